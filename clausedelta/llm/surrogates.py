"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

An entity is ranked among all strings of its format (each letter within its alphabet and case, each
digit, separators fixed), the rank goes one step along a keyed cycle through all ranks, and the new rank is
spelled out in the same format. So distinct entities of a format get distinct surrogates, one entity the same
surrogate wherever it occurs, and none itself, unless its format has one string only. Letters outside the named
alphabets have those of their Unicode neighbourhood and case. Check digits are kept valid, private addresses
private; names keep vowels and consonants in place, and known given names stay within their gender. A check
over the distinct entities of the whole corpus looks for surrogates given twice; should there be one, the key's
round number goes up and the check is repeated.

Names are found behind a title; then every mention of the whole name or of its last word in the same text is
the same entity, before and behind the titled one. A word of a name has one surrogate, whatever title it is
found with. In a dense format a surrogate may be what some other text has as an original.

Defined results: null text stays null, a text without entities stays as it is. Rows are handled one by one;
other columns pass through, a column named like the output `out` is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from clausedelta.llm.segments import slices

FOUND = "kind string, original string, surrogate string"
SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()),
]))
# Alphabets: a letter is replaced by one of the same alphabet.
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
LATIN, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
GREEK, CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüý"
PLAIN = (LATIN, DIGITS, GREEK, CYRILLIC, ACCENTED)
SOUNDED = (VOWELS, CONSONANTS, DIGITS, GREEK, CYRILLIC, ACCENTED)
GIVEN = {
    "f": "anna maria julia laura sophie emma claire elena carmen lucia sarah emily alice martha helen".split(),
    "m": "john peter thomas michael david paul lucas martin carlos pedro hans karl louis james robert".split(),
}

NUMBERS = re.compile(
    r"""(?<![\w.+])(?:
      (?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\.?\d)
    | (?P<ssn>\d{3}-\d\d-\d{4})(?![-\d])
    | (?P<phone>0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d{3,4}[ -]\d{5,7}|0\d(?:[ .]\d\d){4}
      |\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?![-\d])
    | (?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![-\d])
    )""",
    re.VERBOSE,
)
EMAIL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"\b[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b")
SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key)["']?\s*[:=]\s*["']?(?P<secret>[A-Za-z0-9+/_-]{12,})""")
TITLES = r"Mr\.|Mrs\.|Ms\.|Miss|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?\.|Dr\.|Prof\.|Professor|Doctor"
NAME = re.compile(rf"\b(?P<title>{TITLES})(?: +(?:{TITLES}))* +(?P<name>[^\W\d_][\w'-]+)")
NEXT_WORD = re.compile(rf" +(?!(?:{TITLES})\B|(?:{TITLES})\b)([^\W\d_][\w'-]+)")
FEMALE = ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.")
EITHER = ("Dr.", "Prof.", "Professor", "Doctor")
WORD = re.compile(r"[^\W\d_][\w'-]*")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
ANY_DIGIT = re.compile(r"\d")


def spans(text: str) -> list[tuple[int, int, str]]:
    """start, stop, kind of the entities; of overlapping ones the first, then the longest."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in around(EMAIL, text, "@")]
    if ANY_DIGIT.search(text):
        found += [(*m.span(), m.lastgroup) for m in NUMBERS.finditer(text)]
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if iban_rest(m[0]) == 1]
        if text.count(":") > 1:
            found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if is_ipv6(m[0])]
    found += [(*m.span("secret"), "secret") for m in SECRET.finditer(text)] if "=" in text or ":" in text else []
    found += names(text)
    out, upto = [], 0
    for start, stop, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= upto:
            out.append((start, stop, kind))
            upto = stop
    return out


def is_ipv6(value: str) -> bool:
    """An address of three groups and some digits at least, so no word pair such as a::b."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(map(bool, value.split(":"))) > 2 and bool(ANY_DIGIT.search(value))


def names(text: str) -> list[tuple[int, int, str]]:
    """Titled names, and all other mentions of them and of their last words."""
    titled, known = [], {}
    for m in NAME.finditer(text):
        start, stop = last = m.span("name")
        for _ in range(2):  # more words of the name, as long as none begins in lower case
            w = NEXT_WORD.match(text, stop)
            if w is None or w[1][0].islower():
                break
            last, stop = w.span(1), w.end()
        kind = "name_f" if m["title"] in FEMALE else "name_u" if m["title"] in EITHER else "name_m"
        titled.append((start, stop, kind))
        for first in {start, last[0]}:
            name = text[first:stop]
            if not name[0].islower():
                known.setdefault(WORD.match(name)[0], {}).setdefault(name, kind)
    if not known:
        return titled
    for w in WORD.finditer(text):
        for name, kind in known.get(w[0].removesuffix("'s"), {}).items():
            stop = w.start() + len(name)
            if text.startswith(name, w.start()) and not (text[stop : stop + 1].isalnum() or text[stop : stop + 1] == "_"):
                titled.append((w.start(), stop, kind))
    return titled


def around(pattern: re.Pattern, text: str, mark: str) -> Iterator[re.Match]:
    """Matches near a rare mark, without trying every other place of a long text."""
    at, upto = text.find(mark), 0
    while at >= 0:
        start = at
        while start > upto and not text[start - 1].isspace():
            start -= 1
        m = pattern.search(text, start)
        if m and m.start() <= at < m.end():
            yield m
            upto = m.end()
        at = text.find(mark, max(at + 1, upto))


def iban_rest(value: str) -> int:
    moved = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits valid."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


class Permutation:
    """Keyed permutations of 0 .. size - 1: a Feistel network, walked until it lands inside."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, label = (1 << half) - 1, tweak.encode()

        def part(step: int, value: int) -> int:
            raw = hashlib.blake2b(b"%d|%d|%s" % (step, value, label), key=self.key, digest_size=64).digest()
            return int.from_bytes(raw, "little") & mask

        while True:
            left, right = x >> half, x & mask
            for step in range(7, -1, -1) if back else range(8):
                if back:
                    left, right = right ^ part(step, left), left
                else:
                    left, right = right, left ^ part(step, right)
            x = (left << half) | right
            if x < size:
                return x

    def step(self, x: int, size: int, tweak: str) -> int:
        """The next on a keyed cycle through all of 0 .. size - 1, so never x itself where there is another."""
        return self((self(x, size, tweak) + 1) % size, size, tweak, back=True)


@cache
def neighbourhood(low: str) -> str | None:
    """The letters of a character's Unicode neighbourhood, 128 code points, that have its category and their own case."""
    kind, start = unicodedata.category(low), ord(low) & ~127
    if kind not in ("Ll", "Lo"):
        return None
    near = [chr(c) for c in range(start, start + 128) if unicodedata.category(chr(c)) == kind]
    return "".join(c for c in near if kind == "Lo" or (len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c))


def ranked_alphabet(char: str, alphabets: tuple[str, ...]) -> tuple[str, int, bool] | None:
    """Alphabet, place in it and case of a character; None for a separator."""
    low = char.lower()
    if len(low) != 1:
        return None
    for alphabet in alphabets:
        at = alphabet.find(low)
        if at >= 0:
            return alphabet, at, char != low
    if GREEK in alphabets and char.isalpha() and (found := neighbourhood(low)) and low in found:
        taken = "".join(alphabets)
        alphabet = "".join(c for c in found if c not in taken)
        return alphabet, alphabet.index(low), char != low
    return None


def respelled(text: str, permute: Permutation, tweak: str, alphabets: tuple[str, ...], good: Callable[[str], bool] = lambda s: True) -> str:
    """Another string of the same format; walks on until it is good, as the original is."""
    places = [ranked_alphabet(c, alphabets) for c in text]
    rank, size = 0, 1
    for p in places:
        if p:
            rank, size = rank * len(p[0]) + p[1], size * len(p[0])
    shape = tweak + "|" + "".join(
        (chr(65 + alphabets.index(p[0])) if p[0] in alphabets else f"[{ord(p[0][0]):x}]") + "ul"[not p[2]] if p else c
        for c, p in zip(text, places, strict=True)
    )
    while True:
        rank = permute.step(rank, size, shape)
        rest, out = rank, []
        for c, p in zip(reversed(text), reversed(places), strict=True):
            if p:
                rest, at = divmod(rest, len(p[0]))
                c = p[0][at].upper() if p[2] else p[0][at]
            out.append(c)
        made = "".join(reversed(out))
        if good(made):
            return made


def private_part(octets: list[int]) -> int:
    """How many octets name a private or local network; 0 for a public address."""
    if octets[0] in (10, 127):
        return 1
    return 2 if octets[:2] in ([192, 168], [169, 254]) else 0


class Surrogates:
    def __init__(self, key: bytes, version: int = 0) -> None:
        self.permute = Permutation(key + b"|%d" % version)
        self.of = lru_cache(maxsize=100_000)(self.make)

    def make(self, kind: str, value: str) -> str:
        return getattr(self, kind.split("_")[0])(value, kind)

    def email(self, value: str, kind: str) -> str:
        """The top-level domain stays."""
        head, _, top = value.lower().rpartition(".")
        return respelled(head, self.permute, kind + top, PLAIN) + "." + top

    def ip(self, value: str, kind: str) -> str:
        """Private addresses stay in their network, public ones public."""
        octets = [int(p) for p in value.split(".")]
        kept = private_part(octets)
        number, bits = int.from_bytes(bytes(octets[kept:])), 8 * (4 - kept)
        while True:
            number = self.permute.step(number, 1 << bits, f"{kind}{octets[:kept]}")
            made = octets[:kept] + list(number.to_bytes(4 - kept))
            if private_part(made) == kept:
                return ".".join(map(str, made))

    def ipv6(self, value: str, kind: str) -> str:
        """Permuted in its short form, so that spellings of one address agree; long and upper-case ones stay so."""
        old = ipaddress.IPv6Address(value)

        def good(made: str) -> bool:
            try:
                new = ipaddress.IPv6Address(made)
            except ValueError:
                return False
            return new.compressed == made and (new.is_private, new.is_link_local, new.is_multicast) == (
                old.is_private, old.is_link_local, old.is_multicast
            )

        head = re.match(r"(?:fe80|f[cd]..|ff..|2001:db8|2001)?", old.compressed)[0]  # networks of a special meaning, and the usual one
        made = head + respelled(old.compressed[len(head) :], self.permute, kind + head, ("0123456789abcdef",), lambda s: good(head + s))
        made = ipaddress.IPv6Address(made).exploded if value.lower() == old.exploded != old.compressed else made
        return made.upper() if value != value.lower() else made

    def ssn(self, value: str, kind: str) -> str:
        return respelled(value, self.permute, kind, (DIGITS,))

    def phone(self, value: str, kind: str) -> str:
        """The last ten digits, or what follows a country code, are permuted; so formats of one number agree."""
        digits = re.sub(r"\D", "", value)
        code = re.match(r"\+(\d{1,3})(?=\D)", value)
        kept = len(code[1]) if code else max(0, len(digits) - 10)
        tail = digits[kept:]
        new = iter(digits[:kept] + respelled(tail, self.permute, kind, (DIGITS,), lambda s: (s[0] == "0") == (tail[0] == "0")))
        return re.sub(r"\d", lambda _: next(new), value)

    def card(self, value: str, kind: str) -> str:
        """Valid numbers become valid ones, others others; grouping stays."""
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) == digits[-1]:
            head = respelled(digits[:-1], self.permute, kind + "valid", (DIGITS,))
            made = head + luhn_digit(head)
        else:
            made = respelled(digits, self.permute, kind, (DIGITS,), lambda s: luhn_digit(s[:-1]) != s[-1])
        new = iter(made)
        return re.sub(r"\d", lambda _: next(new), value)

    def iban(self, value: str, kind: str) -> str:
        """Country and grouping stay, the check digits are computed anew."""
        plain = value.replace(" ", "")
        body = respelled(plain[4:], self.permute, kind + plain[:2], (LATIN, DIGITS))
        check = 98 - iban_rest(plain[:2] + "00" + body)
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return re.sub(r"\S", lambda _: next(new), value)

    def secret(self, value: str, kind: str) -> str:
        alphabets = ("0123456789abcdef",) if re.fullmatch("[0-9a-f]+", value) else (LATIN, DIGITS)
        return respelled(value, self.permute, kind, alphabets)

    def name(self, value: str, kind: str) -> str:
        """Known given names are exchanged within their gender; other names keep sounds, length and last letter."""
        return " ".join(self.part(p, kind) for p in re.split(" +", value))

    def part(self, word: str, kind: str) -> str:
        for gender, known in GIVEN.items():
            if word.lower() in known:
                new = known[self.permute.step(known.index(word.lower()), len(known), "given " + gender)]
                return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new
        every = {n for names in GIVEN.values() for n in names}
        end = word[-1] if len(word) > 2 else ""
        head = word[: len(word) - len(end)]
        return respelled(head, self.permute, "name" + end, SOUNDED, lambda s: (s + end).lower() not in every) + end


def canonical(kind: str, value: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", value)
        return digits[-10:] if kind == "phone" else digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).compressed
    if kind == "ip":
        return ".".join(str(int(p)) for p in value.split("."))
    return value.lower() if kind == "email" else re.sub(" +", " ", value) if kind == "name" else value


def plain_kind(kind: str) -> str:
    """Names are one kind, whatever title they are found with."""
    return kind.split("_")[0]


def pairs(docs: DataFrame, key: bytes, version: int) -> DataFrame:
    """kind, original, surrogate in canonical form: the distinct entities of the texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key, version)
        for batch in batches:
            for part in slices(batch, "text"):
                seen = {
                    (plain_kind(k), canonical(plain_kind(k), t[a:b]), canonical(plain_kind(k), made.of(k, t[a:b])))
                    for t in part["text"].to_pylist() if t for a, b, k in spans(t)
                }
                cols = list(zip(*sorted(seen), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "original", "surrogate"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(find, FOUND).distinct()


def collision_free_version(docs: DataFrame, key: bytes) -> int:
    """The first round number of the key that gives no surrogate to two entities."""
    version = 0
    while True:
        table = pairs(docs, key, version)
        if table.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return version
        version += 1


def rewritten(docs: DataFrame, key: bytes, version: int, out: str = "entities") -> DataFrame:
    """The rows with surrogates in text, and `out`: kind, start and stop (characters of the new text)."""
    rest = docs.drop(out).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*rest.schema.fields, StructField(out, SPANS)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key, version)
        for batch in batches:
            for part in slices(batch, "text"):
                texts, lists = [], []
                for text in part["text"].to_pylist():
                    pieces, marks, upto, size = [], [], 0, 0
                    for start, stop, kind in spans(text) if text else ():
                        new = made.of(kind, text[start:stop])
                        pieces += [text[upto:start], new]
                        size += start - upto
                        marks.append({"kind": kind, "start": size, "stop": size + len(new)})
                        size, upto = size + len(new), stop
                    texts.append("".join([*pieces, text[upto:]]) if marks else text)
                    lists.append(marks)
                at = part.schema.get_field_index("text")
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind)], [*part.schema.names, out])

    return rest.mapInArrow(write, schema)


def surrogate_documents(docs: DataFrame, key: bytes, out: str = "entities") -> DataFrame:
    return rewritten(docs, key, collision_free_version(docs, key), out)
