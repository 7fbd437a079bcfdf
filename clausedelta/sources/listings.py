"""Document links from JSON listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import exploded, let, with_computed
from clausedelta.functions.text import strip
from clausedelta.functions.urls import classify_document, with_resolved_url

# JSON values that count as missing when a field is looked up.
_EMPTY = ("null", '""', "0", "0.0", "false", "[]", "{}")


def _text(value: Column) -> Column:
    """Text of a JSON value; booleans and null as the words True, False, None."""
    raw = F.to_json(value)
    return (
        F.when(raw == "true", "True").when(raw == "false", "False").when(raw == "null", "None")
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def _first_present(item: Column, names: list[Column]) -> Column:
    """Text of the first named field that is present and not empty."""

    def pick(name: Column) -> Column:
        value = F.try_element_at(item, name)
        return F.when(~F.to_json(value).isin(*_EMPTY), _text(value))

    return F.coalesce(*[pick(n) for n in names])


# Pieces of a template: doubled braces, fields, text, and braces that fit nowhere.
_PIECES = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"
# Of a field: name, key of an object, conversion, format.
_FIELD = r"^\{([^\[\]!:.]*)(?:\[([^\]]*)\])?(?:!([rsa]))?(?::([^}]*))?\}$"
# Of a format: fill, alignment, sign, zero, width, grouping, precision, type.
_SPEC = r"^(?:(.)?([<>=^]))?([+\- ])?(0)?([0-9]{1,4})?([,_])?(?:\.([0-9]{1,2}))?([bdfFosxX%])?$"


def _grouped(digits: Column, mark: Column) -> Column:
    """Thousands of a whole number's digits set apart."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", mark)


def _spec(spec: Column) -> Column:
    """The parts of a format as a struct."""
    names = ("fill", "align", "sign", "zero", "width", "group", "precision", "kind")
    return F.struct(*[F.regexp_extract(spec, _SPEC, n).alias(name) for n, name in enumerate(names, 1)])


def _padded(lead: Column, body: Column, f: Column, side: str) -> Column:
    """Sign and body brought to the width; ``side`` is where a value goes that the format does not place."""
    pad = F.when(f["fill"] != "", f["fill"]).when(f["zero"] != "", "0").otherwise(" ")
    inner_zero = (f["zero"] != "") & (F.lit(side) == ">")
    place = F.when(f["align"] != "", f["align"]).when(inner_zero, "=").otherwise(side)

    def shaped(x: Column) -> Column:
        missing = F.greatest(F.coalesce(f["width"].try_cast("int"), F.lit(0)) - F.length(x["lead"]) - F.length(x["body"]), F.lit(0))
        left = F.when(x["place"] == ">", missing).when(x["place"] == "^", F.floor(missing / 2)).otherwise(0).cast("int")
        inner = F.when(x["place"] == "=", missing).otherwise(0).cast("int")
        right = F.when(x["place"] == "<", missing).when(x["place"] == "^", F.ceil(missing / 2)).otherwise(0).cast("int")
        return F.concat(F.repeat(x["pad"], left), x["lead"], F.repeat(x["pad"], inner), x["body"], F.repeat(x["pad"], right))

    return let(F.struct(lead.alias("lead"), body.alias("body"), pad.alias("pad"), place.alias("place")), shaped)


def formatted_text(text: Column, spec: Column) -> Column:
    """A text in a format such as >8 or .3; null where the format is one of numbers."""
    def shaped(f: Column) -> Column:
        body = F.when(f["precision"] == "", text).otherwise(F.left(text, f["precision"].try_cast("int")))
        fits = f["kind"].isin("", "s") & (f["sign"] == "") & (f["group"] == "") & (f["align"] != "=")
        return F.when(fits, _padded(F.lit(""), body, f, "<"))

    return F.when(spec == "", text).when(spec.rlike(_SPEC), let(_spec(spec), shaped))


def _fixed(number: Column, f: Column) -> Column:
    """Digits of the number's size with so many decimals; rounding is half to even on its written digits."""
    places = F.when(f["precision"] == "", 6).otherwise(F.least(f["precision"].try_cast("int"), F.lit(12)))
    size = F.abs(number) * F.when(f["kind"] == "%", 100).otherwise(1)
    unit = F.call_function("power", F.lit(10.0), places).cast("decimal(13,0)")

    def digits(x: Column) -> Column:
        before = F.floor(x["total"] / x["unit"]).cast("decimal(38,0)")
        after = F.lpad((x["total"] - before * x["unit"]).cast("decimal(38,0)").cast("string"), x["places"], F.lit("0"))
        return F.concat(_grouped(before.cast("string"), f["group"]), F.when(x["places"] > 0, F.concat(F.lit("."), after)).otherwise(""))

    scaled = lambda x: F.bround((x["size"].cast("decimal(38,12)") * x["unit"]).cast("decimal(38,6)"), 0).cast("decimal(38,0)")
    bound = F.struct(size.alias("size"), unit.alias("unit"), places.alias("places"))
    return let(bound, lambda x: let(F.struct(scaled(x).alias("total"), x["unit"].alias("unit"), x["places"].alias("places")), digits))


def formatted_number(number: Column, whole: Column, written: Column, spec: Column) -> Column:
    """A number in a format such as 05d, +, ,.2f, % or x; null where the format does not fit.

    ``written`` are its digits as the listing has them. Zeros that fill up a grouped number and significant
    digits (.3 without f) are not supported.
    """
    def shaped(x: Column) -> Column:
        f, kind = x["f"], x["f"]["kind"]
        fixed = kind.isin("f", "F", "%")
        plain = F.abs(x["number"]).cast("decimal(38,0)")
        digits = (
            F.when(fixed, _fixed(x["number"], f))
            .when(~x["whole"], F.concat(
                _grouped(F.regexp_extract(x["written"], r"^-?([0-9]*)", 1), f["group"]), F.regexp_replace(x["written"], "^-?[0-9]*", "")
            ))
            .when(kind == "x", F.lower(F.hex(plain.cast("bigint")))).when(kind == "X", F.hex(plain.cast("bigint")))
            .when(kind == "o", F.conv(plain.cast("string"), 10, 8)).when(kind == "b", F.bin(plain.cast("bigint")))
            .otherwise(_grouped(plain.cast("string"), f["group"]))
        )
        body = F.concat(digits, F.when(kind == "%", "%").otherwise(""))
        lead = F.when(x["number"] < 0, "-").when(f["sign"].isin("+", " "), f["sign"]).otherwise("")
        fits = F.when(fixed, F.lit(True)).otherwise(
            (f["precision"] == "") & F.when(x["whole"], kind != "s").otherwise(kind == "")
            & ~(kind.isin("b", "o", "x", "X") & (f["group"] != ""))
        ) & ~((f["zero"] != "") & (f["group"] != ""))
        return F.when(fits, _padded(lead, body, f, ">"))

    bound = F.struct(_spec(spec).alias("f"), number.alias("number"), whole.alias("whole"), written.alias("written"))
    return F.when(spec.rlike(_SPEC), let(bound, shaped))


def formatted(value: Column, spec: Column, as_text: Column) -> Column:
    """A JSON value in a Python format, null where it does not fit. Booleans count as 1 and 0 in formats."""
    def shaped(x: Column) -> Column:
        json, flag = x["json"], x["json"].isin("true", "false")
        number = F.when(flag, F.when(json == "true", 1).otherwise(0)).otherwise(F.try_variant_get(x["value"], "$", "decimal(38,12)"))
        words = (x["spec"] == "") | F.startswith(json, F.lit('"')) | x["as_text"]
        of_number = formatted_number(number, flag | json.rlike(r"^-?[0-9]+$"), json, x["spec"])
        return F.when(words, formatted_text(_text(x["value"]), x["spec"])).when(json != "null", of_number)

    return let(F.struct(value.alias("value"), F.to_json(value).alias("json"), spec.alias("spec"), as_text.alias("as_text")), shaped)


def template_pieces(template: Column, item: Column) -> Column:
    """Array of (text, missing, wrong) of a template's pieces for one record."""

    def fill(piece: Column) -> Column:
        part = lambda n: F.regexp_extract(piece, _FIELD, n)
        held = F.try_element_at(item, part(1))
        inside = F.try_element_at(F.from_json(F.to_json(held), "map<string,variant>"), part(2))
        value = F.when(part(2) != "", inside).otherwise(held)
        field = F.startswith(piece, F.lit("{")) & ~piece.isin("{", "{{")

        def shaped(x: Column) -> Column:
            return F.struct(
                F.when(piece == "{{", "{").when(piece == "}}", "}").when(x["field"], x["text"]).otherwise(piece).alias("text"),
                (x["field"] & x["named"] & x["none"]).alias("missing"),
                (piece.isin("{", "}") | (x["field"] & (~x["named"] | (~x["none"] & x["text"].isNull())))).alias("wrong"),
            )

        return let(
            F.struct(
                field.alias("field"), piece.rlike(_FIELD).alias("named"), value.isNull().alias("none"),
                # Converted to text first, a value takes the formats of a text.
                F.when(field, formatted(value, part(4), part(3) != "")).alias("text"),
            ),
            shaped,
        )

    return F.transform(F.regexp_extract_all(template, F.lit(_PIECES), F.lit(0)), fill)


def _filled_template(template: Column, item: Column) -> Column:
    """Template with each field replaced by its value in its format; null when a field is missing."""
    return let(template_pieces(template, item), lambda pieces: F.when(
        ~F.exists(pieces, lambda p: p["missing"] | p["wrong"]), F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    ))


def parse_listings(payloads: DataFrame) -> DataFrame:
    """One row per payload: source_id, endpoint_url, config, items, error.

    ``payloads``: source_id, endpoint_url, body and the optional settings
    items_key, title_field, url_field, url_template, content_field, date_field.
    A body that is not JSON is a failed source; an empty list is a success.
    """
    # A Python-style listing body is an object, an array or a single value.
    df = with_computed(payloads, _root=F.try_parse_json("body"))
    kind = F.regexp_extract(F.schema_of_variant("_root"), r"^([A-Z]+)", 1)
    df = with_computed(df, _kind=kind)
    df = with_computed(df, _object=F.when(F.col("_kind") == "OBJECT", F.from_json("body", "map<string,variant>")))
    keyed = (F.col("_kind") == "OBJECT") & (F.coalesce("items_key", F.lit("")) != "")
    held = F.try_element_at(F.col("_object"), F.col("items_key"))
    held_kind = F.regexp_extract(F.schema_of_variant(held), r"^([A-Z]+)", 1)
    as_list = F.when(keyed, F.to_json(held)).when(F.col("_kind") == "ARRAY", F.col("body"))
    raw_items = (
        F.when(keyed & (held_kind == "ARRAY"), F.from_json(as_list, "array<variant>"))
        .when(keyed, F.array().cast("array<variant>"))
        .when(F.col("_kind") == "ARRAY", F.from_json("body", "array<variant>"))
        .when(F.col("_kind") == "OBJECT", F.array(F.col("_root")))
        .otherwise(F.array().cast("array<variant>"))
    )
    error = (
        F.when(F.col("_root").isNull(), F.concat(F.lit("Expected JSON from "), F.col("endpoint_url"), F.lit(" but could not parse it")))
        .when(keyed & held.isNotNull() & ~held_kind.isin("ARRAY", "OBJECT", "STRING"), F.lit("items are not a list"))
    )
    df = with_computed(df, error=error)
    items = F.transform(
        F.filter(raw_items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))),
        lambda v: F.from_json(F.to_json(v), "map<string,variant>"),
    )
    df = with_computed(df, items=F.when(F.col("error").isNull(), items)).drop("_root", "_kind", "_object")
    wrong = F.exists("items", lambda v: F.exists(template_pieces(F.col("url_template"), v), lambda p: p["wrong"]))
    df = with_computed(df, error=F.when(F.coalesce(wrong, F.lit(False)), "the url template does not fit a record").otherwise(F.col("error")))
    return df.withColumn("items", F.when(F.col("error").isNull(), F.col("items")))


def listing_results(payloads: DataFrame) -> DataFrame:
    """Success, item count and error per payload."""
    return parse_listings(payloads).select(
        "source_id",
        F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), F.size("items")).otherwise(0).alias("items_found"),
        "error",
    )


def listing_documents(payloads: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """Document links of all payloads that parse, in listing order; snippets are cut only if asked for."""
    df = parse_listings(payloads).where("error is null")
    df = exploded(df.drop("body"), "items", "pos", "item")
    item = F.col("item")
    field = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    title = F.coalesce(
        _first_present(item, [field("title_field", "title"), F.lit("name"), F.lit("filename")]),
        F.lit("Municipal Record"),
    )
    templated = F.nullif(_filled_template(F.col("url_template"), item), F.lit(""))
    url = F.coalesce(
        templated,
        _first_present(item, [field("url_field", "url"), F.lit("download_url"), F.lit("link")]),
        F.col("endpoint_url"),
    )
    snippet = F.coalesce(
        _first_present(item, [field("content_field", "body"), F.lit("description"), F.lit("summary")]), F.lit("")
    )
    date = F.coalesce(_text(F.try_element_at(item, field("date_field", "updated_at"))), F.lit(""))
    df = with_computed(df, _title=title, _url=url, snippet=snippet if snippet_chars is None else F.left(snippet, F.lit(snippet_chars)), date=date).select(
        "source_id", "endpoint_url", "pos", "_title", "_url", "snippet", "date"
    )
    df = with_resolved_url(df, F.col("endpoint_url"), F.col("_url"), "url")
    return df.select(
        "source_id", "pos", strip(F.col("_title")).alias("title"), "url",
        classify_document(F.col("_title"), F.col("url")).alias("document_type"), "snippet", "date",
        F.lit("rest_api_json").alias("source_format"),
    )
