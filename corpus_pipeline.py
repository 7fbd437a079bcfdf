"""The corpus pipeline: language ID, exact dedup, near dedup, surrogates for personal data, packing.

Every stage works on all rows that its predecessor kept and returns the columns of documents, the last
one the pieces of the packed sequences. Results of a stage are written to the shared folder and reread,
so a lost executor costs no more than a part of one stage.

Defined results. Language ID drops texts without a letter and texts like none of the languages: those of
which less than half the letters are usual ones (the commonest that make up 99 % of a language's training
letters), and those whose cosine is within the noise for their number of letters (see needed_cosine). Exact dedup keeps one row of each text, A-Z lowered, that of the largest doc_id.
Near dedup keeps the smallest doc_id of each group of linked documents; rows without an id stay. Texts
whose personal data is replaced get a new n_chars, where that column exists. Null text is without a
letter. Columns of any name pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausedelta.llm.common import ascii_lower, read_table, written

MIN_COSINE = 0.125  # four times the spread of the cosine of unrelated random vectors at DIM = 1024, 1/32
FULL_LETTERS = 100  # the cosine of a text grows with the square root of its letters; from here on it is at its height
SLACK = 0.0625  # twice that spread: what a text of no letters at all may fall below zero
SEQUENCE = 4096
PII_KEY = b"corpus pipeline"  # of the registered query alone; a user brings a secret of their own


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from clausedelta.llm.language_profiles import UNKNOWN, held_out, identify, learn, usual_letters

    out, n = ("_stage_lang", "_stage_cosine"), ("_stage_letters", "_stage_usual")
    training = docs.where(~held_out(F.col("doc_id")))
    judged = identify(docs, learn(training), out=out, usual=usual_letters(training), counts=n)
    like = F.col(out[1]) >= needed_cosine(F.col(n[0]))
    return judged.where((F.col(out[0]) != UNKNOWN) & (F.col(n[1]) * 2 >= F.col(n[0])) & like).drop(*out, *n)


def needed_cosine(letters: Column) -> Column:
    """The same likeness per trigram whatever the length, less the spread of the noise, which is all that short texts have."""
    grown = F.least(F.lit(1.0), F.sqrt(letters / FULL_LETTERS))
    return grown * MIN_COSINE - (1 - grown) * SLACK


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from clausedelta.llm.digest_index import deduplicated

    kept = deduplicated(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept"))
    text = F.coalesce(ascii_lower(F.col("text")), F.lit(""))
    rows = docs.withColumn("_digest", F.unhex(F.sha2(text, 256)))
    same = (rows["_digest"] == kept["_kept"]) & rows["doc_id"].cast("long").eqNullSafe(kept["_kept_id"])
    rows = rows.join(kept.distinct(), same, "left_semi")
    one = Window.partitionBy("_digest", "doc_id").orderBy("_digest")  # rows that repeat an id and its text
    return rows.withColumn("_place", F.row_number().over(one)).where("_place = 1").drop("_digest", "_place")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from clausedelta.llm.jaccard_groups import jaccard_components

    gone = jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from clausedelta.llm.surrogates import surrogate_documents

    rows = surrogate_documents(docs, PII_KEY, out="_entities")
    if "n_chars" in rows.columns:
        new = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(F.size("_entities") > 0, new).otherwise(F.col("n_chars")))
    return rows.drop("_entities")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clausedelta.llm.hilbert_packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("surrogates", private_stage),
    ("packing", packing_stage),
]

# Language profiles, shingle components and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTERED = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
