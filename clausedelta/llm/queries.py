"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.llm.common import read_table, written


# Of the registered queries alone; a user brings a secret of their own.
SURROGATE_KEY = b"registered queries"


def op2_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.digest_index import deduplicated

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.balanced_shards import shard_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.language_profiles import held_out, identify, learn

    docs = read_table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = identify(docs.select("doc_id", "text"), prototypes)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clausedelta.llm.hilbert_packing import pack_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, with_ids=False).drop("ids")


def op7_sentencepiece_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clausedelta.llm.sentencepiece_backend import code_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return code_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.jaccard_groups import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.paragraph_minhash import repeated_passages

    return repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.vantage_trees import build_index, search, usable

    rows = written(usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return search(build_index(rows), rows.where("vec_id % 20 = 0"), k=20, factor=5.0)


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.language_profiles import held_out
    from clausedelta.llm.ngram_trie import score_held_out

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = held_out(F.col("doc_id"), parts=5)
    rows = score_held_out(docs, kept)
    return rows.select("doc_id", kept.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.surrogates import surrogate_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate_documents(docs, SURROGATE_KEY).withColumn("n_entities", F.size("entities").cast("long"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.prefix_trie import trie_nodes, turn_ids, with_shared_heads

    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie_nodes(with_shared_heads(turn_ids(conversations)))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.llm.ranked_search import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clausedelta.llm.token_counts import count_tokens

    rows = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 4096)


REGISTERED = {
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
    "op3_surrogates": op3_surrogates,
    "op1_ngram_trie": op1_ngram_trie,
    "op6_vantage_trees": op6_vantage_trees,
    "op4_paragraph_minhash": op4_paragraph_minhash,
    "op5_grouped_prefix_join": op5_grouped_prefix_join,
    "op7_sentencepiece_backend": op7_sentencepiece_backend,
    "op8_hilbert_packing": op8_hilbert_packing,
    "op10_language_profiles": op10_language_profiles,
    "op2_digest_index": op2_digest_index,
    "op9_balanced_shards": op9_balanced_shards,
}

# The crc32 of a short ASCII text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda ch: ascii(ch)::bigint)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384::bigint) else y // 2 end)), 4294967295::bigint)"""

ORACLES = {
    "op11_prefix_trie": f"""
        with t as (select conv_id as c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) order by turn nulls first) as turns
                   from conversations where conv_id is not null group by conv_id),
        h as (select c, turns, c - c % 100 as base, ({CRC32.format(x="c::varchar")} % 6)::bigint as h from t),
        b as (select h.c, list_concat(coalesce(t.turns, [])[1:h.h], h.turns[h.h + 1:]) as s from h left join t on t.c = h.base),
        p as (select c, len(s) as n, d, s[1:d] as path from (select c, s, unnest(range(len(s) + 1)) as d from b)),
        g as (select path, d, min(c) as conv_id, count(*) as n_convs, max(n) = d as leaf,
                     (count(*) - 1) * coalesce(length(max(path[d].x)), 0) as saved,
                     sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256
              from p group by path, d),
        up as (select path, path[1:k] as top, leaf, saved from (select *, unnest(range(d + 1)) as k from g)),
        sub as (select top, count(*) filter (leaf) as n_leaves, sum(saved)::bigint as saved_tokens from up group by top),
        kids as (select path[1:d - 1] as top, count(*) as n_children from g where d > 0 group by 1)
        select g.conv_id, g.d as depth, o.conv_id as parent_conv_id, g.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, g.ends_sha256
        from g join sub on sub.top = g.path left join kids on kids.top = g.path
        left join g o on g.d > 0 and o.d = g.d - 1 and o.path = g.path[1:g.d - 1]""",
    "op12_ranked_search": r"""
        with w as (select doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents where text is not null),
        d as (select id, len(words)::bigint as n, words from w where len(words) > 0),
        a as (select count(*)::bigint as nn, sum(n)::bigint as ll from d),
        tf as (select id, n, term, count(*)::bigint as tf from (select id, n, unnest(words) as term from d) group by all),
        df as (select term, floor(1000 * ln((2.0::double * nn + 2) / (2 * count(*) + 1)))::bigint as wt from tf, a group by term, nn),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        s as (select item_id, id as doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
              from q join tf using (term) join df using (term), a group by item_id, id)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
        from s where score > 0 qualify rank <= 50""",

    "op2_digest_index": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
                   from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
}
