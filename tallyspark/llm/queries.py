"""The operators' registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, jaccard, langid, line_dedup, mixing, quality, sharding, topk
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"))


def op2_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(more), *vocabulary()), *vocabulary())


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"] % 100 == 0, k=10, scale=1024)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def _held_out(docs: DataFrame):
    """Documents that op8 never learns from: crc32 of the id as text leaves 1 mod 3, or the id is null."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.filter(~_held_out(docs)))
    return out.select("doc_id", _held_out(out).alias("held_out"), "lang_pred", "score")


def domain(docs: DataFrame):
    """A source's domain: the documents have none, so sources are dealt to four by their name's CRC-32."""
    return F.concat(F.lit("d"), F.crc32(docs["source"].cast("binary")) % 4)


MIXTURE = mixing.Mixture(weights={("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0}, share=0.6, epochs=4, seed=11)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, [domain(docs), docs["lang"], docs["source"]], MIXTURE)
    return out.select("doc_id", domain(out).alias("domain"), "lang", "source", "mix_epoch", "mix_tokens", "mix_target")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_balanced_sharding": op2_balanced_sharding,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_source_mixing": op9_source_mixing,
    "op10_line_dedup": op10_line_dedup,
}

#: Lower case of A-Z only, and trimming of ASCII white space only, in DuckDB.
_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
t10 AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM p),
g AS (SELECT doc_id, n, i, array_to_string(w[1:n], ' ') AS gram FROM t10, (SELECT unnest([3, 5, 8, 10]) AS n) WHERE len(w) >= n),
d AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS c FROM g) WHERE c > 1),
v AS (SELECT DISTINCT doc_id, n, i + unnest(range(0, n)) AS i FROM d),
c AS (SELECT doc_id, count(*) FILTER (WHERE n = 8) AS n_repeat_words, sum(length(word)) FILTER (WHERE n = 3) AS c3, sum(length(word)) FILTER (WHERE n = 5) AS c5,
             sum(length(word)) FILTER (WHERE n = 8) AS c8, sum(length(word)) FILTER (WHERE n = 10) AS c10 FROM v JOIN p USING (doc_id, i) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
f AS (SELECT doc_id, line, count(*) AS k, length(line) AS chars FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
n AS (SELECT doc_id, sum(k - 1) AS n_dup_lines, sum((k - 1) * chars) AS dup_chars, sum(k * chars) AS line_chars FROM f GROUP BY doc_id),
t AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
m AS (SELECT t.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(c3, 0) / greatest(word_chars, 1) AS s3, coalesce(c5, 0) / greatest(word_chars, 1) AS s5, coalesce(c8, 0) / greatest(word_chars, 1) AS s8, coalesce(c10, 0) / greatest(word_chars, 1) AS s10,
             coalesce(dup_chars, 0) / greatest(coalesce(line_chars, 0), 1) AS sl FROM t LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND s3 <= 0.60 AND s5 <= 0.45 AND s8 <= 0.42 AND s10 <= 0.40 AND sl <= 0.30 AS kept,
       s3 AS dup_3gram_share, s5 AS dup_5gram_share, s8 AS dup_8gram_share, s10 AS dup_10gram_share, sl AS dup_line_share FROM b
"""

OP10_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, {_KEY} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.i, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(any_value(k.n_links), 0) AS n_links, min(r.y) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op10_line_dedup": OP10_SQL}
