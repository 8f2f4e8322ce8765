"""The queries op1 to op10 over the whole driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm import sharding
from texloom.llm.common import read_table
from texloom.llm.language import fit_language, label_language
from texloom.llm.metric_search import top_k
from texloom.llm.mixing import mix, word_count
from texloom.llm.near_copies import near_copies
from texloom.llm.pieces import encode_decode
from texloom.llm.prefix_tokens import token_counts
from texloom.llm.repetition import repetition
from texloom.llm.sharding import shard_rows
from texloom.llm.toxicity import fit_toxicity, grade_toxicity
from texloom.llm.warc import archive_folder, chunk_rows, read_records, write_archives

BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 8


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine and on the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """Whether language training must not read a document; a null id is read."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(read_table(spark, sf_dir, "documents"), SHARDS, keep=["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language(docs.where(~held_out(F.col("doc_id"))))
    rows = label_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_changes", "certainty")


def op3_prefix_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary or tokenizer_path(BPE_FILE), limit=1024, keep=["doc_id"])


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), model or tokenizer_path(PIECE_FILE), keep=["doc_id"])


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    manifest = write_archives(chunk_rows(pages, "page_id", "url", "html"), archive_folder(spark))
    kind = pages.schema["page_id"].dataType
    return read_records(manifest).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return grade_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])


def op10_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mix(docs, word_count(F.col("text")), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_shards,
        op2_language_field,
        op3_prefix_tokens,
        op4_suffix_repeats,
        op5_sentencepiece,
        op6_warc_chunks,
        op7_mtree_topk,
        op8_lsh_forest,
        op9_ordinal_toxicity,
        op10_fair_queue_mix,
    )
}


def _hex_number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _shard_sql() -> str:
    """The network's rounds as one select each; values outside the range go round again."""
    digest = lambda value, r: _hex_number(f"'17:{r}:' || ({value})::VARCHAR")
    rounds, name = "", "split"
    for r in range(sharding.ROUNDS):
        left, right = ("l", f"(r + {digest('l', r)}) % b") if r % 2 else (f"(l + {digest('r', r)}) % a", "r")
        rounds = f"SELECT doc_id, size, text_crc32, n, a, b, {left} AS l, {right} AS r FROM ({rounds or 'SELECT doc_id, size, text_crc32, n, a, b, p // b AS l, p % b AS r FROM walk WHERE step = 0 OR p >= n'})"
        name = f"r{r}"
    return f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
sized AS (
  SELECT doc_id, octet_length(encode(t)) + 1 AS size,
    xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM bits),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY coalesce({_hex_number('doc_id::VARCHAR')} % {sharding.BUCKETS}, 0), doc_id NULLS FIRST, size, text_crc32) - 1 AS p,
    count(*) OVER () AS n FROM sized),
walk AS (
  SELECT 0 AS step, doc_id, size, text_crc32, n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b, p FROM numbered
  UNION ALL
  SELECT 1, doc_id, size, text_crc32, n, a, b, l * b + r FROM ({rounds}))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % {SHARDS})::INT AS shard, p // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM walk WHERE step = 1 AND p < n
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(encode(body)) AS h FROM p),
k AS (SELECT h, max(page_id) AS keeper FROM d GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d.h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d JOIN k ON d.h = k.h
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.f, c.f)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(('0x' || substr(md5('23:' || doc_id::VARCHAR), 1, 8))::BIGINT, 0) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
c AS (SELECT *, source_size * 2 AS cap, source_size * 2 / weight AS lvl FROM w),
f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    (budget - coalesce(sum(cap) OVER before, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS fill
  FROM c WINDOW before AS (ORDER BY lvl, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (SELECT arg_min(fill, lvl) FROM f WHERE fill <= lvl) AS water FROM f),
t AS (SELECT *, CASE WHEN water IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, water * weight) END AS target FROM g),
q AS (
  SELECT d.*, source_size, weight, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT q.*, e, (source_size * e + upto)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1)) x(e)),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, e ROWS UNBOUNDED PRECEDING) AS run FROM o WHERE size > 0)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, coalesce(sum(z.size) FILTER (z.run <= z.budget), 0)::BIGINT AS taken
FROM q LEFT JOIN z ON q.doc_id = z.doc_id GROUP BY q.doc_id, q.size, q.source_size, q.target
"""

#: All pairs by their common n-grams, then the closure of the links.
_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM d),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a),
n AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT r.doc_id, min(r.root) AS class_id, coalesce(any_value(n.links), 0)::BIGINT AS n_links FROM r LEFT JOIN n ON n.a = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_feistel_shards": _shard_sql(),
    "op6_warc_chunks": _WARC_SQL,
    "op7_mtree_topk": _TOPK_SQL,
    "op8_lsh_forest": _NEAR_SQL,
    "op10_fair_queue_mix": _MIX_SQL,
}
