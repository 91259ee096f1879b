"""Line dedup with DataFrame functions only: lines that many documents share go, the rest is put together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, row_key, stored

MIN_DOCUMENTS = 10
MIN_KEY_CHARS = 1


def split_lines(text: Column) -> Column:
    """The text split at \\n; one empty line for null or empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _hashed(line: Column) -> Column:
    """128 bits for a line's key in two longs of different seeds; null for keys that never go."""
    key = line_key(line)
    return F.when(F.char_length(key) >= MIN_KEY_CHARS, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with columns _n_lines, _n_dropped and _kept added.

    Each row is a document. A line's key is the line without white space at its ends, A-Z lower-cased. Lines whose
    key is found in min_documents rows or more go from every row; a key is counted once for each row. Empty keys
    stay. A null or empty text is one empty line and is kept as ''. Repeated rows get the same result each, and
    each counts as a document. Columns beside text and doc_id pass through.

    Only hashes and positions are shuffled for counting, with map-side sums, so a line that a third of all rows
    hold costs one row for each task. Texts are shuffled once, to meet the positions that go.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    inner = docs.select(F.struct(*rest).alias("_rest"), F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").alias("_id"))
    inner = inner.select("_rest", "_text", *row_key("_id", "_text"))
    hashes = F.transform(split_lines(F.col("_text")), _hashed)
    often = (
        inner.select(F.explode(F.array_distinct(hashes)).alias("_l"))
        .where(F.col("_l").isNotNull())
        .groupBy(F.col("_l.a").alias("a"), F.col("_l.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_documents)
        .select("a", "b")
    )
    often = stored(often, "frequent-lines")  # a table of its own, so that Spark can split the join at a hot key
    at = inner.select("_k", "_h", F.posexplode(hashes).alias("_p", "_l")).where(F.col("_l").isNotNull()).select("_k", "_h", "_p", F.col("_l.a").alias("a"), F.col("_l.b").alias("b"))
    gone = at.join(often, ["a", "b"], "left_semi").groupBy("_k", "_h").agg(F.array_sort(F.collect_set("_p")).alias("_gone"))
    joined = inner.join(gone, ["_k", "_h"], "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    return joined.withColumn("_s", split_lines(F.col("_text"))).select(
        *[F.col("_text").alias(text) if c == text else F.col(f"_rest.`{c}`") for c in docs.columns],
        F.size("_s").cast("long").alias("_n_lines"),
        F.size("_gone").cast("long").alias("_n_dropped"),
        F.when(F.size("_gone") == 0, F.coalesce("_text", F.lit(""))).otherwise(_without(F.col("_s"), F.col("_gone"))).alias("_kept"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """The lines at other positions than those in the sorted array gone, in time linear in both."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    spans = F.transform(
        F.array(F.struct(lines.alias("s"), edges.alias("e"))),
        lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["e"]) - 1), lambda i: F.slice(x["s"], F.get(x["e"], i - 1) + 2, F.get(x["e"], i) - F.get(x["e"], i - 1) - 1))),
    )
    return F.array_join(F.element_at(spans, 1), "\n")


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """documents with the shared lines taken out of text; columns as before."""
    out = dedup_lines(docs, min_documents)
    return out.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents
), x AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS p FROM l
), k AS (
  SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.p) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))
