"""Target-distribution importance resampling: hashed word features, log ratios of two bucket histograms, and a weighted draw.

The buckets of every document are written once as packed streams of unsigned 16-bit integers with the documents' ends
beside them. One pass over the streams sorts and run-length encodes them for the counts; a second gathers each
bucket's gain and sums the gains of a document with np.add.reduceat. The draw takes the highest sums of weight and
Gumbel noise, which depends on the seed and the doc_id alone.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import read, stored

BUCKETS = 10_000  # 65,536 at most
NGRAMS = 1
SEED = 2024
MIN_WORDS = 20
DRAWN_PERCENT = 10
#: Buckets in one stream, about; a longer document is a stream of its own.
STREAM = 1_000_000

_STREAMS = "ids array<long>, ends binary, words binary, buckets binary"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("words", pa.binary()), ("buckets", pa.binary())])
# bytes of words stay, A-Z lower-cased; all others separate. In UTF-8 bytes from 128 on belong to words.
_TABLE = bytes(ord(chr(i).lower()) if i >= 128 or chr(i) in string.ascii_letters + string.digits else 32 for i in range(128)) + bytes(range(128, 256))


def features(text: bytes, ngrams: int) -> tuple[int, list[bytes]]:
    """(number of words, runs of 1 to ngrams consecutive words) of a text in UTF-8."""
    words = text.translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    runs = words
    for n in range(2, ngrams + 1):
        runs = runs + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def _packed(buckets: int, ngrams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams of about STREAM buckets; ends are positions after each document's last one."""
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        words: list[int] = []
        size = 0

        def stream() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts], dtype="<i8")
            row = {"ids": [list(ids)], "ends": [ends.tobytes()], "words": [np.array(words, dtype="<i8").tobytes()], "buckets": [np.concatenate(parts).tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                n, runs = features((text.as_py() or "").encode(), ngrams)
                ids.append(i)
                words.append(n)
                parts.append((np.fromiter(map(crc32, runs), dtype=np.uint32, count=len(runs)) % buckets).astype("<u2"))
                size += len(runs)
                if size >= STREAM or len(ids) >= STREAM // 8:
                    yield stream()
                    ids, parts, words, size = [], [], [], 0
        if ids:
            yield stream()

    return run


def streams(docs: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> DataFrame:
    """The packed streams of docs(doc_id, text), stored in the shared folder. A null text has no words."""
    if not 0 < buckets <= 65_536:
        raise ValueError("buckets: 1 to 65,536")
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(buckets, ngrams), _STREAMS), "bucket-streams")


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts: each stream is sorted, its runs' lengths are added up."""
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for s in b.column("buckets"):
                x = np.sort(np.frombuffer(s.as_buffer(), dtype="<u2"))
                starts = np.flatnonzero(np.diff(x, prepend=-1 if not len(x) else int(x[0]) - 1))
                total[x[starts]] += np.diff(starts, append=len(x))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return run


def histogram(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket: at most buckets rows a task, one table of that size on the driver."""
    rows = packed.select("buckets").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed share in the target to that in the raw corpus."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Standard Gumbel noise in thousandths, from a digest of seed and doc_id; a null id counts as ''."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(table: Broadcast, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for b in batches:
            for ids, ends, words, stream in zip(*(b.column(c) for c in ("ids", "ends", "words", "buckets")), strict=True):
                end = np.frombuffer(ends.as_buffer(), dtype="<i8")
                size = np.diff(end, prepend=0)
                weight, some = np.zeros(len(size), dtype=np.int64), size > 0
                if some.any():
                    # documents without features would repeat their neighbour's first gain, so they are left out
                    sums = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), dtype="<u2")], (end - size)[some])
                    weight[some] = sums // size[some]
                known = ids.as_py()
                score = weight + np.array([noise(i, seed) for i in known], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), *[pa.array(x, pa.int64()) for x in (size, np.frombuffer(words.as_buffer(), dtype="<i8"), weight, score)]], ["doc_id", "n_features", "n_words", "weight", "score"])

    return run


def weights(packed: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each document in the streams; gains are a table of one number a bucket."""
    table = packed.sparkSession.sparkContext.broadcast(gain)
    return packed.mapInArrow(_weighed(table, seed), "doc_id long, n_features long, n_words long, weight long, score long")


def resampled(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) for each row of docs(doc_id, text); target has a column text.

    rank numbers the drawn: percent of the documents with min_words or more, rounded down, by falling score, then
    rising doc_id, nulls last; others have null. Rows of equal score and id fall by features and weight, so what is
    left of ties are equal rows. Rows with null or empty texts have no features, weight 0, and are never drawn. With
    no target all gains come from the corpus alone; an empty corpus gives an empty result. Other columns are not read.
    """
    packed = streams(docs, buckets, ngrams)
    wanted = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, ngrams)
    found = stored(weights(packed, gains(histogram(packed, buckets), histogram(wanted, buckets)), seed), "weights")
    enough = found.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = numbered(enough, order, "rank").withColumn("rank", F.when(F.col("rank") <= enough.count() * percent // 100, F.col("rank")))
    return placed.unionByName(found.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resampled(spark, read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT {_WORDS} AS w FROM benchmark
), v AS (SELECT DISTINCT x FROM (SELECT unnest(w) AS x FROM d UNION ALL SELECT unnest(w) FROM b)
), k AS (SELECT list(list_reduce(range(8), lambda c, j: {_BIT}, i) ORDER BY i) AS crc FROM range(256) AS g(i)
), y AS (SELECT x, hex(encode(x)) AS h FROM v
), z AS (SELECT x, list_transform(range(len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM y
), f AS (SELECT x, xor(list_reduce(bytes, lambda c, o: xor(c >> 8, crc[(xor(c, o) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {BUCKETS} AS bucket FROM z, k
), s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS x FROM d) JOIN f USING (x) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) JOIN f USING (x) GROUP BY bucket
), g AS (
  SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}::DOUBLE)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) AS r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
), q AS (SELECT doc_id, sum(gain) AS gain FROM (SELECT doc_id, unnest(w) AS x FROM d) JOIN f USING (x) JOIN g USING (bucket) GROUP BY doc_id
), p AS (
  SELECT d.doc_id, len(w) AS n_features, CAST(coalesce(floor(gain / CAST(len(w) AS DOUBLE)), 0) AS BIGINT) AS weight, sha256('{SEED}:' || d.doc_id) AS h FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), u AS (SELECT *, list_reduce(range(1, 9), lambda a, i: a * 16 + instr('0123456789abcdef', h[i]) - 1, CAST(0 AS BIGINT)) AS u FROM p
), x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM u
), r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS rank, count(*) FILTER (WHERE n_features >= {MIN_WORDS}) OVER () AS total FROM x)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN n_features >= {MIN_WORDS} AND rank <= total * {DRAWN_PERCENT} // 100 THEN rank END AS BIGINT) AS rank FROM r
"""
