"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection in each tile, merged top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored

K = 20
SCALE = 64
EVERY = 20
#: Rows of a tile's two sides: a tile of scores takes 8 * QUERY_BLOCK * SHARD_BLOCK bytes.
QUERY_BLOCK = 512
SHARD_BLOCK = 8192

_BLOCKS = "part int, dim int, query boolean, ids binary, ords binary, vectors binary"
_HITS = "query_id long, query_ord long, dim int, vec_id long, ord long, score long"


def scaled(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, ord, v): components floor(scale * x) of the rows that take part.

    Rows with a null id, a null vector, or a component that is null or not finite take no part; empty vectors meet
    each other with score 0. ord tells repeated ids apart.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return rows.select("vec_id", whole.alias("v")).withColumn("ord", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long"))


def _tiles(side: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of up to side rows of one dimension."""
        kept: dict[int, list[tuple[int, int, list[int]]]] = {}
        n = 0

        def block(dim: int) -> pa.RecordBatch:
            rows = kept.pop(dim)
            m = np.array([r[2] for r in rows], dtype="<i8")
            return pa.RecordBatch.from_pydict(
                {"part": [n], "dim": [dim], "query": [query], "ids": [np.array([r[0] for r in rows], dtype="<i8").tobytes()], "ords": [np.array([r[1] for r in rows], dtype="<i8").tobytes()], "vectors": [m.tobytes()]},
                schema=pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("query", pa.bool_()), ("ids", pa.binary()), ("ords", pa.binary()), ("vectors", pa.binary())]),
            )

        for b in batches:
            for i, o, v in zip(b.column("vec_id").to_pylist(), b.column("ord").to_pylist(), b.column("v").to_pylist(), strict=True):
                kept.setdefault(len(v), []).append((i, o, v))
                if len(kept[len(v)]) == side:
                    yield block(len(v))
                    n += 1
        for dim in list(kept):
            yield block(dim)
            n += 1

    return run


def _best(score: np.ndarray, ids: np.ndarray, ords: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best in each row by score, then smaller id and ord; the columns come sorted by id and ord."""
    if score.shape[1] <= k:
        return np.argsort(-score, axis=1, kind="stable")
    floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = score > floor, score == floor
    fill = level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))
    at = np.nonzero(above | fill)[1].reshape(len(score), k)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, axis=1), axis=1, kind="stable"), axis=1)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where those are exact, else in integers."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q @ x.T


def _search(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of one shard group for every query of one query group."""
        out = []
        load = lambda r: (np.frombuffer(r.ids, "<i8"), np.frombuffer(r.ords, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(len(r.ids) // 8, r.dim))
        shards = []
        for r in right.itertuples():
            ids, ords, x = load(r)
            order = np.lexsort((ords, ids))
            shards.append((r.dim, ids[order], ords[order], x[order]))
        for r in left.itertuples():
            qi, qo, q = load(r)
            top: list[np.ndarray] = []
            for dim, ids, ords, x in shards:
                if dim != r.dim:
                    continue
                s = _product(q, x)
                own = np.searchsorted(ids, qi), np.searchsorted(ids, qi, side="right")
                lowest = np.iinfo(np.int64).min
                for row in np.flatnonzero(own[1] > own[0]):
                    s[row, own[0][row] : own[1][row]][ords[own[0][row] : own[1][row]] == qo[row]] = lowest
                at = _best(s, ids, ords, k)
                hit = np.stack([ids[at], ords[at], np.take_along_axis(s, at, axis=1)])
                top.append(hit)
            if not top:
                continue
            merged = np.concatenate(top, axis=2)
            order = np.lexsort((merged[1], merged[0], -np.maximum(merged[2], np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
            ids, ords, s = (np.take_along_axis(m, order, axis=1) for m in merged)
            ok = s > np.iinfo(np.int64).min
            out.append(pd.DataFrame({"query_id": np.repeat(qi, s.shape[1])[ok.ravel()], "query_ord": np.repeat(qo, s.shape[1])[ok.ravel()], "dim": r.dim, "vec_id": ids[ok], "ord": ords[ok], "score": s[ok]}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _HITS.split(", ")})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, shard_groups: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries its k best of rows, itself left out; both as from scaled().

    Ties go to the smaller vec_id. Vectors meet those of the same length only. The rows lie in blocks of SHARD_BLOCK,
    the blocks in shard groups; each block of queries is sent once to every group, so a task holds one shard group and
    scores it tile by tile. Each group gives at most k hits for a query; those lists are merged by query.
    """
    n = rows.count()
    groups = shard_groups or max(1, -(-n // (4 * SHARD_BLOCK)))
    deal = lambda c, m: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    blocks = stored(queries.mapInArrow(_tiles(QUERY_BLOCK, True), _BLOCKS), "query-blocks")
    many = max(1, blocks.count() // 16)
    left = blocks.withColumn("q", deal(("ids",), many)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = rows.withColumn("g", deal(("vec_id", "ord"), groups)).repartition(groups, "g").drop("g")
    shards = dealt.mapInArrow(_tiles(SHARD_BLOCK, False), _BLOCKS).withColumn("g", deal(("ids", "part"), groups)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    hits = left.groupBy("g", "q").cogroup(shards.groupBy("g", "q")).applyInPandas(_search(k), _HITS)
    best = Window.partitionBy("query_id", "query_ord").orderBy(F.desc("score"), "vec_id", "ord")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = stored(scaled(read(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)
