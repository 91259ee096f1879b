"""Mixing sources to target weights by pivotal dependent rounding on a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read, row_key, stored

WEIGHTS = (3, 1, 2)
#: All targets together, as a part of all sizes.
TOTAL = 1.5
#: What a source, and a document, gives at most, as a part of its size.
MOST = 2.0
#: Rows of a source that one node of the tree takes.
FAN_IN = 4096
SEED = 20


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size), one row a source.

    Sources by code point, null last, have the weights in turn. All sources that the same level L fills have the
    target L * weight; the others stop at most * source_size. L follows from running sums over the sources in the
    order in which they fill up, so no step is repeated. The table has a row for each source, whatever the corpus.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("rank"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the level if all sources before this one are full and it and those after it are not
    level = (F.lit(float(total)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    tried = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    found = tried.withColumn("l", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level")))).over(every))
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("l.level") * F.col("w")), F.col("cap")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after pairs have moved mass at random until all but one at most are 0 or 1.

    Each step keeps the expected size sum(p * size) and each document's expectation.
    """
    p, at = p.copy(), None
    coins = rng.random(len(p))
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if at is None:
            at = k
            continue
        i, j = at, k
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if coins[k] * (up + down) < down else -down
        full_i, full_j = (up == (1 - p[i]) * size[i], up == p[j] * size[j]) if move > 0 else (down == p[i] * size[i], down == (1 - p[j]) * size[j])
        p[i] = (1.0 if move > 0 else 0.0) if full_i else p[i] + move / size[i]
        p[j] = (0.0 if move > 0 else 1.0) if full_j else p[j] - move / size[j]
        at = i if not full_i else j if not full_j else None
    return p


_NODE = "source string, _k long, _h long, size long, n long, p double, node long"


def _reduce(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivots each (source, node) of rows sorted by source, node and key; a group that a batch cuts goes on with the next."""
    rest: pd.DataFrame | None = None
    for b in frames:
        now = b.to_pandas() if rest is None else pd.concat([rest, b.to_pandas()], ignore_index=True)
        s, n = now["source"], now["node"]
        same = (s.eq(s.shift()) | (s.isna() & s.shift().isna())) & n.eq(n.shift())
        starts = np.flatnonzero(~same.to_numpy() | (np.arange(len(now)) == 0))
        rest = now.iloc[starts[-1] :] if len(starts) else now
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield _pivoted(now.iloc[i:j])
    if rest is not None and len(rest):
        yield _pivoted(rest)


def _pivoted(group: pd.DataFrame) -> pa.RecordBatch:
    g = group.sort_values(["size", "_k", "_h"], ascending=[False, True, True], kind="stable")  # what is left over tends to be small
    name = b"\0" if pd.isna(g["source"].iloc[0]) else b"\1" + g["source"].iloc[0].encode()
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name + b"/%d/%d/%d" % (g["node"].iloc[0], g["_k"].iloc[0], g["_h"].iloc[0]), SEED))
    mass = (g["size"] * g["n"]).to_numpy(dtype=float)
    g = g.assign(p=pivot(g["p"].to_numpy(dtype=float), mass, rng))
    return pa.RecordBatch.from_pandas(g, schema=pa.schema([("source", pa.string()), *[(c, pa.int64()) for c in ("_k", "_h", "size", "n")], ("p", pa.float64()), ("node", pa.int64())]), preserve_index=False)


def mixed(docs: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, _k, _h, n, size, source_size, target, copies), a row for each distinct (doc_id, text, source).

    size counts the words of the text. Each document gives 0, 1 or 2 whole copies with expectation target /
    source_size. Within a source the fractions meet in pairs, in nodes of FAN_IN rows or less; what a node leaves
    fractional goes to the next level, until one document is left, which is rounded to the nearer copy. So the taken
    words differ from the target by half a document at most. Rows that repeat (n of them) are decided as one.
    Documents without words have size 0 and no copies. The random numbers follow from the keys: reruns agree.
    A hot source is spread over nodes by key.
    """
    base = docs.select("doc_id", "source", *row_key(), word_count(F.col("text")).alias("size"))
    rows = stored(base.groupBy("doc_id", "source", "_k", "_h", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    per = stored(targets(per.select("source", "source_size"), total, most, weights).join(per.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    side = per.select(F.col("source").alias("_s"), "source_size", "target", "rows", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
    all_rows = rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    nodes = F.ceil(F.col("rows") / FAN_IN)
    level = all_rows.where("size > 0 and p > 0").withColumn("node", F.pmod(F.xxhash64("_h", "_k"), nodes)).select("source", "_k", "_h", "size", "n", "p", "node")
    largest = per.agg(F.max("rows")).first()[0] or 0
    done = []
    while True:
        dealt = level.repartition("source", "node").sortWithinPartitions("source", "node", "_k", "_h")
        out = stored(dealt.mapInArrow(_reduce, _NODE), "mix-level")
        if largest <= FAN_IN:
            done.append(out)
            break
        done.append(out.where("p = 0 or p = 1"))
        largest = -(-largest // FAN_IN)
        level = out.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
    picked = done[0]
    for x in done[1:]:
        picked = picked.unionByName(x)
    extra = picked.select(F.col("source").alias("_s"), F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), F.floor(F.col("p") + 0.5).alias("one"))
    joined = all_rows.join(extra, (F.col("_k") == F.col("_k2")) & (F.col("_h") == F.col("_h2")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("one", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "source", "_k", "_h", "n", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as its copies say; columns as before."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    taken = mixed(rows).where("copies > 0").select(F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), F.col("source").alias("_s"), "copies")
    keyed = rows.select("_row", "source", *row_key())
    met = keyed.join(taken, (F.col("_k") == F.col("_k2")) & (F.col("_h") == F.col("_h2")) & F.col("source").eqNullSafe(F.col("_s")))
    return met.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
