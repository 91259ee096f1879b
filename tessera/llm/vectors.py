"""Embedding near-dedup: PCA-ordered tiled comparison of the vectors of a label, with bounds on what is left of a product.

Equal vectors of a label are one node with a count. Nodes lie in the order of their first principal component, in
groups of consecutive ones; two groups meet only if their intervals on it are near enough for a link. Within two
groups tiles are compared: products of leading components come first, and a pair goes on while they, with the product
of the suffix norms, can still reach the threshold. What goes through to the end is decided by the cosine of the
vectors as they are given. Links are not listed: a task counts them by node and passes on a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import read, stored
from .graph import components

THRESHOLD = 0.93
#: Rows of a group at most; groups of long vectors hold GROUP_BYTES.
GROUP, GROUP_BYTES = 4096, 8_000_000
TILE = 512
#: Nodes that the principal components are fitted to; they decide the order of work, never a link.
BASIS_ROWS = 4096
#: Parts of a node's dimensions after which pairs are judged by bounds.
LEVELS = (0.125, 0.25, 0.5)
#: Share of a tile's pairs under which the pairs left are followed one by one.
FEW = 0.02
_SLACK = 1e-9
_LAST = 2**63 - 1  # in place of a null id: after all others

_NODES = "label string, vec_id long, dim int, digest binary, vector binary"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles, with a digest of label and vector; null for those that link with nothing."""
    for b in batches:
        column, dim, digest, vector = b.column("embedding"), [], [], []
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls become nan, -0.0 becomes 0.0
        end = np.cumsum(size)
        for s, e, label in zip((end - size).tolist(), end.tolist(), b.column("label").to_pylist(), strict=True):
            v = values[s:e]
            linked = label is not None and np.isfinite(v).all() and v.any()
            raw = v.astype("<f8").tobytes() if linked else None
            dim.append(e - s if linked else None)
            vector.append(raw)
            digest.append(hashlib.blake2b(raw, digest_size=16, key=hashlib.sha256(label.encode()).digest()).digest() if linked else None)
        yield pa.RecordBatch.from_arrays([b.column("label"), b.column("vec_id"), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(vector, pa.binary())], ["label", "vec_id", "dim", "digest", "vector"])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bases(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, orthonormal columns by falling second moment, fitted to about BASIS_ROWS nodes in all.

    The nodes are those of the smallest digests, so the choice is the same in every run; lengths without one have no
    basis and keep their own order.
    """
    part = min(1.0, BASIS_ROWS / max(1, nodes.count()))
    at = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    out, found = {}, {}
    for r in nodes.where(at < int(part * 2**32)).select("dim", "vector").collect():
        found.setdefault(r.dim, []).append(np.frombuffer(r.vector, "<f8"))
    for dim, some in found.items():
        u = unit(np.array(some))
        out[dim] = np.ascontiguousarray(np.linalg.eigh(u.T @ u)[1][:, ::-1])
    return out


def _keyed(table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of each node on its first component."""
        for b in batches:
            key = []
            for dim, raw in zip(b.column("dim").to_pylist(), b.column("vector").to_pylist(), strict=True):
                u, basis = unit(np.frombuffer(raw, "<f8")[None])[0], table.value.get(dim)
                key.append(float(u[0] if basis is None else u @ basis[:, 0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.float64())], [*b.schema.names, "key"])

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A group as one row; its nodes in the order of their keys."""
    rows = rows.sort_values("n")
    one = rows.iloc[0]
    joined = {c: [b"".join(rows[c])] for c in ("digest", "vector")} | {c: [rows[c].to_numpy("<i8").tobytes()] for c in ("low", "times")}
    return pd.DataFrame({"label": [one.label], "dim": [one.dim], "g": [one.g], "lo": [rows.key.min()], "hi": [rows.key.max()]} | joined)


def grouped(nodes: DataFrame, table: Broadcast) -> DataFrame:
    """(label, dim, g, lo, hi, digest, vector, low, times): groups of consecutive nodes of one label and length, each packed in a row."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    keyed = nodes.mapInArrow(_keyed(table), f"{schema}, key double")
    placed = numbered(keyed, [F.asc(c) for c in ("label", "dim", "key", "digest")], "n")
    most = F.greatest(F.lit(TILE), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_BYTES) / (8 * F.col("dim"))))).cast("long")
    at = placed.withColumn("g", F.floor((F.col("n") - 1) / most).cast("long"))
    return stored(at.groupBy("label", "dim", "g").applyInPandas(_pack, "label string, dim int, g long, lo double, hi double, digest binary, vector binary, low binary, times binary"), "vector-groups")


def partners(groups: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, g, h), g <= h: groups whose intervals on the first component are near enough for a link.

    Unit vectors at a cosine of t are sqrt(2 - 2 t) apart, so on any axis no farther. Groups follow each other on it,
    so the partners of one are consecutive: as many as begin before its end and that reach. Rows are a few numbers a
    group.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    begins = groups.select("label", "dim", "g", F.col("lo").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("one"))
    asks = groups.select("label", "dim", "g", (F.col("hi") + reach).alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("one"))
    sofar = Window.partitionBy("label", "dim").orderBy("x", "kind", "g").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("label", "dim")
    told = begins.union(asks).withColumn("until", F.sum("one").over(sofar)).withColumn("first", F.min("g").over(first)).where("kind = 1")
    return told.select("label", "dim", "g", F.explode(F.sequence("g", F.col("first") + F.col("until") - 1)).alias("h"))


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the classes of i[k] and j[k]; root holds the smallest place of each class."""
    while True:
        a, b = root[i], root[j]
        far = a != b
        if not far.any():
            return
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


class _Side:
    """A group of vectors: unit rows on the principal axes, the norms of their suffixes, the vectors as given."""

    def __init__(self, row: dict, basis: np.ndarray | None, cuts: list[int]) -> None:
        raw = np.frombuffer(row["vector"], "<f8").reshape(-1, row["dim"])
        self.given = raw / np.abs(raw).max(axis=1, keepdims=True)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.given, self.given))
        self.axes = unit(raw) if basis is None else unit(raw) @ basis
        self.rest = [np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", self.axes[:, :c], self.axes[:, :c]))) for c in cuts]
        self.digest = [row["digest"][k : k + 16] for k in range(0, len(row["digest"]), 16)]
        self.low, self.times = (np.frombuffer(row[c], "<i8") for c in ("low", "times"))
        self.tiles = [slice(s, min(s + TILE, len(raw))) for s in range(0, len(raw), TILE)]
        self.box = [(self.axes[t, : cuts[0]].min(axis=0), self.axes[t, : cuts[0]].max(axis=0), self.rest[0][t].max()) for t in self.tiles]


def _tile_links(a: _Side, s: slice, b: _Side, t: slice, cuts: list[int], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two tiles; of one tile with itself each pair once."""
    least = threshold - _SLACK
    i = j = so_far = None
    done = 0
    product = np.zeros((s.stop - s.start, t.stop - t.start))
    for level, cut in enumerate(cuts):
        if i is None:
            product += a.axes[s, done:cut] @ b.axes[t, done:cut].T
            open_ = product + np.multiply.outer(a.rest[level][s], b.rest[level][t]) >= least
            if same and level == 0:
                upper = np.triu(np.ones_like(open_), 1)
            if same:
                open_ &= upper
            left = np.count_nonzero(open_)
            if left <= FEW * open_.size or cut == cuts[-1]:
                i, j = np.nonzero(open_)
                so_far, i, j = product[i, j], i + s.start, j + t.start
        else:
            so_far = so_far + np.einsum("ij,ij->i", a.axes[i, done:cut], b.axes[j, done:cut])
            on = so_far + a.rest[level][i] * b.rest[level][j] >= least
            i, j, so_far = i[on], j[on], so_far[on]
        if i is not None and not len(i):
            break
        done = cut
    linked = np.zeros(len(i), bool)
    step = max(1, 4_000_000 // a.given.shape[1])
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        linked[k : k + step] = np.einsum("ij,ij->i", a.given[x], b.given[y]) / (a.norm[x] * b.norm[y]) >= threshold
    return i[linked], j[linked]


def _near(a: _Side, m: int, b: _Side, n: int, threshold: float) -> bool:
    """Whether any vectors of two tiles can link, by the bounds of their leading components."""
    (low_a, high_a, rest_a), (low_b, high_b, rest_b) = a.box[m], b.box[n]
    most = np.maximum(np.maximum(low_a * low_b, low_a * high_b), np.maximum(high_a * low_b, high_a * high_b)).sum()
    return most + rest_a * rest_b >= threshold - _SLACK


def _compared(table: Broadcast, threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """What two groups find: rows without a second node count a node's links, the others are edges of a forest."""
        out = {c: [] for c in ("v", "d", "w", "e", "n")}
        if left.num_rows and right.num_rows:
            x, y = left.to_pylist()[0], right.to_pylist()[0]
            dim, same = x["dim"], x["g"] == x["h"]
            cuts = sorted({*(max(1, math.ceil(p * dim)) for p in LEVELS), dim})
            basis = table.value.get(dim)
            a = _Side(x, basis, cuts)
            b = a if same else _Side(y, basis, cuts)
            base = 0 if same else len(a.low)
            count, root = np.zeros(base + len(b.low), dtype=np.int64), np.arange(base + len(b.low))
            for m, s in enumerate(a.tiles):
                for n, t in enumerate(b.tiles):
                    if same and n < m or not _near(a, m, b, n, threshold):
                        continue
                    i, j = _tile_links(a, s, b, t, cuts, threshold, same and m == n)
                    np.add.at(count, i, b.times[j])
                    np.add.at(count, base + j, a.times[i])
                    _join_roots(root, i, base + j)
            low = a.low if same else np.concatenate([a.low, b.low])
            digest = a.digest if same else a.digest + b.digest
            hit, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
            for k in hit.tolist():
                for c, v in zip(out, (low[k], digest[k], None, None, count[k]), strict=True):
                    out[c].append(v)
            for k in tied.tolist():
                for c, v in zip(out, (low[k], digest[k], low[root[k]], digest[root[k]], None), strict=True):
                    out[c].append(v)
        kinds = {"v": pa.int64(), "d": pa.binary(), "w": pa.int64(), "e": pa.binary(), "n": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def _by_digest(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows with a digest, joined with nodes(digest, times, ...): a node of over a thousandth of all rows is sent to
    every executor, of which there can't be more than a thousand; the others meet by shuffles."""
    hot = nodes.where(F.col("times") > max(1, total // 1000))
    ids = F.broadcast(hot.select("digest"))
    return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(ids, "digest", "left_anti").join(nodes, "digest"))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows(vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have the same length, and their cosine is
    threshold or more. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
    Equal rows, and rows that share a vec_id, are vectors of their own and count each other. component_id is the
    smallest vec_id that links reach; a null vec_id comes after all others and stays null only where no other is
    reached. Equal vectors are compared once, whatever their number; other columns are not read.
    """
    if not -1 < threshold <= 1:
        raise ValueError("threshold: above -1, 1 at most")
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    known = stored(plain.mapInArrow(_prepared, _NODES), "vectors")
    alone = known.where(F.col("digest").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = known.where(F.col("digest").isNotNull())
    low = F.coalesce(F.min("vec_id"), F.lit(_LAST)).alias("low")
    nodes = stored(linked.groupBy("digest").agg(F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("vector").alias("vector"), low, F.count(F.lit(1)).alias("times")), "vector-nodes")
    table = rows.sparkSession.sparkContext.broadcast(bases(nodes))
    groups = grouped(nodes, table)
    pairs = stored(partners(groups.select("label", "dim", "g", "lo", "hi"), threshold), "group-pairs")
    packed = ["dim", "digest", "vector", "low", "times"]
    side = lambda own: groups.select("label", *packed, F.col("g").alias(own)).join(pairs.select("label", "dim", "g", "h"), ["label", "dim", own]).select("label", "g", "h", *packed)
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    key = ["label", "dim", "g", "h"]
    both = fresh(side("g")).groupBy(*key).cogroup(fresh(side("h")).groupBy(*key))
    found = both.applyInArrow(_compared(table, threshold), "v long, d binary, w long, e binary, n long")
    found = stored(found, "vector-links")
    node = lambda v, d: F.struct(F.col(v).alias("v"), F.col(d).alias("d"))
    of = components(found.where(F.col("e").isNotNull()).select(node("v", "d").alias("a"), node("w", "e").alias("b")))
    of = of.select(F.col("node.d").alias("digest"), F.col("label.v").alias("least"))
    links = found.where(F.col("e").isNull()).groupBy(F.col("d").alias("digest")).agg(F.sum("n").alias("n"))
    told = nodes.select("digest", "low", "times").join(links, "digest", "left").join(of, "digest", "left")
    told = stored(told.select("digest", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), _known(F.coalesce("least", "low")).alias("component_id")), "vector-components")
    met = _by_digest(linked.select("vec_id", "digest"), told, max(1, known.count()))
    return met.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def _known(id_: Column) -> Column:
    return F.when(id_ != _LAST, id_)


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a
), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, c.least) AS component_id, e.vec_id <= coalesce(c.least, e.vec_id) AS kept FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
