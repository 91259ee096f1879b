"""Near-duplicate documents: 64-bit SimHash fingerprints that link at 3 or fewer differing bits, found through covering codes.

Of 3 differing bits at most one lies in one of the two halves of a fingerprint. In each 32-bit half the anchors are
the words of a covering code: a [31,26] Hamming code beside one free bit, of covering radius 1. A fingerprint's home
is the anchor within the radius; it is sent to every anchor within radius + threshold = 2. Of two fingerprints with
halves at distance 1, either is within 2 of the other's home, so they meet there; nothing else is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, read, row_key, stored
from .graph import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Homes at one anchor beyond which its comparisons are dealt out by salt; larger groups are not held, they pass by.
HOT_HOMES = 20_000


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text in UTF-8: a bit is 1 if set in over half the hashes of its 3-word shingles; 0 without words."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(1, len(ws) - SHINGLE_WORDS + 1)
    ends = list(accumulate(map(len, ws)))
    digest, k = xxhash.xxh64_intdigest, min(SHINGLE_WORDS, len(ws))
    hashes = np.fromiter((digest(joined[(ends[i - 1] + i if i else 0) : ends[i + k - 1] + i + k - 1], SEED) for i in range(n)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "_k", "_h")], pa.array(fp.view(np.int64))], ["doc_id", "_k", "_h", "fp"])


def _anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit halves: row numbers, code words within distance 2, and whether the word is the row's home."""
    low, rows = half & np.uint64(0x7FFFFFFF), np.arange(len(half))
    syndrome = np.zeros(len(half), dtype=np.int64)
    for bit in range(5):
        mask = np.uint64(sum(1 << i for i in range(31) if (i + 1) >> bit & 1))
        syndrome |= (np.bitwise_count(low & mask) & 1).astype(np.int64) << bit
    near = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
    home = half ^ near
    out = [(rows, home, np.ones(len(half), bool)), (rows, home ^ np.uint64(1 << 31), np.zeros(len(half), bool))]
    odd = np.flatnonzero(syndrome)
    for a in range(1, 32):  # bits a and a ^ syndrome, each pair once
        at = odd[(a ^ syndrome[odd]) > a]
        flip = np.uint64(1 << (a - 1)) | (np.uint64(1) << ((a ^ syndrome[at]) - 1).astype(np.uint64))
        out.append((at, half[at] ^ flip, np.zeros(len(at), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fp), 8192):
            part = fp[i : i + 8192]
            for block in (0, 1):
                rows, word, home = _anchors_of(part >> np.uint64(32 * block) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array((word | np.uint64(block << 32)).view(np.int64)), pa.array(part[rows].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _stars(fp: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of the first home of its group of linked ones, -1 for guests without links.

    Groups grow from homes; what one reaches leaves the rest at once, so a group of copies costs little.
    """
    of, rest = np.full(len(fp), -1, dtype=np.int64), np.arange(len(fp))
    for h in np.flatnonzero(homes):
        if of[h] >= 0:
            continue
        of[h] = h
        rest = rest[rest != h]
        front = np.array([h])
        while len(front) and len(rest):
            block, front = front[:256], front[256:]
            hit = (np.bitwise_count(fp[block, None] ^ fp[None, rest]) <= MAX_BITS).any(axis=0)
            new, rest = rest[hit], rest[~hit]
            of[new] = h
            front = np.concatenate([front, new])
    return of


class _Large:
    """A group with too many guests to hold: they pass by its homes."""

    def __init__(self) -> None:
        self.homes, self.of = np.zeros(0, dtype=np.uint64), None

    def among_homes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges among the homes, once all have come."""
        if self.of is None:
            self.of = _stars(self.homes, np.ones(len(self.homes), bool))
            far = self.of != np.arange(len(self.homes))
            yield self.homes[self.of[far]], self.homes[far]

    def meet(self, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges of the next rows, homes first; each guest gets one to every group of homes that it links."""
        if home.any():
            self.homes = np.concatenate([self.homes, fp[home]])
        guests = fp[~home]
        if not len(guests) or not len(self.homes):
            return
        yield from self.among_homes()
        for i in range(0, len(guests), 256):
            some = guests[i : i + 256]
            hit = np.bitwise_count(self.homes[:, None] ^ some[None, :]) <= MAX_BITS
            low = np.where(hit, self.of[:, None], len(self.homes)).min(axis=0)
            met = low < len(self.homes)
            yield self.homes[low[met]], some[met]
            high = np.where(hit, self.of[:, None], -1).max(axis=0)
            for k in np.flatnonzero(met & (high > low)):
                groups = np.unique(self.of[hit[:, k]])
                if len(groups) > 1:
                    yield np.full(len(groups), some[k]), self.homes[groups]
                    self.of[np.isin(self.of, groups)] = groups[0]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among rows sorted by anchor, salt and homes first; the last group of a batch waits for the next, a large one passes by."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, bool)]
    large, key = None, None
    for b in batches:
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "fp", "home")]
        now[2] = now[2].view(np.uint64)
        if large is not None:
            n = int(np.argmax((now[0] != key[0]) | (now[1] != key[1]))) if (now[0][-1], now[1][-1]) != key else len(now[0])
            yield from (_batch(*x) for x in large.meet(now[2][:n], now[3][:n]) if len(x[0]))
            now = [x[n:] for x in now]
            if not len(now[0]):
                continue
            yield from (_batch(*x) for x in large.among_homes() if len(x[0]))
            large = None
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
        cut = new[-1] if len(new) else 0
        rest = [x[cut:] for x in now]
        if cut:
            yield from _edges([x[:cut] for x in now])
        if len(rest[0]) > 2 * HOT_HOMES:
            large, key = _Large(), (rest[0][0], rest[1][0])
            yield from (_batch(*x) for x in large.meet(rest[2], rest[3]) if len(x[0]))
            rest = [x[:0] for x in rest]
    if large is not None:
        yield from (_batch(*x) for x in large.among_homes() if len(x[0]))
    elif len(rest[0]):
        yield from _edges(rest)


def _edges(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    anchor, salt, fp, home = rows
    starts = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(salt) != 0)) + 1, [len(anchor)]])
    sizes, homes = np.diff(starts), np.add.reduceat(home.astype(np.int64), starts[:-1]) if len(anchor) else np.zeros(0)
    out_a, out_b = [], []
    two = starts[:-1][(sizes == 2) & (homes > 0)]
    ok = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS] if len(two) else two
    out_a.append(fp[ok])
    out_b.append(fp[ok + 1])
    for g in np.flatnonzero((sizes > 2) & (homes > 0)):
        part = fp[starts[g] : starts[g + 1]]
        of = _stars(part, home[starts[g] : starts[g + 1]])
        far = (of >= 0) & (of != np.arange(len(part)))
        out_a.append(part[of[far]])
        out_b.append(part[far])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if len(a):
        yield _batch(a, b)


def dealt(fps: DataFrame) -> DataFrame:
    """(anchor, salt, fp, home): what is compared together, for fps(fp) of distinct rows.

    An anchor with more than HOT_HOMES homes is dealt to S x S groups: homes are dealt to S, all that come to the
    anchor to S, and each group holds one part of either. So a group shrinks as S grows, and each home still meets
    all others.
    """
    at = fps.mapInArrow(_to_anchors, "anchor long, fp long, home boolean")
    hot = stored(at.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_HOMES), "hot-anchors")
    if hot.isEmpty():
        return at.withColumn("salt", F.lit(0)).select("anchor", "salt", "fp", "home")
    salts = F.ceil(F.col("n") / HOT_HOMES).cast("int")
    own, every = F.pmod(F.hash("fp"), salts), F.sequence(F.lit(0), salts - 1)
    cell = lambda row, column, home: F.struct((row * salts + column).alias("salt"), home.alias("home"))
    as_guest = F.transform(every, lambda i: cell(i, own, F.col("home") & (i == own)))
    as_home = F.filter(F.transform(every, lambda j: F.when(j != own, cell(own, j, F.lit(True)))), lambda x: x.isNotNull())
    cells = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("salt"), F.col("home")))).otherwise(F.concat(as_guest, F.when(F.col("home"), as_home).otherwise(F.filter(as_guest, lambda x: F.lit(False)))))
    # hot anchors are few: each has more than HOT_HOMES distinct fingerprints, but no bound is known, so no hint
    return at.join(hot, "anchor", "left").select("anchor", "fp", F.explode(cells).alias("c")).select("anchor", "c.salt", "fp", "c.home")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all linked fingerprints of fps(fp), whose rows are distinct."""
    return dealt(fps).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home")).mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, _h, fp, component_id, component) for each row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that can be reached through links. Null and empty texts have fingerprint 0,
    which links like any other. Repeated rows share a fingerprint. A null doc_id counts as larger than all others; a
    component of nulls has a null id; component tells those apart. Equal fingerprints are one node, so any number of copies costs one row after
    the map-side combine.
    """
    rows = stored(docs.select("doc_id", *row_key(), "text").mapInArrow(_fingerprints, "doc_id long, _k long, _h long, fp long"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("times"))
    of = stored(components(links(least.select("fp"))), "fingerprint-labels")
    # of has only fingerprints with links; a component may hold very many, so its rows don't meet in one task
    low = least.join(of.withColumnRenamed("node", "fp"), "fp").groupBy("label").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("times"))
    linked = joined_hot(of, stored(low, "component-ids"), "label").select(F.col("node").alias("fp"), "label", F.col("low").alias("linked"))
    ids = least.join(linked, "fp", "left").select("fp", "times", F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("linked")).alias("component_id"), F.coalesce("label", "fp").alias("component"))
    # copies of one text share a fingerprint, so a shuffle by it would send them all to one task
    return joined_hot(rows, stored(ids, "fingerprint-components"), "fp").select(*rows.columns, "component_id", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null last, one only of repeated rows.

    Columns pass through whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    of = near_duplicates(rows)
    keep = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "_k", "_h")).alias("m")).select("m._k", "m._h")
    return rows.select("_row", *row_key()).join(keep, ["_k", "_h"]).dropDuplicates(["_k", "_h"]).select("_row.*")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
