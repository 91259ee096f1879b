"""Operators on an order that is dealt out by ranges of a key: numbers, pages, joins by comparison, greatest-below lookups.

A global order needs no single task: Spark deals rows to ranges of the sort key, each task sorts its range, and only a
row for each range, its size or its bounds, is gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder

_PLACE = 33  # bits of monotonically_increasing_id() below a partition's number


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and what was computed stays as it is."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sizes(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(_p, _before) of found(_p, n): how many rows lie in the ranges before; a row for each range."""
    sizes = sorted((r._p, r.n) for r in found.collect())
    return spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "_p long, _before long")


def numbered(df: DataFrame, by: Sequence[Column], name: str) -> DataFrame:
    """df with name, the number from 1 of each row in the order of by; ties fall in any order.

    Null keys lie where by's columns put them. Rows are stored once, range by range, so a range that is computed again
    can't be numbered anew; sizes of ranges are gathered, no rows. An empty frame stays empty.
    """
    spark = df.sparkSession
    at = df.repartitionByRange(*by).sortWithinPartitions(*by)
    at = kept(at.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", _PLACE).alias("_p")
    before = _sizes(spark, at.groupBy(part).agg(F.count(F.lit(1)).alias("n")))
    place = F.col("_m").bitwiseAND((1 << _PLACE) - 1)
    return at.withColumn("_p", F.shiftright("_m", _PLACE)).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + place + 1).drop("_m", "_p", "_before")  # a row for each range


def row_numbers(df: DataFrame, by: Sequence[tuple[Column, bool]], order: Sequence[Column], name: str) -> DataFrame:
    """df with ROW_NUMBER() OVER (ORDER BY ...) without a partition, from 1: (key, ascending) pairs, then row order.

    Nulls come first ascending and last descending. No task holds more than a range of the rows.
    """
    keys = [k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in by]
    return numbered(df, [*keys, *[c.asc_nulls_first() for c in order]], name)


# pages

#: Rows that the last step of a seek sorts, about, and ranges that a step counts.
PAGE_ROWS, PAGE_RANGES = 100_000, 256


def _cuts(keys: DataFrame, count: int, ranges: int) -> list:
    """Sampled cut points of keys(k) into ranges; about 40 rows a range are gathered."""
    part = min(1.0, 40 * ranges / max(1, count))
    some = sorted(r.k for r in (keys if part == 1.0 else keys.sample(part, seed=7)).limit(80 * ranges).collect())
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def _range_of(k: Column, cuts: list) -> Column:
    """How many cuts lie at or below k, by blocks of 16 cuts, so that a row meets few of them."""
    blocks = [cuts[i : i + 16] for i in range(0, len(cuts), 16)]
    below = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda c: c <= k))
    at = F.greatest(below([b[0] for b in blocks]) - 1, F.lit(0))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), at + 1)
    return at * 16 + F.size(F.filter(inner, lambda c: c <= k))


def page(df: DataFrame, by: Sequence[Column], offset: int, size: int) -> DataFrame:
    """size rows from offset in the order of by, ascending; offset is held between 0 and the last full page's start.

    The rows before are counted by ranges of the first key, never sorted: a step cuts what is left by sampled keys,
    counts each range in one pass, and goes on with the ranges that hold the page until those have about PAGE_ROWS
    rows, which are sorted. Rows that share one key all stay; a null key comes first.
    """
    if size <= 0:
        raise ValueError("PageSizeInvalid")
    key, left = by[0], df.where(by[0].isNotNull())
    total, nulls = df.agg(F.count(F.lit(1)), F.count(F.when(key.isNull(), 1))).first()
    start = max(0, min(offset, total - size))
    if start < nulls:
        left, count = df, total
    else:
        start, count = start - nulls, total - nulls
    size = min(size, count - start)
    while count > max(PAGE_ROWS, 2 * size) and (cuts := _cuts(left.where(key.isNotNull()).select(key.alias("k")), count, PAGE_RANGES)):
        # null keys, if they are still among the rows, lie in the first range
        at = F.when(key.isNull(), 0).otherwise(_range_of(key, cuts))
        sizes = {r.r: r.n for r in left.groupBy(at.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, first, last, seen = 0, None, 0, 0
        for r in sorted(sizes):
            if first is None and seen + sizes[r] > start:
                first, before = r, seen
            seen += sizes[r]
            last = r
            if seen >= start + size:
                break
        inside = sum(n for r, n in sizes.items() if first <= r <= last)
        if inside == count:
            break  # one key holds them all
        low = key >= cuts[first - 1] if first else F.lit(True)
        high = key < cuts[last] if last < len(cuts) else F.lit(True)
        left = left.where(low & high) if first else left.where(key.isNull() | high)
        start, count = start - before, inside
    order = [c.asc_nulls_first() for c in by]
    if not size:
        return left.limit(0)
    down = [c.desc_nulls_last() for c in by]
    return left.orderBy(*order).limit(start + size).orderBy(*down).limit(size).orderBy(*order)


# joins by comparison

#: Rows of a block, blocks of a side at most, and pairs of blocks at most; what is gathered is bounded by the last two.
BLOCK_ROWS, MOST_BLOCKS, MOST_PAIRS = 2_000, 4_096, 1_000_000
_OPS = {
    "<": (lambda x, y: x < y, lambda a, b: a[0] < b[1]),
    "<=": (lambda x, y: x <= y, lambda a, b: a[0] <= b[1]),
    ">": (lambda x, y: x > y, lambda a, b: a[1] > b[0]),
    ">=": (lambda x, y: x >= y, lambda a, b: a[1] >= b[0]),
    "=": (lambda x, y: x == y, lambda a, b: a[0] <= b[1] and a[1] >= b[0]),
}
#: Bounds by which every row of one block meets every row of the other.
_SURE = {
    "<": lambda a, b: a[1] < b[0],
    "<=": lambda a, b: a[1] <= b[0],
    ">": lambda a, b: a[0] > b[1],
    ">=": lambda a, b: a[0] >= b[1],
    "=": lambda a, b: a[0] == a[1] == b[0] == b[1],
}


def _blocks(df: DataFrame, keys: Sequence[Column], names: Sequence[str], block: str) -> tuple[DataFrame, list]:
    """df stored by ranges of its first key with its blocks, and (block, least and greatest of each key) of every block.

    The row's hash stands behind the key, so that many rows of one key make many blocks.
    """
    at = df.withColumns(dict(zip(names, keys, strict=True)))
    for n in names:
        at = at.where(F.col(n).isNotNull())
    count = at.count()
    blocks = max(1, min(MOST_BLOCKS, -(-count // BLOCK_ROWS)))
    at = at.repartitionByRange(blocks, F.asc(names[0]), F.xxhash64(*df.columns)).withColumn(block, F.spark_partition_id())
    at = kept(at.withColumn(f"{block}_row", F.monotonically_increasing_id()), "blocks")
    ends = at.groupBy(block).agg(*[f(n).alias(f"{n}_{s}") for n in names for s, f in (("lo", F.min), ("hi", F.max))]).collect()
    return at, sorted((r[block], [(r[f"{n}_lo"], r[f"{n}_hi"]) for n in names]) for r in ends)


def _merged_blocks(ends: list) -> list:
    """Neighbouring blocks two by two: (members, bounds)."""
    out = []
    for i in range(0, len(ends), 2):
        two = ends[i : i + 2]
        out.append((sum((m for m, _ in two), []), [(min(b[k][0] for _, b in two), max(b[k][1] for _, b in two)) for k in range(len(two[0][1]))]))
    return out


def theta_join(a: DataFrame, b: DataFrame, on: Sequence[tuple[Column, str, Column]], how: str = "inner", where: Column | None = None) -> DataFrame:
    """Rows of a and b for which every (key of a, <, <=, >, >= or =, key of b) holds, and where, if given.

    The comparison that shuffles nothing together: each side lies in blocks of consecutive first keys, and only pairs
    of blocks whose bounds allow every comparison meet, by an equality of block numbers. So a band costs about as
    much as it yields, neither side is broadcast, and no key is too frequent for a task. Null keys meet nothing; left
    keeps rows of a that met none. The sides' column names must differ. Only the sides are stored, never the pairs;
    who only counts or adds up what is met takes correlated, which forms no pairs.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"UnsupportedSyntax: {how} join")
    if any(op not in _OPS for _, op, _ in on) or not on:
        raise ValueError("ComparisonOperatorInvalid")
    spark = a.sparkSession
    x, y = [f"_x{i}" for i in range(len(on))], [f"_y{i}" for i in range(len(on))]
    left, ends_a = _blocks(a, [k for k, _, _ in on], x, "_i")
    right, ends_b = _blocks(b, [k for _, _, k in on], y, "_j")
    one, two = ([([n], e) for n, e in ends] for ends in (ends_a, ends_b))
    while len(one) * len(two) > MOST_PAIRS:
        one, two = (_merged_blocks(one), two) if len(one) > len(two) else (one, _merged_blocks(two))
    fits = lambda p, q: all(_OPS[op][1](p[k], q[k]) for k, (_, op, _) in enumerate(on))
    pairs = [(i, j) for i, (_, p) in enumerate(one) for j, (_, q) in enumerate(two) if fits(p, q)]
    small = lambda rows, names: F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)))
    group = lambda blocks, n, g: small([(m, i) for i, (ms, _) in enumerate(blocks) for m in ms], [n, g])
    # at most MOST_BLOCKS rows, and MOST_PAIRS
    p = left.join(group(one, "_i", "_g"), "_i").join(small(pairs, ["_g", "_h"]), "_g")
    q = right.join(group(two, "_j", "_h"), "_j").join(small(pairs, ["_g", "_h"]), "_h")
    meets = reduce(lambda c, d: c & d, [_OPS[op][0](F.col(x[k]), F.col(y[k])) for k, (_, op, _) in enumerate(on)])
    meets = meets if where is None else meets & where
    met = p.join(q, ["_g", "_h"]).where(meets).select(*a.columns, *b.columns)
    if how == "inner":
        return met
    # rows of a block that surely meets another one need no search; others are bare unless they have a first match
    sure = lambda p, q: where is None and all(_SURE[op](p[k], q[k]) for k, (_, op, _) in enumerate(on))
    served = {i for i, j in pairs if sure(one[i][1], two[j][1])}
    asked = left.join(group(one, "_i", "_g"), "_i").join(small([(i,) for i in range(len(one)) if i not in served], ["_g"]), "_g")
    few = [(i, j) for i, j in pairs if i not in served]
    other = right.join(group(two, "_j", "_h"), "_j").join(small(few, ["_g", "_h"]), "_h").withColumnsRenamed({"_g": "_og", "_h": "_oh"})
    first = asked.join(small(few, ["_g", "_h"]), "_g").join(other, (F.col("_g") == F.col("_og")) & (F.col("_h") == F.col("_oh")) & meets, "left_semi")
    bare = asked.join(first.select("_i_row").distinct(), "_i_row", "left_anti")
    lacks = [F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema]
    empty = F.exists(F.array(*[k.isNull() for k, _, _ in on]), lambda v: v)
    return met.unionByName(bare.select(*a.columns, *lacks)).unionByName(a.where(empty).select(*a.columns, *lacks))


# correlation by an order

_AGGREGATES = {"max": (F.max, max), "min": (F.min, min), "sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b)}


def correlated(outer: DataFrame, inner: DataFrame, on: Sequence[str], outer_at: Column, op: str, inner_at: Column, value: Column, how: str, name: str) -> DataFrame:
    """outer with name: the aggregate (max, min, sum, count) of value over rows of inner with equal columns on and inner_at op outer_at.

    op is <, <=, > or >=. Both sides lie in one order, by on and place, dealt out by ranges; within a range the
    aggregate runs along, and what earlier ranges bring for a range's first key is added from a row or two that each
    range reports. So neither a frequent key nor a lookup without on takes one task, and no pair of rows is formed.
    Rows of outer with a null among on or place find nothing: null, or 0 for count. A struct as value gives the row of
    the greatest place: max of (place, columns).
    """
    if op not in ("<", "<=", ">", ">="):
        raise ValueError("ComparisonOperatorInvalid")
    if how not in _AGGREGATES:
        raise ValueError(f"AggregateInvalid: {how}")
    spark, (aggregate, combine) = outer.sparkSession, _AGGREGATES[how]
    keys = [f"_c{i}" for i in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    kind = inner.select(value.alias("v")).schema["v"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in outer.columns]).alias("_row")
    # of equal places the inner rows come first where they count
    here, there = (0, 1) if op in ("<=", ">=") else (1, 0)
    ours = outer.select(*named, outer_at.alias("_at"), F.lit(there).alias("_tag"), F.lit(None).cast(kind).alias("_v"), row)
    theirs = inner.select(*named, inner_at.alias("_at"), F.lit(here).alias("_tag"), value.alias("_v"), F.lit(None).cast(outer.select(row).schema["_row"].dataType).alias("_row"))
    filled = lambda df: df.where(F.forall(F.array(*[F.col(c).isNotNull() for c in [*keys, "_at"]]), lambda x: x))
    both = filled(theirs).unionByName(filled(ours))
    if op in ("<", "<="):
        order = [F.asc(c) for c in [*keys, "_at", "_tag"]]
    else:
        order = [*[F.asc(c) for c in keys], F.desc("_at"), F.asc("_tag")]
    at = both.repartitionByRange(*order, F.xxhash64("_row")).sortWithinPartitions(*order)
    at = kept(at.withColumn("_m", F.monotonically_increasing_id()), "correlated").withColumn("_p", F.shiftright("_m", _PLACE))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    at = at.withColumn("_g", group)
    ends = at.groupBy("_p").agg(F.min_by("_g", "_m").alias("_first"), F.max_by("_g", "_m").alias("_last"))
    ends = kept(ends, "range-ends")
    told = at.join(F.broadcast(ends), "_p").where(F.col("_g") == F.col("_last"))  # a row for each range
    carried = {r._p: r.v for r in told.groupBy("_p").agg(aggregate("_v").alias("v")).collect()}
    carry, key, held = [], None, None
    for p, start, end in sorted((r._p, r._first, r._last) for r in ends.collect()):
        brought = held if start == key else None
        carry.append((p, brought))
        own = carried.get(p)
        if start == end and brought is not None:
            own = brought if own is None else combine(brought, own)
        key, held = end, own
    result = kind if how in ("max", "min") else at.agg(aggregate("_v").alias("v")).schema["v"].dataType
    brought = spark.createDataFrame(carry, StructType([StructField("_p", LongType()), StructField("_b", result)]))
    along = Window.partitionBy("_p", *keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    ran = at.withColumn("_own", aggregate("_v").over(along)).where(F.col("_row").isNotNull()).join(F.broadcast(ends.select("_p", "_first")), "_p").join(F.broadcast(brought), "_p")
    before = F.when(F.col("_g") == F.col("_first"), F.col("_b"))
    own = F.col("_own")
    joined = F.when(own >= before, own).otherwise(before) if how == "max" else F.when(own <= before, own).otherwise(before) if how == "min" else own + before
    whole = F.when(before.isNull(), own).when(own.isNull(), before).otherwise(joined)
    bare = outer.where(F.exists(F.array(*[F.col(c).isNull() for c in on], outer_at.isNull()), lambda x: x))
    none = F.lit(0).cast("long") if how == "count" else F.lit(None).cast(result)
    return ran.select("_row.*", whole.alias(name)).unionByName(bare.withColumn(name, none))
