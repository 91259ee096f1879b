"""Relational operators whose results depend on the order of rows, with that order given as columns.

The query surface fixes which spelling stands for a group, which row DISTINCT keeps and how ties fall: by the order of
rows in the source. A DataFrame has none, so each operator here takes order, the columns that give it (a scan's is
fold(Id)). Where the keys are integers, or the result can't tell, no order is needed and plain Spark is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import FAULT, col, fold
from ..session import shared_folder

MAX_ITERATIONS = 32_767


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if f.dataType.typeName() == "string"}


def keys(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Group keys for columns of df: folded for text, as they are for integers."""
    some = _text_columns(df)
    return [fold(n) if n in some else F.col(n) for n in names]


def values(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Inline rows; text, 64-bit integers and nulls; a column of both kinds becomes text. _row keeps their order."""
    if any(len(r) != len(names) for r in rows):
        raise ValueError("InlineValuesArityMismatch")
    kinds = []
    for i, n in enumerate(names):
        kind = {type(r[i]) for r in rows if r[i] is not None}
        kinds.append("long" if kind == {int} else "string")
    cell = lambda v, kind: v if v is None or kind == "long" else str(v)
    data = [(*map(cell, r, kinds), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join([*(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)), "_row long"]))


def distinct(df: DataFrame, order: Sequence[Column], names: Sequence[str] | None = None) -> DataFrame:
    """DISTINCT by folded values; the first row of each stays."""
    names = list(names or df.columns)
    if not _text_columns(df.select(*names)):
        return df.select(*names).distinct()
    first = F.min_by(F.struct(*names), F.struct(*order))
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys(df, names))]).agg(first.alias("_r")).select("_r.*")


def first_of(x, order: Sequence[Column]) -> Column:
    """The value in the group's first row."""
    return F.min_by(col(x), F.struct(*order))


def min_text(x, order: Sequence[Column]) -> Column:
    """The smallest text by fold key; of equal ones that of the first row. Nulls do not count."""
    return F.min_by(col(x), F.when(col(x).isNotNull(), F.struct(fold(x).alias("f"), F.struct(*order).alias("o"))))


def max_text(x, order: Sequence[Column]) -> Column:
    """The largest text by fold key; of equal ones that of the first row."""
    return F.max_by(col(x), F.struct(fold(x).alias("f"), *[_falling(c).alias(f"o{i}") for i, c in enumerate(order)]))


def _falling(c: Column) -> Column:
    """A key that falls as a key of text or integers rises; that of null is the largest."""
    is_text = F.typeof(c) == "string"
    number = F.when(~is_text, -c.try_cast("decimal(20,0)"))
    text = F.when(is_text, F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    return F.struct(c.isNull().alias("n"), number.alias("i"), text.alias("t"))


def stable(x, order: Sequence[Column], text: bool = True) -> Column:
    """The group's one value of an expression that is no group key; faults if rows of the group differ in it."""
    key = fold(x) if text else col(x)
    n, some = F.count(F.lit(1)), F.count(col(x))
    fault = F.raise_error(F.lit(FAULT + "GroupedProjectionNotDeterministic"))
    same = ((some == 0) | (some == n)) & F.coalesce(F.min(key) == F.max(key), F.lit(True))
    return F.when(same, first_of(x, order)).otherwise(fault)


def string_agg(x, separator: str, by: Sequence[tuple[Column, bool]], order: Sequence[Column]) -> Column:
    """Text values joined by separator, ordered by (key, ascending) pairs, then by row order; nulls are left out."""
    cells = F.struct(*[(k if up else _falling(k)).alias(f"k{i}") for i, (k, up) in enumerate(by)], *[c.alias(f"o{i}") for i, c in enumerate(order)], col(x).cast("string").alias("v"))
    kept = F.sort_array(F.collect_list(F.when(col(x).isNotNull(), cells)))
    return F.when(F.count(col(x)) > 0, F.array_join(F.transform(kept, lambda e: e["v"]), separator))


def row_number(partition: Sequence[Column], by: Sequence[tuple[Column, bool]], order: Sequence[Column]) -> Column:
    """1-based number of the row in its partition; nulls first ascending, last descending; ties by row order.

    Without a partition all rows would lie in one task: ranges.row_numbers() numbers them by ranges.
    """
    if not partition:
        raise ValueError("RowNumberPartitionMissing: use ranges.row_numbers")
    parts = [k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in by] + [c.asc_nulls_first() for c in order]
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*parts)).cast("long")


def split(df: DataFrame, x, separator: str, outer: bool = False, value: str = "value", ordinal: str | None = None) -> DataFrame:
    """CROSS or OUTER APPLY of STRING_SPLIT: a row for each part; no row for null unless outer; '' is one empty part."""
    if separator is None or len(separator) != 1:
        raise ValueError("StringSplitSeparatorInvalid")
    parts = F.split(col(x), "\\Q" + separator + "\\E", -1)
    explode = F.posexplode_outer(parts) if outer else F.posexplode(parts)
    out = df.select("*", explode.alias("_p", value))
    return out.withColumn(ordinal, (F.col("_p") + 1).cast("long")).drop("_p") if ordinal else out.drop("_p")


def join(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """INNER, LEFT or CROSS join; the others are not part of the surface."""
    if how not in ("inner", "left", "cross"):
        raise ValueError(f"UnsupportedSyntax: {how} join")
    return a.crossJoin(b) if how == "cross" else a.join(b, on, how)


def exists(a: DataFrame, b: DataFrame, on: Column, negate: bool = False) -> DataFrame:
    """Rows of a with (or without) a row of b for which on holds."""
    return a.join(b, on, "left_anti" if negate else "left_semi")


def scalar(df: DataFrame, inner: DataFrame, on: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the value of the one row of inner with equal keys, null without one; two rows fault."""
    parts = [F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v")]
    found = inner.groupBy(*on).agg(*parts) if on else inner.agg(*parts)
    met = df.join(found, list(on), "left") if on else df.crossJoin(found)
    fault = F.raise_error(F.lit(FAULT + "ScalarSubqueryCardinalityInvalid")).cast(inner.schema[value].dataType)
    return met.withColumn(name, F.when(F.col("_n") > 1, fault).otherwise(F.col("_v"))).drop("_n", "_v")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, then of b; names from a. Counts of columns are equal; where kinds differ, the column becomes text."""
    if len(a.columns) != len(b.columns):
        raise ValueError("UnionColumnCountMismatch")
    b = b.toDF(*a.columns)
    for x, y in zip(a.schema, b.schema, strict=True):
        if x.dataType != y.dataType and {x.dataType.typeName(), y.dataType.typeName()} & {"string"}:
            a, b = (d.withColumn(x.name, F.col(f"`{x.name}`").cast("string")) for d in (a, b))
    return a.union(b)


def recursive(anchor: DataFrame, member: Callable[[DataFrame], DataFrame], level: str | None = None, limit: int = MAX_ITERATIONS) -> DataFrame:
    """The union of anchor, member(anchor), member(member(anchor)) and so on until an iteration has no rows.

    Each iteration is checkpointed, so plans stay small and a lost executor costs nothing; level names a column with
    the iteration. Up to limit iterations may have rows. An iteration with the rows of the one before, text compared
    in any case, faults: counts and sums of hashes tell, and only where those agree are the rows compared.
    """
    spark = anchor.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    folded = lambda df: df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys(df, df.columns))])
    now, out, i, before = anchor.checkpoint(), None, 0, None
    while (mark := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys(now, now.columns)).cast("decimal(38,0)"))).first()))[0]:
        if i >= limit:
            raise RuntimeError("CommonTableExpressionRecursionLimitExceeded")
        if before is not None and mark == before[0] and folded(now).exceptAll(folded(before[1])).isEmpty():
            raise RuntimeError("CommonTableExpressionRecursionDidNotAdvance")
        part = now.withColumn(level, F.lit(i).cast("long")) if level else now
        out = part if out is None else out.union(part)
        before = mark, now
        now, i = member(now).checkpoint(), i + 1
    return out if out is not None else (anchor.withColumn(level, F.lit(0).cast("long")) if level else anchor)
