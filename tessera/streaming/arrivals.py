"""Records of one entity as a stream: those that break the model, and counts by a property in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fold
from ..model import ID_PATTERN, Entity


def records(spark: SparkSession, entity: Entity, path: str, time: str | None = None) -> DataFrame:
    """New Parquet files under path as a stream; time is a timestamp column beside the members."""
    schema = ", ".join([*[f"`{c}` string" for c in entity.columns], *([f"`{time}` timestamp"] if time else [])])
    return spark.readStream.schema(schema).parquet(path)


def broken(df: DataFrame, entity: Entity) -> DataFrame:
    """(id, code, member) of what can be seen in a record alone: missing or invalid ids and missing required members."""
    tests = [(F.col("Id").isNull() | (F.trim("Id") == ""), "instance.id.missing", "Id"), ((F.trim("Id") != "") & ~F.col("Id").rlike(ID_PATTERN), "instance.id.invalid", "Id")]
    tests += [(F.col(p.name).isNull(), "instance.required.missing", p.name) for p in entity.properties if p.required]
    tests += [(F.col(r.column).isNull(), "instance.relationship.missing", r.column) for r in entity.relationships if r.required]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(m).alias("member"))) for t, c, m in tests]), lambda x: x.isNotNull())
    return df.select(F.col("Id").alias("id"), F.explode(found).alias("x")).select("id", "x.*")


def counts(df: DataFrame, by: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records by a property in any case and by window; state of windows past the watermark is dropped."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), fold(by).alias(by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
