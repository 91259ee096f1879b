"""What the corpus operators share: table access, scratch tables, row identity, small text helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one whose files are too few to keep the cores busy is dealt out to as many partitions as there are cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_hot(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """rows joined with told(key, times, ...), which has one row for each key and the number of rows that hold it.

    A key of over a thousandth of all rows is sent to every executor, of which there can't be more than a thousand;
    the others meet by shuffles, in which no key is large. Rows with a null key, or one that told lacks, have no match.
    """
    hot = told.where(F.col("times") > max(1, rows.count() // 1000))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(told, key))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that identify a row by its content, nulls included; equal rows share them.

    Unlike a generated id they come out the same when Spark computes a lost partition again.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")).alias("_k"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_h"),
    ]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The array of `[^\\x20\\x09-\\x0D]+` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it within further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
