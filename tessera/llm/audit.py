"""Filter interaction audit: what each filter removes in every order, from counts of the masks of failed filters.

A document's mask has a bit for each filter that it fails. Documents are counted by part and mask; a subset-zeta
transform of a part's 2 ** k counts gives the survivors of every set of filters, and a step of an order is the
difference between two neighbouring sets. Counts of labelled documents go through the same transform.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, stored, words

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"
#: Parts whose rows are made at once.
PARTS_AT_ONCE = 32

_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; a null text is empty. A is bit 0."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            words(t),
            lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w), 2).otherwise(0)
            + F.when(100 * F.regexp_count(t, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.char_length(t), 4).otherwise(0)
            + F.when(t.rlike(SYMBOLS), 8).otherwise(0),
        ),
    ).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs(doc_id, text, source): documents by part and failed filters.

    Filter E, bit 4, fails where a smaller doc_id has the same text (null: empty), whatever its part. A row without a
    doc_id is not compared: it passes E and has no labels. Equal rows count each; a doc_id with several rows of labels
    is good or toxic if one says so. Null sources are the part ''.

    Texts are read once; what is stored and shuffled is a digest, a mask and ids. Rows that agree in all of them are
    counted before they move, the first of a text is a minimum with partial results, and the joins are by doc_id, so
    neither a large part nor a text with many copies lies in one task.
    """
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    cells = stored(docs.select("doc_id", part, digest, text_failures(F.col("text")).alias("mask")).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "mask-cells")
    known = cells.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    met = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    met = met.select("part", F.when(F.col("first").isNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = cells.where(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    both = met.unionByName(rest)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """For counts[..., mask] of 2 ** k masks, [..., s]: how many pass every filter of the set s.

    The zeta transform sums over the subsets of a set, one bit at a time; what passes s are the masks within its
    complement.
    """
    k, z = counts.shape[-1].bit_length() - 1, counts.copy()
    for bit in range(k):
        pairs = z.reshape(*z.shape[:-1], -1, 2, 1 << bit)
        pairs[..., 1, :] += pairs[..., 0, :]
    return z[..., ::-1]


def steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step, bit of the filter, set of the filters before it) of every step of every order."""
    orders, step, bit, before = [], [], [], []
    for order in permutations(range(len(letters))):
        gone = 0
        for i, f in enumerate(order):
            orders.append("".join(letters[x] for x in order))
            step.append(i + 1)
            bit.append(f)
            before.append(gone)
            gone |= 1 << f
    return orders, np.array(step), np.array(bit), np.array(before)


def interactions(counts: np.ndarray, bit: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of _COUNTS as [part, step row], for counts[measure, part, mask] of all, good and toxic documents."""
    k, alive = counts.shape[-1].bit_length() - 1, survivors(counts)
    after = before | 1 << bit
    removed = alive[..., before] - alive[..., after]
    sets, everything = np.arange(1 << k), (1 << k) - 1
    fails = alive[0][:, :1] - alive[0][:, 1 << bit]
    alone = alive[0][:, everything ^ 1 << bit] - alive[0][:, everything : everything + 1]
    # an order puts just the filters of a set before a filter in |set|! (k - 1 - |set|)! ways
    ways = np.array([factorial(int(s).bit_count()) * factorial(max(0, k - 1 - int(s).bit_count())) for s in sets])
    shares = np.stack([((alive[0][:, free] - alive[0][:, free | 1 << f]) * ways[free]).sum(axis=1) for f in range(k) for free in [sets[sets >> f & 1 == 0]]], axis=1)
    return {"kept": alive[0][:, after], "removed": removed[0], "redundant": fails - removed[0], "unique_fails": alone, "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shares[:, bit]}


def _audit(letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, step, bit, before = steps(letters)
        for b in batches:
            for at in range(0, b.num_rows, PARTS_AT_ONCE):
                some = b.slice(at, PARTS_AT_ONCE)
                parts = some.column("part").to_pylist()
                counts = np.zeros((3, len(parts), 1 << len(letters)), dtype=np.int64)
                for i, cells in enumerate(some.column("cells").to_pylist()):
                    for c in cells:
                        counts[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                found, rows = interactions(counts, bit, before), len(orders)
                columns = [pa.array(np.repeat(np.array(parts, dtype=object), rows), pa.string()), pa.array(orders * len(parts), pa.string()), pa.array(np.tile(step, len(parts)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found[c].ravel(), pa.int64()) for c in _COUNTS]], ["part", "filter_order", "step", *_COUNTS])

    return run


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, for counts as mask_counts() gives them; letters name the bits.

    A part is one row of at most 2 ** k cells, whatever it holds; parts are independent. Nothing for no parts.
    """
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_audit(letters), _RESULT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(mask_counts(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_UPPER_PERCENT} * length(text) AS c, regexp_matches(text, '{SYMBOLS}') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), n AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, bit)
), o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits FROM f p, f q, f r, f s, f u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31
), k AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, list_sum(bits[1 : i]) - bits[i] AS before FROM o, range(1, 6) AS g(i)
), x AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT part, filter_order, step, bit, CAST(before AS BIGINT) AS before, mask, n, good, toxic FROM n, k) GROUP BY ALL
)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS[:-1])}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""
