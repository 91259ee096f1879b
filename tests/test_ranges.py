"""Orders dealt out by ranges: numbers, pages, joins by comparison, correlated aggregates, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ranges
from tessera.operators import relational as R
from tessera.plans import catalog

from . import oracle


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_numbers(spark):
    r = random.Random(1)
    data = [(i, r.choice([None, 1, 2, 3]), r.choice("abC")) for i in range(300)]
    df = spark.createDataFrame(data, "id int, a int, b string").repartition(7)
    out = ranges.row_numbers(df, [(F.col("a"), False), (S.fold("b"), True)], [F.col("id")], "n")
    want = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[2].upper(), x[0]))
    assert sorted((x.n, x.id) for x in out.collect()) == [(k, x[0]) for k, x in enumerate(want, 1)]
    assert "Window" not in plan(out) and "SinglePartition" not in plan(out)
    assert ranges.row_numbers(df.where("false"), [(F.col("a"), True)], [F.col("id")], "n").count() == 0
    with pytest.raises(ValueError, match="RowNumberPartitionMissing"):
        R.row_number([], [(F.col("a"), True)], [])


@pytest.mark.parametrize("pages", [100_000, 40])
def test_page(spark, monkeypatch, pages):
    """Every page of a table with nulls, ties and a frequent key, sorted at once and sought by ranges."""
    monkeypatch.setattr(ranges, "PAGE_ROWS", pages)
    monkeypatch.setattr(ranges, "PAGE_RANGES", 9)
    r = random.Random(2)
    keys = [None] * 60 + ["hot"] * 250 + [f"{r.choice('abcxyz')}{r.randrange(99)}" for _ in range(700)]
    data = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "k string, i int").repartition(5)
    want = sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    for offset, size in ((55, 10), (400, 25), (9999, 7), (-5, 3), (0, 2000)):
        out = ranges.page(df, [F.col("k"), F.col("i")], offset, size)
        start = max(0, min(offset, len(want) - size))
        assert [tuple(x) for x in out.collect()] == want[start : start + size]
        assert "CollectLimit" not in plan(out)
    assert ranges.page(df.where("false"), [F.col("k"), F.col("i")], 0, 5).count() == 0


def test_page_of_integers(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PAGE_ROWS", 50)
    df = spark.range(10_000).select((F.col("id") * 7 % 10_000).alias("id"))
    assert [x.id for x in ranges.page(df, [F.col("id")], 6_123, 40).collect()] == list(range(6_123, 6_163))


OPS = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}


@pytest.mark.parametrize(("ops", "block", "most"), [(["<"], 20_000, 1_000_000), ([">="], 15, 1_000_000), (["<=", ">"], 15, 1_000_000), (["<"], 15, 30), ([">", "="], 15, 30)])
def test_theta_join(spark, monkeypatch, ops, block, most):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", block)
    monkeypatch.setattr(ranges, "MOST_PAIRS", most)
    r = random.Random(len(ops))
    side = lambda n: [(i, r.choice([None, 50, 50, r.randrange(100)]), r.choice([None, "k", "m", "z"])) for i in range(n)]
    a, b = side(120), side(90)
    left, right = spark.createDataFrame(a, "i int, x int, s string"), spark.createDataFrame(b, "j int, y int, t string")
    on = [(F.col(p), op, F.col(q)) for op, p, q in zip(ops, "xs", "yt")]
    fits = lambda p, q: all(p[k] is not None and q[k] is not None and OPS[op](p[k], q[k]) for k, op in enumerate(ops, 1))
    want = [(p[0], q[0]) for p in a for q in b if fits(p, q)]
    out = ranges.theta_join(left, right, on)
    assert rows(out.select("i", "j")) == sorted(want, key=str)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    bare = [(p[0], None) for p in a if not any(p[0] == i for i, _ in want)]
    assert rows(ranges.theta_join(left, right, on, "left").select("i", "j")) == sorted([*want, *bare], key=str)
    odd = ranges.theta_join(left, right, on, where=F.col("i") % 2 == F.col("j") % 3)
    assert rows(odd.select("i", "j")) == sorted([(i, j) for i, j in want if i % 2 == j % 3], key=str)


@pytest.fixture
def stored(monkeypatch):
    """Numbers of rows of the tables that operators store."""
    sizes, kept = [], ranges.kept

    def counted(df, label):
        out = kept(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ranges, "kept", counted)
    return sizes


@pytest.mark.parametrize(("ops", "odd"), [(["<"], False), (["<="], True), ([">"], False), ([">="], False), (["="], False), (["<", ">"], True), ([">=", "<="], False), (["=", "<"], False)])
def test_theta_join_left_stores_its_sides_only(spark, monkeypatch, stored, ops, odd):
    """Rows without a match, in blocks that may meet another and in ones that meet none; null keys; odd is a condition beside the comparisons."""
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 15)
    r = random.Random(3)
    a = [(i, r.choice([None, 7, r.randrange(60)]), r.randrange(60)) for i in range(130)]
    b = [(j, r.choice([None, r.randrange(10, 50)]), r.randrange(10, 50)) for j in range(110)]
    on = [(F.col(p), op, F.col(q)) for op, p, q in zip(ops, ("x", "s"), ("y", "t"))]
    fits = lambda p, q: all(p[k] is not None and q[k] is not None and OPS[op](p[k], q[k]) for k, op in enumerate(ops, 1)) and (not odd or p[0] % 5 < q[0] % 4)
    met = [(p[0], q[0]) for p in a for q in b if fits(p, q)]
    found = {i for i, _ in met}
    want = [*met, *[(p[0], None) for p in a if p[0] not in found]]
    where = F.col("i") % 5 < F.col("j") % 4 if odd else None
    out = ranges.theta_join(spark.createDataFrame(a, "i int, x int, s int"), spark.createDataFrame(b, "j int, y int, t int"), on, "left", where)
    assert rows(out.select("i", "j")) == sorted(want, key=str)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert sum(stored) <= len(a) + len(b)


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no tables here")
def test_theta_left_forms_no_pairs(spark, stored, tmp_path):
    """Repeated and null customers, a frequent owner, owners that are no customers: counts by SQL, stored rows in proportion to the tables."""
    c = oracle.connect()
    for t in oracle.TABLES:
        if t not in ("customer", "orders"):
            os.symlink(f"{oracle.DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    customers = "SELECT * REPLACE (CASE WHEN i % 50 = 0 THEN NULL ELSE i // 2 END AS c_custkey) FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) LIMIT 400"
    orders = "SELECT * REPLACE (CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 90 ELSE o_orderkey % 301 - 50 END AS o_custkey, '1-URGENT' AS o_orderpriority, 'P' AS o_orderstatus) FROM orders ORDER BY o_orderkey LIMIT 1000"
    c.execute(f"COPY (SELECT * EXCLUDE (i) FROM ({customers})) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    c.execute(f"COPY ({orders}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    oracle.agree(spark, catalog.QUERIES["theta_left"], catalog.SQL["theta_left"], str(tmp_path))
    assert 0 < sum(stored) <= 2 * (400 + 1000)


def test_theta_join_of_nothing(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    assert ranges.theta_join(a.where("false"), b, [(F.col("x"), "<", F.col("y"))], "left").count() == 0
    assert rows(ranges.theta_join(a, b.where("false"), [(F.col("x"), "<", F.col("y"))], "left")) == [(1, None)]
    with pytest.raises(ValueError, match="UnsupportedSyntax"):
        ranges.theta_join(a, b, [(F.col("x"), "<", F.col("y"))], "full")
    with pytest.raises(ValueError, match="ComparisonOperatorInvalid"):
        ranges.theta_join(a, b, [(F.col("x"), "<>", F.col("y"))])


@pytest.mark.parametrize(("op", "how", "on"), [("<", "max", []), ("<=", "count", []), (">", "min", ["k"]), (">=", "sum", ["k"]), ("<", "count", ["k", "m"]), ("<=", "max", ["k", "m"]), (">", "sum", []), (">=", "min", [])])
def test_correlated(spark, op, how, on):
    """Over several ranges, with a key that fills some of them."""
    r = random.Random(hash((op, how, len(on))) % 1000)
    key = lambda: (r.choice([None, "hot", "hot", "hot", "a", "b"]), r.choice([1, 2]))
    inner = [(*key(), r.choice([None, r.randrange(40)]), r.choice([None, r.randrange(-50, 50)])) for _ in range(150)]
    outer = [(*key(), r.choice([None, r.randrange(40)]), i) for i in range(120)]
    names = "k string, m int"
    got = ranges.correlated(spark.createDataFrame(outer, f"{names}, x int, i int"), spark.createDataFrame(inner, f"{names}, y int, v int"), on, F.col("x"), op, F.col("y"), F.col("v"), how, "out")
    want = []
    for k, m, x, i in outer:
        hit = [v for p, q, y, v in inner if x is not None and y is not None and OPS[op](y, x) and ("k" not in on or (k is not None and p == k)) and ("m" not in on or q == m) and v is not None]
        value = len(hit) if how == "count" else {"max": max, "min": min, "sum": sum}[how](hit) if hit else None
        want.append((i, value))
    assert rows(got.select("i", "out")) == sorted(want, key=str)


def test_correlated_gives_the_row_of_the_greatest_place(spark):
    prices = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 3, "z")], "k string, t int, p string")
    asked = spark.createDataFrame([("a", 4), ("a", 5), ("b", 2), ("c", 9)], "k string, t int")
    out = ranges.correlated(asked, prices, ["k"], F.col("t"), "<=", F.col("t"), F.struct("t", "p"), "max", "last")
    assert rows(out.select("k", "t", "last.p")) == [("a", 4, "x"), ("a", 5, "y"), ("b", 2, None), ("c", 9, None)]
    assert ranges.correlated(asked.where("false"), prices, ["k"], F.col("t"), "<", F.col("t"), F.lit(1), "count", "n").count() == 0
    assert {r.n for r in ranges.correlated(asked, prices.where("false"), [], F.col("t"), "<", F.col("t"), F.lit(1), "count", "n").collect()} == {0}
