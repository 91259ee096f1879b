import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import relational as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fold_is_one_character_for_one(spark):
    t = lambda x: F.lit(x)
    assert one(spark, S.fold(t("straße")), S.fold(t("ﬁn")), S.fold(t("ıſa")), S.fold(t("_a")), S.fold(t(None).cast("string"))) == ("STRAßE", "ﬁN", "ıſA", "_A", None)
    assert one(spark, S.compare(t("_"), "<", t("a"))) == (False,)


def test_like(spark):
    t = F.lit("a.B\nc[x")
    cases = {"A.b%": True, "a_b%": True, "%[x-z]": True, "%[^x]": False, "%[x": True, "a.b": False, "%\n_%": True}
    assert one(spark, *[S.like(t, p) for p in cases]) == tuple(cases.values())


def test_like_and_replace_take_expressions(spark):
    rows = [("a.B\nc[x", p) for p in ("A.b%", "a_b%", "%[x-z]", "%[^x]", "%[x", "a.b", "%\n_%", "%[[]x", "%[]x", "%[^^&]", "%\\%", "[a-b]%", None)]
    df = spark.createDataFrame(rows, "t string, p string")
    got = [r[0] for r in df.select(S.like("t", F.col("p"))).collect()]
    assert got == [None if p is None else one(spark, S.like(F.lit(t), p))[0] for t, p in rows]
    edits = [("abcABC", "b", "$X\\"), ("a", "", "z"), ("a\\E.b", "\\e.", "-"), ("x.y", ".", ""), ("a", None, "b"), ("a", "", None)]
    df = spark.createDataFrame(edits, "t string, o string, n string")
    assert [r[0] for r in df.select(S.replace("t", F.col("o"), F.col("n"))).collect()] == ["a$X\\cA$X\\C", "a", "a-b", "xy", None, None]


def test_integer_keys_and_ties(spark):
    df = R.values(spark, ["k", "v"], [(9, "z"), (10, "y"), (100, "x"), (None, "w")])
    down = df.agg(R.string_agg("v", ",", [(F.col("k"), False)], [F.col("_row")]).alias("x"))
    assert rows(down) == [("x,y,z,w",)]
    ties = R.values(spark, ["v"], [("a",), ("b",), ("Zz",), *[("c",)] * 7, ("zZ",)])
    assert rows(ties.agg(R.max_text("v", [F.col("_row")]), R.min_text("v", [F.col("_row")]))) == [("Zz", "a")]


def test_stable_values(spark):
    df = R.values(spark, ["g", "v"], [("a", "x"), ("a", "X"), ("b", None), ("b", None)])
    assert rows(df.groupBy("g").agg(R.stable("v", [F.col("_row")]))) == [("a", "x"), ("b", None)]
    for bad in ([("a", "x"), ("a", "y")], [("a", "x"), ("a", None)]):
        with pytest.raises(Exception, match="GroupedProjectionNotDeterministic"):
            R.values(spark, ["g", "v"], bad).groupBy("g").agg(R.stable("v", [F.col("_row")])).collect()


def test_three_valued_in(spark):
    x = F.lit("a")
    assert one(spark, S.within(x, ["A", None]), S.within(x, ["b", None]), S.within(F.lit(None).cast("string"), ["a"])) == (True, None, None)


def test_text_functions(spark):
    assert one(spark, S.concat(F.lit("a"), None, 5), S.trim(F.lit(" \tx ")), S.length(F.lit("a😀  ")), S.length(F.lit("Ångström"))) == ("a5", "\tx", 3, 8)
    assert one(spark, S.is_blank(F.lit(None).cast("string")), S.is_blank(F.lit(" \t ")), S.is_blank(F.lit("x"))) == (1, 1, 0)
    assert one(spark, S.replace(F.lit("abcABC"), "b", "$X\\"), S.replace(F.lit("a"), "", "z")) == ("a$X\\cA$X\\C", "a")


@pytest.mark.parametrize(("start", "count", "want"), [(0, 3, "ab"), (-1, 3, "a"), (2, 3, "bcd"), (9, 3, ""), (1, 0, ""), (-5, 3, "")])
def test_substring(spark, start, count, want):
    assert one(spark, S.substring(F.lit("abcdef"), start, count)) == (want,)


def test_negative_lengths_fault(spark):
    for c in (S.substring(F.lit("a"), 1, -1), S.left(F.lit("a"), -1), S.right(F.lit("a"), -1)):
        with pytest.raises(Exception, match="fault:"):
            one(spark, c)


def test_to_int(spark):
    given = {" 12 ": 12, "+5": 5, "1.5": None, "": None, "2147483648": None, "-2147483648": -2147483648, "1e3": None, "\t7\n": 7, "9" * 60: None}
    assert one(spark, *[S.to_int(F.lit(x)) for x in given]) == tuple(given.values())


def test_conditionals(spark):
    null = F.lit(None).cast("string")
    assert one(spark, S.coalesce(null, "x"), S.nullif(F.lit("a"), "A"), S.nullif(F.lit("a"), "b"), S.iif(null == "a", "y", "n"), S.case([(F.lit(False), "a")])) == ("x", None, "a", "n", None)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order_decides_spelling_and_ties(spark):
    df = R.values(spark, ["Id", "g", "v"], [("3", "k", "b"), ("1", "K", "B"), ("2", "k", None), ("4", "j", "a")])
    order = [S.fold("Id")]
    assert rows(R.distinct(df, order, ["g"])) == [("K",), ("j",)]
    got = df.groupBy(S.fold("g")).agg(R.first_of("g", order), R.min_text("v", order), R.max_text("v", order), R.string_agg("v", ",", [(S.fold("v"), True)], order), F.count("v"))
    assert rows(got) == [("J", "j", "a", "a", "a", 1), ("K", "K", "B", "B", "B,b", 2)]
    numbered = df.select("Id", R.row_number([S.fold("g")], [(S.fold("v"), True)], order))
    assert rows(numbered) == [("1", 2), ("2", 1), ("3", 3), ("4", 1)]
    down = df.groupBy(F.lit(1)).agg(R.string_agg("Id", ",", [(S.fold("v"), False)], order).alias("x")).select("x")
    assert rows(down) == [("1,3,4,2",)]


def test_empty_groups(spark):
    df = R.values(spark, ["Id", "v"], [("1", "a")]).where("false")
    assert rows(df.agg(F.count(F.lit(1)), R.string_agg("v", ",", [(S.fold("v"), True)], [F.col("Id")]), R.min_text("v", [F.col("Id")]))) == [(0, None, None)]


def test_split_and_apply(spark):
    df = R.values(spark, ["Id", "t"], [("1", "b.a"), ("2", None), ("3", "")]).drop("_row")
    assert rows(R.split(df, "t", ".", ordinal="o").select("Id", "value", "o")) == [("1", "a", 2), ("1", "b", 1), ("3", "", 1)]
    assert rows(R.split(df, "t", ".", outer=True).select("Id", "value")) == [("1", "a"), ("1", "b"), ("2", None), ("3", "")]
    with pytest.raises(ValueError, match="StringSplitSeparatorInvalid"):
        R.split(df, "t", "ab")


def test_values_union_and_scalar_faults(spark):
    mixed = R.values(spark, ["a"], [(1,), ("x",), (None,)])
    assert rows(mixed.select("a")) == [("1",), ("x",), (None,)]
    a = R.values(spark, ["a"], [(1,)]).drop("_row")
    with pytest.raises(ValueError, match="UnionColumnCountMismatch"):
        R.union_all(a, a.withColumn("b", F.lit(1)))
    assert rows(R.union_all(a, R.values(spark, ["z"], [("x",)]).drop("_row"))) == [("1",), ("x",)]
    assert R.union_all(a, a).schema["a"].dataType.typeName() == "long"
    with pytest.raises(ValueError, match="UnsupportedSyntax"):
        R.join(a, a, F.lit(True), "full")
    two = R.values(spark, ["k", "v"], [("1", "a"), ("1", "b"), ("2", "c")]).drop("_row")
    left = R.values(spark, ["k"], [("2",), ("3",)]).drop("_row")
    assert rows(R.scalar(left, two, ["k"], "v", "x")) == [("2", "c"), ("3", None)]
    with pytest.raises(Exception, match="ScalarSubqueryCardinalityInvalid"):
        R.scalar(R.values(spark, ["k"], [("1",)]).drop("_row"), two, ["k"], "v", "x").collect()


def test_recursion(spark):
    n = R.values(spark, ["Id", "p"], [("root", None), ("a", "root"), ("b", "root"), ("c", "a")]).drop("_row")
    got = R.recursive(n.where("p is null").select("Id", F.col("Id").alias("path")), lambda t: t.alias("t").join(n.alias("n"), F.col("n.p") == F.col("t.Id")).select("n.Id", S.concat(F.col("t.path"), "/", F.col("n.Id")).alias("path")))
    assert rows(got) == [("a", "root/a"), ("b", "root/b"), ("c", "root/a/c"), ("root", "root")]
    with pytest.raises(RuntimeError, match="DidNotAdvance"):
        R.recursive(n.select("Id"), lambda t: t)


def test_recursion_stops_at_its_limit_and_at_repeats_in_any_case(spark):
    start = spark.createDataFrame([(0,)], "n int")
    step = lambda most: lambda t: t.select((F.col("n") + 1).alias("n")).where(F.col("n") < most)
    assert R.recursive(start, step(3), limit=3).count() == 3
    with pytest.raises(RuntimeError, match="RecursionLimitExceeded"):
        R.recursive(start, step(4), limit=3)
    flip = lambda t: t.select(F.when(F.col("s") == "a", "A").otherwise("a").alias("s"))
    with pytest.raises(RuntimeError, match="RecursionDidNotAdvance"):
        R.recursive(spark.createDataFrame([("a",)], "s string"), flip, limit=9)


def test_places_count_utf16_units(spark):
    """Texts with characters of two units against Python's UTF-16."""
    texts = ["a😀b", "😀", "😀𐀀x😁", "plain", "", "é😀"]
    cut = lambda t, a, b: t.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le", "replace")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(6):
        for s in range(-1, 6):
            got = [tuple(r) for r in df.select(S.substring("t", s, n), S.left("t", n), S.right("t", n), S.length("t")).collect()]
            for t, (sub, left, right, size) in zip(texts, got):
                units = len(t.encode("utf-16-le")) // 2
                a, b = max(0, s - 1), max(0, s - 1 + n)
                assert (sub, left, right, size) == (cut(t, a, max(a, b)), cut(t, 0, n), cut(t, max(0, units - n), units), units)
