"""The registered queries over the benchmark tables, each beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import Entity, Model, Property, Relationship, Workspace
from ..operators import diffs as D
from ..operators import operations as O
from ..operators import graph, ordering, ranges
from ..operators import relational as R
from ..operators import services as V
from ..session import shared_folder
from ..sources import files, imports, shards
from ..sources.tables import as_text, first_difference, star
from .direction import Direction

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def by_id() -> list[Column]:
    """A scan's row order."""
    return [S.fold(F.col("Id").cast("string"))]


_FIXTURE = """(SELECT 's' || c_custkey AS Id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Alpha' WHEN 2 THEN 'alpha' ELSE c_name END AS Name, 'K' || (1 + c_custkey % 2) AS Kind,
CASE c_custkey % 3 WHEN 1 THEN lower(c_mktsegment) || ',' || c_nationkey WHEN 2 THEN 'x' END AS Tags, CASE c_custkey % 4 WHEN 1 THEN 'R1' WHEN 2 THEN 'r2' WHEN 3 THEN 'r1' END AS RoleId FROM customer)"""
_PIECES = """(SELECT p_partkey AS n, CASE p_partkey % 7 WHEN 0 THEN '  ' || p_name || '  ' WHEN 1 THEN p_type || chr(9) WHEN 2 THEN 'Ångström ' || p_brand WHEN 3 THEN p_type || '   ' WHEN 4 THEN '' WHEN 5 THEN chr(9) || ' ' END AS t FROM part)"""


def _by_rest(k: Column, n: int, cells: dict[int, Column]) -> Column:
    out = F
    for rest, cell in cells.items():
        out = out.when(k % n == rest, cell)
    return out


def fixture(spark, sf) -> DataFrame:
    """Customers with names in mixed case, some empty, some equal but for case, and lists and roles that some lack."""
    c = star(spark, sf, typed=True)["Customer"]
    k, one = F.col("Id"), F.lit
    name = _by_rest(k, 5, {0: one(""), 1: one("Alpha"), 2: one("alpha")}).otherwise(F.col("Name"))
    tags = _by_rest(k, 3, {1: F.concat(F.lower("Segment"), one(","), F.col("NationId").cast("string")), 2: one("x")})
    role = _by_rest(k, 4, {1: one("R1"), 2: one("r2"), 3: one("r1")})
    return c.select(F.concat(one("s"), k.cast("string")).alias("Id"), name.alias("Name"), F.concat(one("K"), (1 + k % 2).cast("string")).alias("Kind"), tags.alias("Tags"), role.alias("RoleId"))


def pieces(spark, sf) -> DataFrame:
    """Texts of parts with spaces and tabs around them, longer letters, blanks, and some that are missing."""
    p = star(spark, sf, typed=True)["Part"]
    one = F.lit
    t = _by_rest(F.col("Id"), 7, {0: F.concat(one("  "), "Name", one("  ")), 1: F.concat("Type", one("\t")), 2: F.concat(one("Ångström "), "Brand"), 3: F.concat("Type", one("   ")), 4: one(""), 5: one("\t ")})
    return p.select(t.alias("t"), F.col("Id").alias("n"))


def mixed_status(ws: Workspace) -> DataFrame:
    """Orders with the status in lower case where the id is odd."""
    odd = F.col("Id").cast("long") % 2 == 1
    return ws["Order"].select("Id", F.when(odd, F.lower("Status")).otherwise(F.col("Status")).alias("Status"), "Priority", "CustomerId")


_MIXED = "(SELECT CAST(o_orderkey AS VARCHAR) AS Id, CASE WHEN o_orderkey % 2 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS Status, o_orderpriority AS Priority, CAST(o_custkey AS VARCHAR) AS CustomerId FROM orders)"


# scans and sources


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, n_name AS Name, CAST(n_regionkey AS VARCHAR) AS RegionId FROM nation")
def scan_project(spark, sf):
    return star(spark, sf)["Nation"].select("Id", "Name", "RegionId")


@query("SELECT CAST(1 AS BIGINT) AS one, 'x' AS label, (SELECT count(*) FROM orders) AS n, (SELECT max(upper(c_mktsegment)) FROM customer) AS last")
def select_no_from(spark, sf):
    """A row from nothing but expressions, scalar subqueries among them."""
    ws = star(spark, sf)
    row = spark.range(1).select(F.lit(1).cast("long").alias("one"), F.lit("x").alias("label"))
    row = R.scalar(row, ws["Order"].agg(F.count(F.lit(1)).alias("v")), [], "v", "n")
    return R.scalar(row, ws["Customer"].agg(F.max(S.fold("Segment")).alias("v")), [], "v", "last")


@query("SELECT v.n, v.label, count(n_nationkey) AS nations FROM (VALUES (CAST(2 AS BIGINT), 'two'), (1, 'one'), (9, NULL)) AS v(n, label) LEFT JOIN nation ON n_regionkey = v.n GROUP BY v.n, v.label")
def values_table(spark, sf):
    """Inline rows joined with a table."""
    v = R.values(spark, ["n", "label"], [(2, "two"), (1, "one"), (9, None)])
    met = R.join(v, star(spark, sf, typed=True)["Nation"], F.col("n") == F.col("RegionId"), "left")
    return met.groupBy("n", "label").agg(F.count("Id").alias("nations"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, upper(r_name) AS label FROM region")
def derived_alias_list(spark, sf):
    return star(spark, sf)["Region"].select("Id", S.upper("Name")).toDF("key", "label")


# predicates


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id FROM orders WHERE upper(o_orderstatus) = 'O' AND upper(o_orderpriority) >= '3-'")
def where_cmp(spark, sf):
    return star(spark, sf)["Order"].where(S.equal(F.col("Status"), "o") & S.compare(F.col("Priority"), ">=", "3-")).select("Id")


@query(f"SELECT Id FROM {_FIXTURE} WHERE NOT (upper(RoleId) = 'R2' AND upper(Kind) = 'K1') OR (RoleId IS NULL AND Tags IS NOT NULL)")
def where_3vl(spark, sf):
    return fixture(spark, sf).where(~(S.equal(F.col("RoleId"), "r2") & S.equal(F.col("Kind"), "k1")) | (F.col("RoleId").isNull() & F.col("Tags").isNotNull())).select("Id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def in_list(spark, sf):
    return star(spark, sf)["Customer"].where(S.within(F.col("Segment"), ["building", "Machinery"])).select("Id")


@query(f"SELECT count(*) AS n FROM {_FIXTURE} WHERE NOT (upper(Kind) IN ('K1', NULL))")
def not_in_null(spark, sf):
    return fixture(spark, sf).where(~S.within(F.col("Kind"), ["k1", None])).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS Id, p_type AS Type FROM part WHERE p_type ILIKE '%m_l%' OR p_type ILIKE 's%d'")
def like_percent(spark, sf):
    return star(spark, sf)["Part"].where(S.like("Type", "%M_L%") | S.like("Type", "S%d")).select("Id", "Type")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, n_name AS Name FROM nation WHERE regexp_matches(n_name, '(?is)^[a-c][^r].*$') OR regexp_matches(n_name, '(?is)^.*[0-4]$')")
def like_set(spark, sf):
    return star(spark, sf)["Nation"].where(S.like("Name", "[a-c][^r]%") | S.like("Name", "%[0-4]")).select("Id", "Name")


@query(f"SELECT Id FROM {_FIXTURE} WHERE Tags IS NULL OR RoleId IS NULL")
def is_null(spark, sf):
    return fixture(spark, sf).where(F.col("Tags").isNull() | F.col("RoleId").isNull()).select("Id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def exists_semi(spark, sf):
    ws = star(spark, sf, typed=True)
    c, o = ws["Customer"], ws["Order"].where(S.like("Priority", "1-%"))
    return R.exists(c, o, c["Id"] == o["CustomerId"]).select(*as_text("Id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_anti(spark, sf):
    ws = star(spark, sf, typed=True)
    c, o = ws["Customer"], ws["Order"].where(S.equal(F.col("Status"), "p"))
    return R.exists(c, o, c["Id"] == o["CustomerId"], negate=True).select(*as_text("Id"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS Id FROM region WHERE EXISTS (SELECT count(*) FROM nation WHERE n_name = 'none such')")
def exists_aggregate(spark, sf):
    ws = star(spark, sf)
    one = ws["Nation"].where(S.equal(F.col("Name"), "none such")).agg(F.count(F.lit(1)).alias("n"))
    return R.exists(ws["Region"], one, F.lit(True)).select("Id")


# joins


@query("SELECT CAST(o_orderkey AS VARCHAR) AS OrderId, c_name AS Customer, n_name AS Nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_equi(spark, sf):
    ws = star(spark, sf, typed=True)
    o, c, n = ws["Order"].alias("o"), ws["Customer"].alias("c"), ws["Nation"].alias("n")
    joined = R.join(R.join(o, c, F.col("o.CustomerId") == F.col("c.Id")), n, F.col("c.NationId") == F.col("n.Id"))
    return joined.select(F.col("o.Id").cast("string").alias("OrderId"), F.col("c.Name").alias("Customer"), F.col("n.Name").alias("Nation"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND upper(a.n_name) < upper(b.n_name)")
def inner_theta(spark, sf):
    n = star(spark, sf, typed=True)["Nation"]
    a, b = n.alias("a"), n.alias("b")
    return R.join(a, b, (F.col("a.RegionId") == F.col("b.RegionId")) & S.compare(F.col("a.Name"), "<", F.col("b.Name"))).select(F.col("a.Name").alias("a"), F.col("b.Name").alias("b"))


_NEAR = "o_totalprice >= 100 * c_acctbal AND o_totalprice < 100 * c_acctbal + 40"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS CustomerId, CAST(o_orderkey AS VARCHAR) AS OrderId FROM customer JOIN orders ON {_NEAR}")
def theta_band(spark, sf):
    """Orders whose price lies in a band over a hundred times a customer's balance: no equality."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("CustomerId"), (100 * F.col("c_acctbal")).alias("balance"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("OrderId"), F.col("o_totalprice").alias("price"))
    price, balance = F.col("price"), F.col("balance")
    return ranges.theta_join(c, o, [(balance, "<=", price), (balance + 40, ">", price)]).select("CustomerId", "OrderId")


@query("SELECT CAST(c_custkey AS VARCHAR) AS CustomerId, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey > c_custkey AND o_orderpriority LIKE '1-%' AND o_orderstatus = 'P' GROUP BY c_custkey")
def theta_left(spark, sf):
    """How many urgent open orders belong to customers of greater ids; also none. Orders are counted by owner and added up along the ids, no pair is formed."""
    ws = star(spark, sf, typed=True)
    c = ws["Customer"].select(F.col("Id").alias("CustomerKey"))
    o = ws["Order"].where(S.like("Priority", "1-%") & S.equal(F.col("Status"), "p")).select(F.col("Id").alias("OrderKey"), F.col("CustomerId").alias("Owner"))
    owned = o.groupBy("Owner").agg(F.count("OrderKey").alias("owned"))
    behind = ranges.correlated(c, owned, [], F.col("CustomerKey"), ">", F.col("Owner"), F.col("owned"), "sum", "n")
    return behind.groupBy(F.col("CustomerKey").cast("string").alias("CustomerId")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, CAST(o_orderkey AS VARCHAR) AS OrderId FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def left_join(spark, sf):
    ws = star(spark, sf, typed=True)
    c, o = ws["Customer"].alias("c"), ws["Order"].alias("o")
    return R.join(c, o, (F.col("c.Id") == F.col("o.CustomerId")) & S.equal(F.col("o.Status"), "p"), "left").select(*as_text("c.Id"), F.col("o.Id").cast("string").alias("OrderId"))


@query("SELECT count(*) AS n FROM nation CROSS JOIN region")
def cross_join_count(spark, sf):
    ws = star(spark, sf)
    return R.join(ws["Nation"].select("Id"), ws["Region"].select(F.col("Id").alias("r")), F.lit(True), "cross").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS Nation, r_name AS Region FROM nation, region WHERE n_regionkey = r_regionkey")
def comma_join(spark, sf):
    ws = star(spark, sf, typed=True)
    n, r = ws["Nation"].alias("n"), ws["Region"].alias("r")
    return R.join(n, r, F.lit(True), "cross").where(F.col("n.RegionId") == F.col("r.Id")).select(F.col("n.Name").alias("Nation"), F.col("r.Name").alias("Region"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS Id, u.word, u.ordinal FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, CAST(unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS BIGINT) AS ordinal FROM part) u")
def cross_apply_split(spark, sf):
    return R.split(star(spark, sf)["Part"], "Type", " ", value="word", ordinal="ordinal").select("Id", "word", "ordinal")


@query(f"SELECT Id, unnest(CASE WHEN Tags IS NULL THEN [NULL] ELSE string_split(Tags, ',') END) AS tag FROM {_FIXTURE}")
def outer_apply_split(spark, sf):
    return R.split(fixture(spark, sf), "Tags", ",", outer=True, value="tag").select("Id", "tag")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, a.n, a.first_priority FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, min(o_orderpriority) AS first_priority FROM orders WHERE o_custkey = c_custkey) a ON true")
def apply_correlated_agg(spark, sf):
    ws = star(spark, sf, typed=True)
    per = ws["Order"].groupBy(F.col("CustomerId").alias("k")).agg(F.count(F.lit(1)).alias("n"), R.min_text("Priority", by_id()).alias("first_priority"))
    return ws["Customer"].join(per, F.col("Id") == F.col("k"), "left").select(*as_text("Id"), F.coalesce("n", F.lit(0)).alias("n"), "first_priority")


# grouping


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(spark, sf):
    return star(spark, sf)["Order"].groupBy(F.col("Status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT arg_min(Status, Id) AS status, count(*) AS n, count(DISTINCT Status) AS spellings FROM {_MIXED} GROUP BY upper(Status)")
def group_expr(spark, sf):
    o = mixed_status(star(spark, sf))
    return o.groupBy(S.fold("Status").alias("k")).agg(R.first_of("Status", by_id()).alias("status"), F.count(F.lit(1)).alias("n"), F.countDistinct("Status").alias("spellings")).drop("k")


@query("SELECT count(*) AS n, min(n_name) AS least FROM nation WHERE n_name = 'none such'")
def implicit_group_empty(spark, sf):
    return star(spark, sf)["Nation"].where(S.equal(F.col("Name"), "none such")).agg(F.count(F.lit(1)).alias("n"), R.min_text("Name", by_id()).alias("least"))


@query(f"SELECT Priority AS priority, arg_min(Status, (upper(Status), Id)) AS least, (list(Status ORDER BY upper(Status) DESC, Id))[1] AS most, count(CustomerId) AS n FROM {_MIXED} GROUP BY Priority")
def min_max_text(spark, sf):
    o = mixed_status(star(spark, sf))
    return o.groupBy(F.col("Priority").alias("priority")).agg(R.min_text("Status", by_id()).alias("least"), R.max_text("Status", by_id()).alias("most"), F.count("CustomerId").alias("n"))


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY upper(n_name), CAST(n_nationkey AS VARCHAR)) AS up, string_agg(n_name, '|' ORDER BY upper(n_name) DESC, CAST(n_nationkey AS VARCHAR)) AS down FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def string_agg_ordered(spark, sf):
    ws = star(spark, sf, typed=True)
    n, r = ws["Nation"].alias("n"), ws["Region"].alias("r")
    key, order = S.fold(F.col("n.Name")), [S.fold(F.col("n.Id").cast("string"))]
    joined = R.join(n, r, F.col("n.RegionId") == F.col("r.Id"))
    return joined.groupBy(F.col("r.Name").alias("region")).agg(R.string_agg(F.col("n.Name"), ",", [(key, True)], order).alias("up"), R.string_agg(F.col("n.Name"), "|", [(key, False)], order).alias("down"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS customer, string_agg(o_orderstatus, ',' ORDER BY o_orderkey DESC) AS latest, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY upper(o_orderpriority) DESC, o_orderkey) AS urgent_last FROM orders GROUP BY o_custkey")
def string_agg_integer_keys(spark, sf):
    """Texts ordered by integers downwards, and ties of text that integers break."""
    o = star(spark, sf, typed=True)["Order"]
    return o.groupBy("CustomerId").agg(R.string_agg("Status", ",", [(F.col("Id"), False)], [F.col("Id")]).alias("latest"), R.string_agg("Id", ",", [(S.fold("Priority"), False)], [F.col("Id")]).alias("urgent_last")).select(F.col("CustomerId").cast("string").alias("customer"), "latest", "urgent_last")


@query("SELECT CAST(o_custkey AS VARCHAR) AS customer, (list(s ORDER BY upper(s) DESC, o_orderkey))[1] AS most, (list(s ORDER BY upper(s), o_orderkey))[1] AS least FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s FROM orders) GROUP BY o_custkey")
def min_max_integer_ties(spark, sf):
    """Spellings of equal texts fall by integer ids, in which 9 comes before 10."""
    o = star(spark, sf, typed=True)["Order"].withColumn("s", F.when(F.col("Id") % 2 == 1, F.lower("Status")).otherwise(F.col("Status")))
    return o.groupBy("CustomerId").agg(R.max_text("s", [F.col("Id")]).alias("most"), R.min_text("s", [F.col("Id")]).alias("least")).select(F.col("CustomerId").cast("string").alias("customer"), "most", "least")


@query("SELECT c_mktsegment AS segment, max(upper(c_mktsegment)) AS label, count(*) AS n FROM customer GROUP BY c_mktsegment")
def grouped_stable_value(spark, sf):
    """An expression that is no group key but has one value in each group."""
    c = star(spark, sf)["Customer"]
    return c.groupBy(F.col("Segment").alias("segment")).agg(R.stable(S.upper("Segment"), by_id()).alias("label"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, r_name AS region, regexp_replace(n_name, left(r_name, 1), '<' || lower(r_name) || '>', 'gi') AS renamed FROM nation JOIN region ON n_regionkey = r_regionkey WHERE starts_with(upper(n_name), upper(left(r_name, 1))) OR contains(upper(n_name), '1')")
def like_expression(spark, sf):
    """LIKE and REPLACE with patterns and texts from columns."""
    ws = star(spark, sf, typed=True)
    n, r = ws["Nation"].alias("n"), ws["Region"].alias("r")
    first = S.left("r.Name", 1)
    hit = S.like("n.Name", S.concat(first, "%")) | S.like("n.Name", F.lit("%1%"))
    return R.join(n, r, (F.col("n.RegionId") == F.col("r.Id")) & hit).select(*as_text("n.Id"), F.col("r.Name").alias("region"), S.replace("n.Name", first, S.concat("<", S.lower("r.Name"), ">")).alias("renamed"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS v, n_name AS name FROM nation UNION ALL SELECT r_name, r_name FROM region")
def union_all_mixed_kinds(spark, sf):
    ws = star(spark, sf, typed=True)
    return R.union_all(ws["Nation"].select(F.col("Id").alias("v"), F.col("Name").alias("name")), ws["Region"].select("Name", F.col("Name").alias("again")))


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 5")
def having_via_derived(spark, sf):
    return star(spark, sf)["Part"].groupBy(F.col("Brand").alias("brand")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query(f"SELECT status, priority FROM (SELECT Status AS status, Priority AS priority, row_number() OVER (PARTITION BY upper(Status), upper(Priority) ORDER BY Id) AS r FROM {_MIXED}) WHERE r = 1")
def distinct_rows(spark, sf):
    o = mixed_status(star(spark, sf)).withColumnsRenamed({"Status": "status", "Priority": "priority"})
    return R.distinct(o, by_id(), ["status", "priority"])


@query("SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def union_all(spark, sf):
    ws = star(spark, sf)
    part = lambda n: ws[n].select(F.lit(n.lower()).alias("kind"), F.col("Name").alias("name"))
    return R.union_all(part("Nation"), part("Region"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY upper(o_orderpriority), CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS n FROM orders")
def row_number_partitioned(spark, sf):
    return star(spark, sf, typed=True)["Order"].select(*as_text("Id"), R.row_number([F.col("CustomerId")], [(S.fold("Priority"), True)], by_id()).alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, CAST(row_number() OVER (ORDER BY upper(o_orderpriority) DESC, o_orderdate, o_orderkey) AS BIGINT) AS n FROM orders")
def row_number_global(spark, sf):
    """Numbers over all orders, without a partition."""
    o = star(spark, sf, typed=True)["Order"]
    return ranges.row_numbers(o, [(S.fold("Priority"), False), (F.col("Date"), True)], [F.col("Id")], "n").select(*as_text("Id"), "n")


@query("SELECT customer, Id FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS Id, row_number() OVER (PARTITION BY o_custkey ORDER BY upper(o_orderpriority) DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM orders) WHERE n = 1")
def row_number_top1_derived(spark, sf):
    o = star(spark, sf, typed=True)["Order"].withColumn("n", R.row_number([F.col("CustomerId")], [(S.fold("Priority"), False)], by_id()))
    return o.where("n = 1").select(F.col("CustomerId").cast("string").alias("customer"), *as_text("Id"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation")
def scalar_subquery_corr(spark, sf):
    ws = star(spark, sf, typed=True)
    inner = ws["Region"].select(F.col("Id").alias("k"), F.col("Name").alias("v"))
    return R.scalar(ws["Nation"].withColumn("k", F.col("RegionId")), inner, ["k"], "v", "region").select(*as_text("Id"), "region")


@query("SELECT CAST(o.o_orderkey AS VARCHAR) AS Id, CAST((SELECT max(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderdate < o.o_orderdate) AS VARCHAR) AS last_key, (SELECT count(*) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderdate <= o.o_orderdate) AS so_far FROM orders o")
def scalar_subquery_below(spark, sf):
    """A customer's earlier orders: correlation by an equality and an order."""
    o = star(spark, sf, typed=True)["Order"].select("Id", "CustomerId", "Date")
    last = ranges.correlated(o, o, ["CustomerId"], F.col("Date"), "<", F.col("Date"), F.col("Id"), "max", "last_key")
    both = ranges.correlated(last, o, ["CustomerId"], F.col("Date"), "<=", F.col("Date"), F.lit(1), "count", "so_far")
    return both.select(*as_text("Id", "last_key"), "so_far")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, (SELECT max(o_totalprice) FROM orders WHERE o_totalprice <= 20 * c_acctbal) AS below, (SELECT min(o_totalprice) FROM orders WHERE o_totalprice > 20 * c_acctbal) AS above FROM customer")
def scalar_subquery_nearest(spark, sf):
    """The nearest prices below and above a number: correlation by an order alone."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("Id"), (20 * F.col("c_acctbal")).alias("x"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_totalprice")
    price, x = F.col("o_totalprice"), F.col("x")
    below = ranges.correlated(c, o, [], x, "<=", price, price, "max", "below")
    return ranges.correlated(below, o, [], x, ">", price, price, "min", "above").select("Id", "below", "above")


@query("WITH a AS (SELECT c_mktsegment AS s, c_nationkey AS n FROM customer), b AS (SELECT s, n, count(*) AS k FROM a GROUP BY s, n), c AS (SELECT s, max(k) AS most FROM b GROUP BY s) SELECT b.s AS segment, n_name AS nation, b.k AS customers FROM b JOIN c ON b.s = c.s AND b.k = c.most JOIN nation ON n_nationkey = b.n")
def cte_chain(spark, sf):
    ws = star(spark, sf, typed=True)
    b = ws["Customer"].groupBy(F.col("Segment").alias("s"), F.col("NationId").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    c = b.groupBy("s").agg(F.max("k").alias("k"))
    return b.join(c, ["s", "k"]).join(ws["Nation"], F.col("n") == F.col("Id")).select(F.col("s").alias("segment"), F.col("Name").alias("nation"), F.col("k").alias("customers"))


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS k, n_name AS path, CAST(0 AS BIGINT) AS level FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, path || '/' || n_name, level + 1 FROM t JOIN nation ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = k) SELECT CAST(k AS VARCHAR) AS Id, path, level FROM t")
def cte_recursive_path(spark, sf):
    n = star(spark, sf)["Nation"].select("Id", "Name", F.when(F.col("Id") != "0", F.floor((S.to_int("Id") - 1) / 3).cast("string")).alias("ParentId"))
    anchor = n.where("Id = '0'").select("Id", F.col("Name").alias("path"))
    member = lambda t: t.alias("t").join(n.alias("n"), F.col("n.ParentId") == F.col("t.Id")).select("n.Id", S.concat(F.col("t.path"), "/", F.col("n.Name")).alias("path"))
    return R.recursive(anchor, member, level="level")


# scalar functions


@query(f"SELECT Id, concat(coalesce(Name, ''), '-', coalesce(Tags, ''), '-', '1') AS c FROM {_FIXTURE}")
def concat_null(spark, sf):
    return fixture(spark, sf).select("Id", S.concat(F.col("Name"), "-", F.col("Tags"), "-", 1).alias("c"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS Id, lower(p_brand) AS lo, upper(p_name) AS up FROM part")
def upper_lower(spark, sf):
    return star(spark, sf)["Part"].select("Id", S.lower("Brand").alias("lo"), S.upper("Name").alias("up"))


@query(f"SELECT CAST(n AS BIGINT) AS n, trim(t, ' ') AS b, ltrim(t, ' ') AS l, rtrim(t, ' ') AS r FROM {_PIECES}")
def trim_family(spark, sf):
    return pieces(spark, sf).select("n", S.trim("t").alias("b"), S.trim("t", "left").alias("l"), S.trim("t", "right").alias("r"))


@query(f"SELECT CAST(n AS BIGINT) AS n, length(rtrim(t, ' ')) AS len FROM {_PIECES}")
def len_trailing(spark, sf):
    return pieces(spark, sf).select("n", S.length("t").alias("len"))


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN t IS NULL OR regexp_matches(t, '^\\s*$') THEN 1 ELSE 0 END AS BIGINT) AS blank FROM {_PIECES}")
def is_blank(spark, sf):
    return pieces(spark, sf).select("n", S.is_blank("t").alias("blank"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS Id, regexp_replace(p_type, 'ard', '$x', 'gi') AS t FROM part")
def replace_ci(spark, sf):
    return star(spark, sf)["Part"].select("Id", S.replace("Type", "ard", "$x").alias("t"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS Id, substr(p_name, 1, 2) AS a, substr(p_name, 1, 1) AS b, substr(p_name, 3, 4) AS c, '' AS d FROM part")
def substring_edges(spark, sf):
    return star(spark, sf)["Part"].select("Id", S.substring("Name", 0, 3).alias("a"), S.substring("Name", -1, 3).alias("b"), S.substring("Name", 3, 4).alias("c"), S.substring("Name", 900, 3).alias("d"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, left(c_name, 4) AS l, right(c_name, 5) AS r, left(c_name, 900) AS w FROM customer")
def left_right(spark, sf):
    return star(spark, sf)["Customer"].select("Id", S.left("Name", 4).alias("l"), S.right("Name", 5).alias("r"), S.left("Name", 900).alias("w"))


@query(f"SELECT Id, coalesce(Tags, RoleId, 'none') AS c, CASE WHEN upper(Name) = 'ALPHA' THEN NULL ELSE Name END AS n, CASE WHEN upper(RoleId) = 'R1' THEN 'yes' ELSE 'no' END AS i FROM {_FIXTURE}")
def coalesce_nullif_iif(spark, sf):
    return fixture(spark, sf).select("Id", S.coalesce(F.col("Tags"), F.col("RoleId"), "none").alias("c"), S.nullif(F.col("Name"), "ALPHA").alias("n"), S.iif(S.equal(F.col("RoleId"), "r1"), "yes", "no").alias("i"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, CASE WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS c FROM orders")
def case_searched(spark, sf):
    return star(spark, sf)["Order"].select("Id", S.case([(S.equal(F.col("Status"), "f"), "filled"), (S.like("Priority", "1%"), "urgent")]).alias("c"))


_NUMBERS = "(SELECT p_partkey AS n, CASE p_partkey % 9 WHEN 0 THEN ' ' || p_partkey || ' ' WHEN 1 THEN '+' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN '' WHEN 4 THEN CAST(2147483647 + p_partkey AS VARCHAR) WHEN 5 THEN CAST(-2147483648 + p_partkey AS VARCHAR) WHEN 6 THEN p_size || 'e3' WHEN 8 THEN repeat('9', 40) || p_size END AS t FROM part)"


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(TRY_CAST(CASE WHEN regexp_matches(t, '^\\s*[+-]?[0-9]+\\s*$') THEN trim(t) END AS INTEGER) AS BIGINT) AS v FROM {_NUMBERS}")
def try_convert(spark, sf):
    p = star(spark, sf, typed=True)["Part"]
    k, size, one = F.col("Id"), F.col("Size"), F.lit
    far = lambda n: (one(n).cast("long") + k).cast("string")
    t = _by_rest(k, 9, {0: F.concat(one(" "), k.cast("string"), one(" ")), 1: F.concat(one("+"), size), 2: F.concat(size, one(".5")), 3: one(""), 4: far(2147483647), 5: far(-2147483648), 6: F.concat(size, one("e3")), 8: F.concat(one("9" * 40), size)})
    return p.select(k.alias("n"), S.to_int(t).alias("v"))


# sources by name, parameters, conversions


def catalog_direction() -> Direction:
    """Regions and nations as a category tree, with a parameter in the names."""
    target = Model("Catalog", (Entity("Category", (Property("Name"),)), Entity("Item", (Property("Name"),), (Relationship("Category"),))))
    return Direction(
        target,
        transformations={
            "Item": lambda c: c.relation("Named").select(S.concat("item:", F.col("Id")).alias("Id"), F.col("Name"), S.concat("category:", F.col("RegionId")).alias("CategoryId")),
            "Category": lambda c: c.source("Region").select(S.concat("category:", F.col("Id")).alias("Id"), S.concat(F.col("Name"), ".", c.parameters["suffix"]).alias("Name")),
        },
        requirements={"regions": ("nation without region", lambda c: c.source("Nation").where(F.col("RegionId").isNull()).select("Id"))},
        relations={"Named": lambda c: c.source("Nation", "star").select("Id", S.upper("Name").alias("Name"), "RegionId")},
        parameters=("suffix",),
        roles=("star",),
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id FROM customer WHERE upper(c_mktsegment) = upper('AUTOmobile')")
def string_parameter(spark, sf):
    parameters = {"segment": "AUTOmobile"}
    return star(spark, sf)["Customer"].where(S.equal(F.col("Segment"), parameters["segment"])).select("Id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, upper(n_name) AS Name, CAST(n_regionkey AS VARCHAR) AS RegionId FROM nation")
def named_relation(spark, sf):
    return catalog_direction().context({"star": star(spark, sf)}, {"suffix": "x"}).relation("Named")


@query("SELECT 'open' AS requirement, 'order is open (Id=' || CAST(o_orderkey AS VARCHAR) || ', Status=' || o_orderstatus || ')' AS message FROM orders WHERE o_orderstatus = 'P'")
def requirement_violations(spark, sf):
    d = Direction(Model("None"), {}, {"open": ("order is open", lambda c: c.source("Order").where(S.equal(F.col("Status"), "p")).select("Id", "Status"))}, roles=("star",))
    return d.violations(d.context({"star": star(spark, sf)}))


@query("SELECT 'item:' || CAST(n_nationkey AS VARCHAR) AS Id, upper(n_name) AS Name, 'category:' || CAST(n_regionkey AS VARCHAR) AS CategoryId, r_name || '.v1' AS Category FROM nation JOIN region ON n_regionkey = r_regionkey")
def direction_target(spark, sf):
    out = catalog_direction().run({"star": star(spark, sf)}, {"suffix": "v1"})
    return out["Item"].join(out["Category"].select(F.col("Id").alias("CategoryId"), F.col("Name").alias("Category")), "CategoryId").select("Id", "Name", "CategoryId", "Category")


@query(
    "SELECT * FROM (VALUES ('SourceWorkspaceMissing', 'prices', CAST(NULL AS BIGINT)), ('SourceWorkspaceUnexpected', 'shop', NULL), ('ParameterValueMissing', 'suffix', NULL), ('ParameterValueUnexpected', 'prefix', NULL), ('SourceModelMismatch', 'orders', NULL)) AS v(code, subject, records)"
    " UNION ALL SELECT 'instance.relationship.orphan', 'orders:Order.CustomerId', count(*) FROM orders WHERE o_orderkey % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'instance.required.missing', 'orders:Order.Status', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0"
)
def direction_validation(spark, sf):
    """All that is wrong between a direction and what it is given: declarations, and the records of its sources."""
    d = Direction(Model("None"), {}, parameters=("suffix",), roles=("orders", "prices"), models={"orders": "Orders"})
    return d.validation({"orders": _checked_orders(spark, sf), "shop": _geography(spark, sf)}, {"prefix": "x"})


# record services


_STANDARD = "FROM part WHERE contains(upper(p_type), 'DARD') AND upper(p_brand) = 'BRAND#12'"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS Id, p_name AS Name, (SELECT count(*) {_STANDARD}) AS total {_STANDARD} ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 200")
def record_query_contains(spark, sf):
    total, rows = V.query_records(star(spark, sf)["Part"], [("type", "Contains", "dard"), ("Brand", "Equal", "brand#12")])
    return rows.select("Id", "Name", F.lit(total).cast("long").alias("total"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS total FROM orders WHERE o_custkey = 7 ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 3")
def record_query_role(spark, sf):
    """A relationship named by its role."""
    total, rows = V.query_records(star(spark, sf)["Order"], [("customer", "Equal", "7")], 3)
    return rows.select("Id", F.lit(total).cast("long").alias("total"))


@query("SELECT (SELECT count(*) FROM customer) AS n, c_name AS name FROM customer WHERE c_custkey = 12")
def count_and_point_read(spark, sf):
    c = star(spark, sf)["Customer"]
    return c.where(S.equal(F.col("Id"), "12")).select(F.col("Name").alias("name")).crossJoin(c.agg(F.count(F.lit(1)).alias("n")))  # one row by one row


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 10 OFFSET (SELECT count(*) - 10 FROM customer)")
def page_window(spark, sf):
    return V.page(star(spark, sf)["Customer"], 10**9, 10).select("Id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, o_orderdate::DATE::VARCHAR AS Date FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET (SELECT count(*) // 2 FROM orders)")
def page_window_middle(spark, sf):
    """A page from the middle of the orders."""
    o = star(spark, sf)["Order"]
    return V.page(o, o.count() // 2, 25).select("Id", "Date")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'CustomerId' AS member, 'Customer' AS entity, CAST(o_custkey AS VARCHAR) AS target FROM orders")
def relationship_list(spark, sf):
    return V.references(star(spark, sf), "Order").select("id", "member", "entity", "target")


def _part_workspace(spark, sf) -> Workspace:
    ws = star(spark, sf)
    e = ws.model.entity("Part")
    return Workspace(Model("Parts", (e,)), {"Part": ws["Part"].withColumn("Brand", F.when(F.col("Size") == "1", F.lit("")).otherwise(F.col("Brand"))).withColumn("Size", F.when(F.col("Size") != "2", F.col("Size")))})


_PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS Id, p_name AS Name, CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS Brand, p_type AS Type, CASE WHEN p_size <> 2 THEN CAST(p_size AS VARCHAR) END AS Size FROM part)"


def _profile_sql(columns: list[str]) -> str:
    part = "SELECT '{c}' AS property, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(CASE WHEN {c} = '' THEN 1 END) AS blanks, count(CASE WHEN {c} <> '' THEN 1 END) AS non_blank, count(DISTINCT {c}) AS distinct_non_null, count(DISTINCT CASE WHEN {c} <> '' THEN {c} END) AS distinct_non_blank FROM " + _PARTS
    return " UNION ALL ".join(part.format(c=c) for c in columns)


@query(_profile_sql(["Name", "Brand", "Type", "Size"]))
def property_profile(spark, sf):
    return V.profile(_part_workspace(spark, sf)).select("property", "rows", "non_null", "nulls", "blanks", "non_blank", "distinct_non_null", "distinct_non_blank")


@query("SELECT 'Customer' AS entity, 'Name' AS property, CAST(1.0 AS DOUBLE) AS score FROM customer HAVING count(*) = count(DISTINCT c_name) UNION ALL SELECT 'Customer', 'Segment', 1.0 FROM customer HAVING count(*) = count(DISTINCT c_mktsegment) UNION ALL SELECT 'Nation', 'Name', 1.0 FROM nation HAVING count(*) = count(DISTINCT n_name)")
def business_keys(spark, sf):
    ws = star(spark, sf)
    some = Workspace(Model("Some", tuple(ws.model.entity(n) for n in ("Customer", "Nation"))), {n: ws[n] for n in ("Customer", "Nation")})
    return V.business_keys(some)


def _plain_orders(spark, sf) -> Workspace:
    """Orders whose customer is a property yet, a third of them unknown."""
    ws = star(spark, sf)
    orders = Entity("Order", (Property("Status"), Property("CustomerId"), Property("PayerCustomerId", False)))
    payer = F.when(F.col("Id").cast("long") % 3 == 0, F.concat(F.lit("x"), F.col("CustomerId"))).otherwise(F.col("CustomerId"))
    return Workspace(Model("Plain", (Entity("Customer", (Property("Name"),)), orders)), {"Customer": ws["Customer"].select("Id", "Name"), "Order": ws["Order"].select("Id", "Status", "CustomerId", payer.alias("PayerCustomerId"))})


_PAYER = "CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END"


@query(
    f"""WITH v AS (SELECT 'CustomerId' AS property, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'PayerCustomerId', {_PAYER} FROM orders),
g AS (SELECT property, v, count(*) AS n, EXISTS (SELECT 1 FROM customer WHERE CAST(c_custkey AS VARCHAR) = v) AS hit FROM v GROUP BY property, v),
a AS (SELECT property, CAST(sum(n) AS BIGINT) AS source_rows, count(*) AS source_distinct, CAST(coalesce(sum(n) FILTER (WHERE hit), 0) AS BIGINT) AS matched_rows, count(*) FILTER (WHERE hit) AS matched_distinct, coalesce((list(v ORDER BY v) FILTER (WHERE NOT hit))[1:5], []) AS bad FROM g GROUP BY property),
b AS (SELECT *, CAST(CASE WHEN matched_distinct < source_distinct THEN 1 ELSE 0 END + CASE WHEN source_rows > source_distinct THEN 0 ELSE 1 END AS INTEGER) AS blockers FROM a)
SELECT property, source_rows, source_distinct, matched_rows, matched_distinct, array_to_string(bad, ',') AS unmatched_sample, blockers, round(0.40 + 0.35 * matched_rows / source_rows + 0.15 + CASE WHEN source_rows > source_distinct THEN 0.10 ELSE 0 END - 0.12 * blockers, 3) AS score FROM b"""
)
def fk_suggestion(spark, sf):
    return V.lookup_suggestions(_plain_orders(spark, sf)).select("property", "source_rows", "source_distinct", "matched_rows", "matched_distinct", "unmatched_sample", "blockers", "score")


# diff, merge, synchronization


def _two(spark, sf) -> tuple[Workspace, Workspace]:
    """Customers without every seventh, and with every fifth in another segment and every eleventh without a name."""
    ws = star(spark, sf)
    model = Model("Two", (Entity("Customer", (Property("Name", False), Property("Segment"))),))
    left = ws["Customer"].where(F.col("Id").cast("long") % 7 != 0).select("Id", "Name", "Segment")
    right = ws["Customer"].where(F.col("Id").cast("long") % 9 != 0).select("Id", F.when(F.col("Id").cast("long") % 11 != 0, F.col("Name")).alias("Name"), F.when(F.col("Id").cast("long") % 5 == 0, F.lit("NEW")).otherwise(F.col("Segment")).alias("Segment"))
    return Workspace(model, {"Customer": left}), Workspace(model, {"Customer": right})


@query("SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 = 0 UNION ALL SELECT 'right', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 9 <> 0")
def equal_diff_rows(spark, sf):
    return V.diff_rows(*_two(spark, sf)).select("side", "id")


_BOTH = "FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0"


@query(
    f"SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS id, 'Segment' AS member, c_mktsegment AS value {_BOTH} AND c_custkey % 5 = 0 UNION ALL SELECT 'right', CAST(c_custkey AS VARCHAR), 'Segment', 'NEW' {_BOTH} AND c_custkey % 5 = 0 UNION ALL SELECT 'left', CAST(c_custkey AS VARCHAR), 'Name', c_name {_BOTH} AND c_custkey % 11 = 0"
)
def equal_diff_properties(spark, sf):
    return V.diff_cells(*_two(spark, sf)).select("side", "id", "member", "value")


@query("SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS id, 'Title' AS member, c_name AS value FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 9 <> 0")
def aligned_diff(spark, sf):
    left, right = _two(spark, sf)
    model = Model("Aligned", (Entity("Person", (Property("Title", False),)),))
    view = lambda w: V.aligned(w, model, {"Customer": "Person"}, {("Customer", "Name"): "Title"})
    return V.diff_cells(view(left), view(right)).select("side", "id", "member", "value")


@query(
    f"SELECT 'ModelLeftPropertyInstanceNotInRight' AS entity, 'Customer:' || CAST(c_custkey AS VARCHAR) || ':Segment' AS Id, c_mktsegment AS value {_BOTH} AND c_custkey % 5 = 0"
    f" UNION ALL SELECT 'ModelLeftPropertyInstanceNotInRight', 'Customer:' || CAST(c_custkey AS VARCHAR) || ':Name', c_name {_BOTH} AND c_custkey % 11 = 0"
    f" UNION ALL SELECT 'ModelRightPropertyInstanceNotInLeft', 'Customer:' || CAST(c_custkey AS VARCHAR) || ':Segment', 'NEW' {_BOTH} AND c_custkey % 5 = 0"
    " UNION ALL SELECT CASE WHEN c_custkey % 9 = 0 THEN 'ModelLeftEntityInstanceNotInRight' ELSE 'ModelRightEntityInstanceNotInLeft' END, 'Customer:' || CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE (c_custkey % 7 = 0) <> (c_custkey % 9 = 0)"
)
def diff_workspace(spark, sf):
    """What a diff stored as a workspace says that the sides lack, with the values of cells."""
    ws, out = D.equal_diff(*_two(spark, sf)), None
    for side, other in (("Left", "Right"), ("Right", "Left")):
        rows = ws[f"Model{side}EntityInstanceNotIn{other}"].select("Id", F.lit(None).cast("string").alias("value"), F.lit(f"Model{side}EntityInstanceNotIn{other}").alias("entity"))
        values = ws[f"Model{side}PropertyInstance"].select("Id", F.col("Value").alias("value"))
        cells = ws[f"Model{side}PropertyInstanceNotIn{other}"].select("Id").join(values, "Id").withColumn("entity", F.lit(f"Model{side}PropertyInstanceNotIn{other}"))
        part = rows.unionByName(cells)
        out = part if out is None else out.unionByName(part)
    return out.select("entity", "Id", "value")


_NEW = "FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 9 <> 0"


@query(
    "SELECT 'DeleteRecord' AS operation, CAST(c_custkey AS VARCHAR) AS id, NULL AS member, NULL AS value FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 = 0"
    f" UNION ALL SELECT 'InsertRecord', CAST(c_custkey AS VARCHAR), NULL, NULL {_NEW} UNION ALL SELECT 'SetProperty', CAST(c_custkey AS VARCHAR), 'Name', c_name {_NEW} AND c_custkey % 11 <> 0"
    f" UNION ALL SELECT 'SetProperty', CAST(c_custkey AS VARCHAR), 'Segment', CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END {_NEW}"
    f" UNION ALL SELECT 'SetProperty', CAST(c_custkey AS VARCHAR), 'Segment', 'NEW' {_BOTH} AND c_custkey % 5 = 0 UNION ALL SELECT 'ClearProperty', CAST(c_custkey AS VARCHAR), 'Name', NULL {_BOTH} AND c_custkey % 11 = 0"
)
def sync_plan(spark, sf):
    return V.sync_plan(*_two(spark, sf), "Customer").select("operation", "id", "member", "value")


_RIGHT = "SELECT CAST(c_custkey AS VARCHAR) AS Id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS Name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS Segment FROM customer WHERE c_custkey % 9 <> 0"


@query(_RIGHT)
def sync_plan_applied(spark, sf):
    """What the plan makes of the one workspace is the other."""
    left, right = _two(spark, sf)
    return V.synchronized(left, V.sync_plan(left, right, "Customer"), "Customer")


@query(_RIGHT)
def instance_merge(spark, sf):
    left, right = _two(spark, sf)
    return V.merge(left, left, right)["Customer"].select("Id", "Name", "Segment")


@query("SELECT 'Customer' AS entity, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 9 = 0 THEN 'Id' WHEN c_custkey % 11 = 0 THEN 'Name' ELSE 'Segment' END AS member FROM customer WHERE ((c_custkey % 7 = 0) <> (c_custkey % 9 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 9 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 11 = 0))) ORDER BY id LIMIT 1")
def workspace_difference(spark, sf):
    """The first cell in which two workspaces differ."""
    return first_difference(*_two(spark, sf)).select("entity", "id", "member")


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS k, CAST(0 AS BIGINT) AS level FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, level + 1 FROM t JOIN nation ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = k) SELECT CAST(k AS VARCHAR) AS Id, level FROM t")
def record_order(spark, sf):
    """The order in which records of a tree can be made."""
    n = star(spark, sf)["Nation"].select("Id", F.when(F.col("Id") != "0", F.floor((S.to_int("Id") - 1) / 3).cast("string")).alias("ParentId"))
    return V.record_levels(n, "ParentId")


_LEVELS = [("Region", "r_regionkey", "region", 0), ("Nation", "n_nationkey", "nation JOIN region ON n_regionkey = r_regionkey", 1), ("Customer", "c_custkey", "customer JOIN nation ON c_nationkey = n_nationkey", 2), ("Supplier", "s_suppkey", "supplier JOIN nation ON s_nationkey = n_nationkey", 2), ("Part", "p_partkey", "part", 0), ("Order", "o_orderkey", "orders JOIN customer ON o_custkey = c_custkey", 3), ("Event", "event_id", "events", 0)]


@query(" UNION ALL ".join(f"SELECT '{n}' AS entity, CAST({k} AS VARCHAR) AS Id, CAST({d} AS BIGINT) AS level FROM {t}" for n, k, t, d in _LEVELS) + " UNION ALL SELECT 'Line', concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')), 4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def record_levels(spark, sf):
    """The level of every record of the star, so that each comes after those that it refers to."""
    return ordering.record_levels(star(spark, sf))


def _trade(spark, sf, side: str) -> Workspace:
    """Nations and customers, as one of two states: some of either are missing, renamed, changed, or recommended by others."""
    ws, k = star(spark, sf), F.col("Id").cast("long")
    model = Model("Trade", (Entity("Customer", (Property("Name", False), Property("Segment")), (Relationship("Nation"), Relationship("Customer", "Friend", False))), Entity("Nation", (Property("Name"),))))
    nations = ws["Nation"].where(k % 7 != (3 if side == "left" else 5)).select(F.concat(F.lit("n"), "Id").alias("Id"), "Name")
    c = ws["Customer"].where(F.col("NationId").cast("long") % 7 != (3 if side == "left" else 5)).where(k % 5 != (1 if side == "left" else 2))
    other = k + (10 if side == "left" else 5)
    friend = F.when((k % 4 == 0) | (k % 4 == (1 if side == "left" else 2)), F.concat(F.lit("c"), other.cast("string")))
    spelt = F.concat(F.when(k % 11 == 0, F.lit("C")).otherwise(F.lit("c")), "Id") if side == "right" else F.concat(F.lit("c"), "Id")
    name = F.when(k % 3 != 0, F.col("Name")) if side == "left" else F.when(k % 6 != 0, F.col("Name"))
    segment = F.when(k % 8 == 0, F.lit("NEW")).otherwise(F.col("Segment")) if side == "right" else F.col("Segment")
    customers = c.select(spelt.alias("Id"), name.alias("Name"), segment.alias("Segment"), F.concat(F.lit("n"), "NationId").alias("NationId"), friend.alias("_f"))
    ids = customers.select(F.lower("Id").alias("_f"), F.lit(True).alias("_known"))
    whole = customers.join(ids, "_f", "left").select("Id", "Name", "Segment", "NationId", F.when(F.col("_known"), F.col("_f")).alias("FriendId"))
    return Workspace(model, {"Customer": whole, "Nation": nations})


def _trade_sql(name: str, gone: int, drop: int, step: int, more: int, spelt: str, names: int, segment: str) -> str:
    base = f"SELECT c_custkey AS k, {spelt} || c_custkey AS Id, CASE WHEN c_custkey % {names} <> 0 THEN c_name END AS Name, {segment} AS Segment, 'n' || c_nationkey AS NationId, CASE WHEN c_custkey % 4 IN (0, {more}) THEN c_custkey + {step} END AS f FROM customer WHERE c_nationkey % 7 <> {gone} AND c_custkey % 5 <> {drop}"
    return f"{name}b AS ({base}), {name}c AS (SELECT a.k, a.Id, a.Name, a.Segment, a.NationId, CASE WHEN b.k IS NOT NULL THEN 'c' || a.f END AS FriendId FROM {name}b a LEFT JOIN {name}b b ON a.f = b.k), {name}n AS (SELECT 'n' || n_nationkey AS Id, n_name AS Name FROM nation WHERE n_nationkey % 7 <> {gone})"


_SIDES = _trade_sql("l", 3, 1, 10, 1, "'c'", 3, "c_mktsegment") + ", " + _trade_sql("r", 5, 2, 5, 2, "CASE WHEN c_custkey % 11 = 0 THEN 'C' ELSE 'c' END", 6, "CASE WHEN c_custkey % 8 = 0 THEN 'NEW' ELSE c_mktsegment END")


def _plan_sql() -> str:
    p = lambda stage, level, op, entity, e, i, member="NULL", value="NULL", cells="NULL", m=0: f"SELECT {stage} AS stage, {level} AS level, '{op}' AS operation, '{entity}' AS entity, {e} AS e, {i} AS id, {member} AS member, {value} AS value, {cells} AS cells, {m} AS m FROM "
    both, new, gone = "lc a JOIN rc b ON a.k = b.k", "rc b ANTI JOIN lc a ON a.k = b.k", "lc a ANTI JOIN rc b ON a.k = b.k"
    filled = "array_to_string(list_filter([CASE WHEN b.Name IS NOT NULL THEN 'Name=' || b.Name END, 'NationId=' || b.NationId, 'Segment=' || b.Segment], lambda x: x IS NOT NULL), '|')"
    steps = [p(1, 0, "RenameRecord", "Customer", 0, "a.Id", "'Id'", "b.Id") + f"{both} WHERE a.Id <> b.Id"]
    steps += [p(2, 1, "InsertRecord", "Customer", 0, "b.Id", cells=filled) + f"{new} WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.Id = b.NationId)", p(2, 0, "InsertRecord", "Customer", 0, "b.Id", cells=filled) + f"{new} WHERE EXISTS (SELECT 1 FROM ln WHERE ln.Id = b.NationId)", p(2, 0, "InsertRecord", "Nation", 1, "b.Id", cells="'Name=' || b.Name") + "rn b ANTI JOIN ln a ON a.Id = b.Id"]
    for m, (c, kind) in enumerate((("Name", "Property"), ("Segment", "Property"), ("NationId", "Relationship"), ("FriendId", "Relationship")), 1):
        steps.append(p(3, 0, f"Set{kind}", "Customer", 0, "b.Id", f"'{c}'", f"b.{c}", m=m) + f"{both} WHERE b.{c} IS NOT NULL AND b.{c} IS DISTINCT FROM a.{c}")
        steps.append(p(3, 0, f"Clear{kind}", "Customer", 0, "b.Id", f"'{c}'", m=m) + f"{both} WHERE b.{c} IS NULL AND a.{c} IS NOT NULL")
    steps += [p(4, 0, "SetRelationship", "Customer", 0, "b.Id", "'FriendId'", "b.FriendId", m=4) + f"{new} WHERE b.FriendId IS NOT NULL", p(5, 0, "ClearRelationship", "Customer", 0, "a.Id", "'FriendId'", m=4) + f"{gone} WHERE a.FriendId IS NOT NULL"]
    steps += [p(6, 1, "DeleteRecord", "Customer", 0, "a.Id") + f"{gone} WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.Id = a.NationId)", p(6, 0, "DeleteRecord", "Customer", 0, "a.Id") + f"{gone} WHERE EXISTS (SELECT 1 FROM rn WHERE rn.Id = a.NationId)", p(6, 0, "DeleteRecord", "Nation", 1, "a.Id") + "ln a ANTI JOIN rn b ON a.Id = b.Id"]
    return f"WITH {_SIDES}, steps AS ({' UNION ALL '.join(steps)}) SELECT CAST(row_number() OVER (ORDER BY stage, CASE WHEN stage = 6 THEN -level ELSE level END, e, upper(id), m) AS BIGINT) AS step, operation, entity, id, member, value, cells FROM steps"


@query(_plan_sql())
def sync_plan_ordered(spark, sf):
    """Every operation between two states of customers and nations, numbered so that references stay whole."""
    plan = ordering.ordered_plan(_trade(spark, sf, "left"), _trade(spark, sf, "right"))
    cells = F.array_join(F.array_sort(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return plan.select("step", "operation", "entity", "id", "member", "value", cells.alias("cells"))


@query(f"WITH {_SIDES} SELECT 'Customer' AS entity, Id, Name, Segment, NationId, FriendId FROM rc UNION ALL SELECT 'Nation', Id, Name, NULL, NULL, NULL FROM rn")
def sync_plan_ordered_applied(spark, sf):
    """The ordered plan applied stage by stage, the state checked after each."""
    left, right = _trade(spark, sf, "left"), _trade(spark, sf, "right")
    out, none = ordering.applied(left, ordering.ordered_plan(left, right)), F.lit(None).cast("string")
    nations = out["Nation"].select(F.lit("Nation").alias("entity"), "Id", "Name", none.alias("Segment"), none.alias("NationId"), none.alias("FriendId"))
    return out["Customer"].select(F.lit("Customer").alias("entity"), "Id", "Name", "Segment", "NationId", "FriendId").unionByName(nations)


def _persons(spark, sf) -> tuple[Workspace, Workspace]:
    """The right side of _two() under another model."""
    left, right = _two(spark, sf)
    model = Model("Persons", (Entity("Person", (Property("Title", False), Property("Kind"), Property("Extra"))), Entity("Loose")))
    people = right["Customer"].select("Id", F.col("Name").alias("Title"), F.col("Segment").alias("Kind"), F.lit("x").alias("Extra"))
    return left, Workspace(model, {"Person": people, "Loose": people.select("Id")})


def _aligned_diff(spark, sf) -> tuple[Workspace, Workspace]:
    left, right = _persons(spark, sf)
    maps = D.alignment(left.model, right.model, {"Customer": "Person"}, {("Customer", "Name"): "Title", ("Customer", "Segment"): "Kind"}, spark)
    return left, D.aligned_diff(left, right, maps)


@query(
    f"SELECT 'ModelLeftPropertyInstanceNotInRight' AS entity, 'Customer:Person:' || CAST(c_custkey AS VARCHAR) || ':Customer:Segment' AS Id, c_mktsegment AS value {_BOTH} AND c_custkey % 5 = 0"
    f" UNION ALL SELECT 'ModelLeftPropertyInstanceNotInRight', 'Customer:Person:' || CAST(c_custkey AS VARCHAR) || ':Customer:Name', c_name {_BOTH} AND c_custkey % 11 = 0"
    f" UNION ALL SELECT 'ModelRightPropertyInstanceNotInLeft', 'Customer:Person:' || CAST(c_custkey AS VARCHAR) || ':Customer:Segment', 'NEW' {_BOTH} AND c_custkey % 5 = 0"
    " UNION ALL SELECT CASE WHEN c_custkey % 9 = 0 THEN 'ModelLeftEntityInstanceNotInRight' ELSE 'ModelRightEntityInstanceNotInLeft' END, 'Customer:Person:' || CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE (c_custkey % 7 = 0) <> (c_custkey % 9 = 0)"
)
def aligned_diff_workspace(spark, sf):
    """What the sides of two models lack of each other, as a diff through an alignment stores it."""
    (_, ws), out = _aligned_diff(spark, sf), None
    for side, other in (("Left", "Right"), ("Right", "Left")):
        rows = ws[f"Model{side}EntityInstanceNotIn{other}"].select("Id", F.lit(None).cast("string").alias("value"), F.lit(f"Model{side}EntityInstanceNotIn{other}").alias("entity"))
        values = ws[f"Model{side}PropertyInstance"].select("Id", F.col("Value").alias("value"))
        part = rows.unionByName(ws[f"Model{side}PropertyInstanceNotIn{other}"].select("Id").join(values, "Id").withColumn("entity", F.lit(f"Model{side}PropertyInstanceNotIn{other}")))
        out = part if out is None else out.unionByName(part)
    return out.select("entity", "Id", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS Name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS Segment FROM customer WHERE c_custkey % 9 <> 0")
def aligned_merge(spark, sf):
    """What a diff through an alignment makes of its left side."""
    left, diff = _aligned_diff(spark, sf)
    return D.merge_aligned(left, diff)["Customer"]


# files


def _geography(spark, sf) -> Workspace:
    ws = star(spark, sf)
    return Workspace(Model("Geo", tuple(ws.model.entity(n) for n in ("Region", "Nation"))), {n: ws[n] for n in ("Region", "Nation")})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, n_name AS Name, CAST(n_regionkey AS VARCHAR) AS RegionId FROM nation")
def xml_round_trip(spark, sf):
    """A workspace published as XML, model and records, and read again."""
    version = files.publish_xml(_geography(spark, sf), f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}")
    return files.read_published(spark, version)["Nation"]


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, c_name AS Name, CASE WHEN c_custkey = 7 THEN 'changed' ELSE c_mktsegment END AS Segment, CAST(c_nationkey AS VARCHAR) AS NationId FROM customer")
def xml_shards(spark, sf):
    """A workspace published twice as XML shards; the second version lists what has not changed again, and is read."""
    ws, path = star(spark, sf), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    names = ("Region", "Nation", "Customer")
    some = Workspace(Model("Geo", tuple(ws.model.entity(n) for n in names)), {n: ws[n] for n in names})
    first = shards.publish(some, path, "")
    changed = some.with_data("Customer", some["Customer"].withColumn("Segment", F.when(F.col("Id") == "7", F.lit("changed")).otherwise(F.col("Segment"))))
    shards.publish(changed, path, first.fingerprint)
    return shards.opened(spark, path, verify=True)[0]["Customer"]


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, c_name AS Name, c_mktsegment AS Segment, CAST(c_nationkey AS VARCHAR) AS NationId FROM customer")
def csv_round_trip(spark, sf):
    """An entity exported as CSV, read again and imported."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.export_csv(star(spark, sf), "Customer", path)
    entity, rows = files.import_csv(files.read_csv(spark, path), "Customer")
    return rows.select("Id", "Name", "Segment", "NationId") if all(p.required for p in entity.properties) else rows


@query("SELECT 'Nation' AS entity, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Person', count(*) FROM customer WHERE c_custkey % 7 <> 0")
def workspace_merge(spark, sf):
    ws = star(spark, sf)
    a = Workspace(Model("A", (ws.model.entity("Region"), ws.model.entity("Nation"))), {n: ws[n] for n in ("Region", "Nation")})
    b = O.rename_entity("Customer", "Person")(_two(spark, sf)[0])
    both = V.combine("Both", [a, b])
    out = None
    for e in both.model.entities:
        part = both[e.name].agg(F.lit(e.name).alias("entity"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out.select("entity", "n")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'insert' ELSE 'set' END AS action, 'Segment' AS member, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 9 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0) UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN 'insert' ELSE 'clear' END, 'Name', CASE WHEN c_custkey % 11 <> 0 THEN c_name END FROM customer WHERE c_custkey % 9 <> 0 AND ((c_custkey % 7 = 0 AND c_custkey % 11 <> 0) OR (c_custkey % 7 <> 0 AND c_custkey % 11 = 0))")
def csv_merge_plan(spark, sf):
    left, right = _two(spark, sf)
    return files.merge_plan(left["Customer"], right["Customer"]).select("id", "action", "member", "value")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, CASE WHEN n_nationkey < 3 THEN 'b' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS Name FROM nation UNION ALL SELECT CAST(max(n_nationkey) + 1 AS VARCHAR), 'new' FROM nation")
def bulk_upsert(spark, sf):
    n = star(spark, sf)["Nation"].select("Id", "Name")
    rows = [(str(i), f"{c}{i}", 10 * k + i) for k, c in enumerate("ab") for i in range(3)] + [(None, "new", 99), ("1", None, 98)]
    return files.upsert(n, R.values(spark, ["Id", "Name", "ord"], rows).drop("_row"), "ord", auto_id=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, c_name AS Name, CASE WHEN c_custkey % 3 = 0 THEN 'by id' WHEN c_custkey % 5 = 0 THEN 'BY ' || lower(c_name) ELSE c_mktsegment END AS Segment FROM customer UNION ALL SELECT 'x' || CAST(c_custkey AS VARCHAR), 'new ' || c_name, 'by id' FROM customer WHERE c_custkey % 100 = 1")
def bulk_upsert_key(spark, sf):
    """Customers named by Id, known or new, or else by their name in any case, of which there is one."""
    c = star(spark, sf)["Customer"].select("Id", "Name", "Segment")
    k, none = F.col("Id").cast("long"), F.lit(None).cast("string")
    by_id = c.where(k % 3 == 0).select(F.concat(F.lit(" "), "Id").alias("Id"), none.alias("Name"), F.lit("by id").alias("Segment"))
    by_name = c.where((k % 5 == 0) & (k % 3 != 0)).select(none.alias("Id"), F.concat(F.lower("Name"), F.lit(" ")).alias("Name"), F.concat(F.lit("BY "), F.lower("Name")).alias("Segment"))
    new = c.where(k % 100 == 1).select(F.concat(F.lit("x"), "Id").alias("Id"), F.concat(F.lit("new "), "Name").alias("Name"), F.lit("by id").alias("Segment"))
    rows = by_id.unionByName(by_name).unionByName(new).withColumn("ord", F.monotonically_increasing_id())
    out = files.upsert(c, rows, "ord", ["Name"])
    # a key's spelling is a cell like others
    return out.join(c.select("Id", F.col("Name").alias("_n")), "Id", "left").select("Id", F.coalesce("_n", "Name").alias("Name"), "Segment")


_AUTO = "(SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 100000000 + o_orderkey * 3 END AS g FROM orders WHERE o_orderkey % 2 = 1)"


@query(f"WITH r AS (SELECT ord, g, count(*) FILTER (WHERE g IS NULL) OVER (ORDER BY ord) AS c FROM {_AUTO}), s AS (SELECT ord, g, c, max(CASE WHEN g IS NOT NULL THEN g - c END) OVER (ORDER BY ord) AS s FROM r), n AS (SELECT coalesce(g, greatest((SELECT max(c_custkey) FROM customer), coalesce(s, 0)) + c) AS id, ord FROM s) SELECT CAST(id AS VARCHAR) AS Id, 'order ' || max(ord) AS Name FROM n GROUP BY id UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer")
def bulk_upsert_auto(spark, sf):
    """Orders as new customers: some with ids of their own, the others with the next number at their place."""
    c = star(spark, sf)["Customer"].select("Id", "Name")
    o = star(spark, sf, typed=True)["Order"].where(F.col("Id") % 2 == 1)
    rows = o.select(F.when(F.col("Id") % 7 == 0, (100000000 + F.col("Id") * 3).cast("string")).alias("Id"), F.concat(F.lit("order "), "Id").alias("Name"), F.col("Id").alias("ord"))
    return files.upsert(c, rows, "ord", auto_id=True)


def _import_rows(spark, sf) -> tuple[Workspace, DataFrame]:
    """Customers with optional sponsors, and rows for some of them and for new ones, as a CSV file would bring them."""
    ws, k = star(spark, sf), F.col("Id").cast("long")
    model = Model("Import", (Entity("Nation", (Property("Name"),)), Entity("Customer", (Property("Name"), Property("Segment", False)), (Relationship("Nation"), Relationship("Customer", "Sponsor", False)))))
    old = ws["Customer"].where(k % 4 != 0).select("Id", "Name", "Segment", "NationId", F.lit(None).cast("string").alias("SponsorId"))
    rows = ws["Customer"].where(k % 3 != 0).select("Id", "Name", F.when(k % 5 != 0, F.lit("NEW")).alias("segment"), "NationId", F.when(k % 2 == 0, F.when(k > 4, (k - 4).cast("string"))).alias("SponsorId"))
    there = rows.select(F.col("Id").alias("SponsorId"), F.lit(True).alias("_ok")).unionByName(old.select("Id", F.lit(True)).toDF("SponsorId", "_ok")).distinct()
    rows = rows.join(there, "SponsorId", "left").select("Id", "Name", "segment", "NationId", F.when(F.col("_ok"), F.col("SponsorId")).alias("SponsorId"))
    return Workspace(model, {"Nation": ws["Nation"].select("Id", "Name"), "Customer": old}), rows


_IMPORT = "i0 AS (SELECT c_custkey AS k, c_name AS Name, CASE WHEN c_custkey % 5 <> 0 THEN 'NEW' END AS Segment, CAST(c_nationkey AS VARCHAR) AS NationId, CASE WHEN c_custkey % 2 = 0 AND c_custkey > 4 AND NOT ((c_custkey - 4) % 3 = 0 AND (c_custkey - 4) % 4 = 0) THEN c_custkey - 4 END AS sk FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT *, k % 4 = 0 AS fresh, CAST(sk AS VARCHAR) AS SponsorId, coalesce(sk % 4 = 0, false) AS late, CAST(k AS VARCHAR) AS id FROM i0)"


def _import_sql() -> str:
    p = lambda op, late, place, member="NULL", value="NULL", cells="NULL": f"SELECT {late} AS late, {place} AS place, '{op}' AS operation, id, {member} AS member, {value} AS value, {cells} AS cells FROM i WHERE "
    filled = "array_to_string(list_filter(['Name=' || Name, 'NationId=' || NationId, CASE WHEN Segment IS NOT NULL THEN 'Segment=' || Segment END], lambda x: x IS NOT NULL), '|')"
    steps = [p("InsertRecord", "false", 0, cells=filled) + "fresh", p("SetProperty", "false", 1, "'Name'", "Name") + "NOT fresh", p("SetProperty", "false", 2, "'Segment'", "Segment") + "NOT fresh AND Segment IS NOT NULL", p("ClearProperty", "false", 2, "'Segment'") + "NOT fresh AND Segment IS NULL"]
    steps += [p("SetRelationship", "false", 3, "'NationId'", "NationId") + "NOT fresh", p("SetRelationship", "late", 4, "'SponsorId'", "SponsorId") + "SponsorId IS NOT NULL", p("ClearRelationship", "false", 4, "'SponsorId'") + "NOT fresh AND SponsorId IS NULL"]
    return f"WITH {_IMPORT}, steps AS ({' UNION ALL '.join(steps)}) SELECT CAST(row_number() OVER (ORDER BY late, id, place) AS BIGINT) AS step, operation, id, member, value, cells FROM steps"


@query(_import_sql())
def csv_import_plan(spark, sf):
    """Rows brought into an entity that is there: inserts, cells, and last the references to records that are only coming."""
    ws, rows = _import_rows(spark, sf)
    cells = F.array_join(F.array_sort(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return imports.import_plan(ws, "Customer", rows).select("step", "operation", "id", "member", "value", cells.alias("cells"))


@query(f"WITH {_IMPORT} SELECT id AS Id, Name, Segment, NationId, SponsorId FROM i UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0")
def csv_import_applied(spark, sf):
    ws, rows = _import_rows(spark, sf)
    return imports.imported(ws, "Customer", imports.import_plan(ws, "Customer", rows))["Customer"]


@query("SELECT CAST(1 AS BIGINT) AS step, 'AddEntity' AS operation, NULL AS id, NULL AS member, NULL AS value UNION ALL SELECT 2, 'AddProperty', NULL, 'Name', 'true' UNION ALL SELECT 3, 'AddProperty', NULL, 'Segment', CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) = 0 THEN 'true' ELSE 'false' END UNION ALL SELECT 3 + row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)), 'InsertRecord', CAST(c_custkey AS VARCHAR), NULL, NULL FROM customer")
def csv_import_new_entity(spark, sf):
    rows = star(spark, sf)["Customer"].select("Id", "Name", F.when(F.col("Id").cast("long") % 5 != 0, F.col("Segment")).alias("Segment"))
    return imports.import_plan(Workspace(Model("Empty")), "Client", rows).select("step", "operation", "id", "member", "value")


# operations


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, CASE WHEN n_regionkey = 1 THEN 'one' ELSE CAST(n_regionkey AS VARCHAR) END AS RegionId FROM nation")
def rename_record(spark, sf):
    ws = star(spark, sf)
    some = Workspace(Model("Geo", tuple(ws.model.entity(n) for n in ("Region", "Nation"))), {n: ws[n] for n in ("Region", "Nation")})
    return O.execute(some, [O.rename_record("Region", "1", "one")])["Nation"].select("Id", "RegionId")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Id, CAST(c_custkey AS VARCHAR) AS CustomerId FROM orders JOIN customer ON o_custkey = c_custkey")
def property_to_relationship(spark, sf):
    ws = _plain_orders(spark, sf)
    return O.property_to_relationship("Order", "CustomerId", "Customer")(ws)["Order"].select("Id", "CustomerId")


def _checked_orders(spark, sf) -> Workspace:
    """Orders of which some lack a status, and some refer to nobody."""
    ws = star(spark, sf)
    model = Model("Checked", (Entity("Customer", (Property("Name"),)), Entity("Order", (Property("Status"),), (Relationship("Customer"),))))
    third = F.col("Id").cast("long") % 3 == 0
    orders = ws["Order"].select("Id", F.when(F.col("Status") != "P", F.col("Status")).alias("Status"), F.when(third, F.concat(F.lit("x"), "CustomerId")).otherwise(F.col("CustomerId")).alias("CustomerId"))
    return Workspace(model, {"Customer": ws["Customer"].select("Id", "Name"), "Order": orders})


@query("SELECT 'instance.relationship.orphan' AS code, 'CustomerId' AS member, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'instance.required.missing', 'Status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'")
def instance_validation(spark, sf):
    return _checked_orders(spark, sf).issues().select("code", "member", "id")


# model operations


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, c_name AS Title, CASE WHEN c_custkey = 5 THEN 'changed' ELSE 'none' END AS Remark, CASE WHEN c_custkey = 5 THEN '3' ELSE CAST(c_nationkey AS VARCHAR) END AS HomeId FROM customer WHERE c_custkey <> 9")
def model_operations(spark, sf):
    """Entities, properties and relationships renamed, added and removed; the rows follow."""
    ws = star(spark, sf)
    names = ("Region", "Nation", "Customer")
    some = Workspace(Model("Geo", tuple(ws.model.entity(n) for n in names)), {n: ws[n] for n in names})
    steps = [
        O.rename_entity("Customer", "Person"),
        O.rename_property("Person", "Name", "Title"),
        O.remove_property("Person", "Segment"),
        O.add_property("Person", Property("Remark"), "none"),
        O.set_property("Person", "5", "Remark", "changed"),
        O.rename_relationship("Person", "NationId", "Home"),
        O.set_relationship("Person", "5", "HomeId", "3"),
        O.delete_record("Person", "9"),
    ]
    return O.execute(some, steps, batch=True)["Person"].select("Id", "Title", "Remark", "HomeId")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS Id, CASE WHEN n_regionkey = 4 THEN 'new' ELSE CAST(n_regionkey AS VARCHAR) END AS RegionId FROM nation")
def batch_operations(spark, sf):
    """A batch passes through states that would fault one by one: the region goes before its nations have another."""
    ws = _geography(spark, sf)
    moved = [O.set_relationship("Nation", str(i), "RegionId", "new") for i in range(25) if i % 5 == 4]
    return O.execute(ws, [O.delete_record("Region", "4"), *moved, O.insert_record("Region", "new", Name="New")], batch=True)["Nation"].select("Id", "RegionId")


# graph and search


_KEYS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Line": "lineitem", "Event": "events"}
_LINKS = [("Nation", "Region", "n_regionkey"), ("Customer", "Nation", "c_nationkey"), ("Supplier", "Nation", "s_nationkey"), ("Order", "Customer", "o_custkey"), ("Line", "Order", "l_orderkey"), ("Line", "Part", "l_partkey"), ("Line", "Supplier", "l_suppkey")]
_GRAPH = "WITH RECURSIVE n AS (" + " UNION ALL ".join(f"SELECT '{n}' AS x FROM {t} HAVING count(*) > 0" for n, t in _KEYS.items()) + "), e AS (" + " UNION ALL ".join(f"SELECT '{s}' AS s, '{t}' AS t, '{t}Id' AS m, count({c}) AS r FROM {_KEYS[s]} HAVING count({c}) > 0" for s, t, c in _LINKS) + ")"
_DEGREES = "SELECT x AS entity, (SELECT count(DISTINCT s) FROM e WHERE t = x) AS in_degree, (SELECT count(DISTINCT t) FROM e WHERE s = x) AS out_degree FROM n"


@query(f"{_GRAPH} {_DEGREES}")
def graph_degree(spark, sf):
    """Which entities' records refer to each other."""
    return graph.degrees(*graph.record_graph(star(spark, sf)))


@query(f"{_GRAPH} SELECT * FROM ({_DEGREES}) ORDER BY out_degree DESC, upper(entity) LIMIT 3")
def graph_top_degrees(spark, sf):
    return graph.top_degrees(*graph.record_graph(star(spark, sf)), "out_degree", 3)


@query(f"{_GRAPH} SELECT s AS entity, m AS member, r AS references FROM e WHERE t = 'Nation'")
def graph_inbound(spark, sf):
    return graph.inbound(graph.record_graph(star(spark, sf))[1], "nation")


@query(
    f"""{_GRAPH}, both_ways AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
walk AS (SELECT s, t, CAST(1 AS BIGINT) AS d FROM e UNION ALL SELECT w.s, e.t, d + 1 FROM walk w JOIN e ON w.t = e.s),
reach AS (SELECT x AS a, x AS b FROM n UNION SELECT r.a, t FROM reach r JOIN both_ways ON r.b = s)
SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT least) FROM (SELECT min(b) AS least FROM reach GROUP BY a)) AS components, (SELECT max(d) FROM walk) AS max_depth,
(SELECT string_agg(x, ',' ORDER BY x) FROM n WHERE x NOT IN (SELECT t FROM e)) AS roots, (SELECT string_agg(x, ',' ORDER BY x) FROM n WHERE x NOT IN (SELECT s FROM e)) AS sinks, (SELECT count(DISTINCT (s, t)) / (SELECT count(*) FROM n) FROM e) AS average_in"""
)
def graph_measures(spark, sf):
    out = graph.measures(*graph.record_graph(star(spark, sf)))
    return out.select("entities", "edges", "components", "max_depth", "roots", "sinks", "average_in")


_PAGES = "(SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' UNION SELECT DISTINCT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0 UNION SELECT n_name, n_name FROM nation WHERE n_nationkey % 6 = 1)"


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM {_PAGES} AS v(s, t)), r AS (SELECT s AS a, t AS b FROM e UNION SELECT r.a, e.t FROM r JOIN e ON r.b = e.s), c AS (SELECT x.a AS name, min(x.b) AS loop FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),"
    " i AS (SELECT e.s, e.t, p.loop FROM e JOIN c p ON e.s = p.name JOIN c q ON e.t = q.name AND p.loop = q.loop), w AS (SELECT loop, t AS place, loop || '>' || t AS path, 1 AS d FROM i WHERE s = loop UNION ALL SELECT w.loop, i.t, w.path || '>' || i.t, d + 1 FROM w JOIN i ON w.loop = i.loop AND w.place = i.s WHERE w.place <> w.loop AND d < 4)"
    " SELECT loop, arg_min(path, (d, path)) AS sample FROM w WHERE place = loop GROUP BY loop"
)
def graph_cycle_samples(spark, sf):
    """A shortest path around each loop of a graph of segments, priorities and nations that orders make."""
    ws = star(spark, sf, typed=True)
    o, c = ws["Order"].where(S.equal(F.col("Status"), "p")).alias("o"), ws["Customer"].alias("c")
    met = o.join(c, F.col("o.CustomerId") == F.col("c.Id")).select(F.col("o.Id").alias("k"), "Segment", "Priority").distinct()
    there = met.select(F.col("Segment").alias("source"), F.col("Priority").alias("target"))
    back = met.where("k % 7 = 0").select(F.col("Priority").alias("source"), F.col("Segment").alias("target"))
    own = ws["Nation"].where("Id % 6 = 1").select(F.col("Name").alias("source"), F.col("Name").alias("target"))
    return graph.loop_samples(there.unionByName(back).unionByName(own))


@query("SELECT Id, Name, CAST(CASE WHEN upper(Name) = 'NATION_1' THEN 0 WHEN starts_with(upper(Name), 'NATION_1') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM (SELECT CAST(n_nationkey AS VARCHAR) AS Id, n_name AS Name FROM nation) WHERE contains(upper(Name), 'NATION_1') ORDER BY rank, upper(Name), Name LIMIT 25")
def ranked_search(spark, sf):
    return V.search(star(spark, sf)["Nation"].select("Id", "Name"), "nation_1", "Name")


@query("SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS BIGINT) AS rank, count(*) AS orders, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, count(CASE WHEN o_orderpriority LIKE '1-%' THEN 1 END) AS urgent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def flagship(spark, sf):
    """Orders by market segment: join, CASE, ordered text aggregate and row numbers in one query."""
    ws = star(spark, sf, typed=True)
    o, c = ws["Order"].alias("o"), ws["Customer"].alias("c")
    each = R.join(o, c, F.col("o.CustomerId") == F.col("c.Id")).groupBy(F.col("c.Segment").alias("segment"), F.col("o.Status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count(S.case([(S.like("o.Priority", "1-%"), "u")])).alias("u"))
    total = each.groupBy("segment").agg(F.sum("n").alias("orders"), R.string_agg("status", ",", [(S.fold("status"), True)], [F.col("status")]).alias("statuses"), F.sum("u").alias("urgent"))
    return ranges.row_numbers(total, [(F.col("orders"), False)], [F.col("segment")], "rank")


@query("SELECT c_mktsegment AS segment, n_name AS nation, l_returnflag AS flag, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority <> '5-LOW' GROUP BY c_mktsegment, n_name, l_returnflag")
def lines_by_segment(spark, sf):
    """A four-way join over all line items, grouped by text in any case."""
    ws = star(spark, sf, typed=True)
    li, o, c, n = (ws[x].alias(x[0].lower()) for x in ("Line", "Order", "Customer", "Nation"))
    kept = o.where(S.compare(F.col("o.Priority"), "<>", "5-low"))
    small = R.join(c, n, F.col("c.NationId") == F.col("n.Id")).select(F.col("c.Id").alias("k"), F.col("c.Segment").alias("segment"), F.col("n.Name").alias("nation"))
    joined = R.join(li, kept, F.col("l.OrderId") == F.col("o.Id")).select(F.col("o.CustomerId").alias("k"), F.col("l.ReturnFlag").alias("flag")).join(small, "k")
    return joined.groupBy("segment", "nation", "flag").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def events_by_type(spark, sf):
    return star(spark, sf)["Event"].groupBy(F.col("Type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("UserId").alias("users"))
