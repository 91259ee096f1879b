"""Workspaces over the benchmark tables, Parquet directories, rows and JDBC."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Entity, Model, Property, Relationship, Workspace
from ..operators.ordering import differences

_P, _R = Property, Relationship
STAR = Model(
    "Star",
    (
        Entity("Region", (_P("Name"),)),
        Entity("Nation", (_P("Name"),), (_R("Region"),)),
        Entity("Customer", (_P("Name"), _P("Segment")), (_R("Nation"),)),
        Entity("Supplier", (_P("Name"),), (_R("Nation"),)),
        Entity("Part", (_P("Name"), _P("Brand"), _P("Type"), _P("Size"))),
        Entity("Order", (_P("Status"), _P("Priority"), _P("Date")), (_R("Customer"),)),
        Entity("Line", (_P("Number"), _P("ReturnFlag"), _P("Status")), (_R("Order"), _R("Part"), _R("Supplier"))),
        Entity("Event", (_P("Type"), _P("UserId"), _P("Props", False))),
    ),
)
# table and column of each member
_COLUMNS = {
    "Region": ("region", {"Id": "r_regionkey", "Name": "r_name"}),
    "Nation": ("nation", {"Id": "n_nationkey", "Name": "n_name", "RegionId": "n_regionkey"}),
    "Customer": ("customer", {"Id": "c_custkey", "Name": "c_name", "Segment": "c_mktsegment", "NationId": "c_nationkey"}),
    "Supplier": ("supplier", {"Id": "s_suppkey", "Name": "s_name", "NationId": "s_nationkey"}),
    "Part": ("part", {"Id": "p_partkey", "Name": "p_name", "Brand": "p_brand", "Type": "p_type", "Size": "p_size"}),
    "Order": ("orders", {"Id": "o_orderkey", "Status": "o_orderstatus", "Priority": "o_orderpriority", "Date": "o_orderdate", "CustomerId": "o_custkey"}),
    "Line": ("lineitem", {"Id": "", "Number": "l_linenumber", "ReturnFlag": "l_returnflag", "Status": "l_linestatus", "OrderId": "l_orderkey", "PartId": "l_partkey", "SupplierId": "l_suppkey"}),
    "Event": ("events", {"Id": "event_id", "Type": "event_type", "UserId": "user_id", "Props": "props"}),
}
LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def star(spark: SparkSession, sf_dir: str, typed: bool = False) -> Workspace:
    """The benchmark's star tables as records; lazy: a query reads the columns it uses.

    Every member is text, as the record model has it. typed leaves ids and references the integers that they are, so
    that filters on them reach the files and joins shuffle and compare integers; as_text() gives their text form.
    """
    data = {}
    for e in STAR.entities:
        table, names = _COLUMNS[e.name]
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        links = {"Id", *[r.column for r in e.relationships]} if typed else set()
        cell = lambda c, m, links=links: F.date_format(c, "yyyy-MM-dd") if c == "o_orderdate" else F.col(c).cast("long") if m in links else F.col(c).cast("string")
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in LINE_ID], F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")) if e.name == "Line" else None
        data[e.name] = df.select(*[(key if key is not None and m == "Id" else cell(c, m)).alias(m) for m, c in names.items()])
    return Workspace(STAR, data)


def as_text(*names: str) -> list[Column]:
    """Ids and references in their text form, named after the last part of each name."""
    return [F.col(n).cast("string").alias(n.rpartition(".")[2]) for n in names]


def from_rows(spark: SparkSession, model: Model, rows: Mapping[str, list[dict]]) -> Workspace:
    data = {}
    for e in model.entities:
        cells = [tuple(None if r.get(c) is None else str(r[c]) for c in e.columns) for r in rows.get(e.name, [])]
        data[e.name] = spark.createDataFrame(cells, ", ".join(f"`{c}` string" for c in e.columns))
    return Workspace(model, data)


def from_parquet(spark: SparkSession, model: Model, path: str) -> Workspace:
    return Workspace(model, {e.name: spark.read.parquet(f"{path}/{e.name}").select(*[F.col(c).cast("string").alias(c) for c in e.columns]) for e in model.entities})


def to_parquet(ws: Workspace, path: str) -> None:
    for e in ws.model.entities:
        ws[e.name].select(*e.columns).write.mode("overwrite").parquet(f"{path}/{e.name}")


def _name(*parts: str) -> str:
    """A name in standard SQL's quotes, with the schema if there is one."""
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts if p)


def from_jdbc(spark: SparkSession, model: Model, url: str, schema: str = "dbo", split: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> Workspace:
    """One table an entity; filters, column choices, limits and counts are pushed to the database.

    split gives, for entities worth more than one connection, a numeric column, its lower and upper bound and the
    number of parts to read.
    """

    def read(e: Entity) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=_name(schema, e.name), **options)
        if split and e.name in split:
            column, low, high, parts = split[e.name]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()

    return Workspace(model, {e.name: read(e).select(*[F.col(c).cast("string").alias(c) for c in e.columns]) for e in model.entities})


def bounded_jdbc(spark: SparkSession, url: str, entity: Entity, conditions: Sequence[tuple[str, str, str]], limit: int, schema: str = "dbo", **options: str) -> tuple[int, DataFrame]:
    """(number of matches, the first limit rows by Id) of a query that the database answers.

    Conditions are (member, Equal or Contains, value), all of which hold in any case; null counts as ''. Values are
    quoted, names are the entity's own.
    """
    known = {c.upper(): c for c in entity.columns} | {(r.role or r.entity).upper(): r.column for r in entity.relationships}
    tests = []
    for name, op, value in conditions:
        if name.upper() not in known:
            raise ValueError(f"RecordQueryFieldNotFound: {name}")
        if op not in ("Equal", "Contains"):
            raise ValueError(f"RecordQueryOperatorInvalid: {op}")
        key, plain = f"UPPER(COALESCE({_name(known[name.upper()])}, ''))", value.replace("'", "''")
        like = re.sub(r"([%_!\[])", r"!\1", plain)
        tests.append(f"{key} = UPPER('{plain}')" if op == "Equal" else f"{key} LIKE UPPER('%{like}%') ESCAPE '!'")
    where = " WHERE " + " AND ".join(tests) if tests else ""
    table, key = _name(schema, entity.name), _name("Id")
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    total = ask(f"SELECT COUNT(*) AS n FROM {table}{where}").first()[0]
    rows = ask(f"SELECT {', '.join(map(_name, entity.columns))} FROM {table}{where} ORDER BY UPPER({key}), {key} OFFSET 0 ROWS FETCH NEXT {int(limit)} ROWS ONLY")
    return total, rows.toDF(*entity.columns)


def to_jdbc(ws: Workspace, url: str, schema: str = "dbo", mode: str = "append", verify: bool = True, **options: str) -> None:
    """One table an entity. verify reads what was written back and faults where rows are missing or differ."""
    for e in ws.model.entities:
        table, rows = _name(schema, e.name), ws[e.name].select(*e.columns)
        rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
        if verify:
            back = ws[e.name].sparkSession.read.format("jdbc").options(url=url, dbtable=table, **options).load().toDF(*e.columns)
            lost = differences(rows, back).where("_n > 0") if mode == "append" else first_difference(Workspace(Model("w", (e,)), {e.name: rows}), Workspace(Model("w", (e,)), {e.name: back}))
            if not lost.isEmpty():
                raise RuntimeError(f"WriteVerificationFailed: {e.name}")


def model_difference(left: Model, right: Model) -> str | None:
    """The first difference of two models' contracts by name, whatever the order of members: a text, or None."""
    if left.name != right.name:
        return f"ModelName: {left.name}, {right.name}"
    if len(left.entities) != len(right.entities):
        return f"EntityCount: {len(left.entities)}, {len(right.entities)}"
    theirs = {e.name.upper(): e for e in right.entities}
    for a in left.entities:
        b = theirs.get(a.name.upper())
        if b is None or b.name != a.name:
            return f"{'EntityMissing' if b is None else 'EntitySpelling'}: {a.name}"
        for kind, ours, other in (("Property", a.properties, b.properties), ("Relationship", a.relationships, b.relationships)):
            if len(ours) != len(other):
                return f"{kind}Count: {a.name}, {len(ours)}, {len(other)}"
            name = lambda m: m.name if isinstance(m, Property) else m.column
            known = {name(m).upper(): m for m in other}
            for m in ours:
                if known.get(name(m).upper()) != m:
                    return f"{kind}{'Differs' if name(m).upper() in known else 'Missing'}: {a.name}.{name(m)}"
    return None


def first_difference(left: Workspace, right: Workspace) -> DataFrame:
    """(entity, id, member, left, right): the first cell by entity, id and member that two workspaces of one model do not share.

    No row if they hold the same; models that differ fault with the first difference. A record that one side lacks
    differs in its Id. References compare in any case, all else as it is. Of records that share an id all count, so
    that one written twice, or in place of another, shows.
    """
    if (apart := model_difference(left.model, right.model)) is not None:
        raise ValueError(f"WorkspaceModelMismatch: {apart}")
    out = None
    for place, e in enumerate(left.model.entities):
        links = {r.column for r in e.relationships}
        cells = F.array(*[F.struct(F.col(c).alias("v"), (F.upper(c) if c in links else F.col(c)).alias("key")) for c in e.columns])
        flat = lambda ws, side, cells=cells, e=e: ws[e.name].select(F.col("Id").alias("id"), F.lit(side).alias("side"), F.posexplode(cells).alias("at", "c"))
        both = flat(left, 1).unionByName(flat(right, -1))
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("c.v")))
        # sums of digests tell multisets of values apart
        apart = both.groupBy("id", "at").agg(of(1).alias("left"), of(-1).alias("right"), F.sum("side").alias("n"), F.sum(F.xxhash64("c.key").cast("decimal(38,0)") * F.col("side")).alias("h")).where("n <> 0 OR h <> 0")
        one = apart.select(F.lit(place).alias("_e"), F.lit(e.name).alias("entity"), "id", F.element_at(F.array(*map(F.lit, e.columns)), F.col("at") + 1).alias("member"), F.col("at").alias("_a"), "left", "right").orderBy("id", "_a").limit(1)
        out = one if out is None else out.union(one)
    return out.orderBy("_e").limit(1).drop("_e", "_a")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()
