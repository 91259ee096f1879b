"""Plans of operations that bring a table, such as a CSV file, into a workspace: a new entity, or records of one that is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Entity, Model, Property, Workspace
from ..operators.ordering import record_levels
from ..operators.ranges import kept, numbered
from .files import ImportFault, import_csv

_PLAN = ["step", "operation", "entity", "id", "member", "value", "cells"]


def import_plan(target: Workspace, entity: str, df: DataFrame) -> DataFrame:
    """(step, operation, entity, id, member, value, cells): how to bring df, with ids in a column Id, into an entity.

    A new entity is added with its properties, optional where a cell is missing, then its records. Records of an entity
    that is there are inserted or have each imported member set, or cleared where the cell is blank; cells has the
    properties and required references of a new one. All go by id in any case, new ones after those of their kind
    that they require. References to records of the same kind that are only about to be inserted come last. Faults
    start with a code and name the first row: unknown columns, required members blank or, for new records, not among
    the columns; what is wrong with ids is told by import_csv().
    """
    known = next((e for e in target.model.entities if e.name.upper() == entity.upper()), None)
    made, rows = import_csv(df, entity)
    return _new_entity(made, rows) if known is None else _existing(target, known, made, rows)


def _step(operation: str, i: Column | None = None, member=None, value: Column | None = None, place: int = 0, late: bool = False) -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(F.lit(late).alias("late"), F.lit(operation).alias("operation"), text(i).alias("id"), text(member).alias("member"), text(value).alias("value"), F.lit(place).alias("place"))


def _cells(names: dict[str, str]) -> Column:
    """A map of the filled cells: member to the column of the import that holds it."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{c}`") for c in names.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _new_entity(made: Entity, rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    head = [("AddEntity", None, None)] + [("AddProperty", p.name, str(p.required).lower()) for p in made.properties]
    first = spark.createDataFrame([(i + 1, op, made.name, None, member, value, None) for i, (op, member, value) in enumerate(head)], "step long, operation string, entity string, id string, member string, value string, cells map<string,string>")
    placed = numbered(rows.select("Id", _cells({p.name: p.name for p in made.properties}).alias("cells")), [F.upper("Id").asc(), F.asc("Id")], "n")
    none = F.lit(None).cast("string")
    return first.unionByName(placed.select((F.col("n") + len(head)).alias("step"), F.lit("InsertRecord").alias("operation"), F.lit(made.name).alias("entity"), F.col("Id").alias("id"), none.alias("member"), none.alias("value"), "cells"))


def _preflight(e: Entity, given: dict[str, str], rows: DataFrame) -> None:
    """One aggregate over rows(Id, _new, ...): the first fault by id, and in it by member."""
    members = [(p.name, "Property", p.required) for p in e.properties] + [(r.column, "Relationship", r.required) for r in e.relationships]
    needed = [(n, kind) for n, kind, required in members if required]
    tests = [F.when(F.col(f"`{given[n]}`").isNull(), F.struct(F.lit(f"ImportRequired{kind}Blank").alias("code"), F.lit(n).alias("member"))) for n, kind in needed if n in given]
    tests += [F.when(F.col("_new"), F.struct(F.lit(f"ImportRequired{kind}ColumnMissing").alias("code"), F.lit(n).alias("member"))) for kind in ("Property", "Relationship") for n, k in sorted(needed, key=lambda x: x[0].upper()) if k == kind and n not in given]
    if not tests:
        return
    fault = F.coalesce(*tests)
    first = rows.agg(F.min_by(F.struct("Id", fault.alias("f")), F.when(fault.isNotNull(), F.struct(F.upper("Id"), "Id"))).alias("x")).first().x
    if first is not None:
        raise ImportFault(f"{first.f.code}: {e.name}.{first.f.member}, row '{first.Id}'")


def _existing(target: Workspace, e: Entity, made: Entity, rows: DataFrame) -> DataFrame:
    mine = {c.upper(): c for c in e.columns}
    unknown = [p.name for p in made.properties if p.name.upper() not in mine]
    if unknown:
        raise ImportFault(f"ImportColumnUnknown: {e.name}.{unknown[0]}")
    given = {mine[p.name.upper()]: p.name for p in made.properties}
    there = target[e.name].select(F.upper("Id").alias("_k"), F.lit(True).alias("_there"))
    at = kept(rows.withColumn("_k", F.upper("Id")).join(there, "_k", "left").withColumn("_new", F.col("_there").isNull()).drop("_there"), "import")
    _preflight(e, given, at)
    links = {r.column: r for r in e.relationships}
    inserted = {m: c for m, c in given.items() if m not in links or links[m].required}
    # levels of new records by the required references to their own kind
    own = [r for r in e.relationships if r.required and r.entity.upper() == e.name.upper() and r.column in given]
    level = F.lit(0).cast("long")
    if own:
        alone = Model("Import", (Entity(e.name, (), tuple(own)),))
        new = at.where("_new").select("Id", *[F.col(f"`{given[r.column]}`").alias(r.column) for r in own])
        present = Workspace(alone, {e.name: target[e.name].select("Id", *[r.column for r in own])})
        depth = record_levels(Workspace(alone, {e.name: new}), present=present).select(F.upper("Id").alias("_k"), F.col("level").alias("_level"))
        at, level = at.join(depth, "_k", "left"), F.coalesce("_level", F.lit(0))
    # targets of the same kind that are new come last
    fresh = at.where("_new").select(F.col("_k").alias("_t"), F.lit(True).alias("_coming"))
    for i, r in enumerate(e.relationships):
        if r.column in given and r.entity.upper() == e.name.upper():
            at = at.join(fresh.select(F.col("_t").alias(f"_t{i}"), F.col("_coming").alias(f"_late{i}")), F.upper(F.col(f"`{given[r.column]}`")) == F.col(f"_t{i}"), "left")
    late = {r.column: F.coalesce(F.col(f"_late{i}"), F.lit(False)) for i, r in enumerate(e.relationships) if r.column in given and r.entity.upper() == e.name.upper()}
    steps = [F.when(F.col("_new"), _step("InsertRecord", F.col("Id")))]
    for place, (m, c) in enumerate(given.items(), 1):
        v, kind = F.col(f"`{c}`"), "Relationship" if m in links else "Property"
        optional_link = m in links and not links[m].required
        sets = ~F.col("_new") | F.lit(optional_link)
        soon = F.when(v.isNotNull() & sets, _step(f"Set{kind}", F.col("Id"), m, v, place))
        if m in late:
            soon = F.when(v.isNotNull() & sets & late[m], _step(f"Set{kind}", F.col("Id"), m, v, place, late=True)).when(v.isNotNull() & sets, _step(f"Set{kind}", F.col("Id"), m, v, place))
        steps.append(soon.when(v.isNull() & ~F.col("_new"), _step(f"Clear{kind}", F.col("Id"), m, place=place)))
    flat = at.select("_k", level.alias("_level"), _cells(inserted).alias("_cells"), F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("_k", "_level", "s.*", F.when(F.col("s.operation") == "InsertRecord", F.col("_cells")).alias("cells"))
    placed = numbered(flat, [F.asc(c) for c in ("late", "_level", "_k", "place")], "step")
    return placed.withColumn("entity", F.lit(e.name)).select(*_PLAN)


def imported(target: Workspace, entity: str, plan: DataFrame) -> Workspace:
    """target after a plan of import_plan(); the steps of a record and member are one at most, so they are applied together."""
    e = next((x for x in target.model.entities if x.name.upper() == entity.upper()), None)
    if e is None:
        added = [r for r in plan.where("operation = 'AddProperty'").orderBy("step").collect()]  # a row for each property
        e = Entity(entity, tuple(Property(r.member, r.value == "true") for r in added))
        new = plan.where("operation = 'InsertRecord'").select(F.col("id").alias("Id"), *[F.col("cells")[c].alias(c) for c in e.columns[1:]])
        return Workspace(Model(target.model.name, (*target.model.entities, e)), {**target.data, entity: new})
    new = plan.where("operation = 'InsertRecord'").select(F.col("id").alias("Id"), *[F.col("cells")[c].alias(c) for c in e.columns[1:]])
    told = plan.where(F.col("member").isNotNull()).groupBy(F.upper("id").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("_c"))
    met = target[e.name].select(*e.columns).unionByName(new).withColumn("_k", F.upper("Id")).join(told, "_k", "left")
    said = lambda c: F.coalesce(F.map_contains_key("_c", F.lit(c)), F.lit(False))
    return target.with_data(e.name, met.select("Id", *[F.when(said(c), F.col("_c")[c]).otherwise(F.col(c)).alias(c) for c in e.columns[1:]]))
