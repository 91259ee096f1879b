"""Services over workspaces: record queries, pages, profiles, suggestions, diff and merge, graph measures, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fold
from ..model import Entity, Model, Relationship, Workspace, dependency_order
from . import ordering, ranges

# record queries


def _matches(df: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> Column:
    test = F.lit(True)
    for name, op, value in conditions:
        key = fold(F.coalesce(F.col(f"`{name}`"), F.lit("")))
        if op not in ("Equal", "Contains"):
            raise ValueError(f"RecordQueryOperatorInvalid: {op}")
        test &= key == fold(F.lit(value)) if op == "Equal" else key.contains(fold(F.lit(value)))
    return test


def query_records(df: DataFrame, conditions: Sequence[tuple[str, str, str]], limit: int = 200) -> tuple[int, DataFrame]:
    """(number of matches, the first limit of them by Id): every (field, Equal or Contains, value) holds in any case; null counts as ''.

    A field is a column, or the role of a relationship, whose column is the role and "Id"; names in any case.
    """
    known = {c.upper(): c for c in df.columns}
    named = [(known.get(n.upper()) or known.get(n.upper() + "ID") or n, op, v) for n, op, v in conditions]
    found = df.where(_matches(df, named))
    return found.count(), found.orderBy(fold("Id"), "Id").limit(limit)


def page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """size rows by Id from offset, which is held between 0 and the last full page's start."""
    return ranges.page(df, [fold("Id"), F.col("Id")], offset, size)


def references(ws: Workspace, entity: str, record_id: str | None = None) -> DataFrame:
    """(id, member, entity, target) of the references that go out from a record, or from all."""
    e = ws.model.entity(entity)
    df = ws[e.name] if record_id is None else ws[e.name].where(F.upper("Id") == record_id.upper())
    pairs = [F.struct(F.lit(r.column).alias("member"), F.lit(r.entity).alias("entity"), F.col(r.column).alias("target")) for r in e.relationships]
    out = df.select(F.col("Id").alias("id"), F.explode(F.array(*pairs)).alias("r")).select("id", "r.*")
    return out.where(F.col("target").isNotNull())


# profiles and suggestions


def profile(ws: Workspace, with_id: bool = False) -> DataFrame:
    """One row for each property: counts of rows, nulls, blanks ('') and distinct values, compared as they are.

    One pass over each entity. Distinct counts are exact: values are first grouped within tasks, then across them.
    """
    out = None
    for e in ws.model.entities:
        members = ([("Id", True)] if with_id else []) + [(p.name, p.required) for p in e.properties]
        if not members:
            continue
        cells = F.array(*[F.struct(F.lit(n).alias("property"), F.lit(q).alias("required"), F.col(n).alias("v")) for n, q in members])
        flat = ws[e.name].select(F.explode(cells).alias("c")).select("c.*").groupBy("property", "required", "v").agg(F.count(F.lit(1)).alias("n"))
        known, filled = F.col("v").isNotNull(), F.col("v") != ""
        count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
        one = flat.groupBy("property", "required").agg(
            F.sum("n").alias("rows"),
            count(known).alias("non_null"),
            count(~known).alias("nulls"),
            count(F.col("v") == "").alias("blanks"),
            count(filled).alias("non_blank"),
            F.count(F.when(known, 1)).alias("distinct_non_null"),
            F.count(F.when(filled, 1)).alias("distinct_non_blank"),
        )
        one = one.select(F.lit(e.name).alias("entity"), "*", (F.col("distinct_non_null") == F.col("non_null")).alias("unique_non_null"), (F.col("distinct_non_blank") == F.col("non_blank")).alias("unique_non_blank"))
        out = one if out is None else out.unionByName(one)
    return out


def _rounded(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def business_keys(ws: Workspace) -> DataFrame:
    """(entity, property, score) of properties whose values, in two rows or more, are all different."""
    p = profile(ws).where((F.col("rows") >= 2) & (F.col("non_null") > 0) & F.col("unique_non_null"))
    give = lambda test, points: F.when(test, points).otherwise(0.0)
    score = F.lit(0.55) + give(F.col("nulls") == 0, 0.20) + give(F.col("blanks") == 0, 0.15) + give(F.col("required"), 0.05) + give(F.col("rows") >= 5, 0.05)
    return p.select("entity", "property", _rounded(score).alias("score"))


def _named_like_references(ws: Workspace) -> list[tuple]:
    """(entity, property, target entity, role, weak) of properties named <Entity>Id, or ending so."""
    out = []
    for e in ws.model.entities:
        for p in e.properties:
            for t in ws.model.entities:
                tail = t.name + "Id"
                if t.name.upper() != e.name.upper() and p.name.upper() != "ID" and p.name.upper().endswith(tail.upper()):
                    weak = p.name.upper() != tail.upper()
                    out.append((e, p, t, p.name[:-2] if weak else "", weak))
    return out


def lookup_suggestions(ws: Workspace) -> DataFrame | None:
    """Properties that look like references: named <Entity>Id, or ending so (weak, with a role).

    For each: how many rows and distinct values of the property are ids of the entity, up to five that are not, and a
    score. Only candidate properties and the ids of their targets are read, each entity once; values are counted
    before they meet, all candidates in one join, and what a score needs comes out of those counts. None without a
    candidate by name.
    """
    found = _named_like_references(ws)
    if not found:
        return None
    values = ids = None
    for name in dict.fromkeys(e.name for e, *_ in found):
        own = [(i, p.name, t.name) for i, (e, p, t, _, _) in enumerate(found) if e.name == name]
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("target"), F.col(p).alias("v")) for i, p, t in own]))
        part = ws[name].select(cells.alias("c")).select("c.*")
        values = part if values is None else values.unionByName(part)
    for name in dict.fromkeys(t.name for _, _, t, _, _ in found):
        part = ws[name].select(F.lit(name).alias("target"), F.col("Id").alias("v"))
        ids = part if ids is None else ids.unionByName(part)
    count = F.count(F.lit(1))
    ids = ids.groupBy("target", "v").agg(count.alias("k"))
    met = values.groupBy("i", "target", "v").agg(count.alias("n")).join(ids, ["target", "v"], "left")
    filled, hit = F.coalesce(F.col("v") != "", F.lit(False)), F.col("k").isNotNull()
    sum_of = lambda test, x: F.coalesce(F.sum(F.when(test, F.col(x))), F.lit(0))
    sides = met.groupBy("i").agg(
        F.sum("n").alias("rows"),
        sum_of(filled, "n").alias("source_rows"),
        F.count(F.when(filled, 1)).alias("source_distinct"),
        sum_of(filled & hit, "n").alias("matched_rows"),
        F.count(F.when(filled & hit, 1)).alias("matched_distinct"),
    )
    targets = ids.groupBy("target").agg(F.sum("k").alias("target_rows"), sum_of(filled, "k").alias("ids"), F.count(F.when(filled, 1)).alias("distinct_ids"))
    first = met.where(filled & ~hit).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where("r <= 5")
    sample = first.groupBy("i").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("unmatched_sample"))
    facts = [(i, e.name, p.name, t.name, role, weak, ((role or t.name) + "Id").upper() in {r.column.upper() for r in e.relationships}, p.required) for i, (e, p, t, role, weak) in enumerate(found)]
    table = ws[found[0][0].name].sparkSession.createDataFrame(facts, "i int, entity string, property string, target string, role string, weak boolean, taken boolean, required boolean")
    row = sides.join(F.broadcast(table), "i").join(targets, "target").join(sample, "i", "left")  # a row for each candidate
    row = row.where((F.col("rows") >= 2) & (F.col("target_rows") >= 2) & (F.col("source_rows") > 0)).withColumn("unmatched_sample", F.coalesce("unmatched_sample", F.lit("")))
    unique, reuse = F.col("distinct_ids") == F.col("ids"), F.col("source_rows") > F.col("source_distinct")
    tests = [F.col("taken"), ~unique, F.col("ids") < F.col("target_rows"), F.col("required") & (F.col("source_rows") < F.col("rows")), F.col("matched_distinct") < F.col("source_distinct"), ~reuse]
    blockers = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    row = row.withColumn("blockers", blockers)
    score = 0.40 + 0.35 * F.col("matched_rows") / F.col("source_rows") + F.when(unique, 0.15).otherwise(0.02) + F.when(reuse, 0.10).otherwise(0.0) - 0.12 * F.col("blockers")
    return row.select("entity", "property", "target", "role", "weak", "source_rows", "source_distinct", "matched_rows", "matched_distinct", "unmatched_sample", "blockers", _rounded(score).alias("score"))


# diff and merge


def cells(ws: Workspace, entity: str) -> DataFrame:
    """(entity, id, member, value) of every filled member of an entity."""
    e = ws.model.entity(entity)
    rest = [c for c in e.columns if c != "Id"]
    if not rest:
        return ws[e.name].select(F.lit(e.name).alias("entity"), F.col("Id").alias("id"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("value")).where("false")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("value")) for c in rest]))
    return ws[e.name].select(F.lit(e.name).alias("entity"), F.col("Id").alias("id"), pairs.alias("p")).select("entity", "id", "p.*").where(F.col("value").isNotNull())


def _all(ws: Workspace, part) -> DataFrame:
    out = None
    for e in ws.model.entities:
        out = part(e.name) if out is None else out.union(part(e.name))
    return out


def diff_rows(left: Workspace, right: Workspace) -> DataFrame:
    """(side, entity, id) of rows that only one of two workspaces of the same model has; ids compare as they are."""
    if left.model.signature() != right.model.signature():
        raise ValueError("DiffModelMismatch")
    rows = lambda ws, side: _all(ws, lambda n: ws[n].select(F.lit(n).alias("entity"), F.col("Id").alias("id"))).withColumn("side", F.lit(side))
    both = rows(left, "left").unionByName(rows(right, "right"))
    one = both.groupBy("entity", "id").agg(F.max("side").alias("side"), F.min("side").alias("other"))
    return one.where("side = other").select("side", "entity", "id")


def diff_cells(left: Workspace, right: Workspace) -> DataFrame:
    """(side, entity, id, member, value) of members that differ in rows which both have: one aggregate, no join."""
    rows = lambda ws, bit: _all(ws, lambda n: ws[n].select(F.lit(n).alias("entity"), F.col("Id").alias("id"), F.lit(bit).alias("side"), F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("value")) for c in ws.model.entity(n).columns if c != "Id"]).alias("cells")))
    of = lambda side: F.flatten(F.collect_list(F.when(F.col("side") == side, F.col("cells"))))
    both = rows(left, "left").union(rows(right, "right")).groupBy("entity", "id").agg(of("left").alias("l"), of("right").alias("r"), F.min("side").alias("a"), F.max("side").alias("b"))
    only = lambda side, x, y: F.transform(F.array_except(x, y), lambda c: F.struct(F.lit(side).alias("side"), c["member"].alias("member"), c["value"].alias("value")))
    apart = both.where("a <> b").select("entity", "id", F.explode(F.concat(only("left", "l", "r"), only("right", "r", "l"))).alias("c"))
    return apart.select("c.side", "entity", "id", "c.member", "c.value").where(F.col("value").isNotNull())


def aligned(ws: Workspace, model: Model, entities: Mapping[str, str], members: Mapping[tuple[str, str], str]) -> Workspace:
    """ws as a workspace of model: entities renamed by the first map, columns by (entity, column) in the second; others go."""
    data = {}
    for e in model.entities:
        old = next(k for k, v in entities.items() if v == e.name)
        names = {v: k[1] for k, v in members.items() if k[0] == old}
        data[e.name] = ws[old].select("Id", *[F.col(names[c]).alias(c) for c in e.columns if c != "Id"])
    return Workspace(model, data)


def sync_plan(current: Workspace, desired: Workspace, entity: str) -> DataFrame:
    """(operation, id, member, value) that turns current's records of an entity into desired's; ids meet in any case."""
    e = current.model.entity(entity)
    a = current[e.name].select(F.upper("Id").alias("_k"), F.struct(*e.columns).alias("a"))
    b = desired[e.name].select(F.upper("Id").alias("_k"), F.struct(*e.columns).alias("b"))
    both = a.join(b, "_k", "full_outer")
    op = lambda name, i, member=None, value=None: F.struct(F.lit(name).alias("operation"), i.alias("id"), F.lit(member).cast("string").alias("member"), (value if value is not None else F.lit(None)).cast("string").alias("value"))
    ida, idb = F.col("a.Id"), F.col("b.Id")
    steps = [F.when(F.col("b").isNull(), op("DeleteRecord", ida)), F.when(F.col("a").isNull(), op("InsertRecord", idb)), F.when(ida != idb, op("RenameRecord", ida, "Id", idb))]
    for c in e.columns[1:]:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        link = any(r.column == c for r in e.relationships)
        steps.append(F.when(F.col("b").isNotNull() & y.isNotNull() & ~x.eqNullSafe(y), op("SetRelationship" if link else "SetProperty", idb, c, y)))
        steps.append(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & x.isNotNull() & y.isNull(), op("ClearRelationship" if link else "ClearProperty", idb, c)))
    return both.select(F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("s.*")


def synchronized(current: Workspace, plan: DataFrame, entity: str) -> DataFrame:
    """The records of an entity after the steps of a plan, as sync_plan() gives them."""
    e = current.model.entity(entity)
    step = lambda *names: plan.where(F.col("operation").isin(*names))
    gone = step("DeleteRecord").select(F.upper("id").alias("_k"))
    renamed = step("RenameRecord").select(F.upper("id").alias("_k"), F.col("value").alias("_new"))
    old = current[e.name].withColumn("_k", F.upper("Id")).join(gone, "_k", "left_anti").join(renamed, "_k", "left")
    old = old.select(F.coalesce("_new", "Id").alias("Id"), *e.columns[1:])
    new = step("InsertRecord").select(F.col("id").alias("Id"), *[F.lit(None).cast("string").alias(c) for c in e.columns[1:]])
    cells = step("SetProperty", "ClearProperty", "SetRelationship", "ClearRelationship").groupBy(F.upper("id").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("_m"))
    met = old.unionByName(new).withColumn("_k", F.upper("Id")).join(cells, "_k", "left")
    given = lambda c: F.coalesce(F.map_contains_key("_m", F.lit(c)), F.lit(False))
    return met.select("Id", *[F.when(given(c), F.col("_m")[c]).otherwise(F.col(c)).alias(c) for c in e.columns[1:]])


def synchronize(current: Workspace, desired: Workspace) -> Workspace:
    """current after the plans of all entities, those that others refer to first; faults where it is not desired then."""
    order, cycle = dependency_order({e.name: [r.entity for r in e.relationships] for e in current.model.entities})
    data = {n: synchronized(current, sync_plan(current, desired, n), n) for n in [*order, *cycle]}
    for n in data:
        if not ordering.differences(data[n], desired[n]).isEmpty():
            raise ValueError(f"SynchronizationVerificationFailed: {n}")
    return Workspace(current.model, data)


def record_levels(df: DataFrame, parent: str) -> DataFrame:
    """(Id, level) of records that refer to others of their kind: 0 without a parent, then one more than the parent's.

    The order in which records can be made; a cycle or a parent that isn't there faults.
    """
    tree = Model("Tree", (Entity("Node", (), (Relationship("Node", "Parent", False),)),))
    return ordering.record_levels(Workspace(tree, {"Node": df.select("Id", F.col(parent).alias("ParentId"))}), optional=True).select("Id", "level")


def merge(target: Workspace, left: Workspace, right: Workspace) -> Workspace:
    """right's records under target's model, if target holds just what left does."""
    for e in left.model.entities:
        if not ordering.differences(target[e.name].select(*e.columns), left[e.name]).isEmpty():
            raise ValueError(f"MergePreconditionFailed: {e.name}")
    return Workspace(target.model, {e.name: right[e.name].select(*e.columns) for e in target.model.entities})


def combine(name: str, parts: Sequence[Workspace]) -> Workspace:
    """One workspace of two or more whose entity names differ."""
    names = [e.name.upper() for w in parts for e in w.model.entities]
    if len(parts) < 2:
        raise ValueError("MergeSourceCountInvalid")
    if len(set(names)) != len(names):
        raise ValueError("MergeEntityCollision")
    return Workspace(Model(name, tuple(e for w in parts for e in w.model.entities)), {k: v for w in parts for k, v in w.data.items()})


# search


def search(df: DataFrame, term: str, name: str, kind: str | None = None, ranks: Mapping[str, int] | None = None, limit: int = 25) -> DataFrame:
    """Rows whose name holds the term in any case: equal ones first, then those that start with it, then the others."""
    key, want = fold(name), fold(F.lit(term))
    rank = F.when(key == want, 0).when(key.startswith(want), 1).otherwise(2)
    weight = F.lit(0)
    for k, r in (ranks or {}).items():
        weight = F.when(F.col(kind) == k, r).otherwise(weight)
    return df.where(key.contains(want)).withColumn("rank", rank).withColumn("_w", weight).orderBy("rank", "_w", key, name).limit(limit).drop("_w")
