"""The order in which records can be made and removed, and plans of operations that keep references whole throughout.

Levels come from peeling: a record whose references are all met gets its level and meets those that refer to it. A
round costs joins of keys; the number of rounds is that of the levels. What no round reaches lies on or behind a
cycle, which faults.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Entity, Model, Relationship, Workspace, dependency_order
from .ranges import kept, numbered

STAGES = ("RenameRecord", "InsertRecord", "Existing", "NewOptional", "RemovedOptional", "DeleteRecord")
_NAMED = 10  # records that a fault names at most

# levels


def _key(c: str) -> Column:
    return F.upper(F.col(f"`{c}`").cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nodes(ws: Workspace) -> DataFrame:
    return _union([ws[e.name].select(F.lit(i).alias("e"), _key("Id").alias("k"), F.col("Id").cast("string").alias("Id")) for i, e in enumerate(ws.model.entities)])


def _edges(ws: Workspace, counted: Mapping[str, list[Relationship]]) -> DataFrame | None:
    """(se, sk, te, tk) of the references that count."""
    at = {e.name: i for i, e in enumerate(ws.model.entities)}
    parts = [
        ws[e.name].where(F.col(r.column).isNotNull()).select(F.lit(at[e.name]).alias("se"), _key("Id").alias("sk"), F.lit(at[ws.model.entity(r.entity).name]).alias("te"), _key(r.column).alias("tk"))
        for e in ws.model.entities
        for r in counted[e.name]
    ]
    return _union(parts) if parts else None


def _names(model: Model, found: DataFrame) -> str:
    """Entity:Id of some rows of found(e, k, ...) in a fixed order, for a fault."""
    return ", ".join(f"{model.entities[r.e].name}:{r.k}" for r in found.select("e", "k").distinct().orderBy("e", "k").limit(_NAMED).collect())


def _check(ws: Workspace, counted: Mapping[str, list[Relationship]], edges: DataFrame, nodes: DataFrame, present: DataFrame | None) -> None:
    for i, e in enumerate(ws.model.entities):
        needs = [F.col(r.column).isNull() for r in counted[e.name] if r.required]
        if needs:
            lacking = ws[e.name].where(F.exists(F.array(*needs), lambda x: x)).select(F.lit(i).alias("e"), F.col("Id").alias("k"))
            if names := _names(ws.model, lacking):
                raise ValueError(f"RequiredRelationshipValueMissing: {names}")
    known = nodes.select("e", "k") if present is None else nodes.select("e", "k").union(present.select("e", "k"))
    orphans = edges.join(known.select(F.col("e").alias("te"), F.col("k").alias("tk")), ["te", "tk"], "left_anti")
    if names := _names(ws.model, orphans.select(F.col("se").alias("e"), F.col("sk").alias("k"))):
        raise ValueError(f"RelationshipTargetMissing: {names}")


def _cycle(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """Of rest(e, k) on or behind cycles, without those behind: what no other refers to goes, round by round."""
    while True:
        edges = edges.join(rest.select(F.col("e").alias("se"), F.col("k").alias("sk")), ["se", "sk"], "left_semi")
        wanted = edges.select(F.col("te").alias("e"), F.col("tk").alias("k")).distinct()
        less = kept(rest.join(wanted, ["e", "k"], "left_semi"), "cycle")
        if less.count() == rest.count():
            return less
        rest = less


def _peeled(model: Model, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(e, k, level) of nodes(e, k); every edge leads to a node. Each round keeps only what is not met yet."""
    own = edges.groupBy(F.col("se").alias("e"), F.col("sk").alias("k")).agg(F.count(F.lit(1)).alias("unmet"))
    state = kept(nodes.select("e", "k").join(own, ["e", "k"], "left").select("e", "k", F.coalesce("unmet", F.lit(0)).alias("unmet"), F.lit(0).cast("long").alias("level")), "peeling")
    edges, out = kept(edges, "edges"), []
    while True:
        front = state.where("unmet = 0").select("e", "k", "level")
        out.append(front)
        sizes = state.agg(F.count(F.when(F.col("unmet") == 0, 1)).alias("met"), F.count(F.when(F.col("unmet") > 0, 1)).alias("left")).first()
        if not sizes.left:
            return _union(out)
        if not sizes.met:
            raise ValueError(f"RequiredRelationshipCycle: {_names(model, _cycle(state.select('e', 'k'), edges))}")
        hit = kept(edges.join(front.select(F.col("e").alias("te"), F.col("k").alias("tk"), "level"), ["te", "tk"], "left"), "edges")
        met = hit.where(F.col("level").isNotNull()).groupBy(F.col("se").alias("e"), F.col("sk").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.max("level") + 1).alias("next"))
        edges = hit.where(F.col("level").isNull()).select("se", "sk", "te", "tk")
        waiting = state.where("unmet > 0").join(met, ["e", "k"], "left")
        state = kept(waiting.select("e", "k", (F.col("unmet") - F.coalesce("n", F.lit(0))).alias("unmet"), F.greatest("level", F.coalesce("next", F.lit(0))).alias("level")), "peeling")


def record_levels(ws: Workspace, present: Workspace | None = None, optional: bool = False) -> DataFrame:
    """(entity, Id, level): 0 for records whose references need no other record of ws, else one more than the highest of those.

    References count if they are required, or all with optional; those to records of present, which holds what is
    there already, are met. Ids compare in any case. A required reference without a value faults, as does a target
    that is in neither workspace, and a cycle; faults name up to ten records. Records of an entity that stands on no
    cycle of entities share a level where nothing is present, so no record is joined for it beyond those checks.
    """
    counted = {e.name: [r for r in e.relationships if r.required or optional] for e in ws.model.entities}
    nodes = _nodes(ws)
    edges = _edges(ws, counted)
    if edges is None:
        return nodes.select(_entity(ws.model), "Id", F.lit(0).cast("long").alias("level"))
    there = _nodes(present) if present is not None else None
    _check(ws, counted, edges, nodes, there)
    order, cyclic = dependency_order({n: [ws.model.entity(r.entity).name for r in rs] for n, rs in counted.items()}, skip_self=False)
    if present is None and not cyclic and not optional:
        depth: dict[str, int] = {}
        for n in order:
            depth[n] = max((depth[ws.model.entity(r.entity).name] + 1 for r in counted[n]), default=0)
        return _union([ws[n].select(F.lit(n).alias("entity"), F.col("Id").cast("string").alias("Id"), F.lit(d).cast("long").alias("level")) for n, d in depth.items()])
    inner = edges.join(nodes.select(F.col("e").alias("te"), F.col("k").alias("tk")), ["te", "tk"], "left_semi") if present is not None else edges
    return nodes.join(_peeled(ws.model, nodes, inner), ["e", "k"]).select(_entity(ws.model), "Id", "level")


def _entity(model: Model) -> Column:
    return F.element_at(F.array(*[F.lit(e.name) for e in model.entities]), F.col("e") + 1).alias("entity")


# plans


def _paired(current: Workspace, desired: Workspace, e: Entity) -> DataFrame:
    """(_k, a, b): the records of both sides by id in any case; null where a side has none."""
    side = lambda ws, name: ws[e.name].select(F.upper("Id").alias("_k"), F.struct(*e.columns).alias(name))
    return kept(side(current, "a").join(side(desired, "b"), "_k", "full_outer"), "paired")


def _only(pairs: Mapping[str, DataFrame], model: Model, side: str, other: str) -> Workspace:
    return Workspace(model, {n: d.where(F.col(other).isNull()).select(f"{side}.*") for n, d in pairs.items()})


def ordered_plan(current: Workspace, desired: Workspace) -> DataFrame:
    """(step, stage, level, operation, entity, id, member, value, cells) that turns current into desired, of one model.

    step numbers the operations from 1. Stages: 1 spellings of ids, 2 new records after those that they require,
    3 cells of records that stay, 4 optional references of new records, 5 optional references of removed records
    cleared, 6 removals, of records before those that they require. cells has the properties and required references
    of a new record. Within a stage and level operations go by entity as in the model, id in any case, and member.
    After each stage no reference is open. Both sides must be valid; a cycle of required references among new or
    removed records faults.
    """
    if current.model.signature() != desired.model.signature():
        raise ValueError("SynchronizationModelMismatch")
    model = current.model
    pairs = {e.name: _paired(current, desired, e) for e in model.entities}
    stays = Workspace(model, {n: d.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("b.*") for n, d in pairs.items()})
    new, gone = _only(pairs, model, "b", "a"), _only(pairs, model, "a", "b")
    levels = lambda ws: record_levels(ws, present=stays).select("entity", F.upper("Id").alias("_k"), "level")
    up, down = levels(new), levels(gone)
    none = F.lit(None).cast("string")
    parts = []
    for place, e in enumerate(model.entities):
        rows = pairs[e.name]
        links = {r.column: r.required for r in e.relationships}
        needed = [c for c in e.columns[1:] if links.get(c, True)]
        op = lambda stage, name, i, member=none, value=none, m=0: F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("operation"), i.alias("id"), member.cast("string").alias("member"), value.cast("string").alias("value"), F.lit(m).alias("_m"))
        a, b = F.col("a.Id"), F.col("b.Id")
        is_new, is_gone = F.col("a").isNull(), F.col("b").isNull()
        both = ~is_new & ~is_gone
        steps = [F.when(both & (a != b), op(1, "RenameRecord", a, F.lit("Id"), b)), F.when(is_new, op(2, "InsertRecord", b)), F.when(is_gone, op(6, "DeleteRecord", a))]
        for m, c in enumerate(e.columns[1:], 1):
            x, y, kind = F.col(f"a.{c}"), F.col(f"b.{c}"), "Relationship" if c in links else "Property"
            steps.append(F.when(both & y.isNotNull() & ~x.eqNullSafe(y), op(3, f"Set{kind}", b, F.lit(c), y, m)).when(both & x.isNotNull() & y.isNull(), op(3, f"Clear{kind}", b, F.lit(c), m=m)))
            if c in links and not links[c]:
                steps.append(F.when(is_new & y.isNotNull(), op(4, "SetRelationship", b, F.lit(c), y, m)).when(is_gone & x.isNotNull(), op(5, "ClearRelationship", a, F.lit(c), m=m)))
        given = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in needed]), F.array(*[F.col(f"b.{c}") for c in needed])), lambda _, v: v.isNotNull()) if needed else F.create_map().cast("map<string,string>")
        flat = rows.select("_k", given.alias("_cells"), F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("_k", "s.*", F.when(F.col("s.stage") == 2, F.col("_cells")).alias("cells"))
        parts.append(flat.select(F.lit(place).alias("_e"), F.lit(e.name).alias("entity"), "*"))
    every = _union(parts)
    at = lambda stage, depth: every.where(F.col("stage") == stage).join(depth, ["entity", "_k"])
    placed = every.where(~F.col("stage").isin(2, 6)).withColumn("level", F.lit(0).cast("long")).unionByName(at(2, up)).unionByName(at(6, down))
    falls = F.when(F.col("stage") == 6, -F.col("level")).otherwise(F.col("level"))
    order = [F.asc(c) for c in ("stage", "_falls", "_e", "_k", "_m")]
    return numbered(placed.withColumn("_falls", falls), order, "step").select("step", "stage", "level", "operation", "entity", "id", "member", "value", "cells")


def _after(model: Model, data: Mapping[str, DataFrame], plan: DataFrame, stage: int) -> dict[str, DataFrame]:
    """The records after one stage of a plan."""
    out, steps = {}, plan.where(F.col("stage") == stage)
    for e in model.entities:
        own, now = steps.where(F.col("entity") == e.name), data[e.name]
        rest = e.columns[1:]
        if stage == 1:
            to = own.select(F.upper("id").alias("_k"), F.col("value").alias("_new"))
            now = now.withColumn("_k", F.upper("Id")).join(to, "_k", "left").select(F.coalesce("_new", "Id").alias("Id"), *rest)
        elif stage == 2:
            now = now.unionByName(own.select(F.col("id").alias("Id"), *[F.col("cells")[c].alias(c) for c in rest]))
        elif stage == 6:
            now = now.withColumn("_k", F.upper("Id")).join(own.select(F.upper("id").alias("_k")), "_k", "left_anti").drop("_k")
        else:
            cells = own.groupBy(F.upper("id").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("_c"))
            met = now.withColumn("_k", F.upper("Id")).join(cells, "_k", "left")
            given = lambda c: F.coalesce(F.map_contains_key("_c", F.lit(c)), F.lit(False))
            now = met.select("Id", *[F.when(given(c), F.col("_c")[c]).otherwise(F.col(c)).alias(c) for c in rest])
        out[e.name] = now
    return out


def applied(current: Workspace, plan: DataFrame, check: bool = True) -> Workspace:
    """current after a plan of ordered_plan(), stage by stage; with check a stage that leaves the workspace invalid faults.

    A stage's operations touch different cells, so they are applied together; the order within it is that of the levels.
    """
    model, data = current.model, {e.name: current[e.name].select(*e.columns) for e in current.model.entities}
    for stage in range(1, len(STAGES) + 1):
        data = {n: kept(d, "after-stage") for n, d in _after(model, data, plan, stage).items()}
        if check:
            issues = Workspace(model, data).issues()
            if issues is not None and (wrong := issues.limit(1).collect()):
                raise ValueError(f"OperationStageInvalid: stage {stage}, {wrong[0].code} {wrong[0].entity}:{wrong[0].id}")
    return Workspace(model, data)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two frames of the same columns with _n, how many more a has (negative: b): one aggregate over both."""
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_s", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("_s").alias("_n")).where("_n <> 0")


def planned(current: Workspace, desired: Workspace) -> DataFrame:
    """ordered_plan(), applied and held against desired; faults where the result differs. References compare in any case."""
    plan = ordered_plan(current, desired)
    out = applied(current, plan)
    for e in current.model.entities:
        links = {r.column for r in e.relationships}
        same = lambda ws, e=e, links=links: ws[e.name].select(*[F.upper(c).alias(c) if c in links else F.col(c) for c in e.columns])
        if not differences(same(out), same(desired)).isEmpty():
            raise ValueError(f"SynchronizationVerificationFailed: {e.name}")
    return plan
