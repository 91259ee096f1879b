"""Diffs as workspaces of their own, under fixed models, so that they can be stored, read and queried like others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Entity, Model, Property, Relationship, Workspace
from .ordering import differences
from .services import cells, diff_cells, diff_rows


def _model(name: str, spec: str) -> Model:
    """A model from lines of entity, properties, and after > the entities that it refers to."""
    out = []
    for line in spec.strip().splitlines():
        own, _, links = line.partition(">")
        entity, *properties = own.split()
        out.append(Entity(entity, tuple(map(Property, properties)), tuple(map(Relationship, links.split()))))
    return Model(name, tuple(out))


# The contracts of diffs of one model, of alignments of two models, and of diffs through an alignment.
EQUAL = _model(
    "InstanceDiffModelEqual",
    """
    Diff Name DiffModelVersion > Model
    Model Name
    Entity Name > Model
    Property Name > Entity
    ModelLeftEntityInstance EntityInstanceIdentifier > Diff Entity
    ModelRightEntityInstance EntityInstanceIdentifier > Diff Entity
    ModelLeftPropertyInstance Value > ModelLeftEntityInstance Property
    ModelRightPropertyInstance Value > ModelRightEntityInstance Property
    ModelLeftEntityInstanceNotInRight > ModelLeftEntityInstance
    ModelRightEntityInstanceNotInLeft > ModelRightEntityInstance
    ModelLeftPropertyInstanceNotInRight > ModelLeftPropertyInstance
    ModelRightPropertyInstanceNotInLeft > ModelRightPropertyInstance
    """,
)
_ALIGNMENT = """
    Alignment Name > ModelLeft ModelRight
    Model Name
    ModelLeft > Model
    ModelRight > Model
    ModelLeftEntity Name > ModelLeft
    ModelRightEntity Name > ModelRight
    ModelLeftProperty Name > ModelLeftEntity
    ModelRightProperty Name > ModelRightEntity
    EntityMap > ModelLeftEntity ModelRightEntity
    PropertyMap > ModelLeftProperty ModelRightProperty
    """
ALIGNMENT = _model("InstanceDiffModelAlignment", _ALIGNMENT)
ALIGNED = _model(
    "InstanceDiffModelAligned",
    _ALIGNMENT.rstrip()
    + """
    ModelLeftEntityInstance EntityInstanceIdentifier > ModelLeftEntity
    ModelRightEntityInstance EntityInstanceIdentifier > ModelRightEntity
    ModelLeftPropertyInstance Value > ModelLeftEntityInstance ModelLeftProperty
    ModelRightPropertyInstance Value > ModelRightEntityInstance ModelRightProperty
    ModelLeftEntityInstanceNotInRight > ModelLeftEntityInstance
    ModelRightEntityInstanceNotInLeft > ModelRightEntityInstance
    ModelLeftPropertyInstanceNotInRight > ModelLeftPropertyInstance
    ModelRightPropertyInstanceNotInLeft > ModelRightPropertyInstance
    """,
)


def _key(*parts) -> Column:
    """An id: entity, record and member, as far as there are any."""
    return F.concat_ws(":", *parts)


def equal_diff(left: Workspace, right: Workspace, name: str = "diff", version: str = "1") -> Workspace:
    """The diff of two workspaces of one model, as a workspace of EQUAL.

    It holds the records and filled cells of both, and which of them the other side lacks: records by id, cells of
    records that both have. Ids name entity, record and member. The schema's rows come from the model; records stay
    DataFrames.
    """
    spark, model = next(iter(left.data.values())).sparkSession, left.model
    table = lambda entity, rows: spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in EQUAL.entity(entity).columns))
    members = [(e.name, c) for e in model.entities for c in e.columns if c != "Id"]
    data = {
        "Diff": table("Diff", [("diff", name, version, model.name)]),
        "Model": table("Model", [(model.name, model.name)]),
        "Entity": table("Entity", [(e.name, e.name, model.name) for e in model.entities]),
        "Property": table("Property", [(f"{e}:{c}", c, e) for e, c in members]),
    }
    rows, parts = diff_rows(left, right), diff_cells(left, right)
    for side, ws, other in (("Left", left, "Right"), ("Right", right, "Left")):
        every: DataFrame | None = None
        filled: DataFrame | None = None
        for e in model.entities:
            a = ws[e.name].select(F.lit(e.name).alias("entity"), F.col("Id").alias("id"))
            b = cells(ws, e.name)
            every, filled = (a, b) if every is None else (every.unionByName(a), filled.unionByName(b))
        record, cell = _key("entity", "id"), _key("entity", "id", "member")
        data[f"Model{side}EntityInstance"] = every.select(record.alias("Id"), F.col("id").alias("EntityInstanceIdentifier"), F.lit("diff").alias("DiffId"), F.col("entity").alias("EntityId"))
        data[f"Model{side}PropertyInstance"] = filled.select(cell.alias("Id"), F.col("value").alias("Value"), record.alias(f"Model{side}EntityInstanceId"), _key("entity", "member").alias("PropertyId"))
        gone = rows.where(F.col("side") == side.lower()).select(record.alias("Id"))
        data[f"Model{side}EntityInstanceNotIn{other}"] = gone.select("Id", F.col("Id").alias(f"Model{side}EntityInstanceId"))
        apart = parts.where(F.col("side") == side.lower()).select(cell.alias("Id"))
        data[f"Model{side}PropertyInstanceNotIn{other}"] = apart.select("Id", F.col("Id").alias(f"Model{side}PropertyInstanceId"))
    return Workspace(EQUAL, data)


def alignment(left: Model, right: Model, entities: dict[str, str], members: dict[tuple[str, str], str], spark, name: str = "alignment") -> Workspace:
    """An alignment of two models as a workspace of ALIGNMENT: entities maps left to right names, members (left entity, left column) to right columns."""
    table = lambda entity, rows: spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ALIGNMENT.entity(entity).columns))
    data = {
        "Alignment": table("Alignment", [(name, name, left.name, right.name)]),
        "Model": table("Model", sorted({(m.name, m.name) for m in (left, right)})),
        "EntityMap": table("EntityMap", [(f"{a}:{b}", a, b) for a, b in entities.items()]),
        "PropertyMap": table("PropertyMap", [(f"{a}:{x}", f"{a}:{x}", f"{entities[a]}:{y}") for (a, x), y in members.items()]),
    }
    for side, model in (("Left", left), ("Right", right)):
        data[f"Model{side}"] = table(f"Model{side}", [(model.name, model.name)])
        data[f"Model{side}Entity"] = table(f"Model{side}Entity", [(e.name, e.name, model.name) for e in model.entities])
        data[f"Model{side}Property"] = table(f"Model{side}Property", [(f"{e.name}:{c}", c, e.name) for e in model.entities for c in e.columns if c != "Id"])
    return Workspace(ALIGNMENT, data)


# diffs through an alignment


def _required(ws: Workspace, model: Model) -> None:
    if ws.model.signature() != model.signature():
        raise ValueError(f"DiffContractMismatch: {model.name}")


def _checked(ws: Workspace) -> None:
    """Faults for an alignment that does not name each thing once, or maps members across entities that it does not map.

    The tables are as large as the models; each check is a count or an anti-join of them.
    """
    if ws["Alignment"].count() != 1:
        raise ValueError("AlignmentCountInvalid")
    for table in ("EntityMap", "PropertyMap"):
        for side in ("Left", "Right"):
            column = f"Model{side}{table.removesuffix('Map')}Id"
            if not ws[table].join(ws[column.removesuffix("Id")].select(F.col("Id").alias(column)), column, "left_anti").isEmpty():
                raise ValueError(f"AlignmentTargetMissing: {table}.{column}")
            if not ws[table].groupBy(column).count().where("count > 1").isEmpty():
                raise ValueError(f"AlignmentMappedTwice: {table}.{column}")
    of = lambda side: ws[f"Model{side}Property"].select(F.col("Id").alias(f"Model{side}PropertyId"), f"Model{side}EntityId")
    crossing = ws["PropertyMap"].join(of("Left"), "ModelLeftPropertyId").join(of("Right"), "ModelRightPropertyId").join(ws["EntityMap"], ["ModelLeftEntityId", "ModelRightEntityId"], "left_anti")
    if not crossing.isEmpty():
        raise ValueError("AlignmentPropertyWithoutEntity")


def _matches(ws: Workspace, alignment: Workspace, side: str) -> None:
    """Faults where a workspace lacks what the alignment names on its side."""
    spark = next(iter(ws.data.values())).sparkSession
    entities, members = alignment[f"Model{side}Entity"], alignment[f"Model{side}Property"]
    known = spark.createDataFrame([(e.name, c) for e in ws.model.entities for c in e.columns], "entity string, member string")  # a row for each member
    named = members.join(entities.select(F.col("Id").alias(f"Model{side}EntityId"), F.col("Name").alias("entity")), f"Model{side}EntityId").select("entity", F.col("Name").alias("member"))
    lacking = named.unionByName(entities.select(F.col("Name").alias("entity"), F.lit("Id").alias("member"))).join(known, ["entity", "member"], "left_anti")
    if row := lacking.first():
        raise ValueError(f"AlignmentModelMismatch: {row.entity}.{row.member}")


def _entity_map(alignment: Workspace, side: str) -> DataFrame:
    """(m, entity, entity_id): the entity of a side under each entity map."""
    own = alignment[f"Model{side}Entity"].select(F.col("Id").alias("entity_id"), F.col("Name").alias("entity"))
    return alignment["EntityMap"].select(F.col("Id").alias("m"), F.col(f"Model{side}EntityId").alias("entity_id")).join(own, "entity_id")


def _member_map(alignment: Workspace, side: str) -> DataFrame:
    """(m, p, entity, member, property_id): the member of a side under each property map; ids are not mapped."""
    own = alignment[f"Model{side}Property"].where(F.upper("Name") != "ID").select(F.col("Id").alias("property_id"), F.col("Name").alias("member"), F.col(f"Model{side}EntityId").alias("entity_id"))
    return alignment["PropertyMap"].select(F.col("Id").alias("p"), F.col(f"Model{side}PropertyId").alias("property_id")).join(own, "property_id").join(_entity_map(alignment, side), "entity_id")


def _snapshot(ws: Workspace, alignment: Workspace, side: str) -> tuple[DataFrame, DataFrame]:
    """A side as the maps see it: rows (m, id, entity_id), and filled cells (m, id, p, value, property_id)."""
    every: DataFrame | None = None
    filled: DataFrame | None = None
    for e in ws.model.entities:
        a, b = ws[e.name].select(F.lit(e.name).alias("entity"), F.col("Id").alias("id")), cells(ws, e.name)
        every, filled = (a, b) if every is None else (every.unionByName(a), filled.unionByName(b))
    rows = every.join(_entity_map(alignment, side), "entity").select("m", "id", "entity_id")
    return rows, filled.join(_member_map(alignment, side), ["entity", "member"]).select("m", "id", "p", "value", "property_id")


def aligned_diff(left: Workspace, right: Workspace, alignment: Workspace) -> Workspace:
    """The diff of workspaces of two models through an alignment of them, as a workspace of ALIGNED.

    A record is told by its entity map and id, a cell by its property map besides; what no map names is left out. The
    maps are tables that records and cells are joined with, and one grouping by record finds what either side lacks:
    records, and cells of records that both have. It holds the alignment too, so that it can be merged by itself.
    """
    _required(alignment, ALIGNMENT)
    _checked(alignment)
    sides = {"Left": (left, "Right"), "Right": (right, "Left")}
    data = dict(alignment.data)
    every: DataFrame | None = None
    for side, (ws, _) in sides.items():
        _matches(ws, alignment, side)
        rows, parts = _snapshot(ws, alignment, side)
        record, cell = _key("m", "id"), _key("m", "id", "p")
        data[f"Model{side}EntityInstance"] = rows.select(record.alias("Id"), F.col("id").alias("EntityInstanceIdentifier"), F.col("entity_id").alias(f"Model{side}EntityId"))
        data[f"Model{side}PropertyInstance"] = parts.select(cell.alias("Id"), F.col("value").alias("Value"), record.alias(f"Model{side}EntityInstanceId"), F.col("property_id").alias(f"Model{side}PropertyId"))
        none = F.lit(None).cast("string")
        marked = rows.select("m", "id", F.lit(side).alias("side"), none.alias("p"), none.alias("value")).unionByName(parts.select("m", "id", F.lit(side).alias("side"), "p", "value"))
        every = marked if every is None else every.unionByName(marked)
    has = lambda side: F.max((F.col("side") == side).cast("int")).alias(side)
    of = lambda side: F.collect_list(F.when((F.col("side") == side) & F.col("p").isNotNull(), F.struct("p", "value"))).alias(f"{side}_cells")
    both = every.groupBy("m", "id").agg(has("Left"), has("Right"), of("Left"), of("Right"))  # a record's cells are as many as its members
    for side, (_, other) in sides.items():
        gone = both.where((F.col(side) == 1) & (F.col(other) == 0)).select(_key("m", "id").alias("Id"))
        data[f"Model{side}EntityInstanceNotIn{other}"] = gone.select("Id", F.col("Id").alias(f"Model{side}EntityInstanceId"))
        apart = both.where((F.col(side) == 1) & (F.col(other) == 1)).select("m", "id", F.explode(F.array_except(f"{side}_cells", f"{other}_cells")).alias("c")).select(_key("m", "id", "c.p").alias("Id"))
        data[f"Model{side}PropertyInstanceNotIn{other}"] = apart.select("Id", F.col("Id").alias(f"Model{side}PropertyInstanceId"))
    return Workspace(ALIGNED, data)


def _told(diff: Workspace, side: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot of a side that a diff holds: (m, id) and (m, id, p, value)."""
    own = diff[f"Model{side}EntityInstance"].select(F.col("Id").alias("r"), F.col("EntityInstanceIdentifier").alias("id"), F.col(f"Model{side}EntityId").alias("entity_id"))
    rows = own.join(_entity_map(diff, side), "entity_id").select("r", "m", "id")
    members = _member_map(diff, side).select("p", "property_id")
    parts = diff[f"Model{side}PropertyInstance"].select(F.col(f"Model{side}EntityInstanceId").alias("r"), F.col("Value").alias("value"), F.col(f"Model{side}PropertyId").alias("property_id"))
    return rows.select("m", "id"), parts.join(members, "property_id").join(rows, "r").select("m", "id", "p", "value")


def _same(ws: Workspace, diff: Workspace, side: str, fault: str) -> None:
    rows, parts = _snapshot(ws, diff, "Left")
    told_rows, told_parts = _told(diff, side)
    if not differences(rows.select("m", "id"), told_rows).isEmpty() or not differences(parts.select("m", "id", "p", "value"), told_parts).isEmpty():
        raise ValueError(fault)


def merge_aligned(target: Workspace, diff: Workspace) -> Workspace:
    """target, of the left model, with what the right side of a diff of ALIGNED holds of mapped entities and members.

    Faults if target is not what the left side holds, if the result would not be what the right side does, or if it
    would break its model. Members without a map stay, and are null in new records; entities without one stay. Its
    operations are those of ordering.ordered_plan(target, result).
    """
    _required(diff, ALIGNED)
    _matches(target, diff, "Left")
    _same(target, diff, "Left", "MergePreconditionFailed: target is not the left snapshot")
    rows, parts = _told(diff, "Right")
    names = _member_map(diff, "Left").select("p", "member", "entity")
    values = parts.join(names, "p").groupBy("entity", "id").agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("_c"))
    mapped = {}
    for r in names.select("entity", "member").distinct().collect():  # a row for each member
        mapped.setdefault(r.entity, set()).add(r.member)
    held = rows.join(_entity_map(diff, "Left").select("m", "entity"), "m")
    data = dict(target.data)
    for (name,) in _entity_map(diff, "Left").select("entity").distinct().collect():
        e = target.model.entity(name)
        own = held.where(F.col("entity") == e.name).select(F.col("id").alias("_id"), F.upper("id").alias("_k"))
        now = target[e.name].withColumn("_k", F.upper("Id"))
        given = values.where(F.col("entity") == e.name).select(F.col("id").alias("_id"), "_c")
        met = own.join(given, "_id", "left").join(now, "_k", "left")
        data[e.name] = met.select(F.col("_id").alias("Id"), *[F.col("_c")[c].alias(c) if c in mapped.get(e.name, ()) else F.col(c) for c in e.columns[1:]])
    out = Workspace(target.model, data)
    _same(out, diff, "Right", "MergePostconditionFailed: the result is not the right snapshot")
    issues = out.issues()
    if issues is not None and (wrong := issues.first()):
        raise ValueError(f"MergeResultInvalid: {wrong.code} {wrong.entity}:{wrong.id}")
    return out
