"""CSV import, export and merge plans, bulk upserts, and XML workspaces."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fold
from ..model import ID_PATTERN, Entity, Model, Property, Relationship, Workspace
from ..operators.ordering import record_levels
from ..operators.ranges import correlated, kept, numbered


class ImportFault(ValueError):
    """Input that can't be imported; args[0] starts with its code."""


def identifiers(headers: Sequence[str]) -> list[str]:
    """Header names as identifiers, repeated ones with _2, _3 and so on."""
    out: list[str] = []
    for h in headers:
        name = re.sub(r"[^A-Za-z0-9_]+", "_", (h or "").replace("﻿", "").strip()).strip("_") or "Column"
        name = name if re.match(r"[A-Za-z_]", name) else "_" + name
        n, base = 1, name
        while name.upper() in {x.upper() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Text columns with identifier names; cells are trimmed, blank ones null, blank rows left out, short rows padded."""
    reader = spark.read.options(multiLine=True, quote='"', escape='"', sep=separator, mode="PERMISSIVE")
    head = reader.options(header=False).csv(path).first()  # Spark would number repeated names by place
    df = reader.options(header=True).csv(path).toDF(*identifiers(list(head or [])))
    df = df.select(*[F.when(F.trim(F.regexp_replace(c, r"^\x{FEFF}", "")) != "", F.trim(F.regexp_replace(c, r"^\x{FEFF}", ""))).alias(c) for c in df.columns])
    return df.where(F.coalesce(*df.columns).isNotNull())


def import_csv(df: DataFrame, entity: str) -> tuple[Entity, DataFrame]:
    """The entity that a table makes: all text, columns with a missing cell optional. Ids must be there, valid and unique."""
    key = next((c for c in df.columns if c.upper() == "ID"), None)
    if key is None:
        raise ImportFault("ImportIdColumnMissing")
    df = df.withColumnRenamed(key, "Id")
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count("Id").alias("ids"), F.countDistinct(F.upper("Id")).alias("keys"), F.count(F.when(~F.col("Id").rlike(ID_PATTERN), 1)).alias("bad"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    for code, wrong in (("ImportIdMissing", counts.ids < counts.n), ("ImportIdInvalid", counts.bad), ("ImportIdDuplicate", counts["keys"] < counts.ids)):
        if wrong:
            raise ImportFault(code)
    properties = tuple(Property(c, counts[f"c{i}"] == counts.n) for i, c in enumerate(df.columns) if c != "Id")
    return Entity(entity, properties), df.select("Id", *[p.name for p in properties])


def merge_plan(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action, member, value): insert for new ids, set or clear for cells that change; incoming's columns only."""
    members = [c for c in incoming.columns if c != "Id"]
    a = existing.select(F.upper("Id").alias("_k"), F.col("Id").alias("_old"), *[F.col(c).alias(f"_a_{c}") for c in members])
    b = incoming.select(F.upper("Id").alias("_k"), F.col("Id").alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in members])
    both = b.join(a, "_k", "left")
    new = F.col("_old").isNull()
    steps = []
    for c in members:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        act = F.when(new & y.isNotNull(), "insert").when(~new & y.isNotNull() & ~x.eqNullSafe(y), "set").when(~new & y.isNull() & x.isNotNull(), "clear")
        steps.append(F.struct(act.alias("action"), F.lit(c).alias("member"), y.alias("value")))
    flat = both.select(F.coalesce("_old", "_new").alias("id"), F.explode(F.array(*steps)).alias("s")).select("id", "s.*")
    return flat.where(F.col("action").isNotNull())


def export_csv(ws: Workspace, entity: str, path: str) -> None:
    """Id, relationship columns, then properties, by Id as it is spelt; one sorted run of part files."""
    e = ws.model.entity(entity)
    columns = ["Id", *[r.column for r in e.relationships], *[p.name for p in e.properties]]
    ws[e.name].select(*columns).orderBy("Id").write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


# bulk upserts


def read_upsert(spark: SparkSession, path: str, order: str = "ord") -> DataFrame:
    """Rows of a tab- or comma-separated text file with order, their place: tabs in the first line tell which.

    Cells are trimmed and not quoted; empty lines are left out. A blank header name faults, as does, when it is met, a
    row with more or fewer cells than the header.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    lines = numbered(read.where(F.col("value") != ""), [F.asc(c) for c in ("f", "b", "m")], "_n")
    head = lines.where("_n = 1").first()
    if head is None:
        raise ImportFault("UpsertHeaderMissing")
    tab = "\t" if "\t" in head.value else ","
    names = [h.replace("\ufeff", "").strip() for h in head.value.split(tab)]
    if not all(names):
        raise ImportFault("UpsertHeaderInvalid")
    parts = F.split("value", tab, -1)
    right = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.lit("fault:UpsertColumnCountInvalid")).cast("array<string>"))
    rows = lines.where("_n > 1").select(right.alias("_parts"), F.col("_n").alias(order))
    return rows.select(*[F.trim(F.col("_parts")[i]).alias(n) for i, n in enumerate(names)], order)


def _by_key(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, without ids, with the Id of the one record whose key columns they name in any case."""
    side = existing.groupBy(*[fold(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.countDistinct(F.upper("Id")).alias("_n"), F.min("Id").alias("_id"))
    given = rows.withColumns({f"_g{i}": F.trim(c) for i, c in enumerate(key)})
    met = given.join(side, [fold(f"_g{i}") == F.col(f"_k{i}") for i in range(len(key))], "left")
    blank = F.exists(F.array(*[F.coalesce(F.col(f"_g{i}"), F.lit("")) == "" for i in range(len(key))]), lambda x: x)
    fault = lambda code: F.raise_error(F.lit(f"fault:{code}")).cast("string")
    found = F.when(blank, fault("UpsertKeyMissing")).when(F.col("_n").isNull(), fault("UpsertKeyNotFound")).when(F.col("_n") > 1, fault("UpsertKeyAmbiguous")).otherwise(F.col("_id"))
    return met.withColumn("Id", found).select(*rows.columns)


def _by_number(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """rows with numbers for missing ids: one more than the largest among existing ids, those given before, and those made before.

    The n-th made id is n more than the largest start, where a number g that is given after m made ones starts at
    g - m; both are lookups along the order of the rows.
    """
    top = existing.agg(F.coalesce(F.max(F.col("Id").try_cast("long")), F.lit(0)).alias("top"), F.count(F.when(F.col("Id").try_cast("long").isNull(), 1)).alias("bad")).first()
    if top.bad:
        raise ImportFault("UpsertAutoIdNotNumeric")
    rows = kept(rows, "upsert-rows")
    made = rows.where(F.col("Id").isNull())
    counted = correlated(rows, made, [], F.col(order), "<=", F.col(order), F.lit(1), "count", "_c")
    given = counted.where(F.col("Id").try_cast("long").isNotNull()).select(order, (F.col("Id").try_cast("long") - F.col("_c")).alias("_s"))
    started = correlated(counted.where(F.col("Id").isNull()), given, [], F.col(order), "<", F.col(order), F.col("_s"), "max", "_s")
    fresh = started.withColumn("Id", (F.greatest(F.lit(top.top).cast("long"), F.coalesce("_s", F.lit(top.top).cast("long"))) + F.col("_c")).cast("string"))
    return rows.where(F.col("Id").isNotNull()).unionByName(fresh.select(*rows.columns))


def upsert(existing: DataFrame, incoming: DataFrame, order: str, key: Sequence[str] = (), auto_id: bool = False, entity: Entity | None = None) -> DataFrame:
    """existing with incoming's cells put in; incoming has a column order, its rows' place, all different.

    A row finds its record by its trimmed Id if it has one, new or not. Without one it gets the next number with
    auto_id, for which all existing ids must be numbers; else the key columns must name one record in any case; else
    it faults. Of rows for the same record the last filled cell of each member counts, and the first row's spelling
    of a new id. A column that existing lacks faults. With entity, required references of new records to their own
    kind are followed, and a cycle or an open one faults. What to do step by step is ordering.ordered_plan() of the
    table before and after.
    """
    known = {c.upper(): c for c in existing.columns}
    if unknown := [c for c in incoming.columns if c.upper() not in known and c != order]:
        raise ImportFault(f"UpsertColumnUnknown: {unknown[0]}")
    rows = incoming.toDF(*[c if c == order else known[c.upper()] for c in incoming.columns])
    if "Id" not in rows.columns:
        rows = rows.withColumn("Id", F.lit(None).cast("string"))
    rows = rows.withColumn("Id", F.when(F.trim("Id") != "", F.trim("Id")))
    if auto_id:
        rows = _by_number(rows, existing, order)
    elif key:
        rows = rows.where(F.col("Id").isNotNull()).unionByName(_by_key(rows.where(F.col("Id").isNull()), existing, [known[k.upper()] for k in key]))
    else:
        rows = rows.withColumn("Id", F.coalesce("Id", F.raise_error(F.lit("fault:UpsertIdMissing")).cast("string")))
    members = [c for c in existing.columns if c != "Id"]
    given = [c for c in members if c in rows.columns]
    last = rows.groupBy(F.upper("Id").alias("_k")).agg(F.min_by("Id", order).alias("_new"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_b_{c}") for c in given])
    both = existing.withColumn("_k", F.upper("Id")).join(last, "_k", "full_outer")
    cell = lambda c: F.coalesce(f"_b_{c}", c).alias(c) if c in given else F.col(c)
    out = both.select(F.coalesce("Id", "_new").alias("Id"), *[cell(c) for c in members], F.col("Id").isNull().alias("_fresh"))
    own = [r for r in entity.relationships if r.required and r.entity.upper() == entity.name.upper()] if entity is not None else []
    if own:
        out = kept(out, "upserted")
        alone = Model("Upsert", (Entity(entity.name, (), tuple(own)),))
        side = lambda df: Workspace(alone, {entity.name: df.select("Id", *[r.column for r in own])})
        record_levels(side(out.where("_fresh")), present=side(out.where("NOT _fresh")))
    return out.drop("_fresh")


# XML


def read_model(xml: str) -> Model:
    """A model from its XML text: entities with properties and relationships."""
    root = ElementTree.fromstring(xml)
    entities = []
    for e in root.iter("Entity"):
        required = lambda x: (x.get("isRequired") or x.get("required") or "true").lower() != "false"
        entities.append(Entity(e.get("name"), tuple(Property(p.get("name"), required(p)) for p in e.iter("Property")), tuple(Relationship(r.get("entity"), r.get("role") or "", required(r)) for r in e.iter("Relationship"))))
    return Model(root.get("name"), tuple(entities))


def model_xml(model: Model) -> str:
    """The XML text of a model, as read_model() takes it; members in the model's order."""
    root = ElementTree.Element("Model", name=model.name)
    entities = ElementTree.SubElement(root, "Entities")
    for e in model.entities:
        at = ElementTree.SubElement(entities, "Entity", name=e.name)
        for kind, members in (("Property", e.properties), ("Relationship", e.relationships)):
            group = ElementTree.SubElement(at, "Properties" if kind == "Property" else "Relationships") if members else None
            for m in members:
                names = {"name": m.name} if kind == "Property" else {"entity": m.entity} | ({"role": m.role} if m.role else {})
                ElementTree.SubElement(group, kind, **names, **({} if m.required else {"isRequired": "false"}))
    return ElementTree.tostring(root, encoding="unicode")


def publish_xml(ws: Workspace, path: str) -> str:
    """A new version of a workspace under path: its model and its records; gives the version's path.

    Records are written first, then the model; _SUCCESS beside it comes last, so read_published() sees whole versions
    only, and an earlier one stays until the new one is there.
    """
    spark = next(iter(ws.data.values())).sparkSession
    version = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    write_xml(ws, f"{version}/records")
    spark.createDataFrame([(ws.model.signature(),)], "signature string").coalesce(1).write.text(f"{version}/contract")
    spark.createDataFrame([(model_xml(ws.model),)], "xml string").coalesce(1).write.text(f"{version}/model")
    return version


def read_published(spark: SparkSession, version: str) -> Workspace:
    """A version that publish_xml() gave; faults where the model's contract is not the one that was written."""
    model = read_model("\n".join(r.value for r in spark.read.text(f"{version}/model", wholetext=True).collect()))
    (contract,) = spark.read.text(f"{version}/contract").collect()
    if contract.value != model.signature():
        raise ImportFault(f"ModelContractMismatch: {model.name}")
    data = {e.name: read_xml(spark, Model(model.name, (e,)), f"{version}/records/{e.name}")[e.name] for e in model.entities}
    return Workspace(model, data)


def read_xml(spark: SparkSession, model: Model, path: str) -> Workspace:
    """Records from instance files: an element for each, ids and references as attributes, properties as child elements."""
    data = {}
    for e in model.entities:
        names = ["_Id", *[p.name for p in e.properties], *[f"_{r.column}" for r in e.relationships]]
        df = spark.read.format("xml").options(rowTag=e.name).schema(", ".join(f"`{n}` string" for n in names)).load(path)
        data[e.name] = df.select(*[F.col(f"`{n}`").alias(n.removeprefix("_")) for n in names]).select(*e.columns)
    return Workspace(model, data)


def write_xml(ws: Workspace, path: str) -> None:
    """Part files of each entity under path, in the form that read_xml() takes, by Id."""
    for e in ws.model.entities:
        names = {"Id": "_Id"} | {r.column: f"_{r.column}" for r in e.relationships}
        df = ws[e.name].orderBy("Id").select(*[F.col(c).alias(names.get(c, c)) for c in e.columns])
        df.write.mode("overwrite").format("xml").options(rowTag=e.name, rootTag=f"{e.name}List").save(f"{path}/{e.name}")
