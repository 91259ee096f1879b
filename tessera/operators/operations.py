"""The operation algebra: schema and record changes as functions from a workspace to a workspace.

Nothing runs until a result is used; execute() checks the outcome, after each operation or once for a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAME, Entity, Model, Property, Relationship, Workspace

Operation = Callable[[Workspace], Workspace]


class OperationFault(ValueError):
    """An operation that can't be applied; args[0] starts with its code."""


def _same(c: str, value: str) -> Column:
    return F.upper(F.col(c)) == value.upper()


def _need(ok: bool, code: str) -> None:
    if not ok:
        raise OperationFault(code)


def _set(ws: Workspace, entity: str, ids: DataFrame | str, column: str, value: str | None) -> Workspace:
    e = ws.model.entity(entity)
    _need(column in e.columns and column != "Id", f"member.unknown: {entity}.{column}")
    df = ws[e.name]
    return ws.with_data(e.name, df.withColumn(column, F.when(_same("Id", ids), F.lit(value)).otherwise(F.col(column))))


# records


def insert_record(entity: str, record_id: str, **members: str | None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        _need(set(members) <= set(e.columns), f"member.unknown: {entity}")
        row = ws[e.name].sparkSession.createDataFrame([tuple(record_id if c == "Id" else members.get(c) for c in e.columns)], ", ".join(f"`{c}` string" for c in e.columns))
        return ws.with_data(e.name, ws[e.name].select(*e.columns).union(row))

    return run


def delete_record(entity: str, record_id: str) -> Operation:
    return lambda ws: ws.with_data(ws.model.entity(entity).name, ws[entity].where(~_same("Id", record_id)))


def rename_record(entity: str, old: str, new: str) -> Operation:
    """Also in every reference to the record."""

    def run(ws: Workspace) -> Workspace:
        name = ws.model.entity(entity).name
        out = ws.with_data(name, ws[name].withColumn("Id", F.when(_same("Id", old), F.lit(new)).otherwise(F.col("Id"))))
        for e in ws.model.entities:
            for r in e.relationships:
                if r.entity == name:
                    out = out.with_data(e.name, out[e.name].withColumn(r.column, F.when(_same(r.column, old), F.lit(new)).otherwise(F.col(r.column))))
        return out

    return run


def set_property(entity: str, record_id: str, name: str, value: str) -> Operation:
    return lambda ws: _set(ws, entity, record_id, name, value)


def clear_property(entity: str, record_id: str, name: str) -> Operation:
    return lambda ws: _set(ws, entity, record_id, name, None)


def set_relationship(entity: str, record_id: str, column: str, target: str) -> Operation:
    return lambda ws: _set(ws, entity, record_id, column, target)


def clear_relationship(entity: str, record_id: str, column: str) -> Operation:
    return lambda ws: _set(ws, entity, record_id, column, None)


# schema


def rename_model(name: str) -> Operation:
    return lambda ws: replace(ws, model=replace(ws.model, name=name))


def add_entity(entity: Entity) -> Operation:
    def run(ws: Workspace) -> Workspace:
        _need(entity.name.upper() not in {e.name.upper() for e in ws.model.entities}, f"entity.duplicate: {entity.name}")
        spark = next(iter(ws.data.values())).sparkSession
        empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in entity.columns))
        return Workspace(replace(ws.model, entities=(*ws.model.entities, entity)), {**ws.data, entity.name: empty})

    return run


def remove_entity(entity: str) -> Operation:
    """Only an entity without records that nothing refers to."""

    def run(ws: Workspace) -> Workspace:
        name = ws.model.entity(entity).name
        _need(not any(t == name and s != name for s, t, _, _ in ws.model.edges()), f"entity.referenced: {name}")
        _need(ws[name].isEmpty(), f"entity.notEmpty: {name}")
        return Workspace(replace(ws.model, entities=tuple(e for e in ws.model.entities if e.name != name)), {k: v for k, v in ws.data.items() if k != name})

    return run


def rename_entity(old: str, new: str) -> Operation:
    """Reference columns that are named after the entity follow."""

    def run(ws: Workspace) -> Workspace:
        name = ws.model.entity(old).name
        data, entities = {}, []
        for e in ws.model.entities:
            df, links = ws[e.name], []
            for r in e.relationships:
                to = replace(r, entity=new) if r.entity == name else r
                df = df.withColumnRenamed(r.column, to.column) if to.column != r.column else df
                links.append(to)
            target = new if e.name == name else e.name
            data[target] = df
            entities.append(replace(e, name=target, relationships=tuple(links)))
        return Workspace(replace(ws.model, entities=tuple(entities)), data)

    return run


def add_property(entity: str, prop: Property, value: str | None = None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        _need(bool(NAME.fullmatch(prop.name)), f"property.name.invalid: {prop.name}")
        _need(prop.name.upper() not in {c.upper() for c in e.columns}, f"property.duplicate: {prop.name}")
        new = replace(e, properties=(*e.properties, prop))
        return Workspace(ws.model.with_entity(e.name, new), {**ws.data, e.name: ws[e.name].withColumn(prop.name, F.lit(value).cast("string")).select(*new.columns)})

    return run


def remove_property(entity: str, name: str) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        return Workspace(ws.model.with_entity(e.name, replace(e, properties=tuple(p for p in e.properties if p.name != name))), {**ws.data, e.name: ws[e.name].drop(name)})

    return run


def rename_property(entity: str, old: str, new: str) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        renamed = replace(e, properties=tuple(replace(p, name=new) if p.name == old else p for p in e.properties))
        return Workspace(ws.model.with_entity(e.name, renamed), {**ws.data, e.name: ws[e.name].withColumnRenamed(old, new)})

    return run


def set_property_required(entity: str, name: str, required: bool, fill: str | None = None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        changed = replace(e, properties=tuple(replace(p, required=required) if p.name == name else p for p in e.properties))
        df = ws[e.name] if fill is None else ws[e.name].fillna({name: fill})
        return Workspace(ws.model.with_entity(e.name, changed), {**ws.data, e.name: df})

    return run


def add_relationship(entity: str, link: Relationship, target: str | None = None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        _need(link.column.upper() not in {c.upper() for c in e.columns}, f"relationship.duplicate: {link.column}")
        new = replace(e, relationships=(*e.relationships, link))
        return Workspace(ws.model.with_entity(e.name, new), {**ws.data, e.name: ws[e.name].withColumn(link.column, F.lit(target).cast("string"))})

    return run


def remove_relationship(entity: str, column: str) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        return Workspace(ws.model.with_entity(e.name, replace(e, relationships=tuple(r for r in e.relationships if r.column != column))), {**ws.data, e.name: ws[e.name].drop(column)})

    return run


def _change_link(entity: str, column: str, change: Callable[[Relationship], Relationship], fill: str | None = None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        old = next((r for r in e.relationships if r.column == column), None)
        _need(old is not None, f"relationship.unknown: {entity}.{column}")
        new = change(old)
        df = ws[e.name] if fill is None else ws[e.name].fillna({column: fill})
        changed = replace(e, relationships=tuple(new if r is old else r for r in e.relationships))
        return Workspace(ws.model.with_entity(e.name, changed), {**ws.data, e.name: df.withColumnRenamed(column, new.column)})

    return run


def rename_relationship(entity: str, column: str, role: str) -> Operation:
    return _change_link(entity, column, lambda r: replace(r, role=role))


def retarget_relationship(entity: str, column: str, target: str) -> Operation:
    return _change_link(entity, column, lambda r: replace(r, entity=target, role=column[:-2]))


def set_relationship_required(entity: str, column: str, required: bool, fill: str | None = None) -> Operation:
    return _change_link(entity, column, lambda r: replace(r, required=required), fill)


# refactors


def property_to_relationship(entity: str, name: str, target: str, lookup: str = "Id", role: str = "", drop: bool = True) -> Operation:
    """The property's values become references to the records of target whose lookup property they equal.

    Values compare as they are, ids in any case. The lookup must be filled and unique, and every value found; the
    checks are aggregates that run now.
    """

    def run(ws: Workspace) -> Workspace:
        e, t = ws.model.entity(entity), ws.model.entity(target)
        prop = next((p for p in e.properties if p.name == name), None)
        _need(prop is not None, f"property.unknown: {entity}.{name}")
        link = Relationship(t.name, role, prop.required)
        _need(link.column not in e.columns or (drop and link.column == name), f"relationship.conflict: {link.column}")
        key = (lambda c: F.upper(c)) if lookup == "Id" else (lambda c: c)
        side = ws[t.name].select(key(F.col(lookup)).alias("_key"), F.col("Id").alias("_to"))
        n, filled, unique = side.agg(F.count(F.lit(1)), F.count(F.when(F.col("_key") != "", 1)), F.countDistinct("_key")).first()
        _need(n == filled, f"lookup.blank: {target}.{lookup}")
        _need(n == unique, f"lookup.duplicate: {target}.{lookup}")
        df = ws[e.name].withColumn("_value", key(F.col(name)))
        _need(df.where(F.col("_value").isNotNull()).join(side, F.col("_value") == F.col("_key"), "left_anti").isEmpty(), f"lookup.incomplete: {entity}.{name}")
        kept = tuple(p for p in e.properties if p.name != name) if drop else e.properties
        new = replace(e, properties=kept, relationships=(*e.relationships, link))
        joined = df.join(side, F.col("_value") == F.col("_key"), "left")
        joined = (joined.drop(name) if drop else joined).withColumnRenamed("_to", link.column)
        return Workspace(ws.model.with_entity(e.name, new), {**ws.data, e.name: joined.select(*new.columns)})

    return run


def relationship_to_property(entity: str, column: str, name: str | None = None) -> Operation:
    def run(ws: Workspace) -> Workspace:
        e = ws.model.entity(entity)
        link = next((r for r in e.relationships if r.column == column), None)
        _need(link is not None, f"relationship.unknown: {entity}.{column}")
        new = replace(e, properties=(*e.properties, Property(name or column, link.required)), relationships=tuple(r for r in e.relationships if r is not link))
        return Workspace(ws.model.with_entity(e.name, new), {**ws.data, e.name: ws[e.name].withColumnRenamed(column, name or column).select(*new.columns)})

    return run


def _checked(ws: Workspace) -> Workspace:
    found = ws.model.issues()
    _need(not found, f"{found[0][0]}: {found[0][1]}" if found else "")
    bad = ws.issues()
    row = bad.first() if bad is not None else None
    _need(row is None, f"{row.code}: {row.entity}.{row.member} {row.id}" if row else "")
    return ws


def execute(ws: Workspace, operations: Sequence[Operation], batch: bool = False) -> Workspace:
    """The workspace after all operations, checked after each, or once at the end of a batch; ws itself never changes."""
    for op in operations:
        ws = op(ws) if batch else _checked(op(ws))
    return _checked(ws) if batch else ws
