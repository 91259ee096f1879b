"""Models of typed records, and workspaces that hold a DataFrame for each entity.

Every column is text: Id, the declared properties, and a column for each relationship, named role + "Id". Identity
compares in any case; since ids are printable ASCII, upper() is their key.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,127}")
ID_PATTERN = r"^[\x21-\x7E]([\x20-\x7E]{0,448}[\x21-\x7E])?$"


@dataclass(frozen=True)
class Property:
    name: str
    required: bool = True


@dataclass(frozen=True)
class Relationship:
    entity: str
    role: str = ""
    required: bool = True

    @property
    def column(self) -> str:
        return (self.role or self.entity) + "Id"


@dataclass(frozen=True)
class Entity:
    name: str
    properties: tuple[Property, ...] = ()
    relationships: tuple[Relationship, ...] = ()

    @property
    def columns(self) -> list[str]:
        return ["Id", *[p.name for p in self.properties], *[r.column for r in self.relationships]]


@dataclass(frozen=True)
class Model:
    name: str
    entities: tuple[Entity, ...] = ()

    def entity(self, name: str) -> Entity:
        found = [e for e in self.entities if e.name.upper() == name.upper()]
        if not found:
            raise KeyError(f"SourceEntityNotFound: {name}")
        return found[0]

    def with_entity(self, old: str, new: Entity) -> Model:
        return replace(self, entities=tuple(new if e.name == old else e for e in self.entities))

    def signature(self) -> str:
        """SHA-256 of the sorted lines of all members: equal for models of equal contract."""
        lines = [f"model|{self.name}"]
        for e in self.entities:
            lines.append(f"entity|{e.name}")
            lines += [f"property|{e.name}|{p.name}|{p.required}" for p in e.properties]
            lines += [f"relationship|{e.name}|{r.entity}|{r.column}|{r.required}" for r in e.relationships]
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()

    def edges(self) -> list[tuple[str, str, str, bool]]:
        """(source entity, target entity, column, required) of every relationship."""
        return [(e.name, r.entity, r.column, r.required) for e in self.entities for r in e.relationships]

    def issues(self) -> list[tuple[str, str]]:
        """(code, where) of what is wrong with the model itself."""
        out = [] if NAME.fullmatch(self.name or "") else [("model.name.invalid", self.name or "")]
        names = Counter(e.name.upper() for e in self.entities)
        known = {e.name.upper(): e.name for e in self.entities}
        for e in self.entities:
            if names[e.name.upper()] > 1:
                out.append(("entity.duplicate", e.name))
            if not NAME.fullmatch(e.name):
                out.append(("entity.name.invalid", e.name))
            members = Counter(p.name.upper() for p in e.properties)
            columns = Counter(r.column.upper() for r in e.relationships)
            for p in e.properties:
                if members[p.name.upper()] > 1:
                    out.append(("property.duplicate", f"{e.name}.{p.name}"))
                if not NAME.fullmatch(p.name):
                    out.append(("property.name.invalid", f"{e.name}.{p.name}"))
                if p.name.upper() == "ID":
                    out.append(("property.id.explicit", f"{e.name}.{p.name}"))
                if p.name.upper() in columns:
                    out.append(("entity.member.collision", f"{e.name}.{p.name}"))
            for r in e.relationships:
                if columns[r.column.upper()] > 1:
                    out.append(("relationship.duplicate", f"{e.name}.{r.column}"))
                if r.role and not NAME.fullmatch(r.role):
                    out.append(("relationship.name.invalid", f"{e.name}.{r.role}"))
                if r.entity.upper() not in known:
                    out.append(("relationship.target.missing", f"{e.name}.{r.column}"))
                elif known[r.entity.upper()] != r.entity:
                    out.append(("relationship.target.spelling", f"{e.name}.{r.column}"))
        order, cycle = dependency_order({e.name: [r.entity for r in e.relationships if r.required] for e in self.entities}, skip_self=False)
        return out + [("relationship.cycle", x) for x in cycle]


def dependency_order(needs: Mapping[str, list[str]], skip_self: bool = True) -> tuple[list[str], list[str]]:
    """Names with those that they need first, by name among equals; and the names that lie on or behind a cycle."""
    left = {n: {x for x in xs if x in needs and not (skip_self and x == n)} for n, xs in needs.items()}
    out: list[str] = []
    while ready := sorted((n for n, xs in left.items() if not xs), key=str.upper):
        out.append(ready[0])
        del left[ready[0]]
        for xs in left.values():
            xs.discard(ready[0])
    return out, sorted(left)


@dataclass(frozen=True)
class Workspace:
    """A model and its records; immutable, as DataFrames are."""

    model: Model
    data: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, entity: str) -> DataFrame:
        return self.data[self.model.entity(entity).name]

    def with_data(self, entity: str, df: DataFrame) -> Workspace:
        return replace(self, data={**self.data, entity: df})

    def issues(self) -> DataFrame | None:
        """(code, entity, member, id) of everything that breaks the model.

        One pass over each entity finds what a record shows by itself; repeated ids take a grouping and each
        relationship a join, of keys only.
        """
        out = []
        for e in self.model.entities:
            df, name = self[e.name], e.name
            known = {x.upper() for x in e.columns}
            extra = [c for c in df.columns if c.upper() not in known]
            issue = lambda code, member: F.struct(F.lit(code).alias("code"), F.lit(member).alias("member"))
            tests = [(F.col(f"`{c}`").isNotNull(), "instance.relationship.unknown" if c.endswith("Id") else "instance.property.unknown", c) for c in extra]
            blank = F.col("Id").isNull() | (F.trim("Id") == "")
            tests += [(blank, "instance.id.missing", "Id"), (~blank & ~F.col("Id").rlike(ID_PATTERN), "instance.id.invalid", "Id")]
            tests += [(F.col(p.name).isNull(), "instance.required.missing", p.name) for p in e.properties if p.required]
            tests += [(F.col(r.column).isNull(), "instance.relationship.missing", r.column) for r in e.relationships if r.required]
            wrong = F.filter(F.array(*[F.when(test, issue(code, member)) for test, code, member in tests]), lambda x: x.isNotNull())
            out.append(df.select(F.lit(name).alias("entity"), F.col("Id").alias("id"), F.explode(wrong).alias("w")).select("w.code", "entity", "w.member", "id"))
            say = lambda d, code, member, name=name: d.select(F.lit(code).alias("code"), F.lit(name).alias("entity"), F.lit(member).alias("member"), F.col("Id").alias("id"))
            twice = df.where(F.col("Id").isNotNull()).groupBy(F.upper("Id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("Id").alias("Id")).where("n > 1")
            out.append(say(twice, "instance.id.duplicate", "Id"))
            for r in e.relationships:
                targets = self[r.entity].select(F.upper("Id").alias("_target"))
                out.append(say(df.where(F.col(r.column).isNotNull()).select("Id", r.column).join(targets, F.upper(F.col(r.column)) == F.col("_target"), "left_anti"), "instance.relationship.orphan", r.column))
        result = None
        for d in out:
            result = d if result is None else result.unionByName(d)
        return result
