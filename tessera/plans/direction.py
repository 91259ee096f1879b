"""Conversions from several source workspaces to one target: requirements, shared relations, transformations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NAME, Model, Workspace, dependency_order

Step = Callable[["Context"], DataFrame]


class DirectionFault(ValueError):
    """A direction that can't be run; args[0] starts with its code."""


class Context:
    """What a step sees: sources by role, text parameters, and named relations, each built once when first asked for."""

    def __init__(self, sources: Mapping[str, Workspace], parameters: Mapping[str, str], relations: Mapping[str, Step]):
        self.sources, self.parameters, self._steps = sources, parameters, dict(relations)
        self._built: dict[str, DataFrame] = {}
        self._open: list[str] = []

    def source(self, entity: str, role: str | None = None) -> DataFrame:
        """An entity of a role, or of the one source that has it."""
        if role is not None:
            if role not in self.sources:
                raise DirectionFault(f"SourceRoleNotFound: {role}")
            return self.sources[role][entity]
        found = [w for w in self.sources.values() if any(e.name.upper() == entity.upper() for e in w.model.entities)]
        if len(found) != 1:
            raise DirectionFault(("SourceEntityAmbiguous" if found else "SourceEntityNotFound") + f": {entity}")
        return found[0][entity]

    def relation(self, name: str) -> DataFrame:
        if name in self._open:
            raise DirectionFault(f"NamedRelationRecursive: {' -> '.join([*self._open, name])}")
        if name not in self._steps:
            raise DirectionFault(f"NamedRelationNotFound: {name}")
        if name not in self._built:
            self._open.append(name)
            df = self._steps[name](self)
            self._open.pop()
            if len({c.upper() for c in df.columns}) != len(df.columns):
                raise DirectionFault(f"NamedRelationColumnsInvalid: {name}")
            self._built[name] = df
        return self._built[name]


@dataclass
class Direction:
    """target: the model to build; transformations: a step for each entity; requirements: (message, step) by name.

    roles name the sources; models gives the name of the model that a role's workspace must have, if it matters.
    """

    target: Model
    transformations: Mapping[str, Step]
    requirements: Mapping[str, tuple[str, Step]] = field(default_factory=dict)
    relations: Mapping[str, Step] = field(default_factory=dict)
    parameters: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    models: Mapping[str, str] = field(default_factory=dict)

    def issues(self, sources: Mapping[str, Workspace], parameters: Mapping[str, str | None] | None = None) -> list[tuple[str, str]]:
        """(code, name) of everything that is wrong with the declarations, or between them and what is supplied, in a fixed order."""
        given = dict(parameters or {})
        out = [] if self.roles else [("DirectionSourceWorkspacesMissing", "")]
        out += [] if sources else [("SourceWorkspacesMissing", "")]
        for kind, value, declared, supplied in (("SourceWorkspace", "SourceWorkspace", self.roles, sources), ("StringParameter", "ParameterValue", self.parameters, given)):
            seen: set[str] = set()
            for name in declared:
                if not NAME.fullmatch(name or ""):
                    out.append((f"{kind}NameInvalid", name))
                elif name.upper() in seen:
                    out.append((f"{kind}NameDuplicate", name))
                elif name.upper() not in {x.upper() for x in supplied}:
                    out.append((f"{value}Missing", name))
                seen.add((name or "").upper())
            out += [(f"{value}Unexpected", name) for name in sorted(supplied) if name.upper() not in seen]
        out += [("ParameterValueInvalid", name) for name in sorted(given) if given[name] is None]
        out += [("SourceModelMismatch", role) for role, name in sorted(self.models.items()) if role in sources and sources[role].model.name.upper() != name.upper()]
        known = {e.name.upper() for e in self.target.entities}
        out += [("TargetEntityNotFound", name) for name in sorted(self.transformations) if name.upper() not in known]
        return out

    def validation(self, sources: Mapping[str, Workspace], parameters: Mapping[str, str | None] | None = None) -> DataFrame:
        """(code, subject, records): issues(), and what the supplied workspaces' own records break, counted by code and member."""
        spark = next(df for ws in sources.values() for df in ws.data.values()).sparkSession
        out = spark.createDataFrame([(c, n, None) for c, n in self.issues(sources, parameters)], "code string, subject string, records long")
        for role, ws in sorted(sources.items()):
            found = ws.issues()
            if found is not None:
                subject = F.concat(F.lit(f"{role}:"), "entity", F.lit("."), "member").alias("subject")
                out = out.unionByName(found.groupBy("code", subject).agg(F.count(F.lit(1)).alias("records")))
        return out

    def context(self, sources: Mapping[str, Workspace], parameters: Mapping[str, str] | None = None) -> Context:
        given = dict(parameters or {})
        for code, want, have in (("Parameter", self.parameters, given), ("SourceRole", self.roles, sources)):
            if missing := sorted(set(want) - set(have)):
                raise DirectionFault(f"{code}Missing: {missing[0]}")
            if extra := sorted(set(have) - set(want)):
                raise DirectionFault(f"{code}Undeclared: {extra[0]}")
        return Context(sources, given, self.relations)

    def violations(self, ctx: Context) -> DataFrame | None:
        """(requirement, message) for every row that a requirement returns: the message with its values."""
        out = None
        for name in sorted(self.requirements):
            message, step = self.requirements[name]
            df = step(ctx)
            shown = F.concat_ws(", ", *[F.concat(F.lit(c + "="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))) for c in df.columns])
            part = df.select(F.lit(name).alias("requirement"), F.concat(F.lit(message + " ("), shown, F.lit(")")).alias("message"))
            out = part if out is None else out.unionByName(part)
        return out

    def run(self, sources: Mapping[str, Workspace], parameters: Mapping[str, str] | None = None, progress: Callable[[int, int, str, str], None] | None = None, shown: int = 100) -> Workspace:
        """The target workspace. A violation stops it (with up to shown messages), and so does a broken record."""
        ctx = self.context(sources, parameters)
        total = len(self.requirements) + len(self.relations) + len(self.transformations)
        done = 0

        def tell(kind: str, name: str) -> None:
            nonlocal done
            done += 1
            if progress:
                try:
                    progress(done, total, kind, name)
                except Exception:  # noqa: BLE001, S110  a listener never stops the work
                    pass

        bad = self.violations(ctx)
        found = bad.limit(shown).collect() if bad is not None else []
        for name in sorted(self.requirements):
            tell("requirement", name)
        if found:
            raise DirectionFault("RequirementViolated: " + "; ".join(sorted(r.message for r in found)))
        for name in sorted(self.relations):
            ctx.relation(name)
            tell("relation", name)
        order, cycle = dependency_order({e.name: [r.entity for r in e.relationships] for e in self.target.entities})
        if cycle:
            raise DirectionFault(f"TargetOrderCycle: {', '.join(cycle)}")
        data = {}
        for name in order:
            e = self.target.entity(name)
            if name in self.transformations:
                data[name] = _aligned(self.transformations[name](ctx), e.columns, name)
                tell("transformation", name)
            else:
                spark = next(iter(next(iter(sources.values())).data.values())).sparkSession
                data[name] = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in e.columns))
        out = Workspace(self.target, data)
        issues = out.issues()
        if issues is not None and (row := issues.first()) is not None:
            raise DirectionFault(f"TargetInstantiationFailed: {row.code} {row.entity}.{row.member} {row.id}")
        return out


def _aligned(df: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """Columns in the target's order and spelling; absent members are null, unknown or repeated ones fault."""
    given = {c.upper(): c for c in df.columns}
    if len(given) != len(df.columns):
        raise DirectionFault(f"TargetColumnDuplicate: {entity}")
    if "ID" not in given:
        raise DirectionFault(f"TargetIdMissing: {entity}")
    if unknown := sorted(set(given) - {c.upper() for c in columns}):
        raise DirectionFault(f"TargetColumnUnknown: {entity}.{given[unknown[0]]}")
    return df.select(*[(F.col(f"`{given[c.upper()]}`") if c.upper() in given else F.lit(None)).cast("string").alias(c) for c in columns])
