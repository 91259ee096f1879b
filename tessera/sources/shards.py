"""Workspaces published as XML shards: records dealt to files by ranges of ids, one manifest a version, unchanged files kept.

A folder holds shards/<entity>/..., which are never changed, and manifests 00000001, 00000002 ... that list them. A
manifest is created, not replaced, so of two writers that started from one version only the first publishes; the
other faults. A reader takes the last manifest and sees a whole version, whatever is written meanwhile.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fold
from ..model import Entity, Model, Workspace
from ..operators.ranges import _cuts, _range_of
from .files import model_xml, read_model

#: Records of a shard when its entity is dealt anew; an entity is dealt anew when a shard has twice as many.
SHARD_RECORDS = 250_000
RETRIES = 3


class WorkspaceConflict(RuntimeError):
    """Somebody else has published meanwhile; args[0] starts with its code."""


@dataclass(frozen=True)
class Shard:
    """Records whose folded ids lie from one cut to the next."""

    path: str
    records: int
    digest: str


@dataclass(frozen=True)
class Version:
    """A published version: number 0 is an empty folder's."""

    number: int
    fingerprint: str
    model: Model | None
    cuts: dict[str, list[str]]
    shards: dict[str, dict[int, Shard]]


# fingerprints


def row_digest(columns: list[str]) -> list[Column]:
    """Two 64-bit numbers of a row's MD5, as decimals that add up without overflow; nulls and '' differ."""
    cells = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("+"), F.char_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns])
    text = F.md5(cells)
    part = lambda at: F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)")
    return [part(1), part(17)]


def content_digest(columns: list[str]) -> Column:
    """Aggregate: a text that tells multisets of rows apart, whatever their order or partitions."""
    high, low = row_digest(columns)
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").cast("string") for x in (high, low)]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums)


def fingerprint(ws: Workspace) -> str:
    """A digest of a workspace's model and records; one pass over each entity, no order."""
    parts = [ws.model.signature()]
    for e in sorted(ws.model.entities, key=lambda e: e.name):
        parts.append(f"{e.name}|{ws[e.name].agg(content_digest(e.columns).alias('d')).first().d}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _whole(model: Model, shards: dict[str, dict[int, Shard]]) -> str:
    """fingerprint() from the digests of shards, whose parts add up."""
    parts = [model.signature()]
    for e in sorted(model.entities, key=lambda e: e.name):
        found = [tuple(map(int, s.digest.split(":"))) for s in shards.get(e.name, {}).values()]
        parts.append(f"{e.name}|{':'.join(str(sum(x)) for x in zip(*found)) if found else '0:0:0'}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


# manifests


def _files(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them: any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest_name(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/manifests/{number:08d}"


def _last_number(spark: SparkSession, path: str) -> int:
    fs, at = _files(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def last_version(spark: SparkSession, path: str) -> Version:
    """The version that the last manifest lists."""
    number = _last_number(spark, path)
    if not number:
        return Version(0, "", None, {}, {})
    said = json.loads(spark.read.text(_manifest_name(path, number), wholetext=True).first().value)
    shards = {n: {int(i): Shard(*s) for i, s in own.items()} for n, own in said["shards"].items()}
    return Version(number, said["fingerprint"], read_model(said["model"]), said["cuts"], shards)


def _publish(spark: SparkSession, path: str, v: Version) -> None:
    said = {"fingerprint": v.fingerprint, "model": model_xml(v.model), "cuts": v.cuts, "shards": {n: {str(i): [s.path, s.records, s.digest] for i, s in own.items()} for n, own in v.shards.items()}}
    fs, at = _files(spark, _manifest_name(path, v.number))
    # written aside and renamed: a rename onto a name that exists fails, and no reader sees half a manifest
    _, aside = _files(spark, f"{path.rstrip('/')}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise WorkspaceConflict(f"WorkspaceFingerprintMismatch: version {v.number} was published meanwhile")


# shards


def _cut(df: DataFrame, e: Entity, before: Version) -> list[str]:
    """The entity's cuts: those of the version before while no shard has outgrown them, else new ones."""
    key, cuts = fold("Id"), before.cuts.get(e.name)
    count = df.count()
    if cuts is not None:
        largest = df.withColumn("_shard", _range_of(key, cuts) if cuts else F.lit(0)).groupBy("_shard").count().agg(F.max("count")).first()[0] or 0
        if largest <= 2 * SHARD_RECORDS:
            return cuts
    return _cuts(df.where(key.isNotNull()).select(key.alias("k")), count, -(-count // SHARD_RECORDS)) if count > SHARD_RECORDS else []


def publish(ws: Workspace, path: str, expected: str | None = None) -> Version:
    """Publishes a valid workspace as the next version and gives it.

    expected is the fingerprint of the version that it was made from ('' for an empty folder): another one there
    faults before anything is written, and one that comes while shards are written faults at the manifest. Shards
    whose records are those of the version before are listed again, not written. Ids within a shard are sorted.
    """
    spark = next(iter(ws.data.values())).sparkSession
    issues = ws.issues()
    if issues is not None and (wrong := issues.limit(5).collect()):
        raise ValueError("WorkspaceInvalid: " + " | ".join(f"{r.code} {r.entity}:{r.id}" for r in wrong))
    before = last_version(spark, path)
    if expected is not None and before.fingerprint != expected:
        raise WorkspaceConflict(f"WorkspaceFingerprintMismatch: expected '{expected}', found '{before.fingerprint}'")
    cuts: dict[str, list[str]] = {}
    shards: dict[str, dict[int, Shard]] = {}
    for e in ws.model.entities:
        own = cuts[e.name] = _cut(ws[e.name], e, before)
        at = ws[e.name].select(*e.columns).withColumn("_shard", _range_of(fold("Id"), own) if own else F.lit(0))
        now = {r._shard: r.d for r in at.groupBy("_shard").agg(content_digest(e.columns).alias("d")).collect()}  # a row for each shard
        known = {}
        if before.model is not None and before.cuts.get(e.name) == own and e in before.model.entities:
            known = {i: s for i, s in before.shards.get(e.name, {}).items() if now.get(i) == s.digest}
        changed = sorted(set(now) - set(known))
        home = f"{path.rstrip('/')}/shards/{e.name}/{uuid.uuid4().hex}"
        if changed:
            names = {"Id": "_Id"} | {r.column: f"_{r.column}" for r in e.relationships}
            fresh = at.where(F.col("_shard").isin(changed)).repartition(len(changed), "_shard").sortWithinPartitions("_shard", fold("Id"), "Id")
            fresh.select(*[F.col(c).alias(names.get(c, c)) for c in e.columns], "_shard").write.partitionBy("_shard").format("xml").options(rowTag=e.name, rootTag=f"{e.name}List").save(home)
        shards[e.name] = known | {i: Shard(f"{home}/_shard={i}", int(now[i].split(":")[0]), now[i]) for i in changed}
    version = Version(before.number + 1, _whole(ws.model, shards), ws.model, cuts, shards)
    _publish(spark, path, version)
    return version


def _rows(spark: SparkSession, e: Entity, paths: list[str]) -> DataFrame:
    names = ["_Id", *[p.name for p in e.properties], *[f"_{r.column}" for r in e.relationships]]
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.format("xml").options(rowTag=e.name, nullValue="\x00", ignoreSurroundingSpaces="false").schema(schema).load(paths) if paths else spark.createDataFrame([], schema)
    return df.select(*[F.col(f"`{n}`").alias(n.removeprefix("_")) for n in names]).select(*e.columns)


def opened(spark: SparkSession, path: str, verify: bool = False) -> tuple[Workspace, Version]:
    """The last version, lazily read. A file that is gone, as after a folder was cleaned, is looked for again in the
    version that is the last by then, RETRIES times. verify reads everything once and holds it against the fingerprint."""
    for left in range(RETRIES, 0, -1):
        version = last_version(spark, path)
        if not version.number:
            raise FileNotFoundError(f"WorkspaceNotFound: {path}")
        lost = [s.path for own in version.shards.values() for s in own.values() if not _there(spark, s.path)]
        if not lost:
            break
        if left == 1:
            raise FileNotFoundError(f"WorkspaceShardMissing: {lost[0]}")
    ws = Workspace(version.model, {e.name: _rows(spark, e, [s.path for s in version.shards.get(e.name, {}).values()]) for e in version.model.entities})
    if verify and (found := fingerprint(ws)) != version.fingerprint:
        raise ValueError(f"WorkspaceFingerprintMismatch: listed '{version.fingerprint}', read '{found}'")
    return ws, version


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)
