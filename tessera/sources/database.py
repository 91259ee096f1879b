"""Workspaces in a database: reading in parts that agree on one state, and writing that leaves the old rows if it fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Entity, Model, Workspace, dependency_order
from ..operators.ranges import kept
from .shards import content_digest
from .tables import _name

RETRIES = 3
#: Lengths of the columns of ids and references, and of properties, in new tables.
ID_CHARS, TEXT_CHARS = 450, 4000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ask(spark: SparkSession, url: str, sql: str, options: dict) -> list:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()


# reading


def id_ranges(spark: SparkSession, url: str, table: str, parts: int, **options: str) -> list[str]:
    """Conditions that deal a table's rows to parts by Id, whatever its type and the database's order of texts.

    The cuts are the ids at equal distances in that order: one row for each is asked for, and the index answers.
    """
    key = _name("Id")
    (total,) = _ask(spark, url, f"SELECT COUNT(*) AS n FROM {table}", options)[0]
    places = sorted({i * int(total) // parts for i in range(1, parts)} - {0})
    cuts: list[str] = []
    for at in places:
        found = _ask(spark, url, f"SELECT {key} AS k FROM {table} ORDER BY {key} OFFSET {at} ROWS FETCH NEXT 1 ROWS ONLY", options)
        cut = found[0][0] if found else None  # a database may change the case of names
        if cut is not None:
            literal = _quoted(cut) if isinstance(cut, str) else str(cut)
            if literal not in cuts:
                cuts.append(literal)
    if not cuts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *inner, f"{key} >= {cuts[-1]}"]


def _state(spark: SparkSession, url: str, tables: Sequence[str], version: str | None, options: dict) -> list[tuple]:
    key = _name("Id")
    asked = [version] if version else [f"SELECT COUNT(*) AS n, MIN({key}) AS a, MAX({key}) AS b FROM {t}" for t in tables]
    return [tuple(r) for sql in asked for r in _ask(spark, url, sql, options)]


def snapshot(spark: SparkSession, model: Model, url: str, schema: str = "dbo", parts: int = 8, version: str | None = None, meanwhile: Callable[[], None] | None = None, **options: str) -> Workspace:
    """All entities as of one state of the database, each read through parts connections.

    Parts are read in their own transactions, so the state is asked before and after: by the query version, which
    should give another row after any write (a change-tracking number, say), else by the counts and ends of ids of
    all tables, which don't show cells that change. Where it differs what was read is dropped and read again, RETRIES
    times; then it faults. The rows are stored in the shared folder, so later work asks the database nothing.
    meanwhile is called after each reading, for tests.
    """
    names = {e.name: _name(schema, e.name) for e in model.entities}
    for _ in range(RETRIES):
        before = _state(spark, url, list(names.values()), version, options)
        data = {}
        for e in model.entities:
            df = spark.read.jdbc(url, names[e.name], predicates=id_ranges(spark, url, names[e.name], parts, **options), properties=options)
            data[e.name] = kept(df.select(*[F.col(c).cast("string").alias(c) for c in e.columns]), "snapshot")
        if meanwhile is not None:
            meanwhile()
        if _state(spark, url, list(names.values()), version, options) == before:
            return Workspace(model, data)
    raise RuntimeError("SnapshotChanged: the database was written to during every reading")


# writing


@contextmanager
def _transaction(spark: SparkSession, url: str, options: dict) -> Iterator:
    """A connection of the driver's: committed at the end, rolled back on any fault."""
    if options.get("driver"):
        spark._jvm.java.lang.Class.forName(options["driver"])
    given = spark._jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, str(v))
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _run(connection, sql: str) -> None:
    statement = connection.createStatement()
    statement.execute(sql)
    statement.close()


def _number(connection, sql: str) -> int:
    statement = connection.createStatement()
    rows = statement.executeQuery(sql)
    rows.next()
    n = rows.getLong(1)
    statement.close()
    return n


def _ordered(model: Model) -> list[Entity]:
    """Entities after those that they refer to; those on a cycle last."""
    order, cycle = dependency_order({e.name: [r.entity for r in e.relationships] for e in model.entities})
    return [model.entity(n) for n in [*order, *cycle]]


def create_tables(spark: SparkSession, model: Model, url: str, schema: str = "dbo", keys: bool = True, **options: str) -> None:
    """A table for each entity, in one transaction: Id as primary key, required members not null, references as foreign keys."""
    with _transaction(spark, url, options) as c:
        for e in _ordered(model):
            _run(c, _create(e, _name(schema, e.name), schema if keys else None))


def _chars(e: Entity) -> dict[str, int]:
    return {"Id": ID_CHARS} | {p.name: TEXT_CHARS for p in e.properties} | {r.column: ID_CHARS for r in e.relationships}


def _create(e: Entity, table: str, keys_in: str | None, marks: int = 0) -> str:
    """CREATE TABLE; marks are characters by which optional columns are longer."""
    free = _optional(e)
    lines = [f"{_name(c)} VARCHAR({n + marks * (c in free)}){'' if c in free else ' NOT NULL'}" for c, n in _chars(e).items()]
    if keys_in is not None:
        lines.append(f"PRIMARY KEY ({_name('Id')})")
        lines += [f"FOREIGN KEY ({_name(r.column)}) REFERENCES {_name(keys_in, r.entity)} ({_name('Id')})" for r in e.relationships]
    return f"CREATE TABLE {table} ({', '.join(lines)})"


def _optional(e: Entity) -> set[str]:
    return {p.name for p in e.properties if not p.required} | {r.column for r in e.relationships if not r.required}


def _staged(ws: Workspace, e: Entity, url: str, table: str, parts: int, options: dict) -> None:
    """Rows in their staging table, held against what was sent by a sum of row digests; repeated tasks show as extra rows.

    Spark writes a null under the type that its dialect has for texts, which some databases refuse, so optional cells
    are marked: - for null, + before a value.
    """
    marked = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-")).alias(c) if c in _optional(e) else F.col(c)
    rows, spark = ws[e.name].select(*[marked(c) for c in e.columns]), ws[e.name].sparkSession
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
    back: DataFrame = spark.read.jdbc(url, table, predicates=id_ranges(spark, url, table, parts, **options), properties=options)
    sent, found = (df.agg(content_digest(e.columns).alias("d")).first().d for df in (rows, back.toDF(*e.columns)))
    if sent != found:
        raise RuntimeError(f"WriteVerificationFailed: {e.name}")


def _source(e: Entity, table: str) -> str:
    """A staging table's rows as they were sent."""
    plain = lambda c: f"CASE WHEN {_name(c)} = '-' THEN NULL ELSE {{fn SUBSTRING({_name(c)}, 2, {_chars(e)[c]})}} END AS {_name(c)}" if c in _optional(e) else _name(c)
    return f"(SELECT {', '.join(map(plain, e.columns))} FROM {table})"


def write(ws: Workspace, url: str, schema: str = "dbo", mode: str = "replace", parts: int = 8, **options: str) -> None:
    """Brings the tables to ws's records (replace), or adds and changes only (merge), all entities in one transaction.

    Executors write to staging tables beside the targets. Then one transaction, run by the database on its own
    tables, deletes what is gone (dependents first), updates what differs, inserts what is new (dependents last), and
    counts what is not as it was sent. Any fault, also in staging, leaves the old rows. Ids compare as the database
    compares them.
    """
    if mode not in ("replace", "merge"):
        raise ValueError(f"WriteModeInvalid: {mode}")
    spark = next(iter(ws.data.values())).sparkSession
    order, key = _ordered(ws.model), _name("Id")
    staging = {e.name: _name(schema, f"{e.name}__staging") for e in order}
    target = {e.name: _name(schema, e.name) for e in order}
    made: list[str] = []
    try:
        for e in order:
            with _transaction(spark, url, options) as c:
                _run(c, _create(e, staging[e.name], None, marks=1))
            made.append(e.name)
            _staged(ws, e, url, staging[e.name], parts, options)
        same = lambda e: " AND ".join(f"(t.{_name(x)} = s.{_name(x)} OR (t.{_name(x)} IS NULL AND s.{_name(x)} IS NULL))" for x in e.columns[1:]) or "1 = 1"
        with _transaction(spark, url, options) as c:
            for e in order:  # references first lead to rows that stay
                t, s = target[e.name], _source(e, staging[e.name])
                listed = ", ".join(map(_name, e.columns))
                _run(c, f"INSERT INTO {t} ({listed}) SELECT {listed} FROM {s} s WHERE {key} NOT IN (SELECT {key} FROM {t})")
            for e in order:
                t, s = target[e.name], _source(e, staging[e.name])
                apart = f"{key} IN (SELECT s.{key} FROM {s} s JOIN {t} t ON s.{key} = t.{key} WHERE NOT ({same(e)}))"
                if e.columns[1:]:
                    _run(c, f"UPDATE {t} SET " + ", ".join(f"{_name(x)} = (SELECT s.{_name(x)} FROM {s} s WHERE s.{key} = {t}.{key})" for x in e.columns[1:]) + f" WHERE {apart}")
            if mode == "replace":
                for e in reversed(order):
                    _run(c, f"DELETE FROM {target[e.name]} WHERE {key} NOT IN (SELECT {key} FROM {staging[e.name]})")
            for e in order:
                t, s = target[e.name], _source(e, staging[e.name])
                lost = _number(c, f"SELECT COUNT(*) FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM {t} t WHERE t.{key} = s.{key} AND {same(e)})")
                extra = _number(c, f"SELECT COUNT(*) FROM {t}") - _number(c, f"SELECT COUNT(*) FROM {s} s") if mode == "replace" else 0
                if lost or extra:
                    raise RuntimeError(f"WriteVerificationFailed: {e.name}")
    finally:
        for n in made:
            with _transaction(spark, url, options) as c:
                _run(c, f"DROP TABLE {staging[n]}")
