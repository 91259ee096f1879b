"""Shards, databases, imports and diffs through alignments: results, faults, and what stays as it was."""

import pytest
from pyspark.sql import functions as F

from tessera.model import Entity, Model, Property, Relationship, Workspace
from tessera.operators import diffs as D
from tessera.operators import ordering
from tessera.sources import database, files, imports, shards, tables

from .test_workspace import MODEL, rows, workspace

TREE = Model("T", (Entity("Kind", (Property("Name"),)), Entity("Node", (Property("Name"), Property("Note", False)), (Relationship("Kind"), Relationship("Node", "Parent"), Relationship("Node", "Friend", False)))))


def tree(spark, nodes, kinds=("k1", "k2")):
    return tables.from_rows(spark, TREE, {"Kind": [{"Id": k, "Name": k} for k in kinds], "Node": [dict(zip(("Id", "Name", "Note", "KindId", "ParentId", "FriendId"), n)) for n in nodes]})


# shards


def many(spark, n=60, changed=()):
    return workspace(spark, [{"Id": f"{'iI'[k % 2]}{k:03d}", "Name": f" <n{k}> é", "Note": "changed" if k in changed else None, "GroupId": "g1"} for k in range(n)])


def test_shards_are_reused_and_cut_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_RECORDS", 10)
    path = f"file://{tmp_path}/w"
    first = shards.publish(many(spark), path, "")
    assert len(first.shards["Item"]) == 6 and sum(s.records for s in first.shards["Item"].values()) == 60
    ws, version = shards.opened(spark, path, verify=True)
    assert version.fingerprint == first.fingerprint == shards.fingerprint(many(spark).with_data("Item", many(spark)["Item"].repartition(7)))
    assert all(rows(ws[e.name]) == rows(many(spark)[e.name].select(*e.columns)) for e in MODEL.entities)
    second = shards.publish(many(spark, changed={31}), path, first.fingerprint)
    apart = [i for i in first.shards["Item"] if first.shards["Item"][i] != second.shards["Item"][i]]
    assert len(apart) == 1 and first.shards["Group"] == second.shards["Group"] and second.number == 2
    assert rows(shards.opened(spark, path)[0]["Item"].where("Note is not null").select("Id")) == [("I031",)]
    third = shards.publish(many(spark, 200), path, second.fingerprint)
    assert third.cuts["Item"] != second.cuts["Item"] and max(s.records for s in third.shards["Item"].values()) <= 20
    assert shards.opened(spark, path, verify=True)[0]["Item"].count() == 200


def test_shards_tell_conflicts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    with pytest.raises(FileNotFoundError, match="WorkspaceNotFound"):
        shards.opened(spark, path)
    first = shards.publish(many(spark), path)
    shards.publish(many(spark, changed={1}), path, first.fingerprint)
    with pytest.raises(shards.WorkspaceConflict, match="WorkspaceFingerprintMismatch: expected"):
        shards.publish(many(spark, changed={2}), path, first.fingerprint)
    # one that comes while the shards are written
    write = shards._whole

    def meanwhile(model, found):
        monkeypatch.setattr(shards, "_whole", write)
        shards.publish(many(spark, changed={3}), path)
        return write(model, found)

    monkeypatch.setattr(shards, "_whole", meanwhile)
    with pytest.raises(shards.WorkspaceConflict, match="published meanwhile"):
        shards.publish(many(spark, changed={4}), path)
    assert rows(shards.opened(spark, path, verify=True)[0]["Item"].where("Note is not null").select("Id")) == [("I003",)]
    with pytest.raises(ValueError, match="WorkspaceInvalid: instance.relationship.orphan Item:i1"):
        shards.publish(workspace(spark, [{"Id": "i1", "Name": "x", "GroupId": "gone"}]), path)


def test_fingerprints_tell_cells_apart(spark):
    one = lambda **cells: shards.fingerprint(workspace(spark, [{"Id": "i", "Name": "n", "GroupId": "g1", **cells}]))
    assert len({one(), one(Note=""), one(Name="n\x1f", Note="x"), one(Name="n", Note="\x1fx"), one(Note="-"), one(GroupId="g2")}) == 6


# databases

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def derby(spark, request):
    url = f"jdbc:derby:memory:{request.node.name.replace('[', '_').replace(']', '_')};create=true"
    try:
        spark._jvm.java.lang.Class.forName(DRIVER["driver"])
        connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    except Exception:
        pytest.skip("no database driver here")
    yield url, lambda sql: connection.createStatement().execute(sql)
    connection.close()


def test_snapshot_in_parts(spark, derby):
    url, run = derby
    ws = many(spark, 90)
    database.create_tables(spark, MODEL, url, schema="", **DRIVER)
    database.write(ws, url, schema="", **DRIVER)
    ranges = database.id_ranges(spark, url, '"Item"', 5, **DRIVER)
    assert len(ranges) == 5 and all("'" in r for r in ranges)
    back = database.snapshot(spark, MODEL, url, schema="", parts=5, **DRIVER)
    assert all(rows(back[e.name]) == rows(ws[e.name].select(*e.columns)) for e in MODEL.entities)
    left = iter([lambda: run("""INSERT INTO "Group" ("Id", "Name") VALUES ('g8', 'late')"""), lambda: None])
    again = database.snapshot(spark, MODEL, url, schema="", parts=2, meanwhile=lambda: next(left)(), **DRIVER)
    assert "g8" in {r.Id for r in again["Group"].collect()}
    number = iter(range(9))
    with pytest.raises(RuntimeError, match="SnapshotChanged"):
        database.snapshot(spark, MODEL, url, schema="", version='SELECT MAX("Name") AS v FROM "Group"', meanwhile=lambda: run(f"""UPDATE "Group" SET "Name" = 'z{next(number)}' WHERE "Id" = 'g8'"""), **DRIVER)
    assert database.id_ranges(spark, url, '"Item"', 1, **DRIVER) == ["1 = 1"]


def test_writes_are_whole(spark, derby, monkeypatch):
    """Replaced, merged, and left alone where something fails before or within the transaction."""
    url, run = derby
    database.create_tables(spark, TREE, url, schema="", **DRIVER)
    read = lambda: rows(database.snapshot(spark, TREE, url, schema="", parts=3, **DRIVER)["Node"])
    old = tree(spark, [("a", "A", None, "k1", "a", None), ("b", "B", "x", "k1", "a", "a"), ("c", "C", None, "k2", "b", None)])
    database.write(old, url, schema="", **DRIVER)
    assert read() == rows(old["Node"])
    new = tree(spark, [("a", "A'2", "n", "k3", "a", "d"), ("d", "D", None, "k3", "a", None)], ("k1", "k3"))
    database.write(new, url, schema="", mode="merge", **DRIVER)
    assert read() == sorted([*rows(new["Node"]), ("b", "B", "x", "k1", "a", "a"), ("c", "C", None, "k2", "b", None)])
    database.write(new, url, schema="", **DRIVER)
    assert read() == rows(new["Node"]) and database.snapshot(spark, TREE, url, schema="", **DRIVER)["Kind"].count() == 2
    # the database refuses the references, after rows have been inserted
    with pytest.raises(Exception, match="(?i)constraint|foreign"):
        database.write(tree(spark, [("x", "X", None, "gone", "x", None)]), url, schema="", **DRIVER)
    assert read() == rows(new["Node"])
    # a staging table that does not hold what was sent
    real = database.content_digest
    calls = iter(range(99))
    monkeypatch.setattr(database, "content_digest", lambda c: F.concat(real(c), F.lit(str(next(calls)))))
    with pytest.raises(RuntimeError, match="WriteVerificationFailed: Kind"):
        database.write(old, url, schema="", **DRIVER)
    monkeypatch.setattr(database, "content_digest", real)
    assert read() == rows(new["Node"])
    database.write(old, url, schema="", **DRIVER)  # no staging table was left
    assert read() == rows(old["Node"])
    with pytest.raises(ValueError, match="WriteModeInvalid"):
        database.write(old, url, schema="", mode="append", **DRIVER)


# imports

OLD = [("a", "A", None, "k1", "a", None), ("b", "B", "x", "k1", "a", None)]


def table(spark, names, *lines):
    return spark.createDataFrame(lines, ", ".join(f"{n} string" for n in names.split()))


def test_import_into_an_entity(spark):
    df = table(spark, "id NAME Note KindId ParentId FriendId", ("z", "Z", None, "k2", "y", "B"), ("y", "Y", "n", "k1", "a", "z"), ("B", "B2", None, "k2", "y", None))
    plan = imports.import_plan(tree(spark, OLD), "node", df)
    got = [(r.step, r.operation, r.id, r.member, r.value, r.cells) for r in plan.orderBy("step").collect()]
    assert got == [
        (1, "SetProperty", "B", "Name", "B2", None),
        (2, "ClearProperty", "B", "Note", None, None),
        (3, "SetRelationship", "B", "KindId", "k2", None),
        (4, "ClearRelationship", "B", "FriendId", None, None),
        (5, "InsertRecord", "y", None, None, {"Name": "Y", "Note": "n", "KindId": "k1", "ParentId": "a"}),
        (6, "InsertRecord", "z", None, None, {"Name": "Z", "KindId": "k2", "ParentId": "y"}),
        (7, "SetRelationship", "z", "FriendId", "B", None),
        (8, "SetRelationship", "B", "ParentId", "y", None),
        (9, "SetRelationship", "y", "FriendId", "z", None),
    ]
    out = imports.imported(tree(spark, OLD), "Node", plan)
    assert rows(out["Node"]) == [("a", "A", None, "k1", "a", None), ("b", "B2", None, "k2", "y", None), ("y", "Y", "n", "k1", "a", "z"), ("z", "Z", None, "k2", "y", "B")]
    assert out.issues().isEmpty()


def test_import_of_a_new_entity(spark):
    plan = imports.import_plan(tree(spark, OLD), "Shape", table(spark, "Id Sides Color", ("q", "4", None), ("C", "0", "red")))
    assert [tuple(r)[1:] for r in plan.orderBy("step").collect()] == [("AddEntity", "Shape", None, None, None, None), ("AddProperty", "Shape", None, "Sides", "true", None), ("AddProperty", "Shape", None, "Color", "false", None), ("InsertRecord", "Shape", "C", None, None, {"Sides": "0", "Color": "red"}), ("InsertRecord", "Shape", "q", None, None, {"Sides": "4"})]
    out = imports.imported(tree(spark, OLD), "Shape", plan)
    assert rows(out["Shape"]) == [("C", "0", "red"), ("q", "4", None)] and out.issues().isEmpty()


@pytest.mark.parametrize(
    ("names", "line", "fault"),
    [
        ("Id Name Other", ("a", "x", "y"), "ImportColumnUnknown: Node.Other"),
        ("Id Name", ("b", None), "ImportRequiredPropertyBlank: Node.Name, row 'b'"),
        ("Id KindId", ("a", None), "ImportRequiredRelationshipBlank: Node.KindId, row 'a'"),
        ("Id KindId ParentId", ("n", "k1", "a"), "ImportRequiredPropertyColumnMissing: Node.Name, row 'n'"),
        ("Id Name ParentId", ("n", "x", "a"), "ImportRequiredRelationshipColumnMissing: Node.KindId, row 'n'"),
        ("Id Name KindId ParentId", ("n", "x", "k1", "n"), "RequiredRelationshipCycle: Node:N"),
        ("Id Name KindId ParentId", ("n", "x", "k1", "gone"), "RelationshipTargetMissing: Node:N"),
        ("Name", ("n",), "ImportIdColumnMissing"),
        ("Id Name", (None, "n"), "ImportIdMissing"),
    ],
)
def test_import_faults(spark, names, line, fault):
    with pytest.raises(ValueError, match=fault):
        imports.import_plan(tree(spark, OLD), "Node", table(spark, names, line)).collect()


# ordered plans


def test_ordered_plan_of_a_tree(spark):
    left = tree(spark, [("a", "A", None, "k1", "a", None), ("b", "B", None, "k1", "a", "c"), ("c", "C", None, "k1", "b", None)])
    right = tree(spark, [("A", "A", None, "k1", "a", "e"), ("e", "E", None, "k3", "d", "d"), ("d", "D", "n", "k3", "a", None)], ("k1", "k3"))
    plan = ordering.planned(left, right)
    assert [(r.operation, r.id) for r in plan.orderBy("step").collect()] == [
        ("RenameRecord", "a"),
        ("InsertRecord", "k3"),
        ("InsertRecord", "d"),
        ("InsertRecord", "e"),
        ("SetRelationship", "A"),
        ("SetRelationship", "e"),
        ("ClearRelationship", "b"),
        ("DeleteRecord", "c"),
        ("DeleteRecord", "k2"),
        ("DeleteRecord", "b"),
    ]


def test_ordered_plan_faults(spark):
    good = tree(spark, OLD)
    with pytest.raises(ValueError, match="RequiredRelationshipCycle: Node:X, Node:Y"):
        ordering.ordered_plan(good, tree(spark, [*OLD, ("x", "X", None, "k1", "y", None), ("y", "Y", None, "k1", "x", None)]))
    with pytest.raises(ValueError, match="SynchronizationModelMismatch"):
        ordering.ordered_plan(good, workspace(spark))
    broken = ordering.ordered_plan(good, tree(spark, [*OLD, ("x", "X", None, "k1", "b", None)])).where("operation <> 'InsertRecord'").unionByName(ordering.ordered_plan(good, tree(spark, OLD[:1])))
    with pytest.raises(ValueError, match="OperationStageInvalid: stage 6, instance.relationship.orphan"):
        ordering.applied(tree(spark, [*OLD, ("x", "X", None, "k1", "b", None)]), broken)


def test_levels_with_what_is_there(spark):
    new = tree(spark, [("x", "X", None, "k9", "a", None), ("y", "Y", None, "k1", "X", None), ("z", "Z", None, "k1", "b", None)], ("k9",))
    assert rows(ordering.record_levels(new, present=tree(spark, OLD))) == [("Kind", "k9", 0), ("Node", "x", 1), ("Node", "y", 2), ("Node", "z", 0)]
    with pytest.raises(ValueError, match="RequiredRelationshipValueMissing: Node:x"):
        ordering.record_levels(tree(spark, [("x", "X", None, None, "a", None)]), present=tree(spark, OLD))


# diffs through alignments

RIGHT = Model("R", (Entity("Team", (Property("Label"),)), Entity("Thing", (Property("Title", False), Property("Own")), (Relationship("Team"),))))


def sides(spark):
    left = workspace(spark, [{"Id": "i1", "Name": "x", "GroupId": "g1", "Note": "kept"}, {"Id": "i2", "Name": "y", "GroupId": "g2"}])
    right = tables.from_rows(spark, RIGHT, {"Team": [{"Id": "g1", "Label": "alpha"}, {"Id": "g3", "Label": "gamma"}], "Thing": [{"Id": "i1", "Title": "new", "Own": "o", "TeamId": "g3"}, {"Id": "i3", "Title": "z", "Own": "o", "TeamId": "g1"}]})
    return left, right


def maps(spark, members=None, entities=None):
    return D.alignment(MODEL, RIGHT, entities or {"Group": "Team", "Item": "Thing"}, members or {("Group", "Name"): "Label", ("Item", "Name"): "Title", ("Item", "GroupId"): "TeamId"}, spark)


def test_aligned_diff_and_merge(spark, tmp_path):
    left, right = sides(spark)
    diff = D.aligned_diff(left, right, maps(spark))
    assert diff.issues().isEmpty()
    gone = lambda n: {r.Id for r in diff[n].collect()}
    assert gone("ModelLeftEntityInstanceNotInRight") == {"Group:Team:g2", "Item:Thing:i2"} and gone("ModelRightEntityInstanceNotInLeft") == {"Group:Team:g3", "Item:Thing:i3"}
    assert gone("ModelLeftPropertyInstanceNotInRight") == {"Item:Thing:i1:Item:Name", "Item:Thing:i1:Item:GroupId"} == gone("ModelRightPropertyInstanceNotInLeft")
    # stored, read again, and merged by itself
    tables.to_parquet(diff, str(tmp_path / "diff"))
    out = D.merge_aligned(left, tables.from_parquet(spark, D.ALIGNED, str(tmp_path / "diff")))
    assert rows(out["Item"]) == [("i1", "new", "kept", "g3"), ("i3", "z", None, "g1")] and rows(out["Group"]) == [("g1", "alpha"), ("g3", "gamma")]
    assert ordering.planned(left, out).count() > 0
    with pytest.raises(ValueError, match="MergePreconditionFailed"):
        D.merge_aligned(out, diff)
    # without a map of the groups' names a new group would lack one
    part = D.aligned_diff(left, right, maps(spark, {("Item", "Name"): "Title", ("Item", "GroupId"): "TeamId"}))
    with pytest.raises(ValueError, match="MergeResultInvalid: instance.required.missing Group:g3"):
        D.merge_aligned(left, part)


def test_alignment_faults(spark):
    left, right = sides(spark)
    good = maps(spark)
    change = lambda table, df: Workspace(D.ALIGNMENT, {**good.data, table: df})
    twice = good["EntityMap"].unionByName(good["EntityMap"].limit(1).withColumn("Id", F.lit("again")))
    missing = good["PropertyMap"].withColumn("ModelLeftPropertyId", F.lit("gone"))
    crossing = good["PropertyMap"].where("Id = 'Item:Name'").withColumn("ModelRightPropertyId", F.lit("Team:Label"))
    unknown = good["ModelLeftProperty"].unionByName(good["ModelLeftProperty"].limit(1).withColumns({"Id": F.lit("new"), "Name": F.lit("Nope")}))
    for bad, code in ((change("EntityMap", twice), "AlignmentMappedTwice: EntityMap"), (change("PropertyMap", missing), "AlignmentTargetMissing: PropertyMap.ModelLeftPropertyId"), (change("PropertyMap", crossing), "AlignmentPropertyWithoutEntity"), (change("ModelLeftProperty", unknown), "AlignmentModelMismatch: Group.Nope"), (change("Alignment", good["Alignment"].limit(0)), "AlignmentCountInvalid")):
        with pytest.raises(ValueError, match=code):
            D.aligned_diff(left, right, bad)
    with pytest.raises(ValueError, match="DiffContractMismatch"):
        D.aligned_diff(left, right, left)


def test_read_faults_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Name\n1,x\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert imports.import_plan(Workspace(Model("E")), "New", df).count() == 3
