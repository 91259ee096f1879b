import pytest
from pyspark.sql import functions as F

from tessera.model import Entity, Model, Property, Relationship, Workspace
from tessera.operators import diffs as D
from tessera.operators import graph
from tessera.operators import operations as O
from tessera.operators import services as V
from tessera.plans.direction import Direction, DirectionFault
from tessera.sources import files, tables

MODEL = Model("M", (Entity("Group", (Property("Name"),)), Entity("Item", (Property("Name"), Property("Note", False)), (Relationship("Group"),))))


def workspace(spark, items=None):
    return tables.from_rows(spark, MODEL, {"Group": [{"Id": "g1", "Name": "alpha"}, {"Id": "g2", "Name": "beta"}], "Item": items or [{"Id": "i1", "Name": "x", "GroupId": "G1"}, {"Id": "i2", "Name": "y", "GroupId": "g2", "Note": "n"}]})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_model_issues():
    bad = Model("1", (Entity("A", (Property("Id"), Property("x"), Property("X")), (Relationship("B"), Relationship("a"), Relationship("Gone"))), Entity("B", (), (Relationship("A"),))))
    codes = {c for c, _ in bad.issues()}
    assert codes >= {"model.name.invalid", "property.id.explicit", "property.duplicate", "relationship.target.missing", "relationship.target.spelling", "relationship.cycle"}
    assert MODEL.issues() == []
    assert MODEL.signature() == Model("M", MODEL.entities[::-1]).signature()


def test_instance_issues(spark):
    ws = workspace(spark, [{"Id": "i1", "Name": "x", "GroupId": "nope"}, {"Id": "I1", "Name": None, "GroupId": None}, {"Id": " ", "Name": "z", "GroupId": "g1"}, {"Id": "ä", "Name": "z", "GroupId": "g1"}])
    assert {r.code for r in ws.issues().collect()} == {"instance.relationship.orphan", "instance.id.duplicate", "instance.required.missing", "instance.relationship.missing", "instance.id.missing", "instance.id.invalid"}
    assert workspace(spark).issues().isEmpty()


def test_operations(spark):
    ws = workspace(spark)
    out = O.execute(ws, [O.rename_record("Group", "G1", "g9"), O.rename_entity("Group", "Team"), O.add_property("Item", Property("Size"), "1"), O.set_property("Item", "i1", "Size", "2")], batch=True)
    assert rows(out["Item"].select("Id", "TeamId", "Size")) == [("i1", "g9", "2"), ("i2", "g2", "1")]
    assert rows(ws["Group"]) == [("g1", "alpha"), ("g2", "beta")]
    with pytest.raises(O.OperationFault, match="instance.relationship.orphan"):
        O.execute(ws, [O.delete_record("Group", "g1")])
    with pytest.raises(O.OperationFault, match="entity.referenced"):
        O.execute(ws, [O.remove_entity("Group")])
    more = O.execute(ws, [O.insert_record("Group", "g3", Name="c"), O.set_relationship("Item", "i1", "GroupId", "g3"), O.clear_property("Item", "i2", "Note"), O.rename_relationship("Item", "GroupId", "Home"), O.rename_property("Item", "Name", "Title"), O.set_property_required("Item", "Note", True, "-")])
    assert rows(more["Item"]) == [("i1", "x", "-", "g3"), ("i2", "y", "-", "g2")]
    assert more["Item"].columns == ["Id", "Title", "Note", "HomeId"]


def test_refactors(spark):
    ws = O.relationship_to_property("Item", "GroupId")(workspace(spark))
    assert [p.name for p in ws.model.entity("Item").properties] == ["Name", "Note", "GroupId"]
    back = O.property_to_relationship("Item", "GroupId", "Group")(ws)
    assert rows(back["Item"].select("Id", "GroupId")) == [("i1", "g1"), ("i2", "g2")]
    by_name = O.set_property("Item", "i1", "Note", "beta")(workspace(spark))
    by_name = O.set_property("Item", "i2", "Note", "alpha")(by_name)
    linked = O.property_to_relationship("Item", "Note", "Group", lookup="Name", role="Other")(by_name)
    assert rows(linked["Item"].select("Id", "OtherId")) == [("i1", "g2"), ("i2", "g1")]
    with pytest.raises(O.OperationFault, match="lookup.incomplete"):
        O.property_to_relationship("Item", "Name", "Group", lookup="Name", role="Other")(workspace(spark))


def test_diff_merge_sync(spark):
    left = workspace(spark)
    right = O.set_property("Item", "i1", "Note", "new")(O.delete_record("Item", "i2")(O.insert_record("Item", "i3", Name="z", GroupId="g1")(left)))
    assert rows(V.diff_rows(left, right)) == [("left", "Item", "i2"), ("right", "Item", "i3")]
    assert rows(V.diff_cells(left, right)) == [("right", "Item", "i1", "Note", "new")]
    assert {(r.operation, r.id) for r in V.sync_plan(left, right, "Item").collect()} == {("DeleteRecord", "i2"), ("InsertRecord", "i3"), ("SetProperty", "i1"), ("SetProperty", "i3"), ("SetRelationship", "i3")}
    assert rows(V.merge(left, left, right)["Item"]) == rows(right["Item"])
    with pytest.raises(ValueError, match="MergePreconditionFailed"):
        V.merge(right, left, right)
    with pytest.raises(ValueError, match="MergeEntityCollision"):
        V.combine("x", [left, right])


def test_queries_and_pages(spark):
    ws = workspace(spark)
    n, found = V.query_records(ws["Item"], [("Name", "Contains", "X"), ("Note", "Equal", "")])
    assert (n, rows(found.select("Id"))) == (1, [("i1",)])
    assert rows(V.page(ws["Group"], 99, 1).select("Id")) == [("g2",)]
    with pytest.raises(ValueError, match="PageSizeInvalid"):
        V.page(ws["Group"], 0, 0)
    assert rows(V.references(ws, "Item", "I2")) == [("i2", "GroupId", "Group", "g2")]


def test_profile_and_suggestions(spark):
    model = Model("S", (Entity("Product", (Property("Name"),)), Entity("Order", (Property("Number"), Property("ProductId"), Property("Text", False)))))
    ws = tables.from_rows(spark, model, {"Product": [{"Id": f"p{i}", "Name": f"n{i}"} for i in range(4)], "Order": [{"Id": str(i), "Number": f"o{i}", "ProductId": f"p{i % 3}", "Text": "" if i else None} for i in range(5)]})
    keys = {(r.entity, r.property): r.score for r in V.business_keys(ws).collect()}
    assert keys == {("Product", "Name"): 0.95, ("Order", "Number"): 1.0}
    (s,) = V.lookup_suggestions(ws).collect()
    assert (s.entity, s.property, s.target, s.weak, s.matched_rows, s.blockers, s.score) == ("Order", "ProductId", "Product", False, 5, 0, 1.0)


def test_graph(spark):
    m = graph.measures(*graph.model_graph(spark, MODEL)).first()
    assert (m.components, m.max_depth, m.roots, m.sinks, m.loops) == (1, 1, "Item", "Group", 0)
    loop = Model("L", (Entity("A", (), (Relationship("B", required=False),)), Entity("B", (), (Relationship("A", required=False),)), Entity("C")))
    m = graph.measures(*graph.model_graph(spark, loop)).first()
    assert (m.components, m.max_depth, m.loops, m.isolated) == (2, None, 1, "C")
    nodes, edges = graph.record_graph(workspace(spark))
    assert rows(nodes) == [("Group",), ("Item",)] and rows(edges) == [("Item", "Group", "GroupId", 2)]


def direction(**more):
    target = Model("T", (Entity("Category", (Property("Name"),)), Entity("Thing", (Property("Name"),), (Relationship("Category"),))))
    steps = {"Thing": lambda c: c.relation("Things"), "Category": lambda c: c.source("Group").select("Id", "Name")}
    return Direction(target, steps, relations={"Things": lambda c: c.source("Item").select("Id", F.upper("Name").alias("name"), F.col("GroupId").alias("CategoryId"))}, roles=("m",), **more)


def test_direction(spark):
    ws, told = workspace(spark), []
    out = direction().run({"m": ws}, progress=lambda *x: told.append(x))
    assert rows(out["Thing"]) == [("i1", "X", "G1"), ("i2", "Y", "g2")]
    assert [x[2] for x in told] == ["relation", "transformation", "transformation"]
    bad = direction(requirements={"r": ("has note", lambda c: c.source("Item").where("Note is not null").select("Id"))})
    with pytest.raises(DirectionFault, match=r"has note \(Id=i2\)"):
        bad.run({"m": ws})
    with pytest.raises(DirectionFault, match="SourceRoleMissing"):
        direction().run({})
    loop = direction()
    loop.relations = {"Things": lambda c: c.relation("Other"), "Other": lambda c: c.relation("Things")}
    with pytest.raises(DirectionFault, match="NamedRelationRecursive"):
        loop.run({"m": ws})
    two = direction()
    two.roles = ("m", "n")
    with pytest.raises(DirectionFault, match="SourceEntityAmbiguous"):
        two.run({"m": ws, "n": ws})
    orphan = direction()
    orphan.transformations = {**orphan.transformations, "Category": lambda c: c.source("Group").where("Id = 'g1'").select("Id", "Name")}
    with pytest.raises(DirectionFault, match="TargetInstantiationFailed: instance.relationship.orphan"):
        orphan.run({"m": ws})


def test_direction_issues(spark):
    """Every issue at once, and what the sources' records break."""
    d = Direction(MODEL, {"Nope": lambda c: None}, parameters=("a", "A", "1x", "b"), roles=("m", "m", "", "n"), models={"m": "Other"})
    ws = workspace(spark, [{"Id": "i1", "Name": None, "GroupId": "gone"}, {"Id": "i2", "Name": None, "GroupId": "g1"}])
    assert d.issues({"m": ws, "x": ws}, {"a": "1", "b": None, "c": "2"}) == [
        ("SourceWorkspaceNameDuplicate", "m"),
        ("SourceWorkspaceNameInvalid", ""),
        ("SourceWorkspaceMissing", "n"),
        ("SourceWorkspaceUnexpected", "x"),
        ("StringParameterNameDuplicate", "A"),
        ("StringParameterNameInvalid", "1x"),
        ("ParameterValueUnexpected", "c"),
        ("ParameterValueInvalid", "b"),
        ("SourceModelMismatch", "m"),
        ("TargetEntityNotFound", "Nope"),
    ]
    assert Direction(MODEL, {}).issues({}) == [("DirectionSourceWorkspacesMissing", ""), ("SourceWorkspacesMissing", "")]
    good = Direction(MODEL, {}, roles=("m",), models={"m": "M"})
    assert rows(good.validation({"m": ws})) == [("instance.relationship.orphan", "m:Item.GroupId", 1), ("instance.required.missing", "m:Item.Name", 2)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,Full name,Full name\n1," a ""q""\n b ",x\n\n2,y,\n3\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "Full_name", "Full_name_2"]
    entity, data = files.import_csv(df, "E")
    assert rows(data) == [("1", 'a "q"\n b', "x"), ("2", "y", None), ("3", None, None)]
    assert [p.required for p in entity.properties] == [False, False]
    with pytest.raises(files.ImportFault, match="ImportIdColumnMissing"):
        files.import_csv(data.drop("Id"), "E")
    with pytest.raises(files.ImportFault, match="ImportIdDuplicate"):
        files.import_csv(data.union(data), "E")
    files.export_csv(workspace(spark), "Item", str(tmp_path / "out"))
    assert rows(files.read_csv(spark, str(tmp_path / "out"))) == [("i1", "G1", "x", None), ("i2", "g2", "y", "n")]


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", "p"), ("2", "b", "q")], "Id string, Name string, Kind string")
    new = spark.createDataFrame([("1", "A", None, 1), ("1", None, "P", 2), (None, "c", "r", 3)], "Id string, Name string, Kind string, ord int")
    assert rows(files.upsert(old, new, "ord", auto_id=True)) == [("1", "A", "P"), ("2", "b", "q"), ("3", "c", "r")]
    by_name = spark.createDataFrame([(None, "B ", "Q", 1)], "Id string, Name string, Kind string, ord int")
    assert rows(files.upsert(old, by_name, "ord", ["Name"])) == [("1", "a", "p"), ("2", "B ", "Q")]
    # an Id goes before the key, also a new one
    both = spark.createDataFrame([(" 2 ", "a", "x", 1), ("9", "a", "y", 2)], "Id string, name string, Kind string, ord int")
    assert rows(files.upsert(old, both, "ord", ["Name"])) == [("1", "a", "p"), ("2", "a", "x"), ("9", "a", "y")]


@pytest.mark.parametrize(
    ("row", "key", "fault"),
    [((None, "c", 1), ["Name"], "fault:UpsertKeyNotFound"), ((None, "A", 1), ["Name"], "fault:UpsertKeyAmbiguous"), ((None, " ", 1), ["Name"], "fault:UpsertKeyMissing"), ((" ", "b", 1), [], "fault:UpsertIdMissing")],
)
def test_upsert_faults(spark, row, key, fault):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "A")], "Id string, Name string")
    with pytest.raises(Exception, match=fault):
        files.upsert(old, spark.createDataFrame([row], "Id string, Name string, ord int"), "ord", key).collect()


def test_upsert_checks_columns_numbers_and_self_references(spark):
    old = spark.createDataFrame([("1", "1"), ("2", "1")], "Id string, ParentId string")
    new = lambda *rs: spark.createDataFrame([(*r, i) for i, r in enumerate(rs)], "Id string, ParentId string, ord int")
    with pytest.raises(files.ImportFault, match="UpsertColumnUnknown: Other"):
        files.upsert(old, new(("3", "1")).withColumn("Other", F.lit(1)), "ord")
    with pytest.raises(files.ImportFault, match="UpsertAutoIdNotNumeric"):
        files.upsert(old.union(spark.createDataFrame([("x", "1")])), new((None, "1")), "ord", auto_id=True)
    tree = Entity("Node", (), (Relationship("Node", "Parent"),))
    assert files.upsert(old, new(("5", "4"), ("4", "3"), ("3", "2")), "ord", entity=tree).count() == 5
    with pytest.raises(ValueError, match="RequiredRelationshipCycle: Node:3, Node:4"):
        files.upsert(old, new(("3", "4"), ("4", "3")), "ord", entity=tree)
    with pytest.raises(ValueError, match="RelationshipTargetMissing: Node:3"):
        files.upsert(old, new(("3", "9")), "ord", entity=tree)


@pytest.mark.parametrize(("text", "want"), [("\ufeffId\tName \r\n1\t a, b\r\n\r\n2\t\r\n", [("1", "a, b", 2), ("2", "", 3)]), ("Id,Name\n1,x\n,y", [("", "y", 3), ("1", "x", 2)])])
def test_upsert_text(spark, tmp_path, text, want):
    (tmp_path / "in.txt").write_text(text, newline="")
    df = files.read_upsert(spark, str(tmp_path / "in.txt"))
    assert df.columns == ["Id", "Name", "ord"] and rows(df) == want


def test_upsert_text_faults(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Id,\n1,x")
    with pytest.raises(files.ImportFault, match="UpsertHeaderInvalid"):
        files.read_upsert(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.txt").write_text("Id,Name\n1,x,y")
    with pytest.raises(Exception, match="fault:UpsertColumnCountInvalid"):
        files.read_upsert(spark, str(tmp_path / "b.txt")).collect()


def test_xml_and_parquet_round_trip(spark, tmp_path):
    ws = workspace(spark)
    files.write_xml(ws, str(tmp_path / "x"))
    xml = files.read_xml(spark, MODEL, str(tmp_path / "x" / "*"))
    tables.to_parquet(ws, str(tmp_path / "p"))
    for other in (xml, tables.from_parquet(spark, MODEL, str(tmp_path / "p"))):
        for e in MODEL.entities:
            assert rows(other[e.name]) == rows(ws[e.name])
    model = files.read_model('<Model name="M"><Entity name="Group"><Property name="Name"/></Entity><Entity name="Item"><Property name="Name"/><Property name="Note" isRequired="false"/><Relationship entity="Group"/></Entity></Model>')
    assert model == MODEL


def test_stream(spark, tmp_path):
    from tessera.streaming import arrivals

    item = MODEL.entity("Item")
    spark.createDataFrame([("i1", None, None, "g1", 0), ("", "x", None, None, 60)], "Id string, Name string, Note string, GroupId string, s int").withColumn("at", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    stream = arrivals.records(spark, item, str(tmp_path / "in"), "at")
    for name, df, mode in (("broken", arrivals.broken(stream, item), "append"), ("counts", arrivals.counts(stream, "GroupId", "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert rows(spark.table("broken")) == [("", "instance.id.missing", "Id"), ("", "instance.relationship.missing", "GroupId"), ("i1", "instance.required.missing", "Name")]
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1]


def test_combine_keeps_both(spark):
    other = Workspace(Model("N", (Entity("Third"),)), {"Third": spark.createDataFrame([("t",)], "Id string")})
    assert {e.name for e in V.combine("B", [workspace(spark), other]).model.entities} == {"Group", "Item", "Third"}


def test_synchronize_reaches_what_is_desired(spark):
    left = workspace(spark)
    right = O.set_property("Item", "i1", "Note", "new")(O.delete_record("Item", "i2")(O.insert_record("Item", "i3", Name="z", GroupId="g1")(left)))
    out = V.synchronize(left, right)
    assert rows(out["Item"].select("Id", "Note", "GroupId")) == rows(right["Item"].select("Id", "Note", "GroupId"))
    assert rows(V.synchronize(right, left)["Item"]) == rows(left["Item"].select(*MODEL.entity("Item").columns))
    renamed = left.with_data("Item", left["Item"].withColumn("Id", F.upper("Id")))
    assert {r.operation for r in V.sync_plan(left, renamed, "Item").collect()} == {"RenameRecord"}
    assert rows(V.synchronize(left, renamed)["Item"]) == rows(renamed["Item"])


def test_first_difference(spark):
    left = workspace(spark)
    assert tables.first_difference(left, left).isEmpty()
    right = O.set_property("Item", "i2", "Note", "changed")(O.set_property("Item", "i2", "Name", "other")(left))
    assert rows(tables.first_difference(left, right)) == [("Item", "i2", "Name", "y", "other")]
    fewer = O.delete_record("Item", "i1")(left)
    assert rows(tables.first_difference(left, fewer)) == [("Item", "i1", "Id", "i1", None)]


def test_first_difference_of_repeated_ids_and_models(spark):
    one = Model("W", (Entity("E", (Property("Name"),), (Relationship("E", "Other", False),)),))
    ws = lambda *rs: Workspace(one, {"E": spark.createDataFrame(rs, "Id string, Name string, OtherId string")})
    assert tables.first_difference(ws(("1", "a", "X"), ("1", "b", None)), ws(("1", "b", None), ("1", "a", "x"))).isEmpty()
    assert rows(tables.first_difference(ws(("1", "a", None), ("1", "b", None)), ws(("1", "b", None), ("1", "b", None))).select("id", "member")) == [("1", "Name")]
    assert tables.first_difference(ws(("1", "a", None)), ws(("1", "A", None))).count() == 1
    reordered = Model("M", (MODEL.entities[1], MODEL.entities[0]))
    assert tables.model_difference(MODEL, reordered) is None
    optional = MODEL.with_entity("Group", Entity("Group", (Property("Name", False),)))
    assert tables.model_difference(MODEL, optional) == "PropertyDiffers: Group.Name"
    assert tables.model_difference(MODEL, Model("N")) == "ModelName: M, N" and tables.model_difference(MODEL, Model("M")) == "EntityCount: 2, 0"


def test_record_levels(spark):
    nodes = [("root", None), ("A", "ROOT"), ("b", "a")]
    df = lambda *more: spark.createDataFrame([*nodes, *more], "Id string, ParentId string")
    assert rows(V.record_levels(df(), "ParentId")) == [("A", 1), ("b", 2), ("root", 0)]
    with pytest.raises(ValueError, match="RequiredRelationshipCycle: Node:X, Node:Y"):
        V.record_levels(df(("x", "y"), ("y", "x"), ("behind", "x")), "ParentId")
    with pytest.raises(ValueError, match="RelationshipTargetMissing: Node:Z"):
        V.record_levels(df(("z", "gone")), "ParentId")


def test_graph_of_a_model_with_loops(spark):
    model = Model("L", (Entity("A", (), (Relationship("B", required=False),)), Entity("B", (), (Relationship("C", required=False), Relationship("A", required=False))), Entity("C", (), (Relationship("A", required=False),)), Entity("S", (), (Relationship("S", "Parent", False),)), Entity("X", (), (Relationship("A"), Relationship("A", "Other"))), Entity("Y")))
    nodes, edges = graph.model_graph(spark, model)
    assert rows(graph.loops(edges)) == [("A", "A"), ("A", "B"), ("A", "C"), ("S", "S")]
    assert rows(graph.loop_samples(edges)) == [("A", "A>B>A"), ("S", "S>S")]
    m = graph.measures(nodes, edges).first()
    assert (m.entities, m.edges, m.distinct_edges, m.components, m.max_depth, m.loops, m.roots, m.sinks, m.isolated) == (6, 7, 6, 3, None, 2, "X,Y", "Y", "Y")
    assert rows(graph.inbound(edges, "a").select("entity", "member")) == [("B", "AId"), ("C", "AId"), ("X", "AId"), ("X", "OtherId")]
    line = Model("P", tuple(Entity(n, (), (Relationship(t),) if t else ()) for n, t in (("A", "B"), ("B", "C"), ("C", ""))))
    assert graph.depth(*graph.model_graph(spark, line)) == 2 and graph.loop_samples(graph.model_graph(spark, line)[1]).isEmpty()


def test_query_by_role(spark):
    n, found = V.query_records(workspace(spark)["Item"], [("group", "Equal", "G2"), ("name", "Contains", "Y")])
    assert (n, rows(found.select("Id"))) == (1, [("i2",)])


def test_numbers_of_new_records_follow_the_order(spark):
    """Numbers given before a row raise the next one; those after don't."""
    old = spark.createDataFrame([("7", "a"), ("3", "b")], "Id string, Name string")
    given = {3: "3", 100: "600", 101: "x", 200: "20", 450: "9999"}
    new = spark.range(0, 500, 1, 9).select(F.create_map(*[F.lit(x) for p in given.items() for x in p])[F.col("id").cast("int")].alias("Id"), F.concat(F.lit("n"), F.col("id")).alias("Name"), (1000 - F.col("id")).alias("ord"))
    got = {r.Id: r.Name for r in files.upsert(old, new, "ord", auto_id=True).collect()}
    want, top = {"7": "a", "3": "b"}, 7
    for i in range(499, -1, -1):
        k = given.get(i)
        if k is None:
            top += 1
            k = str(top)
        elif k.isdigit():
            top = max(top, int(k))
        want[k] = f"n{i}"
    assert got == want


def test_published_versions(spark, tmp_path):
    ws = workspace(spark)
    assert files.read_model(files.model_xml(MODEL)) == MODEL
    version = files.publish_xml(ws, str(tmp_path / "pub"))
    back = files.read_published(spark, version)
    assert back.model == MODEL and all(rows(back[e.name]) == rows(ws[e.name]) for e in MODEL.entities)
    spark.createDataFrame([("other",)], "s string").coalesce(1).write.mode("overwrite").text(f"{version}/contract")
    with pytest.raises(files.ImportFault, match="ModelContractMismatch"):
        files.read_published(spark, version)


def test_jdbc(spark):
    """A database in memory: write and verify, read in parts, and a query that the database answers."""
    url = "jdbc:derby:memory:records;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    ws = workspace(spark, [{"Id": str(i), "Name": f"It's {i}%", "Note": "" if i % 2 else "n", "GroupId": "g1"} for i in range(1, 31)])
    try:
        spark._jvm.java.lang.Class.forName(driver["driver"])
        statement = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    except Exception:
        pytest.skip("no database driver here")
    for e in MODEL.entities:
        statement.execute(f'CREATE TABLE "{e.name}" (' + ", ".join(f'"{c}" VARCHAR(99)' for c in e.columns) + ")")
    tables.to_jdbc(ws, url, schema="", **driver)
    back = tables.from_jdbc(spark, MODEL, url, schema="", **driver)
    assert all(rows(back[e.name]) == rows(ws[e.name]) for e in MODEL.entities)
    n, found = tables.bounded_jdbc(spark, url, MODEL.entity("Item"), [("Name", "Contains", "'S 1"), ("group", "Equal", "G1"), ("Note", "Equal", "")], 3, schema="", **driver)
    assert n == 6 and [r.Id for r in found.collect()] == ["1", "11", "13"] and found.columns == MODEL.entity("Item").columns
    assert tables.bounded_jdbc(spark, url, MODEL.entity("Item"), [("Name", "Contains", "3%")], 9, schema="", **driver)[0] == 3


def test_diff_workspaces_are_valid(spark):
    left = workspace(spark)
    right = O.set_property("Item", "i1", "Note", "new")(O.delete_record("Item", "i2")(left))
    ws = D.equal_diff(left, right)
    assert not D.EQUAL.issues() and ws.issues().isEmpty() and len(D.EQUAL.entities) == 12 and len(D.ALIGNED.entities) == 18
    assert rows(ws["ModelLeftEntityInstanceNotInRight"]) == [("Item:i2", "Item:i2")]
    assert rows(ws["ModelRightPropertyInstanceNotInLeft"].select("Id")) == [("Item:i1:Note",)]
    other = Model("Other", (Entity("Team", (Property("Title"),)),))
    maps = D.alignment(MODEL, other, {"Group": "Team"}, {("Group", "Name"): "Title"}, spark)
    assert not D.ALIGNMENT.issues() and maps.issues().isEmpty()
    assert rows(maps["PropertyMap"]) == [("Group:Name", "Group:Name", "Team:Title")]
