import pytest
from pyspark.sql import functions as F

from stratasift.functions import names
from stratasift.operators import characters, graph, registry, relational
from stratasift.sources import embedded, sinks
from stratasift.streaming import dedup

HUMAN = [("Hips", -1), ("Spine", 0), ("Chest", 1), ("Neck", 2), ("Head", 3), ("LeftShoulder", 2), ("LeftArm", 5), ("LeftForeArm", 6), ("LeftHand", 7), ("RightShoulder", 2), ("RightArm", 9), ("RightForeArm", 10), ("RightHand", 11), ("LeftUpLeg", 0), ("LeftLeg", 13), ("LeftFoot", 14), ("RightUpLeg", 0), ("RightLeg", 16), ("RightFoot", 17)]


def test_rig_scores(spark):
    bip = [(f"Bip01_{n}", p) for n, p in HUMAN]
    rows = characters.rig_scores(characters.bones_of(spark, [("human", HUMAN), ("bip", bip), ("box", [("a", -1), ("b", 0)])])).collect()
    got = {r.asset: r for r in rows}
    assert got["human"].humanoid and got["human"].rig_score > 0.5 and got["human"].bone_count == 19 and got["bip"].humanoid
    assert not got["box"].humanoid and got["box"].depth == 1


@pytest.mark.parametrize(
    ("row", "kind"),
    [(("hero", "a/b", True, True, 20, 1, 1, 100, 1), "character"), (("villager", "x", True, True, 20, 0, 0, 10, 1), "npc"), (("dragon", "x", True, False, 7, 0, 0, 10, 1), "creature"), (("sword", "x", False, False, 0, 0, 0, 10, 1), "weapon"),
     (("thing", "x", False, False, 0, 0, 0, 300_000, 1), "environment"), (("thing", "x", False, False, 0, 0, 0, 10, 1), "prop"), (("thing", "x", False, False, 0, 0, 0, 0, 0), "unknown")],
)
def test_classify(spark, row, kind):
    df = spark.createDataFrame([row], "name string, path string, skinned boolean, humanoid boolean, bones int, clips int, textures int, triangles long, meshes int")
    assert df.select(characters.classify(*[F.col(c) for c in df.columns]).alias("c")).first().c.classification == kind


def test_name_similarity_and_matches(spark):
    df = spark.createDataFrame([("Hero_Body", "Hero_Body_D"), ("Hero", "Barrel")], "a string, b string")
    x, y = [r[0] for r in df.select(characters.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert x > 0.5 > y
    models = spark.createDataFrame([("m", "Hero", "chars/hero/hero.glb", ["Hips", "Spine"])], "model string, name string, path string, bones array<string>")
    clips = spark.createDataFrame([("c1", "hero_idle", "chars/hero/idle.bvh", ["hips", "spine"]), ("c2", "zzz", "other/q.bvh", ["Wheel"])], "clip string, name string, path string, tracks array<string>")
    found = characters.match_animations(models, clips)
    assert [r.clip for r in found.collect()] == ["c1"]
    groups = characters.group_confidence(spark.createDataFrame([("m", 0.6), ("low", 0.2)], "model string, confidence double"), found, spark.createDataFrame([], "model string, texture string"))
    r = groups.collect()
    assert len(r) == 1 and r[0].animations == ["c1"] and r[0].confidence == pytest.approx(0.65)


def test_budget_stops_at_first_violation(spark):
    m = spark.createDataFrame([("z", i, s, 100) for i, s in enumerate([5, 5, 50, 1])], "c string, i int, size long, packed long")
    assert [r.i for r in relational.within_budget(m, "c", ["i"], "size", 10, 20).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in relational.within_budget(m, "c", ["i"], "size", 3, 1000).orderBy("i").collect()] == [0, 1, 2]
    assert relational.within_budget(m, "c", ["i"], "size", 10, 1000, max_ratio=0.5, packed="packed", ratio_from=10).count() == 2


def test_cascade_ties_and_early_stop(spark):
    c = spark.createDataFrame([("a", 0, 0.96, "x"), ("a", 1, 0.99, "y"), ("b", 0, 0.5, "x"), ("b", 1, 0.5, "y")], "k string, rank int, confidence double, format string")
    assert {r.k: r.format for r in relational.best_candidate(c, "k").collect()} == {"a": "x", "b": "x"}
    assert {r.k: r.format for r in relational.best_candidate(c, "k", None).collect()}["a"] == "y"


def test_interpolation_holds_ends(spark):
    k = spark.createDataFrame([("u", 0.0, 1.0), ("u", 10.0, 3.0)], "track string, t double, v double")
    s = spark.createDataFrame([("u", x) for x in (-1.0, 0.0, 5.0, 10.0, 11.0)], "track string, at double")
    assert [r.v for r in relational.interpolate(k, "track", "t", "v", s, "at").orderBy("at").collect()] == [1, 1, 2, 3, 3]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "src string, dst string, relation string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(e, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_paths(spark):
    df = spark.createDataFrame([("../../etc/passwd",), ("a/../../b",), ("/etc/passwd",), ("C:\\Windows\\system32\\x.dll",), ("a/./b/../c",), ("",)], "p string")
    assert [r[0] for r in df.select(names.normalise_path(F.col("p"))).collect()] == [None, None, "etc/passwd", "Windows/system32/x.dll", "a/c", None]


def test_sinks(spark):
    f = spark.createDataFrame([("d", "a.png", 1), ("d", "a.png", 2), ("d", "b", 3)], "folder string, name string, n int")
    assert [r.target for r in sinks.unique_names(f, "folder", "name", "n").orderBy("n").collect()] == ["a.png", "a_02.png", "b"]
    t = spark.createDataFrame([(1, "x", 1)], "k int, v string, at int")
    c = spark.createDataFrame([(1, "y", 2), (2, "z", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in sinks.upsert(t, c, ["k"], ["at"]).collect()} == {1: "y", 2: "z"}
    assert {r.k: r.v for r in sinks.insert_new(t, c, ["k"]).collect()} == {1: "x", 2: "z"}
    text, page = sinks.report({"files": 2}, f, f.limit(0))
    assert '"files": 2' in text and "<td>a.png</td>" in page


def test_streaming_first_seen(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "name string, content string").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("name string, content string, ts timestamp").parquet(src)
    q = dedup.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_long_chains_and_cycles(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)] + [(200, 202), (201, 200), (202, 201), (203, 200), (300, 999)], "id long, parent long")
    depth = {r.id: r.depth for r in graph.depths(n).collect()}
    assert all(depth[i] == i for i in range(100)) and depth[200] is None and depth[203] is None and depth[300] == 0
    length = {r.id: r.length for r in graph.chains(n).collect()}
    assert all(length[i] == 100 - i for i in range(100)) and length[300] == 1


def test_registry_order_and_plugins(tmp_path):
    r = registry.Registry("x")
    for name, priority in (("a", 10), ("b", 90), ("c", 90), ("d", None)):
        r.add(name, priority)
    assert list(r) == ["b", "c", "d", "a"] and r.first(lambda x: x in "da") == "d" and r.first(lambda x: False) is None
    good, bad = tmp_path / "good", tmp_path / "bad"
    for p in (good, bad):
        p.mkdir()
    (good / "plugin.json").write_text('{"name": "good", "version": "1", "entrypoint": "plugin.py"}')
    (good / "plugin.py").write_text("def register(api):\n    api.add_detector('seen', 99)\n")
    (bad / "plugin.json").write_text('{"name": "bad", "version": "1", "entrypoint": "../x.py", "api_version": 7}')
    assert registry.load_plugins(tmp_path) == {"bad": ["asks for interface 7, this is 1", "entrypoint is no plain file name"], "good": []}
    assert "seen" in list(registry.REGISTRIES["detector"])
    registry.REGISTRIES["detector"].clear()


def test_embedded_items(spark):
    import struct
    import zlib

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 16, 9, 8, 2, 0, 0, 0) + b"\0" * 4 + b"\0\0\0\0" + embedded.PNG_END
    blob = b"HEADER" + bytes(100) + png + b"\xff" * 50
    df = spark.createDataFrame([("f", bytearray(blob)), ("n", None)], "virtual_path string, content binary")
    r = embedded.embedded_items(df).collect()
    assert [(x.at, x.kind, x.width, x.height, bytes(x.content)) for x in r] == [(106, "PNG", 16, 9, png)]
    packed = zlib.compress(b"x" * 4096)
    assert embedded.decompress(packed, "zlib") == b"x" * 4096 and embedded.decompress(packed, "zlib", 10) == b"x" * 10 and embedded.decompress(b"78", "gzip") is None
    assert [(at, out) for at, out in embedded.zlib_streams(b"ab" + packed + b"cd")] == [(2, b"x" * 4096)]


def test_preorder_of_deep_trees_takes_few_rounds(spark, monkeypatch):
    """A chain of 300, two roots in one tree, a cycle and a missing parent; rounds grow with the logarithm of the steps."""
    chain = [("a", i, i - 1 if i else None) for i in range(300)]
    rest = [("b", 7, None), ("b", 1, None), ("b", 9, 1), ("b", 3, 7), ("b", 5, 7), ("b", 4, 3), ("c", 1, 2), ("c", 2, 1), ("c", 3, 2), ("c", 4, 99), ("c", 5, 4)]
    rounds, made = [], graph._written
    monkeypatch.setattr(graph, "_written", lambda *a: rounds.append(1) or made(*a))
    got = {(r.tree, r.id): (r.depth, r.place) for r in graph.preorder(spark.createDataFrame(chain + rest, "tree string, id long, parent long"), "tree").collect()}
    assert got == {("a", i): (i, i) for i in range(300)} | {("b", 1): (0, 0), ("b", 9): (1, 1), ("b", 7): (0, 2), ("b", 3): (1, 3), ("b", 4): (2, 4), ("b", 5): (1, 5)}
    assert len(rounds) <= 13


@pytest.mark.parametrize("name", ["jaccard_pairs", "path_proximity_pairs", "theta_match"])
def test_pairs_of_members_are_never_shuffled(spark, name):
    from stratasift.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Exchange")


def test_pairs_of_members_cuts_large_classes(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 4)
    members = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 100)], "cls string, id long")
    blocks = relational.member_blocks(members)
    assert blocks.count() > 4
    classes = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5)], "x string, y string, score double")
    got = sorted((r.i, r.j, r.score) for r in relational.pairs_of_members(classes, blocks, blocks).collect())
    assert got == sorted([(i, j, 1.0) for i in range(30) for j in range(30)] + [(i, 100, 0.5) for i in range(30)])
