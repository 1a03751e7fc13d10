"""Catalogue, error classes, host documents and versions on small built inputs."""

from pyspark.sql import functions as F

from lodestack.functions import context, errors, scenes, uris
from lodestack.operators import catalog, versions
from lodestack.operators.ranking import numbered


def test_error_classes(spark):
    cases = [
        (200, "resolve", "x", None), (503, "any", "", "ServiceUnavailable"), (400, "upload_blob", "Invalid HASH", "InvalidHash"), (400, "upload_blob", "hash mismatch", "ContentHashMismatch"),
        (400, "resolve_uri", None, "ResolveBadRequest"), (400, None, None, "BadRequest"), (404, "resolve", "", "ResolveNotFound"), (404, "head_blob", "", "BlobNotFound"), (404, "lock_status", "", "LockNotFound"),
        (404, "x", "", "NotFound"), (403, "lock_release", "", "LockNotOwned"), (403, "x", "", "Forbidden"), (409, "lock_acquire", "", "LockHeldByOther"), (409, "register_version", "no CAS", "RegisterContentNotFound"),
        (409, "register_version", "taken", "RegisterVersionConflict"), (409, "x", "", "Conflict"), (418, "x", "", "ApiError"), (500, "x", "", "ApiError"),
    ]
    df = spark.createDataFrame(cases, "status int, op string, detail string, want string")
    rows = df.select("want", errors.error_class(F.col("status"), F.col("op"), F.col("detail")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    assert set(errors.PARENTS.values()) <= set(errors.PARENTS) | {"ApiError"}


def test_palette_chooses_one_of_equal_codes(spark):
    assets = spark.createDataFrame([(i, 1, "a", "n", "t") for i in (7, 5, 6)], "id long, project_id long, code string, name string, type string")
    groups = spark.createDataFrame([(5, 2), (6, 9)], "asset_id long, version_number int")
    rows = catalog.palette(assets, groups, "").collect()
    assert [(r.n_assets, r.codes, r.versions) for r in rows] == [(3, "a,a,a", "2")]


def test_palette_of_a_project(spark):
    assets = spark.createDataFrame([(1, "hero", "Hero", "char", 7), (2, "box", None, "prop", 7), (3, "hut", "Hut", "prop", 8)], "id long, code string, name string, type string, project_id long")
    groups = spark.createDataFrame([(1, n) for n in range(1, 15)] + [(2, 2), (2, 2)], "asset_id long, version_number int")
    rows = {r.project_id: r for r in catalog.palette(assets, groups, "").collect()}
    assert (rows[7].n_assets, rows[7].codes, rows[7].asset_code, rows[7].versions) == (2, "box,hero", "box", "2,2")
    assert rows[8].versions == ""
    hero = catalog.palette(assets, groups, " HERO ").collect()
    assert [r.versions for r in hero] == [",".join(str(n) for n in range(14, 2, -1))]
    assert catalog.palette(assets, groups, "prop", ("code", "name")).collect() == []


def test_stages_versions_and_representations(spark):
    groups = spark.createDataFrame([(1, 1, "rigging", "ma"), (1, 2, "", "blend"), (1, 3, "lookdev", ""), (2, 1, "", "")], "asset_id long, version_number int, stage string, representation string")
    assert {r.asset_id: r.stages for r in catalog.distinct_stages(groups).collect()} == {1: ["lookdev", "rigging"], 2: list(catalog.DEFAULT_STAGES)}
    assert sorted(r.label for r in catalog.distinct_versions(groups, "rigging").collect()) == ["v001", "v001", "v002"]
    reps = {(r.asset_id, r.version_number): r.representations for r in catalog.distinct_representations(groups, "rigging").collect()}
    assert reps == {(1, 1): ["ma"], (1, 2): ["blend"], (1, 3): ["blend"], (2, 1): ["blend"]}
    assert {r.asset_id: r.representation for r in catalog.switch_representation(groups, "lookdev").collect()} == {1: "blend", 2: "blend"}


def test_tasks_by_any_role(spark):
    tasks = spark.createDataFrame([(1, "u1", None), (2, None, ["u2", "u1"]), (3, "u3", ["u2"]), (4, None, None)], "id long, assignee_id string, collaborators array<string>")
    users = spark.createDataFrame([("u1", "Ann", "x"), ("u2", "bob", "ANN"), ("u3", "cy", "cy")], "id string, username string, name string")
    assert sorted(r.id for r in catalog.my_tasks(tasks, users, " ann ").collect()) == [1, 2, 3]
    assert catalog.my_tasks(tasks, users, "nobody").collect() == []


def test_hosts(spark):
    cases = [(["maya", "bpy"], None, "x", "blender"), (["sys"], " Nuke ", "x", "nuke"), ([], None, "/opt/Blender/blender.exe", "blender"), ([], "", "/opt/hfs19/bin/python", "N/A"), ([], "", "hfs-python", "houdini"), ([], None, None, "N/A")]
    df = spark.createDataFrame(cases, "modules array<string>, hint string, exe string, want string")
    rows = df.select("want", catalog.host_name(F.col("modules"), F.col("hint"), F.col("exe")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_routes_addresses_and_contexts(spark):
    df = spark.createDataFrame([("A.BLEND", None, "blocks"), ("a.usd", "blender", "blocks"), ("a.ma", "usd", "text"), ("a.x", "maya", None), ("a.x", "USD", "stage"), ("a.usdz", "", "stage")], "path string, hint string, want string")
    assert all(r.want == r.got for r in df.select("want", scenes.route("path", "hint").alias("got")).collect())
    one = spark.createDataFrame([("asset://p/a/latest/ma",), ("asset://p/a/x/ma",)], "uri string")
    assert [tuple(r.p) for r in one.select(uris.parsed_uri("uri").alias("p")).collect()] == [("p", "a", "latest", "ma"), ("", "", "", "")]
    texts = spark.createDataFrame([("",), ("[]",), ("{",), ('{"intent":"i","dcc":"d","project_id":"1"}',), ('{"dcc":"d"}',)], "t string")
    assert [r.c is not None for r in texts.select(context.launch_context("t").alias("c")).collect()] == [False, False, False, True, False]
    assert [r.c is not None for r in texts.select(context.lenient_context("t").alias("c")).collect()] == [False, False, False, True, True]


def test_versions_and_locks(spark):
    old = spark.createDataFrame([("p", "a", "r", 1), ("p", "a", "r", 4)], "project string, asset string, representation string, version_number int")
    asked = spark.createDataFrame([("p", "a", "r", "h", None, 1), ("p", "a", "r", "h", 4, 2), ("p", "a", "r", "h", 9, 3), ("p", "a", "r", "gone", None, 4), ("p", "a", "r", "h", None, 20005), ("q", "a", "r", "h", None, 6)], "project string, asset string, representation string, content_id string, version int, seq long")
    store = spark.createDataFrame([("h",)], "content_id string")
    got = {r.seq: (r.outcome, r.version_number) for r in versions.register(old, asked, store).collect()}
    assert got == {1: ("ok", 5), 2: ("version_conflict", None), 3: ("ok", 9), 4: ("content_not_found", None), 20005: ("ok", 10), 6: ("ok", 1)}


def test_numbers_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").alias("k"), "id")
    out = numbered(df, ["k"], ["id"], F.floor(F.col("id") / 300), "n").groupBy("k").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.corr("n", "id").alias("c")).collect()
    assert {(r[0], r[1], r[2], r[3]) for r in out} == {("hot", 1, 4500, 4500), (None, 1, 500, 500)} and all(r.c > 0.999 for r in out)


def test_refused_requests_change_no_lock(spark):
    asked = [("k", 1, "acquire"), ("k", 2, "acquire"), ("k", 2, "release"), ("k", 1, "release"), ("k", 1, "release"), ("k", 2, "acquire"), ("k", 1, "acquire")]
    rows = spark.createDataFrame([(*r, f"2024-01-01 {h:02d}:00:00", i) for i, (r, h) in enumerate(zip(asked, (0, 0, 1, 1, 2, 3, 9)))], "lock_key string, user_id long, action string, at string, event_id long").selectExpr("*", "to_timestamp_ntz(at) AS ts")
    got = [(r.holder, r.outcome) for r in sorted(versions.lock_requests(rows).collect(), key=lambda r: r.event_id)]
    assert got == [(None, "acquired"), (1, "held_by_other"), (1, "not_owner"), (1, "released"), (None, "not_found"), (None, "acquired"), (2, "held_by_other")]
    assert [tuple(r) for r in versions.lock_holders(rows).collect()] == [("k", 2, 6)]


def test_claims_of_one_batch_see_each_other(spark):
    old = spark.createDataFrame([("p", "a", "r", 3)], "project string, asset string, representation string, version_number int")
    asked = spark.createDataFrame([("p", "a", "r", "h", v, s) for s, v in ((1, 4), (2, None), (3, 4), (30_000, 5), (30_001, 9), (60_000, None))], "project string, asset string, representation string, content_id string, version int, seq long")
    got = {r.seq: (r.outcome, r.version_number) for r in versions.register(old, asked).collect()}
    assert got == {1: ("ok", 4), 2: ("ok", 5), 3: ("version_conflict", None), 30_000: ("version_conflict", None), 30_001: ("ok", 9), 60_000: ("ok", 10)}
