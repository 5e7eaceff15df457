import json

import pytest
from pyspark.sql import functions as F

from seqspark.functions.keys import SLOT_COUNT
from seqspark.operators import nodes, releases, routes
from tests.conftest import rows


def payload(*entries):
    return json.dumps({"nodes": [{"node_id": n, "slots": list(s)} for n, s in entries]})


EVEN, ODD = range(0, SLOT_COUNT, 2), range(1, SLOT_COUNT, 2)
GOOD = payload(("b", list(ODD)[::-1]), ("a", EVEN))


@pytest.mark.parametrize(
    "version,text,problems",
    [(1, GOOD, set()), (0, GOOD, {"bad_version"}), (1, GOOD[:50], {"bad_json"}), (1, "{}", {"bad_json"}), (1, payload(("a", EVEN)), {"coverage"}), (1, payload(("a", EVEN), ("b", [*ODD, 2])), {"duplicate_slot"}),
     (1, payload(("a", EVEN), ("b", [*ODD, SLOT_COUNT])), {"slot_range"}), (1, payload(("", EVEN), ("b", ODD)), {"empty_node"}), (1, payload(("a", EVEN), ("a", ODD)), {"duplicate_node"}),
     (1, payload(("a", EVEN), ("b", [*ODD, -1])), {"slot_range"}), (1, payload(("a", EVEN), ("b", [*ODD, 1.5])), {"bad_json"}), (1, payload(("a", EVEN), ("b", [*ODD, None])), {"slot_range"}), (1, payload(), {"coverage"})],
)
def test_route_rules(spark, version, text, problems):
    got = routes.violations(spark.createDataFrame([(version, text)], "version long, payload string"))
    assert {r["problem"] for r in got.collect()} == problems


def test_publication_is_canonical(spark):
    snapshot = routes.publish(routes.split_slots(spark, ["b", "a"]), 3)
    text = json.loads(snapshot.first()["payload"])
    assert [n["node_id"] for n in text["nodes"]] == ["a", "b"] and text["nodes"][0]["slots"] == list(ODD)
    assert routes.valid_routes(snapshot).count() == 1
    nodes_ = routes.canonical(spark.createDataFrame([(1, GOOD)], "version long, payload string")).first()["nodes"]
    assert [(n["node_id"], n["slots"]) for n in nodes_] == [("a", list(EVEN)), ("b", list(ODD))]


@pytest.mark.parametrize("held,version,content,want", [(None, 1, "x", "apply"), (2, 3, "x", "apply"), (2, 1, "x", "regression"), (2, 2, "same", "noop"), (2, 2, "other", "conflict")])
def test_update_verdicts(spark, held, version, content, want):
    df = spark.createDataFrame([(held, "same", version, content)], "h long, hc string, v long, c string")
    assert df.select(routes.update_verdict(*[F.col(c) for c in ("h", "hc", "v", "c")])).first()[0] == want


def test_latest_newer_and_answers(spark):
    log = spark.createDataFrame([(4, "p4"), (5, "p5")], "version long, payload string")
    assert [r["version"] for r in routes.latest_newer(log, 0).collect()] == [5] and routes.latest_newer(log, 5).count() == 0
    df = spark.createDataFrame([(0, None), (2, 2), (3, 2), (1, 2)], "k long, c long")
    assert [r[0] for r in df.select(routes.get_route(F.col("k"), F.col("c"))).collect()] == ["SEQUENCE_ROUTE_UNAVAILABLE", "not_modified", "not_modified", "snapshot"]
    df = spark.createDataFrame([(0, True, None), (1, True, None), (1, True, 2), (1, False, None), (1, False, 2)], "k long, n boolean, v long")
    assert [r[0] for r in df.select(routes.refresh_problem(F.col("k"), F.col("n"), F.col("v"))).collect()] == ["unavailable", None, "invalid", "invalid", None]


def test_diffs(spark):
    slots = lambda *s: spark.createDataFrame([(x,) for x in s], "slot int")
    assert rows(routes.diff(slots(1, 2), slots(2, 3))) == [(1, "dropped"), (3, "added")]
    assert rows(routes.open_diff(slots(1, 2), slots(2, 3), 5, 4)) == [(1, "dropped"), (2, "added"), (2, "dropped"), (3, "added")]
    assert rows(routes.open_diff(slots(1, 2), slots(2, 3), 4, 4)) == [(1, "dropped"), (3, "added")]


def test_effective_owners(spark):
    owners = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "b", 0)], "version long, node_id string, slot int")
    published = spark.createDataFrame([(1, 0, 3), (2, 10, 13), (3, 20, 23)], "version long, taken_at long, applies_at long")
    spans = routes.effective(owners, published)
    asked = spark.createDataFrame([(0, t) for t in (0, 3, 9, 10, 12, 13, 22, 23, 99)], "slot int, ts long")
    assert {r["ts"]: (r["version"], r["node_id"]) for r in routes.owner_at(asked, spans).collect()} == {
        0: (None, None), 3: (1, "a"), 9: (1, "a"), 10: (None, None), 12: (None, None), 13: (2, "b"), 22: (2, "b"), 23: (3, "b"), 99: (3, "b")
    }


def test_endpoints(spark):
    kind = "name string, node_id string, state string"
    state = lambda *s: routes.connectivity(spark.createDataFrame([(str(k), "n", x) for k, x in enumerate(s)], kind)).first()[0]
    assert [state(), state("READY", "TRANSIENT_FAILURE"), state("CONNECTING", "TRANSIENT_FAILURE"), state("IDLE")] == ["TRANSIENT_FAILURE", "READY", "TRANSIENT_FAILURE", "CONNECTING"]
    twice = spark.createDataFrame([("x", "n", "READY"), ("y", "n", "CONNECTING"), ("z", "m", "READY"), ("w", None, "READY")], kind)
    assert rows(routes.ready_owners(twice)) == [("m", "z")]
    turns = routes.round_robin(spark.range(5), "id", twice)
    assert {r["id"]: r["name"] for r in turns.collect()} == {0: "w", 1: "x", 2: "z", 3: "w", 4: "x"}
    assert routes.round_robin(spark.range(2), "id", twice.limit(0)).where("name IS NULL").count() == 2
    wanted = spark.createDataFrame([("x", "new", 0), ("q", "p", 1), ("x", "last", 2)], "name string, node_id string, place int")
    assert rows(routes.reconcile(twice, wanted)) == [("q", "p", "added"), ("w", None, "removed"), ("x", "last", "kept"), ("y", "n", "removed"), ("z", "m", "removed")]


def ticks(spark, rows_):
    return spark.createDataFrame(rows_, "node_id string, tick long, heartbeat boolean, failed boolean, version long, slots array<int>")


def test_node_life(spark):
    route = lambda t: (1, [1, 2]) if t < 10 else (2, [2, 3]) if t < 30 else (4, [2, 3])
    data = [("n", t, True, 20 <= t < 26, *route(t)) for t in range(1, 41)]
    log = {r["tick"]: r for r in nodes.node_log(ticks(spark, data).repartition(3), 3).collect()}
    assert not log[1]["paused"] and log[3]["slots"] == [] and log[4]["slots"] == [1, 2] and log[4]["version"] == 1
    assert log[10]["slots"] == [2] and log[12]["slots"] == [2] and log[13]["slots"] == [2, 3] and log[13]["version"] == 2
    assert not log[22]["paused"] and log[23]["paused"] and log[25]["paused"] and not log[26]["paused"] and log[26]["slots"] == [2, 3]
    assert log[32]["version"] == 2 and log[33]["version"] == 4 and log[33]["slots"] == [2, 3]
    waits = spark.createDataFrame([("n", 2, 5), ("n", 3, 1), ("n", 9, 1)], "node_id string, version long, tick long")
    got = {r["version"]: r["ready_tick"] for r in nodes.first_applied(nodes.node_log(ticks(spark, data), 3), waits).collect()}
    assert got == {2: 13, 3: 33, 9: None}


def test_schedule_and_start(spark):
    plan = nodes.schedule(spark, ["n"], 5, 2)
    assert [r["tick"] for r in plan.where("heartbeat").orderBy("tick").collect()] == [0, 2, 4]
    log = {r["tick"]: r for r in nodes.node_log(ticks(spark, [("n", t, t == 0, False, 1, [7]) for t in range(6)]), 3).collect()}
    assert not log[0]["paused"] and log[2]["slots"] == [] and log[3]["slots"] == [7] and not log[3]["paused"] and log[4]["paused"]


def test_lookups(spark):
    kind = "service string, releases array<struct<version: string, contract: string, tested_clients: array<string>>>"
    manifests = spark.createDataFrame([("s", [("v1.0.0", "", [])])], kind)
    found = lambda *a: {r["problem"] for r in releases.lookup_violations(manifests, *a).collect()}
    assert [found("s", "v1.0.0"), found("s", "v2.0.0"), found("t", "v1.0.0")] == [set(), {"no_release"}, {"foreign_service", "no_release"}]


def test_identity():
    from seqspark.sources.store import identity_problem

    assert identity_problem(("a", "b"), ("a", "b")) is None and "a/c" in identity_problem(("a", "c"), ("a", "b"))


def test_manifest_tags(spark):
    tags = ["gen/go/x/v1.2.3", "gen/go/v1.2.3", "gen/go/x/v1.2", "gen/go/x/y/v0.0.1", "pkg/x/v1.2.3", "gen/go/x/v1.2.3-rc1"]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(releases.valid_tag(F.col("t"), "gen/go/")).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, False]


def test_history(spark):
    kind = "service string, version string, contract string, tested_clients array<string>"
    old = spark.createDataFrame([("s", "v1", "c1", ["a", "b"]), ("s", "v2", "c2", []), ("s", "v3", "c3", ["a"])], kind)
    now = spark.createDataFrame([("s", "v1", "c1", ["b"]), ("s", "v3", "other", ["a", "new"]), ("s", "v4", "", [])], kind)
    assert rows(releases.history_violations(now, old)) == [("s", "v1", "removed_client", "a"), ("s", "v2", "removed_release", "v2"), ("s", "v3", "changed_contract", "c3")]


def test_tree_drift_ignores_licence_headers(spark):
    head = "// Copyright 2026 X\n//\n// Licensed under the Apache License, Version 2.0 (the L);\n// limitations under the License.\n\n"
    tree = [("a.go", "package a\n"), ("b.go", head + "package b\n"), ("c.txt", head + "c"), ("d.go", "d"), ("f.go", "// Copyright 2026 X\n// limitations under the License.\nf")]
    tagged = [("a.go", head + "package a\n"), ("b.go", head.replace("2026", "2025") + "package b\n"), ("c.txt", "c"), ("e.go", "e"), ("f.go", "f")]
    kind = "path string, text string"
    got = releases.tree_drift(spark.createDataFrame(tree, kind), spark.createDataFrame(tagged, kind))
    assert rows(got) == [("c.txt", "changed"), ("d.go", "added"), ("e.go", "removed"), ("f.go", "changed")]
