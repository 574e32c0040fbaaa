"""Known answers for hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import names
from fleetlens.operators import aggregates, logs, matching, permissions, projections, quality, ranking, sets, telemetry, trees


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


INFO, OK = "\x1b[0;34m[INFO]\x1b[0m", "\x1b[0;32m[OK]\x1b[0m"


def run_log(steps, finished, polls=(), boards=None, completed=False, failed_cleanup=True):
    """A run's lines: steps started in order, the first `finished` of them ended."""
    lines = [f"{INFO} Log file: x", ""]
    for i, step in enumerate(steps):
        lines.append(f"{INFO} === {step} ===")
        if i == 0 and failed_cleanup:
            lines += ["ERROR 1146 (42S02) at line 1: Table 'db.wamp_sessions' doesn't exist",
                      "ERROR 1146 (42S02) at line 6: Table 'db.injected_plugins' doesn't exist"]
        if i == 1 and boards:
            lines += [f"  Board totali: {boards[0]}", f"  Board online: {boards[1]}"]
        if "plugin" in step:
            lines += [f"  [{k}/12] Ready: {ready}, Synced: True" for k, ready in polls] + ["Test completato!"]
        if i < finished:
            lines.append(f"{OK} {step} completato")
    if completed:
        lines.append(f"{OK} Suite CRD completata")
    return lines


STEPS = ["Cleanup", "Creazione board", "Compilazione", "Test plugin", "Injection"]
LONG = ["Cleanup", "Creazione board", "Compilazione", "Allineamento", "Test plugin", "Injection", "Verifica"]
RUNS = {
    "r1": run_log(STEPS, 4, [(1, True)], (5, 5)),
    "r2": run_log(LONG[:6], 5, [(1, True)], (5, 0)),
    "r3": run_log(LONG[:6], 5, [(1, False), (2, True)], (5, 0)),
    "r4": run_log(STEPS[:1], 0, failed_cleanup=False),
    "r5": run_log(LONG, 7, [(1, False), (2, True)], (5, 0), completed=True),
    "r6": run_log(LONG, 7, [(1, True)], (5, 0), completed=True),
}


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(
        [(run, i + 1, text) for run, body in RUNS.items() for i, text in enumerate(body)], "run_id string, line_no bigint, line string"
    )


def test_steps_and_summary(lines):
    counts = logs.step_outcomes(lines).groupBy("run_id").agg(F.count("*").alias("s"), F.count_if("finished").alias("f"))
    assert [r[1:] for r in rows(counts)] == [(5, 4), (6, 5), (6, 5), (1, 0), (7, 7), (7, 7)]
    summary = rows(logs.run_summary(lines), "run_id", "started", "finished", "boards_total", "boards_online", "completed")
    assert [r[1:] for r in summary] == [
        (5, 4, 5, 5, False), (6, 5, 5, 0, False), (6, 5, 5, 0, False), (1, 0, None, None, False), (7, 7, 5, 0, True), (7, 7, 5, 0, True),
    ]


def test_a_repeated_step_is_paired_with_its_own_end(spark):
    text = [f"{INFO} === A ===", f"{OK} A completato", f"{INFO} === A ===", f"{INFO} === A ===", f"{OK} A completato", f"{OK} A completato"]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "run_id string, line_no bigint, line string")
    assert rows(logs.step_outcomes(df), "occurrence", "start_line", "end_line") == [(1, 0, 1), (2, 2, None), (3, 3, 4)]


def test_polls_until_ready(spark, lines):
    everyone = lines.select("run_id").distinct()
    polled = ranking.poll_until(logs.poll_attempts(lines), ["run_id"], 12)
    got = everyone.join(polled, "run_id", "left")
    assert [r[1] for r in rows(got, "run_id", "attempt")] == [1, 1, 2, None, 2, 1]
    late = spark.createDataFrame([("a", 13, True, True), ("a", 12, True, False)], "k string, attempt int, ready boolean, synced boolean")
    assert rows(ranking.poll_until(late, ["k"], 12)) == [("a", None, "timeout")]


def test_error_signatures(lines):
    got = {r.signature.split("'")[1]: (r.lines, r.runs) for r in logs.error_signatures(lines).collect()}
    assert got == {"db.wamp_sessions": (5, 5), "db.injected_plugins": (5, 5)}


def test_levels_and_words(spark):
    df = spark.createDataFrame([(1, "\x1b[1;33m[WARN]\x1b[0m low"), (2, "[ERR] x"), (3, "ERROR 5"), (4, "ERRORS are plain"), (5, "")], "n int, line string")
    assert rows(logs.classify_lines(df), "n", "level") == [(1, "WARN"), (2, "ERR"), (3, "ERROR"), (4, "plain"), (5, "plain")]
    assert rows(logs.line_filter(df, ["err", "a.b"]), "n") == [(2,), (3,), (4,)]


def test_report_and_online(spark):
    boards = spark.createDataFrame([(f"u{i}", f"T-{i}", f"Test Board {i}", "registered", "w") for i in range(1, 6)], "uuid string, code string, name string, status string, agent string")
    plugins = spark.createDataFrame([("p", "Test Plugin")], "uuid string, name string")
    injections = spark.createDataFrame([("u5", "p", "injected", False), ("gone", "p", "injected", True)], "board_uuid string, plugin_uuid string, status string, onboot boolean")
    assert rows(matching.injection_report(injections, boards, plugins)) == [("Test Board 5", "T-5", "Test Plugin", "p", "injected", False)]
    sessions = spark.createDataFrame([(f"u{i}", 1) for i in range(1, 6)] * 2 + [("x", 1)], "board_uuid string, valid int")
    assert rows(aggregates.online_ratio(matching.mark_online(boards, sessions))) == [(5, 5)]
    some = matching.mark_online(boards, sessions, F.col("code") == "T-2")
    assert rows(aggregates.online_ratio(some)) == [(5, 1)]


def test_injection_verdicts(spark):
    boards = spark.createDataFrame([("on", "online", "a"), ("off", "offline", "a"), ("bare", "online", "")], "uuid string, status string, agent string")
    targets = spark.createDataFrame([("p",)], "uuid string")
    asks = spark.createDataFrame([("on", "p"), ("off", "p"), ("bare", "p"), ("on", "q"), ("none", "p")], "board_uuid string, plugin_uuid string")
    assert rows(matching.injection_eligibility(asks, boards, targets)) == [
        ("bare", "p", "no agent"), ("none", "p", "board missing"), ("off", "p", "board offline"), ("on", "p", "allowed"), ("on", "q", "target missing"),
    ]


def test_reconcile_policies(spark):
    desired = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("d", "4")], "id string, code string")
    observed = spark.createDataFrame([("b", "2"), ("c", "3"), ("d", None), ("e", "5")], "id string, code string")
    assert rows(matching.reconcile_plan(desired, observed, ["id"], ["code"])) == [
        ("a", "create", ""), ("b", "noop", ""), ("c", "update", "code"), ("d", "update", "code"), ("e", "delete", ""),
    ]
    assert ("e", "orphan", "") in rows(matching.reconcile_plan(desired, observed, ["id"], ["code"], "Orphan"))
    assert ("c", "replace", "code") in rows(matching.reconcile_plan(desired, observed, ["id"], ["code"], replace=True))
    assert {r[1] for r in rows(matching.reconcile_plan(desired, observed, ["id"]))} == {"create", "noop", "delete"}


def test_reconcile_compares_what_the_kind_compares(spark):
    desired = spark.createDataFrame([("a", "1", "n")], "uuid string, code string, name string")
    observed = spark.createDataFrame([("a", "2", "n")], "uuid string, code string, name string")
    plan = {kind: rows(matching.reconcile_resources(desired, observed, kind))[0][1:] for kind in ("Device", "Plugin", "Service")}
    assert plan == {"Device": ("update", "code"), "Plugin": ("noop", ""), "Service": ("noop", "")}


def test_membership_without_an_answer_is_unknown(spark):
    wanted = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("c", "p")], "board string, item string")
    seen = spark.createDataFrame([("a", ["p", "z"]), ("b", None)], "board string, items array<string>")
    assert rows(matching.membership_probe(wanted, seen, "board", "item", "items")) == [
        ("a", "p", "present"), ("a", "q", "absent"), ("b", "p", "unknown"), ("c", "p", "unknown"),
    ]


def test_references_resolve_in_order(spark):
    refs = spark.createDataFrame([("x",), ("y",), ("z",)], "code string")
    first = spark.createDataFrame([("x", "2"), ("x", "1"), ("y", "")], "code string, uuid string")
    second = spark.createDataFrame([("x", "0"), ("y", "7")], "code string, uuid string")
    assert rows(matching.resolve_refs(refs, first, second, "code", "uuid")) == [
        ("x", "1", "primary"), ("y", "7", "fallback"), ("z", None, "unresolved"),
    ]


def test_upsert_sets_and_adds_but_never_removes(spark):
    target = spark.createDataFrame([("a", 1, "k"), ("a", 2, "l"), ("b", 3, "m")], "key string, v int, w string")
    source = spark.createDataFrame([("a", 9), ("c", None), ("c", 4)], "key string, v int")
    assert rows(matching.upsert_merge(target, source, ["key"], ["v"])) == [("a", 9, "k"), ("a", 9, "l"), ("b", 3, "m"), ("c", 4, None)]


def test_requests_keep_unanswered_ones(spark):
    requests = spark.createDataFrame([("r1", "done"), ("r2", "open")], "uuid string, status string")
    results = spark.createDataFrame([("r1", "ok"), ("r1", "bad"), ("lost", "ok")], "request_uuid string, result string")
    assert rows(matching.request_results(requests, results)) == [("r1", "done", "bad"), ("r1", "done", "ok"), ("r2", "open", None)]
    assert rows(matching.request_outcomes(requests, results, {"ok": F.col("result") == "ok"})) == [("r1", "done", 2, 1), ("r2", "open", 0, 0)]


def test_dangling_and_guard(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, board string")
    parent = spark.createDataFrame([("a",)], "uuid string")
    assert rows(matching.dangling_refs(child, parent, "board", "uuid")) == [(2, "b")]
    assert rows(matching.delete_guard(parent, child, "uuid", "board")) == [("a", 1, False)]


def test_port_pool(spark):
    exposed = spark.createDataFrame([(50000,), (50024,), (50024,), (60000,)], "public_port int")
    got = {r.port: r for r in matching.port_pool(spark, exposed, 50000, 50100, (50001, 50100)).collect()}
    assert sum(r.state == "free" for r in got.values()) == 99
    assert (got[50000].state, got[50000].forwarded) == ("used", False)
    assert (got[50024].state, got[60000].state) == ("clash", "outside")


def test_expected_things_and_verdict(spark):
    expected = spark.createDataFrame([("db", "fail"), ("ui", "warn"), ("bus", "fail"), ("web", "fail")], "name string, severe string")
    actual = spark.createDataFrame([("db", "Running"), ("db", "Pending"), ("bus", "Pending"), ("extra", "Running")], "name string, phase string")
    checks = matching.expected_vs_actual(expected, actual, ["name"], F.col("phase") == "Running", F.col("severe"))
    assert rows(checks, "name", "severity") == [("bus", "warn"), ("db", "ok"), ("ui", "warn"), ("web", "fail")]
    assert rows(aggregates.health_verdict(checks)) == [(1, 2, 1, "ISSUES")]
    assert rows(aggregates.health_verdict(checks.where("severity != 'fail'"))) == [(1, 2, 0, "MOSTLY_OK")]
    assert rows(aggregates.health_verdict(checks.where("severity = 'ok'"))) == [(1, 0, 0, "GOOD")]


def test_config_usage(spark):
    usages = spark.createDataFrame([("c", "Device")] * 5 + [("c", "Plugin"), ("c", "BoardPluginInjection")], "config string, kind string")
    assert rows(aggregates.config_usage(usages)) == [("c", "BoardPluginInjection", 1), ("c", "Device", 5), ("c", "Plugin", 1)]


def test_election(spark):
    agents = spark.createDataFrame(
        [("h1", 1, 1, "2026-01-01 09:00"), ("h2", 1, 1, "2026-01-01 10:00"), ("h3", 0, 0, "2026-01-01 11:00")],
        "hostname string, ragent int, online int, created_at string",
    )
    assert rows(aggregates.duplicate_actives(agents)) == [(2, "duplicate")]
    after = ranking.elect_singleton(agents)
    assert rows(after, "hostname", "ragent", "online") == [("h1", 0, 1), ("h2", 0, 1), ("h3", 1, 1)]
    assert rows(aggregates.duplicate_actives(after)) == [(1, "single")]
    boards = spark.createDataFrame([("a", ""), ("b", "x"), ("c", None)], "code string, agent string")
    elected = ranking.latest_row(agents).select("hostname")
    assert rows(projections.assign_agent(boards, elected, projections.is_blank("agent"))) == [("a", "h3"), ("b", "x"), ("c", "h3")]
    assert rows(projections.assign_agent(boards, elected.where("false"), projections.is_blank("agent"))) == rows(boards)


def test_least_loaded_keeps_ties(spark):
    nodes = spark.createDataFrame([("n1", True), ("n2", True), ("n3", True), ("n4", False)], "node string, up boolean")
    functions = spark.createDataFrame([("n1",), ("n1",)], "node string")
    tied = aggregates.least_loaded(nodes, functions, reachable="up")
    assert rows(tied) == [("n2", 0), ("n3", 0)]
    assert {aggregates.pick_one(tied, seed=s).first()[0] for s in range(12)} == {"n2", "n3"}


def test_newest_matching_falls_back(spark):
    everything = spark.createDataFrame([("T-1", 5), ("T-2", 3), ("X-9", 9)], "code string, created int")
    fresh = spark.createDataFrame([("X-9",)], "code string")
    assert rows(ranking.newest_matching(fresh, everything, "code", "created", "T-")) == [("T-1", False)]
    fresh = spark.createDataFrame([("T-0",), ("T-2",)], "code string")
    assert rows(ranking.newest_matching(fresh, everything, "code", "created", "T-")) == [("T-2", True)]


def test_patch_skips_zero_values(spark):
    current = spark.createDataFrame([("w", 80, True, "x")], "uuid string, port int, secure boolean, name string")
    zero = spark.createDataFrame([("w", 0, False, "")], "uuid string, port int, secure boolean, name string")
    assert rows(projections.sparse_patch(current, zero, ["uuid"])) == [("w", 80, True, "x")]
    assert rows(projections.sparse_patch(current, zero, ["uuid"], explicit_null=True)) == [("w", 0, False, "")]


def test_settings_documents(spark):
    boards = spark.createDataFrame([("A",), ("B",), ("",)], "code string")
    pods = spark.createDataFrame([("A", "p2", "Running"), ("A", "p1", "Running"), ("B", "p3", "Pending")], "code string, pod string, phase string")
    docs = projections.settings_documents(boards, pods, "wss://h/", "realm")
    assert rows(docs, "code", "pod", "skipped") == [("", None, "code missing"), ("A", "p1", None), ("B", None, "no running pod")]
    assert docs.where("code = 'A'").first().document == (
        '{"device":{"board":{"code":"A"},"wamp":{"registration-agent":{"url":"wss://h/","realm":"realm"}}}}'
    )
    assert rows(aggregates.settings_coverage(docs)) == [(3, 1, 1, 1)]


def test_namespaces(spark):
    projects = [
        ("a.b", "x"), ("a-b", "x"), ("a-b", "c"), ("a", "b-c"), ("kube", "system"), ("o" * 60, "abc"),
        ("https://idp.example/realms/r#ann", "p"), ("", "q"),
    ]
    df = quality.namespace_audit(spark.createDataFrame(projects, "owner string, project_name string"))
    got = {(r.owner, r.project): r for r in df.collect()}
    assert got["a.b", "x"].namespace == got["a-b", "x"].namespace == "a-b-x" and got["a.b", "x"].collides
    assert got["a-b", "c"].namespace == got["a", "b-c"].namespace == "a-b-c" and got["a", "b-c"].collides
    assert got["kube", "system"].reserved and not got["kube", "system"].collides
    assert got["o" * 60, "abc"].too_long
    ann = got["https://idp.example/realms/r#ann", "p"]
    assert (ann.namespace, ann.delete_namespace, ann.leaks) == ("ann-p", "https-idp-examplerealmsrann-p", True)
    assert got["", "q"].incomplete and got["", "q"].namespace is None


def test_names(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert value(names.slug(F.lit("A.b@C_d / e--f"))) == "a-b-c-de-f"
    assert value(names.slug(F.lit("  __ "))) == "x"
    assert value(names.object_name(F.lit("injection-TEST-BOARD-1_a b-p"))) == "injection-test-board-1-a-b-p"
    assert value(names.age_seconds(F.lit("3m19s"))) == 199
    assert value(names.age_seconds(F.lit("2d3h"))) == 183600
    assert value(names.age_seconds(F.lit("soon"))) is None
    assert value(F.unix_timestamp(names.code_epoch(F.lit("TEST-BOARD-1700000000-3")))) == 1700000000
    assert value(names.code_epoch(F.lit("PLAIN-3"))) is None
    assert value(names.call_outcome(F.lit("GET"), F.lit(404))) == "absent"
    assert value(names.call_outcome(F.lit("DELETE"), F.lit(404))) == "done"
    assert value(names.call_outcome(F.lit("PATCH"), F.lit(201))) == "error"


def test_references(spark):
    digest = "ab12cd34ef56" + "0" * 52
    text = f"""
image: docker.io/acme/app:1.2
  image: "acme/app:1.2"
FROM quay.io/x/y@sha256:{digest} AS build
image: localhost:5000/img
# image: nothing
"""
    refs = logs.extract_references(spark.createDataFrame([(text,)], "t string"), "t")
    got = {r.source: (r.target, r.kept) for r in logs.reference_inventory(refs, "me").collect()}
    assert {v[0] for v in got.values()} == {"docker.io/me/app:1.2", "docker.io/me/y:sha-ab12cd34ef56", "docker.io/me/img:latest", "docker.io/me/nothing:latest"}
    plain = spark.createDataFrame([("docker.io/acme/app:1.2",), ("acme/app:1.2",), (f"quay.io/x/y@sha256:{digest}",), ("localhost:5000/img",)], "source string")
    got = {r.source: (r.target, r.kept) for r in logs.reference_inventory(plain, "me").collect()}
    assert got["acme/app:1.2"] == ("docker.io/me/app:1.2", True)
    assert got["docker.io/acme/app:1.2"] == ("docker.io/me/app:1.2", False)
    assert got[f"quay.io/x/y@sha256:{digest}"] == ("docker.io/me/y:sha-ab12cd34ef56", True)
    assert got["localhost:5000/img"] == ("docker.io/me/img:latest", True)
    assert logs.reference_inventory(plain, "me", ["acme"]).count() == 2


def test_union_inventory(spark):
    a = spark.createDataFrame([("x  # c",), ("",), ("# only",)], "line string")
    b = spark.createDataFrame([("x",), ("  y",)], "line string")
    assert rows(sets.union_inventory(a, b)) == [("x",), ("y",)]


def test_snapshots_with_null_keys(spark):
    before = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    after = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "k string")
    assert rows(sets.new_since(before, after, ["k"])) == [("c",)]
    assert rows(sets.snapshot_diff(before, after, ["k"])) == [("a", "removed"), ("b", "kept"), ("c", "added"), (None, "kept")]


def test_endpoints_default_and_strip(spark):
    df = spark.createDataFrame([("http://h:5000/v3",), ("https://h/v3",), ("",), (None,)], "url string")
    assert rows(logs.endpoint_inventory(df, "url")) == [
        ("http", "h", 1), ("http", "keystone.default.svc.cluster.local", 2), ("https", "h", 1),
    ]


def test_telemetry(spark):
    text = [
        'LOG Environmental Data #0: {"timestamp": 1.5, "temperature": 25.0, "humidity": 70.1, "pressure": 1003.0, "wind_speed": 0.0, "wind_direction": 360}',
        "LOG   Temperature: 25.0", 'LOG Environmental Data #1: {"timestamp": 2.5, "temperature": 16.0, "wind_direction": 0}',
    ]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "run_id string, line_no int, line string")
    readings = telemetry.telemetry_extract(df)
    assert rows(readings, "seq", "temperature", "humidity", "wind_direction") == [(0, 25.0, 70.1, 360), (1, 16.0, None, 0)]
    assert rows(telemetry.range_check(readings, ["seq"]), "seq", "metric", "value") == [(0, "temperature", 25.0)]
    angles = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("b", 90.0)], "k string, deg double")
    means = {r.k: round(r.direction, 6) % 360 for r in telemetry.circular_mean(angles, ["k"], F.col("deg")).collect()}
    assert means == {"a": 0.0, "b": 90.0}


SITES = [("production", None), ("staging", "production"), ("development", "staging")]


def test_site_chain(spark):
    sites = spark.createDataFrame(SITES, "site string, parent string")
    assert rows(trees.site_paths(sites, "site", "parent"), "node", "depth", "path", "state") == [
        ("development", 2, "production/staging/development", "ok"), ("production", 0, "production", "ok"), ("staging", 1, "production/staging", "ok"),
    ]
    configs = spark.createDataFrame(
        [("production", "region", "east"), ("production", "timezone", "A"), ("staging", "timezone", "B")], "site string, key string, value string"
    )
    assert rows(trees.effective_site_config(sites, "site", "parent", configs), "node", "key", "value", "source") == [
        ("development", "region", "east", "production"), ("development", "timezone", "B", "staging"),
        ("production", "region", "east", "production"), ("production", "timezone", "A", "production"),
        ("staging", "region", "east", "production"), ("staging", "timezone", "B", "staging"),
    ]
    devices = spark.createDataFrame([("development",), ("development",), ("production",)], "site string")
    assert rows(trees.site_device_count(sites, "site", "parent", devices, "site")) == [("development", 2, 2), ("production", 1, 3), ("staging", 0, 2)]


def test_broken_trees_are_reported(spark):
    nodes = [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s"), ("m", "gone"), ("n", "m"), ("top", ""), ("t1", "top")]
    nodes += [(f"d{i}", f"d{i - 1}" if i else None) for i in range(12)]
    sites = spark.createDataFrame(nodes, "site string, parent string")
    state = {r.node: r.state for r in trees.site_paths(sites, "site", "parent").collect()}
    assert {state[n] for n in "abcs"} == {"cycle"}
    assert state["m"] == state["n"] == "missing parent"
    assert state["top"] == state["t1"] == state["d11"] == "ok"
    found = {r.node: (r.root, r.depth, r.resolved) for r in trees.tree_roots(sites, "site", "parent").collect()}
    assert len(found) == len(nodes)
    assert found["d11"] == ("d0", 11, True) and found["n"] == ("gone", 2, True) and found["top"] == ("top", 0, True)
    assert [found[n] for n in "abcs"] == [(None, None, False)] * 4


def test_closure_against_brute_force(spark):
    parents = {i: (i * 7 + 3) % i if i else None for i in range(200)}
    sites = spark.createDataFrame(list(parents.items()), "site int, parent int")
    want = set()
    for node in parents:
        at, distance = node, 0
        while at is not None:
            want.add((node, at, distance))
            at, distance = parents[at], distance + 1
    got = trees.site_closure(sites, "site", "parent").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def plain_tree(parents, configs, devices):
    """Nearest settings and subtree counts by walking up from every site; a walk ends before it would repeat."""
    nodes = set(parents) | {p for p in parents.values() if p is not None}
    settings, below = {}, dict.fromkeys(nodes, 0)
    for node in nodes:
        at, seen, distance = node, set(), 0
        while at is not None and at not in seen:
            seen.add(at)
            below[at] += devices.get(node, 0)
            for key, value in configs.get(at, {}).items():
                settings.setdefault((node, key), (value, at, distance))
            at, distance = parents.get(at), distance + 1
    return settings, {n: (devices.get(n, 0), below[n]) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_settings_and_counts_against_a_walk(spark, seed):
    import random

    r = random.Random(seed)
    parents = {i: r.choice([None, *range(i)]) if i else None for i in range(150)}
    if seed % 2:  # rings of three, of one, and one with branches; a parent that is no site
        parents |= {0: 1, 1: 2, 2: 0, 10: 10, 20: 40, 40: 20, 60: 999}
    configs = {i: {k: f"{k}{i}" for k in "abc" if r.random() < 0.1} for i in [*range(150), 999]}
    devices = {i: r.randrange(4) for i in [*range(150), 999] if r.random() < 0.7}
    sites = spark.createDataFrame([*parents.items(), (None, 3), (7, parents[7])], "site int, parent int")
    rules = spark.createDataFrame([(i, k, v) for i, c in configs.items() for k, v in c.items()] + [(5000, "a", "x")], "site int, key string, value string")
    held = spark.createDataFrame([(i,) for i, n in devices.items() for _ in range(n)] + [(5000,), (None,)], "at int")
    settings, counts = plain_tree(parents, configs, devices)
    found = trees.effective_site_config(sites, "site", "parent", rules)
    assert rows(found, "node", "key", "value", "source", "distance") == sorted([(n, k, *v) for (n, k), v in settings.items()], key=repr)
    assert rows(trees.site_device_count(sites, "site", "parent", held, "at")) == sorted([(n, *c) for n, c in counts.items()], key=repr)


def test_a_chain_of_a_hundred_thousand_sites(spark, monkeypatch):
    n, most, plain = 100_000, [0], trees.stage

    def measured(df, name):
        out = plain(df, name)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(trees, "stage", measured)
    chain = spark.range(n).select(F.col("id").alias("site"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    counts = trees.site_device_count(chain, "site", "parent", spark.range(n).withColumnRenamed("id", "at"), "at")
    assert counts.where(F.col("subtree") != n - F.col("site")).count() == 0 and counts.count() == n
    rules = spark.createDataFrame([(0, "zone", "a"), (50_000, "zone", "b"), (10, "rate", "c")], "site long, key string, value string")
    found = trees.effective_site_config(chain, "site", "parent", rules).groupBy("key", "value", "source").agg(
        F.count("*").alias("n"), F.max("distance").alias("far"))
    assert rows(found) == [("rate", "c", 10, 99_990, 99_989), ("zone", "a", 0, 50_000, 49_999), ("zone", "b", 50_000, 50_000, 49_999)]
    assert most[0] <= 2 * n  # a row per site, or per site and key


def test_deep_chains_are_whole(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(80)], "site int, parent int")
    counts = {r.node: r["count"] for r in trees.site_closure(chain, "site", "parent").groupBy("node").count().collect()}
    assert counts == {i: i + 1 for i in range(80)}
    paths = {r.node: r for r in trees.site_paths(chain, "site", "parent").collect()}
    assert paths[79].depth == 79 and paths[79].top == 0 and paths[79].state == "ok" and paths[79].path == "/".join(map(str, range(80)))
    long = spark.createDataFrame([(i, i - 1 if i else None, False) for i in range(5000)], "site int, parent int, pending boolean")
    found = {r.node: (r.root, r.depth, r.resolved) for r in trees.request_tree(long, "site", "parent", "pending").collect()}
    assert found == {i: (0, i, True) for i in range(5000)}
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)] + [(100, 5)], "site int, parent int")
    pairs = trees.site_closure(ring, "site", "parent")
    assert pairs.count() == 40 * 40 + 41 and pairs.distinct().count() == pairs.count()


def test_rows_with_null_keys_stay(spark):
    from fleetlens.operators import aggregates, matching, projections, ranking

    first = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, name string")
    assert sorted(map(tuple, ranking.first_per_key(first, "name", ["id"]).collect())) == [(1, None, True), (2, None, False), (3, "a", True)]
    nodes = spark.createDataFrame([("n1", None), ("n2", None), ("n3", "s")], "node string, site string")
    work = spark.createDataFrame([("n1",)], "node string")
    assert {r.node for r in aggregates.least_loaded(nodes, work, ["site"]).collect()} == {"n2", "n3"}
    agents = spark.createDataFrame([(None, "h1", 1, 1, 0), (None, "h2", 0, 2, 0)], "site string, hostname string, ragent int, created_at int, online int")
    assert {r.hostname: r.ragent for r in ranking.elect_singleton(agents, ["site"]).collect()} == {"h1": 0, "h2": 1}
    current = spark.createDataFrame([(1, "old", "old")], "k int, p string, q string")
    patches = spark.createDataFrame([(1, 2, "new", ""), (1, 1, "older", "new"), (1, 3, "", "")], "k int, at int, p string, q string")
    assert tuple(projections.sparse_patch(current, patches, ["k"], order=["at"]).first()) == (1, "new", "new")
    source = spark.createDataFrame([(1, 5, "zz"), (1, 9, "aa")], "k int, at int, p string")
    assert matching.upsert_merge(current, source, ["k"], ["p"], ["at"]).first().p == "aa"
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "k int, v string")
    plan = {r.k: r.action for r in matching.reconcile_plan(twice, twice.limit(0), ["k"], ["v"]).collect()}
    assert plan == {1: "repeated", 2: "create"}


def test_bindings_compare_their_subject_lists(spark):
    schema = "namespace string, binding string, role string, subject string"
    want = spark.createDataFrame([("n", "b", "r", "u1"), ("n", "b", "r", "u2"), (None, "c", "r", "u")], schema)
    have = spark.createDataFrame([("n", "b", "r", "u2"), ("n", "b", "r", "u1"), (None, "c", "q", "x")], schema)
    got = {r.binding: (r.subjects, r.action, r.subjects_changed) for r in permissions.role_binding_drift(want, have).collect()}
    assert got == {"b": (["u1", "u2"], "patch", False), "c": (["u"], "recreate", True)}
    rules = permissions.role_rules(spark, "iot", "config", "site-{}")
    bound = spark.createDataFrame([("root", "site-admin", None), ("pm", "site-admin", "n")], "subject string, role string, namespace string")
    asks = spark.createDataFrame([("root", None, "iot", "sites", "create"), ("pm", None, "iot", "sites", "create")],
                                 "subject string, namespace string, api_group string, resource string, verb string")
    assert {r.subject: r.allowed for r in permissions.can_i(asks, bound, rules).collect()} == {"root": True, "pm": False}


def test_permissions(spark):
    rules = permissions.role_rules(spark, "iot", "config")
    bindings = spark.createDataFrame(
        [("op", "operator", None), ("ro", "viewer", None), ("root", "admin", None), ("pm", "manager_project", "ns1")],
        "subject string, role string, namespace string",
    )
    asks = spark.createDataFrame([
        ("op", "ns1", "iot", "sites", "delete"), ("op", "ns1", "iot", "devices", "delete"), ("ro", "ns2", "iot", "devices", "update"),
        ("ro", "ns2", "iot", "devices/status", "get"), ("root", "ns1", "iot", "sites", "create"), ("op", "ns1", "config", "providerconfigs", "get"),
        ("pm", "ns1", "apps", "deployments", "create"), ("pm", "ns2", "apps", "deployments", "create"), ("pm", "ns1", "any", "thing", "watch"),
        ("nobody", "ns1", "iot", "sites", "get"),
    ], "subject string, namespace string, api_group string, resource string, verb string")
    answers = {tuple(r[:-1]): r[-1] for r in permissions.can_i(asks, bindings, rules).collect()}
    assert [answers[tuple(r)] for r in asks.collect()] == [False, True, False, True, True, False, True, False, True, False]
    held = permissions.effective_permissions(bindings, rules)
    assert held.where("subject = 'root'").count() == 4 * 7 + 4 * 3 + 3


def test_claims_and_bindings(spark):
    users = spark.createDataFrame([("u", ["grp:a-b:admin", "grp:two", "x:grp:no", "grp:two"]), ("v", None)], "username string, groups array<string>")
    assert rows(permissions.group_claims(users, "^grp:")) == [
        ("u", "federated_users", "", ""), ("u", "grp:a-b:admin", "grp:a-b", "admin"), ("u", "grp:two", "grp:two", ""), ("v", "federated_users", "", ""),
    ]
    desired = spark.createDataFrame([("n", "a", "r1", "s"), ("n", "b", "r1", "s"), ("n", "c", "r1", "s"), ("n", "d", "r1", "s")], "namespace string, binding string, role string, subject string")
    existing = spark.createDataFrame([("n", "b", "r2", "s"), ("n", "c", "r1", "t"), ("n", "d", "r1", "s")], "namespace string, binding string, role string, subject string")
    assert rows(permissions.role_binding_drift(desired, existing), "binding", "action", "subjects_changed") == [
        ("a", "create", False), ("b", "recreate", False), ("c", "patch", True), ("d", "patch", False),
    ]


def test_conformance_and_audits(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "id string, code string, agent string")
    new = spark.createDataFrame([("a", "1", "y"), ("b", "3", "x"), ("c", "9", "z")], "id string, code string, agent string")
    assert rows(quality.immutability_audit(old, new, "id", ["code", "agent"])) == [("a", "agent", None, "y"), ("b", "code", "2", "3")]
    bodies = spark.createDataFrame([(1, '{"name": 1, "url": null}'), (2, "{}"), (3, None)], "id int, body string")
    assert rows(quality.missing_fields(bodies, "body", ["name", "url"]), "id", "missing") == [(2, "name, url"), (3, "name, url")]


def test_counts(spark):
    probes = spark.createDataFrame([("n", 200, 0.1, None), ("n", 500, 0.9, None), ("n", None, None, "down")], "node string, http_status int, response_time double, error string")
    assert rows(aggregates.node_health(probes)) == [("n", 3, 1, 1, 1, 0.9)]
    pods = spark.createDataFrame([("a", True), ("a", False), ("a", None)], "namespace string, ready boolean")
    assert rows(aggregates.ready_ratio(pods)) == [("a", 1, 3)]
    items = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "line string")
    assert rows(aggregates.inventory_count(items, "line", F.col("line") == "x")) == [(2, 1)]
    assert rows(aggregates.inventory_count(items, "line", F.col("line") == "x", approximate=True)) == [(2, 1)]
    inj = spark.createDataFrame([("b", "p"), ("b", "p"), ("b", "q")], "board string, plugin string")
    asks = spark.createDataFrame([("b", "p"), ("b", "q"), ("c", "p")], "board string, plugin string")
    assert rows(matching.existence_check(asks, inj, ["board", "plugin"])) == [("b", "p", 2, False), ("b", "q", 1, True), ("c", "p", 0, False)]
