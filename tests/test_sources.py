"""Readers and writers on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.values import condition_status
from fleetlens.operators.projections import nested_extract, resource_summary
from fleetlens.operators.quality import BOARD_RULES, SERVICE_RULES, conformance
from fleetlens.sources.lists import list_items
from fleetlens.sources.scans import api_capture_scan, log_scan, registry_scan, resource_scan
from fleetlens.sources.sinks import report_sink

MANIFEST = """---
kind: Site
metadata:
  name: production
spec:
  forProvider:
    name: Production
    config: {region: east, timezone: A}
---
kind: Site
metadata:
  name: staging
spec:
  forProvider:
    name: Staging
    parentSite: production
    config: {timezone: B}
---
kind: Device
metadata:
  name: pi
  labels: {site: staging}
spec:
  forProvider:
    code: pi-1
    type: raspberry-pi
    location: [{latitude: "1.5", longitude: "2"}]
"""


def device(name, **spec):
    return {
        "kind": "Device",
        "metadata": {"name": name, "creationTimestamp": "2026-01-01T00:00:00Z", "annotations": {"crossplane.io/external-name": name + "-x"}},
        "spec": {"forProvider": spec, "deletionPolicy": "Delete"},
        "status": {"conditions": [{"type": "Ready", "status": "True"}, {"type": "Synced", "status": "False"}]},
    }


def test_list_export_and_single_documents(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"kind": "List", "items": [device("a", code="A"), device("b", code="B")]}, indent=2))
    (tmp_path / "one.json").write_text(json.dumps(device("c", code="C"), indent=2))
    df = resource_scan(spark, str(tmp_path), "Device")
    assert sorted(r.name for r in df.collect()) == ["a", "b", "c"]
    line = resource_summary(df, F.lit("2026-01-01 00:01:30").cast("timestamp")).where("name = 'a'").first()
    assert (line.code, line.ready, line.synced, line.external_name, line.age_s) == ("A", "True", "False", "a-x", 90)


def test_list_exports_by_line(spark, tmp_path):
    lines = [{"items": [device("a", code="A"), device("b", code="B")]}, device("c", code="C"), {"items": []}]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)))
    assert resource_scan(spark, str(tmp_path), "Device", "jsonl").count() == 3


def test_manifests_split_between_documents(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    sites = {r.name: r for r in resource_scan(spark, str(tmp_path), "Site", "yaml").collect()}
    assert sites["staging"].spec.parentSite == "production"
    assert sites["production"].spec.config == {"region": "east", "timezone": "A"}
    devices = resource_scan(spark, str(tmp_path), "Device", "yaml")
    assert devices.first().spec.location[0].latitude == "1.5"
    flat = devices.select("name", F.col("spec.name").alias("n"), "spec.code", "spec.type", "spec.status").drop("name").withColumnRenamed("n", "name")
    broken = {(r.column, r.rule) for r in conformance(flat, ["code"], BOARD_RULES).collect()}
    assert broken == {("type", "enum"), ("name", "required")}


def test_values_that_no_type_takes_cost_one_row(spark, tmp_path):
    good = "kind: Site\nmetadata:\n  name: %s\nspec:\n  forProvider:\n    name: %s\n"
    docs = [
        good % ("a", "2024-13-45"), good % ("b", "2024-02-03"), "kind: Site\n? [1, 2]\n: x\n", "kind: Site\nmetadata: {name: c, [1]: 2}\n",
        "kind: [", good % ("d", "!!timestamp 2024-13-45"), "kind: Site\nspec: " + "[" * 3000 + "]" * 3000 + "\n", good % ("e", "!!python/object:os.system x"),
        good % ("f", "!!set {x, y}"), good % ("z", "end")]
    (tmp_path / "m.yaml").write_text("\n---\n".join(docs))
    (tmp_path / "windows.yaml").write_bytes(("\r\n---\r\n".join([good % ("w1", "2024-13-45"), good % ("w2", "!!timestamp x"), good % ("w3", "c")])).encode())
    found = resource_scan(spark, str(tmp_path), "Site", "yaml").collect()
    read = {r.name: r.spec.name for r in found if r.error is None}
    assert {n: read[n] for n in ("a", "b", "z", "w1", "w3")} == {"a": "2024-13-45", "b": "2024-02-03", "z": "end", "w1": "2024-13-45", "w3": "c"}
    bad = [r for r in found if r.error is not None]
    assert len(bad) >= 6 and all(r.file.endswith(".yaml") and r.name is None for r in bad)
    assert any("kind: [" in r.error for r in bad) and any("2024-13-45" in r.error for r in bad)


def nested(r, depth=0):
    if depth > 3 or r.random() < 0.4:
        return r.choice(["x", "}", '{"a":[', "\\", '\\"', '"items":[{', "é}", "a\nb\t", 5, None, True, 1.5, ""])
    if r.random() < 0.5:
        return {r.choice(["a", "items", "b}", 'q"']): nested(r, depth + 1) for _ in range(r.randint(0, 3))}
    return [nested(r, depth + 1) for _ in range(r.randint(0, 3))]


@pytest.mark.parametrize("split", ["300", "134217728"])
def test_list_items_over_many_splits(spark, tmp_path, split):
    r = random.Random(5)
    want = []
    for f in range(5):
        items = [{"n": f * 1000 + i, "v": nested(r), "w": nested(r)} for i in (range(0), range(1), range(40))[f % 3]]
        if f == 3:
            items.append({"n": 9999, "big": [{"x": "}" * 50, "y": {"z": i}} for i in range(100)]})
        doc = {
            "kind": "List", "metadata": {"items": [{"no": 1}], "b": {"c": {"d": 1}}}, "other": [{"n": -1}], "items": items,
            "more": {"items": [{"n": -3}]}, "last": [[{"n": -4}]]}
        if f == 4:
            doc = {"kind": "x", "metadata": {"items": [{"n": 1}]}}
        else:
            want += items
        (tmp_path / f"f {f}.json").write_text(json.dumps(doc, indent=(None, 2)[f % 2], ensure_ascii=f < 2) + "\n" * (f % 2))
    for name, value in (("maxPartitionBytes", split), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        got = [json.loads(x.body) for x in list_items(spark, str(tmp_path)).collect()]
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_list_item_that_is_no_resource_is_an_error(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"items": [' + json.dumps(device("a", code="A"), indent=1) + ', {"kind": "Device", "metadata": nonsense}, 5, "x"]}')
    found = resource_scan(spark, str(tmp_path), "Device", "list").collect()
    assert sorted((r.name or "", r.error is not None) for r in found) == [("", True), ("a", False)]


def test_runs_below_paths_with_blanks_and_signs(spark, tmp_path):
    for folder in ("a b", "c+d", "e%20f", "ü"):
        (tmp_path / "all runs" / folder).mkdir(parents=True)
        (tmp_path / "all runs" / folder / "run 1.log").write_text("x\ny\n")
    found = log_scan(spark, str(tmp_path / "all runs"))
    assert {(r.run_id, r.n) for r in found.groupBy("run_id").agg(F.max("line_no").alias("n")).collect()} == {
        (f"{d}/run 1", 2) for d in ("a b", "c+d", "e%20f", "ü")}


def test_service_protocol_case_matters(spark):
    df = spark.createDataFrame([("s", 80, "tcp"), ("t", 0, "UDP"), ("u", 65535, "TCP")], "name string, port int, protocol string")
    got = {(r.name, r.column, r.rule) for r in conformance(df.withColumn("key", F.col("name")), ["name"], SERVICE_RULES).collect()}
    assert got == {("s", "protocol", "enum"), ("t", "port", "minimum")}


def test_registry_columns_that_a_file_lacks_are_null(spark, tmp_path):
    spark.createDataFrame([("u", "c")], "uuid string, code string").write.parquet(str(tmp_path / "boards.parquet"))
    assert registry_scan(spark, str(tmp_path), "boards").first().agent is None


def test_api_payload_shapes(spark):
    bodies = [
        (1, '{"service": "a", "public_port": 1}'), (2, '[{"service": "b", "public_port": 2}, {"service": "c"}]'),
        (3, '{"exposed": [{"service": "d", "public_port": 4}]}'), (4, "not json"), (5, '{"exposed": []}'),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    got = api_capture_scan(df, "body", "service string, public_port int", "exposed")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", 1), (2, "b", 2), (2, "c", None), (3, "d", 4), (4, None, None), (5, None, None)]


def test_log_lines_are_numbered_over_many_splits(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for run, n in (("long", 5000), ("short", 3)):
        (logs / f"{run}.log").write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = log_scan(spark, str(logs))
        assert df.select("line_no", "line").where("line != concat('line ', line_no)").count() == 0
        assert {r.run_id: r.n for r in df.groupBy("run_id").agg(F.max("line_no").alias("n")).collect()} == {"long": 5000, "short": 3}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1)], "code string, n int")
    report_sink(df, str(tmp_path / "tsv"), "tsv", ["code"])
    back = spark.read.option("sep", "\t").option("header", True).schema("code string, n int").csv(str(tmp_path / "tsv"))
    assert [tuple(r) for r in back.orderBy("code", "n").collect()] == [("a", 1), ("b", 1), ("b", 2)]
    report_sink(df.select("code"), str(tmp_path / "text"), "text")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a", "b"]
    report_sink(df, str(tmp_path / "json"), "json")
    assert spark.read.schema("code string, n int").json(str(tmp_path / "json")).count() == 3


def test_nested_extract_drops_missing_null_and_false(spark):
    df = spark.createDataFrame([(1, (True,)), (2, (False,)), (3, (None,)), (4, None)], "id int, s struct<on:boolean>")
    assert [tuple(r) for r in nested_extract(df, "s.on", "on", ["id"]).collect()] == [(1, True)]


def test_condition_status(spark):
    df = spark.createDataFrame([([("Ready", "True")],), ([],), (None,)], "c array<struct<type:string,status:string>>")
    assert [r[0] for r in df.select(condition_status("c", "Ready")).collect()] == ["True", "Unknown", "Unknown"]


def test_lists_bad_documents_and_core_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "list.yaml").write_text(
        "kind: List\nitems:\n- kind: Site\n  metadata: {name: one}\n  status: {atProvider: {deviceCount: 4}}\n- kind: Device\n  metadata: {name: no}\n---\n"
        "kind: [broken\n---\njust text\n---\nkind: Site\nmetadata: {name: two}\n")
    sites = resource_scan(spark, str(tmp_path / "a"), "Site", "yaml").collect()
    assert sorted(r.name for r in sites if r.error is None) == ["one", "two"]
    assert [r.observed.deviceCount for r in sites if r.name == "one"] == [4]
    assert len([r for r in sites if r.error]) == 2 and all(r.file.endswith("list.yaml") for r in sites)
    (tmp_path / "b").mkdir()
    lines = [
        device("d", code="c"), {"kind": "Service", "apiVersion": "v1", "metadata": {"name": "core"}, "spec": {"ports": [{"port": 80}]}},
        {"kind": "Service", "apiVersion": "iot/v1", "metadata": {"name": "iot"}, "spec": {"forProvider": {"port": 22}}},
        {"kind": "ClusterRole", "metadata": {"name": "r"}, "rules": [{"apiGroups": ["*"], "resources": ["sites"], "verbs": ["get"]}]},
        {"kind": "Pod", "metadata": {"name": "p"}, "status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}]}},
    ]
    (tmp_path / "b" / "x.jsonl").write_text("\n".join([*map(json.dumps, lines), '{"kind": "Dev', ""]))
    scan = lambda kind: resource_scan(spark, str(tmp_path / "b"), kind, "jsonl").collect()
    assert [(r.name, bool(r.error)) for r in scan("Device")] == [("d", False), (None, True)]
    assert scan("v1/Service")[0].spec.ports[0].port == 80 and scan("Service")[0].spec.port == 22
    assert scan("ClusterRole")[0].spec.rules[0].resources == ["sites"]
    pod = scan("Pod")[0]
    assert pod.observed.phase == "Running" and pod.conditions[0].status == "True"


def test_runs_of_equal_names_stay_apart(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run.log").write_text("".join(f"{folder}{i}\n" for i in range(1, 50)))
    found = sorted((r.run_id, r.line_no, r.line) for r in log_scan(spark, str(tmp_path)).collect())
    assert found == sorted((f"{f}/run", i, f"{f}{i}") for f in "ab" for i in range(1, 50))


def test_list_exports_are_several_files_and_none_is_written_for_a_few_devices(spark, tmp_path, monkeypatch):
    from fleetlens.plans import projections
    from fleetlens.plans.registry import QUERIES

    made = []

    def path(_, name):
        made.append(tmp_path / f"{name}-out")
        return str(made[-1])

    monkeypatch.setattr(projections, "fresh_path", path)
    monkeypatch.setattr(projections, "LIST_ORDERS", 300, raising=False)
    orders = [(i, "1-URGENT", "F") for i in range(1000)] + [(5, "2-HIGH", "O"), (5, "2-HIGH", "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in QUERIES["S1_list_scan"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"o-{k}", p, s) for k, p, s in orders)
    files = [f.read_text() for f in made[-1].rglob("*.txt")]
    assert len(files) == 4 and all(len(json.loads(f)["items"]) < 300 for f in files)

    spark.range(2).selectExpr("cast(id as int) n_nationkey", "concat('N', id) n_name").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(3000).selectExpr("id s_suppkey", "cast(id % 2 as int) s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted(map(tuple, QUERIES["S1_json_scan"](spark, str(tmp_path)).collect())) == [("n-0", "N0", 1500), ("n-1", "N1", 1500)]
    assert len(list(made[-1].rglob("*.txt"))) == 2
