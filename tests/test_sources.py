"""Files written and read back, and models read."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracework.log import InvalidLog
from tracework.operators import snapshot as P
from tracework.sources import files as S

MODEL = """<?xml version="1.0"?><bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL"><bpmn:process id="p">
<bpmn:startEvent id="s"/><bpmn:task id="t1" name="A"/><bpmn:task id="t2"/><bpmn:exclusiveGateway id="g" name="G"/><bpmn:exclusiveGateway id="h"/><bpmn:endEvent id="e" name="End"/>
<bpmn:sequenceFlow id="f1" sourceRef="s" targetRef="t1"/><bpmn:sequenceFlow id="f2" sourceRef="t1" targetRef="g"/><bpmn:sequenceFlow id="f3" sourceRef="g" targetRef="h"/>
<bpmn:sequenceFlow id="f4" sourceRef="h" targetRef="g"/><bpmn:sequenceFlow id="f5" sourceRef="h" targetRef="e"/></bpmn:process></bpmn:definitions>"""


def test_model_and_upstream(spark, tmp_path):
    (tmp_path / "m.bpmn").write_text(MODEL)
    nodes, flows = S.read_model(spark, str(tmp_path / "m.bpmn"))
    assert {(r["node_id"], r["kind"], r["name"]) for r in nodes.collect()} == {("s", "startEvent", "Unnamed startEvent s"), ("t1", "task", "A"), ("t2", "task", "Unnamed Task t2"), ("g", "exclusiveGateway", "G"), ("h", "exclusiveGateway", "Unnamed exclusiveGateway h"), ("e", "endEvent", "End")}
    assert flows.count() == 5
    assert {(r["node_id"], r["task"]) for r in P.upstream_tasks(nodes, flows).collect()} == {("g", "t1"), ("h", "t1")}


def test_logs(spark, tmp_path):
    rows = [("c", "A", "R", "2024-01-01T10:00:00Z", "2024-01-01T11:00:00.123456+02:00"), ("c", "B", "R", "", "nonsense")]
    spark.createDataFrame(rows, "CaseId string, Activity string, Resource string, StartTime string, EndTime string").coalesce(1).write.csv(str(tmp_path / "x.csv"), header=True)
    got = S.read_event_log(spark, str(tmp_path / "x.csv")).orderBy("activity").collect()
    assert got[0]["start_time"] == datetime(2024, 1, 1, 10) and got[0]["end_time"].microsecond == 123456 and got[1]["start_time"] is None and got[1]["end_time"] is None
    with pytest.raises(InvalidLog):
        S.read_event_log(spark, str(tmp_path / "x.csv"), required=["enable_time"])
    log, missing = S.read_mapped(spark, str(tmp_path / "x.csv"))
    assert missing.first()["missing_ends"] == 1 and S.present(["activity", "none"], log) == ["activity"]


def test_snapshot_attributes_and_ids(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc)
    log = spark.createDataFrame([(0, "c", "A", "R", at(9), at(10), "BUSINESS", 10), (1, "c", "B", "R", at(10), None, None, 20)], "id long, case_id string, activity string, resource string, start_time timestamp, end_time timestamp, client_type string, stage int")
    nodes = spark.createDataFrame([("a", "task", "A"), ("b", "task", "B"), ("z", "endEvent", "End")], "node_id string, kind string, name string")
    flows = spark.createDataFrame([("f1", "a", "b"), ("f2", "b", "z")], "flow_id string, source string, target string")
    index = spark.createDataFrame([(["A+COMPLETE", "B+START"], ["a", "b"])], "gram array<string>, marking array<string>")
    got = P.snapshot(log, nodes, flows, index, ["client_type"], ["stage"])
    r = got.first()
    assert r["case_attributes"] == {"client_type": "BUSINESS"} and r["event_attributes"] == {"stage": "20"}
    assert r["activities"] == ["b"] and [x["label"] for x in r["ongoing_activities"]] == ["B"] and r["ongoing_activities"][0]["event_attributes"] == {"stage": "20"}
    S.write_snapshot(str(tmp_path / "s"), got, log.agg(F.max("start_time").alias("last_case_arrival")))
    assert [x["case_id"] for x in S.read_snapshot_ids(spark, str(tmp_path / "s")).collect()] == ["c"]
    assert S.read_snapshot_ids(spark, str(tmp_path / "absent")).count() == 0


def test_model_under_any_prefix(spark, tmp_path):
    """The same elements with another prefix, without one, and within a sub-process; a name may hold marks."""
    nodes, flows = S.read_model(spark, _written(tmp_path, "a", MODEL))
    want = sorted(map(repr, nodes.collect())), sorted(map(repr, flows.collect()))
    for name, text in (("b", MODEL.replace("bpmn:", "m2:").replace(":bpmn", ":m2")), ("c", MODEL.replace("bpmn:", "").replace("xmlns:bpmn", "xmlns"))):
        got = S.read_model(spark, _written(tmp_path, name, text))
        assert tuple(sorted(map(repr, x.collect())) for x in got) == want
    inner = MODEL.replace('<bpmn:task id="t2"/>', '<bpmn:subProcess id="sub"><bpmn:task id="t2" name="a &lt; b &amp; c"/></bpmn:subProcess>')
    assert ("t2", "a < b & c") in {(r["node_id"], r["name"]) for r in S.read_model(spark, _written(tmp_path, "d", inner))[0].collect()}


def _written(folder, name, text):
    (folder / f"{name}.bpmn").write_text(text)
    return str(folder / f"{name}.bpmn")


def test_sorted_sink(spark, tmp_path):
    at = [datetime(2024, 1, 1 + (k * 7) % 20, (k * 5) % 24, tzinfo=timezone.utc) for k in range(300)]
    log = spark.createDataFrame([(k, t, "A") for k, t in enumerate(at)], "id long, start_time timestamp, activity string").repartition(3)
    path = str(tmp_path / "sorted")
    S.write_sorted(log, path, 1000)
    order = sorted(range(300), key=lambda k: (at[k], k))
    assert {r["id"]: r["place"] for r in S.read_places(spark, path).collect()} == {k: i for i, k in enumerate(order)}
    a, b = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 6, 12, tzinfo=timezone.utc)
    got = S.read_between(spark, path, F.lit(a), F.lit(b))
    assert {r["id"] for r in got.collect()} == {k for k in range(300) if a <= at[k] <= b}
    assert 0 < len(got.inputFiles()) < len(spark.read.parquet(path).inputFiles()) and S.read_between(spark, path, F.lit(b.replace(year=2030)), F.lit(b.replace(year=2031))).count() == 0
