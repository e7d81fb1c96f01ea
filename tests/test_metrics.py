"""Latency figures, drift and streams against plain loops, with hot keys and in any order of arrival."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vellum.operators import quality
from vellum.streaming import metrics


@pytest.mark.parametrize("cells", [1, 7, 4096])
def test_percentiles_of_a_hot_key(spark, cells):
    rnd = random.Random(cells)
    rows = [("hot", rnd.choice([rnd.random(), round(rnd.random(), 1), 1e9 * (rnd.random() > 0.99)])) for _ in range(3000)]
    rows += [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), ("low", -3.0), ("low", 4.0)] + [("few", float(k)) for k in range(10)]
    found = {r["k"]: tuple(r)[1:] for r in quality.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.5, 0.95, 0.99), cells).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(own[int(len(own) * p)] for p in (0.0, 0.5, 0.95, 0.99))
    assert found == want


def plain_verdicts(runs):
    """The rules run by run: (seq, p50, err_rate)."""
    passed, alerts, out = [], 0, []
    for _, p50, err in runs:
        said = "PASS"
        if p50 is None or err > 0.1:
            said = "INFRA"
        elif p50 > 300:
            said = "HALT"
        elif passed:
            base = statistics.median(passed[-3:])
            said = "HALT" if p50 > 1.1 * base else "ALERT" if p50 > 280 or p50 > 1.05 * base else "PASS"
        if said == "PASS":
            alerts = 0
            passed.append(p50)
        elif said == "ALERT" and p50 <= 280:
            alerts += 1
            said = "HALT" if alerts >= 2 else said
        out.append(said)
    return out, passed[-6:]


def test_verdicts_and_retained_passes(spark):
    rnd = random.Random(3)
    rows = [(f"s{k}", i, rnd.choice([None, 200.0, 205.0, 212.0, 216.0, 225.0, 285.0, 310.0, 290.0]), rnd.choice([0.0, 0.0, 0.0, 0.2])) for k in range(6) for i in range(1, 150)]
    rnd.shuffle(rows)
    runs = spark.createDataFrame(rows, "scenario string, seq long, p50 double, err_rate double")
    judged = quality.verdicts(runs)
    got = {}
    for r in judged.orderBy("scenario", "seq").collect():
        got.setdefault(r["scenario"], []).append(r["verdict"])
    last = {}
    for r in quality.last_passes(runs, judged).orderBy("scenario", "seq").collect():
        last.setdefault(r["scenario"], []).append(r["p50"])
    for name in got:
        assert (got[name], last[name]) == plain_verdicts(sorted(x[1:] for x in rows if x[0] == name))
    assert {"PASS", "ALERT", "HALT", "INFRA"} <= {v for x in got.values() for v in x}


def test_alerts_in_any_order_of_arrival(spark, tmp_path):
    """More rows than an Arrow batch, shuffled over files that come one at a time."""
    rnd = random.Random(4)
    rows = [(i, f"2024-01-01 {i // 600 % 24:02d}:{i // 10 % 60:02d}:{rnd.randint(0, 59):02d}", rnd.choice("ab"), float(rnd.choice([100, 400]))) for i in range(14_400)]
    shuffled = rnd.sample(rows, len(rows))
    schema = "event_id long, ts string, event_type string, value double"
    size = -(-len(rows) // 4)
    for k in range(4):
        spark.createDataFrame(shuffled[k * size : (k + 1) * size], schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = {r["event_id"]: r["alerts"] for r in metrics.drained(metrics.running_alerts(metrics.events_stream(spark, str(tmp_path), 1), late="1 day")).collect()}
        assert found == {}
        found = {r["event_id"]: (r["route"], r["alerts"]) for r in metrics.drained(metrics.running_alerts(metrics.events_stream(spark, str(tmp_path), 4), late="2 hours")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = max(r[1] for r in rows)
    want, count = {}, {"a": 0, "b": 0}
    for i, ts, route, value in sorted(rows, key=lambda r: (r[1], r[0])):
        count[route] = count[route] + 1 if value > 280 else 0
        if ts <= f"2024-01-01 {int(last[11:13]) - 2:02d}{last[13:]}":
            want[i] = (route, count[route])
    assert found == want and len(want) > 10_000


def test_alerts_over_several_triggers(spark, tmp_path):
    """Files that overlap in time by less than what the watermark waits for."""
    rnd = random.Random(5)
    rows = [(i, f"2024-01-0{1 + i // 1000} {i % 1000 // 42:02d}:{rnd.randint(0, 59):02d}:00", "a", float(rnd.choice([100, 400]))) for i in range(4000)]
    schema = "event_id long, ts string, event_type string, value double"
    for k in range(4):
        own = rows[k * 1000 : (k + 1) * 1000]
        rnd.shuffle(own)
        spark.createDataFrame(own, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = {r["event_id"]: r["alerts"] for r in metrics.drained(metrics.running_alerts(metrics.events_stream(spark, str(tmp_path), 1), late="30 days")).collect()}
    assert found == {}
    found = {r["event_id"]: r["alerts"] for r in metrics.drained(metrics.running_alerts(metrics.events_stream(spark, str(tmp_path), 1), late="25 hours")).collect()}
    last, want, count = max(r[1] for r in rows), {}, 0
    for i, ts, _, value in sorted(rows, key=lambda r: (r[1], r[0])):
        count = count + 1 if value > 280 else 0
        want[i] = count
    assert found and all(want[i] == n for i, n in found.items()) and len(found) >= 2500 and last


def test_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        metrics.shared_folder(Session())
