"""Live metrics: the batch operators' streaming forms. State and outputs live in the checkpoint folder, so a restarted query goes on where it was."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this session's own on one machine, and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share; it isn't set, and the master is {spark.sparkContext.master}")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """Requests as a stream of files; what arrives faster waits for the next trigger."""
    raw = table_stream(spark, sf_dir, "events", files_per_trigger)
    status = F.when(F.col("value") > 200, 500).when(F.col("value") > 150, 400).otherwise(200)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("route"), status.alias("status"), (F.col("value") / 100).alias("duration_s"))


def drained(stream: DataFrame, mode: str = "append", form: str = "parquet") -> DataFrame:
    """K9: everything that the stream gives for what is there now, through an exactly-once file sink; ``form`` "json" makes a line of each row."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format(form).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(form).load(f"{base}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files; what arrives faster waits for the next trigger."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def in_time(requests: DataFrame, budget_s: float) -> DataFrame:
    """Z3: requests that a worker still takes up: those that have waited for longer than their budget are skipped. Needs ts and taken_at."""
    return requests.where(F.col("taken_at") <= F.col("ts") + F.make_dt_interval(secs=F.lit(budget_s)))


def windowed_counters(requests: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counters by route and window; what comes later than the watermark is dropped."""
    s = F.col("status")
    grouped = requests.withWatermark("ts", late).groupBy(F.window("ts", width), "route")
    out = grouped.agg(F.count("*").alias("n"), F.count_if(s < 300).alias("ok"), F.count_if(s >= 500).alias("server_errors"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("from"), "route", "n", "ok", "server_errors")


def page_events(pages: DataFrame) -> DataFrame:
    """A request's pages as events, in any order; (request_id, seq, event, page_index)."""
    return pages.select("request_id", F.col("page_index").alias("seq"), F.when(F.col("failed"), "page_error").otherwise("page").alias("event"), "page_index")


def closed_requests(events: DataFrame) -> DataFrame:
    """The event lines of each request: meta first, pages by index, end with counts last."""
    body = F.array_sort(F.collect_list(F.struct("page_index", "event")))
    rows = events.groupBy("request_id").agg(body.alias("a"), F.count_if(F.col("event") == "page").alias("pages"), F.count_if(F.col("event") == "page_error").alias("errors"))
    line = lambda e: F.to_json(F.struct(e["event"].alias("event"), e["page_index"].alias("page_index")))
    meta = F.to_json(F.struct(F.lit("meta").alias("event"), F.size("a").alias("total")))
    end = F.to_json(F.struct(F.lit("end").alias("event"), F.col("pages"), F.col("errors")))
    return rows.select("request_id", F.array_join(F.concat(F.array(meta), F.transform("a", line), F.array(end)), "\n").alias("lines"))


def running_alerts(requests: DataFrame, ceiling_s: float = 2.8, late: str = "1 day") -> DataFrame:
    """With each request, how many slow ones of its route came in a row: (route, event_id, alerts).

    The order is that of the requests' own times, then of their ids, whatever the order of arrival: a request waits until the watermark has passed it, and
    what comes later than that is dropped. State is a number and the requests that wait, as many as come in the time ``late``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        alerts, waiting = (state.get[0], list(zip(*state.get[1:]))) if state.exists else (0, [])
        if not state.hasTimedOut:
            for frame in frames:
                micros = frame["ts"].astype("datetime64[us]").astype("int64")
                waiting += zip(micros.tolist(), frame["event_id"].tolist(), (frame["duration_s"] > ceiling_s).tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ids, counts = [], []
        for at, event, slow in waiting:
            if at > passed:
                break
            alerts = alerts + 1 if slow else 0
            ids.append(event)
            counts.append(alerts)
        waiting = waiting[len(ids) :]
        state.update((alerts, [w[0] for w in waiting], [w[1] for w in waiting], [bool(w[2]) for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"route": key[0], "event_id": ids, "alerts": counts})

    kept = "alerts long, at array<long>, id array<long>, slow array<boolean>"
    given = requests.select("ts", "route", "event_id", "duration_s").withWatermark("ts", late)
    return given.groupBy("route").applyInPandasWithState(step, "route string, event_id long, alerts long", kept, "append", GroupStateTimeout.EventTimeTimeout)
