"""Alerts in batch, as a stream and as a stream that was stopped and started again, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mnemolake.streaming import alerting

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
RULES = (alerting.Rule("high", "x", "gt", 5.0, 100.0, "error", 400.0), alerting.Rule("low", "x", "lt", 2.0, 0.0, "warning", 0.0), alerting.Rule("other", "y", "ge", 1.0, 30.0, "critical", 90.0))
SCHEMA = "metric string, key string, ts timestamp, value double"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def loops(samples, rules, now):
    out = []
    for r in rules:
        for key in {s[1] for s in samples}:
            series = {}
            for metric, k, t, value in samples:
                if metric == r.metric and k == key and value is not None:
                    hit = {"gt": value > r.threshold, "lt": value < r.threshold, "ge": value >= r.threshold}[r.comparator]
                    series[t] = series.get(t, False) or hit
            times, last, k = sorted(series), None, 0
            while k < len(times):
                if not series[times[k]]:
                    k += 1
                    continue
                start = times[k]
                while k < len(times) and series[times[k]]:
                    k += 1
                end = times[k] if k < len(times) else None
                fire = start + datetime.timedelta(seconds=r.hold)
                if last is not None:
                    fire = max(fire, last + datetime.timedelta(seconds=r.cooldown))
                if fire <= now and (end is None or fire < end):
                    last = fire
                    out.append((r.name, key, r.severity, fire, "fired"))
                    if end is not None and end <= now:
                        out.append((r.name, key, r.severity, end, "resolved"))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    level = {}
    out = []
    for k in range(n):
        key = rng.choice("abc")
        level[key] = rng.choice([1.0, 3.0, 9.0]) if rng.random() < 0.2 else level.get(key, 3.0)
        out.append((rng.choice("xxy"), key, at(k * 17), level[key]))
    return out


def events(spark, df):
    return sorted((r["rule"], r["key"], r["severity"], r["at"].replace(tzinfo=datetime.timezone.utc), r["event"]) for r in df.collect())


def test_batch(spark):
    samples = made(1, 600) + [("x", "a", at(50), None), ("z", "a", at(60), 9.0)]
    now = at(600 * 17)
    got = events(spark, alerting.as_events(alerting.fired(spark.createDataFrame(samples, SCHEMA), RULES, now)))
    assert got == loops(samples, RULES, now) and len(got) > 40
    assert alerting.fired(spark.createDataFrame([], SCHEMA), RULES, now).count() == 0
    assert len(alerting.DEFAULT_RULES) == 5


@pytest.mark.parametrize("stops", [(), (2,)])
def test_stream(spark, tmp_path, stops):
    """Files of samples in turn, some of them late, with the stream ended and started again from its checkpoint between them."""
    samples = made(2, 300)
    end = at(300 * 17)
    rng = random.Random(3)
    # a file holds samples that are up to 120 seconds late
    order = sorted(range(len(samples)), key=lambda k: k * 17 + rng.uniform(0, 120))
    files = [[samples[k] for k in order[low : low + 60]] for low in range(0, 300, 60)] + [[("none", "a", end + datetime.timedelta(days=d), 0.0)] for d in (1, 2)]
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = alerting.alert_stream(stream, RULES + (alerting.Rule("none", "none", "gt", 1.0),), "300 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if k in stops:
            run()
    run()
    got = events(spark, spark.read.parquet(out).filter(F.col("rule") != "none"))
    assert got == loops(samples, RULES, end + datetime.timedelta(hours=12)) and len(got) > 20
