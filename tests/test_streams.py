"""Streams against their batch forms: several sinks, stream joins, running summaries, late spans."""

import json
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from skeinwatch.functions import shared
from skeinwatch.operators import compare, traces
from skeinwatch.sources import tables
from skeinwatch.streaming import ingest, outbox, samples, streams

T0 = datetime(2024, 1, 1)
SPANS = (
    "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, start_time timestamp, "
    "end_time timestamp, status_code int, status_message string"
)


@pytest.fixture
def folder(spark):
    return shared.new_folder(spark, "stream-test")


def stream(spark, path, ddl):
    return spark.readStream.schema(ddl).parquet(path)


def drop_in(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).repartition(2).write.mode("append").parquet(path)


def message(kind, i, **more):
    record = {"created_at": (T0 + timedelta(hours=i)).isoformat() + "Z", "entity_id": i % 3, **more}
    return (json.dumps({"type": kind, "record": record}),)


def messages():
    rows = []
    for i in range(60):
        rows += [
            message("spc", i, feature="f", value=1.5 * i), message("psi", i, feature="f", bin_id=i % 5, bin_count=i), message("custom", i, metric="m", value=0.5),
            message("route", i, route_name="/r", latency=3.0, status_code=200),
        ]
    broken = ["{broken", "", None, "[]", '{"type":"other","record":{}}', '{"type":"spc"}', '{"type":"spc","record":{"created_at":null,"entity_id":1}}']
    broken += ['{"type":"psi","record":{"created_at":"2024-01-01T00:00:00Z","entity_id":"x","bin_id":1}}', '{"type":"custom","record":[1]}']
    return rows + [(b,) for b in broken], len(broken)


def everything(spark, path):
    kinds = [*tables.RECORDS, "bad"]
    return {k: sorted(map(str, ingest.read_ingested(spark, path, k).collect())) for k in kinds}


def test_ingest_routes_every_message_once(spark, folder):
    rows, n_bad = messages()
    drop_in(spark, f"{folder}/in", rows[:150], "value string")
    run = lambda: ingest.ingest_stream(stream(spark, f"{folder}/in", "value string"), f"{folder}/out", f"{folder}/check")
    first = run()
    first.awaitTermination()
    drop_in(spark, f"{folder}/in", rows[150:], "value string")
    second = run()
    second.awaitTermination()
    metrics = [p["observedMetrics"]["ingest"] for q in (first, second) for p in q.recentProgress if "ingest" in (p["observedMetrics"] or {})]
    assert sum(m["n_messages"] for m in metrics) == len(rows) and sum(m["n_bad"] for m in metrics) == n_bad
    batch = tables.parse_messages(spark.createDataFrame(rows, "value string"))
    expected = {k: sorted(map(str, df.collect())) for k, df in batch.items()}
    got = everything(spark, f"{folder}/out")
    assert got == expected and len(got["spc"]) == len(got["route"]) == 60 and len(got["bad"]) == n_bad
    counts = {(r["batch"], r["kind"]): r["n"] for r in ingest.ingest_counts(spark, f"{folder}/out").collect()}
    assert sum(n for (_, k), n in counts.items() if k == "bad") == n_bad and len({b for b, _ in counts}) == 2
    day = ingest.read_ingested(spark, f"{folder}/out", "spc", T0 + timedelta(hours=24), T0 + timedelta(hours=30))
    assert day.count() == 6


def test_a_repeated_or_unfinished_batch_adds_nothing(spark, folder, monkeypatch):
    rows, _ = messages()
    held = tables.classified(spark.createDataFrame(rows, "value string"))
    ingest.ingest_batch(held, 0, folder)
    once = everything(spark, folder)
    ingest.ingest_batch(held, 0, folder)
    assert everything(spark, folder) == once
    monkeypatch.setattr(ingest, "finish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(held, 1, folder)
    assert everything(spark, folder) == once


def test_waiting_records_equal_the_batch_join(spark, folder):
    at = lambda m: T0 + timedelta(minutes=m)
    records = [(f"r{i}", f"t{i % 40}", at(i), i % 4) for i in range(100)] + [("end", "none", at(10_000), 0)]
    spans = [(f"t{i % 40}", at(i + 3)) for i in range(0, 100, 3)] + [(f"t{i % 40}", at(i + 4)) for i in range(0, 100, 6)] + [("none", at(10_001))]
    kinds = "record_id string, trace_id string, created_at timestamp, retry_count int", "trace_id string, start_time timestamp"
    for name, rows, ddl in zip(("records", "spans"), (records, spans), kinds, strict=True):
        drop_in(spark, f"{folder}/{name}", rows, ddl)
    made = streams.waiting_records(stream(spark, f"{folder}/records", kinds[0]), stream(spark, f"{folder}/spans", kinds[1]), "10 minutes", "1 minute")
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    got = {r["record_id"]: (r["span_count"], r["status"], r["retry_count"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    # a record's own wait holds the spans of its trace that the batch join counts by trace
    expected = {}
    for r in records[:-1]:
        own = spark_count = sum(t == r[1] and r[2] <= s <= r[2] + timedelta(minutes=10) for t, s in spans)
        tried = r[3] + 1
        expected[r[0]] = (own, "ready" if spark_count else "failed" if tried >= 3 else "retry", r[3] if own else tried)
    assert got == expected and {s for _, s, _ in got.values()} == {"ready", "retry", "failed"}
    once = [r for r in records[:40]]
    batch = compare.attach_spans(spark.createDataFrame(once, kinds[0]), spark.createDataFrame([s for s in spans if s[1] < at(44)], kinds[1]))
    assert {r["record_id"]: (r["span_count"], r["status"], r["retry_count"]) for r in batch.collect()} == {r[0]: expected[r[0]] for r in once}


def spans_at(trace, starts, step=1):
    return [
        (trace, f"{trace}-{i}", None if i == 0 else f"{trace}-0", f"svc{i % 3}", f"op{i}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + step), 2 if i % 4 == 3 else 1,
         f"err{i}" if i % 4 == 3 else None)
        for i, s in enumerate(starts)
    ]


def summaries(df):
    names = ["trace_id", "service_name", "root_operation", "start_time", "end_time", "duration_ms", "status_code", "status_message", "span_count", "error_count"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_running_summaries_flush_and_forget(spark, folder):
    first = spans_at("a", range(0, 50)) + spans_at("b", range(5, 25)) + spans_at("c", [30, 31])
    again = [s for s in spans_at("a", [*range(0, 50), *range(200, 220)]) if s[5] >= T0 + timedelta(seconds=200)]
    last = spans_at("z", [1000])
    out, held = [], None
    tick = spans_at("y", [100])
    for rows in (first, tick, again, last):
        drop_in(spark, f"{folder}/in", rows, SPANS)
        made = streams.running_summaries(stream(spark, f"{folder}/in", SPANS), 10, "15 seconds")
        held = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
        held.awaitTermination()
        out.append(spark.read.parquet(f"{folder}/out").count())
    parts = spark.read.parquet(f"{folder}/out")
    assert parts.where("trace_id = 'a'").count() == 2 and parts.where("trace_id = 'z'").count() == 0
    whole = traces.trace_summaries(spark.createDataFrame(first + tick + again, SPANS))
    # the merge takes the message of the part with most spans, so that may be another error of the trace
    assert summaries(traces.merge_summaries(parts).withColumn("status_message", F.lit(""))) == summaries(whole.withColumn("status_message", F.lit("")))
    assert held.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # only z: its part and its timer's two rows
    assert out[-1] == 5 and out[1] == 3


def test_late_spans_are_in_the_merged_summary(spark, folder):
    rows = spans_at("a", range(0, 60)) + spans_at("b", range(0, 6))
    in_time, late = [r for r in rows if int(r[1].split("-")[1]) % 5], [r for r in rows if int(r[1].split("-")[1]) % 5 == 0]
    for part in (in_time, late):
        drop_in(spark, f"{folder}/in", part, SPANS)
        ingest.summary_stream(stream(spark, f"{folder}/in", SPANS), f"{folder}/out", f"{folder}/check", "15 seconds").awaitTermination()
    parts = ingest.read_parts(spark, f"{folder}/out")
    behind = [r for r in late if r[5] < T0 + timedelta(seconds=59 - 15)]
    assert parts.where("late").agg(F.sum("span_count")).first()[0] == len(behind)
    whole = traces.trace_summaries(spark.createDataFrame(rows, SPANS))
    cut = lambda df: df.select("trace_id", "start_time", "end_time", "duration_ms", "status_code", "span_count", "error_count")
    assert sorted(map(tuple, cut(ingest.read_summaries(spark, f"{folder}/out")).collect())) == sorted(map(tuple, cut(whole).collect()))
    before = sorted(map(tuple, parts.collect()))
    ingest.summary_batch(spark.createDataFrame(late, SPANS), 1, f"{folder}/out", "15 seconds")  # a retried batch
    assert sorted(map(tuple, ingest.read_parts(spark, f"{folder}/out").collect())) == before


LOG = "trace_id string, entity_id string, start_time timestamp, event string"


def test_the_outbox_compacts_and_forgets(spark, folder, monkeypatch):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [
        [("a", "e", at(0), "candidate"), ("b", "e", at(1), "candidate"), ("b", "e", at(1), "ack")],
        [("c", "e", at(2), "ack"), ("d", "e", at(3), "candidate")],
        [("c", "e", at(1), "candidate"), ("a", "e", at(50), "ack"), ("f", "e", at(51), "candidate")],
        [("g", "e", at(52), "candidate")],
    ]
    names = lambda: sorted(r["trace_id"] for r in outbox.read_pending(spark, folder).collect())
    seen = []
    for i, rows in enumerate(batches):
        outbox.log_batch(spark.createDataFrame(rows, LOG), i, folder)
        outbox.log_batch(spark.createDataFrame(rows, LOG), i, folder)  # retried
        seen.append(names())
        if i in (0, 1, 2):
            assert outbox.compact(spark, folder, timedelta(hours=24)) == i and names() == seen[-1]
    assert seen == [["a"], ["a", "d"], ["d", "f"], ["d", "f", "g"]]
    held = {r["trace_id"] for r in spark.read.parquet(f"{folder}/snapshots/upto=2").collect()}
    assert held == {"a", "d", "f"}  # b and c are acked and old
    left = {r["batch"] for r in spark.read.parquet(f"{folder}/pairs").select("batch").distinct().collect()}
    assert left == {2, 3}
    monkeypatch.setattr(outbox, "finish", lambda *a, **k: None)  # a compaction that isn't finished
    assert outbox.compact(spark, folder) == 3 and outbox._snapshots(spark, folder)[0] == 2 and names() == ["d", "f", "g"]


def test_samples_over_batches_without_a_frame_a_feature(spark, folder):
    values = [("f", T0 + timedelta(seconds=i), float(i % 13)) for i in range(103)] + [("g", T0, None), ("g", T0, 1.0)]
    for a in range(0, 105, 35):
        drop_in(spark, f"{folder}/in", values[a : a + 35], "feature string, created_at timestamp, value double")
        source = stream(spark, f"{folder}/in", "feature string, created_at timestamp, value double")
        samples.sample_stream(source, 10, f"{folder}/out", f"{folder}/check").awaitTermination()
    got = {(r["feature"], r["seq"]): r["value"] for r in samples.read_samples(spark, f"{folder}/out", 10).collect()}
    flat = [v for _, _, v in values[:103]]
    assert got == {("f", i): pytest.approx(sum(flat[10 * i : 10 * i + 10]) / 10) for i in range(10)}


def test_running_summaries_hand_each_span_to_the_state_as_one_value(spark, folder):
    """Spark converts a state's input value by value, which was most of the work."""
    drop_in(spark, f"{folder}/in", spans_at("a", [0]), SPANS)
    made = streams.running_summaries(stream(spark, f"{folder}/in", SPANS), 10, "15 seconds")
    plan = made._jdf.queryExecution().analyzed()
    while "TransformWithState" not in plan.nodeName():
        plan = plan.children().head()
    assert plan.children().head().output().size() <= 4  # the trace, its copy as the key, the time, and the span


def test_a_part_of_spans_is_what_merging_them_one_by_one_gives():
    own = [
        json.dumps(dict(zip("abcdefgh", span, strict=True))) for span in (
            (1, "s3", "x", "n1", 2, "late", 30, 35), (1, "s1", "y", None, 2, None, 10, 90), (0, "s2", None, None, 1, None, 20, 40),
            (1, "s0", "z", "n2", 2, "same start", 30, 31), (0, "s9", "w", "n3", 0, "no error", 20, 21),
        )
    ]
    for k in range(1, 6):
        assert streams._part_of(iter(own[:k])) == reduce(streams._merged, (streams._part_of(iter([o])) for o in own[:k]))
    assert streams._part_of(iter(own)) == (0, 20, "s2", None, "", 1, 10, 90, 30, 5, 3, 30, "s3", "late")
