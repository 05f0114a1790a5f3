"""Stored roll-ups: sketches at two levels within their bounds, trace metrics from summaries."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from skeinwatch.operators import genai, rollup, traces

T0 = datetime(2024, 1, 1)


def test_sketches_at_three_levels(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(3, 1, 30_000), np.full(10_000, 7.0)])  # a quarter is one value
    rng.shuffle(values)
    rows = [(f"m{i % 2}", T0 + timedelta(minutes=i % 4000), float(v), f"u{i % 9000}") for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("none", T0, None, None)], "model string, start_time timestamp, duration_ms double, user string")
    hours = rollup.sketched(df, ["model"], ("duration_ms",), ("user",))
    days = rollup.merged(hours, ["model"], "day")
    total = rollup.merged(days, [])
    levels = (
        (rollup.answers(hours), lambda r: (r[0], r[1].replace(minute=0)), lambda m, b: (m, b)), (rollup.answers(days), lambda r: (r[0], r[1].replace(hour=0, minute=0)), lambda m, b: (m, b)),
        (rollup.answers(total), lambda r: None, lambda m, b: None),
    )
    for found, of, name in levels:
        groups = {}
        for r in [*rows, ("none", T0, None, None)]:
            groups.setdefault(of(r), []).append(r)
        got = {name(r["model"] if "model" in r else None, r["bucket"] if "bucket" in r else None): r for r in (x.asDict() for x in found.collect())}
        assert set(got) == set(groups)
        for k, g in groups.items():
            own = np.array([r[2] for r in g if r[2] is not None])
            assert got[k]["n"] == len(g)
            for q in (50, 95, 99):
                at = got[k][f"duration_ms_p{q}"]
                if not len(own):
                    assert at is None
                    continue
                assert (own < at).mean() <= q / 100 + rollup.RANK_ERROR and (own <= at).mean() >= q / 100 - rollup.RANK_ERROR
            users = len({r[3] for r in g if r[3] is not None})
            assert abs(got[k]["user_distinct"] - users) <= max(1, users * rollup.DISTINCT_ERROR)
            if len(own):
                assert abs(got[k]["duration_ms_mean"] - own.mean()) < 1e-6 * own.mean()


def test_default_dashboards_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(i // 6, i % 6, T0 + timedelta(seconds=i), int(v)) for i, v in enumerate(rng.lognormal(5, 1, 6000))]
    spans = spark.createDataFrame(rows, "trace_id long, n long, start_time timestamp, took long").select(
        "trace_id", (F.col("trace_id") * 10 + F.col("n")).alias("span_id"), F.when(F.col("n") > 0, F.col("trace_id") * 10).alias("parent_span_id"), F.lit("s").alias("service_name"),
        F.lit("op").alias("span_name"), "start_time", F.timestamp_micros(F.unix_micros("start_time") + F.col("took") * 1000).alias("end_time"), F.lit(1).alias("status_code"),
        F.lit(None).cast("string").alias("status_message"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"),
    )
    exact, near = (traces.trace_metrics(spans, exact=e).orderBy("bucket").collect() for e in (True, False))
    for a, b in zip(exact, near, strict=True):
        assert a["trace_count"] == b["trace_count"] and all(abs(a[p] - b[p]) <= 0.02 * a[p] for p in ("p50", "p95", "p99"))
    agents = spark.range(5000).select((F.col("id") % 700).cast("string").alias("agent_name"), F.col("id").cast("string").alias("conversation_id"))
    a, b = (genai.agent_unique_counts(agents, exact=e).first() for e in (True, False))
    assert a[:] == (700, 5000) and abs(b[0] - 700) <= 0.15 * 700 and abs(b[1] - 5000) <= 0.15 * 5000


def test_metrics_from_summaries_of_split_traces(spark):
    kinds = "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, start_time timestamp, end_time timestamp, status_code int, status_message string, attributes map<string,string>"
    rows = []
    for t in range(30):
        for i in range(5):
            at = T0 + timedelta(minutes=7 * t, seconds=i)
            tags = {"a": str(t % 2), "b": str(i)} if i else {}
            rows.append((f"t{t}", f"{t}-{i}", f"{t}-0" if i else None, f"svc{(t + i) % 3}", "op", at, at + timedelta(seconds=t), 2 if t % 4 == 0 and i == 3 else 1, None, tags))
    spans = spark.createDataFrame(rows, kinds)
    watched = {"both": [("a", "1"), ("b", "2")], "never": [("a", "1"), ("b", "9")]}
    parts = [rollup.summary_parts(spans.where(F.col("span_id").endswith(e)), watched) for e in ("0", "1", "2", "3", "4")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    for service, hit in ((None, None), ("svc1", None), ("svc1", "both"), (None, "never")):
        expected = traces.trace_metrics(spans, "hour", service, watched[hit] if hit else [], exact=True)
        got = rollup.summary_metrics(whole, "hour", service, hit, exact=True)
        assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
