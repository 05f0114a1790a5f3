"""Numbering, ranks and quantiles over range partitions, blocks of control samples, and trees of large traces."""

from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwatch.functions import ranked, shared
from skeinwatch.operators import metrics, profile, psi, spc, traces
from skeinwatch.sources import tables
from tests.test_drift import loop_rules, series


@pytest.fixture(scope="module")
def keyed(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 1), ("c", 40)) for v in rng.integers(0, 60, n)] + [("a", None), ("d", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def values(df):
    out = {}
    for k, v in df.collect():
        out.setdefault(k, []).append(v)
    return {k: np.sort([x for x in v if x is not None]) for k, v in out.items()}


def test_numbering_within_keys(spark, keyed):
    got = {}
    for r in ranked.numbered(keyed.where("v is not null"), ["v"], "n", ["k"]).collect():
        got.setdefault(r["k"], {})[r["n"]] = r["v"]
    expected = values(keyed)
    assert set(got) == {"a", "b", "c"}
    for k, by in got.items():
        assert sorted(by) == list(range(len(by))) and [by[i] for i in sorted(by)] == expected[k].tolist()
    assert ranked.numbered(keyed.where("false"), ["v"]).count() == 0


def test_equal_rows_are_dealt_to_many_partitions(spark, monkeypatch):
    held = []
    monkeypatch.setattr(ranked, "written", lambda df, name: held.append(shared.written(df, name)) or held[-1])
    made = ranked.numbered(spark.range(1_000_000).select(F.lit("x").alias("k")), ["k"], "n")
    assert made.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 999_999, 1_000_000)
    sizes = [r["count"] for r in held[0].groupBy("__part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 600_000


def test_descending_numbers(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int").repartition(4)
    got = {(r["k"], r["v"]): r["n"] for r in ranked.numbered(rows, [F.desc("v")], "n", ["k"]).collect()}
    for k in range(3):
        down = sorted((v for kk, v in got if kk == k), reverse=True)
        assert [got[k, v] for v in down] == list(range(len(down)))


def test_exact_quantiles_match_numpy(keyed):
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    expected = values(keyed)
    got = {(r["k"], r["q"]): r["v"] for r in ranked.exact_quantiles(keyed, ["k"], "v", at).collect()}
    assert set(got) == {(k, q) for k in ("a", "b", "c") for q in at}
    for (k, q), v in got.items():
        assert abs(v - np.quantile(expected[k], q)) < 1e-9
    nearest = ranked.nearest_ranks(keyed, ["k"], "v", at, F.floor(F.col("q") * (F.col("__n") - 1))).collect()
    assert all(r["v"] == expected[r["k"]][int(r["q"] * (len(expected[r["k"]]) - 1))] for r in nearest) and len(nearest) == 18
    wide = metrics.exact_percentiles(keyed, ["k"], "v").where("k = 'a'").first()
    assert abs(wide["p95"] - np.quantile(expected["a"], 0.95)) < 1e-9


def test_quantiles_of_large_keys_come_from_brackets(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SMALL", 100)
    rng = np.random.default_rng(9)
    groups = {"smooth": rng.normal(size=60_000), "ties": rng.integers(0, 3, 60_000).astype(float), "few": rng.normal(size=50)}
    groups["ends"] = np.concatenate([np.full(30_000, np.inf), np.full(100, np.nan), rng.normal(size=20_000)])
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, v double").repartition(6)
    at = (0.0, 0.0001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.9999, 1.0)
    got = {(r["k"], r["q"]): r["v"] for r in ranked.exact_quantiles(df.where("k <> 'ends'"), ["k"], "v", at).collect()}
    assert len(got) == 3 * len(at)
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(groups[k], q), rel=1e-12, abs=1e-12)
    near = ranked.nearest_ranks(df, ["k"], "v", at, F.floor(F.col("q") * (F.col("__n") - 1))).collect()
    for r in near:
        own = np.sort(groups[r["k"]])  # nan last
        np.testing.assert_equal(r["v"], own[int(r["q"] * (len(own) - 1))])
    assert len(near) == 4 * len(at)


def test_quantiles_between_equal_values_are_these(spark):
    df = spark.createDataFrame([(i / 100,) for i in (1, 3, 4, 6, 7) for _ in range(14)], "x double").repartition(3)
    edges = psi.quantile_edges(df, ["x"], 10).first()["edges"]
    assert edges[0] == 0.01 and edges[-1] == 0.07  # 0.1 * 69 falls between two equal values
    counts = {r["id"]: r["count"] for r in psi.psi_bin_counts(df, psi.psi_profile(df, ["x"]), ["x"]).collect()}
    assert counts[1] == 14 and counts[max(counts)] == 0 and sum(counts.values()) == 70


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_gathers_the_rows_of_a_key(spark, keyed, monkeypatch):
    found = ranked.nearest_ranks(keyed, ["k"], "v", (0.5,), F.floor(F.col("q") * (F.col("__n") - 1)))
    assert "BroadcastHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    few = sorted(ranked.exact_quantiles(keyed, ["k"], "v", (0.1, 0.5)).collect())
    monkeypatch.setattr(ranked, "FEW_KEYS", 2)
    assert sorted(ranked.exact_quantiles(keyed, ["k"], "v", (0.1, 0.5)).collect()) == few


def test_no_task_gathers_the_values_of_a_column(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")).repartition(5)
    bars = profile.histogram(df, ["x", "y"], 10)
    assert "BroadcastHashJoin" in plan_of(bars)
    assert {(r["feature"], r["bin"]): r["count"] for r in bars.collect() if r["count"]} == {("y", 0): 1000} | {("x", i): 100 for i in range(10)}


def test_approximate_percentiles_are_near(spark):
    df = spark.range(100_000).select(F.lit("m").alias("metric"), ((F.col("id") * 7919) % 100_000).cast("double").alias("value"))
    row = df.groupBy("metric").agg(*metrics.percentiles("value"), F.approx_count_distinct("value").alias("n")).first()
    assert all(abs(row[f"p{q}"] - q * 1000) <= 20 for q in (50, 95, 99)) and abs(row["n"] - 100_000) < 10_000


@pytest.mark.parametrize("seed", range(2))
def test_rules_over_blocks_match_loops(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    zones = rng.choice([-3, -2, -1, 0, 1, 2, 3, 4], 200, p=[0.02, 0.1, 0.25, 0.1, 0.35, 0.1, 0.05, 0.03]).tolist()
    df, rule = series(spark, zones), "3 4 2 3 1 2 1 1"
    whole = {
        n: {r["seq"] for r in hits.collect()} for n,
        hits in (("c", spc.consecutive_hits(df, 3, 1)), ("a", spc.alternating_hits(df, 3, 1)), ("t", spc.trend_hits(df, 4)))
    }
    monkeypatch.setattr(spc, "BLOCK", 9)
    assert {(r["zone"], r["kind"]) for r in spc.spc_rules(df, rule, trend=False).collect()} == loop_rules(zones, rule)
    for n, hits in (("c", spc.consecutive_hits(df, 3, 1)), ("a", spc.alternating_hits(df, 3, 1)), ("t", spc.trend_hits(df, 4))):
        rows = [r["seq"] for r in hits.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == whole[n] and rows


def test_profiles_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(psi, "MAX_BINS", 5)
    df = spark.range(10).select(F.col("id").cast("int").alias("x"))
    with pytest.raises(ValueError, match="at most 5 bins"):
        psi.fixed_profile(psi.psi_profile(df, ["x"], categorical=["x"]))


def spans(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(t, s, p, start + timedelta(seconds=at)) for t, s, p, at in rows],
        "trace_id long, span_id long, parent_span_id long, start_time timestamp",
    )


def test_large_traces_are_placed_by_joins(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, i - 1 if i else None, 300 - i) for i in range(300)]  # a chain, later spans first
    rows += [(2, i, int(rng.integers(0, i)) if i else None, int(rng.integers(0, 9))) for i in range(60)]
    rows += [(3, 0, 7, 5), (3, 1, 0, 3), (4, 0, 1, 0), (4, 1, 0, 1), (4, 2, None, 9), (5, 0, None, 0), (5, 1, None, 0), (5, 2, 99, 1)]
    df = spans(spark, rows)
    key = lambda r: (r["trace_id"], r["span_id"])
    want = {key(r): r.asDict() for r in traces.span_tree(df).collect()}
    assert want[1, 299]["depth"] == 299 and len(want) == len(rows)
    assert {key(r): r.asDict() for r in traces.joined_tree(df).collect()} == want
    mixed = traces.span_tree(df, max_spans=50)
    assert {key(r): r.asDict() for r in mixed.collect()} == want
    depths = {key(r): r["depth"] for r in traces.span_depths(df).collect()}
    assert depths == {k: v["depth"] for k, v in want.items()}


def test_pages_of_a_deep_trace(spark):
    n = 50_000
    rows = [(1, i, i - 1 if i else None, i) for i in range(n)] + [(2, 0, None, 0), (2, 1, 0, 1), (3, 5, 4, 0)]
    df = spans(spark, rows)
    page = traces.span_page(df, n - 100, 100)
    got = page.orderBy("span_order").collect()
    assert "path" not in page.columns and [(r["trace_id"], r["span_id"], r["depth"], r["span_order"], r["root_span_id"]) for r in got] == [(1, i, i, i, 0) for i in range(n - 100, n)]
    begin = traces.span_page(df, 0, 2, paths=True).orderBy("trace_id", "span_order").collect()
    assert [(r["trace_id"], r["span_id"], r["path"]) for r in begin] == [(1, 0, [0]), (1, 1, [0, 1]), (2, 0, [0]), (2, 1, [0, 1]), (3, 5, [5])]
    # A task holds a bounded number of path elements, however many the trace has.
    m = 6000
    chain = pa.record_batch({"trace_id": [1], "ids": [list(range(m))], "parents": [[None, *range(m - 1)]]})
    fields = [pa.field(x, pa.int64()) for x in ("trace_id", "span_id", "depth", "span_order", "root_span_id")] + [pa.field("path", pa.list_(pa.int64()))]
    sizes = [(len(b["path"].flatten()), b.num_rows) for b in traces._tree_rows([chain], fields, None, True)]
    assert sum(x for _, x in sizes) == m and sum(x for x, _ in sizes) == m * (m + 1) // 2 and max(x for x, _ in sizes) <= traces.HELD_PATHS + m


def test_partitions_go_and_tables_are_not_overwritten(spark, tmp_path):
    days = spark.range(30).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("start_time"),
        F.col("id").alias("trace_id"),
        F.lit("s").alias("service_name"),
    )
    path = str(tmp_path / "t")
    tables.write_trace_table(days, path)
    assert tables.drop_partitions(spark, path, date(2024, 1, 4)) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    held = spark.read.parquet(path)
    assert held.count() == 27
    with pytest.raises(Exception, match="(?i)exists"):
        tables.compact(held, path)
    tables.compact(held, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 27


def test_compaction_makes_more_ranges_of_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SORTED_ROWS", 1000, raising=False)
    held = spark.range(10_000).select(F.timestamp_seconds("id").alias("start_time"), F.lit("s").alias("service_name"), "id").repartition(3)
    tables.compact(held, str(tmp_path / "c"), files=4)
    made = spark.read.parquet(str(tmp_path / "c"))
    sizes = [r["count"] for r in made.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert made.agg(F.count("*"), F.count_distinct("id")).first()[:] == (10_000, 10_000)
    assert len(sizes) >= 8 and max(sizes) < 2500


def test_the_shared_folder_is_the_sessions(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Session:
        def __init__(self, **values):
            self.conf, self.values = self, values

        def get(self, key, default=None):
            return self.values.get(key.replace(".", "_"), default)

    assert shared.shared_dir(Session(spark_master="local[4]")).startswith("file:")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(spark_master="spark://host:7077"))
