"""Binning, PSI, SPC and profiles on literals."""

import math
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwatch.functions.statistics import chi_square_quantile, normal_quantile
from skeinwatch.operators import metrics, profile, psi, registry, spc


@pytest.fixture(scope="module")
def shifted(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(x) + k for k, x in enumerate(rng.random(3), 1)) for _ in range(1000)]
    return spark.createDataFrame(rows, "feature_0 double, feature_1 double, feature_2 double")


def test_chi_square_quantiles():
    for degrees, expected in ((1, 3.841459), (4, 9.487729), (9, 16.918978), (30, 43.772972)):
        assert math.isclose(chi_square_quantile(0.95, degrees), expected, abs_tol=1e-5)
    assert math.isclose(normal_quantile(0.95), 1.644854, abs_tol=1e-6)


def test_first_edges_of_shifted_uniforms(shifted):
    rows = psi.psi_profile(shifted, shifted.columns).where("id = 1").orderBy("feature").collect()
    for r, expected in zip(rows, (1.1, 2.1, 3.1), strict=True):
        assert abs(r["upper"] - expected) < 0.05 and r["lower"] == -math.inf
    assert all(abs(r["proportion"] - 0.1) < 0.002 for r in rows)


def test_no_drift_against_itself_and_drift_when_moved(shifted):
    prof = psi.psi_profile(shifted, shifted.columns)
    same = psi.psi_alerts(psi.psi_drift(shifted, prof, shifted.columns)).collect()
    assert all(r["psi"] < 1e-12 and not r["alert"] for r in same)
    moved = shifted.select(*((F.col(c) + 0.5).alias(c) for c in shifted.columns))
    for method in ("chi_square", "normal", "fixed"):
        assert all(r["alert"] for r in psi.psi_alerts(psi.psi_drift(moved, prof, shifted.columns), method).collect())
    with pytest.raises(ValueError):
        psi.psi_drift(shifted.withColumn("other", F.lit(1.0)), prof, ["other"])


def test_non_finite_values_and_strict_denominator(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    prof = psi.psi_profile(base, ["x"])
    odd = base.unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double"))
    assert psi.psi_drift(odd, prof, ["x"]).first()["n"] == 100
    assert psi.psi_drift(odd, prof, ["x"]).first()["psi"] < 1e-12 < psi.psi_drift(odd, prof, ["x"], strict_denominator=True).first()["psi"]


def test_bin_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    row = psi.bin_statistics(df, ["x"]).select(*(psi.bin_count(r, 6).alias(r) for r in psi.RULES)).first()
    assert row.asDict() == {
        "manual": 6,
        "square_root": 10,
        "sturges": 8,
        "rice": 10,
        "doane": 8,
        "scott": 5,
        "terrell_scott": 6,
        "freedman_diaconis": 5,
    }
    with pytest.raises(Exception, match="at least 2 bins"):
        psi.width_edges(df, ["x"], "manual", 1).collect()


def test_empty_bins_have_rows(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    prof = psi.psi_profile(base, ["x"])
    counts = psi.psi_bin_counts(base.where("x < 10"), prof, ["x"])
    assert counts.count() == 10 and counts.where("count = 0").count() == 9


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(21)], "x double")
    rows = profile.histogram(df, ["x"], 20).orderBy("bin").collect()
    assert sum(r["count"] for r in rows) == 21 and rows[-1]["count"] == 2
    flat = profile.histogram(spark.createDataFrame([(1.0,)] * 5, "x double"), ["x"], 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [5, 0, 0, 0]


def test_correlations_within_tolerance(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(20_000)
    y = 0.75 * x + math.sqrt(1 - 0.75**2) * rng.standard_normal(20_000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in profile.correlations(df, ["x", "y"]).collect()}
    assert abs(got["x", "y"] - 0.75) < 0.1 and got["x", "x"] == 1.0


def test_string_profile_and_codes(spark):
    df = spark.createDataFrame([("hello", "blah"), ("world", "foo"), ("world", "world")], "feature1 string, feature2 string")
    row = profile.profile_string(df, ["feature1"]).first()
    assert (row["distinct"], row["min_length"], row["max_length"], row["median_length"]) == (2, 5, 5, 5)
    codes = profile.category_codes(df, ["feature1"])
    assert sorted(
        r["feature1"] for r in profile.ordinal_encode(
            spark.createDataFrame([("new",), ("world",)], "feature1 string"),
            ["feature1"],
            codes,
        ).collect()
    ) == [1, 2]


def series(spark, zones):
    return spark.createDataFrame([("f", i, float(z)) for i, z in enumerate(zones)], "feature string, seq long, zone double")


def loop_rules(zones, rule):
    """Plain loops over trailing windows."""
    parts, found = spc.parse_rule(rule), set()
    for i, value in enumerate(zones):
        for zone in (1, 2, 3, 4):
            n, m = parts[2 * zone - 2], parts[2 * zone - 1]
            if abs(value) != zone:
                continue
            if n and i + 1 >= n:
                window = zones[i + 1 - n : i + 1]
                if all(x >= zone for x in window) or all(x <= -zone for x in window):
                    found.add((zone, "out_of_bounds" if zone == 4 else "consecutive"))
            if m and i + 1 >= m:
                window = zones[i + 1 - m : i + 1]
                if all(abs(x) >= zone for x in window) and all(a != b for a, b in zip(window, window[1:], strict=False)):
                    found.add((zone, "out_of_bounds" if zone == 4 else "alternating"))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_rules_match_loops(spark, seed):
    rng = np.random.default_rng(seed)
    zones = rng.choice([-3, -2, -1, 0, 1, 2, 3, 4], 60, p=[0.05, 0.1, 0.25, 0.1, 0.3, 0.1, 0.05, 0.05]).tolist()
    rule = "3 4 2 3 1 2 1 1"
    got = {(r["zone"], r["kind"]) for r in spc.spc_rules(series(spark, zones), rule, trend=False).collect()}
    assert got == loop_rules(zones, rule)


def test_trend_and_bad_rule(spark):
    assert spc.spc_rules(series(spark, [0, 1, 2, 3, 4, 5, 6])).where("kind = 'trend'").count() == 1
    assert spc.spc_rules(series(spark, [0, 1, 2, 3, 3, 5, 6])).where("kind = 'trend'").count() == 0
    with pytest.raises(ValueError):
        spc.parse_rule("1 2 3")


def test_zone_borders(spark):
    limits = {"center": 0.0, "one_ucl": 1.0, "one_lcl": -1.0, "two_ucl": 2.0, "two_lcl": -2.0, "three_ucl": 3.0, "three_lcl": -3.0}
    df = spark.createDataFrame([(float(v),) for v in (0, 3, -3, 3.1, -3.1, 1, -1, 0.5, -0.5, 2, -2)], "value double")
    got = [r[0] for r in df.select(*(F.lit(v).alias(k) for k, v in limits.items()), "value").select(spc.spc_zone(F.col("value"))).collect()]
    assert got == [0, 0, 0, 4, -4, 2, -2, 1, -1, 3, -3]


def test_ordered_numbering_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert all(r["x"] == r["seq"] for r in spc.numbered(df, ["x"]).collect())


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0), ("d", 5.0)], "metric string, value double")
    rules = spark.createDataFrame(
        [("a", 4.0, "above", None), ("b", 4.0, "above", 1.5), ("c", 7.0, "below", 1.0), ("d", 5.2, "outside", 0.1)],
        "metric string, baseline double, kind string, delta double",
    )
    assert {r["metric"]: r["alert"] for r in metrics.threshold_alerts(df, rules).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_route_percentiles_and_codes(spark):
    rows = [(datetime(2024, 1, 1), "r", float(i), 200) for i in range(1, 101)] + [(datetime(2024, 1, 1), "r", 7.0, 500)] * 2
    row = metrics.route_metrics(
        spark.createDataFrame(rows, "created_at timestamp, route_name string, latency double, status_code int"),
        5,
    ).first()
    assert (
        row["p5"],
        row["p50"],
        row["p99"],
        row["request_count"],
        row["error_count"],
        row["error_latency"],
    ) == (5.0, 50.0, 99.0, 100, 2, 14.0)
    assert row["status_codes"] == {200: 100, 500: 2}


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("*", (0, 0, 0), None),
        ("^1.2.3", (1, 2, 3), (2, 0, 0)),
        ("^0.2.3", (0, 2, 3), (0, 3, 0)),
        ("~1.2.3", (1, 2, 3), (1, 3, 0)),
        ("1.*", (1, 0, 0), (2, 0, 0)),
        ("1.2.*", (1, 2, 0), (1, 3, 0)),
        ("1.2.3", (1, 2, 3), (1, 2, 4)),
    ],
)
def test_version_ranges(text, low, high):
    assert registry.range_bounds(text) == (low, high)


def test_sweep_counts_from_each_previous_run(spark):
    day = datetime(2024, 1, 1)
    profiles = spark.createDataFrame(
        [(1, "custom", True, day, day), (2, "custom", True, datetime(2024, 2, 1), day), (3, "custom", False, day, day)],
        "entity_id long, drift_type string, active boolean, previous_run timestamp, next_run timestamp",
    )
    facts = spark.createDataFrame(
        [(e, datetime(2024, 1, 15), "m", 9.0) for e in (1, 2, 3)],
        "entity_id long, created_at timestamp, metric string, value double",
    )
    rules = spark.createDataFrame(
        [(e, "m", 5.0, "above", None) for e in (1, 2, 3)],
        "entity_id long, metric string, baseline double, kind string, delta double",
    )
    none = spark.createDataFrame([], "entity_id long, created_at timestamp, feature string, bin_id int, bin_count long")
    bins = spark.createDataFrame([], "entity_id long, feature string, id int, proportion double")
    assert [r["entity_id"] for r in registry.run_due_checks(profiles, none, bins, facts, rules, datetime(2024, 3, 1)).collect()] == [1]


def test_bins_of_many_edges(spark):
    rng = np.random.default_rng(4)
    for n in (1, 16, 17, 50_000):
        edges = sorted(rng.normal(size=n).tolist())
        values = [*rng.normal(size=3000).tolist(), edges[0], edges[-1], float("nan"), float("inf"), None]
        df = spark.createDataFrame([(x,) for x in values], "x double")
        got = [tuple(r) for r in df.select("x", psi.bin_of(F.col("x"), edges).alias("b")).collect()]
        for x, b in got:
            assert b == (None if x is None or not np.isfinite(x) else np.searchsorted(edges, x, side="left") + 1)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 20))
    wide = base @ rng.normal(size=(20, 500)) + rng.normal(size=(400, 500)) + 1e6
    columns = [f"f{i}" for i in range(500)]
    df = spark.createDataFrame(pa.table(dict(zip(columns, wide.T, strict=True)))).repartition(3)
    got = profile.correlations(df, columns).toPandas()
    found = got.pivot(index="feature_a", columns="feature_b", values="corr").loc[columns, columns].to_numpy()
    assert len(got) == 250_000
    np.testing.assert_allclose(found, np.corrcoef(wide.T), atol=1e-9)


def test_wide_correlations_skip_nulls_as_the_narrow_ones_do(spark, monkeypatch):
    rows = [(float(i), float(i * i % 17), None if i % 3 else float(-i), 5.0, float("nan") if i == 7 else 1.0 * i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    narrow = {tuple(r[:2]): r[2] for r in profile.correlations(df, df.columns).collect()}
    monkeypatch.setattr(profile, "WIDE", 2)
    monkeypatch.setattr(profile, "BLOCK", 4)
    wide = {tuple(r[:2]): r[2] for r in profile.correlations(df, df.columns).collect()}
    assert set(wide) == set(narrow) and len(wide) == 36
    for k, r in narrow.items():
        same = wide[k]
        assert (r is None or math.isnan(r)) == (same is None or math.isnan(same)), (k, r, same)
        assert r is None or math.isnan(r) or same == pytest.approx(r, abs=1e-12)
