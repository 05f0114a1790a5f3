"""Profiling, PSI, SPC, metric and registry queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skeinwatch.functions import scalars
from skeinwatch.functions.shared import new_folder
from skeinwatch.functions.statistics import chi_square_quantile, normal_quantile
from skeinwatch.functions.timeutil import time_bin
from skeinwatch.operators import metrics, profile, psi, registry, rollup, spc
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.plans.views import FEATURES, FLAGS, with_views

BOOK = Book()
query = BOOK.query
_SINCE = datetime(2024, 1, 5)

# Profiling.


@query("P1_P3_profile_numeric", f"""{with_views("long_all")}
SELECT feature, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS stddev, round(min(value), 8) AS min,
  round(max(value), 8) AS max,
       count(DISTINCT value) AS "distinct", round(count(DISTINCT value) / count(*), 8) AS distinct_fraction FROM long_all GROUP BY feature""")
def profile_numeric(spark, sf):
    return rounded(profile.profile_numeric(views.table(spark, sf, "lineitem"), FEATURES), 8)


@query(
    "P1_profile_wide",
    "SELECT " + ", ".join(
        f"round(avg({c}), 8) AS {c}_mean, round(stddev_samp({c}), 8) AS {c}_stddev, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in FEATURES
    ) + " FROM lineitem",
)
def profile_wide(spark, sf):
    return rounded(profile.profile_wide(views.table(spark, sf, "lineitem"), FEATURES), 8)


@query("P2_rank_quantiles", f"""{with_views("long_all")},
numbered AS (SELECT feature, value, row_number() OVER (PARTITION BY feature
  ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM long_all)
SELECT feature, q::DOUBLE AS q, round(value, 6) AS value FROM numbered, (VALUES (0.25::DOUBLE), (0.5), (0.75), (0.99)) t(q)
  WHERE r = floor(q * (n - 1) + 0.5)""")
def rank_quantiles(spark, sf):
    return rounded(profile.rank_quantiles(views.table(spark, sf, "lineitem"), FEATURES))


@query("P4_histogram", f"""{with_views("long_all")},
ends AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM long_all GROUP BY feature),
counts AS (SELECT feature, least(floor((value - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM long_all JOIN ends USING (feature)
  GROUP BY ALL)
SELECT feature, b::INTEGER AS bin, round(lo + b * w, 6) AS left_edge, coalesce(n, 0)::BIGINT AS count FROM ends CROSS JOIN range(20) r(b)
  LEFT JOIN counts USING (feature) WHERE counts.bin = b OR counts.bin IS NULL
UNION SELECT feature, b::INTEGER, round(lo + b * w, 6), 0 FROM ends CROSS JOIN range(20) r(b) WHERE NOT EXISTS (SELECT 1 FROM counts c
  WHERE c.feature = ends.feature AND c.bin = b)""")
def histogram(spark, sf):
    return rounded(profile.histogram(views.table(spark, sf, "lineitem"), FEATURES))


@query("P5_profile_string", """WITH long AS (UNPIVOT (SELECT lang, source FROM documents) ON lang, source INTO NAME feature VALUE value)
SELECT feature, count(*) AS n, count(DISTINCT value) AS "distinct", round(count(DISTINCT value) * 100.0 / count(*), 6) AS distinct_percent,
  min(length(value))::INTEGER AS min_length, max(length(value))::INTEGER AS max_length,
       round(avg(length(value)), 6) AS mean_length, (list_sort(list(length(value)))[(count(*) // 2) + 1])::INTEGER AS median_length
         FROM long GROUP BY feature""")
def profile_string(spark, sf):
    return rounded(profile.profile_string(views.table(spark, sf, "documents"), ["lang", "source"]))


@query("P5_value_frequencies", """WITH long AS (UNPIVOT (SELECT l_returnflag, l_linestatus
  FROM lineitem) ON l_returnflag, l_linestatus INTO NAME feature VALUE value)
SELECT feature, value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY feature), 6) AS percent FROM long
  GROUP BY feature, value""")
def value_frequencies(spark, sf):
    return rounded(profile.value_frequencies(views.table(spark, sf, "lineitem"), FLAGS))


@query(
    "P6_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in FEATURES for b in FEATURES
    ),
)
def correlations(spark, sf):
    return rounded(profile.correlations(views.table(spark, sf, "lineitem"), FEATURES))


@query("P7_ordinal_correlations", """WITH a AS (SELECT l_quantity, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag,
  dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM lineitem)
""" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM a" for a in ["l_quantity", *FLAGS] for b in ["l_quantity", *FLAGS]))
def ordinal_correlations(spark, sf):
    coded = profile.ordinal_encode(views.table(spark, sf, "lineitem").select("l_quantity", *FLAGS), FLAGS)
    return rounded(profile.correlations(coded, ["l_quantity", *FLAGS]))


_CORR_QUANTITY = " UNION ALL ".join(
    f"SELECT '{x}' AS feature, {'max(NULL::DOUBLE)' if x == 'l_quantity' else f'round(corr({x}, l_quantity), 6)'} AS corr_quantity FROM coded"
    for x in [*FEATURES, *FLAGS]
)


@query("P8_profile_report", f"""{with_views("long_all")}, words AS (UNPIVOT (SELECT l_returnflag, l_linestatus
  FROM lineitem) ON l_returnflag, l_linestatus INTO NAME feature VALUE value)
, coded AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, dense_rank() OVER (ORDER BY l_returnflag) AS l_returnflag,
  dense_rank() OVER (ORDER BY l_linestatus) AS l_linestatus FROM lineitem),
c AS ({_CORR_QUANTITY}),
r AS (SELECT feature, 'numeric' AS kind, count(*) AS n, 20 AS bars, count(DISTINCT value) AS "distinct" FROM long_all GROUP BY feature
UNION ALL SELECT feature, 'string', count(*), 0, count(DISTINCT value) FROM words GROUP BY feature) SELECT * FROM r JOIN c USING (feature)""")
def profile_report(spark, sf):
    report = profile.profile(views.table(spark, sf, "lineitem"), FEATURES, FLAGS)
    n, distinct = (F.coalesce(F.col("numeric")[c], F.col("string")[c]).alias(c) for c in ("n", "distinct"))
    bars = F.coalesce(F.size("histogram"), F.lit(0)).alias("bars")
    return rounded(
        report.select("feature", "kind", n, bars, distinct, F.try_element_at("correlations", F.lit("l_quantity")).alias("corr_quantity"))
    )


# PSI.

_EDGES = f"""{with_views("base", "serve", "long_base", "long_serve")},
edges AS (SELECT feature, list_distinct(quantile_cont(value, [{", ".join(f"{i / 10}::DOUBLE" for i in range(1, 10))}])) AS e FROM long_base
  GROUP BY feature),
bins AS (SELECT feature, unnest(range(1, len(e) + 2))::INTEGER AS id FROM edges),
expected AS (SELECT feature, 1 + len(list_filter(e, lambda x: value > x))::INTEGER AS id, count(*) AS m FROM long_base
  JOIN edges USING (feature) GROUP BY ALL),
prop AS (SELECT b.feature, b.id, coalesce(m, 0) / sum(coalesce(m, 0)) OVER (PARTITION BY b.feature) AS p FROM bins b LEFT
  JOIN expected x ON b.feature = x.feature AND b.id = x.id),
observed AS (SELECT feature, 1 + len(list_filter(e, lambda x: value > x))::INTEGER AS id, count(*) AS m FROM long_serve
  JOIN edges USING (feature) GROUP BY ALL),
shares AS (SELECT p.feature, p.id, p.p, coalesce(o.m, 0) AS m, coalesce(o.m, 0) / sum(coalesce(o.m, 0)) OVER (PARTITION BY p.feature) AS q
  FROM prop p LEFT JOIN observed o ON p.feature = o.feature AND p.id = o.id),
drift AS (SELECT feature, sum((p + 1e-10 - q - 1e-10) * ln((p + 1e-10) / (q + 1e-10))) AS psi, sum(m)::BIGINT AS n, count(*) AS bins
  FROM shares GROUP BY feature)"""


@query("D1_quantile_edges", f"""{with_views("base", "long_base")},
  tenths AS (SELECT feature, quantile_cont(value, [{", ".join(f"{i / 10}::DOUBLE" for i in range(1, 10))}]) AS e FROM long_base GROUP BY feature)
  SELECT feature, i::INTEGER AS i, round(e[i], 6) AS edge FROM tenths, range(1, 10) t(i)""")
def quantile_edges(spark, sf):
    return rounded(
        psi.quantile_edges(views.base(spark, sf), FEATURES).select(
            "feature",
            F.posexplode("edges").alias("i", "edge"),
        ).withColumn("i", F.col("i") + 1)
    )


_STATS = f"""{with_views("base", "long_base")}, numbered AS (SELECT feature, value, row_number() OVER (PARTITION BY feature
  ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS m FROM long_base),
mo AS (SELECT feature, avg(value) AS mu FROM long_base GROUP BY feature),
stats AS (SELECT n.feature, count(*)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu,
  2)), 1.5) AS g1, stddev_pop(value) AS sd,
  max(value) FILTER (r = floor(0.25 * (m - 1))) AS q1, max(value) FILTER (r = floor(0.75 * (m - 1))) AS q3 FROM numbered n
    JOIN mo USING (feature) GROUP BY n.feature)"""
_RULES = {
    "square_root": "ceil(sqrt(n))",
    "sturges": "ceil(log2(n)) + 1",
    "rice": "ceil(2 * pow(n, 1 / 3::DOUBLE))",
    "doane": "round(1 + log2(n) + log2(1 + abs(g1) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))))",
    "scott": "ceil((hi - lo) / (3.49 * sd / pow(n, 1 / 3::DOUBLE)))",
    "terrell_scott": "round(pow(2 * n, 1 / 3::DOUBLE))",
    "freedman_diaconis": "ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1 / 3::DOUBLE)))",
    "manual": "7",
}


@query(
    "D3_D10_bin_rules",
    f"{_STATS} SELECT feature, " + ", ".join(f"({sql})::INTEGER AS {name}" for name, sql in _RULES.items()) + " FROM stats",
)
def bin_rules(spark, sf):
    return psi.bin_statistics(views.base(spark, sf), FEATURES).select("feature", *(psi.bin_count(r, 7).alias(r) for r in _RULES))


@query("D2_width_edges", f"""{_STATS}, k AS (SELECT *, ({_RULES['doane']})::INTEGER AS k FROM stats)
  SELECT feature, i::INTEGER AS i, round(lo + i * ((hi - lo) / k), 6) AS edge FROM k, unnest(range(1, k)) t(i)""")
def width_edges(spark, sf):
    return rounded(
        psi.width_edges(views.base(spark, sf), FEATURES).select(
            "feature",
            F.posexplode("edges").alias("i", "edge"),
        ).withColumn("i", F.col("i") + 1)
    )


@query("D11_psi_profile", f"{_EDGES} SELECT feature, id, round(p, 6) AS proportion FROM prop")
def psi_profile(spark, sf):
    return rounded(psi.psi_profile(views.base(spark, sf), FEATURES).select("feature", "id", "proportion"))


@query("D12_categorical_profile", f"""{with_views("base")}, coded AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS id FROM base)
SELECT 'l_returnflag' AS feature, id::INTEGER AS id, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM coded GROUP BY id""")
def categorical_profile(spark, sf):
    coded = profile.ordinal_encode(views.base(spark, sf).select("l_returnflag"), ["l_returnflag"])
    return rounded(psi.psi_profile(coded, ["l_returnflag"], categorical=["l_returnflag"]).select("feature", "id", "proportion"))


@query("D13_D14_psi_drift", f"{_EDGES} SELECT feature, round(psi, 6) AS psi, n, bins FROM drift")
def psi_drift(spark, sf):
    return rounded(psi.psi_drift(views.serve(spark, sf), psi.psi_profile(views.base(spark, sf), FEATURES), FEATURES))


@query("D15_bin_counts", f"{_EDGES} SELECT feature, id, m::BIGINT AS count FROM shares")
def bin_counts(spark, sf):
    return psi.psi_bin_counts(views.serve(spark, sf), psi.psi_profile(views.base(spark, sf), FEATURES), FEATURES)


_SHARES = """shares AS (SELECT bin_id AS id, count(*) AS c, sum(count(*)) OVER () AS total FROM facts WHERE created_at > TIMESTAMP '1998-05-24'
  GROUP BY bin_id)"""


@query("D16_distributions", f"""{with_views("facts")}, {_SHARES}
  SELECT 'l_quantity' AS feature, id, round(c / total, 6) AS observed, total::BIGINT AS total FROM shares WHERE total > 50""")
def distributions(spark, sf):
    return rounded(psi.psi_distributions(views.psi_facts(spark, sf), views.even_profile(spark), datetime(1998, 5, 24)))


@query("D17_J1_J2_psi_over_time", f"""{with_views("facts")}, binned AS (
  SELECT time_bucket(INTERVAL 43200 MINUTE, created_at, TIMESTAMP '1970-01-01') AS bucket, bin_id AS id, count(*) AS c FROM facts
    GROUP BY ALL UNION ALL SELECT NULL, bin_id, count(*) FROM facts GROUP BY bin_id),
shares AS (SELECT *, sum(c) OVER (PARTITION BY bucket) AS total FROM binned),
grid AS (SELECT DISTINCT bucket, total, i AS id FROM shares, range(1, 6) t(i) WHERE total > 100),
al AS (SELECT g.bucket, g.total, 0.2 + 1e-10 AS p, coalesce(s.c / s.total, 0) + 1e-10 AS q FROM grid g LEFT
  JOIN shares s ON g.bucket IS NOT DISTINCT FROM s.bucket AND g.id = s.id)
SELECT 'l_quantity' AS feature, {stamp("bucket")}, round(sum((p - q) * ln(p / q)), 6) AS psi, total::BIGINT AS total FROM al
  GROUP BY bucket, total""")
def psi_over_time(spark, sf):
    return rounded(psi.psi_over_time(views.psi_facts(spark, sf), views.even_profile(spark), 43200))


@query("D18_psi_normal", f"""{_EDGES} SELECT feature, round(psi, 6) AS psi, n, bins, round((bins - 1) / n + {normal_quantile(0.95)!r} * sqrt(2 * (bins - 1)) / n,
  6) AS threshold, psi > (bins - 1) / n + {normal_quantile(0.95)!r} * sqrt(2 * (bins - 1)) / n AS alert FROM drift""")
def psi_normal(spark, sf):
    drift = psi.psi_drift(views.serve(spark, sf), psi.psi_profile(views.base(spark, sf), FEATURES), FEATURES)
    return rounded(psi.psi_alerts(drift, "normal"))


_CHI = "CASE bins " + " ".join(f"WHEN {b} THEN {chi_square_quantile(0.95, b - 1)!r}" for b in range(2, 12)) + " END / n"


@query(
    "D21_psi_alerts",
    f"{_EDGES} SELECT feature, round(psi, 6) AS psi, n, bins, round({_CHI}, 6) AS threshold, psi > {_CHI} AS alert FROM drift",
)
def psi_alerts(spark, sf):
    prof = psi.fixed_profile(psi.psi_profile(views.base(spark, sf), FEATURES))
    drift = psi.psi_drift(views.serve(spark, sf), prof, FEATURES)
    return rounded(psi.psi_alerts(drift, "chi_square", profile=prof))


@query(
    "D20_psi_fixed",
    f"{_EDGES} SELECT feature, round(psi, 6) AS psi, n, bins, 0.25::DOUBLE AS threshold, psi > 0.25 AS alert FROM drift",
)
def psi_fixed(spark, sf):
    drift = psi.psi_drift(views.serve(spark, sf), psi.psi_profile(views.base(spark, sf), FEATURES), FEATURES)
    return rounded(psi.psi_alerts(drift, "fixed"))


# SPC.

_CHUNKS = """chunks AS (SELECT (row_number() OVER (ORDER BY created_at, event_id) - 1) // 25 AS chunk, value FROM metric),
means AS (SELECT chunk, avg(value) AS m, stddev_samp(value) AS s FROM chunks GROUP BY chunk)"""
_PROFILE = """prof AS (SELECT avg(m) AS center, avg(s) / (96 / 97.0::DOUBLE) AS sg FROM means)"""
_ZONE = """(CASE WHEN value IN (center, center + 3 * sg, center - 3 * sg) THEN 0
  WHEN value > center THEN 1 + len(list_filter([1, 2, 3], lambda k: value >= center + k * sg))
  ELSE -1 - len(list_filter([1, 2, 3], lambda k: value <= center - k * sg)) END)::INTEGER"""
_DRIFT = f"""{with_views('metric')}, {_CHUNKS}, {_PROFILE},
  drift AS (SELECT 'value' AS feature, created_at, event_id, row_number() OVER (ORDER BY created_at, event_id) - 1 AS seq, value,
  {_ZONE} AS zone FROM metric, prof)"""


def _spc(spark, sf):
    held = views.metric(spark, sf).select("created_at", "event_id", "value")
    prof = spc.spc_profile(held, ["value"], ["created_at", "event_id"], 25)
    series = spc.numbered(held, ["created_at", "event_id"]).select(F.lit("value").alias("feature"), "seq", "value")
    return held, prof, series


@query(
    "W6_D23_spc_profile",
    f"{with_views('metric')}, {_CHUNKS}, {_PROFILE} SELECT 'value' AS feature, round(center, 6) AS center, " + ", ".join(
        f"round(center + {k} * sg, 6) AS {n}_ucl, round(center - {k} * sg, 6) AS {n}_lcl" for k,
        n in ((1, "one"), (2, "two"), (3, "three"))
    ) + " FROM prof",
)
def spc_profile(spark, sf):
    return rounded(_spc(spark, sf)[1])


@query("D24_spc_samples", f"{with_views('metric')}, {_CHUNKS} SELECT 'value' AS feature, chunk AS seq, round(m, 6) AS value FROM means")
def spc_samples(spark, sf):
    return rounded(spc.spc_samples(views.metric(spark, sf), ["value"], 25, ["created_at", "event_id"]))


@query(
    "D25_D26_spc_drift",
    f"{_DRIFT} SELECT zone, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM drift GROUP BY zone",
)
def spc_drift(spark, sf):
    _, prof, series = _spc(spark, sf)
    return rounded(
        spc.spc_drift(series, prof).groupBy("zone").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )


@query("W2_D29_trend", f"""{_DRIFT}, s AS (SELECT seq, sign(zone - lag(zone) OVER (ORDER BY seq)) AS d FROM drift),
r AS (SELECT seq, count(*) FILTER (d = 1) OVER w AS up, count(*) FILTER (d = -1) OVER w AS down FROM s
  WINDOW w AS (ORDER BY seq ROWS 1 PRECEDING)) SELECT seq FROM r WHERE up >= 2 OR down >= 2""")
def trend(spark, sf):
    _, prof, series = _spc(spark, sf)
    return spc.trend_hits(spc.spc_drift(series, prof), 3).select("seq")


@query("W3_consecutive", f"""{_DRIFT}, r AS (SELECT seq, zone, count(*) FILTER (zone >= 1) OVER w AS up,
  count(*) FILTER (zone <= -1) OVER w AS down FROM drift WINDOW w AS (ORDER BY seq ROWS 3 PRECEDING)) SELECT seq, zone FROM r
  WHERE abs(zone) = 1 AND (up >= 4 OR down >= 4)""")
def consecutive(spark, sf):
    _, prof, series = _spc(spark, sf)
    return spc.consecutive_hits(spc.spc_drift(series, prof), 4, 1).select("seq", "zone")


@query("W4_alternating", f"""{_DRIFT}, s AS (SELECT seq, zone, zone <> lag(zone) OVER (ORDER BY seq) AS turn FROM drift),
r AS (SELECT seq, zone, count(*) FILTER (abs(zone) >= 1) OVER (ORDER BY seq ROWS 3 PRECEDING) AS past,
  count(*) FILTER (turn) OVER (ORDER BY seq ROWS 2 PRECEDING) AS turns FROM s) SELECT seq, zone FROM r
  WHERE abs(zone) = 1 AND past = 4 AND turns = 3""")
def alternating(spark, sf):
    _, prof, series = _spc(spark, sf)
    return spc.alternating_hits(spc.spc_drift(series, prof), 4, 1).select("seq", "zone")


def _rule_sql(zone: int, n: int, alternating: bool) -> str:
    kind = "out_of_bounds" if zone == 4 else ("alternating" if alternating else "consecutive")
    last = f"OVER (ORDER BY seq ROWS {n - 1} PRECEDING)"
    if alternating:
        turns = f"count(*) FILTER (turn) OVER (ORDER BY seq ROWS {n - 2} PRECEDING) = {n - 1}" if n > 1 else "true"
        hit = f"count(*) FILTER (abs(zone) >= {zone}) {last} = {n} AND {turns}"
    else:
        hit = f"count(*) FILTER (zone >= {zone}) {last} >= {n} OR count(*) FILTER (zone <= -{zone}) {last} >= {n}"
    return f"SELECT {zone} AS zone, '{kind}' AS kind FROM (SELECT zone, {hit} AS hit FROM t) WHERE abs(zone) = {zone} AND hit"


_RULES_SQL = " UNION ".join(_rule_sql(i // 2 + 1, n, bool(i % 2)) for i, n in enumerate(spc.parse_rule(spc.RULE)))
_TREND_SQL = """SELECT 0 AS zone, 'trend' AS kind FROM (SELECT count(*) FILTER (d = 1) OVER w AS up, count(*) FILTER (d = -1) OVER w AS down FROM t
  WINDOW w AS (ORDER BY seq ROWS 5 PRECEDING)) WHERE up >= 6 OR down >= 6"""


@query("D28_D30_spc_alerts", f"""{_DRIFT}, t AS (SELECT seq, zone, zone <> lag(zone) OVER (ORDER BY seq) AS turn,
  sign(zone - lag(zone) OVER (ORDER BY seq)) AS d FROM drift)
SELECT 'value' AS feature, zone, kind FROM ({_RULES_SQL} UNION {_TREND_SQL})""")
def spc_alerts(spark, sf):
    _, prof, series = _spc(spark, sf)
    return spc.spc_alerts(series, prof)


@query("W7_D27_spc_recent", f"""{with_views("metric")}, h AS (SELECT metric AS feature, created_at, value FROM metric
  WHERE created_at > TIMESTAMP '2024-01-05' AND metric IN ('view', 'click', 'error')),
r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY created_at DESC, value DESC) AS seq FROM h)
SELECT feature, seq::INTEGER AS seq, round(value, 6) AS value FROM r WHERE seq <= (SELECT min(n) FROM (SELECT count(*) AS n FROM h
  GROUP BY feature))""")
def spc_recent(spark, sf):
    return rounded(spc.spc_recent(views.samples(spark, sf), _SINCE, ["view", "click", "error"]))


# Metrics.

_HALF_HOUR = "time_bucket(INTERVAL 30 MINUTE, created_at, TIMESTAMP '1970-01-01')"


@query("A1_time_bin", f"{with_views('metric')} SELECT {stamp(_HALF_HOUR, 'bucket')}, count(*) AS n FROM metric GROUP BY {_HALF_HOUR}")
def time_bins(spark, sf):
    return rounded(views.metric(spark, sf).groupBy(time_bin("created_at", 30).alias("bucket")).agg(F.count("*").alias("n")))


@query("A3_binned_mean", f"""{with_views("metric")}, b AS (SELECT metric, {_HALF_HOUR} AS bucket, avg(value) AS mean FROM metric GROUP BY ALL)
SELECT metric, count(*) AS points, strftime(max(bucket), '%Y-%m-%d %H:%M:%S.%f') AS newest, round(arg_max(mean, bucket), 6) AS newest_mean,
  round(sum(mean), 6) AS total FROM b GROUP BY metric""")
def binned_mean(spark, sf):
    held = metrics.binned_mean(views.metric(spark, sf), "metric", "value", 30)
    first = F.element_at("points", 1)
    return rounded(
        held.select(
            "metric",
            F.size("points").cast("long").alias("points"),
            first["bucket"].alias("newest"),
            first["mean"].alias("newest_mean"),
            F.aggregate("points", F.lit(0.0), lambda s, p: s + p["mean"]).alias("total"),
        )
    )


_BAND = "round(avg(value), 6) AS avg, round(avg(value) - coalesce(stddev_samp(value), 0), 6) AS lower, round(avg(value) + coalesce(stddev_samp(value), 0), 6) AS upper"


@query(
    "A4_binned_band",
    f"{with_views('metric')} SELECT metric, {stamp(_HALF_HOUR, 'bucket')}, {_BAND} FROM metric GROUP BY metric, {_HALF_HOUR}",
)
def binned_band(spark, sf):
    return rounded(metrics.binned_band(views.metric(spark, sf), "metric", "value", 30))


@query("A5_binned_pass_rate", f"""{with_views('metric')} SELECT metric, {stamp(_HALF_HOUR, 'bucket')}, {_BAND}, round(avg((k > 50)::INTEGER), 6) AS pass_rate FROM metric
  GROUP BY metric, {_HALF_HOUR}""")
def binned_pass_rate(spark, sf):
    return rounded(metrics.binned_pass_rate(views.metric(spark, sf).withColumn("passed", F.col("k") > 50), "metric", "value", "passed", 30))


@query("A6_metric_means", f"""{with_views('metric')} SELECT metric, round(avg(value), 6) AS value FROM metric WHERE created_at > TIMESTAMP '2024-01-05'
  GROUP BY metric""")
def metric_means(spark, sf):
    return rounded(metrics.metric_means(views.metric(spark, sf), _SINCE))


@query("A7_sum_map", f"{with_views('metric')} SELECT metric, (k % 5)::INTEGER AS key, count(*) AS n FROM metric GROUP BY ALL")
def sum_map(spark, sf):
    held = views.metric(spark, sf).select("metric", F.create_map(F.col("k") % 5, F.lit(1).cast("long")).alias("counts"))
    return metrics.sum_map(held, ["metric"], "counts").select("metric", F.explode("counts").alias("key", "n"))


@query("A10_A11_percentiles", f"""{with_views('metric')} SELECT metric, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE),
  6) AS p95, round(quantile_cont(value, 0.99::DOUBLE), 6) AS p99 FROM metric GROUP BY metric""")
def percentiles(spark, sf):
    return rounded(metrics.exact_percentiles(views.metric(spark, sf), ["metric"], "value"))


@query("A10_A12_approximate")
def approximate(spark, sf):
    return views.metric(spark, sf).groupBy("metric").agg(*metrics.percentiles("value"), F.approx_count_distinct("user_id").alias("users"))


@query("A10_A12_rollup", f"""{with_views('metric')} SELECT coalesce(metric, 'all') AS metric, strftime(CASE WHEN metric IS NULL THEN NULL ELSE d END, '%Y-%m-%d') AS day,
  count(*) AS n, round(avg(value), 6) AS value_mean, count(DISTINCT user_id) AS users, true AS p50_near, true AS p95_near, true AS users_near
  FROM (SELECT *, date_trunc('day', created_at) AS d FROM metric) GROUP BY GROUPING SETS ((metric, d), ())""")
def rolled_up(spark, sf):
    """Hourly sketches merged to days of a metric and to one total, with the exact counts, and whether each sketch keeps its bound."""
    path, rows = new_folder(spark, "rollup"), views.metric(spark, sf)
    rollup.sketched(rows, ["metric"], ("value",), ("user_id",), "hour", "created_at").write.parquet(path)
    hours = spark.read.parquet(path)
    out = None
    for keys, unit in ((["metric"], "day"), ([], None)):
        found = rollup.answers(rollup.merged(hours, keys, unit), (0.5, 0.95))
        by = [*keys, *(["bucket"] if unit else [])]
        own = rows.withColumn("bucket", F.date_trunc("day", "created_at")).withColumn("__all", F.lit(0))
        held = own.join(found.withColumn("__all", F.lit(0)), [*by, "__all"])
        near = [
            (F.avg((F.col("value") < F.col(f"value_p{q}")).cast("double")) <= q / 100 + rollup.RANK_ERROR)
            & (F.avg((F.col("value") <= F.col(f"value_p{q}")).cast("double")) >= q / 100 - rollup.RANK_ERROR) for q in (50, 95)
        ]
        users = F.count_distinct("user_id")
        made = held.groupBy(*by, "n", "value_mean", "user_id_distinct").agg(near[0].alias("p50_near"), near[1].alias("p95_near"), users.alias("users"))
        made = made.select(
            (F.col("metric") if keys else F.lit("all")).alias("metric"), (F.date_format("bucket", "yyyy-MM-dd") if unit else F.lit(None).cast("string")).alias("day"), "n", "value_mean", "users",
            "p50_near", "p95_near", (F.abs(F.col("user_id_distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * rollup.DISTINCT_ERROR)).alias("users_near"),
        )
        out = made if out is None else out.unionByName(made)
    return rounded(out)


@query("A12_A13_distinct_and_error_rate", f"""{with_views('metric')} SELECT metric, count(DISTINCT user_id) AS users, round(avg((k % 10 = 0)::INTEGER), 6) AS error_rate FROM metric
  GROUP BY metric""")
def distinct_and_errors(spark, sf):
    return rounded(
        views.metric(spark, sf).groupBy("metric").agg(
            F.count_distinct("user_id").alias("users"),
            metrics.error_rate(F.col("k") % 10 == 0).alias("error_rate"),
        )
    )


@query("A15_distinct_features", with_views("metric") + " SELECT DISTINCT user_id AS entity_id, metric AS feature FROM metric")
def distinct_features(spark, sf):
    return metrics.distinct_features(views.samples(spark, sf).withColumnRenamed("user_id", "entity_id"))


@query("D31_custom_averages", f"""{with_views('metric')} SELECT {stamp(_HALF_HOUR, 'bucket')}, metric, round(avg(value), 6) AS value FROM metric
  WHERE metric IN ('view', 'click') GROUP BY metric, {_HALF_HOUR}""")
def custom_averages(spark, sf):
    return rounded(metrics.custom_averages(views.metric(spark, sf), 30, ["view", "click"]))


def _conditions(spark):
    rows = [("view", 5.0, "above", 1.0), ("click", 50.0, "below", 2.0), ("error", 9.0, "outside", 0.5)]
    return spark.range(1).select(
        F.inline(
            F.array(
                *(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("metric", "baseline", "kind", "delta"), strict=True))) for r in rows)
            )
        )
    )


_CONDITIONS = "cond(metric, baseline, kind, delta) AS (VALUES ('view', 5.0::DOUBLE, 'above', 1.0::DOUBLE), ('click', 50.0, 'below', 2.0), ('error', 9.0, 'outside', 0.5))"
_BREAK = """CASE kind WHEN 'above' THEN value > baseline + delta
  WHEN 'below' THEN value < baseline - delta ELSE value > baseline + delta OR value < baseline - delta END"""


@query("D32_threshold_alerts", f"""{with_views('metric')}, {_CONDITIONS}, m AS (SELECT metric, avg(value) AS value FROM metric GROUP BY metric)
  SELECT metric, round(value, 6) AS value, baseline, kind, delta, {_BREAK} AS alert FROM m JOIN cond USING (metric)""")
def threshold_alerts(spark, sf):
    held = views.metric(spark, sf).groupBy("metric").agg(F.avg("value").alias("value"))
    return rounded(metrics.threshold_alerts(held, _conditions(spark)))


@query("D33_custom_alerts", f"""{with_views('metric')}, {_CONDITIONS}, m AS (SELECT metric, avg(value) AS value FROM metric WHERE created_at > TIMESTAMP '2024-01-05'
  GROUP BY metric) SELECT metric, round(value, 6) AS value, baseline, kind, delta, {_BREAK} AS alert FROM m JOIN cond USING (metric)
  WHERE {_BREAK}""")
def custom_alerts(spark, sf):
    return rounded(metrics.custom_alerts(views.metric(spark, sf), _conditions(spark), _SINCE))


@query("D34_agent_alerts", f"""{with_views('metric')}, m AS (SELECT avg((k % 100) / 100.0::DOUBLE) AS value FROM metric WHERE created_at > TIMESTAMP '2024-01-05')
  SELECT 'pass_rate' AS metric, round(value, 6) AS value, 0.9::DOUBLE AS baseline, 'below' AS kind, 0.1::DOUBLE AS delta, true AS alert
  FROM m WHERE value < 0.9 - 0.1""")
def agent_alerts(spark, sf):
    flows = views.metric(spark, sf).select("created_at", (F.col("k") % 100 / 100).alias("pass_rate"))
    condition = spark.range(1).select(
        F.lit("pass_rate").alias("metric"),
        F.lit(0.9).alias("baseline"),
        F.lit("below").alias("kind"),
        F.lit(0.1).alias("delta"),
    )
    return rounded(metrics.agent_alerts(flows, condition, _SINCE))


@query("D35_alert_log", f"""{with_views('metric')} SELECT user_id AS id, {stamp('min(created_at)', 'created_at')}, arg_max(k, (created_at,
  k > 50))::INTEGER AS entity_id, arg_max(metric, (created_at, k > 50)) AS alert, arg_max(k > 50, (created_at, k > 50)) AS active,
  {stamp('max(created_at)', 'updated_at')} FROM metric GROUP BY user_id""")
def alert_log(spark, sf):
    log = views.metric(spark, sf).select(
        F.col("user_id").alias("id"),
        F.col("k").alias("entity_id"),
        F.col("metric").alias("alert"),
        (F.col("k") > 50).alias("active"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    return rounded(metrics.list_alerts(log))


@query("D35_page_alerts", f"""{with_views('metric')}, a AS (SELECT metric || '-' || lpad(event_id::VARCHAR, 12, '0') AS id,
  user_id % 3 AS entity_id, metric AS alert, created_at, event_id % 2 = 1 AS active FROM metric WHERE k > 50)
SELECT entity_id, alert, {stamp('created_at')}, active FROM a
  WHERE entity_id = 1 AND created_at >= TIMESTAMP '2024-01-03' AND (created_at, id) < (TIMESTAMP '2024-01-20', 'x')
  ORDER BY a.created_at DESC, id DESC LIMIT 41""")
def page_alerts(spark, sf):
    """Alerts written to a log, half of them acknowledged, then one page of an entity's."""
    path = new_folder(spark, "alerts")
    rows = views.metric(spark, sf).where("k > 50")
    alert = F.create_map(F.lit("metric"), F.col("metric"), F.lit("event"), F.col("event_id").cast("string"))
    metrics.write_alerts(
        rows.select((F.col("user_id") % 3).alias("entity_id"), alert.alias("alert"), "created_at"),
        path,
        F.col("created_at"),
    )
    log = spark.read.parquet(path)
    even = log.where(F.col("alert")["event"].cast("long") % 2 == 0).select("id")
    log = metrics.ack_alerts(log, even, F.col("updated_at") + F.make_dt_interval(mins=F.lit(1)))
    named = log.withColumn("id", F.concat_ws("-", F.col("alert")["metric"], F.lpad(F.col("alert")["event"], 12, "0")))
    page = metrics.page_alerts(named, 40, [datetime(2024, 1, 20), "x"], entity_id=1, start=datetime(2024, 1, 3))
    return rounded(page.select("entity_id", F.col("alert")["metric"].alias("alert"), "created_at", "active"))


_DAY = "time_bucket(INTERVAL 1440 MINUTE, created_at, TIMESTAMP '1970-01-01')"
_NEAREST = ", ".join(
    f"round(list_sort(list(latency) FILTER (status_code < 400))[greatest(1, ceil({q} * count(*) FILTER (status_code < 400)))::INTEGER], 6) AS {n}" for q,
    n in (("0.05::DOUBLE", "p5"), ("0.25::DOUBLE", "p25"), ("0.5::DOUBLE", "p50"), ("0.95::DOUBLE", "p95"), ("0.99::DOUBLE", "p99"))
)


@query("D36_J3_route_metrics", f"""{with_views("metric", "routes")}
  SELECT {stamp(_DAY, "bucket")}, route_name, count(*) FILTER (status_code < 400) AS request_count,
  count(*) FILTER (status_code >= 400) AS error_count, round(coalesce(sum(latency) FILTER (status_code >= 400), 0), 6) AS error_latency,
  {_NEAREST},
  count(*) FILTER (status_code = 500) AS n500 FROM routes GROUP BY route_name, {_DAY}""")
def route_metrics(spark, sf):
    return rounded(
        metrics.route_metrics(views.routes(spark, sf), 1440).withColumn(
            "n500",
            F.coalesce(F.col("status_codes")[500], F.lit(0)),
        ).drop("status_codes")
    )


_HOUR = "time_bucket(INTERVAL 60 MINUTE, created_at, TIMESTAMP '1970-01-01')"
_STORED = _NEAREST.replace("round(", "(").replace(", 6)", ")")


@query("D37_route_metrics_over_time", f"""{with_views("metric", "routes")},
  hourly AS (SELECT {_HOUR} AS created_at, route_name, count(*) FILTER (status_code < 400) AS request_count,
  count(*) FILTER (status_code >= 400) AS error_count, coalesce(sum(latency) FILTER (status_code >= 400), 0) AS error_latency, {_STORED}
  FROM routes GROUP BY route_name, {_HOUR})
SELECT route_name, {stamp(_DAY, "bucket")}, {", ".join(f"round(avg({p}), 6) AS {p}" for p in ("p5", "p25", "p50", "p95", "p99"))},
  sum(request_count)::BIGINT AS request_count, sum(error_count)::BIGINT AS error_count, round(sum(error_latency), 6) AS error_latency
  FROM hourly GROUP BY route_name, {_DAY}""")
def route_metrics_over_time(spark, sf):
    stored = metrics.route_metrics(views.routes(spark, sf), 60).withColumnRenamed("bucket", "created_at")
    held = metrics.route_metrics_over_time(stored, 1440)
    return rounded(held.select("route_name", F.inline("points")).drop("status_codes"))


# Registry.


def _profiles(spark, sf):
    s = views.table(spark, sf, "supplier")
    version = F.concat_ws(".", F.col("s_suppkey") % 3, F.floor(F.col("s_suppkey") / 3) % 5, F.floor(F.col("s_suppkey") / 15))
    return s.select(
        F.col("s_suppkey").alias("entity_id"),
        F.lit("space").alias("space"),
        F.concat(F.lit("m"), F.col("s_nationkey") % 4).alias("name"),
        version.alias("version"),
        (F.col("s_suppkey") % 2 == 0).alias("active"),
    )


_PROFILES = """p AS (SELECT s_suppkey AS entity_id, 'm' || (s_nationkey % 4) AS name, s_suppkey % 3 AS major, (s_suppkey // 3) % 5 AS minor,
  s_suppkey // 15 AS patch, s_suppkey % 2 = 0 AS active FROM supplier)"""


@query("D38_select_profiles", f"""WITH {_PROFILES},
  newest AS (SELECT name, max(struct_pack(a := major, b := minor, c := patch)) AS v FROM p WHERE major = 1 GROUP BY name)
  SELECT name, v.a || '.' || v.b || '.' || v.c AS version FROM newest""")
def select_profiles(spark, sf):
    return registry.select_profiles(_profiles(spark, sf), "^1.0.0").select("name", "version")


@query(
    "D38_mark_superseded",
    f"WITH {_PROFILES} SELECT entity_id, row(major, minor, patch) = max(row(major, minor, patch)) OVER (PARTITION BY name) AS active FROM p",
)
def mark_superseded(spark, sf):
    return registry.mark_superseded(_profiles(spark, sf)).select("entity_id", "active")


@query("D39_due_checks", f"""{with_views("metric")}, due AS (SELECT s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 3 = 0),
facts AS (SELECT l_suppkey AS entity_id, ceil(l_quantity / 10)::INTEGER AS id FROM lineitem JOIN due ON l_suppkey = entity_id
  WHERE l_shipdate > TIMESTAMP '{views.CUT}'),
sh AS (SELECT entity_id, id, count(*) / sum(count(*)) OVER (PARTITION BY entity_id) AS q, sum(count(*)) OVER (PARTITION BY entity_id) AS n
  FROM facts GROUP BY entity_id, id),
al AS (SELECT g.entity_id, g.n, 0.2 + 1e-10 AS p, coalesce(sh.q, 0) + 1e-10 AS q FROM (SELECT DISTINCT entity_id, n, i AS id
  FROM sh, range(1, 6) t(i)) g LEFT JOIN sh USING (entity_id, id)),
d AS (SELECT entity_id, sum((p - q) * ln(p / q)) AS value, max(n) AS n FROM al GROUP BY entity_id)
SELECT entity_id, 'psi' AS kind, 'l_quantity' AS name, round(value, 6) AS value, 0.005::DOUBLE AS threshold FROM d WHERE n > 50 AND value > 0.005""")
def due_checks(spark, sf):
    suppliers = views.table(spark, sf, "supplier")
    profiles = suppliers.select(
        F.col("s_suppkey").alias("entity_id"),
        F.lit("psi").alias("drift_type"),
        (F.col("s_suppkey") % 3 == 0).alias("active"),
        F.lit(views.CUT).cast("timestamp").alias("previous_run"),
        F.lit("2000-01-01").cast("timestamp").alias("next_run"),
    )
    facts = views.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.lit("l_quantity").alias("feature"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("bin_id"),
        F.lit(1).cast("long").alias("bin_count"),
    )
    bins = suppliers.select(
        F.col("s_suppkey").alias("entity_id"),
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("id"),
    ).withColumns({"feature": F.lit("l_quantity"), "proportion": F.lit(0.2)})
    custom = views.metric(spark, sf).select(F.col("user_id").alias("entity_id"), "created_at", "metric", "value")
    conditions = _conditions(spark).where("false").select(F.lit(0).cast("long").alias("entity_id"), "metric", "baseline", "kind", "delta")
    return rounded(registry.run_due_checks(profiles, facts, bins, custom, conditions, datetime(2001, 1, 1), fixed=0.005))


_ENTITY_RULES = " UNION ".join(
    _rule_sql(i // 2 + 1, n, bool(i % 2)).replace(
        "ORDER BY seq",
        "PARTITION BY entity_id, feature ORDER BY seq",
    ).replace("SELECT zone,", "SELECT entity_id, feature, zone,").replace(
        "SELECT " + str(i // 2 + 1),
        "SELECT entity_id, feature, " + str(i // 2 + 1),
    ) for i,
    n in enumerate(spc.parse_rule(spc.RULE))
)
_ENTITY_TREND = _TREND_SQL.replace(
    "ORDER BY seq",
    "PARTITION BY entity_id, feature ORDER BY seq",
).replace("SELECT 0 AS zone", "SELECT entity_id, feature, 0 AS zone").replace(
    "FROM (SELECT count",
    "FROM (SELECT entity_id, feature, count",
)


@query("D39_due_spc_and_agent", f"""{with_views("metric")}, m AS (SELECT user_id % 4 AS entity_id, metric AS feature, created_at, value, k
  FROM metric),
prof AS (SELECT entity_id, feature, avg(value) AS center, stddev_samp(value) / 2 AS sg FROM m GROUP BY entity_id, feature),
h AS (SELECT * FROM m WHERE entity_id % 2 = 0 AND created_at > TIMESTAMP '2024-01-05'),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, feature
  ORDER BY created_at DESC, value DESC) - 1 AS seq, count(*) OVER (PARTITION BY entity_id, feature) AS c FROM h),
least AS (SELECT entity_id, min(c) AS c FROM n GROUP BY entity_id),
drift AS (SELECT n.entity_id, n.feature, seq, {_ZONE} AS zone FROM n JOIN least l ON n.entity_id = l.entity_id AND seq < l.c
  JOIN prof p ON n.entity_id = p.entity_id AND n.feature = p.feature),
t AS (SELECT entity_id, feature, seq, zone, zone <> lag(zone) OVER w AS turn, sign(zone - lag(zone) OVER w) AS d FROM drift
  WINDOW w AS (PARTITION BY entity_id, feature ORDER BY seq)),
found AS ({_ENTITY_RULES} UNION {_ENTITY_TREND}),
agent AS (SELECT entity_id, avg((k % 100) / 100.0::DOUBLE) AS value FROM m WHERE entity_id = 1 AND created_at > TIMESTAMP '2024-01-05'
  GROUP BY entity_id)
SELECT entity_id, 'spc' AS kind, feature || ':' || kind AS name, zone::DOUBLE AS value, NULL::DOUBLE AS threshold FROM found
UNION ALL SELECT entity_id, 'agent', 'pass_rate', round(value, 6), 0.9 FROM agent WHERE value < 0.8""")
def due_spc_and_agent(spark, sf):
    m = views.metric(spark, sf).select(
        (F.col("user_id") % 4).alias("entity_id"),
        F.col("metric").alias("feature"),
        "created_at",
        "value",
        "k",
    )
    half = F.stddev_samp("value") / 2
    prof = m.groupBy("entity_id", "feature").agg(F.avg("value").alias("center"), half.alias("s"))
    limits = {
        f"{n}_{side}": F.col("center") + sign * k * F.col("s") for k,
        n in ((1, "one"), (2, "two"), (3, "three")) for side,
        sign in (("ucl", 1), ("lcl", -1))
    }
    kind = F.when(F.col("id") % 2 == 0, "spc").when(F.col("id") == 1, "agent").otherwise("custom")
    profiles = spark.range(4).select(
        F.col("id").alias("entity_id"),
        kind.alias("drift_type"),
        F.lit(True).alias("active"),
        F.lit(_SINCE).alias("previous_run"),
        F.lit(_SINCE).alias("next_run"),
    )
    psi_facts = m.where("false").select(
        "entity_id",
        "created_at",
        "feature",
        F.lit(1).alias("bin_id"),
        F.lit(1).cast("long").alias("bin_count"),
    )
    bins = m.where("false").select("entity_id", "feature", F.lit(1).alias("id"), F.lit(0.2).alias("proportion"))
    custom = m.where("false").select("entity_id", "created_at", F.col("feature").alias("metric"), "value")
    conditions = spark.range(1, 2).select(
        F.col("id").alias("entity_id"),
        F.lit("pass_rate").alias("metric"),
        F.lit(0.9).alias("baseline"),
        F.lit("below").alias("kind"),
        F.lit(0.1).alias("delta"),
    )
    flows = m.select("entity_id", "created_at", (F.col("k") % 100 / 100).alias("pass_rate"))
    spc_profiles = prof.withColumns(limits).drop("s")
    return rounded(
        registry.run_due_checks(
            profiles,
            psi_facts,
            bins,
            custom,
            conditions,
            datetime(2025, 1, 1),
            spc_facts=m,
            spc_profiles=spc_profiles,
            workflows=flows,
        )
    )


# Scalars.


@query("F11_sample_records")
def sample_records(spark, sf):
    return scalars.sample_records(views.metric(spark, sf), 0.1, "event_id").select("event_id", "metric")


@query(
    "F13_finite",
    "SELECT count(*) AS n FROM lineitem WHERE isfinite(ln(l_discount * 100 + 1e-300) / nullif(l_tax, 0)) AND isfinite(l_quantity)",
)
def finite(spark, sf):
    held = views.table(spark, sf, "lineitem").select(
        "l_quantity",
        (F.log(F.col("l_discount") * 100 + 1e-300) / F.nullif("l_tax", F.lit(0.0))).alias("x"),
    )
    return scalars.only_finite(held, ["x", "l_quantity"]).agg(F.count("*").alias("n"))
