"""Profile registry: selection by version range, and one sweep over all due profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import numbered
from skeinwatch.operators import metrics, psi, spc


def version_parts(df: DataFrame, column: str = "version") -> DataFrame:
    parts = F.split(column, r"\.")
    return df.withColumns({name: parts[i].cast("int") for i, name in enumerate(("major", "minor", "patch"))})


def range_bounds(text: str) -> tuple[tuple[int, int, int], tuple[int, int, int] | None]:
    """Lowest version allowed, and the first that isn't: of `*`, `^1.2.3`, `~1.2.3`, `1.*`, `1.2.*`, `1.2` or `1.2.3`."""
    if text in ("*", ""):
        return (0, 0, 0), None
    found = re.fullmatch(r"([\^~]?)(\d+)(?:\.(\d+|\*))?(?:\.(\d+|\*))?", text)
    if not found:
        raise ValueError(f"not a version range: {text!r}")
    mark, parts = found[1], [p for p in found.groups()[1:] if p not in (None, "*")]
    major, minor, patch = (int(p) for p in (*parts, "0", "0")[:3])
    low = (major, minor, patch)
    if mark == "^":
        high = (major + 1, 0, 0) if major else ((0, minor + 1, 0) if minor else (0, 0, patch + 1))
    elif mark == "~" or len(parts) == 2:
        high = (major, minor + 1, 0) if len(parts) > 1 else (major + 1, 0, 0)
    elif len(parts) == 1:
        high = (major + 1, 0, 0)
    else:
        high = (major, minor, patch + 1)
    return low, high


def select_profiles(df: DataFrame, versions: str | None = None, active: bool = False) -> DataFrame:
    """The latest version (inside a range, of the active ones) of every space and name at once."""
    held = version_parts(df)
    if active:
        held = held.where("active")
    if versions is not None:
        low, high = range_bounds(versions)
        version = F.struct("major", "minor", "patch")
        literal = lambda v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("major", "minor", "patch"), strict=True)))
        held = held.where(version >= literal(low))
        held = held if high is None else held.where(version < literal(high))
    latest = Window.partitionBy("space", "name").orderBy(F.desc("major"), F.desc("minor"), F.desc("patch"))
    return held.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "major", "minor", "patch")


def mark_superseded(df: DataFrame) -> DataFrame:
    """df with active true for the latest version of each space and name only."""
    latest = Window.partitionBy("space", "name")
    version = F.struct("major", "minor", "patch")
    return version_parts(df).withColumn("active", version == F.max(version).over(latest)).drop("major", "minor", "patch")


def due(profiles: DataFrame, now) -> DataFrame:
    return profiles.where(F.col("active") & (F.col("next_run") <= F.lit(now)))


def _psi_alerts(ready: DataFrame, facts: DataFrame, bins: DataFrame, fixed: float, per_bin: int) -> DataFrame:
    held = facts.join(ready, "entity_id").where(F.col("created_at") > F.col("previous_run"))
    counts = held.groupBy("entity_id", "feature", F.col("bin_id").alias("id")).agg(F.sum("bin_count").alias("count"))
    shares = psi.bin_proportions(counts, ["entity_id", "feature"])
    grid = shares.groupBy("entity_id", "feature").agg(F.max("total").alias("n")).join(bins, ["entity_id", "feature"])
    aligned = grid.join(shares.select("entity_id", "feature", "id", "observed"), ["entity_id", "feature", "id"], "left")
    term = psi.psi_term(F.col("proportion"), F.coalesce("observed", F.lit(0.0)))
    drift = aligned.groupBy("entity_id", "feature").agg(F.sum(term).alias("value"), F.max("n").alias("n"), F.count("*").alias("bins"))
    hit = drift.where((F.col("n") > per_bin * F.col("bins")) & (F.col("value") > fixed))
    return hit.select("entity_id", F.lit("psi").alias("kind"), F.col("feature").alias("name"), "value", F.lit(fixed).alias("threshold"))


def _mean_alerts(ready: DataFrame, facts: DataFrame, conditions: DataFrame, kind: str) -> DataFrame:
    held = facts.join(ready, "entity_id").where(F.col("created_at") > F.col("previous_run"))
    means = held.groupBy("entity_id", "metric").agg(F.avg("value").alias("value")).join(conditions, ["entity_id", "metric"])
    hit = means.where(metrics.threshold_alert(F.col("value"), F.col("baseline"), F.col("kind"), F.col("delta")))
    return hit.select("entity_id", F.lit(kind).alias("kind"), F.col("metric").alias("name"), "value", F.col("baseline").alias("threshold"))


def _spc_alerts(ready: DataFrame, facts: DataFrame, profiles: DataFrame, rule: str) -> DataFrame:
    """Samples newest first, cut to an entity's shortest feature; value is the zone of the alert, name feature:kind."""
    own = profiles.select("entity_id", "feature")
    held = facts.join(ready, "entity_id").where(
        F.col("created_at") > F.col("previous_run")
    ).join(own, ["entity_id", "feature"], "left_semi")
    shortest = held.groupBy("entity_id", "feature").agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.min("n").alias("__least"))
    samples = numbered(
        held.select("entity_id", "feature", "created_at", "value"),
        [F.desc("created_at"), F.desc("value")],
        "seq",
        ["entity_id", "feature"],
    )
    samples = samples.join(shortest, "entity_id").where(F.col("seq") < F.col("__least")).select("entity_id", "feature", "seq", "value")
    found = spc_sweep(samples, profiles, rule)
    name = F.concat_ws(":", "feature", "kind")
    return found.select(
        "entity_id",
        F.lit("spc").alias("kind"),
        name.alias("name"),
        F.col("zone").cast("double").alias("value"),
        F.lit(None).cast("double").alias("threshold"),
    )


def run_due_checks(
    profiles: DataFrame,
    psi_facts: DataFrame,
    psi_bins: DataFrame,
    custom_facts: DataFrame,
    conditions: DataFrame,
    now,
    fixed: float = 0.25,
    per_bin: int = 10,
    spc_facts: DataFrame | None = None,
    spc_profiles: DataFrame | None = None,
    rule: str = spc.RULE,
    workflows: DataFrame | None = None,
) -> DataFrame:
    """entity_id, kind, name, value, threshold: every alert of every due profile (drift_type psi, custom, spc, agent).

    Facts count from each profile's own previous run. psi_bins: entity_id, feature, id, proportion; conditions (custom
    metrics, and pass_rate of agents): entity_id, metric, baseline, kind, delta; spc_facts: entity_id, created_at,
    feature, value; spc_profiles: entity_id, feature and limits; workflows: entity_id, created_at, pass_rate.
    """
    ready = due(profiles, now).select("entity_id", "drift_type", "previous_run")
    of = lambda kind: ready.where(F.col("drift_type") == kind).drop("drift_type")
    out = _psi_alerts(of("psi"), psi_facts, psi_bins, fixed, per_bin)
    out = out.unionByName(_mean_alerts(of("custom"), custom_facts, conditions, "custom"))
    if spc_facts is not None:
        out = out.unionByName(_spc_alerts(of("spc"), spc_facts, spc_profiles, rule))
    if workflows is not None:
        rates = workflows.select("entity_id", "created_at", F.lit("pass_rate").alias("metric"), F.col("pass_rate").alias("value"))
        out = out.unionByName(_mean_alerts(of("agent"), rates, conditions, "agent"))
    return out


def spc_sweep(samples: DataFrame, profiles: DataFrame, rule: str = spc.RULE) -> DataFrame:
    """Alerts of all entities' features: samples and profiles carry entity_id; a feature is an entity's own."""
    own = lambda df: df.withColumn("feature", F.to_json(F.struct("entity_id", "feature")))
    found = spc.spc_alerts(own(samples), own(profiles).drop("entity_id"), rule)
    parsed = F.from_json("feature", "entity_id long, feature string")
    return found.select(parsed["entity_id"].alias("entity_id"), parsed["feature"].alias("feature"), "zone", "kind")
