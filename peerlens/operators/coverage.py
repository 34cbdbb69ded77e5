"""How often derived metrics came out, and what that leaves of the scores and roles that are made of them.

The engines' results are counted once, by group and over all, in one aggregation. What is absent for everyone is followed through
the definitions: a total to the metrics that are made of it, a metric to scores, a score that is thereby disabled to roles. So a
feature that the data can never give is told from one that too few rows have so far."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Role, Score
from . import scoring

#: From what share on a metric is no longer sparse or partial, and of caveated results a feature is called caveated.
SPARSE, PARTIAL, CAVEATED = 0.5, 0.95, 0.5


def metric_status(eligible: Column, computed: Column, best: Column) -> Column:
    share = F.greatest(computed / F.nullif(eligible, F.lit(0)), F.coalesce(best, F.lit(0.0)))
    return F.when(eligible == 0, "unknown").when(computed == 0, "absent").when(share < SPARSE, "sparse").when(share < PARTIAL, "partial").otherwise("complete")


def derived_coverage(rows: DataFrame, metrics: Sequence[str], group: str, made_of: Mapping[str, frozenset[str]] | None = None) -> DataFrame:
    """(metric, eligible, computed, best_group, best_coverage, status, absent_inputs) over eligible rows.

    The best group is the one with the largest share, the first by name among equals; a metric that is common in one group is
    no gap. No rows give no result. ``made_of`` tells which totals a metric needs; those that nobody has are the reason why it is absent."""
    totals = sorted({t for own in (made_of or {}).values() for t in own})
    counts = rows.groupingSets([[], [group]], group).agg(F.grouping(group).alias("_all"), F.count("*").alias("_n"), *[F.count(m).alias(m) for m in metrics], *[F.count(t).alias(f"_t:{t}") for t in totals])
    absent = lambda m: F.array_compact(F.array(*[F.when(F.col(f"`_t:{t}`") == 0, F.lit(t)) for t in sorted((made_of or {}).get(m, ()))])) if (made_of or {}).get(m) else F.array().cast("array<string>")
    one = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("computed"), F.array_join(absent(m), ",").alias("absent_inputs")) for m in metrics]
    long = counts.select(group, "_all", "_n", F.explode(F.array(*one)).alias("m")).select(group, "_all", "_n", "m.*")
    own = F.col("_all") == 1
    share = F.when(~own & (F.col("computed") > 0), F.struct((F.col("computed") / F.col("_n")).alias("share"), F.col(group)))
    best = F.array_sort(F.collect_list(share), lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1).when(a[group] < b[group], -1).when(a[group] > b[group], 1).otherwise(0))
    whole = long.groupBy("metric").agg(F.max(F.when(own, F.col("_n"))).alias("eligible"), F.max(F.when(own, F.col("computed"))).alias("computed"), F.get(best, F.lit(0)).alias("_best"), F.max(F.when(own, F.col("absent_inputs"))).alias("absent_inputs"))
    eligible = F.coalesce("eligible", F.lit(0))
    return whole.select("metric", eligible.alias("eligible"), "computed", F.col("_best")[group].alias("best_group"), F.coalesce(F.col("_best.share"), F.lit(0.0)).alias("best_coverage"), metric_status(eligible, F.col("computed"), F.col("_best.share")).alias("status"), "absent_inputs")


def feature_coverage(wide: DataFrame, group: str, scores: Sequence[Score], roles: Sequence[Role], metrics: Sequence[str]) -> DataFrame:
    """(kind, name, eligible, produced, caveated, absent_components, surviving, needed, status, reason) of scores and roles.

    ``wide`` holds eligible rows with a percentile for each metric and a column score:<name> for each score. A feature is
    caveated where it came out without all of its weight. ``surviving`` is the share of its weight that isn't absent for
    everyone; below ``needed`` it is withheld for good, and a score that is so is absent for the roles that use it. The reason:
    inputs (withheld for good), sample (no population, or fewer than half came out), partial (made without absent components)."""
    quoted = lambda c: F.col(f"`{c}`")

    def counts(kind: str, name: str, weights: Mapping[str, float], least: float, open_to: Column) -> list[Column]:
        own = {f"`{c}`": w for c, w in weights.items()}
        made = (quoted(f"score:{name}") if kind == "score" else scoring.weighted(own, least)).isNotNull() & open_to
        return [F.count_if(open_to).alias(f"eligible:{kind}:{name}"), F.count_if(made).alias(f"produced:{kind}:{name}"), F.count_if(made & (scoring.coverage(own) < 1 - 1e-9)).alias(f"caveated:{kind}:{name}")]

    parts = [c for s in scores for c in counts("score", s.name, s.weights, s.min_coverage, F.lit(True))]
    parts += [c for r in roles for c in counts("role", r.name, r.weights, r.min_coverage, F.col(group).isin(*r.groups))]
    row = wide.agg(*parts, *[F.count(quoted(m)).alias(f"known:{m}") for m in metrics])
    dead: dict[str, Column] = {}

    def one(kind: str, name: str, weights: Mapping[str, float], least: float) -> Column:
        gone = {c: dead[c[6:]] if c.startswith("score:") else quoted(f"known:{c}") == 0 for c in weights}
        total = float(sum(weights.values()))
        surviving = F.lit(total)
        for c, w in weights.items():
            surviving = surviving - F.when(gone[c], F.lit(float(w))).otherwise(F.lit(0.0))
        surviving = surviving / total
        lacking = F.array_join(F.array_compact(F.array(*[F.when(gone[c], F.lit(c)) for c in sorted(weights)])), ",")
        eligible, produced, caveated = (quoted(f"{x}:{kind}:{name}") for x in ("eligible", "produced", "caveated"))
        for_good = (lacking != "") & (surviving < least - 1e-9)
        if kind == "score":
            dead[name] = for_good
        status = F.when(eligible == 0, "unknown").when(produced == 0, "withheld").when(caveated >= produced * CAVEATED, "caveated").otherwise("available")
        few = (produced < eligible * 0.5) | (eligible == 0)
        reason = F.when(for_good, "inputs").when((status == "withheld") | few, "sample").when(lacking != "", "partial").otherwise("")
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), eligible.alias("eligible"), produced.alias("produced"), caveated.alias("caveated"), lacking.alias("absent_components"), surviving.alias("surviving"), F.lit(least).alias("needed"), status.alias("status"), reason.alias("reason"))

    rows = [one("score", s.name, s.weights, s.min_coverage) for s in scores] + [one("role", r.name, r.weights, r.min_coverage) for r in roles]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
