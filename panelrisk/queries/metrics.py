"""Queries on metrics, thresholds, scoring, drift and association."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions import scalar
from panelrisk.operators import drift, metrics, ordered
from panelrisk.plans import jobs
from panelrisk.queries.base import feature_table, features, query, scored, scored_table

EDGES = [0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]


def r6(df):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_GROUPS = """WITH g AS (SELECT pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM sc GROUP BY pd),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY pd DESC ROWS UNBOUNDED PRECEDING))"""
_RANK = "sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos * cp / (cp + cn)) / max(p) AS average_precision, max(abs(cp / p - cn / n)) AS ks"


@query(_GROUPS + " SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(ks, 6) AS ks FROM (SELECT " + _RANK + " FROM c)")
def ev1_ev2_ev4_rank_metrics(spark, sf_dir):
    return r6(metrics.rank_metrics(scored_table(spark, sf_dir)))


_POINT = """count(*) AS observations, round(avg(label), 6) + 0.0 AS actual_rate, round(avg(pd), 6) + 0.0 AS mean_pd, round(sum(label) / sum(pd), 6) + 0.0 AS observed_expected,
round(avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, pd))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, pd))))), 6) + 0.0 AS log_loss, round(avg((pd - label) ** 2), 6) + 0.0 AS brier"""


@query(f"SELECT {_POINT} FROM sc")
def ev3_ev6_point_metrics(spark, sf_dir):
    return r6(metrics.point_metrics(scored(spark, sf_dir)))


_RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity"""
_CELLS = "count(*) FILTER (WHERE pd >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE pd >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE pd < {t} AND label = 1) AS fn, count(*) FILTER (WHERE pd < {t} AND label = 0) AS tn"


@query(f"SELECT tp, fp, fn, tn, {_RATES} FROM (SELECT {_CELLS.format(t=0.1)} FROM sc)")
def ev5_confusion(spark, sf_dir):
    return r6(metrics.confusion(scored(spark, sf_dir), 0.1))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(pd, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM sc),
d AS (SELECT greatest(1, len(list_filter(edges, lambda x: x < pd)))::INT AS decile, label, pd FROM sc, e),
g AS (SELECT decile, count(*) AS n, sum(label)::BIGINT AS events, avg(pd) AS mean_pd FROM d GROUP BY decile)
SELECT decile, n, events, round(mean_pd, 6) AS mean_pd, round(events / n, 6) AS event_rate, round(sum(events) OVER (ORDER BY decile) / sum(events) OVER (), 6) AS cum_event_share, round(events / n / (sum(events) OVER () / sum(n) OVER ()), 6) AS lift FROM g""")
def ev7_deciles(spark, sf_dir):
    return r6(metrics.deciles(scored_table(spark, sf_dir)))


@query(_GROUPS + " SELECT pd, round(cp / p, 6) AS tpr, round(cn / n, 6) AS fpr FROM c")
def ev8_roc_curve(spark, sf_dir):
    return metrics.curve(scored_table(spark, sf_dir)).select("pd", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(_GROUPS + " SELECT pd, round(cp / p - cn / n, 6) + 0.0 AS gap FROM c")
def ev9_ks_curve(spark, sf_dir):
    return metrics.curve(scored_table(spark, sf_dir)).select("pd", (F.round("gap", 6) + 0.0).alias("gap"))


_BIN = "CASE " + " ".join(f"WHEN pd <= {e} THEN {k}" for k, e in enumerate(EDGES) if k) + " END"
_TABLE = f"SELECT {_BIN} AS bin, count(*) AS n, avg(pd) AS mean_pd, avg(label) AS event_rate, abs(avg(label) - avg(pd)) AS gap FROM sc GROUP BY 1"


@query(f"SELECT bin, n, round(mean_pd, 6) AS mean_pd, round(event_rate, 6) AS event_rate, round(gap, 6) AS gap FROM ({_TABLE})")
def ev10_calibration_table(spark, sf_dir):
    return r6(metrics.calibration_table(scored(spark, sf_dir), EDGES))


@query(f"SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM ({_TABLE})")
def ev11_calibration_errors(spark, sf_dir):
    return r6(metrics.calibration_errors(metrics.calibration_table(scored(spark, sf_dir), EDGES)))


_GRID = f"SELECT t AS threshold, {_CELLS.format(t='t')} FROM sc, (SELECT round(0.01 + 0.01 * i, 10)::DOUBLE AS t FROM range(29) x(i)) GROUP BY t"


_ERRORS = """tp + fp AS flagged, round((tp + fp) / (tp + fp + fn + tn), 6) AS flagged_share, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS event_capture_rate, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS false_negative_rate, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate"""


@query(f"SELECT threshold, tp, fp, fn, tn, {_RATES}, {_ERRORS} FROM ({_GRID})")
def ev18_threshold_grid(spark, sf_dir):
    return r6(metrics.threshold_grid(scored(spark, sf_dir), 0.01, 0.3, 0.01))


@query(f"""SELECT threshold, round(f1, 6) AS f1 FROM (SELECT threshold, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS p, tp / (tp + fn) AS r FROM ({_GRID})) ORDER BY f1 DESC, p DESC, r DESC, threshold LIMIT 1""")
def ev19_tk3_best_threshold(spark, sf_dir):
    return r6(metrics.best_threshold(metrics.threshold_grid(scored(spark, sf_dir), 0.01, 0.3, 0.01)).select("threshold", "f1"))


@query("""WITH g AS (SELECT vintage, pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM sc GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, nullif(sum(pos) OVER (PARTITION BY vintage), 0) AS p, nullif(sum(neg) OVER (PARTITION BY vintage), 0) AS n FROM g WINDOW w AS (PARTITION BY vintage ORDER BY pd DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT vintage, """ + _RANK + f""" FROM c GROUP BY vintage), q AS (SELECT vintage, {_POINT} FROM sc GROUP BY vintage)
SELECT q.*, round(roc_auc, 6) + 0.0 AS roc_auc, round(average_precision, 6) + 0.0 AS average_precision, round(ks, 6) + 0.0 AS ks FROM q JOIN r USING (vintage)""")
def ev20_ev22_by_vintage(spark, sf_dir):
    df = scored_table(spark, sf_dir)
    return r6(metrics.point_metrics(df, "vintage").join(metrics.rank_metrics(df, "vintage"), "vintage"))


@query("SELECT tile, count(*) AS n, sum(label)::BIGINT AS events, round(avg(pd), 6) AS mean_pd FROM (SELECT label, pd, ntile(10) OVER (ORDER BY pd DESC, loan_id, observation_age)::INT AS tile FROM sc) GROUP BY tile")
def wn20_risk_tiles(spark, sf_dir):
    return r6(metrics.risk_tiles(scored_table(spark, sf_dir), 10, "loan_id", "observation_age"))


@query("SELECT vintage, " + ", ".join(f"round(quantile_cont(pd, {q}), 6) AS p{round(100 * q)}" for q in (0.1, 0.5, 0.9, 0.99)) + " FROM sc GROUP BY vintage")
def ev25_pd_distribution(spark, sf_dir):
    q = ordered.quantiles(scored(spark, sf_dir), "pd", [0.1, 0.5, 0.9, 0.99], "vintage")
    return r6(q.select("vintage", *[F.get("quantiles", F.lit(k)).alias(f"p{p}") for k, p in enumerate((10, 50, 90, 99))]))


@query("SELECT loan_id, observation_age, round(ln(p), 6) + 0.0 AS ln_p, round(ln(1 - p), 6) + 0.0 AS ln_q, round(ln(p / (1 - p)), 6) + 0.0 AS logit FROM (SELECT *, least(greatest(pd, 1e-6), 1 - 1e-6) AS p FROM sc)")
def prj20_logit(spark, sf_dir):
    p = F.least(F.greatest("pd", F.lit(1e-6)), F.lit(1 - 1e-6))
    return r6(scored(spark, sf_dir).select("loan_id", "observation_age", F.log(p).alias("ln_p"), F.log(1 - p).alias("ln_q"), F.log(p / (1 - p)).alias("logit")))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY pd DESC, loan_id, observation_age) AS i, count(*) OVER () AS rows_all, sum(label) OVER () AS e FROM sc), f AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS share)
SELECT share, ceil(round(max(rows_all) * share, 9))::BIGINT AS population, sum(label)::BIGINT AS captured, round(sum(label) / max(e), 6) AS capture_rate, round(sum(label) / count(*), 6) AS "precision", round(avg(pd), 6) AS mean_pd, round(sum(label) / count(*) / (max(e) / max(rows_all)), 6) AS lift
FROM o, f WHERE i <= ceil(round(rows_all * share, 9)) GROUP BY share""")
def tk1_top_share(spark, sf_dir):
    return r6(metrics.top_share(scored_table(spark, sf_dir), [0.05, 0.1, 0.2], "loan_id", "observation_age"))


@query("SELECT loan_id, observation_age, (pd >= 0.1)::INT AS intervention_flag, CASE WHEN pd >= 0.1 THEN 'FLAG' ELSE 'NO_FLAG' END AS intervention_band FROM sc")
def sc2_flag(spark, sf_dir):
    hit = F.col("pd") >= 0.1
    return scored(spark, sf_dir).select("loan_id", "observation_age", hit.cast("int").alias("intervention_flag"), F.when(hit, "FLAG").otherwise("NO_FLAG").alias("intervention_band"))


@query("SELECT loan_id, observation_age, period, CASE WHEN pd >= 0.1 THEN row_number() OVER (PARTITION BY period ORDER BY (pd >= 0.1)::INT DESC, pd DESC, current_actual_upb DESC, loan_id) END::INT AS intervention_rank FROM sc")
def sc3_wn19_rank(spark, sf_dir):
    return jobs.intervene(scored_table(spark, sf_dir), 0.1).select("loan_id", "observation_age", "period", "intervention_rank")


@query("SELECT period, observation_age, count(*) AS loans, count(*) FILTER (WHERE pd >= 0.1) AS flagged, round(avg((pd >= 0.1)::INT), 6) AS flagged_share, round(coalesce(sum(current_actual_upb) FILTER (WHERE pd >= 0.1), 0), 2) AS flagged_upb FROM sc GROUP BY ALL")
def sc5_portfolio(spark, sf_dir):
    hit = F.col("pd") >= 0.1
    return scored(spark, sf_dir).groupBy("period", "observation_age").agg(F.count(F.lit(1)).alias("loans"), F.count_if(hit).alias("flagged"), F.round(F.avg(hit.cast("int")), 6).alias("flagged_share"), F.round(F.coalesce(F.sum(F.when(hit, F.col("current_actual_upb"))), F.lit(0.0)), 2).alias("flagged_upb"))


@query("SELECT loan_id, max(pd) AS max_pd, round(avg(pd), 6) AS mean_pd, max(label) AS label FROM sc GROUP BY loan_id")
def sc7_roll_up(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("loan_id").agg(F.max("pd").alias("max_pd"), F.round(F.avg("pd"), 6).alias("mean_pd"), F.max("label").alias("label"))


NUM, CAT = ["credit_score", "original_ltv", "current_actual_upb", "delinquency_months_12m"], ["occupancy_status", "property_state"]


def _based(spark, sf_dir):
    return feature_table(spark, sf_dir, "vintage", *NUM).withColumn("is_base", (F.col("vintage") <= 1995).cast("int"))


def _psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, CASE WHEN (SELECT len(edges) FROM e_{c}) >= 3 THEN (SELECT round(sum((a - e) * ln(a / e)), 6) + 0.0 FROM (SELECT greatest(1e-6, base / sum(base) OVER ()) AS e, greatest(1e-6, other / sum(other) OVER ()) AS a
    FROM (SELECT len(list_filter(edges[2:-2], lambda x: x < {c})) AS level, count(*) FILTER (WHERE vintage <= 1995) AS base, count(*) FILTER (WHERE vintage > 1995) AS other FROM mi, e_{c} WHERE {c} IS NOT NULL GROUP BY 1))) END AS psi"""


@query("WITH " + ", ".join(f"e_{c} AS (SELECT list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM mi WHERE vintage <= 1995)" for c in NUM) + " " + " UNION ALL ".join(map(_psi_sql, NUM)))
def dr1_numeric_psi(spark, sf_dir):
    return r6(drift.numeric_psi(_based(spark, sf_dir), "is_base", NUM))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, round(sum((a - e) * ln(a / e)), 6) + 0.0 AS psi FROM (SELECT greatest(1e-6, base / sum(base) OVER ()) AS e, greatest(1e-6, other / sum(other) OVER ()) AS a
FROM (SELECT coalesce({c}, '__NULL__') AS level, count(*) FILTER (WHERE vintage <= 1995) AS base, count(*) FILTER (WHERE vintage > 1995) AS other FROM mi GROUP BY 1))""" for c in CAT))
def dr2_categorical_psi(spark, sf_dir):
    return r6(drift.categorical_psi(features(spark, sf_dir).withColumn("is_base", (F.col("vintage") <= 1995).cast("int")), "is_base", CAT))


@query("""SELECT vintage, n, events, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS high
FROM (SELECT vintage, count(*) AS n, sum(future_90dpd)::BIGINT AS events, sum(future_90dpd) / count(*) AS p, 1.959964 AS z FROM mi GROUP BY vintage)""")
def dr3_wilson(spark, sf_dir):
    g = features(spark, sf_dir).groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), F.sum("future_90dpd").cast("long").alias("events"))
    low, high = scalar.wilson(F.col("events"), F.col("n"))
    return r6(g.select("vintage", "n", "events", low.alias("low"), high.alias("high")))


@query("""WITH r AS (SELECT vintage, property_state, count(*) AS n, avg(future_90dpd) AS rate FROM mi GROUP BY ALL), b AS (SELECT property_state, n / sum(n) OVER () AS weight FROM r WHERE vintage = 1995)
SELECT vintage, round(raw, 6) + 0.0 AS raw_rate, round(std, 6) + 0.0 AS standard_rate, round(raw - std, 6) + 0.0 AS mix_effect, round(100 * (raw - std) / nullif(raw, 0), 6) + 0.0 AS mix_effect_pct FROM (SELECT vintage, sum(n * rate) / sum(n) AS raw, sum(weight * rate) / sum(weight) AS std FROM r LEFT JOIN b USING (property_state) GROUP BY vintage)""")
def dr4_standardized(spark, sf_dir):
    return r6(drift.standardized(features(spark, sf_dir), "vintage", "property_state", "future_90dpd", 1995))


@query("SELECT CASE WHEN credit_score < 580 THEN 'low' WHEN credit_score < 720 THEN 'mid' WHEN credit_score >= 720 THEN 'high' END AS band, count(*) AS n, round(avg(future_90dpd), 6) AS event_rate FROM mi GROUP BY 1")
def dr5_segment_rates(spark, sf_dir):
    inf = float("inf")
    band = scalar.band(F.col("credit_score"), [-inf, 580, 720, inf], ["low", "mid", "high"])
    return features(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("future_90dpd"), 6).alias("event_rate"))


_RHO = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{k}" for k, c in enumerate(NUM))
_PAIRS = [(a, b) for a in range(len(NUM)) for b in range(a + 1, len(NUM))]
_SPEARMAN = f"WITH r AS (SELECT {_RHO} FROM mi WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUM) + ") " + " UNION ALL ".join(f"SELECT '{NUM[a]}' AS a, '{NUM[b]}' AS b, round(corr(r{a}, r{b}), 6) + 0.0 AS rho FROM r" for a, b in _PAIRS)


@query(_SPEARMAN)
def as1_spearman(spark, sf_dir):
    return r6(drift.spearman(feature_table(spark, sf_dir, "loan_id", "observation_age", *NUM), ["loan_id", "observation_age"], NUM))


@query("""WITH c AS (SELECT property_state AS a, occupancy_status AS b, count(*) AS n FROM mi WHERE property_state IS NOT NULL AND occupancy_status IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c),
s AS (SELECT max(t) * (sum(n * n / (ra * rb)) - 1) AS chi2, max(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM m)
SELECT round(sqrt(greatest(0, chi2 / t - (k - 1) * (r - 1) / (t - 1)) / least(k - (k - 1) ** 2 / (t - 1) - 1, r - (r - 1) ** 2 / (t - 1) - 1)), 6) + 0.0 AS v FROM s""")
def as2_cramers_v(spark, sf_dir):
    return r6(drift.cramers_v(features(spark, sf_dir), "property_state", "occupancy_status"))


@query("""WITH x AS (SELECT occupancy_status AS c, credit_score::DOUBLE AS v FROM mi WHERE occupancy_status IS NOT NULL AND credit_score IS NOT NULL), m AS (SELECT avg(v) AS m FROM x), g AS (SELECT c, count(*) AS n, avg(v) AS gm FROM x GROUP BY c)
SELECT round(sqrt((SELECT sum(n * (gm - m) ** 2) FROM g, m) / (SELECT sum((v - m) ** 2) FROM x, m)), 6) AS eta""")
def as3_correlation_ratio(spark, sf_dir):
    return r6(drift.correlation_ratio(features(spark, sf_dir), "occupancy_status", "credit_score"))


@query(f"SELECT feature, round(max(abs(rho)), 6) AS max_abs_rho, CASE WHEN max(abs(rho)) >= 0.9 THEN 'redundant' WHEN max(abs(rho)) >= 0.8 THEN 'high' WHEN max(abs(rho)) >= 0.5 THEN 'moderate' ELSE 'low' END AS redundancy FROM (SELECT a AS feature, rho FROM ({_SPEARMAN}) UNION ALL SELECT b, rho FROM ({_SPEARMAN})) GROUP BY feature")
def as4_redundancy(spark, sf_dir):
    pairs = drift.spearman(feature_table(spark, sf_dir, "loan_id", "observation_age", *NUM), ["loan_id", "observation_age"], NUM)
    m = F.max(F.abs("rho"))
    out = pairs.select(F.explode(F.array("a", "b")).alias("feature"), "rho").groupBy("feature").agg(m.alias("max_abs_rho"))
    c = F.col("max_abs_rho")
    return r6(out.withColumn("redundancy", F.when(c >= 0.9, "redundant").when(c >= 0.8, "high").when(c >= 0.5, "moderate").otherwise("low")))


@query(f"SELECT a, b, rho FROM ({_SPEARMAN}) ORDER BY abs(rho) DESC, a, b LIMIT 3")
def tk7_strongest_pairs(spark, sf_dir):
    return r6(drift.spearman(feature_table(spark, sf_dir, "loan_id", "observation_age", *NUM), ["loan_id", "observation_age"], NUM)).orderBy(F.abs("rho").desc(), "a", "b").limit(3)
