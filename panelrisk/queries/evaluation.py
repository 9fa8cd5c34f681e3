"""Queries on calibration methods, temporal decay, diagnosis, importance and the evaluation job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, metrics, ml, pit, registry, suite
from panelrisk.plans import jobs
from panelrisk.queries.base import feature_table, orig, perf, query, scored, scored_table
from panelrisk.queries.models import _CLIP, _TERMS, applied_sql, named_newton
from panelrisk.queries.metrics import _GROUPS, _POINT, _RANK, r6
from panelrisk.sources.scratch import scratch_path, stored

NUM, CAT = ["credit_score", "original_ltv", "delinquency_months_12m", "current_actual_upb"], ["occupancy_status", "property_state"]
KEY = ["loan_id", "observation_age"]

#: raw and intercept-calibrated scores in long form, the intercept taken on vintages up to 1996.
_LONG = """m AS (SELECT loan_id, observation_age, vintage, label, 'raw' AS method, pd FROM sc UNION ALL
SELECT loan_id, observation_age, vintage, label, 'intercept', o / (1 + o) FROM (SELECT *, p / (1 - p) * (r / (1 - r)) / (a / (1 - a)) AS o FROM (SELECT *, least(greatest(pd, 1e-6), 1 - 1e-6) AS p FROM sc),
(SELECT avg(label) AS r, avg(least(greatest(pd, 1e-6), 1 - 1e-6)) AS a FROM sc WHERE vintage <= 1996)))"""


def _long(spark, sf_dir, names=("raw", "intercept")):
    df = scored_table(spark, sf_dir)
    return stored(calibrate.methods(df.where("vintage <= 1996"), df, names), "methods")


def _compared(long):
    """Point and rank metrics by method and period."""
    by = ("method", "vintage")
    return r6(metrics.point_metrics(long, *by).join(metrics.rank_metrics(long, *by), list(by)))


_BY = """g AS (SELECT method, vintage, pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM m GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, nullif(sum(pos) OVER (PARTITION BY method, vintage), 0) AS p, nullif(sum(neg) OVER (PARTITION BY method, vintage), 0) AS n FROM g WINDOW w AS (PARTITION BY method, vintage ORDER BY pd DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_LONG}, {_BY}, r AS (SELECT method, vintage, {_RANK} FROM c GROUP BY ALL), q AS (SELECT method, vintage, {_POINT} FROM m GROUP BY ALL)
SELECT q.*, round(roc_auc, 6) + 0.0 AS roc_auc, round(average_precision, 6) + 0.0 AS average_precision, round(ks, 6) + 0.0 AS ks FROM q JOIN r USING (method, vintage)""")
def ev23_intercept_by_period(spark, sf_dir):
    return _compared(_long(spark, sf_dir))


_FITTED = ", ".join(named_newton(name, name, "(SELECT pd, label FROM sc WHERE vintage <= 1996)") for name in _TERMS)
_ALL = _LONG.rstrip()[:-1] + "".join(f" UNION ALL SELECT loan_id, observation_age, vintage, label, '{name}', {applied_sql(name, name)} FROM sc, (SELECT * FROM w_{name} ORDER BY k DESC LIMIT 1)" for name in _TERMS) + ")"


@query(f"""WITH RECURSIVE {_FITTED}, {_ALL}, {_BY}, r AS (SELECT method, vintage, {_RANK} FROM c GROUP BY ALL), q AS (SELECT method, vintage, {_POINT} FROM m GROUP BY ALL)
SELECT q.*, round(roc_auc, 6) + 0.0 AS roc_auc, round(average_precision, 6) + 0.0 AS average_precision, round(ks, 6) + 0.0 AS ks FROM q JOIN r USING (method, vintage)""")
def ev23_method_comparison(spark, sf_dir):
    """Raw, intercept, Platt and beta by period, all fitted on vintages up to 1996."""
    return _compared(_long(spark, sf_dir, calibrate.METHODS))


@query(f"""WITH {_LONG}, t AS (SELECT *, ntile(10) OVER (PARTITION BY method ORDER BY pd DESC, loan_id, observation_age)::INT AS tile FROM m)
SELECT method, tile, count(*) AS n, sum(label)::BIGINT AS events, round(avg(pd), 6) AS mean_pd, round(sum(label) / count(*), 6) AS event_rate, round(avg(pd) - sum(label) / count(*), 6) + 0.0 AS gap, round(sum(label) / sum(pd), 6) AS ratio FROM t GROUP BY ALL""")
def ev24_decile_gap(spark, sf_dir):
    t = metrics.risk_tiles(_long(spark, sf_dir), 10, *KEY, by=("method",))
    rate = F.col("events") / F.col("n")
    return r6(t.withColumns({"event_rate": rate, "gap": F.col("mean_pd") - rate, "ratio": rate / F.col("mean_pd")}))


_V = """g AS (SELECT vintage, pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM sc GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, nullif(sum(pos) OVER (PARTITION BY vintage), 0) AS p, nullif(sum(neg) OVER (PARTITION BY vintage), 0) AS n FROM g WINDOW w AS (PARTITION BY vintage ORDER BY pd DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT vintage, """ + _RANK + """, sum(pos) / sum(pos + neg) AS rate FROM c GROUP BY vintage)"""


@query(f"""WITH {_V} SELECT vintage, round(roc_auc, 6) + 0.0 AS roc_auc, round(roc_auc - first_value(roc_auc) OVER w, 6) + 0.0 AS auc_change, round(ks - first_value(ks) OVER w, 6) + 0.0 AS ks_change,
round(average_precision / nullif(rate, 0), 6) + 0.0 AS pr_ratio FROM r WINDOW w AS (ORDER BY vintage)""")
def ev22_decay(spark, sf_dir):
    df = scored_table(spark, sf_dir)
    rows = metrics.rank_metrics(df, "vintage").join(df.groupBy("vintage").agg(F.avg("label").alias("rate")), "vintage")
    w = Window.orderBy("vintage")  # one row a vintage
    change = lambda c: F.col(c) - F.first(c).over(w)
    return r6(rows.select("vintage", "roc_auc", change("roc_auc").alias("auc_change"), change("ks").alias("ks_change"), (F.col("average_precision") / F.nullif("rate", F.lit(0.0))).alias("pr_ratio")))


@query("""WITH RECURSIVE f AS (SELECT vintage, ln(least(greatest(pd, 1e-6), 1 - 1e-6) / (1 - least(greatest(pd, 1e-6), 1 - 1e-6))) AS x, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS e FROM sc GROUP BY ALL),
v AS (SELECT vintage, sum(n)::BIGINT AS n, sum(e)::BIGINT AS events, min(x) < max(x) AS several FROM f GROUP BY vintage),
w(vintage, k, a, b) AS (SELECT vintage, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM v WHERE events > 0 AND events < n AND several UNION ALL
  SELECT vintage, k + 1, CASE WHEN h0 * h2 - h1 * h1 > 1e-12 THEN a + greatest(-5, least(5, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1))) ELSE a END, CASE WHEN h0 * h2 - h1 * h1 > 1e-12 THEN b + greatest(-5, least(5, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1))) ELSE b END
  FROM (SELECT vintage, k, a, b, sum(e - n * q) AS g0, sum((e - n * q) * x) AS g1, sum(n * q * (1 - q)) AS h0, sum(n * q * (1 - q) * x) AS h1, sum(n * q * (1 - q) * x * x) AS h2
    FROM (SELECT w.*, f.x, f.n, f.e, 1 / (1 + exp(-(a + b * f.x))) AS q FROM w JOIN f USING (vintage) WHERE k < 25) GROUP BY ALL))
SELECT v.vintage, v.n, v.events, round(a, 6) + 0.0 AS intercept, round(b, 6) + 0.0 AS slope FROM v LEFT JOIN w ON w.vintage = v.vintage AND k = 25""")
def ev16_slope_by_period(spark, sf_dir):
    return r6(calibrate.slopes(scored_table(spark, sf_dir), "vintage"))


def _metadata_sql() -> str:
    """One row for each method: populations, rates and losses before and after, and parameters."""
    p = _CLIP
    loss = lambda c: f"avg(-(label * ln({c}) + (1 - label) * ln(1 - {c})))"
    clip = lambda c: f"least(greatest({c}, 1e-6), 1 - 1e-6)"
    tables, rows = [], []
    for name in _TERMS:
        tables.append(named_newton(name, name, "t"))
    odds = f"{p} / (1 - {p}) * (r / (1 - r)) / (m / (1 - m))"
    given = {"raw": ("pd", "t", ["NULL"] * 3), "intercept": (f"({odds}) / (1 + {odds})", f"t, (SELECT avg(label) AS r, avg({p}) AS m FROM t)", ["NULL"] * 3)}
    for name in _TERMS:
        given[name] = (applied_sql(name, name), f"t, (SELECT * FROM w_{name} ORDER BY k DESC LIMIT 1)", ["max(b0)", "max(b1)", "max(b2)" if name == "beta" else "NULL"])
    for name, (value, source, weights) in given.items():
        kept = ", ".join(w[4:-1] for w in weights if w != "NULL")
        rows.append(f"""SELECT '{name}' AS method, count(*) AS n, sum(label)::BIGINT AS events, avg(label) AS event_rate, avg(pd) AS mean_raw, avg(c) AS mean_calibrated, {loss(clip('pd'))} AS log_loss_raw, {loss(clip('c'))} AS log_loss_calibrated,
        {weights[0]}::DOUBLE AS intercept, {weights[1]}::DOUBLE AS slope_0, {weights[2]}::DOUBLE AS slope_1 FROM (SELECT label, pd, {value} AS c{', ' + kept if kept else ''} FROM {source})""")
    names = "event_rate mean_raw mean_calibrated log_loss_raw log_loss_calibrated intercept slope_0 slope_1".split()
    return f"WITH RECURSIVE t AS (SELECT pd, label FROM sc WHERE vintage <= 1996), {', '.join(tables)} SELECT method, n, events, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in names)} FROM ({' UNION ALL '.join(rows)})"


@query(_metadata_sql())
def ev17_calibration_metadata(spark, sf_dir):
    fit, out = scored_table(spark, sf_dir).where("vintage <= 1996"), None
    for name in calibrate.METHODS:
        row = calibrate.metadata(fit, name)
        out = row if out is None else out.unionByName(row)
    return r6(out.select("*", F.element_at("parameters", "intercept").alias("intercept"), F.element_at("parameters", "slope_0").alias("slope_0"), F.element_at("parameters", "slope_1").alias("slope_1")).drop("parameters"))


# Bounds of the change of ROC-AUC and KS within which discrimination is stable, and of observed over expected.
AUC_BOUND, KS_BOUND, RATIO_BOUND = 0.02, 0.03, 0.70


@query(f"""WITH s AS (SELECT vintage > 1995 AS later, label, pd FROM sc), g AS (SELECT later, pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY later) AS p, sum(neg) OVER (PARTITION BY later) AS n FROM g WINDOW w AS (PARTITION BY later ORDER BY pd DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT later, {_RANK}, sum(pos) / sum(pd * (pos + neg)) AS oe FROM c GROUP BY later), d AS (SELECT b.roc_auc - a.roc_auc AS auc_change, b.ks - a.ks AS ks_change, b.oe AS later_ratio FROM r a, r b WHERE NOT a.later AND b.later)
SELECT round(auc_change, 6) AS auc_change, round(ks_change, 6) AS ks_change, round(later_ratio, 6) AS later_ratio,
CASE WHEN abs(auc_change) >= {AUC_BOUND} OR abs(ks_change) >= {KS_BOUND} THEN 'discrimination changed' WHEN later_ratio < {RATIO_BOUND} THEN 'probability level shifted' ELSE 'not decisive' END AS diagnosis FROM d""")
def ev26_diagnosis(spark, sf_dir):
    df = scored_table(spark, sf_dir).withColumn("later", F.col("vintage") > 1995)
    rows = metrics.rank_metrics(df, "later").join(metrics.point_metrics(df, "later").select("later", "observed_expected"), "later")
    of = lambda c, later: F.max(F.when(F.col("later") == later, F.col(c)))
    d = rows.agg((of("roc_auc", True) - of("roc_auc", False)).alias("auc_change"), (of("ks", True) - of("ks", False)).alias("ks_change"), of("observed_expected", True).alias("later_ratio"))
    moved = (F.abs("auc_change") >= AUC_BOUND) | (F.abs("ks_change") >= KS_BOUND)
    return r6(d.withColumn("diagnosis", F.when(moved, "discrimination changed").when(F.col("later_ratio") < RATIO_BOUND, "probability level shifted").otherwise("not decisive")))


@query(_GROUPS.replace("SELECT pd,", "SELECT vintage, pd,").replace("GROUP BY pd", "GROUP BY vintage, pd").replace("OVER ()", "OVER (PARTITION BY vintage)").replace("(ORDER BY pd", "(PARTITION BY vintage ORDER BY pd") + " SELECT vintage, round(max(abs(cp / nullif(p, 0) - cn / nullif(n, 0))), 6) + 0.0 AS ks FROM c GROUP BY vintage")
def wn21_ks_by_vintage(spark, sf_dir):
    return r6(metrics.rank_metrics(scored_table(spark, sf_dir), "vintage").select("vintage", "ks"))


_SPLIT = "CASE WHEN vintage <= 1995 THEN 'train' WHEN vintage = 1996 THEN 'test' ELSE 'oot' END"
_EDGES = [0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
_SHARES = (0.01, 0.05, 0.1, 0.2)


def _rows(table: str, source: str, row: str, **values: str) -> str:
    """Long rows of a table of the suite."""
    return f"SELECT '{table}' AS \"table\", split, {row}::DOUBLE AS \"row\", unnest({list(values)}) AS metric, unnest([{', '.join(f'({v})::DOUBLE' for v in values.values())}]) AS value FROM {source}"


def _suite_sql(scores: str, threshold: float, grid: str) -> str:
    """All tables of the suite but the curve, from scores (split, label, pd) by their definitions over rows."""
    cells = "count(*) FILTER (WHERE pd >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE pd >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE pd < {t} AND label = 1) AS fn, count(*) FILTER (WHERE pd < {t} AND label = 0) AS tn"
    safe = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    rates = {"tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "accuracy": safe("(tp + tn)", "(tp + fp + fn + tn)"), "precision": safe("tp", "(tp + fp)"), "recall": safe("tp", "(tp + fn)"), "f1": safe("2 * tp", "(2 * tp + fp + fn)"), "specificity": safe("tn", "(tn + fp)")}
    errors = {"flagged": "tp + fp", "flagged_share": safe("(tp + fp)", "(tp + fp + fn + tn)"), "event_capture_rate": safe("tp", "(tp + fn)"), "false_negative_rate": safe("fn", "(tp + fn)"), "false_positive_rate": safe("fp", "(fp + tn)")}
    bins = "CASE " + " ".join(f"WHEN pd <= {e} THEN {k}" for k, e in enumerate(_EDGES) if k) + " END"
    p = "greatest(1e-15, least(1 - 1e-15, pd))"
    point = {"observations": "count(*)", "actual_rate": "avg(label)", "mean_pd": "avg(pd)", "observed_expected": "sum(label) / sum(pd)", "log_loss": f"avg(-(label * ln({p}) + (1 - label) * ln(1 - {p})))", "brier": "avg((pd - label) ** 2)"}
    whole = {"roc_auc": "sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n))", "average_precision": "sum(pos * cp / (cp + cn)) / max(p)", "ks": "max(abs(cp / p - cn / n))"}
    parts = ", ".join(str(k / 10) for k in range(11))
    return f"""s AS ({scores}), g AS (SELECT split, pd, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, nullif(sum(pos) OVER (PARTITION BY split), 0) AS p, nullif(sum(neg) OVER (PARTITION BY split), 0) AS n FROM g WINDOW w AS (PARTITION BY split ORDER BY pd DESC ROWS UNBOUNDED PRECEDING)),
e AS (SELECT split, list_distinct(quantile_cont(pd, [{parts}])) AS edges, count(*) AS rows_all, sum(label) AS events_all FROM s GROUP BY split),
d AS (SELECT s.*, rows_all, events_all, greatest(1, len(list_filter(edges, lambda x: x < pd))) AS decile FROM s JOIN e USING (split)),
dd AS (SELECT split, decile, count(*) AS n, sum(label) AS events, avg(pd) AS mean_pd, max(rows_all) AS r, max(events_all) AS a FROM d GROUP BY ALL),
de AS (SELECT *, sum(events) OVER (PARTITION BY split ORDER BY decile) AS up FROM dd),
k AS (SELECT split, {bins} AS bin, count(*) AS n, avg(pd) AS mean_pd, avg(label) AS event_rate, abs(avg(label) - avg(pd)) AS gap FROM s GROUP BY ALL),
f AS (SELECT unnest({list(_SHARES)})::DOUBLE AS share),
t AS (SELECT c.split, share, ceil(round((p + n) * share, 9)) AS population, greatest(0, least(1, (ceil(round((p + n) * share, 9)) - (cp + cn - pos - neg)) / (pos + neg))) AS part, pos, neg, pd, p AS a, p + n AS r FROM c, f),
u AS (SELECT split, share, population, sum(part * pos) AS captured, sum(part * (pos + neg) * pd) / sum(part * (pos + neg)) AS mean_pd, max(a) AS a, max(r) AS r FROM t GROUP BY ALL),
o AS (SELECT split, {cells.format(t=threshold)} FROM s GROUP BY split), h AS (SELECT split, t AS threshold, {cells.format(t="t")} FROM s, ({grid}) GROUP BY ALL),
""" + "m AS (" + " UNION ALL ".join([
        _rows("rank", f"(SELECT split, {', '.join(f'{v} AS {c}' for c, v in whole.items())} FROM c GROUP BY split)", "NULL", **{c: c for c in whole}),
        _rows("point", f"(SELECT split, {', '.join(f'{v} AS {c}' for c, v in point.items())} FROM s GROUP BY split)", "NULL", **{c: c for c in point}),
        _rows("confusion", "o", "NULL", **rates), _rows("thresholds", "h", "threshold", **rates, **errors),
        _rows("deciles", "de", "decile", n="n", events="events", mean_pd="mean_pd", event_rate="events / n", cum_event_share="up / a", lift="events / n / (a / r)"),
        _rows("calibration", "k", "bin", n="n", mean_pd="mean_pd", event_rate="event_rate", gap="gap"),
        _rows("calibration_errors", "(SELECT split, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM k GROUP BY split)", "NULL", ece="ece", mce="mce"),
        _rows("top_shares", "u", "share", population="population", captured="captured", capture_rate="captured / a", precision="captured / population", mean_pd="mean_pd", lift="captured / population / (a / r)"),
    ]) + ")"


def _split(df):
    return df.withColumn("split", F.when(F.col("vintage") <= 1995, "train").when(F.col("vintage") == 1996, "test").otherwise("oot"))


@query("WITH " + _suite_sql(f"SELECT {_SPLIT} AS split, label, pd FROM sc", 0.1, "SELECT round(0.01 + 0.01 * i, 10)::DOUBLE AS t FROM range(29) x(i)") + ' SELECT "table", split, "row", metric, round(value, 6) + 0.0 AS value FROM m')
def ev20_suite_by_split(spark, sf_dir):
    """All tables of three splits, from one read of the scored rows."""
    df = _split(scored(spark, sf_dir)).select("split", "label", "pd")
    tables = suite.suite(df, "split", edges=_EDGES, grid=(0.01, 0.3, 0.01), threshold=0.1, shares=_SHARES)
    return r6(suite.in_long_form({k: v for k, v in tables.items() if k != "curve"}, "split"))


def _job_sql() -> str:
    """The evaluation job by definition: beta calibration on the test split, the threshold with the best F1 of it, all tables of both scores, and the sizes of both curves."""
    grid = "SELECT round(0.01 + 0.01 * i, 10)::DOUBLE AS t FROM range(98) x(i)"
    cells = "count(*) FILTER (WHERE pd >= t AND label = 1) AS tp, count(*) FILTER (WHERE pd >= t AND label = 0) AS fp, count(*) FILTER (WHERE pd < t AND label = 1) AS fn, count(*) FILTER (WHERE pd < t AND label = 0) AS tn"
    rates = {"tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "accuracy": "(tp + tn) / (tp + fp + fn + tn)", "precision": "p", "recall": "r", "f1": "f", "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)", "flagged": "tp + fp", "flagged_share": "(tp + fp) / (tp + fp + fn + tn)",
             "event_capture_rate": "r", "false_negative_rate": "coalesce(fn / nullif(tp + fn, 0), 0)", "false_positive_rate": "coalesce(fp / nullif(fp + tn, 0), 0)"}
    suites, curves = [], []
    for kind, scores in (("raw", "sp"), ("calibrated", "cal")):
        suites.append(f"""SELECT '{kind}_' || "table" AS "table", split, "row", metric, value FROM (WITH {_suite_sql(f'SELECT split, label, pd FROM {scores}', '(SELECT t FROM best)', grid)} SELECT * FROM m)""")
        g = f"""(SELECT split, count(*) AS points, max(cp / p - cn / n) AS largest_gap FROM (SELECT split, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS n
        FROM (SELECT split, pd, sum(label) AS pos, count(*) - sum(label) AS neg FROM {scores} GROUP BY ALL) WINDOW w AS (PARTITION BY split ORDER BY pd DESC ROWS UNBOUNDED PRECEDING)) GROUP BY split)"""
        curves.append(_rows(f"{kind}_curve", g, "NULL", points="points", largest_gap="largest_gap"))
    chosen = _rows("threshold", "(SELECT NULL::VARCHAR AS split, * FROM best)", "NULL", threshold="t", **rates)
    return f"""WITH RECURSIVE sp AS (SELECT {_SPLIT} AS split, label, pd FROM sc), {named_newton('beta', 'beta', "(SELECT pd, label FROM sp WHERE split = 'test')")},
cal AS (SELECT split, label, {applied_sql('beta', 'beta')} AS pd FROM sp, (SELECT * FROM w_beta ORDER BY k DESC LIMIT 1)),
best AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM (SELECT t, {cells} FROM cal, ({grid}) WHERE split = 'test' GROUP BY t) ORDER BY f DESC, p DESC, r DESC, t LIMIT 1)
SELECT "table", split, "row", metric, round(value, 6) + 0.0 AS value FROM ({' UNION ALL '.join([*suites, *curves, chosen])})"""


@query(_job_sql())
def ev21_snk3_evaluation_job(spark, sf_dir):
    """The tables of the evaluation job, saved and read again: small ones in long form, and the points of both curves summed up."""
    path = scratch_path(spark, "evaluation")
    jobs.save_tables(jobs.evaluate(stored(_split(scored(spark, sf_dir)).select("split", "label", "pd"), "splits"), _EDGES), path)
    small = spark.read.schema("table string, split string, row double, metric string, value double").json(f"{path}/tables")
    for name in ("raw_curve", "calibrated_curve"):
        curve = spark.read.parquet(f"{path}/{name}").groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("points"), F.max("gap").alias("largest_gap"))
        long = curve.select(F.lit(name).alias("table"), "split", F.lit(None).cast("double").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("points", "largest_gap")])).alias("m"))
        small = small.unionByName(long.select("table", "split", "row", "m.metric", "m.value"))
    return r6(small)


def _input(spark, sf_dir):
    df = feature_table(spark, sf_dir, *KEY, "vintage", F.col("future_90dpd").cast("double").alias("label"), *NUM, *CAT)
    return df, df.where("vintage <= 1996"), df.where("vintage > 1996")


@query()
def im1_tree_importance(spark, sf_dir):
    df, fit, _ = _input(spark, sf_dir)
    return ml.tree_importance(ml.train(ml.forest_pipeline(NUM, CAT), fit), df)


@query()
def im2_permutation_importance(spark, sf_dir):
    _, fit, test = _input(spark, sf_dir)
    return ml.permutation_importance(ml.train(ml.linear_pipeline(NUM, CAT), fit), test, KEY, [*NUM, *CAT], repeats=5)


@query()
def im3_ablation(spark, sf_dir):
    _, fit, test = _input(spark, sf_dir)
    return ml.ablation(ml.linear_pipeline, NUM, CAT, {"score": ["credit_score"], "delinquency": ["delinquency_months_12m"], "categories": CAT}, fit, test)


_BETA = {"credit_score": -0.004, "original_ltv": 0.02, "delinquency_months_12m": 0.3}
_DIFF = " UNION ALL ".join(f"SELECT loan_id, observation_age, '{c}' AS feature, {b} * (coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM mi)) + {b / 2} * (({c} IS NULL)::INT - (SELECT avg(({c} IS NULL)::INT) FROM mi)) AS contribution FROM mi" for c, b in _BETA.items())


def _given(spark, sf_dir):
    """Contributions under given coefficients: each feature is two entries, its value and whether it is missing."""
    df = feature_table(spark, sf_dir, *KEY, *_BETA)
    x = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in _BETA], *[F.col(c).isNull().cast("double") for c in _BETA])
    return ml.contribution_rows(x, df, KEY, [*_BETA, *_BETA], [*_BETA.values(), *[b / 2 for b in _BETA.values()]])


@query(f"SELECT loan_id, observation_age, feature, round(contribution, 6) + 0.0 AS contribution FROM ({_DIFF})")
def im4_contribution_rows(spark, sf_dir):
    return r6(_given(spark, sf_dir))


@query(f"""WITH c AS ({_DIFF}), s AS (SELECT feature, avg(abs(contribution)) AS a, avg(contribution) AS m FROM c GROUP BY feature)
SELECT feature, CASE WHEN feature LIKE '%delinq%' THEN 'delinquency' ELSE 'origination' END AS feature_group, round(a, 6) AS mean_abs, round(m, 6) + 0.0 AS mean, row_number() OVER (ORDER BY a DESC, feature)::INT AS position,
round(a / sum(a) OVER (), 6) AS share, round(sum(a) OVER (ORDER BY a DESC, feature) / sum(a) OVER (), 6) AS cum_share FROM s""")
def im4_contribution_summary(spark, sf_dir):
    return r6(ml.contribution_summary(_given(spark, sf_dir)))


@query()
def im4_contributions(spark, sf_dir):
    df, fit, _ = _input(spark, sf_dir)
    return ml.contributions(ml.train(ml.linear_pipeline(NUM, CAT), fit), df)


@query()
def ml8_boosted_trees(spark, sf_dir):
    """Trees stop when the rows of the vintage before the last training one no longer gain."""
    df, fit, _ = _input(spark, sf_dir)
    pipeline = ml.boosted_pipeline(NUM, CAT, validation="_later", rounds=20)
    model = ml.train(pipeline, fit.withColumn("_later", F.col("vintage") == 1996))
    return ml.score(model, df).select(*KEY, "label", "pd")


@query()
def ml14_ml17_ml19_saved_contract(spark, sf_dir):
    """Inputs are checked, frozen with the fit, saved beside the model, and checked again when it is loaded to score."""
    df, fit, _ = _input(spark, sf_dir)
    ml.check_features(df, NUM, CAT)
    path = scratch_path(spark, "model")
    ml.save_model(ml.train(ml.gam_pipeline(NUM, CAT), fit), path)
    model, columns = ml.load_model(path, df)
    return ml.score(model, df.select(*KEY, "label", *columns)).select(*KEY, "label", "pd")


@query("SELECT loan_id, observation_age, label, pd, (pd >= 0.2)::INT AS predicted FROM sc WHERE vintage > 1996")
def sc6_predictions(spark, sf_dir):
    return scored_table(spark, sf_dir).where("vintage > 1996").select(*KEY, "label", "pd", (F.col("pd") >= 0.2).cast("int").alias("predicted"))


@query("""SELECT vintage, period, count(*) AS n, count(*) FILTER (WHERE pd >= 0.1) AS flagged, max(r) AS last_rank, sum(r * (loan_id % 97))::BIGINT AS rank_sum
FROM (SELECT *, CASE WHEN pd >= 0.1 THEN row_number() OVER (PARTITION BY period, pd >= 0.1 ORDER BY pd DESC, current_actual_upb DESC, loan_id) END AS r FROM sc) GROUP BY ALL""")
def sc4_interventions_by_vintage(spark, sf_dir):
    from panelrisk.sources import files

    path = scratch_path(spark, "interventions")
    files.write_partitioned(jobs.intervene(scored_table(spark, sf_dir), 0.1), path)
    rank = F.col("intervention_rank").cast("long")
    return spark.read.parquet(path).groupBy("vintage", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("intervention_flag").cast("long").alias("flagged"), F.max(rank).alias("last_rank"), F.sum(rank * (F.col("loan_id") % 97)).alias("rank_sum"),
    )


_VINTAGES = {"train": [1992, 1993, 1994, 1995], "test": [1996], "oot": [1997, 1998]}


@query("""SELECT CASE WHEN vintage <= 1995 THEN 'train' WHEN vintage = 1996 THEN 'test' ELSE 'oot' END AS split, count(*) AS n, sum(future_90dpd)::BIGINT AS events, count(*) AS scored, count(*) AS equal_scores
FROM mi WHERE vintage BETWEEN 1992 AND 1998 GROUP BY 1""")
def ml9_ml18_ml20_training_job(spark, sf_dir):
    """The input is built and written, a model fitted on its train vintages and saved, then loaded to score every split as the fitted one does."""
    from panelrisk.operators import splits

    source, target = scratch_path(spark, "model-input"), scratch_path(spark, "model")
    jobs.build_model_input(perf(spark, sf_dir, last_age=max(pit.AGES) + pit.HORIZON), orig(spark, sf_dir), source)
    fitted = jobs.train(spark, source, target, ml.linear_pipeline(NUM, CAT), _VINTAGES)
    df = splits.yearly(spark.read.parquet(source), **_VINTAGES)
    model, columns = ml.load_model(target, df)
    rows = ml.score(fitted, ml.score(model, df.select("split", "future_90dpd", *columns)), "own")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("future_90dpd").cast("long").alias("events"), F.count_if(F.col("pd").between(0, 1)).alias("scored"), F.count_if(F.col("pd") == F.col("own")).alias("equal_scores"))


@query("""SELECT v AS version, (SELECT count(*) FROM mi WHERE vintage <= y) AS train_rows, (SELECT sum(future_90dpd)::BIGINT FROM mi WHERE vintage <= y) AS train_events, count(*) AS scored, count(*) AS equal_scores FROM mi, (VALUES ('a', 1995), ('b', 1996)) t(v, y) GROUP BY v, y""")
def ml18_two_versions(spark, sf_dir):
    """Two versions are saved with their training populations, one more is cut off before its manifest; each complete one scores as it did when it was fitted."""
    df, root, out = _input(spark, sf_dir)[0], scratch_path(spark, "models"), None
    for version, last in (("a", 1995), ("b", 1996)):
        fit = df.where(F.col("vintage") <= last)
        fitted = ml.train(ml.linear_pipeline(NUM, CAT), fit)
        registry.save_version(fitted, root, version, {"train": registry.population(fit)}, {"pipeline": "linear", "last": last})
        fitted.write().overwrite().save(f"{root}/{version}-cut/model")
        model, manifest = registry.load_version(spark, root, version, df.columns)
        rows = ml.score(fitted, ml.score(model, df), "own").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("pd") == F.col("own")).alias("equal_scores"))
        row = rows.select(F.lit(version).alias("version"), F.lit(int(manifest["metadata"]["train"]["rows"])).cast("long").alias("train_rows"), F.lit(int(manifest["metadata"]["train"]["events"])).cast("long").alias("train_events"), "*")
        out = row if out is None else out.unionByName(row)
    return out.where(F.col("version").isin([r["version"] for r in registry.versions(spark, root).collect()]))


@query("SELECT unnest(['credit_score', 'original_ltv', 'property_state', 'original_ltv x property_state', 'credit_score x original_ltv']) AS feature, unnest([1, 3, (SELECT count(DISTINCT coalesce(property_state, 'Unknown')) + 1 FROM mi WHERE vintage <= 1996), 3 * (SELECT count(DISTINCT coalesce(property_state, 'Unknown')) + 1 FROM mi WHERE vintage <= 1996), 3]) AS entries")
def prj22_raw_names(spark, sf_dir):
    """The entries of a GAM's features by the raw columns that they come from, with names that hold others and the mark of a product."""
    df = feature_table(spark, sf_dir, "vintage", "credit_score", "original_ltv", "property_state", F.lit(1.0).alias("original_ltv_x_property"), F.col("future_90dpd").cast("double").alias("label"))
    pipeline = ml.gam_pipeline(["credit_score", "original_ltv"], ["property_state"], pairs=[("original_ltv", "property_state"), ("credit_score", "original_ltv")], linear=["credit_score"])
    stages = [s if not isinstance(s, ml.Splines) else ml.Splines(inputCols=["original_ltv_filled"], numKnots=3, degree=1) for s in pipeline.getStages()[:-1]]
    model = ml.Pipeline(stages=stages).fit(df.where("vintage <= 1996"))
    names = ml.raw_names(model, df)
    return spark.createDataFrame([(f, names.count(f)) for f in dict.fromkeys(names)], "feature string, entries long")

@query("SELECT loan_id, observation_age, mi.vintage, credit_score, pd FROM mi LEFT JOIN (SELECT loan_id, observation_age, pd FROM sc WHERE sc.vintage > 1994) USING (loan_id, observation_age)")
def jn7_scores_joined_back(spark, sf_dir):
    """A written score table joined to the population by key; rows that were not scored keep a null."""
    scores = scored_table(spark, sf_dir).where("vintage > 1994").select(*KEY, "pd")
    return feature_table(spark, sf_dir, *KEY, "vintage", "credit_score").join(scores, KEY, "left")
