"""Queries on learned transforms, models and calibration. Fits have no SQL; their fixed halves do."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, isotonic, metrics, ml, pit
from panelrisk.operators.interactions import Interactions
from panelrisk.queries.base import feature_table, features, query, scored, scored_table
from panelrisk.sources.scratch import stored

NUM, CAT = ["credit_score", "original_ltv", "delinquency_months_12m", "current_actual_upb"], ["occupancy_status", "property_state"]


def _input(spark, sf_dir):
    """The inputs of a model, written once: a fit reads them for its checks, medians, categories and rows, and scoring once more."""
    return feature_table(spark, sf_dir, "loan_id", "observation_age", "vintage", F.col("future_90dpd").cast("double").alias("label"), *NUM, *CAT)


def _fit(spark, sf_dir, pipeline):
    df = _input(spark, sf_dir)
    return df, ml.train(pipeline, df.where("vintage <= 1996"))


def _scores(spark, sf_dir, pipeline):
    df, model = _fit(spark, sf_dir, pipeline)
    return ml.score(model, df).select("loan_id", "observation_age", "label", "pd")


@query()
def ml6_sc1_logistic(spark, sf_dir):
    """Probabilities named by their horizon."""
    df, model = _fit(spark, sf_dir, ml.linear_pipeline(NUM, CAT))
    name = ml.horizon_name(pit.HORIZON)
    return ml.score(model, df, name).select("loan_id", "observation_age", "label", name)


@query()
def ml7_random_forest(spark, sf_dir):
    return _scores(spark, sf_dir, ml.forest_pipeline(NUM, CAT))


@query()
def ml15_gam(spark, sf_dir):
    return _scores(spark, sf_dir, ml.gam_pipeline(NUM, CAT, pairs=[("credit_score", "original_ltv"), ("credit_score", "occupancy_status")]))


@query()
def ml13_group_gam(spark, sf_dir):
    return _scores(spark, sf_dir, ml.gam_pipeline(NUM[:2], CAT, group="property_state"))


@query("SELECT loan_id, observation_age, CASE WHEN future_90dpd = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM mi")
def ml16_class_weights(spark, sf_dir):
    return ml.class_weights(features(spark, sf_dir), "future_90dpd", 10.0, 1.0).select("loan_id", "observation_age", "weight")


@query("""WITH x AS (SELECT loan_id, observation_age, greatest(50.0, least(104.0, original_ltv)) AS v FROM mi)
SELECT loan_id, observation_age, round(CASE WHEN v < 75 THEN (75 - v) / 25 ELSE 0 END, 6) AS b0, round(CASE WHEN v < 75 THEN (v - 50) / 25 ELSE (104 - v) / 29 END, 6) AS b1, round(CASE WHEN v < 75 THEN 0 ELSE (v - 75) / 29 END, 6) AS b2 FROM x""")
def ml11_spline_basis(spark, sf_dir):
    b = ml.basis(F.col("original_ltv"), [50.0, 75.0, 104.0], degree=1)
    return features(spark, sf_dir).select("loan_id", "observation_age", *[F.round(b[k], 6).alias(f"b{k}") for k in range(3)])


_TRAIN = "SELECT * FROM mi WHERE vintage <= 1996"
_LEVELS = f"""lv AS (SELECT coalesce(property_state, 'Unknown') AS level, row_number() OVER (ORDER BY count(*) DESC, coalesce(property_state, 'Unknown')) - 1 AS k FROM ({_TRAIN}) GROUP BY 1), nl AS (SELECT count(*) AS n FROM lv)"""


def _encoded(spark, sf_dir, numeric, categories):
    """The panel with inputs prepared by stages fitted on the training vintages."""
    df = feature_table(spark, sf_dir, "loan_id", "observation_age", "vintage", *numeric, *categories)
    return ml.preprocessor(numeric, categories).fit(df.where("vintage <= 1996")).transform(df)


@query(f"""WITH {_LEVELS}, md AS (SELECT quantile_disc(original_dti, 0.5) AS dti, quantile_disc(original_ltv, 0.5) AS ltv FROM ({_TRAIN}))
SELECT loan_id, observation_age, coalesce(original_dti, dti)::DOUBLE AS dti_filled, 2 + n + 1 AS width, (coalesce(original_dti, dti) + coalesce(original_ltv, ltv) + 1)::DOUBLE AS total FROM mi, md, nl""")
def ml1_ml4_ml5_imputed_and_assembled(spark, sf_dir):
    df = _encoded(spark, sf_dir, ["original_dti", "original_ltv"], ["property_state"])
    v = vector_to_array("features")
    return df.select("loan_id", "observation_age", F.col("original_dti_filled").cast("double").alias("dti_filled"), F.size(v).cast("long").alias("width"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {_LEVELS} SELECT loan_id, observation_age, coalesce(k, n)::DOUBLE AS state_index, coalesce(k, n)::BIGINT + 1 AS hot_slot, n + 1 AS slots FROM mi CROSS JOIN nl LEFT JOIN lv ON level = coalesce(property_state, 'Unknown')""")
def ml2_ml3_category_slots(spark, sf_dir):
    df = _encoded(spark, sf_dir, ["original_ltv"], ["property_state"])
    hot = vector_to_array("property_state_hot")
    return df.select("loan_id", "observation_age", F.col("property_state_index").alias("state_index"), F.array_position(hot, 1.0).alias("hot_slot"), F.size(hot).cast("long").alias("slots"))


@query(f"""WITH q AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q), v AS (SELECT 'original_ltv' AS feature, original_ltv::DOUBLE AS x FROM ({_TRAIN}) UNION ALL SELECT 'delinquency_months_12m', delinquency_months_12m::DOUBLE FROM ({_TRAIN}) UNION ALL SELECT 'max_dpd_3m', max_dpd_3m::DOUBLE FROM ({_TRAIN})),
r AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS r, count(*) OVER (PARTITION BY feature) AS n FROM v WHERE x IS NOT NULL),
k AS (SELECT DISTINCT feature, x AS knot FROM r, q WHERE r = greatest(1, ceil(round(q * n, 6))))
SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY knot) - 1 AS k, knot, CASE WHEN count(*) OVER (PARTITION BY feature) > 2 THEN 'spline' ELSE 'linear' END AS kind, CASE WHEN count(*) OVER (PARTITION BY feature) <= 2 THEN 'fewer than three different quantiles' END AS reason FROM k""")
def ml10_spline_knots(spark, sf_dir):
    columns = ["original_ltv", "delinquency_months_12m", "max_dpd_3m"]
    model = ml.Splines(inputCols=columns).fit(feature_table(spark, sf_dir, "vintage", *columns).where("vintage <= 1996"))
    knots = model.getOrDefault(model.knots)
    reasons = model.getOrDefault(model.reasons)
    rows = [(c, k, x, "linear" if c in reasons else "spline", reasons.get(c)) for c, own in knots.items() for k, x in enumerate(own)]
    return spark.createDataFrame(rows, "feature string, k long, knot double, kind string, reason string")


@query(f"""WITH {_LEVELS}, x AS (SELECT loan_id, observation_age, coalesce(k, n) AS slot, n + 1 AS slots, greatest(50.0, least(104.0, original_ltv)) AS v FROM mi CROSS JOIN nl LEFT JOIN lv ON level = coalesce(property_state, 'Unknown') WHERE original_ltv IS NOT NULL)
SELECT loan_id, observation_age, 3 * slots AS width, round((CASE WHEN v < 75 THEN (75 - v) / 25 ELSE 0 END) * (slot + 1) + (CASE WHEN v < 75 THEN (v - 50) / 25 ELSE (104 - v) / 29 END) * (slots + slot + 1) + (CASE WHEN v < 75 THEN 0 ELSE (v - 75) / 29 END) * (2 * slots + slot + 1), 5) AS moment FROM x""")
def ml12_spline_by_category(spark, sf_dir):
    """The products of a spline and a category's indicators, as their number and the sum of each times its place."""
    df = _encoded(spark, sf_dir, ["original_ltv"], ["property_state"]).where("original_ltv IS NOT NULL").withColumn("ltv_basis", array_to_vector(ml.basis(F.col("original_ltv"), [50.0, 75.0, 104.0], degree=1)))
    v = vector_to_array("crossed")
    crossed = ml.Crossed(inputCols=["ltv_basis", "property_state_hot"], outputCol="crossed").transform(df)
    placed = F.aggregate(F.transform(v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return crossed.select("loan_id", "observation_age", F.size(v).cast("long").alias("width"), F.round(placed, 5).alias("moment"))


_BASES = """x AS (SELECT loan_id, observation_age, vintage, original_ltv::DOUBLE AS l, delinquency_months_12m::DOUBLE AS d, coalesce(property_state, 'Unknown') AS level, greatest(50.0, least(104.0, original_ltv)) AS v, greatest(0.0, least(12.0, delinquency_months_12m)) AS u FROM mi),
f AS (SELECT loan_id, observation_age, vintage, l, d, level, [CASE WHEN v < 75 THEN (75 - v) / 25 ELSE 0 END, CASE WHEN v < 75 THEN (v - 50) / 25 ELSE (104 - v) / 29 END, CASE WHEN v < 75 THEN 0 ELSE (v - 75) / 29 END]::DOUBLE[] AS b,
  [CASE WHEN u < 2 THEN (2 - u) / 2 ELSE 0 END, CASE WHEN u < 2 THEN u / 2 ELSE (12 - u) / 10 END, CASE WHEN u < 2 THEN 0 ELSE (u - 2) / 10 END]::DOUBLE[] AS t FROM x),
m AS (SELECT avg(l) AS l, avg(d) AS d, [avg(b[1]), avg(b[2]), avg(b[3])] AS b, [avg(t[1]), avg(t[2]), avg(t[3])] AS t FROM f WHERE vintage <= 1996),
c AS (SELECT loan_id, observation_age, level, f.l - m.l AS l, f.d - m.d AS d, [f.b[1] - m.b[1], f.b[2] - m.b[2], f.b[3] - m.b[3]] AS b, [f.t[1] - m.t[1], f.t[2] - m.t[2], f.t[3] - m.t[3]] AS t FROM f, m)"""


@query(f"""WITH {_LEVELS}, {_BASES}
SELECT loan_id, observation_age, round(l * d, 5) + 0.0 AS linear_linear, round(d * (b[1] + 2 * b[2] + 3 * b[3]), 5) + 0.0 AS spline_linear,
round(b[1] * (t[1] + 2 * t[2] + 3 * t[3]) + b[2] * (4 * t[1] + 5 * t[2] + 6 * t[3]) + b[3] * (7 * t[1] + 8 * t[2] + 9 * t[3]), 5) + 0.0 AS spline_spline, round(l * (coalesce(k, n) + 1), 5) + 0.0 AS linear_category,
[1, 3, 9, n + 1]::BIGINT[]::VARCHAR AS widths FROM c CROSS JOIN nl LEFT JOIN lv USING (level)""")
def ml12_centred_interactions(spark, sf_dir):
    """Products of centred factors of each kind, as the sum of each times its place; all vintages are scored with the means of the training ones."""
    df = stored(features(spark, sf_dir).select("loan_id", "observation_age", "vintage", "original_ltv", "delinquency_months_12m", "property_state"), "interactions")
    fit = df.where("vintage <= 1996")
    shown = lambda d: ml.preprocessor(["original_ltv", "delinquency_months_12m"], ["property_state"]).fit(fit).transform(d).withColumns({
        "ltv_basis": array_to_vector(ml.basis(F.col("original_ltv"), [50.0, 75.0, 104.0], degree=1)), "dq_basis": array_to_vector(ml.basis(F.col("delinquency_months_12m"), [0.0, 2.0, 12.0], degree=1)),
    })
    pairs = {"linear_linear": ("original_ltv_filled", "delinquency_months_12m_filled"), "spline_linear": ("ltv_basis", "delinquency_months_12m_filled"), "spline_spline": ("ltv_basis", "dq_basis"), "linear_category": ("original_ltv_filled", "property_state_hot")}
    model = Interactions(pairs=[list(p) for p in pairs.values()], outputCols=list(pairs), plain=["property_state_hot"]).fit(shown(fit))
    out = model.transform(shown(df))
    moment = lambda c: F.round(F.aggregate(F.transform(vector_to_array(c), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 5) + 0.0
    widths = F.concat(F.lit("["), F.concat_ws(", ", *[F.size(vector_to_array(c)).cast("string") for c in pairs]), F.lit("]"))
    return out.select("loan_id", "observation_age", *[moment(c).alias(c) for c in pairs], widths.alias("widths"))


def _calibrated(df):
    return metrics.point_metrics(df.withColumn("pd", F.col("calibrated")))


#: Isotonic values by the min-max formula: of all runs of scores around a score, the greatest over starts of the least mean over ends.
_ISOTONIC = """WITH g AS (SELECT pd, count(*) AS n, sum(label) AS s FROM sc WHERE vintage <= 1996 GROUP BY pd),
k AS (SELECT pd, n, s, row_number() OVER (ORDER BY pd) AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM g WINDOW w AS (ORDER BY pd ROWS UNBOUNDED PRECEDING)),
a AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM k a JOIN k b ON b.i >= a.i),
l AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM a), y AS (SELECT k.pd, max(least) AS y FROM l JOIN k ON k.i = l.b GROUP BY k.pd),
o AS (SELECT loan_id, observation_age, label, sc.pd, p.pd AS x0, p.y AS y0, q.pd AS x1, q.y AS y1 FROM sc ASOF LEFT JOIN y p ON sc.pd >= p.pd ASOF LEFT JOIN y q ON sc.pd <= q.pd),
i AS (SELECT loan_id, observation_age, label, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (pd - x0) / (x1 - x0) * (y1 - y0) END AS pd FROM o)"""
_POINT_OF_I = """count(*) AS observations, round(avg(label), 6) + 0.0 AS actual_rate, round(avg(pd), 6) + 0.0 AS mean_pd, round(sum(label) / sum(pd), 6) + 0.0 AS observed_expected,
round(avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, pd))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, pd))))), 6) + 0.0 AS log_loss, round(avg((pd - label) ** 2), 6) + 0.0 AS brier"""


@query(_ISOTONIC + " SELECT loan_id, observation_age, round(pd, 6) + 0.0 AS calibrated FROM i")
def ev12_isotonic_rows(spark, sf_dir):
    df = stored(scored(spark, sf_dir), "scored")
    return isotonic.isotonic(df.where("vintage <= 1996"), df).select("loan_id", "observation_age", (F.round("calibrated", 6) + 0.0).alias("calibrated"))


@query(_ISOTONIC + f" SELECT {_POINT_OF_I} FROM i")
def ev12_isotonic(spark, sf_dir):
    df = stored(scored(spark, sf_dir), "scored")
    return _rounded_point(isotonic.isotonic(df.where("vintage <= 1996"), df))


_CLIP = "least(greatest(pd, 1e-6), 1 - 1e-6)"


def newton_sql(terms: list[str], source: str, rounds: int = 30) -> str:
    """Tables f (x1.., n, e) and w (round k, weights b0..) of Newton's method for a logistic fit of up to two terms, by Cramer's rule; the last round holds the fit."""
    m = len(terms) + 1
    x = ["1", *[f"x{i}" for i in range(1, m)]]
    z = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    sums = [f"sum((e - n * q) * {v}) AS g{i}" for i, v in enumerate(x)] + [f"sum(n * q * (1 - q) * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(m) for j in range(i, m)]
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"

    def det(cell) -> str:
        if m == 2:
            return f"({cell(0, 0)} * {cell(1, 1)} - {cell(0, 1)} * {cell(1, 0)})"
        minor = lambda j: " ".join(["(", cell(1, (j + 1) % 3), "*", cell(2, (j + 2) % 3), "-", cell(1, (j + 2) % 3), "*", cell(2, (j + 1) % 3), ")"])
        return "(" + " + ".join(f"{cell(0, j)} * {minor(j)}" for j in range(3)) + ")"

    steps = ", ".join(f"b{k} + greatest(-5, least(5, {det(lambda i, j, k=k: f'g{i}' if j == k else h(i, j))} / {det(h)}))" for k in range(m))
    b = ", ".join(f"b{k}" for k in range(m))
    return f"""f AS (SELECT {', '.join(f'{t} AS x{i + 1}' for i, t in enumerate(terms))}, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS e FROM {source} GROUP BY ALL),
w(k, {b}) AS (SELECT 0, {', '.join(['0.0::DOUBLE'] * m)} UNION ALL SELECT k + 1, {steps} FROM (SELECT k, {b}, {', '.join(sums)} FROM (SELECT w.*, f.*, 1 / (1 + exp(-({z}))) AS q FROM w, f WHERE k < {rounds}) GROUP BY ALL))"""


_TERMS = {"platt": [f"ln({_CLIP} / (1 - {_CLIP}))"], "beta": [f"ln({_CLIP})", f"ln(1 - {_CLIP})"]}


def named_newton(name: str, method: str, source: str) -> str:
    """newton_sql with tables f_<name> and w_<name>."""
    sql = newton_sql(_TERMS[method], source)
    return sql.replace("f AS (", f"f_{name} AS (", 1).replace("FROM w, f WHERE", f"FROM w_{name} w, f_{name} f WHERE").replace("\nw(k", f"\nw_{name}(k")


def applied_sql(name: str, method: str) -> str:
    """The calibrated score as a scalar over pd and the last row of w_<name>, which joins as (SELECT * FROM w_<name> ORDER BY k DESC LIMIT 1)."""
    z = " + ".join(["b0", *[f"b{k + 1} * {t}" for k, t in enumerate(_TERMS[method])]])
    return f"1 / (1 + exp(-({z})))"


def _fit_sql(method: str) -> str:
    terms = _TERMS[method]
    z = " + ".join(["b0", *[f"b{k + 1} * {t}" for k, t in enumerate(terms)]])
    return f"""WITH RECURSIVE {newton_sql(terms, '(SELECT pd, label FROM sc WHERE vintage <= 1996)')}, i AS (SELECT loan_id, observation_age, label, 1 / (1 + exp(-({z}))) AS pd FROM sc, w WHERE k = (SELECT max(k) FROM w))"""


_TWO = ["original_ltv::DOUBLE", "delinquency_months_12m::DOUBLE"]


@query(f"""WITH RECURSIVE {newton_sql(_TWO, '(SELECT original_ltv, delinquency_months_12m, future_90dpd AS label FROM mi WHERE vintage <= 1996)')}
SELECT loan_id, observation_age, future_90dpd AS label, round(1 / (1 + exp(-(b0 + b1 * original_ltv + b2 * delinquency_months_12m))), 5) + 0.0 AS pd_3m FROM mi, (SELECT * FROM w ORDER BY k DESC LIMIT 1)""")
def ml6_sc1_two_inputs(spark, sf_dir):
    """A logistic regression without ridge is the maximum of the likelihood, which SQL finds by Newton's method; scores are named by their horizon."""
    df = stored(features(spark, sf_dir).select("loan_id", "observation_age", "vintage", F.col("future_90dpd").cast("double").alias("label"), "original_ltv", "delinquency_months_12m"), "two-inputs")
    model = ml.train(ml.linear_pipeline(["original_ltv", "delinquency_months_12m"], [], ridge=0.0, tolerance=1e-13, rounds=500), df.where("vintage <= 1996"))
    name = ml.horizon_name(pit.HORIZON)
    return ml.score(model, df, name).select("loan_id", "observation_age", F.col("label").cast("int").alias("label"), (F.round(name, 5) + 0.0).alias(name))


def _rounded_point(df):
    point = _calibrated(df)
    return point.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in point.dtypes])


@query(_fit_sql("platt") + f" SELECT {_POINT_OF_I} FROM i")
def ev13_platt(spark, sf_dir):
    df = stored(scored(spark, sf_dir), "scored")
    return _rounded_point(calibrate.logistic_calibration(df.where("vintage <= 1996"), df, "platt"))


@query(_fit_sql("beta") + f" SELECT {_POINT_OF_I} FROM i")
def ev14_beta(spark, sf_dir):
    df = stored(scored(spark, sf_dir), "scored")
    return _rounded_point(calibrate.logistic_calibration(df.where("vintage <= 1996"), df, "beta"))


@query(_fit_sql("beta") + " SELECT loan_id, observation_age, round(pd, 6) + 0.0 AS calibrated FROM i")
def ev14_beta_rows(spark, sf_dir):
    df = stored(scored(spark, sf_dir), "scored")
    return calibrate.logistic_calibration(df.where("vintage <= 1996"), df, "beta").select("loan_id", "observation_age", (F.round("calibrated", 6) + 0.0).alias("calibrated"))


@query("""WITH r AS (SELECT avg(label) AS r, avg(least(greatest(pd, 1e-6), 1 - 1e-6)) AS m FROM sc WHERE vintage <= 1996), o AS (SELECT loan_id, observation_age, p / (1 - p) * (r / (1 - r)) / (m / (1 - m)) AS o FROM (SELECT *, least(greatest(pd, 1e-6), 1 - 1e-6) AS p FROM sc), r)
SELECT loan_id, observation_age, round(o / (1 + o), 6) AS calibrated FROM o""")
def ev15_intercept(spark, sf_dir):
    df = scored_table(spark, sf_dir)
    return calibrate.intercept_calibration(df.where("vintage <= 1996"), df).select("loan_id", "observation_age", F.round("calibrated", 6).alias("calibrated"))
