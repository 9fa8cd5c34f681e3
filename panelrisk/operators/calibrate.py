"""Calibration of probabilities on frames with label and pd."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import isotonic
from panelrisk.sources.scratch import stored

EPS = 1e-6


def _clipped():
    return F.least(F.greatest("pd", F.lit(EPS)), F.lit(1 - EPS))


def _terms(method: str) -> list[Column]:
    """What the logit of a calibrated score is linear in: the logit (platt), or ln p and ln (1 - p) (beta)."""
    p = _clipped()
    return {"platt": [F.log(p / (1 - p))], "beta": [F.log(p), F.log(1 - p)]}[method]


def logistic_fit(fit: DataFrame, method: str, rounds: int = 50) -> list[float]:
    """Intercept and slopes of the logistic fit of the label on the terms of pd, by Newton's method to the last digits.

    Rows are summed up by pd once; each round is one aggregate of at most nine sums over these. A fit of one class, or of one pd,
    has no finite optimum: rounds end where the curvature does.
    """
    terms = _terms(method)
    counts = stored(fit.where("pd IS NOT NULL AND label IS NOT NULL").groupBy("pd").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("e")), "score-counts")
    x = [F.lit(1.0), *terms]
    at = np.zeros(len(x))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-sum((F.lit(float(w)) * v for w, v in zip(at, x, strict=True)), F.lit(0.0))))
        off, weight = F.col("e") - F.col("n") * q, F.col("n") * q * (1 - q)
        row = counts.agg(*[F.sum(off * v).alias(f"g{i}") for i, v in enumerate(x)], *[F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if row["g0"] is None:
            break
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        if np.linalg.cond(h) > 1e14:
            break
        step = np.linalg.solve(h, [row[f"g{i}"] for i in range(len(x))])
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-11:
            break
    return [float(v) for v in at]


def _applied(weights: list[float], df: DataFrame, method: str) -> DataFrame:
    z = sum((F.lit(w) * v for w, v in zip(weights[1:], _terms(method), strict=True)), F.lit(weights[0]))
    return df.withColumn("calibrated", 1 / (1 + F.exp(-z)))


def logistic_calibration(fit: DataFrame, df: DataFrame, method: str) -> DataFrame:
    """df with calibrated, by logistic_fit on fit."""
    return _applied(logistic_fit(fit, method), df, method)


def isotonic_calibration(fit: DataFrame, df: DataFrame) -> DataFrame:
    """df with calibrated, by a monotone fit over ranges of scores; constant beyond its range."""
    return isotonic.isotonic(fit, df)


def intercept_calibration(fit: DataFrame, df: DataFrame) -> DataFrame:
    """df with calibrated: odds times the ratio of the odds of the event rate and of the mean pd."""
    rate = fit.agg(F.avg("label").alias("r"), F.avg(_clipped()).alias("m"))
    p = _clipped()
    odds = p / (1 - p) * (F.col("r") / (1 - F.col("r"))) / (F.col("m") / (1 - F.col("m")))
    return df.crossJoin(F.broadcast(rate)).withColumn("calibrated", odds / (1 + odds)).drop("r", "m")


METHODS = ("raw", "intercept", "platt", "beta")


def methods(fit: DataFrame, df: DataFrame, names: tuple[str, ...] = METHODS) -> DataFrame:
    """df in long form: method, pd by each method, all fitted on fit."""
    keep, out = [c for c in df.columns if c != "pd"], df.withColumn("raw", F.col("pd"))
    for name in names:
        if name != "raw":
            out = (intercept_calibration(fit, out) if name == "intercept" else logistic_calibration(fit, out, name)).withColumnRenamed("calibrated", name)
    return out.select(*keep, *names).unpivot(keep, list(names), "method", "pd")


def metadata(fit: DataFrame, name: str) -> DataFrame:
    """One row on a calibration of fit: method, population, events, rates, mean pd and log loss before and after, parameters."""
    parameters: dict[str, float] = {}
    if name in ("platt", "beta"):
        weights = logistic_fit(fit, name)
        out = _applied(weights, fit, name)
        parameters = {"intercept": weights[0]} | {f"slope_{k}": w for k, w in enumerate(weights[1:])}
    elif name == "intercept":
        out = intercept_calibration(fit, fit)
    else:
        out = fit.withColumn("calibrated", F.col("pd"))
    y = F.col("label")
    loss = lambda p: F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    inside = lambda c: F.least(F.greatest(c, F.lit(EPS)), F.lit(1 - EPS))
    one = out.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("events"), F.avg(y).alias("event_rate"), F.avg("pd").alias("mean_raw"), F.avg("calibrated").alias("mean_calibrated"),
        loss(inside("pd")).alias("log_loss_raw"), loss(inside("calibrated")).alias("log_loss_calibrated"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv]) if parameters else F.create_map().cast("map<string,double>")
    return one.select(F.lit(name).alias("method"), "*", kinds.alias("parameters"))


def slopes(df: DataFrame, by: str, rounds: int = 25) -> DataFrame:
    """by, n, events, intercept, slope of a logistic fit of the label on the logit of pd in each group, by Newton's method.

    Rows are summed up by group and pd once; each round is one aggregate with five sums a group, and groups (periods, segments) are
    few enough to be held by the driver. A group of one class or one pd has no fit.
    """
    spark, p = df.sparkSession, _clipped()
    counts = df.groupBy(F.col(by).alias("_g"), F.log(p / (1 - p)).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum("label").cast("double").alias("_e")).persist()
    try:
        groups = counts.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum("_e").cast("long").alias("events"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()
        at = {r["_g"]: (0.0, 1.0) for r in groups if r["_g"] is not None and 0 < r["events"] < r["n"] and r["lo"] < r["hi"]}
        kind = dict(df.dtypes)[by]
        for _ in range(rounds if at else 0):
            now = spark.createDataFrame([(g, *ab) for g, ab in at.items()], f"_g {kind}, _a double, _b double")
            q = 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
            w, r = F.col("_n") * q * (1 - q), F.col("_e") - F.col("_n") * q
            x = F.col("_x")
            sums = counts.join(F.broadcast(now), "_g").groupBy("_g").agg(*[F.sum(c).alias(k) for k, c in {"g0": r, "g1": r * x, "h0": w, "h1": w * x, "h2": w * x * x}.items()]).collect()
            largest = 0.0
            for s in sums:
                det = s["h0"] * s["h2"] - s["h1"] ** 2
                if det > 1e-12:
                    step = ((s["h2"] * s["g0"] - s["h1"] * s["g1"]) / det, (s["h0"] * s["g1"] - s["h1"] * s["g0"]) / det)
                    at[s["_g"]] = tuple(v + max(-5.0, min(5.0, d)) for v, d in zip(at[s["_g"]], step, strict=True))
                    largest = max(largest, *map(abs, step))
            if largest < 1e-10:
                break
        rows = [(r["_g"], r["n"], r["events"], *(at.get(r["_g"], (None, None)))) for r in groups]
        return spark.createDataFrame([tuple(None if isinstance(v, float) and not math.isfinite(v) else v for v in r) for r in rows], f"{by} {kind}, n long, events long, intercept double, slope double")
    finally:
        counts.unpersist()
