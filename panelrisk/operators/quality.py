"""Data-quality reports over panel frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators.aggregates import categorical_profile, unpivoted
from panelrisk.operators.validate import rules


def reconciliation(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """stage, loans, missing (ids of the first stage that it lacks), extra, retained share of the first stage."""
    first, out = next(iter(stages.values())).select(key).distinct(), None
    for name, df in stages.items():
        own = df.select(key).distinct()
        both = first.withColumn("a", F.lit(1)).join(own.withColumn("b", F.lit(1)), key, "full")
        row = both.agg(F.count("b").alias("loans"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count("a").alias("_all"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_both"))
        row = row.select(F.lit(name).alias("stage"), "loans", "missing", "extra", (F.col("_both") / F.col("_all")).alias("retained"))
        out = row if out is None else out.unionByName(row)
    return out


def grain(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """dataset, duplicate_rows, status."""
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return one.select(F.lit(name).alias("dataset"), "duplicate_rows", F.when(F.col("duplicate_rows") == 0, "PASS").otherwise("FAIL").alias("status"))


def value_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, infinite, negative, zero, min, max."""
    v = F.col("value")
    return unpivoted(df, [], columns).groupBy("feature").agg(F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.min(v).alias("min"), F.max(v).alias("max"))


def surviving(df: DataFrame, sentinels: dict[str, object]) -> DataFrame:
    """check, severity, bad_rows: sentinel values that are still there, in one aggregate."""
    return rules(df, {c: ("warning", F.col(c) == v) for c, v in sentinels.items()})


def constant(df: DataFrame, columns: list[str], threshold: float = 0.99) -> DataFrame:
    """feature, top_share, status."""
    share = F.col("top_share")
    status = F.when(F.col("distinct_values") <= 1, "FAIL").when(share >= threshold, "WARN").otherwise("PASS")
    return categorical_profile(df, columns).select("feature", "distinct_values", "top_share", status.alias("status"))


def forbidden(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, present, status: columns that would leak the outcome; rows counts the frame."""
    found = [F.struct(F.lit(n).alias("feature"), F.lit(n in df.columns).alias("present"), F.lit("FAIL" if n in df.columns else "PASS").alias("status")) for n in names]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*found)).alias("x")).select("x.*", "rows")


def inventory(df: DataFrame) -> DataFrame:
    """feature, type, filled: every column with its type and the rows that have it; one aggregate."""
    types = dict(df.dtypes)
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("filled")) for c, t in types.items()]))
    return one.select(rows.alias("x")).select("x.*")


def funnel(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """position, stage, loans, retention against the stage before."""
    out = None
    for k, (name, df) in enumerate(stages):
        row = df.agg(F.count_distinct(key).alias("loans")).select(F.lit(k).alias("position"), F.lit(name).alias("stage"), "loans")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("retention", F.col("loans") / F.lag("loans").over(Window.orderBy("position")))


def gate(report: DataFrame, review: int = 0) -> DataFrame:
    """check, bad_rows, status: FAIL for errors, REVIEW for warnings above `review`, else PASS."""
    bad = F.col("bad_rows")
    return report.withColumn("status", F.when((F.col("severity") == "error") & (bad > 0), "FAIL").when(bad > review, "REVIEW").otherwise("PASS"))


def violations(df: DataFrame, bad: Column, *by: str) -> DataFrame:
    return df.where(bad).groupBy(*by).agg(F.count(F.lit(1)).alias("bad_rows"))


def summary(df: DataFrame, name: str, key: str) -> DataFrame:
    """dataset, rows, columns, loans, missing_ids, duplicate_rows (equal in every column)."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("loans"), F.count_if(F.col(key).isNull()).alias("missing_ids"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("_d"))
    return one.crossJoin(F.broadcast(distinct)).select(F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "loans", "missing_ids", (F.col("rows") - F.col("_d")).alias("duplicate_rows"))


def indicators(df: DataFrame, suffix: str = "_missing") -> DataFrame:
    """feature, bad_rows, status: rows in which <feature>_missing is not 1 where the feature is null and 0 elsewhere. One aggregate; no row where there is no indicator."""
    pairs = [(c.removesuffix(suffix), c) for c in df.columns if c.endswith(suffix) and c.removesuffix(suffix) in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, bad_rows long, status string")
    one = df.agg(*[F.count_if(~F.col(m).cast("int").eqNullSafe(F.col(c).isNull().cast("int"))).alias(c) for c, m in pairs])
    rows = one.unpivot([], [c for c, _ in pairs], "feature", "bad_rows")
    return rows.withColumn("status", F.when(F.col("bad_rows") > 0, "FAIL").otherwise("PASS"))


def target_features(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """feature, label, n, mean, median, min, max of numeric columns by the value of the label."""
    from panelrisk.operators import aggregates

    v = F.col("value")
    stats = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")]
    return aggregates.profiled(aggregates.unpivoted(df.withColumnRenamed(label, "label"), ["label"], columns), ["feature", "label"], stats, {"median": 0.5})


def issues(tables: dict[str, DataFrame]) -> DataFrame:
    """report, item, status of all rows of the tables whose status is WARN, REVIEW or FAIL; the item is a row's first text column."""
    out = None
    for name, t in tables.items():
        if "status" in t.columns:
            item = next(c for c, kind in t.dtypes if kind == "string" and c != "status")
            part = t.where(F.col("status").isin("WARN", "REVIEW", "FAIL")).select(F.lit(name).alias("report"), F.col(item).alias("item"), "status")
            out = part if out is None else out.unionByName(part)
    return out


def flagged(orig: DataFrame, perf: DataFrame, rows: DataFrame, numeric: list[str], categories: list[str], leaks: list[str], sentinels: dict[str, object]) -> dict[str, DataFrame]:
    """The tables of the report that have a status, by name: all that its issues come from."""
    return {
        "grain": grain(orig, "origination", "loan_id").unionByName(grain(perf, "performance", "loan_id", "period")).unionByName(grain(rows, "input", "loan_id", "observation_age")),
        "sentinels": gate(surviving(orig, sentinels)),
        "constant": constant(rows, [*numeric, *categories]),
        "leakage": forbidden(rows, leaks),
        "indicators": indicators(rows),
    }


def report(orig: DataFrame, perf: DataFrame, rows: DataFrame, label: str, numeric: list[str], categories: list[str], leaks: list[str], sentinels: dict[str, object]) -> dict[str, DataFrame]:
    """All tables of the report by name, the issues of the others last; the three frames are read several times, so give written ones."""
    from panelrisk.operators import aggregates

    y = F.col(label)
    tables = flagged(orig, perf, rows, numeric, categories, leaks, sentinels) | {
        "summary": summary(orig, "origination", "loan_id").unionByName(summary(perf, "performance", "loan_id")).unionByName(summary(rows, "input", "loan_id")),
        "reconciliation": reconciliation({"origination": orig, "performance": perf, "input": rows}, "loan_id"),
        "funnel": funnel([("origination", orig), ("performance", perf), ("input", rows)], "loan_id"),
        "target": rows.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("events"), F.count_if(y == 0).alias("non_events"), F.count_if(y.isNull()).alias("missing"), F.avg(label).alias("event_rate")),
        "missing": aggregates.missingness(rows, [*numeric, *categories]),
        "numeric": aggregates.numeric_profile(rows, numeric),
        "categories": categorical_profile(rows, categories),
        "numeric_values": value_checks(rows, numeric),
        "target_features": target_features(rows, label, numeric),
        "inventory": inventory(rows),
    }
    return tables | {"issues": issues(tables)}


def long_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of any columns as table, row (their text columns) and metric, value (their numbers)."""
    out = None
    for name, df in tables.items():
        text = [c for c, t in df.dtypes if t in ("string", "boolean")]
        numbers = [c for c, t in df.dtypes if c not in text and not t.startswith(("array", "map", "struct"))]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers])) if numbers else F.explode(F.array(F.struct(F.lit("row").alias("metric"), F.lit(1.0).alias("value"))))
        own = df.select(F.lit(name).alias("table"), F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in text]).alias("row"), pairs.alias("x")).select("table", "row", "x.*")
        out = own if out is None else out.unionByName(own)
    return out
