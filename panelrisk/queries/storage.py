"""Queries on readers, writers, checks of columns, history bounds, samples and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import panel, pit, quality, splits
from panelrisk.queries.base import clock, features, master, orig, perf, query, read
from panelrisk.queries.tables import BUCKET
from panelrisk.sources import files, ingest
from panelrisk.sources.scratch import scratch_path, stored
from panelrisk.sources.spec import Field, TableSpec

ORDERS = TableSpec("orders", (Field("o_orderkey", "int"), Field("o_custkey", "int"), Field("o_totalprice", "double"), Field("o_orderstatus", "text"), Field("month", "month")), ("o_orderkey",))


def _raw_orders(spark, sf_dir) -> str:
    """The orders as header-less files with a bar between fields."""
    path = scratch_path(spark, "raw-orders")
    o = read(spark, sf_dir, "orders")
    line = F.concat_ws("|", "o_orderkey", "o_custkey", F.col("o_totalprice").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyyMM"))
    o.select(line.alias("value")).write.text(path)
    return path


_MONTH = "(year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1"


@query(f"SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus, {_MONTH} AS month FROM orders")
def src1_src2_delimited(spark, sf_dir):
    raw = files.read_delimited(spark, _raw_orders(spark, sf_dir), ORDERS)
    return ORDERS.canonical(raw).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT 'orders' AS \"table\", count(*) AS rows, 0::BIGINT AS bad_width, 0::BIGINT AS no_key FROM orders")
def snk2_ingest(spark, sf_dir):
    return files.ingest(spark, _raw_orders(spark, sf_dir), ORDERS, scratch_path(spark, "orders"))


@query(f"""SELECT *, rows AS published FROM (SELECT year(o_orderdate) AS vintage, quarter(o_orderdate) AS quarter, count(*) FILTER (WHERE o_orderkey % 500 NOT IN (7, 8)) AS rows, count(*) FILTER (WHERE o_orderkey % 500 IN (7, 8)) AS bad_rows FROM orders GROUP BY ALL)""")
def snk2_staged_quarters(spark, sf_dir):
    """Quarters by file name, with lines cut short and blank keys set apart; a second ingest that allows none is refused and changes nothing."""
    path, target = scratch_path(spark, "raw-quarters"), scratch_path(spark, "ingested")
    o = read(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 500
    line = F.when(odd == 7, F.concat_ws("|", "o_orderkey", "o_custkey")).otherwise(F.concat_ws("|", F.when(odd == 8, "").otherwise(F.col("o_orderkey").cast("string")), "o_custkey", F.col("o_totalprice").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyyMM")))
    o.select(line.alias("value"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter")).write.partitionBy("quarter").text(path)
    done = ingest.staged_ingest(spark, f"{path}/*", ORDERS, target, f"{target}-bad", ingest.Limits(bad_share=0.5))
    try:
        ingest.staged_ingest(spark, f"{path}/*", ORDERS, target, f"{target}-bad")
        raise AssertionError("bad rows were let through")
    except ingest.IngestError:
        pass
    there = ingest.read_ingested(spark, target, ORDERS).groupBy("vintage", "quarter").agg(F.count(F.lit(1)).alias("published"))
    return done.join(there, ["vintage", "quarter"])


@query("SELECT vintage, count(*) AS n, round(sum(current_actual_upb), 2) AS upb FROM pf GROUP BY vintage")
def snk1_partitioned(spark, sf_dir):
    path = scratch_path(spark, "performance")
    files.write_partitioned(perf(spark, sf_dir), path)
    return files.read_parquet(spark, path).groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("current_actual_upb"), 2).alias("upb"))


_WANTED = ["c_custkey", "c_name", "c_birthday"]


@query("WITH c AS (SELECT column_name AS name FROM (DESCRIBE SELECT * FROM customer)), w AS (SELECT unnest(['c_custkey', 'c_name', 'c_birthday']) AS name) SELECT name, 'missing' AS problem FROM w WHERE name NOT IN (SELECT name FROM c) UNION ALL SELECT name, 'unexpected' FROM c WHERE name NOT IN (SELECT name FROM w)")
def val1_columns(spark, sf_dir):
    found = TableSpec("customer", tuple(Field(c, "text") for c in _WANTED), ("c_custkey",)).differences(read(spark, sf_dir, "customer"))
    return spark.createDataFrame([(c, k) for k, cs in found.items() for c in cs], "name string, problem string")


@query("SELECT loan_id, vintage FROM fu WHERE age = 6 AND NOT has_prior_serious AND zero_balance_code IS NULL")
def flt1_risk_set_at_age(spark, sf_dir):
    rows = pit.lifetime_history(pit.current_state(master(spark, sf_dir).where("calculated_loan_age <= 15")), pit.Frames())
    return pit.risk_set(rows, (6,)).select("loan_id", "vintage")


@query("SELECT loan_id, age AS calculated_loan_age FROM pf WHERE age <= 12")
def flt3_history_bound(spark, sf_dir):
    return clock(spark, sf_dir, 12).select("loan_id", "calculated_loan_age")


@query("SELECT c_custkey AS loan_id, p0 AS first_payment_date FROM customer LEFT JOIN (SELECT loan_id, min(period) AS p0 FROM mo GROUP BY loan_id) ON c_custkey = loan_id")
def jn2_first_payment_date(spark, sf_dir):
    return panel.with_first_payment(orig(spark, sf_dir).select("loan_id"), perf(spark, sf_dir))


@query("SELECT loan_id, observation_age, future_90dpd, credit_score FROM mi")
def jn6_features_and_target_by_key(spark, sf_dir):
    """Features and target, written apart, joined on their grain keys."""
    both = stored(features(spark, sf_dir).select("loan_id", "observation_age", "future_90dpd", "credit_score"), "input")
    return both.drop("future_90dpd").join(both.drop("credit_score"), ["loan_id", "observation_age"])


@query(f"SELECT loan_id, observation_age FROM mi WHERE {BUCKET.format(seed="'bernoulli'", key='loan_id')} < 0.1")
def tk5_bernoulli_sample(spark, sf_dir):
    return splits.sampled(features(spark, sf_dir), "loan_id", 0.1).select("loan_id", "observation_age")


@query(f"SELECT loan_id, observation_age, future_90dpd FROM mi WHERE {BUCKET.format(seed="'class'", key='loan_id')} < CASE WHEN future_90dpd = 1 THEN 0.9 ELSE 0.2 END")
def tk6_sample_by_class(spark, sf_dir):
    return splits.sampled_by_class(features(spark, sf_dir), "loan_id", "future_90dpd", {0: 0.2, 1: 0.9}).select("loan_id", "observation_age", "future_90dpd")


_YEARS = {"train": [1992, 1993, 1994, 1995], "test": [1996], "oot": [1997, 1998, 1999, 2000, 2050]}
_SPLIT = "CASE WHEN vintage <= 1995 THEN 'train' WHEN vintage = 1996 THEN 'test' ELSE 'oot' END"


@query(f"""SELECT how, split, count(*) AS n FROM (SELECT 'yearly' AS how, {_SPLIT} AS split FROM mi WHERE vintage BETWEEN 1992 AND 2000
UNION ALL SELECT 'random', CASE WHEN {BUCKET.format(seed="'split'", key='loan_id')} < 0.3 THEN 'validation' ELSE 'train' END FROM mi) GROUP BY ALL""")
def sp5_dispatch(spark, sf_dir):
    df, out = stored(features(spark, sf_dir).select("loan_id", "vintage"), "input"), None
    for how, options in (("yearly", _YEARS), ("random", {"key": "loan_id", "share": 0.3})):
        own = splits.dispatch(df, how, **options).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "split", "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM mi WHERE vintage BETWEEN 1992 AND 2000)
SELECT split, count(*) AS n_rows, count(DISTINCT loan_id) AS loans, sum(future_90dpd)::BIGINT AS events, round(avg(future_90dpd), 6) AS event_rate, min(vintage) AS first_vintage, max(vintage) AS last_vintage,
(CASE split WHEN 'train' THEN 4 WHEN 'test' THEN 1 ELSE 5 END - count(DISTINCT vintage))::INT AS vintages_without_rows FROM s GROUP BY split""")
def sp6_summary_with_years(spark, sf_dir):
    return splits.with_years(splits.yearly(features(spark, sf_dir), **_YEARS), "future_90dpd", "loan_id", _YEARS)


_SUM = ["credit_score", "original_ltv", "current_actual_upb"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c})::DOUBLE AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, round(min({c})::DOUBLE, 4) AS least, round(max({c})::DOUBLE, 4) AS most FROM mi" for c in _SUM))
def ag19_summary(spark, sf_dir):
    wide = features(spark, sf_dir).select(*_SUM).summary("count", "mean", "stddev", "min", "max")
    long = wide.unpivot(["summary"], _SUM, "feature", "value").groupBy("feature").pivot("summary", ["count", "mean", "stddev", "min", "max"]).agg(F.first(F.col("value").cast("double")))
    return long.select("feature", F.col("count").alias("n"), *[F.round(a, 4).alias(b) for a, b in (("mean", "mean"), ("stddev", "stddev"), ("min", "least"), ("max", "most"))])


@query("SELECT count(*) = 0 AS is_empty FROM mi WHERE vintage = 1995")
def tk2_existence(spark, sf_dir):
    return spark.createDataFrame([(features(spark, sf_dir).where("vintage = 1995").isEmpty(),)], "is_empty boolean")


@query()
def dq10_report(spark, sf_dir):
    """All tables of the data-quality report in long form, over frames that are written once."""
    return quality.long_report(_report(spark, sf_dir))


def _frames(spark, sf_dir):
    """Origination, performance and model input, each written once; the input is made from the written performance."""
    p, o = stored(perf(spark, sf_dir), "performance"), stored(orig(spark, sf_dir), "origination")
    return o, p, stored(pit.model_input(panel.master(p, panel.missing_indicators(panel.normalized(o)))), "input")


_REPORTED = {"numeric": ["credit_score", "original_ltv", "current_actual_upb", "estimated_ltv"], "categories": ["occupancy_status", "property_state"], "leaks": ["recovery_amount", "has_prior_serious"], "sentinels": {"credit_score": 9999, "original_dti": 999, "original_ltv": 999}}


def _report(spark, sf_dir):
    return quality.report(*_frames(spark, sf_dir), "future_90dpd", **_REPORTED)


@query("""WITH k AS (SELECT 'occupancy_status' AS item, occupancy_status::VARCHAR AS v FROM mi UNION ALL SELECT 'property_state', property_state::VARCHAR FROM mi UNION ALL SELECT 'credit_score', credit_score::VARCHAR FROM mi UNION ALL SELECT 'original_ltv', original_ltv::VARCHAR FROM mi
  UNION ALL SELECT 'current_actual_upb', current_actual_upb::VARCHAR FROM mi UNION ALL SELECT 'estimated_ltv', estimated_ltv::VARCHAR FROM mi),
t AS (SELECT item, count(*) AS levels, max(n) / sum(n) AS share FROM (SELECT item, v, count(*) AS n FROM k WHERE v IS NOT NULL GROUP BY ALL) GROUP BY item)
SELECT 'sentinels' AS report, item, 'REVIEW' AS status FROM (SELECT 'credit_score' AS item, count(*) FILTER (WHERE credit_score = 9999) AS n FROM og UNION ALL SELECT 'original_dti', count(*) FILTER (WHERE original_dti = 999) FROM og UNION ALL SELECT 'original_ltv', count(*) FILTER (WHERE original_ltv = 999) FROM og) WHERE n > 0
UNION ALL SELECT 'constant', item, CASE WHEN levels <= 1 THEN 'FAIL' ELSE 'WARN' END FROM t WHERE levels <= 1 OR share >= 0.99
UNION ALL SELECT 'leakage', 'has_prior_serious', 'FAIL'""")
def dq10_issues(spark, sf_dir):
    """What the tables of the full report flag; of them only those with a status are made."""
    return quality.issues(quality.flagged(*_frames(spark, sf_dir), **_REPORTED))


