"""Point-in-time features and target on hand-made panels, and properties that they must keep."""

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import panel, pit, splits, validate
from panelrisk.sources import files, spec

COLUMNS = "loan_id string, calculated_loan_age int, current_loan_delinquency_status string, zero_balance_code string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumns({c: F.lit(None).cast("string") for c in pit.FLAGS.values()})


def block(df):
    f = pit.Frames()
    return pit.forward_target(pit.trajectory(pit.lookbacks(pit.lifetime_history(pit.current_state(df), f), f), f), f)


def at(df, age, *columns):
    return tuple(df.where(F.col("calculated_loan_age") == age).select(*columns).first())


def test_gap_counts_by_age(spark):
    out = block(frame(spark, [("A", a, s, None) for a, s in ((1, "01"), (2, "00"), (5, "02"), (6, "RA"))]))
    assert at(out, 5, "dpd_30_count_3m", "delinquency_months_12m", "delinquency_episode_count", "relapse_after_current") == (1, 2, 2, 1)
    assert at(out, 6, "has_prior_serious", "current_delinquency_streak", "months_since_last_delinquency") == (True, 0, 1)
    assert at(out, 1, "current_delinquency_streak", "dpd_trend_6m") == (1, None)


def test_codes_that_are_no_numbers(spark):
    out = pit.current_state(frame(spark, [("A", k, s, None) for k, s in enumerate(["RA", "XX", None, "bad", "03", "02"])]))
    assert [r["serious"] for r in out.orderBy("calculated_loan_age").collect()] == [True, False, False, False, True, False]


@pytest.mark.parametrize(("rows", "observable", "label"), [
    ([(4, "00", None), (5, "03", None)], True, 1), ([(4, "00", None), (5, "00", None), (6, "00", None)], True, 0), ([(4, "00", None), (5, "00", "01")], True, 0),
    ([(4, "00", None), (5, "00", "03")], False, 0), ([(4, "00", None), (5, "00", None)], False, 0), ([], False, 0), ([(4, "RA", None), (5, "00", "01")], True, 1), ([(4, "00", None), (6, "00", None)], True, 0),
])
def test_target_truth_table(spark, rows, observable, label):
    out = block(frame(spark, [("A", 3, "00", None)] + [("A", *r) for r in rows]))
    assert at(out, 3, "is_outcome_observable", "future_90dpd") == (observable, label)


def test_later_rows_do_not_change_features_or_target(spark):
    rows = [("A", a, f"{(a * 7) % 3:02d}", None) for a in range(1, 20)]
    key = ["max_dpd_to_date", "dpd_trend_6m", "dpd_acceleration_6m", "delinquency_episode_count", "max_delinquency_streak_12m"]
    long, short = block(frame(spark, rows)), block(frame(spark, rows[:9]))
    assert at(long, 9, *key) == at(short, 9, *key)
    assert at(long, 6, "future_90dpd", "is_outcome_observable") == at(short, 6, "future_90dpd", "is_outcome_observable")


def test_windows_share_one_exchange(spark):
    df = block(frame(spark, [("A", 1, "00", None)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(loan_id") == 1


def test_duplicates_and_orphans(spark):
    a = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("C", 1)], "loan_id string, period int")
    assert [tuple(r) for r in validate.duplicate_keys(a, "loan_id", "period").collect()] == [("A", 1, 2)]
    b = spark.createDataFrame([("A",), ("B",)], "loan_id string")
    assert [r[0] for r in validate.orphans(a, b, "loan_id").collect()] == ["C"]
    with pytest.raises(ValueError, match="loan_id_null"):
        validate.require(validate.key_checks(spark.createDataFrame([(None,), ("x",)], "loan_id string"), "loan_id"))


def test_sentinels_and_indicator(spark):
    df = spark.createDataFrame([(9999, 999, 60, "9"), (700, 30, 999, "P")], "credit_score int, original_dti int, original_ltv int, occupancy_status string")
    out = [tuple(r) for r in panel.missing_indicators(panel.normalized(df)).collect()]
    assert out == [(None, None, 60, None, 1), (700, 30, None, "P", 0)]


def test_contract_and_split_errors(spark):
    df = spark.createDataFrame([(1, 2020)], "loan_id int, vintage int")
    with pytest.raises(ValueError, match="missing"):
        panel.contract(df, ["loan_id", "x"])
    for lists in (([2020], [2020], []), ([2021], [2020], [])):
        with pytest.raises(ValueError):
            splits.yearly(df, *lists)
    with pytest.raises(ValueError):
        splits.grouped(df, "loan_id", 1.0)


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_split_does_not_depend_on_partitions(spark, parts):
    df = spark.range(500).withColumnRenamed("id", "loan_id")
    count = lambda d: d.groupBy("split").count().orderBy("split").collect()
    assert count(splits.grouped(df.repartition(parts), "loan_id", 0.3)) == count(splits.grouped(df, "loan_id", 0.3))


def test_specs_and_ingest(spark, tmp_path):
    assert len(spec.ORIGINATION.fields) == 31 and len(spec.PERFORMANCE.fields) == 35
    assert len({f.name for f in spec.PERFORMANCE.fields}) == 35
    small = spec.TableSpec("t", (spec.Field("loan_id", "text"), spec.Field("period", "month"), spec.Field("upb", "double"), spec.Field("n", "int")), ("loan_id", "period"))
    (tmp_path / "a.txt").write_text("F1|202001|10.5|3\nF2|209913|x|2.5\n|201912||7\n")
    got = files.ingest(spark, str(tmp_path / "a.txt"), small, str(tmp_path / "out")).first()
    assert tuple(got)[1:] == (3, 0, 2)
    rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("F1", 600, 10.5, 3), ("F2", None, None, None), (None, 599, None, 7)}


def test_stream_of_files(spark, tmp_path):
    from panelrisk.streaming import ingest_stream

    small = spec.TableSpec("t", (spec.Field("loan_id", "text"), spec.Field("n", "int")), ("loan_id",))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"L{k}|{k}\n")
        ingest_stream(spark, str(tmp_path / "in"), small, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("L0", 0), ("L1", 1)]


def test_months_are_made_without_joins_of_the_table_with_itself(spark):
    """Months between orders, first and last ones, ids and dates that are null; up to an age, the same rows as of the whole table."""
    from datetime import date

    rows = [(1, 1, date(1995, 1, 5), 10.0, "1-URGENT", "F"), (2, 1, date(1995, 1, 9), 5.0, "5-LOW", "O"), (3, 1, date(1996, 6, 1), 7.0, "5-LOW", "F"), (4, 2, date(1995, 3, 3), 1.0, "2-HIGH", "P"), (5, 3, None, 2.0, "5-LOW", "O"), (6, None, date(1995, 1, 1), 3.0, "5-LOW", "O"), (7, None, date(1995, 3, 1), 4.0, "5-LOW", "O")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string, o_orderstatus string")
    lines = spark.createDataFrame([(1, "R", 0.1, 10.0, 50.0, 0.08), (3, "N", 0.2, 5.0, 1.0, 0.0)], "l_orderkey long, l_returnflag string, l_discount double, l_extendedprice double, l_quantity double, l_tax double")
    df = panel.performance(orders, lines)
    assert {tuple(r) for r in df.groupBy("loan_id").count().collect()} == {(1, 18), (2, 1), (None, 3)}
    assert [r["current_actual_upb"] for r in df.where("loan_id = 1").orderBy("period").collect()] == [15.0] * 17 + [22.0]
    assert df.where("loan_id IS NULL AND current_actual_upb = 0").count() == 3
    assert [r["zero_balance_code"] for r in df.where("zero_balance_code IS NOT NULL").orderBy("loan_id").collect()] == ["01", "03"]
    assert panel.performance(orders, lines, dense=False).count() == 3
    for last in (1, 3, 17, 18, 40):
        assert sorted(map(str, panel.performance(orders, lines, last_age=last).collect())) == sorted(map(str, df.where(f"period - first_payment_date < {last}").collect()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
