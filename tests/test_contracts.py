"""Whole-table contracts against the single checks that they bundle."""

from pyspark.sql import functions as F

from channelspark.operators import contracts as CT
from channelspark.operators import quality as QA

NAN = float("nan")
ROWS = [("a", 1, 1.0, True, 3), ("a", 2, NAN, True, 3), ("a", 2, NAN, True, 3), ("b", 1, None, False, 2),
        ("c", 1, 2.0, False, -1), ("c", 2, None, None, None)]
SCHEMA = "estimator string, link long, range_m double, success boolean, delay_bin int"


def listed(df):
    return sorted((r.rule_id, r.table, r.key, r.detail) for r in df.collect())


def contract(axis):
    return CT.Contract(
        "ranging", required=["estimator", "range_m", "snr_db"], forbidden=["link"], finite=["range_m"],
        some_finite=[(("link",), "range_m"), (("estimator",), "range_m")], rows=[QA.ranging_rule(["estimator", "link"])],
        values=[("Q6", "estimator", "music", "default estimator missing")],
        sizes=[CT.Size("Q15", ("estimator",), 2, axis), CT.Size("Q13", ("link",), F.lit(3))])


def singles(rows, axis):
    parts = [
        QA.columns(rows, "ranging", ["estimator", "range_m", "snr_db"], ["link"]), QA.all_finite(rows, "ranging", ["range_m"]),
        QA.some_finite(rows, "ranging", ["link"], "range_m"), QA.some_finite(rows, "ranging", ["estimator"], "range_m"),
        QA.ranging_consistency(rows, ["estimator", "link"], "music"),
        QA.rows_per_key(rows, "ranging", ["estimator"], 2, axis=axis), QA.rows_per_key(rows, "ranging", ["link"], 3, "Q13"),
    ]
    return sorted(row for part in parts for row in listed(part))


def test_a_contract_finds_what_the_single_checks_find(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    axis = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "estimator string")
    found = listed(CT.violations(rows, contract(axis)))
    assert found == singles(rows, axis)
    assert found.count(("Q6", "ranging", "a-2", "success flag disagrees")) == 2  # repeated rows stay two violations
    assert ("Q15", "ranging", "d", "0") in found and ("Q15", "ranging", "c", "2") in found


def test_an_empty_table_still_breaks_what_must_be_there(spark):
    rows, axis = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("d",)], "estimator string")
    assert listed(CT.violations(rows, contract(axis))) == singles(rows, axis) != []


def test_a_table_that_keeps_its_contract(spark):
    rows = spark.createDataFrame(ROWS[:1], SCHEMA).withMetadata("range_m", {"unit": "m"})
    kept = CT.Contract("ranging", required=["range_m"], forbidden=["snr_db"], units=["range_m"], finite=["range_m"],
                       rows=[QA.ranging_rule(["link"])], values=[("Q6", "estimator", "a", "missing")])
    assert CT.violations(rows, kept).count() == 0
    assert CT.violations(rows, CT.Contract("ranging")).count() == 0


def test_one_scan_and_one_exchange(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    rows = spark.read.parquet(path)
    found = CT.violations(rows, contract(None))
    found.collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("Aggregate") == 1
