"""Every report read from the cube equals the one from the rows, and the cube scans them once."""

from pyspark.sql import functions as F

from payrisk import fixtures as fx
from payrisk.plans import cube, reports
from payrisk.session import store

CUT = "2024-01-20"


def same(a, b):
    """Rows in order, by column name."""
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert [tuple(r) for r in a.select(*names).collect()] == [tuple(r) for r in b.select(*names).collect()]


def test_reports_from_the_cube(spark, folder):
    clean = fx.stored_clean(spark, folder)
    kept = store(cube.fraud_cube(clean, CUT), "cube")
    same(cube.overall_rate(kept), reports.overall_rate(clean))
    same(cube.rate_by_payment_method(kept), reports.rate_by_payment_method(clean))
    same(cube.payment_method_rates(kept), reports.payment_method_rates(clean))
    for grouping, key in (("error", "has_error"), ("hour", "transaction_hour"), ("weekday", "day_of_week")):
        same(cube.rate_by(kept, grouping), reports.rate_by(clean, key))
    same(cube.rate_by_month(kept), reports.rate_by_month(clean))
    same(cube.high_risk_categories(kept, 3, 20), reports.high_risk_categories(clean, 3, 20))
    same(cube.drift_overall(kept), reports.drift_overall(clean, CUT))
    same(cube.drift_by_payment_method(kept), reports.drift_by_payment_method(clean, CUT))


def test_missing_keys_are_groups_and_not_totals(spark, folder):
    clean = fx.stored_clean(spark, folder).withColumns({
        "use_chip": F.when(F.col("transaction_id") % 3 > 0, F.col("use_chip")),
        "transaction_time": F.when(F.col("transaction_id") % 5 > 0, F.col("transaction_time")),
    })
    kept = store(cube.fraud_cube(clean, CUT), "cube")
    same(cube.rate_by_payment_method(kept), reports.rate_by_payment_method(clean))
    same(cube.rate_by_month(kept), reports.rate_by_month(clean))
    same(cube.drift_by_payment_method(kept), reports.drift_by_payment_method(clean, CUT))


def test_one_scan_and_no_periods_without_a_cut_off(spark, folder):
    clean = fx.stored_clean(spark, folder)
    found = cube.fraud_cube(clean)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    assert {r["grouping"] for r in found.select("grouping").distinct().collect()} == set(cube.GROUPINGS) - {"period", "period_method"}
    assert cube.fraud_cube(clean.limit(0), CUT).where("transactions > 0").count() == 0
