"""Detector rules on small hand-made frames, thresholds included."""

from datetime import date, timedelta
from decimal import Decimal

import pytest

from tenderwatch import schemas as S
from tenderwatch.operators import direct_awards, outliers, repeats, supplier_risk
from tenderwatch.operators.runs import append_run, latest_run, read_results, resolve_run, rows_of_run, stamp_run


def contracts(spark, rows):
    """Contract rows from partial dictionaries."""
    base = {
        "supplier": "S", "supplier_tax_id": "1", "buyer": "B", "contract_type": "T", "method": "M", "published_on": date(2020, 1, 1),
        "total_value": Decimal("10.00"), "base_price": Decimal("10.00"), "is_incomplete": False, "is_suspicious": False,
        "n_missing": 0, "confidence": 100, "missing_fields": [],
    }
    names = S.CONTRACT_SCHEMA.fieldNames()
    full = [{**base, "id": i + 1, "raw_id": i + 1, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([[r.get(n) for n in names] for r in full], S.CONTRACT_SCHEMA)


def test_outliers_both_sides(spark):
    values = [100, 101, 102, 103, 104, 105, 106, 107, 1, 500]
    df = contracts(spark, [{"total_value": Decimal(v)} for v in values])
    rows = {r["contract_id"]: r for r in outliers.detect_outliers(df).collect()}
    assert len(rows) == 10
    assert {i: r["direction"] for i, r in rows.items() if r["is_outlier"]} == {9: "LOW", 10: "HIGH"}
    r = rows[9]
    assert r["score"] == pytest.approx((r["lower"] - 1) / r["iqr"], abs=1e-4)
    assert all((x["score"] > 0) == x["is_outlier"] for x in rows.values())


def test_outlier_scope(spark):
    rows = [{"total_value": Decimal(v)} for v in (1, 2, 3, 4)]
    rows += [{"total_value": Decimal(0)}, {"total_value": None}, {"total_value": Decimal(9), "is_incomplete": True}]
    rows += [{"method": "FLAT"}] * 3  # no spread: left out
    rows += [{"method": " ", "contract_type": None}]  # no group: left out
    found = outliers.detect_outliers(contracts(spark, rows)).collect()
    assert sorted(r["contract_id"] for r in found) == [1, 2, 3, 4]


def test_group_falls_back_to_type(spark):
    rows = [{"method": m, "contract_type": "T", "total_value": Decimal(v)} for v, m in enumerate([" ", None, "", "  "], 1)]
    assert {r["grp"] for r in outliers.valid_contracts(contracts(spark, rows)).collect()} == {"T"}


def test_fields_are_checked(spark):
    df = contracts(spark, [{}])
    with pytest.raises(ValueError):
        outliers.valid_contracts(df, "buyer")
    with pytest.raises(ValueError):
        outliers.base_filters(df, date_field="created_at")
    assert outliers.detect_outliers(df, "n_missing").count() == 0


def test_repeat_thresholds(spark):
    gaps = [0, 5, 6, 15, 16, 30, 31]
    rows = []
    for n, gap in enumerate(gaps):
        first = date(2020, 1, 1)
        rows += [{"supplier": f"S{n}", "published_on": d} for d in (first, first + timedelta(days=gap))]
    found = {r["days"]: r for r in repeats.detect_repeats(contracts(spark, rows)).collect()}
    assert {d: r["risk_class"] for d, r in found.items()} == {
        0: "HIGH", 5: "HIGH", 6: "MEDIUM", 15: "MEDIUM", 16: "LOW", 30: "LOW",
    }
    assert {d: r["score"] for d, r in found.items()} == {0: 10.0, 5: 8.33, 6: 8.0, 15: 5.0, 16: 4.67, 30: 0.0}
    assert all(r["related_id"] == r["contract_id"] - 1 for r in found.values())


def test_repeat_keys(spark):
    rows = [
        {}, {"contract_type": None, "method": "T"},  # type falls back to method: same kind
        {"buyer": "OTHER"}, {"supplier": None}, {"buyer": None}, {"published_on": None}, {"is_incomplete": True},
    ]
    assert [r["contract_id"] for r in repeats.detect_repeats(contracts(spark, rows)).collect()] == [2]


def test_direct_award_thresholds(spark):
    def awards(name, n, direct, span):
        day = date(2020, 1, 1)
        return [
            {
                "supplier": name, "method": "CONTRATACIÓN DIRECTA" if i < direct else "OTRA",
                "published_on": day + timedelta(days=span if i == 0 else 0),
            }
            for i in range(n)
        ]

    rows = awards("IN", 3, 3, 90) + awards("LONG", 3, 3, 91) + awards("FEW", 3, 2, 0) + awards("P70", 10, 7, 10)
    rows += awards("P69", 13, 9, 10) + awards("P90", 10, 9, 1) + awards("N/A", 5, 5, 0) + awards(" ", 5, 5, 0)
    found = {r["supplier"]: r for r in direct_awards.detect_direct_awards(contracts(spark, rows)).collect()}
    assert {s: r["risk_class"] for s, r in found.items()} == {"IN": "HIGH", "P70": "MEDIUM", "P69": "LOW", "P90": "HIGH"}
    assert found["P69"]["direct_pct"] == 69.23 and found["P69"]["score"] == 6.92
    assert found["P90"]["n_direct"] == 9 and found["P90"]["n_contracts"] == 10


def test_combined_risk(spark):
    found = [(1, 2.0, "A", "7"), (2, 0.5, "A", "8"), (3, 0.0, "Z", None), (4, 9.0, None, None)]
    out = spark.createDataFrame(found, "contract_id long, score double, supplier string, supplier_tax_id string")
    rep = spark.createDataFrame([("A", 1.0), ("R", 4.0), ("", 9.0)], "supplier string, score double")
    dire = spark.createDataFrame([("D", "5", 2.5), ("E", None, 1.0)], "supplier string, supplier_tax_id string, score double")
    rows = {
        r["supplier"]: r for r in supplier_risk.combine_supplier_risk(out, rep, dire, S.DEFAULT_WEIGHTS).collect()
    }
    assert {s: (r["final_score"], r["risk_class"]) for s, r in rows.items()} == {
        "A": (3.5, "MEDIUM"), "Z": (0.0, "LOW"), "R": (6.0, "HIGH"), "D": (5.0, "HIGH"), "E": (2.0, "MEDIUM"),
    }
    assert rows["A"]["supplier_tax_id"] == "8"
    assert rows["A"]["weights"] == S.DEFAULT_WEIGHTS


def test_weights(spark):
    stored = spark.sql("SELECT 'OUTLIER' AS signal, CAST(3 AS DECIMAL(5,2)) AS weight")
    assert supplier_risk.read_weights(stored) == {"OUTLIER": 3.0, "SHORT_REPEAT": 1.5, "DIRECT_AWARD": 2.0}
    changed = supplier_risk.update_weight(supplier_risk.seed_weights(stored), "direct_award", 0)
    assert supplier_risk.read_weights(changed)["DIRECT_AWARD"] == 0.0
    for bad in (("nothing", 1), ("OUTLIER", -1)):
        with pytest.raises(ValueError):
            supplier_risk.update_weight(stored, *bad)


def test_runs(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.range(3)
    schema = stamp_run(rows, "", "2020-01-01").schema
    with pytest.raises(ValueError):
        resolve_run(read_results(spark, path, schema))
    append_run(rows, path, "b", "2020-01-01 00:00:00")
    append_run(rows, path, "a", "2020-01-02 00:00:00")
    append_run(rows.where("id < 0"), path, "empty", "2020-01-03 00:00:00")
    stored = read_results(spark, path, schema)
    assert latest_run(stored.runs).first()["run_id"] == resolve_run(stored) == "a"
    assert rows_of_run(stored).count() == 3 and rows_of_run(stored, "b").count() == 3
    assert resolve_run(stored, "b") == "b" and rows_of_run(stored, "empty").count() == 0
    plan = latest_run(stored.runs)._jdf.queryExecution().toString()
    assert "results_runs" in plan and "results/run_id" not in plan and plan.count("FileScan") == 1
