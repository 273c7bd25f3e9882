"""Normalisation, quality rules and upsert on hand-made notices."""

from datetime import datetime
from decimal import Decimal

import pytest

from tenderwatch import schemas as S
from tenderwatch.operators import dashboards, normalise, search
from tenderwatch.operators.search import ContractFilter

AS_OF = "2024-01-01"


def notices(spark, rows):
    base = {
        "entidad": "Alcaldía", "nombre_del_proveedor": "Uno", "valor_total_adjudicacion": Decimal("10.00"), "precio_base": Decimal("5.00"),
        "fecha_de_publicacion_del": datetime(2023, 1, 1), "tipo_de_contrato": "Obra", "modalidad_de_contratacion": "Directa",
    }
    full = [{**base, "id": i + 1, "id_del_proceso": f"p{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([[r.get(n) for n in S.RAW_SCHEMA.fieldNames()] for r in full], S.RAW_SCHEMA)


ROWS = [
    {},
    {"entidad": " \t", "nombre_del_proveedor": None},
    {"precio_base": Decimal("-1.00"), "valor_total_adjudicacion": Decimal("-2.50")},
    {"fecha_adjudicacion": datetime(2024, 1, 1, 23, 59)},  # the day itself is not future
    {"fecha_adjudicacion": datetime(2024, 1, 2), "fecha_de_apertura_efectiva": datetime(2025, 1, 1)},
    {
        "entidad": None, "nombre_del_proveedor": "", "valor_total_adjudicacion": None, "fecha_de_publicacion_del": None,
        "tipo_de_contrato": " ", "fecha_adjudicacion": datetime(2030, 1, 1),
    },
]


def test_flags_and_confidence(spark):
    rows = normalise.normalise_contracts(notices(spark, ROWS), AS_OF).orderBy("id").collect()
    assert [r["confidence"] for r in rows] == [100, 60, 80, 100, 60, 0]
    assert [r["is_incomplete"] for r in rows] == [False, True, True, False, False, True]
    assert [r["is_suspicious"] for r in rows] == [False, False, False, False, True, True]
    assert rows[5]["missing_fields"] == S.REQUIRED_FIELDS and rows[5]["n_missing"] == 5
    assert rows[1]["missing_fields"] == ["entidad", "nombre_del_proveedor"]
    assert rows[0]["buyer"] == "ALCALDÍA" and rows[0]["supplier"] == "UNO"


def test_schema(spark):
    found = normalise.normalise_contracts(notices(spark, [{}]), AS_OF).schema
    assert [(f.name, f.dataType.simpleString()) for f in found] == [
        (f.name, f.dataType.simpleString()) for f in S.CONTRACT_SCHEMA
    ]


def test_issues(spark):
    rows = normalise.record_issues(notices(spark, ROWS), AS_OF).collect()
    found = sorted((r["raw_id"], r["kind"], r["field"], r["original_value"]) for r in rows if r["raw_id"] < 6)
    assert found == [
        (2, "MISSING_FIELD", "entidad", None),
        (2, "MISSING_FIELD", "nombre_del_proveedor", None),
        (3, "NEGATIVE_AMOUNT", "precio_base", "-1.00"),
        (3, "NEGATIVE_AMOUNT", "valor_total_adjudicacion", "-2.50"),
        (5, "FUTURE_DATE", "fecha_adjudicacion", "2024-01-02 00:00:00"),
        (5, "FUTURE_DATE", "fecha_de_apertura_efectiva", "2025-01-01 00:00:00"),
    ]
    assert sum(r["raw_id"] == 6 for r in rows) == 6


def test_upsert(spark):
    fresh = normalise.normalise_contracts(notices(spark, ROWS), AS_OF)
    older = normalise.normalise_contracts(notices(spark, ROWS[:2] + [{}]), AS_OF)
    forced = normalise.upsert_actions(fresh, older, force=True)
    assert [r["action"] for r in forced.orderBy("id").collect()] == ["skip", "skip", "update", "insert", "insert", "insert"]
    soft = normalise.upsert_actions(fresh, older, force=False)
    assert [r["action"] for r in soft.orderBy("id").collect()] == ["skip"] * 3 + ["insert"] * 3
    merged = normalise.upsert_merge(forced, older)
    assert sorted(r["row_hash"] for r in merged.collect()) == sorted(r["row_hash"] for r in fresh.collect())
    issues = normalise.record_issues(notices(spark, ROWS), AS_OF)
    counts = normalise.normalise_counts(normalise.upsert_actions(fresh, merged, True), issues).first()
    assert (counts["n_evaluated"], counts["n_processed"], counts["n_skipped"], counts["n_issues"]) == (6, 0, 6, 0)


def test_metrics(spark):
    df = normalise.normalise_contracts(notices(spark, ROWS), AS_OF)
    m = dashboards.quality_metrics(df).first()
    assert (m["total"], m["complete"], m["incomplete"], m["suspicious"]) == (6, 3, 3, 2)
    assert m["pct_suspicious"] == 33.33 and m["avg_confidence"] == 66.67
    empty = dashboards.quality_metrics(df.where("id < 0")).first()
    assert (empty["total"], empty["avg_confidence"], empty["pct_complete"]) == (0, 100.0, 0.0)


def test_search(spark):
    df = normalise.normalise_contracts(notices(spark, ROWS), AS_OF)
    page = search.search_contracts(df, sort="proveedor", order="desc", size=4).collect()
    assert [r["id"] for r in page] == [2, 6, 1, 3]  # NULL first when descending
    assert {(r["total"], r["total_pages"]) for r in page} == {(6, 2)}
    assert search.search_contracts(df, ContractFilter(buyer="alc_ld")).count() == 4  # patterns are allowed
    assert search.text_search(df, "alc_ld").count() == 0  # plain text only
    assert search.autocomplete(df, "a").count() == 0
    with pytest.raises(ValueError):
        ContractFilter(confidence_min=5, confidence_max=1).conditions()
