"""Properties of the executed plans that decide whether they hold at scale."""

import re

import pytest

from tenderwatch.operators import direct_awards, ingest, normalise, outliers, search, supplier_risk
from tenderwatch.operators.runs import rows_of_run
from tenderwatch.plans.pipeline import pipeline
from tenderwatch.schemas import DEFAULT_WEIGHTS
from tenderwatch.sources import testdata

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return pipeline(spark, SF_DIR)


def plan(df, mode="formatted"):
    df.collect()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_normalisation_is_one_compilable_projection(p):
    df = normalise.normalise_contracts(p.raw, testdata.AS_OF)
    text = plan(df)
    assert "Exchange" not in text and "PythonUDF" not in text
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan(df, "codegen"))]
    assert len(sizes) == 1 and sizes[0] < 8000  # above this the JVM interprets


def test_search_pushes_filters_and_never_sorts_everything(p):
    wanted = search.ContractFilter(value_min=1000, confidence_min=50)
    text = plan(search.search_contracts(p.contracts, wanted, page=2))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert "GreaterThanOrEqual(total_value" in text and "GreaterThanOrEqual(confidence,50)" in text


def test_latest_run_reads_one_partition(p):
    text = plan(search.list_outliers(p.outlier_results))
    assert re.search(r"PartitionFilters: \[.*run_id.* = Subquery", text)


def test_detectors_read_only_their_columns(p):
    text = plan(outliers.valid_contracts(p.contracts))
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "url" not in schema and "row_hash" not in schema
    assert "GreaterThan(total_value,0.00)" in text


@pytest.mark.parametrize("name", ["risk", "direct", "insert", "outliers", "upsert", "high_risk"])
def test_no_product_joins(p, name):
    arriving = p.arriving.select("id_del_proceso", "id")
    df = {
        "risk": lambda: supplier_risk.combine_supplier_risk(*p.latest, DEFAULT_WEIGHTS),
        "direct": lambda: direct_awards.detect_direct_awards(p.contracts),
        "insert": lambda: ingest.insert_ignore(arriving, arriving.where("id > 1000"), ["id"]),
        "outliers": lambda: outliers.detect_outliers(p.contracts),
        "upsert": lambda: normalise.upsert_actions(p.contracts, p.earlier_contracts, True),
        "high_risk": lambda: search.high_risk_contracts(p.contracts, p.risk),
    }[name]()
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_signals_need_one_shuffle(p):
    repeat, direct = rows_of_run(p.repeat_results, "run-2"), rows_of_run(p.direct_results, "run-2")
    df = supplier_risk.combine_signals(repeat, repeat, direct)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max" in text


def test_copies_alone_are_aggregated_whole(p):
    """Keys with copies are stored and sent to the wide rows, which only move where they are copies."""
    from tenderwatch.operators.scale import first_per_key

    order = ["fecha_adjudicacion", "id", "nit_entidad", "valor_total_adjudicacion"]
    some = p.arriving.select("id_del_proceso", *order, "entidad").where("id % 10 = 1")
    few = some.unionByName(some.where("id % 70 = 1"))
    found = first_per_key(few, "id_del_proceso", order)
    final = plan(found, "simple").split("== Initial Plan ==")[0]
    assert "LeftAnti" in final and "LeftSemi" in final and "BroadcastHashJoin" in final
    assert "SortMergeJoin" not in final
    once = first_per_key(p.raw, "id_del_proceso", ["id"])  # no copies: nothing moves at all
    assert "Exchange" not in plan(once, "simple")


def test_risk_needs_no_join(p):
    text = plan(supplier_risk.combine_supplier_risk(*p.latest, DEFAULT_WEIGHTS), "simple")
    assert "Join" not in text
