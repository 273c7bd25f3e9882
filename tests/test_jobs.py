"""All jobs end to end on a few landed files."""

import json

import pytest

from tenderwatch.operators.runs import rows_of_run
from tenderwatch.plans.jobs import Monitor
from tenderwatch.sources.storage import children


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text(json.dumps(rows))


def notice(n, **changes):
    base = {
        "id_del_proceso": f"p{n}", "entidad": "Alcaldía", "nombre_del_proveedor": "Uno", "nit_del_proveedor_adjudicado": "9",
        "modalidad_de_contratacion": "Contratación directa", "tipo_de_contrato": "Obra", "valor_total_adjudicacion": str(100 + n),
        "precio_base": "50", "fecha_de_publicacion_del": f"2023-01-{n % 28 + 1:02d}T00:00:00.000", "urlproceso": {"url": f"https://x/{n}"},
    }
    return {**base, **changes}


def test_whole_chain(spark, tmp_path):
    m = Monitor(spark, str(tmp_path / "root"))
    landing = tmp_path / "landing"
    rows = [notice(n) for n in range(20)] + [notice(3, entidad="again"), notice(20, valor_total_adjudicacion="90000", entidad=None)]
    rows += [notice(21, valor_total_adjudicacion="100000", nombre_del_proveedor="Dos")]
    land(landing, "1.json", rows + [notice(99, fecha_de_publicacion_del="2019-05-05T00:00:00")])
    sync = m.sync_source(1, str(landing), "JSON", since="2020-01-01", lines=False)
    assert (sync["fetched"], sync["inserted"], sync["duplicates"], sync["outside"], sync["state"]) == (24, 22, 1, 1, "EXITOSO")
    assert m.last_sync(1) is not None and m.last_sync(2) is None

    log = m.normalise("2024-01-01")
    assert (log["n_evaluated"], log["n_processed"], log["n_issues"]) == (22, 22, 1)
    assert m.contracts.count() == 22 and m.issues.count() == 1
    assert m.contracts.where("url = 'https://x/4'").count() == 1
    again = m.normalise("2024-01-01")
    assert (again["n_evaluated"], again["n_processed"]) == (0, 0)
    forced = m.normalise("2024-01-01", force=True)
    assert (forced["n_evaluated"], forced["n_processed"], forced["n_skipped"]) == (22, 0, 22)

    land(landing, "2.json", [notice(30), notice(5)])
    assert m.sync_source(1, str(landing), "JSON", since="2020-01-01", lines=False)["inserted"] == 1
    assert m.normalise("2024-01-01")["n_processed"] == 1
    # an earlier as-of day makes dates "future": every contract changes and issues are replaced
    changed = m.normalise("2022-01-01", force=True)
    assert changed["n_processed"] == 23 and m.contracts.count() == 23 and m.issues.count() == 24
    assert m.contracts.where("is_suspicious").count() == 23
    m.normalise("2024-01-01", force=True)
    assert m.issues.count() == 1 and m.normalise_runs.count() == 6

    runs = [m.run_outliers(), m.run_repeats(), m.run_direct_awards()]
    assert len(set(runs)) == 3
    assert m.page("outlier_results", only_outliers=True).first()["direction"] == "HIGH"
    m.set_weight("outlier", 0.5)
    m.set_weight("OUTLIER", 0.0)
    m.run_risk()
    top = m.page("supplier_risk", size=1).first()
    assert top["supplier"] == "UNO" and top["total"] == 2 and top["risk_class"] == "HIGH"
    assert top["weights"]["OUTLIER"] == 0.0
    assert m.page("supplier_risk", supplier="dos").first()["final_score"] == 0.0


def test_failed_sync_is_logged(spark, tmp_path):
    m = Monitor(spark, str(tmp_path / "root"))
    with pytest.raises(RuntimeError):
        m.sync_source(1, str(tmp_path / "missing"), "JSON")
    row = m.sync_history.first()
    assert row["state"] == "ERROR" and row["inserted"] == 0 and row["error"]


def test_due_sources_start_where_they_stopped(spark, tmp_path):
    m = Monitor(spark, str(tmp_path / "root"))
    good = tmp_path / "good"
    good.mkdir()
    (good / "1.json").write_text("\n".join(json.dumps(notice(n)) for n in range(3)))
    m.add_source(1, "gone", "JSON", str(tmp_path / "gone"))
    m.add_source(2, "good", "JSON", str(good))
    m.add_source(3, "off", "JSON", str(good), active=False)
    assert m.sync_due() == {1: "ERROR", 2: "EXITOSO"}
    assert m.raw_notices.count() == 3
    last = {r["id"]: r["last_sync"] for r in m.sources.collect()}
    assert last[2] is not None and last[1] is None and last[3] is None
    assert m.sync_due() == {1: "ERROR"}
    today = last[2].date().isoformat()
    (good / "2.json").write_text(json.dumps(notice(50)) + "\n" + json.dumps(notice(51, fecha_de_publicacion_del=f"{today}T00:00:00")))
    assert m.sync_due("2100-01-01 00:00:00")[2] == "EXITOSO"
    row = m.sync_history.orderBy("started_at", ascending=False).where("source_id = 2").first()
    assert (row["since"], row["inserted"], row["outside"]) == (today, 1, 4)
    assert m.test_source(str(good), "JSON")["ok"] is True
    assert m.test_source(str(tmp_path / "gone"), "JSON")["ok"] is False
    (tmp_path / "empty").mkdir()
    assert m.test_source(str(tmp_path / "empty"), "JSON")["ok"] is False


def test_jobs_leave_no_scratch_and_need_a_run(spark, tmp_path):
    def left():
        root = spark.conf.get("spark.checkpoint.dir")
        return set(children(spark, f"{root}/tenderwatch/{spark.sparkContext.applicationId}"))

    m = Monitor(spark, str(tmp_path / "root"))
    land(tmp_path / "in", "1.json", [notice(n) for n in range(10)])
    before = left()
    m.sync_source(1, str(tmp_path / "in"), "JSON", lines=False)
    with pytest.raises(ValueError):
        m.page("outlier_results")
    m.normalise("2024-01-01")
    m.normalise("2024-01-01", force=True)
    m.run_outliers(), m.run_repeats(), m.run_direct_awards(), m.run_risk()
    assert left() == before
    assert m.page("repeat_results").count() > 0
    land(tmp_path / "in", "2.json", [notice(77)])
    m.sync_source(1, str(tmp_path / "in"), "JSON", lines=False)
    assert [r["id_del_proceso"] for r in m.new_notices().collect()] == ["p77"]
    plan = m.new_notices()._jdf.queryExecution().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(writer" in plan or "PartitionFilters: [writer" in plan


def test_half_written_run_is_invisible(spark, tmp_path):
    m = Monitor(spark, str(tmp_path / "root"))
    land(tmp_path / "in", "1.json", [notice(n) for n in range(10)])
    m.sync_source(1, str(tmp_path / "in"), "JSON", lines=False)
    m.normalise("2024-01-01")
    run = m.run_outliers()
    rows = m.results("outlier_results").rows
    rows.drop("run_id").limit(2).write.parquet(str(tmp_path / "root" / "outlier_results" / "run_id=zz"))
    assert rows_of_run(m.results("outlier_results")).select("run_id").distinct().collect() == [(run,)]
    assert rows_of_run(m.results("outlier_results"), "zz").count() == 0
