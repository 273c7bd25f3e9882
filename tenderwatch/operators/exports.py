"""Projections of the exported reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _yes_no(name: str) -> Column:
    return F.when(F.col(name), "SÍ").otherwise("NO")


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def export_contract_rows(contracts: DataFrame) -> DataFrame:
    """Ten report columns: blanks for NULL, percent sign on the confidence, yes/no flags."""
    return contracts.select(
        "id",
        _text(F.col("buyer")).alias("entidad"),
        _text(F.col("supplier")).alias("proveedor"),
        _text(F.col("method")).alias("modalidad"),
        _text(F.col("total_value")).alias("valor_total"),
        _text(F.col("published_on")).alias("fecha"),
        _text(F.col("status")).alias("estado"),
        _text(F.concat(F.col("confidence").cast("string"), F.lit("%"))).alias("confianza"),
        _yes_no("is_incomplete").alias("incompleto"),
        _yes_no("is_suspicious").alias("sospechoso"),
    )


def export_sync_rows(named_history: DataFrame) -> DataFrame:
    """Synchronisation log; a source without a name is shown by its number."""
    by_number = F.concat(F.lit("Fuente #"), F.col("source_id").cast("string"))
    return named_history.select(
        F.col("id").alias("ID"),
        F.coalesce("source_name", by_number).alias("Fuente"),
        _text(_stamp("started_at")).alias("Fecha Inicio"),
        _text(_stamp("ended_at")).alias("Fecha Fin"),
        F.col("fetched").alias("Registros Traídos"),
        F.col("inserted").alias("Registros Insertados"),
        F.col("duplicates").alias("Registros Duplicados"),
        F.col("state").alias("Estado"),
        _text(F.col("error")).alias("Mensaje Error"),
    )


def export_run_rows(runs: DataFrame) -> DataFrame:
    """Normalisation log."""
    return runs.select(
        F.col("id").alias("ID"),
        F.col("state").alias("Estado"),
        _yes_no("forced").alias("Forzar Reproceso"),
        _text(_stamp("started_at")).alias("Fecha Inicio"),
        _text(_stamp("ended_at")).alias("Fecha Fin"),
        _text(F.col("seconds")).alias("Duración (s)"),
        F.col("n_evaluated").alias("Total Evaluados"),
        F.col("n_processed").alias("Procesados"),
        F.col("n_skipped").alias("Omitidos"),
        F.col("n_issues").alias("Anomalías Registradas"),
        _text(F.col("error")).alias("Mensaje Error"),
    )
