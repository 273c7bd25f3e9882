"""Raw notices -> contracts and record issues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch.functions import normalise as N
from tenderwatch.functions import quality as Q


def as_day(as_of: date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def contract_fields() -> dict[str, Column]:
    """The 16 normalised columns of a contract, from one raw notice.

    Fixed values: which notice field each column comes from.
    """

    def text(name: str) -> Column:
        return N.normalise_text(F.col(name))

    return {
        "raw_id": F.col("id"),
        "process_id": text("id_del_proceso"),
        "buyer": text("entidad"),
        "buyer_tax_id": text("nit_entidad"),
        "supplier": text("nombre_del_proveedor"),
        "supplier_tax_id": text("nit_del_proveedor_adjudicado"),
        "published_on": F.to_date("fecha_de_publicacion_del"),
        "awarded_on": F.to_date("fecha_adjudicacion"),
        "total_value": F.col("valor_total_adjudicacion"),
        "base_price": F.col("precio_base"),
        "contract_type": text("tipo_de_contrato"),
        "method": text("modalidad_de_contratacion"),
        "status": text("estado_del_procedimiento"),
        "city": text("ciudad_entidad"),
        "region": text("departamento_entidad"),
        "url": N.normalise_url(F.col("urlproceso")),
    }


# normalised column of each required notice field
_REQUIRED = {
    "entidad": "buyer",
    "nombre_del_proveedor": "supplier",
    "valor_total_adjudicacion": "total_value",
    "fecha_de_publicacion_del": "published_on",
    "tipo_de_contrato": "contract_type",
}


def normalise_contracts(raw: DataFrame, as_of: date | str) -> DataFrame:
    """One contract per notice, with content hash, quality flags and confidence.

    A contract keeps the id of its notice, so ids are stable across runs and need no lookup.
    A narrow projection: no shuffle. A blank text normalises to NULL, so missing fields are
    read off the normalised columns; that also keeps the generated method small enough for
    the JIT compiler (8,000 bytes of bytecode), beyond which it runs several times slower.
    """
    fields = contract_fields()
    columns = list(fields)
    base = raw.select(
        *[c.alias(n) for n, c in fields.items()],
        Q.has_negative_amount().alias("negative"),
        Q.has_future_date(as_day(as_of)).alias("is_suspicious"),
    )
    missing = Q.missing_fields({f: F.col(n) for f, n in _REQUIRED.items()})
    n_missing = F.size("missing_fields")
    return base.withColumn("missing_fields", missing).select(
        F.col("raw_id").alias("id"),
        *columns,
        N.row_hash({n: F.col(n) for n in columns}).alias("row_hash"),
        ((n_missing > 0) | F.col("negative")).alias("is_incomplete"),
        "is_suspicious",
        n_missing.alias("n_missing"),
        "missing_fields",
        Q.confidence(n_missing, F.col("negative"), F.col("is_suspicious")).alias("confidence"),
    )


def _explode(raw: DataFrame, issues: list[Column]) -> DataFrame:
    """One row per issue; notices without any are dropped before the explode."""
    ident = F.col("id")
    return (
        raw.where(F.coalesce(*issues).isNotNull())
        .select(ident.alias("raw_id"), ident.alias("contract_id"), F.explode(F.array(*issues)).alias("issue"))
        .where("issue IS NOT NULL")
        .select("raw_id", "contract_id", "issue.*")
    )


def record_issues(raw: DataFrame, as_of: date | str) -> DataFrame:
    """One row per (notice, issue, field)."""
    return _explode(raw, Q.all_issues(as_day(as_of)))


def detect_missing(raw: DataFrame) -> DataFrame:
    return _explode(raw, Q.missing_issues())


def detect_future_dates(raw: DataFrame, as_of: date | str) -> DataFrame:
    return _explode(raw, Q.future_date_issues(as_day(as_of)))


def detect_negative_amounts(raw: DataFrame) -> DataFrame:
    return _explode(raw, Q.negative_amount_issues())


def unprocessed(raw: DataFrame, contracts: DataFrame) -> DataFrame:
    """Notices that have no contract yet."""
    return raw.join(contracts.select(F.col("raw_id").alias("id")), "id", "left_anti")


_STATE = ["row_hash", "confidence", "is_incomplete", "is_suspicious"]


def packed_state(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Rows with their hash in half the bytes, for a join that moves it."""
    hashes = F.col(f"{prefix}row_hash")
    return rows.withColumn(f"{prefix}packed", N.pack_hash(hashes)).drop(f"{prefix}row_hash")


def upsert_actions(contracts: DataFrame, stored: DataFrame, force: bool) -> DataFrame:
    """Freshly normalised contracts with what an upsert would do to each: insert, update or skip.

    Only the four columns that decide are read from the stored side; hashes move packed.
    """
    known = packed_state(stored.select("raw_id", *[F.col(c).alias(f"old_{c}") for c in _STATE]), "old_")
    same = F.lit(True)
    for c in ["packed", *_STATE[1:]]:
        same = same & (F.col(c) == F.col(f"old_{c}"))
    action = F.when(F.col("old_packed").isNull(), "insert")
    if force:
        action = action.when(same, "skip").otherwise("update")
    else:
        action = action.otherwise("skip")
    joined = packed_state(contracts).join(known, "raw_id", "left")
    columns = {c: F.col(c) for c in contracts.columns} | {"row_hash": N.unpack_hash(F.col("packed"))}
    return joined.select(*[c.alias(n) for n, c in columns.items()], action.alias("action"))


def decide(contracts: DataFrame, stored: DataFrame) -> DataFrame:
    """``raw_id, action`` of a forced run: the wide columns of either side go into no join."""
    return upsert_actions(contracts.select("raw_id", *_STATE), stored, True).select("raw_id", "action")


def upsert_merge(actions: DataFrame, stored: DataFrame) -> DataFrame:
    """The contract table after the upsert: untouched rows and new or changed ones.

    One full join by the id, of which a stored table has one row each: actions are computed once, and
    stay where the join that made them has put them. Stored hashes move packed.
    """
    columns = stored.columns
    old = packed_state(stored.select(*[F.col(c).alias(f"old_{c}") for c in columns]), "old_")
    new = actions.where("action <> 'skip'")
    merged = old.join(new, F.col("old_raw_id") == F.col("raw_id"), "full")
    kept = {c: F.col(f"old_{c}") for c in columns if c != "row_hash"} | {"row_hash": N.unpack_hash(F.col("old_packed"))}
    return merged.select(*[F.when(F.col("action").isNotNull(), F.col(c)).otherwise(kept[c]).alias(c) for c in columns])


def normalise_counts(actions: DataFrame, issues: DataFrame) -> DataFrame:
    """Evaluated, processed, skipped and stored-issue totals of one run.

    Issues are stored for new and for changed contracts.
    """
    stored = issues.join(
        actions.where("action <> 'skip'").select("raw_id"), "raw_id", "left_semi"
    ).agg(F.count("*").alias("n"))
    return actions.agg(
        F.count("*").alias("n_evaluated"),
        F.count_if(F.col("action") != "skip").alias("n_processed"),
        F.count_if(F.col("action") == "skip").alias("n_skipped"),
    ).withColumn("n_issues", stored.scalar())


def merge_issues(actions: DataFrame, issues: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored issues after an upsert: those of new and changed contracts are replaced."""
    changed = actions.where("action <> 'skip'").select("raw_id")
    kept = stored.join(changed, "raw_id", "left_anti")
    return kept.unionByName(issues.join(changed, "raw_id", "left_semi"))
