"""Raw notices, sources and histories derived from the star-schema test tables.

The tables hold no NULLs and almost no outliers, so missing, blank, negative and future values
are injected by modulus and the contract value is price x quantity x discount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: later dates count as future
AS_OF = "2001-01-01"
#: notices published before this day are already stored
STORED_UNTIL = "2000-01-01"

# Contracting methods and process states by order priority and status.
METHODS = {
    "1": "Contratación directa",
    "2": "Licitación pública",
    "3": "Mínima cuantía",
    "4": " ",
    "5": "Contratación régimen especial",
}
STATES = {"F": "Adjudicado", "O": "Publicado", "P": "Seleccionado"}

_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _by_code(code: Column, names: dict[str, str]) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[code]


def _unless(part_modulus: int, value: Column, other: Column | None = None) -> Column:
    """``value`` except for every n-th part."""
    hit = F.col("l_partkey") % part_modulus == 0
    return F.when(hit, F.lit(None) if other is None else other).otherwise(value)


def order_lines(spark: SparkSession, sf_dir: str, first_only: bool) -> DataFrame:
    """Order lines; with ``first_only`` one per (order, line number).

    Lines are dealt by order, which serves the copies as well as the join with the orders after them.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    if not first_only:
        return lines
    return (
        lines.repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min(F.struct(*_LINE_ORDER)).alias("first"))
        .select("l_orderkey", "l_linenumber", "first.*")
    )


def _facts(spark: SparkSession, sf_dir: str, first_only: bool) -> DataFrame:
    """Lines with order, customer, supplier, part, nation and region.

    No hints: Spark broadcasts what its size allows and splits skewed partitions otherwise. Where
    nothing large can be broadcast, lines move twice: by order, whose customers are joined to the few
    orders before, and by part, while they are still narrow.
    """
    def t(name: str, *columns: str) -> DataFrame:
        return read(spark, sf_dir, name).select(*columns)

    orders = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    named = orders.join(t("customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        order_lines(spark, sf_dir, first_only)
        .join(named, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier", "s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _notice_columns() -> list[Column]:
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    value = (
        F.col("l_extendedprice").cast("decimal(12,2)")
        * F.col("l_quantity").cast("decimal(6,2)")
        * F.col("l_discount").cast("decimal(4,2)")
    ).cast("decimal(20,2)")
    columns = {
        "id": ident,
        "fuente_id": F.lit(1),
        "id_del_proceso": ident.cast("string"),
        "entidad": _unless(41, F.col("s_name")),
        "nit_entidad": F.col("s_suppkey").cast("string"),
        "departamento_entidad": F.col("r_name"),
        "ciudad_entidad": F.col("n_name"),
        "estado_del_procedimiento": _by_code(F.col("o_orderstatus"), STATES),
        "fecha_de_publicacion_del": _unless(43, F.col("o_orderdate").cast("timestamp")),
        "fecha_de_ultima_publicaci": F.lit(None).cast("timestamp"),
        "fecha_de_apertura_efectiva": F.lit(None).cast("timestamp"),
        "fecha_adjudicacion": F.col("l_shipdate").cast("timestamp"),
        "precio_base": F.col("o_totalprice").cast("decimal(20,2)"),
        "modalidad_de_contratacion": _by_code(F.substring("o_orderpriority", 1, 1), METHODS),
        "tipo_de_contrato": _unless(47, F.col("p_type")),
        "valor_total_adjudicacion": _unless(53, value, -value),
        "nombre_del_proveedor": _unless(37, F.col("c_name"), F.lit("  ")),
        "nit_del_proveedor_adjudicado": F.col("c_custkey").cast("string"),
        "urlproceso": F.concat(F.lit("{'url': 'https://example.org/"), ident.cast("string"), F.lit("'}")),
    }
    return [c.alias(n) for n, c in columns.items()]


def raw_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored notices: one per process."""
    return _facts(spark, sf_dir, first_only=True).select(*_notice_columns())


def arriving_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as they arrive: with copies, and some without a process key."""
    keyless = F.col("l_partkey") % 59 == 0
    rows = _facts(spark, sf_dir, first_only=False).select(*_notice_columns(), keyless.alias("keyless"))
    key = F.when(F.col("keyless"), F.lit(None)).otherwise(F.col("id_del_proceso"))
    return rows.withColumn("id_del_proceso", key).drop("keyless")


def earlier_notices(raw: DataFrame) -> DataFrame:
    """An older state of the notices: some were still open, some base prices were lower."""
    status = F.when(F.col("id") % 29 == 0, F.lit("Borrador")).otherwise(F.col("estado_del_procedimiento"))
    price = F.when(F.col("id") % 31 == 0, F.col("precio_base") - 1).otherwise(F.col("precio_base"))
    return raw.withColumn("estado_del_procedimiento", status).withColumn("precio_base", price)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def sync_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synchronisation per event."""
    state = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "EN_PROCESO")
        .otherwise("EXITOSO")
    )
    started = F.col("ts").cast("timestamp")
    inserted = F.least(F.col("fetched"), F.floor("value"))
    return (
        read(spark, sf_dir, "events")
        .select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("source_id"), "value",
                started.alias("started_at"), _k().alias("fetched"), state.alias("state"))
        .withColumn("ended_at", F.when(F.col("state") != "EN_PROCESO", F.timestamp_add("SECOND", "fetched", "started_at")))
        .withColumn("inserted", inserted.cast("long"))
        .withColumn("duplicates", F.col("fetched") - F.col("inserted"))
        .withColumn("error", F.when(F.col("state") == "ERROR", F.concat(F.lit("batch "), F.col("fetched").cast("string"))))
        .drop("value")
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sources with history and one per nation without."""
    n = F.col("id")
    formats = F.element_at(F.array(F.lit("JSON"), F.lit("CSV"), F.lit("XML")), (n % 3 + 1).cast("int"))
    with_history = (
        sync_history(spark, sf_dir)
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.max(F.when(F.col("state") == "EXITOSO", F.col("started_at"))).alias("last"))
        .withColumn("name", F.concat(F.lit("Source "), n.cast("string")))
        .withColumn("last_sync", F.when(n % 5 != 4, F.col("last")))
        .select("id", "name", "last_sync")
    )
    without = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("timestamp").alias("last_sync"),
    )
    return with_history.unionByName(without).select(
        "id",
        "name",
        F.lit("OPEN_DATA").alias("kind"),
        formats.alias("format"),
        F.concat(F.lit("https://example.org/source/"), n.cast("string")).alias("endpoint"),
        (n % 7 + 1).cast("long").alias("every_days"),
        (n % 4 != 3).alias("active"),
        "last_sync",
    )


def normalise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation log: one run per "view" event."""
    k = F.col("k")
    started = F.col("ts").cast("timestamp")
    failed = k % 13 == 0
    return (
        read(spark, sf_dir, "events")
        .where(F.col("event_type") == "view")
        .withColumn("k", _k())
        .select(
            F.col("event_id").alias("id"),
            (k * 10).alias("n_evaluated"),
            k.alias("n_processed"),
            (k * 9).alias("n_skipped"),
            F.floor("value").alias("n_issues"),
            started.alias("started_at"),
            F.when(~failed, F.timestamp_add("SECOND", k, started)).alias("ended_at"),
            F.when(~failed, k).alias("seconds"),
            (F.col("event_id") % 2 == 0).alias("forced"),
            F.when(failed, "ERROR").otherwise("EXITOSO").alias("state"),
            F.when(failed, F.lit("chunk failed")).alias("error"),
        )
    )
