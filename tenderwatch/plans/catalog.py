"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch import schemas as S
from tenderwatch.functions import normalise as N
from tenderwatch.functions import quality as Q
from tenderwatch.functions import scoring as C
from tenderwatch.operators import (
    dashboards,
    direct_awards,
    exports,
    ingest,
    normalise,
    outliers,
    repeats,
    search,
    supplier_risk,
    syncs,
)
from tenderwatch.operators.runs import append_run, latest_run, rows_of_run, stamp_run
from tenderwatch.operators.scale import first_wins
from tenderwatch.operators.search import ContractFilter, paginate
from tenderwatch.plans.pipeline import NEW_RUN, NEW_TIME, Pipeline, pipeline
from tenderwatch.sources import testdata
from tenderwatch.sources.key_index import KeyIndex
from tenderwatch.sources.part_store import PartStore
from tenderwatch.sources.readers import scan_notices
from tenderwatch.sources.sinks import export_csv
from tenderwatch.sources.storage import scratch_path, settle
from tenderwatch.streaming.ingest import add_batch, stored_notices, stream_ingest

Query = Callable[[Pipeline], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__.rstrip("_")] = f
    return f


def surface(df: DataFrame) -> DataFrame:
    """Result types every SQL engine prints alike: long, double, string, boolean."""

    def plain(name: str, dtype: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(dtype, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dtype, T.DateType):
            c = c.cast("string")
        elif isinstance(dtype, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(dtype, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(name)

    return df.select(*[plain(f.name, f.dataType) for f in df.schema.fields])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: surface(q(pipeline(spark, sf_dir)))

    return {name: bind(q) for name, q in _QUERIES.items()}


# --- A: scans and sources --------------------------------------------------------------------

_NOTICE = [n for n, _ in S.NOTICE_FIELDS]


def _landed(p: Pipeline) -> DataFrame:
    """All notice columns as text, as a source would publish them."""
    held = set(p.raw.columns)
    return p.raw.select(
        "id", *[(F.col(c) if c in held else F.lit(None)).cast("string").alias(c) for c in _NOTICE]
    )


#: landed text is compressed, in files of so many rows at most: each is one task's share
_LANDED_AS = {"compression": "gzip", "maxRecordsPerFile": 50_000}


@query
def scan_notices_json(p: Pipeline) -> DataFrame:
    path = scratch_path(p.spark, "landed-json")
    _landed(p).drop("id").write.options(**_LANDED_AS).json(path)
    return scan_notices(p.spark, path, "JSON").select(*_NOTICE)


@query
def scan_notices_json_array(p: Pipeline) -> DataFrame:
    """Documents that are one array each, a few hundred notices long."""
    path = scratch_path(p.spark, "landed-arrays")
    part = F.floor(F.col("id") / 5000)
    rows = _landed(p).select(part.alias("part"), F.struct(*_NOTICE).alias("row"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("value")).repartition("part").write.partitionBy(
        "part"
    ).text(path, compression="gzip")
    return scan_notices(p.spark, path, "JSON", lines=False).select(*_NOTICE)


@query
def scan_notices_csv(p: Pipeline) -> DataFrame:
    """Three kinds of files: all columns, columns in another order, and a few columns only."""
    path = scratch_path(p.spark, "landed-csv")
    kinds = {0: _NOTICE, 1: ["unknown", *reversed(_NOTICE)], 2: _CSV_FEW}
    for kind, columns in kinds.items():
        some = _landed(p).where(F.col("id") % 3 == kind).withColumn("unknown", F.lit("x"))
        some.select(*columns).write.mode("append").options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_LANDED_AS
        ).csv(path)
    return scan_notices(p.spark, path, "CSV").select(*_NOTICE)


_CSV_FEW = ["precio_base", "id_del_proceso", "nombre_del_proveedor", "urlproceso"]


@query
def scan_notices_xml(p: Pipeline) -> DataFrame:
    path = scratch_path(p.spark, "landed-xml")
    _landed(p).drop("id").write.options(rootTag="rows", rowTag="row", **_LANDED_AS).xml(path)
    return scan_notices(p.spark, path, "XML").select(*[N.normalise_text(F.col(c)).alias(c) for c in _SCANNED])


_SCANNED = ["id_del_proceso", "entidad", "nombre_del_proveedor", "precio_base", "modalidad_de_contratacion", "urlproceso"]


@query
def publication_window(p: Pipeline) -> DataFrame:
    kept = ingest.publication_window(p.raw, "1997-01-01", "1999-12-31")
    return kept.select("id", "fecha_de_publicacion_del")


@query
def source_sample(p: Pipeline) -> DataFrame:
    return ingest.source_sample(p.raw)


@query
def conform_schema(p: Pipeline) -> DataFrame:
    landed = p.arriving.select("id_del_proceso", "entidad", "urlproceso").withColumn("unknown", F.lit(1))
    return ingest.conform_schema(landed, 7)


def _as_text(p: Pipeline) -> DataFrame:
    """Typed columns as text, some of it unreadable."""
    bad_price = F.when(F.col("id") % 61 == 0, "n/a").otherwise(F.col("precio_base").cast("string"))
    stamp = F.date_format("fecha_adjudicacion", "yyyy-MM-dd'T'HH:mm:ss")
    bad_day = F.when(F.col("id") % 67 == 0, "soon").otherwise(stamp)
    return p.raw.select(
        "id", "id_del_proceso", bad_price.alias("precio_base"), bad_day.alias("fecha_adjudicacion"), "entidad"
    )


@query
def coerce_types(p: Pipeline) -> DataFrame:
    return ingest.coerce_types(_as_text(p))


@query
def rejected_values(p: Pipeline) -> DataFrame:
    return ingest.rejected_values(_as_text(p))


@query
def stringify_nested(p: Pipeline) -> DataFrame:
    link = F.struct(F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("url"))
    landed = p.raw.select("id_del_proceso", link.alias("urlproceso"))
    return ingest.conform_schema(landed, 1).select("id_del_proceso", "urlproceso")


@query
def scan_raw_unprocessed(p: Pipeline) -> DataFrame:
    return p.raw.drop("fecha_de_ultima_publicaci", "fecha_de_apertura_efectiva")


@query
def table_scan_all(p: Pipeline) -> DataFrame:
    return p.sources


_SHORT = ["id", "buyer", "supplier", "method", "published_on", "total_value", "confidence"]


@query
def point_lookup_id(p: Pipeline) -> DataFrame:
    wanted = p.contracts.agg(F.max("id")).scalar()
    return p.contracts.where(F.col("id") == wanted).select(*_SHORT)


@query
def point_lookup_raw_id(p: Pipeline) -> DataFrame:
    wanted = p.raw.agg(F.min("id")).scalar()
    return p.contracts.where(F.col("raw_id") == wanted).select(*_SHORT)


@query
def point_lookup_hash(p: Pipeline) -> DataFrame:
    wanted = p.contracts.agg(F.max("row_hash")).scalar()
    return p.contracts.where(F.col("row_hash") == wanted).select("row_hash", *_SHORT)


# --- B: sinks and state ----------------------------------------------------------------------

_ARRIVAL = ["fecha_adjudicacion", "id", "nit_entidad", "valor_total_adjudicacion"]


def _arrivals(p: Pipeline) -> tuple[DataFrame, DataFrame]:
    """Incoming notices, and stored ones: everything published before a fixed day."""
    rows = p.arriving.select("id_del_proceso", *_ARRIVAL, "fecha_de_publicacion_del")
    limit = F.lit(testdata.STORED_UNTIL).cast("timestamp")
    old = F.coalesce(F.col("fecha_de_publicacion_del") < limit, F.lit(False))
    return rows, first_wins(rows.where(old), S.PROCESS_KEY, _ARRIVAL)


@query
def insert_ignore(p: Pipeline) -> DataFrame:
    incoming, stored = _arrivals(p)
    return ingest.insert_ignore(incoming, stored, _ARRIVAL)


def _indexed(p: Pipeline) -> tuple[DataFrame, DataFrame]:
    """Incoming notices, and the stored keys of their buckets by an index of three batches."""
    incoming, stored = _arrivals(p)
    index = KeyIndex(p.spark, scratch_path(p.spark, "keys"), S.PROCESS_KEY, bucket_keys=2000)
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    for n in range(3):
        index.add(stored.where(turn == n), "w", n)
    return incoming, index.near(incoming, p.spark.range(3).select(F.lit("w").alias("writer"), F.col("id").alias("batch")))


@query
def insert_ignore_indexed(p: Pipeline) -> DataFrame:
    """Insert-ignore against the stored key index."""
    return ingest.insert_ignore(*_indexed(p), _ARRIVAL)


@query
def conflict_anti_indexed(p: Pipeline) -> DataFrame:
    return ingest.not_stored(*_indexed(p))


@query
def sync_result(p: Pipeline) -> DataFrame:
    incoming, stored = _arrivals(p)
    added = ingest.insert_ignore(incoming, stored, _ARRIVAL)
    return ingest.sync_result(incoming, added, testdata.STORED_UNTIL, testdata.AS_OF)


@query
def watermark_update(p: Pipeline) -> DataFrame:
    return syncs.watermarks(p.sources, p.history).select("id", "name", "last_sync", "next_from")


def _stored_contracts(p: Pipeline) -> DataFrame:
    """An older contract table: what had been published by then, in its older state."""
    return p.earlier_contracts.where(F.col("published_on") < F.lit(testdata.STORED_UNTIL).cast("date"))


def _actions(p: Pipeline, force: bool = True) -> DataFrame:
    return normalise.upsert_actions(p.contracts, _stored_contracts(p), force)


@query
def upsert_contracts(p: Pipeline) -> DataFrame:
    return _actions(p).select("raw_id", "row_hash", "action")


@query
def normalise_counts(p: Pipeline) -> DataFrame:
    return normalise.normalise_counts(_actions(p), p.issues)


@query
def normalise_counts_unforced(p: Pipeline) -> DataFrame:
    return normalise.normalise_counts(_actions(p, force=False), p.issues)


@query
def record_issues_write(p: Pipeline) -> DataFrame:
    old = normalise.record_issues(testdata.earlier_notices(p.raw), testdata.AS_OF)
    stored = old.join(_stored_contracts(p).select("raw_id"), "raw_id", "left_semi").withColumn("created_at", F.lit("2000-12-31 00:00:00").cast("timestamp"))
    return normalise.merge_issues(_actions(p), p.issues, stored)


@query
def append_run_results(p: Pipeline) -> DataFrame:
    results = p.outlier_results.rows
    return results.groupBy("run_id", "field").agg(
        F.count("*").alias("n_rows"), F.max("score").alias("max_score"), F.min("computed_at").alias("computed_at")
    )


def _calibrated(p: Pipeline) -> DataFrame:
    """A stored weight table with one signal, derived from the share of outliers."""
    share = F.count_if("is_outlier") * 10 / F.count("*")
    return p.latest[0].agg(
        F.lit("OUTLIER").alias("signal"), F.round(share.cast("decimal(20,10)"), 2).cast("decimal(5,2)").alias("weight")
    )


def _class_counts(p: Pipeline, weights: DataFrame) -> DataFrame:
    signals = supplier_risk.combine_signals(
        supplier_risk.outlier_contracts(p.latest[0]), *p.latest[1:]
    )
    scored = supplier_risk.score_risk(signals, supplier_risk.read_weights(weights))
    return scored.groupBy("risk_class").agg(
        F.count("*").alias("n"), F.sum(F.col("final_score").cast("decimal(20,2)")).alias("total_score")
    )


@query
def weights_seed(p: Pipeline) -> DataFrame:
    return _class_counts(p, supplier_risk.seed_weights(_calibrated(p)))


@query
def weights_update(p: Pipeline) -> DataFrame:
    weights = supplier_risk.default_weights(p.spark)
    return _class_counts(p, supplier_risk.update_weight(weights, "short_repeat", 2.25))


@query
def weights_map(p: Pipeline) -> DataFrame:
    return p.risk.select("supplier", "final_score", F.to_json("weights").alias("weights"))


@query
def export_csv_(p: Pipeline) -> DataFrame:
    path = scratch_path(p.spark, "export")
    export_csv(exports.export_contract_rows(p.contracts), path)
    back = p.spark.read.options(header=True, sep=";", quote='"', escape='"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query
def export_contract_rows(p: Pipeline) -> DataFrame:
    return exports.export_contract_rows(p.contracts)


@query
def export_sync_rows(p: Pipeline) -> DataFrame:
    named = syncs.active_sources(p.sources)
    return exports.export_sync_rows(syncs.with_source_name(p.history, named))


@query
def export_run_rows(p: Pipeline) -> DataFrame:
    return exports.export_run_rows(p.normalise_runs)


# --- C: projections and scalar functions -----------------------------------------------------


@query
def normalise_text(p: Pipeline) -> DataFrame:
    messy = F.concat(F.lit("  \t"), F.lower("entidad"), F.lit(" \r\n "), F.col("nombre_del_proveedor"), F.lit("\t"))
    return p.raw.select("id", N.normalise_text(messy).alias("text"), N.normalise_text(F.col("nombre_del_proveedor")).alias("supplier"))


def date_texts(day: Column, n: Column) -> Column:
    """A date written in one of ten ways, some of them unreadable."""
    shapes = {
        0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "yyyy/MM/dd", 3: "dd-MM-yyyy", 4: "yyyy-MM-dd'T'HH:mm:ss'Z'",
        5: "d/M/yyyy", 6: "dd/MM/yy", 7: "yyyy-MM-dd' junk'", 8: "yyyy-MM-dd' 23:30:00-05:00'",
    }
    out = F.when(n % 10 == 9, F.lit(" "))
    for k, shape in shapes.items():
        out = out.when(n % 10 == k, F.date_format(day, shape))
    return out


@query
def normalise_date(p: Pipeline) -> DataFrame:
    text = date_texts(F.col("fecha_adjudicacion"), F.col("id"))
    return p.raw.select("id", N.normalise_date(text).alias("day"))


def amount_texts(v: Column, n: Column) -> Column:
    """An amount written in one of eight ways, some of them unreadable."""
    us = F.format_number(v, 2)
    eu = F.translate(us, ",.", ".,")
    return (
        F.when(n % 8 == 0, F.concat(F.lit("$ "), us))
        .when(n % 8 == 1, F.concat(F.lit("COP "), eu))
        .when(n % 8 == 2, F.format_number(v, 0))
        .when(n % 8 == 3, F.translate(v.cast("string"), ".", ","))
        .when(n % 8 == 4, v.cast("string"))
        .when(n % 8 == 5, F.concat(v.cast("string"), F.lit("-"), v.cast("string")))
        .when(n % 8 == 6, F.translate(F.format_number(v, 0), ",", "."))
        .otherwise("invalid")
    )


@query
def normalise_amount(p: Pipeline) -> DataFrame:
    text = amount_texts(F.col("valor_total_adjudicacion"), F.col("id"))
    return p.raw.select("id", N.normalise_amount(text).alias("amount"))


@query
def normalise_url(p: Pipeline) -> DataFrame:
    n = F.col("id")
    key = n.cast("string")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("  https://example.org/"), key, F.lit(" ")))
        .when(n % 5 == 1, F.concat(F.lit('{"url": "https://example.org/'), key, F.lit('"}')))
        .when(n % 5 == 2, F.concat(F.lit("{'href': 'https://example.org/"), key, F.lit("'}")))
        .when(n % 5 == 3, F.lit("  "))
        .otherwise(F.col("urlproceso"))
    )
    return p.raw.select("id", N.normalise_url(text).alias("url"))


@query
def row_hash(p: Pipeline) -> DataFrame:
    return normalise.normalise_contracts(p.raw, testdata.AS_OF).select("id", "row_hash")


@query
def normalise_contract(p: Pipeline) -> DataFrame:
    return normalise.normalise_contracts(p.raw, testdata.AS_OF)


@query
def group_key(p: Pipeline) -> DataFrame:
    return p.contracts.select("id", C.group_key(F.col("method"), F.col("contract_type")).alias("grp"))


@query
def iqr_fences(p: Pipeline) -> DataFrame:
    stats = outliers.group_quartiles(outliers.valid_contracts(p.contracts, "base_price"))
    return stats.select("grp", *[C.round_half_up(F.col(c), 4).alias(c) for c in ("lower", "upper")])


def _outlier_surface(df: DataFrame) -> DataFrame:
    df = df.drop("supplier", "supplier_tax_id")
    rounded = ["value", "q1", "q3", "iqr", "lower", "upper"]
    return df.select(*[C.round_half_up(F.col(c), 4).alias(c) if c in rounded else F.col(c) for c in df.columns])


@query
def classify_outlier(p: Pipeline) -> DataFrame:
    found = outliers.detect_outliers(p.contracts, "base_price", methods=["LICITACIÓN PÚBLICA", "MÍNIMA CUANTÍA"])
    return found.select("contract_id", "is_outlier", "direction", "score")


@query
def repeat_score(p: Pipeline) -> DataFrame:
    days = F.date_diff("awarded_on", "published_on")
    return p.contracts.select("id", C.repeat_score(F.abs(days)).alias("score"))


@query
def repeat_class(p: Pipeline) -> DataFrame:
    days = F.date_diff("awarded_on", "published_on")
    return p.contracts.select("id", C.repeat_class(F.abs(days)).alias("risk_class"))


@query
def direct_flag(p: Pipeline) -> DataFrame:
    return p.contracts.select("id", C.direct_flag(F.col("method")).alias("direct"))


@query
def direct_share(p: Pipeline) -> DataFrame:
    return direct_awards.supplier_awards(p.contracts).select(
        "supplier", "supplier_tax_id", "n_contracts", "n_direct",
        C.direct_share(F.col("n_direct"), F.col("n_contracts")).alias("direct_pct"),
    )


@query
def direct_score_class(p: Pipeline) -> DataFrame:
    share = C.direct_share(F.col("n_direct"), F.col("n_contracts"))
    return direct_awards.supplier_awards(p.contracts).select(
        "supplier", "supplier_tax_id", C.direct_score(share).alias("score"), C.direct_class(share).alias("risk_class")
    )


@query
def combined_score_class(p: Pipeline) -> DataFrame:
    rows = supplier_risk.outlier_contracts(p.latest[0])
    weights = {"OUTLIER": 0.5, "SHORT_REPEAT": 1.25, "DIRECT_AWARD": 3.0}
    scored = supplier_risk.score_risk(supplier_risk.combine_signals(rows, *p.latest[1:]), weights)
    return scored.select("supplier", "final_score", "risk_class")


@query
def confidence_score(p: Pipeline) -> DataFrame:
    return normalise.normalise_contracts(p.raw, testdata.AS_OF).select("id", "confidence")


@query
def quality_flags(p: Pipeline) -> DataFrame:
    flags = ["is_incomplete", "is_suspicious", "n_missing", "missing_fields"]
    return normalise.normalise_contracts(p.raw, testdata.AS_OF).select("id", *flags)


@query
def detect_missing(p: Pipeline) -> DataFrame:
    return normalise.detect_missing(p.raw)


@query
def detect_future_dates(p: Pipeline) -> DataFrame:
    return normalise.detect_future_dates(p.raw, testdata.AS_OF)


@query
def detect_negative_amounts(p: Pipeline) -> DataFrame:
    return normalise.detect_negative_amounts(p.raw)


@query
def day_difference(p: Pipeline) -> DataFrame:
    return p.contracts.select("id", F.date_diff("awarded_on", "published_on").alias("days"))


@query
def sync_duration(p: Pipeline) -> DataFrame:
    return syncs.with_duration(p.history).select("id", "source_id", "seconds")


@query
def duplicate_rate(p: Pipeline) -> DataFrame:
    return syncs.duplicate_rate(p.history).select("id", "inserted", "duplicates", "duplicate_rate")


# --- D: filters ------------------------------------------------------------------------------


@query
def search_contracts(p: Pipeline) -> DataFrame:
    wanted = ContractFilter(
        supplier="customer", method="_irecta", published_from="1996-01-01", published_to="1999-12-31",
        value_min=1000, value_max=90000, confidence_min=20, confidence_max=100,
    )
    return search.search_contracts(p.contracts, wanted, "valor", "asc", page=2, size=40).select(*_SHORT, "total", "total_pages")


@query
def search_contracts_flags(p: Pipeline) -> DataFrame:
    wanted = ContractFilter(buyer="supplier#", status="ado", only_incomplete=True, only_suspicious=True)
    return search.where_all(p.contracts, wanted.conditions()).select(*_SHORT)


@query
def list_incomplete(p: Pipeline) -> DataFrame:
    return p.contracts.where("is_incomplete").select(*_SHORT, "missing_fields")


@query
def list_suspicious(p: Pipeline) -> DataFrame:
    return p.contracts.where("is_suspicious").select(*_SHORT)


@query
def search_issues_of_notice(p: Pipeline) -> DataFrame:
    return search.search_issues(p.issues, raw_id=p.issues.agg(F.min("raw_id")).scalar())


@query
def search_issues(p: Pipeline) -> DataFrame:
    return search.search_issues(p.issues, kind="missing_field", field="tipo_de_contrato")


@query
def base_filters(p: Pipeline) -> DataFrame:
    kept = outliers.base_filters(
        p.contracts, "awarded_on", "1997-06-01", "1999-06-30", methods=["CONTRATACIÓN DIRECTA", "LICITACIÓN PÚBLICA"]
    )
    return kept.select(*_SHORT)


@query
def valid_contracts(p: Pipeline) -> DataFrame:
    return outliers.valid_contracts(p.contracts, since="1996-01-01", method="MÍNIMA CUANTÍA")


@query
def repeat_scope(p: Pipeline) -> DataFrame:
    return repeats.repeat_scope(p.contracts, "1996-01-01", "2000-12-31")


@query
def placeholder_suppliers(p: Pipeline) -> DataFrame:
    # some names are replaced by placeholders, which must not come through
    names = F.array(*[F.lit(n) for n in S.PLACEHOLDER_SUPPLIERS])
    n = F.col("id") % 50
    renamed = F.when(n < 5, F.element_at(names, (n + 1).cast("int"))).otherwise(F.col("supplier"))
    return direct_awards.known_suppliers(p.contracts.withColumn("supplier", renamed)).select("id", "supplier")


@query
def list_outliers(p: Pipeline) -> DataFrame:
    return _outlier_surface(search.list_outliers(p.outlier_results, only_outliers=True, direction="HIGH", min_score=0.25))


@query
def list_repeats(p: Pipeline) -> DataFrame:
    return search.list_repeats(p.repeat_results, risk_class="HIGH", min_score=8.5)


@query
def list_direct_awards(p: Pipeline) -> DataFrame:
    return search.list_direct_awards(p.direct_results, min_score=1.0, max_score=9.5, min_pct=12.5, max_pct=80)


@query
def list_direct_alerts(p: Pipeline) -> DataFrame:
    return search.list_direct_awards(p.direct_results, run_id=NEW_RUN, only_alerts=True)


@query
def list_supplier_risk(p: Pipeline) -> DataFrame:
    found = search.list_supplier_risk(p.risk_results, supplier="customer#0000001", risk_class="MEDIUM", min_score=2.5)
    return found.drop("weights")


@query
def active_sources(p: Pipeline) -> DataFrame:
    return syncs.active_sources(p.sources)


@query
def source_by_name(p: Pipeline) -> DataFrame:
    return syncs.source_by_name(p.sources, "Source 4")


@query
def due_sources(p: Pipeline) -> DataFrame:
    return syncs.due_sources(p.sources, p.history.agg(F.date_trunc("second", F.max("started_at"))).scalar())


@query
def history_by_source(p: Pipeline) -> DataFrame:
    return syncs.history_by_source(p.history, 3)


@query
def text_search(p: Pipeline) -> DataFrame:
    return search.text_search(p.contracts, "r#00000001").select(*_SHORT)


@query
def modified_contracts(p: Pipeline) -> DataFrame:
    return search.modified_contracts(p.contracts, p.earlier_contracts).select(*_SHORT, "status", "base_price")


@query
def high_risk_contracts(p: Pipeline) -> DataFrame:
    return search.high_risk_contracts(p.contracts, p.risk).select(*_SHORT)


@query
def latest_run_(p: Pipeline) -> DataFrame:
    tables = {
        "outliers": p.outlier_results, "repeats": p.repeat_results, "direct_awards": p.direct_results, "supplier_risk": p.risk_results,
    }
    rows = [latest_run(df.runs).withColumn("results", F.lit(name)) for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


# --- E: joins --------------------------------------------------------------------------------


@query
def unprocessed_anti(p: Pipeline) -> DataFrame:
    return normalise.unprocessed(p.raw, _stored_contracts(p)).select("id", "id_del_proceso")


@query
def existing_lookup(p: Pipeline) -> DataFrame:
    known = _stored_contracts(p).select(F.col("raw_id").alias("id"), F.col("row_hash").alias("stored_hash"))
    return p.raw.select("id").join(known, "id", "left")


@query
def conflict_anti(p: Pipeline) -> DataFrame:
    incoming, stored = _arrivals(p)
    return ingest.not_stored(incoming, stored)


@query
def group_stats_join(p: Pipeline) -> DataFrame:
    return _outlier_surface(outliers.detect_outliers(p.contracts)).select("contract_id", "grp", "q1", "q3", "iqr", "lower", "upper")


@query
def outlier_contract_join(p: Pipeline) -> DataFrame:
    return supplier_risk.outlier_contracts(p.latest[0])


@query
def combine_signals_join(p: Pipeline) -> DataFrame:
    rows = supplier_risk.outlier_contracts(p.latest[0])
    return supplier_risk.combine_signals(rows, *p.latest[1:])


@query
def source_name_join(p: Pipeline) -> DataFrame:
    named = syncs.active_sources(p.sources)
    return syncs.with_source_name(p.history, named).select("id", "source_id", "source_name", "state", "fetched")


@query
def source_history_join(p: Pipeline) -> DataFrame:
    return syncs.source_history(p.sources, p.history)


@query
def contract_issues(p: Pipeline) -> DataFrame:
    return search.contract_issues(p.contracts, p.issues).drop("created_at")


# --- F: aggregations -------------------------------------------------------------------------


@query
def group_quartiles(p: Pipeline) -> DataFrame:
    stats = outliers.group_quartiles(outliers.valid_contracts(p.contracts))
    return stats.select("grp", "n", *[C.round_half_up(F.col(c), 4).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


@query
def detect_outliers(p: Pipeline) -> DataFrame:
    return _outlier_surface(outliers.detect_outliers(p.contracts))


@query
def outliers_missing_count(p: Pipeline) -> DataFrame:
    # complete contracts have no missing field, so this field never has anything to analyse
    return _outlier_surface(outliers.detect_outliers(p.contracts, "n_missing"))


@query
def outlier_run_summary(p: Pipeline) -> DataFrame:
    return outliers.run_summary(p.latest[0])


@query
def outlier_group_summary(p: Pipeline) -> DataFrame:
    summary = outliers.group_summary(p.latest[0])
    rounded = ["q1", "q3", "iqr", "lower", "upper"]
    return summary.select(*[C.round_half_up(F.col(c), 4).alias(c) if c in rounded else F.col(c) for c in summary.columns])


@query
def repeat_summary(p: Pipeline) -> DataFrame:
    return repeats.repeat_summary(p.latest[1])


@query
def repeat_by_class(p: Pipeline) -> DataFrame:
    return repeats.count_by_class(p.latest[1])


@query
def detect_direct_awards(p: Pipeline) -> DataFrame:
    return direct_awards.detect_direct_awards(p.contracts)


@query
def detect_direct_awards_wide(p: Pipeline) -> DataFrame:
    return direct_awards.detect_direct_awards(p.contracts, "1996-01-01", "2000-06-30", min_awards=2, span_days=365)


@query
def direct_award_summary(p: Pipeline) -> DataFrame:
    return direct_awards.direct_award_summary(p.latest[2])


@query
def direct_award_by_class(p: Pipeline) -> DataFrame:
    return repeats.count_by_class(p.latest[2])


@query
def supplier_outlier_max(p: Pipeline) -> DataFrame:
    return supplier_risk.supplier_outlier_max(p.latest[0])


@query
def supplier_repeat_max(p: Pipeline) -> DataFrame:
    return supplier_risk.supplier_repeat_max(p.latest[1])


@query
def supplier_direct_max(p: Pipeline) -> DataFrame:
    return supplier_risk.supplier_direct_max(p.latest[2])


@query
def combine_supplier_risk(p: Pipeline) -> DataFrame:
    weights = supplier_risk.read_weights(supplier_risk.default_weights(p.spark))
    return supplier_risk.combine_supplier_risk(*p.latest, weights).drop("weights")


@query
def risk_summary(p: Pipeline) -> DataFrame:
    return supplier_risk.risk_summary(p.risk)


@query
def risk_by_class(p: Pipeline) -> DataFrame:
    return repeats.count_by_class(p.risk)


@query
def quality_metrics(p: Pipeline) -> DataFrame:
    return dashboards.quality_metrics(p.contracts)


@query
def missing_field_ranking(p: Pipeline) -> DataFrame:
    return dashboards.missing_field_ranking(p.issues, p.contracts)


@query
def missing_field_pct(p: Pipeline) -> DataFrame:
    return dashboards.missing_field_pct(p.contracts)


@query
def dashboard_metrics(p: Pipeline) -> DataFrame:
    return dashboards.dashboard_metrics(p.contracts, p.risk)


@query
def top_suppliers(p: Pipeline) -> DataFrame:
    return dashboards.top_suppliers(p.contracts)


@query
def risk_distribution(p: Pipeline) -> DataFrame:
    return dashboards.risk_distribution(p.contracts, p.risk)


def _modified(p: Pipeline) -> DataFrame:
    return search.modified_contracts(p.contracts, p.earlier_contracts)


@query
def anomaly_distribution(p: Pipeline) -> DataFrame:
    return dashboards.anomaly_distribution(p.contracts, p.risk, _modified(p))


@query
def anomaly_share(p: Pipeline) -> DataFrame:
    return dashboards.anomaly_share(p.contracts, p.risk, _modified(p))


@query
def sync_status_counts(p: Pipeline) -> DataFrame:
    return syncs.sync_status_counts(p.history)


@query
def sync_comparison(p: Pipeline) -> DataFrame:
    return syncs.sync_comparison(p.sources, p.history)


@query
def source_kpis(p: Pipeline) -> DataFrame:
    return syncs.source_kpis(p.sources)


# --- G: window functions ---------------------------------------------------------------------


@query
def lag_pairs(p: Pipeline) -> DataFrame:
    pairs = repeats.lag_pairs(repeats.repeat_scope(p.contracts))
    return pairs.select("id", "published_on", "prev_id", "prev_on", "days")


@query
def detect_repeats(p: Pipeline) -> DataFrame:
    return repeats.detect_repeats(p.contracts)


@query
def first_wins_dedupe(p: Pipeline) -> DataFrame:
    return first_wins(_arrivals(p)[0], S.PROCESS_KEY, _ARRIVAL)


@query
def latest_sync_per_source(p: Pipeline) -> DataFrame:
    return syncs.latest_sync_per_source(p.history)


# --- H: sorts, limits, top-k -----------------------------------------------------------------


@query
def sort_allowlist(p: Pipeline) -> DataFrame:
    """First page under each accepted sort name and direction."""
    out = None
    for name in [*S.SORT_FIELDS, "unknown"]:
        for order in ("asc", "desc"):
            rows = search.search_contracts(p.contracts, sort=name, order=order, size=20)
            part = rows.select(F.lit(name).alias("sort_name"), F.lit(order).alias("sort_order"), "id", "total", "total_pages")
            out = part if out is None else out.unionByName(part)
    return out


@query
def paginate_(p: Pipeline) -> DataFrame:
    order = search.order_columns("supplier", descending=True)
    return paginate(p.contracts, order, page=3, size=25).select(*_SHORT, "total", "total_pages")


@query
def list_contracts(p: Pipeline) -> DataFrame:
    return search.search_contracts(p.contracts, sort="id", order="asc").select(*_SHORT, "total", "total_pages")


@query
def list_issues(p: Pipeline) -> DataFrame:
    return search.list_issues(p.issues, page=2)


@query
def list_normalise_runs(p: Pipeline) -> DataFrame:
    order = [F.desc_nulls_first("started_at"), F.asc("id")]
    return paginate(p.normalise_runs, order, page=1, size=20)


@query
def order_outliers(p: Pipeline) -> DataFrame:
    rows = _outlier_surface(search.list_outliers(p.outlier_results))
    return paginate(rows, search.order_outliers(), page=2)


@query
def order_repeats(p: Pipeline) -> DataFrame:
    return paginate(search.list_repeats(p.repeat_results), search.order_repeats(), page=1)


@query
def order_direct(p: Pipeline) -> DataFrame:
    return paginate(search.list_direct_awards(p.direct_results), search.order_direct(), page=2)


@query
def order_risk(p: Pipeline) -> DataFrame:
    return paginate(search.list_supplier_risk(p.risk_results).drop("weights"), search.order_risk(), page=1)


@query
def top_missing_fields(p: Pipeline) -> DataFrame:
    return dashboards.top_missing_fields(p.issues, p.contracts)


@query
def recent_syncs(p: Pipeline) -> DataFrame:
    return syncs.recent_syncs(p.history)


@query
def autocomplete(p: Pipeline) -> DataFrame:
    return search.autocomplete(p.contracts, "r#0000000")


# --- I: set operations -----------------------------------------------------------------------


@query
def supplier_universe(p: Pipeline) -> DataFrame:
    rows = supplier_risk.outlier_contracts(p.latest[0])
    return supplier_risk.supplier_universe(rows, *p.latest[1:])


@query
def upsert_merge(p: Pipeline) -> DataFrame:
    merged = normalise.upsert_merge(_actions(p), _stored_contracts(p))
    return merged.select("raw_id", "row_hash", "status", "base_price")


@query
def upsert_by_parts(p: Pipeline) -> DataFrame:
    """The stored table after an upsert that rewrites only the parts it touches."""
    store = PartStore(p.spark, scratch_path(p.spark, "contracts"), "raw_id", part_rows=2000)
    stored = _stored_contracts(p)
    store.write({"contracts": stored.select(*[F.col(f.name).cast(f.dataType) for f in p.contracts.schema])}, "first")
    actions = normalise.decide(p.contracts, stored)
    changed = settle(actions.where("action <> 'skip'").select("raw_id"), "changed")
    store.write({"contracts": p.contracts.join(changed, "raw_id", "left_semi").select(*p.contracts.columns)}, "second", changed)
    return store.read("contracts", p.contracts.schema).select("raw_id", "row_hash", "status", "base_price")


# --- J: incremental ingest -------------------------------------------------------------------


_LANDED = ["id_del_proceso", "entidad", "precio_base", "fecha_adjudicacion", "nit_entidad"]


def _land(rows: DataFrame, landing: str, fmt: str = "JSON", compression: str = "none") -> None:
    """Many landed files per call; all copies of a key lie in one of them, so that their order of arrival is known."""
    key = F.when(F.col("id_del_proceso").isNull(), F.xxhash64(*_LANDED)).otherwise(F.xxhash64("id_del_proceso"))
    files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    options = {"JSON": {}, "CSV": {"header": True, "quote": '"', "escape": '"'}, "XML": {"rootTag": "rows", "rowTag": "row"}}[fmt]
    dealt = rows.select(*_LANDED).repartition(files, key).sortWithinPartitions(*_LANDED)
    dealt.write.mode("append").format(fmt.lower()).options(**options, compression=compression).save(landing)


def _streamed(p: Pipeline, splits: list[tuple[int, Column, str]]) -> DataFrame:
    """Land and take in the notices of each split in turn, with a checkpoint per source."""
    target = scratch_path(p.spark, "stored")
    places = {s: (scratch_path(p.spark, "landing"), scratch_path(p.spark, "offsets")) for s, _, _ in splits}
    for source, condition, fmt in splits:
        landing, checkpoint = places[source]
        _land(p.arriving.where(condition), landing, fmt, "gzip")
        stream_ingest(p.spark, landing, target, checkpoint, source, fmt).awaitTermination()
    return stored_notices(p.spark, target).select("fuente_id", "batch", *_LANDED)


@query
def stream_ingest_(p: Pipeline) -> DataFrame:
    """Two landings of one source, the second overlapping the first; what is stored of each."""
    return _streamed(p, [(1, F.col("fecha_adjudicacion") < "1998-01-01", "JSON"), (1, F.lit(True), "JSON")])


@query
def stream_ingest_csv(p: Pipeline) -> DataFrame:
    """The same with CSV files."""
    return _streamed(p, [(1, F.col("fecha_adjudicacion") < "1998-01-01", "CSV"), (1, F.lit(True), "CSV")])


@query
def stream_ingest_xml(p: Pipeline) -> DataFrame:
    """The same with XML files."""
    return _streamed(p, [(1, F.col("fecha_adjudicacion") < "1998-01-01", "XML"), (1, F.lit(True), "XML")])


@query
def stream_ingest_two_sources(p: Pipeline) -> DataFrame:
    """Two sources of different formats with overlapping keys fill one store, each with its own checkpoint."""
    late = F.col("fecha_adjudicacion") >= "1997-01-01"
    return _streamed(p, [(1, F.col("fecha_adjudicacion") < "1998-01-01", "JSON"), (2, late, "CSV")])


@query
def sync_counts(p: Pipeline) -> DataFrame:
    """One synchronisation with a window, undated notices and unreadable values, through the job's path."""
    landing, target = scratch_path(p.spark, "landing"), scratch_path(p.spark, "stored")
    bad = F.when(F.col("id") % 61 == 0, "n/a").otherwise(F.col("precio_base").cast("string"))
    columns = ["id_del_proceso", "fecha_de_publicacion_del", "entidad"]
    p.arriving.select(*columns, bad.alias("precio_base")).write.options(**_LANDED_AS).json(landing)
    counts = add_batch(scan_notices(p.spark, landing, "JSON"), target, 1, "sync", 0, "1995-01-01", "1998-12-31")
    return p.spark.createDataFrame([counts]).select(*[F.col(c).cast("long") for c in sorted(counts)])
