"""The jobs behind the service operations: sync, normalise, three detectors, combined risk.

``Monitor`` keeps all tables under one root folder. Each job reads stored tables, writes its
result once and returns a one-row summary; only such summaries reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch import schemas as S
from tenderwatch.operators import direct_awards, ingest, normalise, outliers, repeats, search, supplier_risk, syncs
from tenderwatch.operators.runs import Results, append_run, read_results, resolve_run, rows_of_run
from tenderwatch.sources.manifest import Manifest
from tenderwatch.sources.part_store import PartStore
from tenderwatch.sources.readers import scan_notices
from tenderwatch.sources.storage import scratch, settle
from tenderwatch.streaming.ingest import add_batch, batches, rejects, stored_notices

#: batches since the last run that are named one by one in a plan
_NAMED_BATCHES = 1000
_RUN = "run_id string, computed_at timestamp"
RESULT_SCHEMAS = {
    "outlier_results": f"""contract_id bigint, grp string, field string, value double, q1 double, q3 double, iqr double,
        lower double, upper double, is_outlier boolean, direction string, score double, supplier string,
        supplier_tax_id string, {_RUN}""",
    "repeat_results": f"""contract_id bigint, related_id bigint, supplier string, buyer string, contract_type string,
        method string, contract_date date, related_date date, days int, score double, risk_class string, {_RUN}""",
    "direct_award_results": f"""contract_id bigint, supplier string, supplier_tax_id string, buyer string, contract_type string,
        method string, contract_date date, n_contracts bigint, n_direct bigint, direct_pct double, score double,
        risk_class string, {_RUN}""",
    "supplier_risk": f"""supplier string, supplier_tax_id string, max_outlier double, max_repeat double, direct_score double,
        final_score double, risk_class string, weights map<string,double>, {_RUN}""",
}
HISTORY_SCHEMA = """id string, source_id int, started_at timestamp, ended_at timestamp, fetched bigint, inserted bigint,
    duplicates bigint, rejected bigint, outside bigint, bad_values bigint, since string, until string, state string,
    error string"""
SOURCE_SCHEMA = """id int, name string, kind string, format string, endpoint string, every_days bigint, active boolean,
    last_sync timestamp"""
LOG_SCHEMA = """id string, n_evaluated bigint, n_processed bigint, n_skipped bigint, n_issues bigint, started_at timestamp,
    ended_at timestamp, seconds bigint, forced boolean, state string, error string"""
ISSUE_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("raw_id", "contract_id")]
    + [T.StructField(n, T.StringType()) for n in ("kind", "field", "original_value", "description")]
    + [T.StructField("created_at", T.TimestampType())]
)


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Monitor:
    """Stored tables and the jobs that fill them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.store = PartStore(spark, f"{self.root}/contracts_store", "raw_id")

    # --- tables -----------------------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    @property
    def raw_notices(self) -> DataFrame:
        return stored_notices(self.spark, f"{self.root}/raw_notices")

    @property
    def contracts(self) -> DataFrame:
        return self.store.read("contracts", S.CONTRACT_SCHEMA)

    @property
    def issues(self) -> DataFrame:
        return self.store.read("issues", ISSUE_SCHEMA)

    @property
    def rejects(self) -> DataFrame:
        """Values that could not be read, and undated notices that a window could not place."""
        return rejects(self.spark, f"{self.root}/raw_notices")

    def results(self, name: str) -> Results:
        return read_results(self.spark, f"{self.root}/{name}", T.StructType.fromDDL(RESULT_SCHEMAS[name]))

    @property
    def sources(self) -> DataFrame:
        """Registered sources, with the end of their last successful synchronisation."""
        table = self._table("sources", f"{SOURCE_SCHEMA}, updated_at timestamp")
        columns = T.StructType.fromDDL(SOURCE_SCHEMA).fieldNames()
        newest = table.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "updated_at").alias("s")).select("id", "s.*")
        return syncs.watermarks(newest, self.sync_history).select(*columns)

    def add_source(self, source_id: int, name: str, fmt: str, endpoint: str, every_days: int = 15, active: bool = True) -> None:
        """Register a source, or change one."""
        row = (source_id, name, "OPEN_DATA", fmt.upper(), endpoint, every_days, active, None, _now())
        self.spark.createDataFrame([row], f"{SOURCE_SCHEMA}, updated_at timestamp").write.mode("append").parquet(f"{self.root}/sources")

    @property
    def sync_history(self) -> DataFrame:
        return self._table("sync_history", HISTORY_SCHEMA)

    @property
    def normalise_runs(self) -> DataFrame:
        return self._table("normalise_runs", LOG_SCHEMA)

    def _log(self, name: str, schema: str, **values: object) -> Row:
        columns = T._parse_datatype_string(schema).fieldNames()
        row = self.spark.createDataFrame([[values.get(c) for c in columns]], schema)
        row.write.mode("append").parquet(f"{self.root}/{name}")
        return row.first()

    # --- ingest -----------------------------------------------------------------------------

    def sync_source(
        self,
        source_id: int,
        path: str,
        fmt: str,
        since: date | str | None = None,
        until: date | str | None = None,
        **reading: bool,
    ) -> Row:
        """Read one source, insert what is new, and log where every fetched notice went.

        Without ``since`` and ``until`` nothing is left out. Each synchronisation is a writer of its
        own, so two at a time can't overwrite each other.
        """
        started, counts = _now(), {}
        state, error = S.SYNC_OK, None
        try:
            landed = scan_notices(self.spark, path, fmt, **reading)
            writer = f"sync-{source_id}-{uuid.uuid4().hex}"
            counts = add_batch(landed, f"{self.root}/raw_notices", source_id, writer, 0, since, until)
        except Exception as failure:
            state, error = S.SYNC_ERROR, str(failure)
        names = ("fetched", "inserted", "duplicates", "rejected", "outside", "bad_values")
        row = self._log(
            "sync_history", HISTORY_SCHEMA, id=str(uuid.uuid4()), source_id=source_id, started_at=started, ended_at=_now(),
            since=str(since) if since else None, until=str(until) if until else None, state=state, error=error,
            **{n: counts.get(n, 0) for n in names},
        )
        if error:
            raise RuntimeError(f"synchronisation failed: {error}")
        return row

    def sync_due(self, now: datetime | str | None = None) -> dict[int, str]:
        """Synchronise every due source from the day of its last success; returns their states.

        A source that fails is logged and leaves the others alone. Sources are few: they are listed
        by hand.
        """
        moment = now or _now().strftime("%Y-%m-%d %H:%M:%S")
        states = {}
        for s in syncs.due_sources(self.sources, moment).orderBy("id").collect():
            since = s["last_sync"].date() if s["last_sync"] else None
            try:
                states[s["id"]] = self.sync_source(s["id"], s["endpoint"], s["format"], since)["state"]
            except RuntimeError:
                states[s["id"]] = S.SYNC_ERROR
        return states

    def test_source(self, path: str, fmt: str, **reading: bool) -> Row:
        """Whether a source can be read and holds anything: ``ok, message, n_sample``."""
        try:
            return ingest.source_sample(scan_notices(self.spark, path, fmt, **reading)).first()
        except Exception as failure:
            return Row(ok=False, message=str(failure), n_sample=0)

    def last_sync(self, source_id: int) -> datetime | None:
        """End of the latest successful sync; the next window starts on that day."""
        done = self.sync_history.where((F.col("source_id") == source_id) & (F.col("state") == S.SYNC_OK))
        return done.agg(F.max("ended_at")).first()[0]

    # --- normalise --------------------------------------------------------------------------

    def normalise(self, as_of: date | str, force: bool = False) -> Row:
        """Turn notices into contracts and issues.

        Without ``force`` only batches of notices that no earlier run has covered are read, and their
        rows are appended. With it everything is judged again; new and changed contracts and their
        issues are written with the parts of the tables that held them, and all other parts stay.
        """
        started, run = _now(), str(uuid.uuid4())
        try:
            with scratch(self.spark):
                counts = self._normalise(as_of, force, run, started)
        except Exception as failure:
            self._log(
                "normalise_runs", LOG_SCHEMA, id=run, started_at=started, ended_at=_now(), forced=force,
                seconds=int((_now() - started).total_seconds()), state=S.SYNC_ERROR, error=str(failure),
            )
            raise
        ended = _now()
        return self._log(
            "normalise_runs", LOG_SCHEMA, id=run, started_at=started, ended_at=ended, forced=force, state=S.SYNC_OK,
            seconds=int((ended - started).total_seconds()), **counts.asDict(),
        )

    @property
    def _covered(self) -> Manifest:
        """Batches whose notices are all in the current contracts."""
        return Manifest(self.spark, f"{self.root}/normalised_batches", "writer string, batch bigint, run string")

    def _listed_batches(self) -> DataFrame:
        return batches(self.spark, f"{self.root}/raw_notices").rows().select("writer", "batch")

    def _uncovered(self, listed: DataFrame) -> DataFrame:
        return listed.join(self._covered.rows(), ["writer", "batch"], "left_anti").select("writer", "batch")

    def new_notices(self) -> DataFrame:
        """Notices of batches that no run has covered."""
        return self._notices_of(self._uncovered(self._listed_batches()))

    def _notices_of(self, chosen: DataFrame) -> DataFrame:
        """Notices of some batches: a choice of folders, no join of notices.

        Where there are very many batches, Spark chooses the folders by a join.
        """
        names = [(r["writer"], r["batch"]) for r in chosen.limit(_NAMED_BATCHES + 1).collect()]
        if not names:
            return self.raw_notices.limit(0)
        rows = self.spark.read.schema(self.raw_notices.schema).parquet(f"{self.root}/raw_notices")
        if len(names) > _NAMED_BATCHES:
            return rows.join(settle(chosen, "chosen-batches"), ["writer", "batch"], "left_semi").select(*rows.columns)
        wanted = F.struct("writer", "batch").isin([F.struct(F.lit(w), F.lit(b).cast("bigint")) for w, b in names])
        return rows.where(F.col("writer").isin([w for w, _ in names]) & wanted)

    def _normalise(self, as_of: date | str, force: bool, run: str, started: datetime) -> Row:
        listed = settle(self._listed_batches(), "listed")  # batches that come later are for the next run
        changed = None
        if force:
            notices = self._notices_of(listed)
            actions = settle(normalise.decide(normalise.normalise_contracts(notices, as_of), self.contracts), "actions")
            changed = settle(actions.where("action <> 'skip'").select("raw_id"), "changed")
            notices = settle(notices.join(changed.withColumnRenamed("raw_id", "id"), "id", "left_semi"), "notices")
        else:  # notices of new batches have no contract yet
            notices = settle(self._notices_of(self._uncovered(listed)), "notices")
            actions = notices.select(F.col("id").alias("raw_id"), F.lit("insert").alias("action"))
        stamp = F.lit(started.replace(tzinfo=None)).cast("timestamp")
        issues = settle(normalise.record_issues(notices, as_of).withColumn("created_at", stamp), "issues")
        counts = normalise.normalise_counts(actions, issues).first()
        if counts["n_processed"]:
            tables = {"contracts": normalise.normalise_contracts(notices, as_of), "issues": issues}
            self.store.write(tables, run, changed)
        self._covered.rewrite(listed.withColumn("run", F.lit(run)))
        return counts

    # --- detectors --------------------------------------------------------------------------

    def _run(self, name: str, rows: DataFrame) -> str:
        run = str(uuid.uuid4())
        columns = T._parse_datatype_string(RESULT_SCHEMAS[name]).fieldNames()
        kept = [c for c in columns if c not in ("run_id", "computed_at")]
        append_run(rows.select(*kept), f"{self.root}/{name}", run, _now().strftime("%Y-%m-%d %H:%M:%S.%f"))
        return run

    def run_outliers(self, field: str = "total_value", **filters: object) -> str:
        with scratch(self.spark):
            return self._run("outlier_results", outliers.detect_outliers(self.contracts, field, **filters))

    def run_repeats(self, since: date | str | None = None, until: date | str | None = None) -> str:
        with scratch(self.spark):
            return self._run("repeat_results", repeats.detect_repeats(self.contracts, since, until))

    def run_direct_awards(self, **limits: object) -> str:
        with scratch(self.spark):
            return self._run("direct_award_results", direct_awards.detect_direct_awards(self.contracts, **limits))

    def run_risk(self) -> str:
        """Combine the latest run of each detector with the current weights."""
        latest = [rows_of_run(self.results(n)) for n in ("outlier_results", "repeat_results", "direct_award_results")]
        weights = supplier_risk.read_weights(self.weights)
        return self._run("supplier_risk", supplier_risk.combine_supplier_risk(*latest, weights))

    # --- weights ----------------------------------------------------------------------------

    @property
    def weights(self) -> DataFrame:
        """Current weight per signal; defaults where none was set."""
        table = self._table("signal_weights", "signal string, weight decimal(5,2), updated_at timestamp")
        current = table.groupBy("signal").agg(F.max_by("weight", "updated_at").alias("weight"))
        return supplier_risk.seed_weights(current)

    def set_weight(self, signal: str, weight: float) -> None:
        changed = supplier_risk.update_weight(self.weights, signal, weight).where(F.col("signal") == signal.upper())
        stamp = F.lit(_now().strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        changed.withColumn("updated_at", stamp).write.mode("append").parquet(f"{self.root}/signal_weights")

    # --- pages ------------------------------------------------------------------------------

    def page(self, name: str, page: int = 1, size: int = 50, run_id: str | None = None, **filters: object) -> DataFrame:
        """One page of a result table; the latest run unless one is named. No run at all is an error."""
        listing: dict[str, tuple[Callable[..., DataFrame], Callable[[], list]]] = {
            "outlier_results": (search.list_outliers, search.order_outliers),
            "repeat_results": (search.list_repeats, search.order_repeats),
            "direct_award_results": (search.list_direct_awards, search.order_direct),
            "supplier_risk": (search.list_supplier_risk, search.order_risk),
        }
        rows, order = listing[name]
        run_id = resolve_run(self.results(name), run_id)
        return search.paginate(rows(self.results(name), run_id, **filters), order(), page, size)
