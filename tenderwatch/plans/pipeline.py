"""The batch pipeline and its stored tables.

Each table is built once per session from the tables before it and written to the shared
folder; queries read the stored tables, as they would in production.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderwatch.operators import direct_awards, normalise, outliers, repeats, supplier_risk
from tenderwatch.operators.runs import Results, append_run, read_results, rows_of_run, stamp_run
from tenderwatch.sources import testdata
from tenderwatch.sources.storage import scratch_path, settle

# Two runs per detector: an older one over contracts published before 1998, and the latest.
OLD_RUN, NEW_RUN = "run-1", "run-2"
OLD_TIME, NEW_TIME = "2001-01-01 08:00:00", "2001-01-02 08:00:00"
OLD_UNTIL = "1997-12-31"


class Pipeline:
    """Tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def _once(self, name: str, build: Callable[[], DataFrame | Results]) -> DataFrame | Results:
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: settle(build(), name))

    # --- ingest and normalise ---------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        return testdata.read(self.spark, self.sf_dir, table)

    @property
    def raw(self) -> DataFrame:
        # in order of their ids, neighbours repeat more and pack tighter, as do contracts made of them
        return self._stored(
            "raw_notices", lambda: testdata.raw_notices(self.spark, self.sf_dir).sortWithinPartitions("id")
        )

    @property
    def arriving(self) -> DataFrame:
        return self._stored("arriving", lambda: testdata.arriving_notices(self.spark, self.sf_dir))

    @property
    def contracts(self) -> DataFrame:
        return self._stored(
            "contracts", lambda: normalise.normalise_contracts(self.raw, testdata.AS_OF)
        )

    @property
    def earlier_contracts(self) -> DataFrame:
        """Snapshot of an older state of the notices.

        A narrow projection of the stored notices that few columns are read of, so it is not stored.
        """
        return self._once(
            "earlier_contracts",
            lambda: normalise.normalise_contracts(testdata.earlier_notices(self.raw), testdata.AS_OF),
        )

    @property
    def issues(self) -> DataFrame:
        def build() -> DataFrame:
            found = normalise.record_issues(self.raw, testdata.AS_OF)
            return found.withColumn("created_at", F.lit(NEW_TIME).cast("timestamp"))

        return self._stored("record_issues", build)

    # --- detector runs ----------------------------------------------------------------------

    def _runs(self, name: str, old: DataFrame, new: DataFrame) -> Results:
        path = scratch_path(self.spark, name)
        append_run(old, path, OLD_RUN, OLD_TIME)
        append_run(new, path, NEW_RUN, NEW_TIME)
        return read_results(self.spark, path, stamp_run(new, NEW_RUN, NEW_TIME).schema)

    @property
    def outlier_results(self) -> Results:
        detect = outliers.detect_outliers
        return self._once(
            "outlier_results",
            lambda: self._runs(
                "outlier_results",
                detect(self.contracts, "base_price", until=OLD_UNTIL),
                detect(self.contracts),
            ),
        )

    @property
    def repeat_results(self) -> Results:
        detect = repeats.detect_repeats
        return self._once(
            "repeat_results",
            lambda: self._runs(
                "repeat_results", detect(self.contracts, until=OLD_UNTIL), detect(self.contracts)
            ),
        )

    @property
    def direct_results(self) -> Results:
        detect = direct_awards.detect_direct_awards
        return self._once(
            "direct_results",
            lambda: self._runs(
                "direct_results", detect(self.contracts, until=OLD_UNTIL), detect(self.contracts)
            ),
        )

    @property
    def latest(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Latest outlier, repeat and direct-award results."""
        return (
            rows_of_run(self.outlier_results),
            rows_of_run(self.repeat_results),
            rows_of_run(self.direct_results),
        )

    @property
    def risk_results(self) -> Results:
        def score(weights: dict[str, float]) -> DataFrame:
            return supplier_risk.combine_supplier_risk(*self.latest, weights)

        even = {"OUTLIER": 1.0, "SHORT_REPEAT": 1.0, "DIRECT_AWARD": 1.0}
        defaults = supplier_risk.read_weights(supplier_risk.default_weights(self.spark))
        return self._once(
            "risk_results", lambda: self._runs("risk_results", score(even), score(defaults))
        )

    @property
    def risk(self) -> DataFrame:
        return rows_of_run(self.risk_results)

    # --- sources ----------------------------------------------------------------------------

    @property
    def sources(self) -> DataFrame:
        return self._stored("sources", lambda: testdata.sources(self.spark, self.sf_dir))

    @property
    def history(self) -> DataFrame:
        return testdata.sync_history(self.spark, self.sf_dir)

    @property
    def normalise_runs(self) -> DataFrame:
        return testdata.normalise_runs(self.spark, self.sf_dir)


_PIPELINES: dict[tuple[str, str], Pipeline] = {}


def pipeline(spark: SparkSession, sf_dir: str) -> Pipeline:
    """The pipeline of this session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PIPELINES:
        _PIPELINES[key] = Pipeline(spark, sf_dir)
    return _PIPELINES[key]
