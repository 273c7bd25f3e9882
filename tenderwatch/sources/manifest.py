"""A small table that is replaced as a whole: what has been completed so far.

Every change writes a new version folder of one file, from the version before; readers take the
newest complete one. A version that is there already means that somebody else wrote meanwhile: the
change fails, its output stays unlisted, and the job can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tenderwatch.sources.storage import children, exists, remove

#: older versions that stay for readers that have just begun
KEPT = 3


class Manifest:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema)

    def _versions(self) -> list[int]:
        """Complete versions, in order."""
        names = [n for n in children(self.spark, self.path) if n.startswith("v=")]
        found = sorted(int(n[2:]) for n in names)
        return [v for v in found if exists(self.spark, f"{self.path}/v={v}/_SUCCESS")]

    def rows(self) -> DataFrame:
        """All entries, one row each."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}")

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        return max(self._versions(), default=0)

    def rewrite(self, rows: DataFrame, after: int | None = None) -> None:
        """Exactly these rows from now on. ``after`` as in ``put``."""
        versions = self._versions()
        self._unchanged(versions, after)
        self._write(rows.select(*self.schema.fieldNames()), versions)

    def _unchanged(self, versions: list[int], after: int | None) -> None:
        if after is not None and after != (versions[-1] if versions else 0):
            raise RuntimeError(f"another job has changed {self.path} meanwhile; repeat this one")

    def _write(self, rows: DataFrame, versions: list[int]) -> None:
        current = versions[-1] if versions else 0
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/v={current + 1}")
        for v in versions[:-KEPT]:
            remove(self.spark, f"{self.path}/v={v}")

    def put(self, entry: dict[str, object], key: list[str], after: int | None = None) -> None:
        """Add an entry, in place of one with the same ``key``.

        ``after`` is the version that the job has read: if another one has come since, it fails.
        """
        versions = self._versions()
        self._unchanged(versions, after)
        new = self.spark.createDataFrame([[entry[f.name] for f in self.schema.fields]], self.schema)
        kept = self.rows().join(new.select(*key), key, "left_anti").select(*self.schema.fieldNames())
        self._write(kept.unionByName(new), versions)
