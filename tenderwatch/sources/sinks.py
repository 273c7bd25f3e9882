"""CSV export and monthly layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what spreadsheets tell UTF-8 by, at the start of every exported file
BYTE_ORDER_MARK = "\ufeff"


def export_csv(rows: DataFrame, path: str) -> None:
    """Semicolon CSV, every field quoted, quotes doubled, NULL as an empty field.

    Written in parallel, one file per partition that holds rows; each begins with a byte-order mark
    and a header. The writer of CSV has no way to put a mark before the quote of the first header, so
    lines are made here and written as text: the first of a partition carries mark and header. Without
    any row there is one file of a header.
    """

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    spark = rows.sparkSession
    names = ['"' + name.replace('"', '""') + '"' for name in rows.columns]
    head = BYTE_ORDER_MARK + ";".join(names)
    fields = [quoted(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) for name in rows.columns]
    # the low 33 bits count the rows of a partition
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = rows.select(F.concat(F.when(first, F.lit(head + "\n")).otherwise(F.lit("")), F.concat_ws(";", *fields)).alias("value"))
    if rows.isEmpty():
        lines = spark.createDataFrame([(head,)], "value string").coalesce(1)
    lines.write.options(maxRecordsPerFile=0).format("text").save(path)


def write_by_month(rows: DataFrame, path: str, column: str) -> None:
    """Parquet partitioned by month of ``column``, so date ranges prune whole folders.

    The rebalance hint lets adaptive execution join small months and split large ones.
    """
    month = F.date_format(column, "yyyy-MM").alias("published_month")
    balanced = rows.select("*", month).hint("rebalance", "published_month")
    balanced.write.mode("append").partitionBy("published_month").parquet(path)
