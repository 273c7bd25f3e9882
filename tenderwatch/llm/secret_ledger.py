"""Secret scans over an incremental blob ledger.

Every text is a blob named by the SHA-256 of its bytes; many paths (documents, or versions of one)
may lead to a blob. The ledger is a stored table with one row per blob and version of a rule, which
holds the spans found, none included. A scan reads only the blobs that some current rule version
has not seen, each once however many paths lead to it, appends the outcome, and joins findings
back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderwatch.sources.storage import settle


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group that must be long enough, and its least length."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


# The base rules, in the order they are listed in. A run of one class of characters is
# matched whole, so its least length can stand in the pattern; that of a group can't, since a match
# that is too short still hides what lies inside it.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

LEDGER = "blob string, rule string, spans array<struct<start:long,end:long>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: leftmost, not overlapping, code points from 0, end exclusive.

    Matches come out in order, and so does the text between them, so a start is the length of all
    that lies before. Matches whose group is too short are dropped afterwards: they still hide
    later matches inside them.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    long_enough = F.exists(group, lambda g: F.length(g) >= rule.least)
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), group.alias("part"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        kept = F.length(x["part"]) >= rule.least
        return F.struct(
            F.coalesce(end, start).cast("long").alias("at"),
            F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<start:long,end:long>>")
    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.when(long_enough, F.aggregate(parts, first, step, lambda s: s["spans"])).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger under ``path``; a first scan finds none there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Bring the ledger up to date and return the stored ``doc_id, blob`` of every row.

    Blob and rule pairs that the ledger has are left out, and of all paths to a blob one is read
    again for its text. A scan repeated after a failure finds what was appended and skips it.
    """
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    paths = settle(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("path"))
    unseen = (
        blobs.withColumn("rule", F.explode(F.array(*map(F.lit, keys))))
        .join(read_ledger(spark, ledger).select("blob", "rule"), ["blob", "rule"], "left_anti")
        .groupBy("blob", "path")
        .agg(F.collect_set("rule").alias("rules"))
    )
    todo = settle(unseen, "unseen")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), blob_of(F.col("text")).alias("of"))
    found = texts.join(todo, F.col("doc_id").eqNullSafe(F.col("path")) & (F.col("of") == F.col("blob"))).select(
        "blob",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r.key).alias("rule"),
                        F.when(F.array_contains("rules", r.key), _spans(F.col("text"), r)).alias("spans"),
                    )
                    for r in rules
                ]
            )
        ).alias("x"),
    )
    # A path that occurs in several rows has been scanned for each: one outcome is appended.
    outcome = found.where("x.spans IS NOT NULL").groupBy("blob", "x.rule").agg(F.first("x.spans").alias("spans"))
    outcome.write.mode("append").parquet(ledger)
    return paths


def findings(paths: DataFrame, ledger: str, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """``doc_id, blob`` and one array of spans per rule's kind, for every path."""
    known = read_ledger(paths.sparkSession, ledger)
    hits = known.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    per_blob = hits.groupBy("blob").agg(
        *[F.first(F.when(F.col("rule") == r.key, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules]
    )
    # Stored first: small findings are then broadcast, and the rows of a blob that very many paths
    # share can be split, which they can't where the join takes over the aggregate's partitioning.
    per_blob = settle(per_blob, "findings")
    none = F.array().cast("array<struct<start:long,end:long>>")
    joined = paths.join(per_blob, "blob", "left")
    return joined.select("doc_id", "blob", *[F.coalesce(r.kind, none).alias(r.kind) for r in rules])


def listed(rules: Sequence[Rule] = BASE_RULES) -> Column:
    """``kind:start:end`` of all spans, by start and then by the order of the rules, joined by commas."""

    def marked(kind: str, place: int) -> Column:
        return F.transform(
            kind, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("kind"), x["end"].alias("end"))
        )

    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.array_sort(F.concat(*[marked(r.kind, i) for i, r in enumerate(rules)]))
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ","
    )


def find_secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row, from its whole text.

    NULL text counts as empty. Equal texts are one blob, scanned once; repeated rows and NULL ids
    come back as they are. An empty table gives an empty result; other columns are never read.
    """
    found = findings(scan(docs, ledger), ledger).withColumn("spans", listed())
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


def redact(docs: DataFrame, ledger: str, mark: str = "[secret]", length: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all other columns as they were.

    ``length`` may name a column that holds the text's length and is to follow it.

    Texts without a finding pass unchanged, as do all their columns. Findings overlap where rules do, so what is cut out is
    their union.
    """
    found = findings(scan(docs, ledger), ledger)
    spans = F.array_sort(F.concat(*[F.col(r.kind) for r in BASE_RULES])).alias("_tw_spans")
    hits = found.select("blob", spans).where(F.size("_tw_spans") > 0).dropDuplicates(["blob"])

    def cut(state: Column, x: Column) -> Column:
        start, end = x["start"], x["end"]
        gap = F.when(start >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, start - state["at"]), F.lit(mark)))
        return F.struct(
            F.greatest(state["at"], end).cast("long").alias("at"),
            F.concat(state["out"], F.coalesce(gap, F.lit(""))).alias("out"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(
        "_tw_spans",
        first,
        cut,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    clean = F.when(F.col("_tw_spans").isNull(), F.col("text")).otherwise(rest)
    marked = docs.withColumn("_tw_blob", blob_of(F.col("text")))
    joined = marked.join(hits.withColumnRenamed("blob", "_tw_blob"), "_tw_blob", "left")
    # Two steps: beside a new column of the same name, a lambda would see the new one.
    cleaned = joined.withColumn("_tw_clean", clean)
    new = {"text": F.col("_tw_clean")}
    if length:
        follows = F.length("_tw_clean").cast(docs.schema[length].dataType)
        new[length] = F.when(F.col("_tw_spans").isNull(), F.col(f"`{length}`")).otherwise(follows)
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
