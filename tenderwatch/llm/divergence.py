"""Audit of sources: how far their words stray from each other and from their language.

Every text is cut into terms once, in Python, with counts per language, source and term summed up
in each task; from there on it is DataFrame work. Shares are integers, so all arithmetic is exact.

The terms that set a source apart come from a dominance skyband: a term's value rises with its count
in the source and falls with its count in the language, and ties go to the earlier term. So a term
that ``TOP`` others beat or equal in both counts and precede in UTF-8 order can't be among the first
``TOP``. Each partition keeps its own skyband; these are merged, and what is left is ranked exactly.

Sums over pairs of sources need only the terms that a source has. Where it has none its share is the
same for all terms, so these are counted; where both have the term, a join by term corrects the sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, in_python
from tenderwatch.sources.storage import settle

#: documents of a language that must hold a term
LEAST_DOCUMENTS = 10
#: terms listed per group
TOP = 10
#: share of a whole, in integers
UNIT = 1_000_000_000
#: different terms a task holds before it hands its counts on
HELD_TERMS = 400_000
#: rows that a group gathers before its skyband is taken again
_GATHERED = 4096
#: partial skybands that one task merges at most, about
_FAN_IN = 32

#: A-Z to a-z; every other ASCII sign but a-z to a blank; all bytes of other letters stay
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The runs of ASCII letters and non-ASCII characters in a UTF-8 text, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _table(lang: str, source: str, counts: Counter, documents: Counter) -> pa.RecordBatch:
    """The counts of one group. A row with an empty term says that the group occurs."""
    found = [b"", *counts]
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * n, pa.string()),
            pa.array([source] * n, pa.string()),
            pa.array(found, pa.binary()).cast(pa.string()),
            pa.array([0, *counts.values()], pa.int64()),
            pa.array([0, *(documents[t] for t in counts)], pa.int64()),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Batches) -> Batches:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            found = terms(text.as_py())
            counts, documents = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(counts)
            counts.update(found)
            documents.update(set(found))
            held += len(counts)
            if held > HELD_TERMS:
                yield from (_table(*key, *both) for key, both in groups.items())
                groups, held = {}, 0
    yield from (_table(*key, *both) for key, both in groups.items())


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Stored ``lang, source, term, n, lang_n, leads``: kept terms that occur in a source.

    ``lang_n`` is the count in the whole language, ``leads`` marks one row of each (lang, term). Every
    group also has a row with an empty term. One shuffle, of sums per task.
    """
    empty = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    counted = in_python(texts, _count, "lang string, source string, term string, n long, docs long")
    of_term = Window.partitionBy("lang", "term")
    cells = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("leads", F.col("source") == F.min("source").over(of_term))
    )
    kept = cells.where((F.col("lang_docs") >= least_documents) | (F.col("term") == ""))
    return settle(kept.select("lang", "source", "term", "n", "lang_n", "leads"), "term-counts")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact for counts of any size."""
    part = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return 1 + F.call_function("div", part, (total + 2 * terms).cast("decimal(19,0)"))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(cells: DataFrame) -> DataFrame:
    """Stored ``lang, source, total, present, lang_total, terms, absent_p``: one row per group."""
    is_term = F.col("term") != ""
    by_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(is_term).alias("present"))
    by_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(is_term & F.col("leads")).alias("terms"))
    # without any term there is no share; no row asks for it then
    absent = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1))))
    return settle(by_source.join(by_lang, "lang").withColumn("absent_p", absent), "group-sizes")


def skyband(n: np.ndarray, lang_n: np.ndarray, term: list[bytes], k: int) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate.

    In order of falling ``n``, rising ``lang_n`` and rising term all that dominates a row comes before
    it, and a row with ``k`` dominators has ``k`` of them in the skyband: comparing with what has been
    kept so far, and with the rows next to it, is enough.
    """
    place = np.empty(len(term), np.int64)
    place[sorted(range(len(term)), key=term.__getitem__)] = np.arange(len(term))
    order = np.lexsort((place, lang_n, -n))
    kept = order[:0]
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        beaten = (lang_n[kept][:, None] <= lang_n[some]) & (place[kept][:, None] < place[some])
        near = (lang_n[some][:, None] <= lang_n[some]) & (place[some][:, None] < place[some])
        # a row further on in this order has no more of n, so only those before it count
        near = np.triu(near, 1)
        kept = np.concatenate((kept, some[beaten.sum(0) + near.sum(0) < k]))
    return kept


def _skybands(k: int) -> Callable[[Batches], Batches]:
    """Reduce the rows ``lang, source, term, n, lang_n, p, q`` of a partition, group by group."""

    def reduced(rows: pa.Table) -> pa.Table:
        found = rows.column("term").cast(pa.binary()).to_pylist()
        n, lang_n = (rows.column(c).to_numpy() for c in ("n", "lang_n"))
        return rows.take(pa.array(skyband(n, lang_n, found, k)))

    def task(batches: Batches) -> Batches:
        groups: dict[tuple[str, str], list] = {}
        for batch in batches:
            for key, part in _by_group(batch):
                held = groups.setdefault(key, [[], 0, 0])  # parts, their rows, rows of the last skyband
                held[0].append(part)
                held[1] += part.num_rows
                if held[1] > 2 * held[2] + _GATHERED:
                    small = reduced(pa.concat_tables(held[0]))
                    groups[key] = [[small], small.num_rows, small.num_rows]
        for parts, _, _ in groups.values():
            yield from reduced(pa.concat_tables(parts)).combine_chunks().to_batches()

    return task


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], pa.Table]]:
    rows = pa.Table.from_batches([batch])
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    bounds = np.flatnonzero(np.diff(code[order])) + 1
    for some in np.split(order, bounds) if len(order) else ():
        yield (batch.column(0)[int(some[0])].as_py(), batch.column(1)[int(some[0])].as_py()), rows.take(pa.array(some))


_SKYBAND = "lang string, source string, term string, n long, lang_n long, p long, q long"


def distinctive_terms(shares: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a source has more of than its language.

    Partial skybands are merged in rounds; a group's rows are dealt by hash of the term until few
    parts are left, so no task gathers more than some skybands of one group.
    """
    names = [c.split()[0] for c in _SKYBAND.split(", ")]
    found = in_python(shares.where("n > 0 AND p > q").select(*names), _skybands(top), _SKYBAND)
    parts = shares.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // _FAN_IN)
        found = settle(found, "skybands")
        part = F.pmod(F.xxhash64("term"), F.lit(parts))
        found = in_python(found.repartition("lang", "source", part), _skybands(top), _SKYBAND)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = found.select("lang", "source", F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
    return valued.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: every pair of sources of a language, in both directions."""
    lang = ["lang"]
    a, b = (groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "absent_p", "present")], "terms") for x in "ab")
    pairs = a.join(b.drop("terms"), lang).where("source_a < source_b")

    # where one source has a term, against what the other has for an absent one
    held = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), "absent_p")
    one = (
        held.join(other, lang)
        .where("source <> other")
        .groupBy("lang", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b"))
        .agg(F.sum(F.col("times") * _value(F.col("p"), F.col("absent_p"))).alias("one_side"))
    )

    # where both have it, the true value in place of those two, and one absent term too few counted
    left, right = (shares.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "absent_p")]) for x in "ab")
    p, q, no_p, no_q = (F.col(c) for c in ("p_a", "p_b", "absent_p_a", "absent_p_b"))
    both = (
        left.join(right, ["lang", "term"])
        .where("source_a < source_b")
        .groupBy("lang", "source_a", "source_b")
        .agg(F.sum(_value(p, q) - _value(p, no_q) - _value(no_p, q) + _value(no_p, no_q)).alias("both_sides"))
    )
    key = ["lang", "source_a", "source_b"]
    neither = (F.col("terms") - F.col("present_a") - F.col("present_b")) * _value(no_p, no_q)
    value = F.coalesce(neither, F.lit(0)) + F.coalesce("one_side", F.lit(0)) + F.coalesce("both_sides", F.lit(0))
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (key[1:], key[:0:-1])]))
    valued = pairs.join(one, key, "left").join(both, key, "left").select("lang", value.cast("long").alias("value"), ends.alias("_e"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select("lang", "_e.source", "_e.item", "value").withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, top: int = TOP, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs.

    Part ``pair`` ranks the other sources of the language by divergence over all kept terms, part
    ``term`` the first ``top`` terms that the source has more of than its language. NULL language,
    source and text count as empty; every row is a document of its own, rows that repeat an id too.
    A group without terms has pairs, and a language without kept terms has pairs of value 0. The only
    source of a language has no pairs. Ties go to the item that is earlier in UTF-8. An empty table
    gives an empty result; other columns are never read. Memory and rows grow with the square of the
    number of sources of a language only in so far as the result does.
    """
    cells = term_counts(docs, least_documents)
    groups = group_sizes(cells)
    known = cells.where("term <> ''").join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shares = settle(known.select("lang", "source", "term", "n", "lang_n", p.alias("p"), q.alias("q"), "absent_p"), "shares")
    found = [("pair", pair_divergence(shares, groups)), ("term", distinctive_terms(shares, top))]
    rows = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in found]
    return rows[0].unionByName(rows[1])
