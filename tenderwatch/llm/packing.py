"""Best-fit packing of documents into token sequences by bin completion.

Only the lengths of pieces decide a packing, and there are at most ``capacity`` different lengths.
So Spark counts pieces per length, the search runs on that histogram, whose size never depends on
the data, and the resulting plan - which ranks of which length go to which sequences - is looked
up by every piece. The search opens a sequence with the largest piece left and completes it:
undominated fillings of the rest are enumerated, largest pieces first; best-fit decreasing gives
the first whole solution, and a branch ends as soon as its waste rules out fewer sequences. A
filling is applied as often as the counts allow, so equal pieces cost one step together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, in_python, numbered
from tenderwatch.llm.tokens import END_ID, encoder
from tenderwatch.sources.storage import settle

CAPACITY = 4096
#: pieces in an enumerated filling beside the largest, fillings tried per branch, branches beyond
#: the first descent, whose length grows with the different lengths; a descent begun is ended
FILLING_PIECES = 4
BRANCHING = 2
NODES = 4_000
#: steps of one enumeration of fillings
STEPS = 24
#: in a longer filling, a dominance test places each piece in one way only
_DOMINANCE_PIECES = 8
_DOCS = 256


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each holding these pieces: (length, how many)."""

    parts: tuple[tuple[int, int], ...]
    times: int


def _encode(path: str, capacity: int) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                encoded = encoder(path).encode(part.column(1).to_pylist())
                of, piece, start, data = [], [], [], []
                for row, ids in enumerate(encoded):
                    ids += end
                    for n, cut in enumerate(range(0, len(ids), 4 * capacity)):
                        of.append(row)
                        piece.append(n)
                        start.append(cut // 4)
                        data.append(ids[cut : cut + 4 * capacity])
                lengths = np.array([len(x) // 4 for x in data], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.frombuffer(b"".join(data), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(lengths),
                        pa.array([zlib.crc32(x) for x in data], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return task


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: documents with end id, cut where too long."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return in_python(rows, _encode(tokenizer_path, capacity), schema)


def _best_fit(counts: np.ndarray, largest: int, capacity: int) -> list[int]:
    """Best-fit decreasing around one piece: again and again the largest piece that fits."""
    left, filling = capacity - largest, []
    used: dict[int, int] = {}
    at = min(left, largest)
    while left > 0 and at > 0:
        at = min(at, left)
        while at > 0 and counts[at] - used.get(at, 0) <= 0:
            at -= 1
        if at:
            filling.append(at)
            used[at] = used.get(at, 0) + 1
            left -= at
    return filling


def dominates(one: list[int], other: list[int]) -> bool:
    """Whether ``other`` can be dealt into the pieces of ``one``: taking those first is never worse."""
    if sum(other) > sum(one):
        return False
    pieces = sorted(other, reverse=True)

    def deal(k: int, rooms: list[int]) -> bool:
        if k == len(pieces):
            return True
        fit = sorted({r for r in rooms if r >= pieces[k]})
        for room in fit:
            left = list(rooms)
            left[left.index(room)] -= pieces[k]
            if deal(k + 1, left):
                return True
        return False

    if len(pieces) <= _DOMINANCE_PIECES:
        return deal(0, list(one))
    rooms = sorted(one)
    for x in pieces:
        at = bisect_left(rooms, x)
        if at == len(rooms):
            return False
        insort(rooms, rooms.pop(at) - x)
    return True


def fillings(counts: np.ndarray, largest: int, capacity: int, limit: int = BRANCHING) -> list[list[int]]:
    """Undominated fillings beside ``largest``, least waste first; ``counts`` excludes it.

    Larger pieces come first. A filling that leaves no room is not extended, and one that another
    dominates is not kept. The last two pieces of a filling are found
    together by looking up which pairs of lengths fill the rest best. Best-fit comes along always.
    """
    room = capacity - largest
    found: dict[tuple[int, ...], int] = {}
    steps = 0
    lengths = np.nonzero(counts[: room + 1] > 0)[0]

    def keep(filling: list[int]) -> None:
        found.setdefault(tuple(filling), room - sum(filling))

    keep(_best_fit(counts, largest, capacity))

    def extend(filling: list[int], left: int, top: int) -> bool:
        """True once a filling without waste is found that no other can dominate."""
        nonlocal steps
        steps += 1
        usable = lengths[: np.searchsorted(lengths, min(left, top), side="right")]
        free = counts[usable].copy()
        for x in filling:
            if x <= min(left, top):
                free[np.searchsorted(usable, x)] -= 1
        usable, free = usable[free > 0], free[free > 0]
        if not len(usable):
            keep(filling)
            return False
        one = int(usable[-1])
        if one == left:
            keep([*filling, one])
            return True
        fit = np.searchsorted(usable, np.minimum(left - usable, usable), side="right") - 1
        fit -= (fit >= 0) & (usable[fit] == usable) & (free < 2)
        both = usable + np.where(fit >= 0, usable[fit], 0)
        best = int(len(both) - 1 - np.argmax(both[::-1]))
        pair = [int(usable[best])] + ([int(usable[fit[best]])] if fit[best] >= 0 else [])
        if both[best] == left:
            keep([*filling, *pair])
            return True
        keep([*filling, *pair])
        if len(filling) + 1 < FILLING_PIECES:
            for x in usable[::-1]:
                if steps >= STEPS:
                    return False
                if extend([*filling, int(x)], left - int(x), int(x)):
                    return True
        return False

    if room and len(lengths):
        extend([], room, largest)
    kept: list[list[int]] = []
    for f, _ in sorted(found.items(), key=lambda x: (x[1], len(x[0]))):
        if not any(dominates(k, list(f)) for k in kept):
            kept.append(list(f))
            if len(kept) == limit:
                break
    return kept


def _apply(counts: np.ndarray, largest: int, filling: list[int]) -> Pattern:
    """Use a filling as often as the counts allow."""
    need: dict[int, int] = {largest: 1}
    for x in filling:
        need[x] = need.get(x, 0) + 1
    times = min(int(counts[x]) // k for x, k in need.items())
    for x, k in need.items():
        counts[x] -= k * times
    return Pattern(tuple(need.items()), times)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """The fewest sequences the search finds for ``length: count``.

    Depth first, fillings of least waste first, so the first descent completes bins greedily and
    best-fit decreasing is the incumbent. A branch whose waste is so large that it can at best equal
    the incumbent is cut. The search ends at the lower bound, or with the descent in which ``nodes``
    steps beyond the first descent are reached; the first one ends at a whole solution or a cut,
    whatever its length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = int((counts * np.arange(capacity + 1)).sum())
    bound = -(-total // capacity)
    best: list[Pattern] = []
    fewest, work = None, counts.copy()
    while work.any():
        largest = int(np.nonzero(work)[0][-1])
        work[largest] -= 1
        filling = _best_fit(work, largest, capacity)
        work[largest] += 1
        best.append(_apply(work, largest, filling))
    fewest = sum(p.times for p in best)

    path: list[tuple[Pattern, list[list[int]]]] = []
    used, tried = 0, 0
    fresh, first = True, True
    while fewest > bound:
        options: list[list[int]] = []
        if fresh and counts.any():
            largest = int(np.nonzero(counts)[0][-1])
            counts[largest] -= 1
            options = fillings(counts, largest, capacity)
            counts[largest] += 1
        elif fresh and used < fewest:
            fewest, best = used, [p for p, _ in path]
        left = int((counts * np.arange(capacity + 1)).sum())
        # What is left needs at least its own size: beyond that, the branch can't beat the incumbent.
        if options and used - (-left // capacity) < fewest:
            pattern = _apply(counts, largest, options[0])
            path.append((pattern, options[1:]))
            used, tried, fresh = used + pattern.times, tried + (not first), True
            continue
        first = False
        if tried >= nodes:
            break
        while path:
            pattern, others = path.pop()
            used -= pattern.times
            for x, k in pattern.parts:
                counts[x] += k * pattern.times
            if others:
                pattern = _apply(counts, pattern.parts[0][0], others[0])
                path.append((pattern, others[1:]))
                used, tried, fresh = used + pattern.times, tried + 1, True
                break
        else:
            break
    return best


def _lookup(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Per length and first rank: the first sequence, pieces per sequence and place in it."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for p in patterns:
        place = 0
        for length, per in p.parts:
            rows.append((length, int(taken[length]), sequence, per, place))
            taken[length] += per * p.times
            place += per * length
        sequence += p.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "per", "place"), table.T.copy()))


def _place(found: dict[str, np.ndarray]) -> Callable[[Batches], Batches]:
    span = int(found["rank"].max(initial=0)) + 1

    def task(batches: Batches) -> Batches:
        starts = found["length"] * span + found["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(starts, length * span + np.minimum(rank, span - 1), side="right") - 1
            nth = rank - found["rank"][at]
            sequence = found["sequence"][at] + nth // found["per"][at]
            offset = found["place"][at] + nth % found["per"][at] * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return task


def pack(stored: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table with ``doc_id, piece, length``.

    At most ``capacity`` counts come to the driver, and the plan that goes out has a few rows for
    each of them. Repeated rows are placed each; an empty table gives an empty result.
    """
    counts = stored.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    patterns = plan({r["length"]: r["n"] for r in counts.collect()}, capacity, nodes)
    ranked = numbered(stored, ["length"], ["doc_id", "piece"], "rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return in_python(ranked, _place(_lookup(patterns, capacity)), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The packing, one row per piece, and the stored pieces with their ids.

    NULL text counts as empty, so every row gives at least one piece; a NULL ``doc_id`` stays NULL.
    Extra columns are never read.
    """
    stored = settle(pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(stored.drop("ids"), capacity), stored


def sequences(packed: DataFrame, stored: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, at most ``capacity`` ids each."""
    placed = packed.select("doc_id", "piece", "sequence_id", "offset")
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        stored.select("doc_id", "piece", "ids")
        .join(placed, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
    )
