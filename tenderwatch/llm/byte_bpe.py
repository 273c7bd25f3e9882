"""Byte-level BPE by a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary answers, with one probe, whether a whole
pre-token is an entry. Second tier: other pre-tokens are merged by a heap of adjacent pairs over
doubly linked bytes, so a merge costs a logarithm and not a pass. Chunks of text between single
blanks split the same way alone as in their text; Arrow finds the different ones of a stretch of texts,
and each worker remembers the result of short ones, without the signs after them, and that of the
pre-tokens in them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from tenderwatch.llm.common import Batches, in_python
from tenderwatch.llm.token_files import _steps

#: chunks, and pre-tokens of chunks that hold several, remembered by one Python worker in each of two
#: generations, about 300 bytes each
MEMO_CHUNKS = 350_000
MEMO_PIECES = 200_000
#: longer ones are encoded each time
MEMO_CHARS = 48
#: signs that may follow a word, and the last letters of words that they surely don't belong to
_STOPS = ".,;:!?#%*$&|"
_WORD_END = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]\z"
#: a line feed after anything but white space
_LINE_END = r"([^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])\n"

_MASK = 0xFFFFFFFFFFFFFFFF
#: displacements tried at once
_MOVES = 64


def _slots(h: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """Slots of hashes (rows) under displacements (columns)."""
    x = (h[:, None] >> np.uint64(17)) ^ (moves[None, :] * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement per small bucket.

    Keys are dealt to buckets by a 64-bit hash. Buckets of several keys come first, the fullest
    ahead; each takes the first displacement that sends its keys to free slots. A bucket of one
    key is sent to any slot still free, which its negative displacement names.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.size = len(keys)
        self.buckets = max(1, self.size // per_bucket)
        self.keys: list[bytes] = [b""] * self.size
        self.values = [-1] * self.size
        shift = [0] * self.buckets
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        free = np.ones(self.size, bool)
        for b in sorted((b for b in range(self.buckets) if len(members[b]) > 1), key=lambda b: -len(members[b])):
            h, move = np.array([hashes[i] for i in members[b]], np.uint64), 0
            while True:
                slots = _slots(h, np.arange(move, move + _MOVES, dtype=np.uint64), self.size)
                good = free[slots].all(axis=0)
                for j in np.nonzero(good)[0]:
                    if len(set(slots[:, j].tolist())) == len(h):
                        break
                else:
                    move += _MOVES
                    continue
                break
            shift[b] = move + int(j)
            free[slots[:, j]] = False
            self._fill(slots[:, j].tolist(), members[b], keys)
        rest = iter(np.nonzero(free)[0].tolist())
        for b in range(self.buckets):
            if len(members[b]) == 1:
                slot = next(rest)
                shift[b] = -slot - 1
                self._fill([slot], members[b], keys)
        self.shift = shift

    def _fill(self, slots: list[int], members: list[int], keys: list[bytes]) -> None:
        for slot, i in zip(slots, members):
            self.keys[slot], self.values[slot] = keys[i], i

    def get(self, key: bytes) -> int:
        """The key's number, -1 if it is not one of the keys."""
        if not self.size:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        move = self.shift[h % self.buckets]
        if move < 0:
            slot = -move - 1
        else:
            x = (h >> 17) ^ (move * 0x9E3779B97F4A7C15 & _MASK)
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
            slot = (x ^ (x >> 32)) % self.size
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBpe:
    """Encoder and decoder of a rank file; no special tokens."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.vocabulary = [base64.b64decode(a) for a, _ in pairs]
        self.ranks = [int(b) for _, b in pairs]
        self._hash = PerfectHash(self.vocabulary)
        self._bytes = dict(zip(self.ranks, self.vocabulary))
        of = dict(zip(self.vocabulary, self.ranks))
        self._single = {v[0]: r for v, r in of.items() if len(v) == 1}
        #: two adjacent parts that are an entry together, and its rank
        self._pairs = {
            of[v[:k]] << 32 | of[v[k:]]: r
            for v, r in of.items()
            for k in range(1, len(v))
            if v[:k] in of and v[k:] in of
        }
        #: the same for two bytes, by both; -1 if they are no entry
        single = [self._single[b] for b in range(256)]
        self._first = [self._pairs.get(a << 32 | b, -1) for a in single for b in single]
        self._pattern = regex.compile(pattern)
        self._ragged = regex.compile(r"\x20(?:\s|$)|^\x20|(?<=\s)\x20")
        self._decimal = {r: str(r) for r in self.ranks}
        self._memo: dict[str, tuple[str, int, bytes]] = {}
        self._older: dict[str, tuple[str, int, bytes]] = {}
        self._pieces: dict[str, tuple[str, int, bytes]] = {}
        self._older_pieces: dict[str, tuple[str, int, bytes]] = {}

    def rank(self, piece: bytes) -> int:
        at = self._hash.get(piece)
        return -1 if at < 0 else self.ranks[at]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until no pair is an entry."""
        single, pair = self._single, self._pairs.get
        ids = [single[b] for b in piece]
        n = len(ids)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        #: rank of the pair that begins at a part, -1 without one
        first = self._first
        wanted = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        wanted.append(-1)
        # An entry is a rank and a place in one number, so the heap orders by rank, then from the left.
        heap = [rank << shift | at for at, rank in enumerate(wanted) if rank >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            at, rank = entry & mask, entry >> shift
            if wanted[at] != rank:
                continue  # one of its two parts has been merged since
            gone = after[at]
            ids[at], ids[gone], wanted[gone] = rank, -1, -1
            then = after[at] = after[gone]
            if then >= 0:
                before[then] = at
                new = wanted[at] = pair(rank << 32 | ids[then], -1)
                if new >= 0:
                    push(heap, new << shift | at)
            else:
                wanted[at] = -1
            back = before[at]
            if back >= 0:
                new = wanted[back] = pair(ids[back] << 32 | rank, -1)
                if new >= 0:
                    push(heap, new << shift | back)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text: every match of the pattern by itself."""
        return [i for m in self._pattern.findall(text) for i in self.encode_piece(m.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that the pattern splits alike alone and together.

        A single blank between two other characters always begins a match, because the pattern
        takes a blank only at the front of a match or inside a run of white space.
        """
        if not text:
            return []
        if self._ragged.search(text):
            return self._pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _encoded(self, piece: str) -> tuple[str, int, bytes]:
        """Decimal ids, their number and the decoded bytes of one pre-token."""
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return " ".join([self._decimal[i] for i in ids]), len(ids), self.decode(ids)

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        """A pre-token of a chunk that holds several."""
        done = self._pieces.get(piece)
        if done is None:
            done = self._older_pieces.get(piece) or self._memo.get(piece) or self._encoded(piece)
            if len(piece) <= MEMO_CHARS:
                if len(self._pieces) >= MEMO_PIECES:
                    self._older_pieces, self._pieces = self._pieces, {}
                self._pieces[piece] = done
        return done

    def _chunk(self, chunk: str) -> tuple[str, int, bytes]:
        """A chunk that the young generation of the memo lacks."""
        done = self._older.get(chunk)
        if done is None:
            pieces = self._pattern.findall(chunk)
            if not pieces:
                done = ("", 0, b"")
            elif len(pieces) == 1:
                done = self._pieces.get(chunk) or self._encoded(chunk)
            else:
                ids, counts, data = zip(*map(self._piece, pieces))
                done = (" ".join(ids), sum(counts), b"".join(data))
        if len(chunk) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_CHUNKS:
                self._older, self._memo = self._memo, {}
            self._memo[chunk] = done
        return done

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the decimal ids and of the decoded bytes."""
        memo, new = self._memo, self._chunk
        done = [memo.get(c) or new(c) for c in self.chunks(text or "")]
        ids, counts, data = zip(*done) if done else ((), (), ())
        decoded = hashlib.sha256(b"".join(data)).hexdigest()
        return sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(), decoded

    def digests(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """``digest`` of every text, with the chunks of all texts looked up together."""
        ragged = self._ragged.search
        whole = [bool(text and not ragged(text)) for text in texts]
        together = iter(self._together([*itertools.compress(texts, whole)]) if any(whole) else ())
        return [next(together) if x else self.digest(text) for text, x in zip(texts, whole)]

    def _together(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Texts with something in them whose blanks are all single and between other characters."""
        # A match never goes on from another character into a line feed, so a chunk may end there too.
        lines = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _LINE_END, "\\1 \n")
        chunked = pc.split_pattern(lines, " ")
        offsets, flat = chunked.offsets.to_numpy(), chunked.flatten()
        coded = pc.dictionary_encode(flat)
        inner = coded.dictionary
        blank = pc.if_else(pc.starts_with(inner, "\n"), "", pa.scalar(" ", pa.large_string()))
        inner = pc.binary_join_element_wise(blank, inner, pa.scalar("", pa.large_string()))
        # the first chunk of a text has no blank before it
        at = coded.indices.to_numpy().astype(np.int64)
        at[offsets[:-1]] = len(inner) + np.arange(len(texts))
        counts, ids, data = self._results(pa.concat_arrays([inner, flat.take(pa.array(offsets[:-1]))]))
        numbers = np.concatenate(([0], np.cumsum(counts[at])))[offsets]
        at = pa.array(at)
        # every id has a blank before it; that of a text's first one is left out
        ids, data = self._cut(ids.take(at), offsets, 1), self._cut(data.take(at), offsets, 0)
        return [*zip(np.diff(numbers).tolist(), ids, data)]

    def _results(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Numbers of ids, decimal ids with a blank before each, and decoded bytes.

        No match goes on from a letter or digit into a stop, so both are encoded apart.
        """
        stems = pc.utf8_rtrim(chunks, characters=_STOPS)
        stopped = pc.match_substring_regex(stems, _WORD_END)
        stops = pc.replace_substring_regex(chunks, rf"(?s)\A.*[^{_STOPS}]", "")
        memo, new, empty = self._memo.get, self._chunk, pa.scalar("", pa.large_string())
        found = []
        for parts in (pc.if_else(stopped, stems, chunks), pc.if_else(stopped, stops, empty)):
            coded = pc.dictionary_encode(parts)
            done = [memo(c) or new(c) for c in coded.dictionary.to_pylist()]
            ids, counts, data = zip(*done)
            ids = pa.array([" " + x if x else x for x in ids], pa.large_string()).take(coded.indices)
            data = pa.array(data, pa.large_binary()).take(coded.indices)
            found.append((np.array(counts, np.int64)[coded.indices.to_numpy()], ids, data))
        counts, ids, data = zip(*found)
        none = pa.scalar(b"", pa.large_binary())
        return sum(counts), pc.binary_join_element_wise(*ids, empty), pc.binary_join_element_wise(*data, none)

    @staticmethod
    def _cut(parts: pa.Array, offsets: np.ndarray, skipped: int) -> list[str]:
        """SHA-256 of the parts between offsets, without the first bytes."""
        ends = np.frombuffer(parts.buffers()[1], np.int64)[offsets].tolist()
        data = memoryview(parts.buffers()[2])
        return [hashlib.sha256(data[a + skipped : b]).hexdigest() for a, b in itertools.pairwise(ends)]


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(rank_path: str, pattern: str) -> ByteBpe:
    """The worker's codec, kept from task to task."""
    key = (rank_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(*key)
    return _CODECS[key]


def _digests(rank_path: str, pattern: str) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        bpe = codec(rank_path, pattern)
        for part in itertools.chain.from_iterable(map(_steps, batches)):
            rows = bpe.digests(part.column(1).to_pylist())
            n, ids, data = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return task


def _ids(rank_path: str, pattern: str) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        bpe = codec(rank_path, pattern)
        for batch in batches:
            ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return task


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every row, from the whole text; NULL counts as empty, without ids."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return in_python(rows, _ids(rank_path, pattern), f"doc_id {id_type}, ids array<int>")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every whole text encoded and decoded.

    One row per row, without a shuffle: NULL counts as empty, repeated rows and NULL ids come back
    as they are, an empty table gives an empty result, and extra columns are never read.
    """
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_python(rows, _digests(rank_path, pattern), schema)
