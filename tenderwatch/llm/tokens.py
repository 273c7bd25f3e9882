"""Encoding whole texts with a tokenizer file, one white-space chunk at a time.

The tokenizer drops white space and never merges across it, so a text's ids are those of its
chunks between blanks and line feeds, in order. Every different short chunk is encoded once per
Python worker, by the tokenizers library, and remembered up to a bound.
"""

from __future__ import annotations

import itertools
import os
from array import array
from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Encoding

#: words and stops remembered by one Python worker, about 200 bytes each; beyond it, those that came
#: once are forgotten, which most do
MEMO_CHUNKS = 400_000
#: longer chunks are encoded each time
MEMO_CHARS = 48
#: a digit is never merged with anything: it holds the chunks of one call apart, and how many
_DIGIT = "0"
_TOGETHER = 8192
#: what the file's last token of every word ends with
_WORD_END = "</w>"
#: signs that may follow a word; never part of it
_STOPS = ".,;:!?#%*$&|"
#: id written after every document
END_ID = 1


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._digit = self._tokenizer.encode(_DIGIT, add_special_tokens=False).ids
        ids = self._tokenizer.get_vocab()
        self._is_digit = np.zeros(max(ids.values()) + 1, bool)
        self._is_digit[self._digit[:1]] = True
        self._ends_word = np.zeros_like(self._is_digit)
        self._ends_word[[i for token, i in ids.items() if token.endswith(_WORD_END)]] = True
        self._memo: dict[str, bytes] = {"": b""}
        #: remembered ones that came again since some were last forgotten
        self._again: set[str] = set()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """NULL counts as empty."""
        if not texts:
            return []
        # Arrow cuts the texts, finds their different chunks and puts the ids together
        chunked = pc.split_pattern(pa.array([self._folded(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        offsets, coded = chunked.offsets.to_numpy(), pc.dictionary_encode(chunked.flatten())
        del chunked
        parts = self._parted(coded.dictionary)
        words = [part.dictionary.to_pylist() for part in parts]
        wanted = set().union(*words)
        missing = wanted.difference(self._memo)
        self._again.update(wanted.difference(missing))
        self._memo.update(self._encoded({*missing}))
        known = [pa.array([*map(self._memo.__getitem__, w)], pa.large_binary()) for w in words]
        known = [ids.take(part.indices) for ids, part in zip(known, parts)]
        ids = pc.binary_join_element_wise(*known, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[offsets].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in itertools.pairwise(ends)]
        for chunk in missing:
            if len(chunk) > MEMO_CHARS:
                del self._memo[chunk]
        if len(self._memo) > MEMO_CHUNKS:
            self._forget()
        return out

    def _forget(self) -> None:
        """Keep what came again, half the bound at most."""
        kept = itertools.islice(self._again, MEMO_CHUNKS // 2)
        self._memo = {"": b""} | {chunk: self._memo[chunk] for chunk in kept}
        self._again = set()

    @staticmethod
    def _parted(chunks: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """A word and the stops after it: they are encoded apart, as the tokenizer does."""
        stems = pc.utf8_rtrim(chunks, characters=_STOPS)
        plain = pc.match_substring_regex(stems, r"[0-9A-Za-z]\z")
        stopped = pc.not_equal(stems, chunks)
        # the tokenizer lower-cases: a letter that becomes a letter and a mark goes with the stops
        stopped = stopped.to_numpy(zero_copy_only=False).copy()
        odd = np.flatnonzero(stopped & ~plain.to_numpy(zero_copy_only=False))
        ends = [stem[-1:] for stem in stems.take(pa.array(odd)).to_pylist()]
        stopped[odd] = [e.isalnum() and len(e.lower()) == 1 and e.lower().isalnum() for e in ends]
        stopped = pa.array(stopped)
        stops = pc.replace_substring_regex(chunks, rf"(?s)\A.*[^{_STOPS}]", "")
        return (
            pc.dictionary_encode(pc.if_else(stopped, stems, chunks)),
            pc.dictionary_encode(pc.if_else(stopped, stops, pa.scalar("", pa.large_string()))),
        )

    @staticmethod
    def _folded(text: str) -> str:
        """The tokenizer folds case; doing so before saves chunks.

        Only where it can't change anything else: no marks may arise by it, and no letter may be one
        that composes with another differently once it is small.
        """
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _encoded(self, chunks: set[str]) -> dict[str, bytes]:
        """One call for many chunks.

        A word of small-alphabet letters ends in an id that ends words, and has no other such id: it is
        set apart by a blank. The rest are set apart by a digit between line feeds; those that hold it
        go alone.
        """
        words = [c for c in chunks if c.isalpha() and (c.isascii() or max(c) <= "\xff")]
        found = self._apart(words, " ", self._ends_word, 0)
        rest = chunks.difference(found)
        alone = [c for c in rest if _DIGIT in c] if len(self._digit) == 1 else list(rest)
        found.update(zip(alone, map(self._bytes, self._tokenizer.encode_batch_fast(alone, add_special_tokens=False))))
        found.update(self._apart(list(rest.difference(alone)), f"\n{_DIGIT}\n", self._is_digit, 4))
        return found

    def _apart(self, chunks: list[str], between: str, parts: np.ndarray, skipped: int) -> dict[str, bytes]:
        """Encode chunks with something between them; ``parts`` tells by id where a chunk ends.

        ``skipped`` bytes there are of what stands between, else of the chunk itself.
        """
        found = {}
        for at in range(0, len(chunks), _TOGETHER):
            some = chunks[at : at + _TOGETHER]
            data = self._bytes(self._tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0])
            ends = 4 * np.flatnonzero(parts[np.frombuffer(data, "<u4")])
            ends = [*ends.tolist(), len(data)] if skipped else (ends + 4).tolist()
            start = 0
            for c, end in zip(some, ends, strict=True):
                found[c] = data[start:end]
                start = end + skipped
        return found

    @staticmethod
    def _bytes(encoding: Encoding) -> bytes:
        return array("I", encoding.ids).tobytes()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
