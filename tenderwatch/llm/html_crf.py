"""Main-text extraction by a linear-chain conditional random field over leaf blocks.

A page is a chain of leaf blocks, each labelled main text or not. Scores of a block come from the
tags and names of its ancestors and from the shape of its text, scores of neighbouring labels from
the chain. Weights are fitted on labelled pages by maximum likelihood, with forward and backward
passes over all pages at once, and the best labelling of a page is found by Viterbi.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenderwatch.llm.common import Batches, in_python
from tenderwatch.llm.html_blocks import Block, Path, blocks
from tenderwatch.llm.labelled_pages import Labelled, labelled_pages

#: labelled pages fitted on, passes over them, and the penalty on squared weights
PAGES = 600
PASSES = 200
L2 = 1e-3
#: different ancestor paths remembered by one Python worker
MEMO_PATHS = 50_000
#: what stands between blocks
BETWEEN = "\n\n"
_STOPS = (".", "!", "?", "…", ":", ";", '"', "»", "”")


def path_features(path: Path) -> list[str]:
    """Own tag, and tags and names of all ancestors, one by one."""
    return [f"tag={path.tag}", *path.marks]


def text_features(block: Block) -> list[str]:
    """The shape of a block's text: length, words, links, its end and its signs."""
    text = block.text
    n = len(text)
    share = min(3, int(4 * block.linked / n)) if block.linked else -1
    return [
        f"length={min(n, 4000).bit_length()}",
        f"words={min(text.count(' ') + 1, 255).bit_length()}",
        f"links={share}",
        f"stop={text.endswith(_STOPS)}",
        f"sign={any(c in text for c in '©®|»·')}",
        f"upper={text.isupper()}",
    ]


@dataclass(frozen=True)
class Crf:
    """Weights towards main text by feature, and of label pairs; a page starts and ends outside."""

    weights: dict[str, float]
    chain: tuple[tuple[float, float], tuple[float, float]]
    bias: float

    def labels(self, found: list[Block]) -> list[bool]:
        """The most probable labels of a page's blocks."""
        w, ((oo, oi), (io, ii)) = self.weights, self.chain
        out, inside, back = 0.0, float("-inf"), []
        for b in found:
            if b.path.features is None:
                b.path.features = sum(w.get(f, 0.0) for f in path_features(b.path))
            score = self.bias + b.path.features + sum(w.get(f, 0.0) for f in text_features(b))
            to_out, to_in = (out + oo, inside + io), (out + oi, inside + ii)
            back.append((to_out[1] > to_out[0], to_in[1] > to_in[0]))
            out, inside = max(to_out), max(to_in) + score
        state = inside + io > out + oo
        chosen = []
        for from_out, from_in in reversed(back):
            chosen.append(state)
            state = from_in if state else from_out
        return chosen[::-1]


def _design(pages: list[Labelled]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Feature names; features, labels and a mask by page and place."""
    chains, names = [], {}
    for page, labels in pages:
        found = blocks(page, Path(None, "", ()))
        if [b.text for b in found] != [" ".join(t.split()) for t, _ in labels]:
            raise ValueError("a labelled page's blocks are not those of its markup")
        rows = [[*path_features(b.path), *text_features(b)] for b in found]
        for row in rows:
            for f in row:
                names.setdefault(f, len(names))
        chains.append((rows, [y for _, y in labels]))
    longest = max(len(r) for r, _ in chains)
    x = np.zeros((len(chains), longest, len(names)), np.float32)
    y = np.zeros((len(chains), longest), np.int64)
    mask = np.zeros((len(chains), longest), bool)
    for p, (rows, labels) in enumerate(chains):
        for t, row in enumerate(rows):
            x[p, t, [names[f] for f in row]] = 1
            y[p, t] = labels[t]
            mask[p, t] = True
    return list(names), x, y, mask


def _expected(score: np.ndarray, chain: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of label 1 by page and place, and expected label pairs, starts and ends included."""
    pages, longest = score.shape
    emit = np.stack((np.zeros_like(score), score), axis=2)
    forward = np.zeros((pages, longest + 1, 2))
    forward[:, 0] = (0, -1e9)
    for t in range(longest):
        step = np.logaddexp(
            forward[:, t, :1] + chain[0], forward[:, t, 1:] + chain[1]
        ) + emit[:, t]
        forward[:, t + 1] = np.where(mask[:, t, None], step, forward[:, t])
    backward = np.zeros((pages, longest + 1, 2))
    backward[:, longest] = chain[:, 0]
    for t in range(longest - 1, -1, -1):
        after = emit[:, t] + backward[:, t + 1]
        step = np.logaddexp(chain[:, 0] + after[:, :1], chain[:, 1] + after[:, 1:])
        backward[:, t] = np.where(mask[:, t, None], step, backward[:, t + 1])
    whole = backward[:, 0, 0]
    marginal = np.exp(forward[:, 1:, 1] + backward[:, 1:, 1] - whole[:, None]) * mask
    pair = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            joint = forward[:, :-1, i] + chain[i, j] + emit[:, :, j] + backward[:, 1:, j]
            pair[i, j] = np.exp((joint - whole[:, None])[mask]).sum()
    ends = np.exp(forward[:, longest] + chain[:, 0] - whole[:, None]).sum(axis=0)
    pair[:, 0] += ends
    return marginal, pair


def fit(pages: list[Labelled], passes: int = PASSES, l2: float = L2) -> Crf:
    """Maximum-likelihood weights of labelled pages, by gradient ascent with momentum of its size."""
    names, x, y, mask = _design(pages)
    padded = np.pad(y, ((0, 0), (1, 1)))
    real = np.pad(mask, ((0, 0), (0, 1)))
    real[:, 1:] |= mask
    real[:, 0] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (padded[:, :-1][real], padded[:, 1:][real]), 1)
    count = mask.sum()
    flat = x[mask]
    target = y[mask] @ flat
    w = np.zeros(len(names) + 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, passes + 1):
        score = np.zeros(mask.shape)
        score[mask] = flat @ w[:-5].astype(np.float32) + w[-5]
        marginal, pair = _expected(score, w[-4:].reshape(2, 2), mask)
        p = marginal[mask]
        g = np.concatenate((target - p @ flat, [y[mask].sum() - p.sum()], (seen - pair).ravel())) / count - l2 * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    chain = w[-4:].reshape(2, 2)
    return Crf(dict(zip(names, w[:-5].tolist())), tuple(map(tuple, chain.tolist())), float(w[-5]))


@lru_cache(maxsize=1)
def model() -> Crf:
    return fit(labelled_pages(PAGES))


def main_text(page: str | None, crf: Crf, root: Path) -> str:
    """The main blocks of a page in order; NULL counts as an empty page."""
    found = blocks(page or "", root)
    return BETWEEN.join(b.text for b, inside in zip(found, crf.labels(found)) if inside)


def _extract(crf: Crf) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        root, seen = Path(None, "", ()), 0
        for batch in batches:
            texts = []
            for value in batch.column(2):
                texts.append(main_text(value.as_py(), crf, root))
                seen += 1
                if seen % MEMO_PATHS == 0:
                    root = Path(None, "", ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return task


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole HTML, without a shuffle.

    Character references are decoded, white space inside a block becomes one blank, and blocks are
    joined by an empty line. NULL and empty pages, and pages without main text, give an empty text;
    repeated rows come back each; extra columns are never read.
    """
    rows = pages.select("page_id", "url", "html")
    id_type = rows.schema["page_id"].dataType.simpleString()
    return in_python(rows, _extract(crf or model()), f"page_id {id_type}, url string, text string, n_chars long")
