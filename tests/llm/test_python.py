"""Packing, token files, byte-level BPE, SimHash, toxicity, extraction and cover trees."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderwatch.llm import byte_bpe, common, cover_tree, html_crf, packing, simhash, token_files, tokens, toxicity
from tenderwatch.llm.html_blocks import Path, blocks
from tenderwatch.llm.labelled_pages import labelled_pages
from tenderwatch.llm.queries import BYTE_BPE, WORD_BPE
from tenderwatch.llm.tokens import ChunkEncoder
from tests.llm.helpers import awkward_rows, docs, empty

ODD = [" ", "a  b", "\n\n x", "a b c", "<|endoftext|> x's", "\x1c\x85 é́ İ", "漢字かな 😀👍🏽", "don't I'll", "a" * 300, "1 234 5", "\tx \n y ", "ﬁ ½ Å"]


def little(ids):
    return np.array(ids, "<u4").tobytes()


def true_ids(rows):
    t = Tokenizer.from_file(WORD_BPE)
    return [(i, e.ids + [1]) for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False))]


def test_chunk_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = " \n\t 0İ|$,&abC'sé漢😀1!#́"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [little(e.ids) for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    assert ChunkEncoder(WORD_BPE).encode(texts) == want


class Dealt(set):
    """A set that hands out longer strings first, or last."""

    longer_first = True

    def difference(self, *others):
        return sorted(set.difference(self, *others), key=len, reverse=self.longer_first)

    def union(self, *others):
        return type(self)(set.union(self, *others))


class DealtLast(Dealt):
    longer_first = False


@pytest.mark.parametrize("dealt", [Dealt, DealtLast])
def test_a_long_chunk_and_the_same_with_a_stop(monkeypatch, dealt):
    monkeypatch.setattr(tokens, "set", dealt, raising=False)
    texts = ["x" * 60 + " " + "x" * 60 + ".", "y" * 47 + "?! " + "y" * 47, "?" * 60 + " " + "z" * 60 + ".. " + "z" * 60 + "."]
    want = [little(e.ids) for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    e = ChunkEncoder(WORD_BPE)
    for _ in range(2):
        assert e.encode(texts) == want and e.encode(texts[::-1]) == want[::-1]
    assert max(map(len, e._memo)) <= tokens.MEMO_CHARS


def test_words_are_remembered_without_their_stops():
    """A word with other stops after it is no other word; an empty call and empty texts have no ids."""
    e = ChunkEncoder(WORD_BPE)
    want = Tokenizer.from_file(WORD_BPE).encode("tender, tender. tender!? (tender)", add_special_tokens=False).ids
    assert e.encode(["tender, tender. tender!? (tender)"]) == [little(want)]
    assert sorted(e._memo) == ["", "!?", "(tender)", ",", ".", "tender"]
    assert e.encode([]) == [] and e.encode([None, "", " \n "]) == [b""] * 3


def test_remembered_words_are_bounded_and_those_that_come_again_stay(monkeypatch):
    """One generation: nothing beside it holds words that came once."""
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 40)
    e, t = ChunkEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for i in range(12):
        text = "tender award " + " ".join(f"once{chr(97 + i)}{chr(97 + k)}" for k in range(15))
        assert e.encode([text, None]) == [little(t.encode(text, add_special_tokens=False).ids), b""]
        assert {"tender", "award"} <= set(e._memo)
        held = [x for x in vars(e).values() if isinstance(x, (dict, set))]
        assert len(set().union(*held)) <= 40 + 1
    again = " ".join(f"again{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))
    for _ in range(3):
        assert e.encode([again]) == [little(t.encode(again, add_special_tokens=False).ids)]
        assert len(e._memo) <= 40 // 2 + 1


def test_steps_of_documents_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_STEP_BYTES", 10)
    texts = ["x" * n for n in (4, 4, 4, 30, 0, 1)] + [None, "ééé"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    steps = [part.column(0).to_pylist() for part in token_files._steps(batch)]
    assert sum(steps, []) == list(range(8))
    assert all(sum(len((texts[i] or "").encode()) for i in part[1:]) < 10 for part in steps)
    assert [len(part) for part in token_files._steps(batch.slice(0, 0))] == [0]


def test_token_files(spark, tmp_path):
    rows = awkward_rows() + [(2000 + i, t) for i, t in enumerate(ODD)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs(spark, rows), path, WORD_BPE)
    tokens = token_files.read_tokens(spark, path)
    found = token_files.digests(tokens).collect()
    by_id = defaultdict(list)
    for i, ids in true_ids(rows):
        by_id[i].append(ids)
    start, want = 0, Counter()
    for i in sorted(by_id, key=lambda i: (i is not None, i)):
        for ids in sorted(by_id[i], key=lambda x: (len(x), zlib.crc32(little(x)))):
            want[(i, start, len(ids), zlib.crc32(little(ids)))] += 1
            start += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    plan = tokens.where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_token_files_use_the_declared_encodings(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "tokens"
    token_files.write_tokens(docs(spark), str(path), WORD_BPE)
    columns = [pq.ParquetFile(f).metadata.row_group(0) for f in path.glob("*.parquet")][0]
    at = {columns.column(k).path_in_schema.split(".")[0]: columns.column(k) for k in range(columns.num_columns)}
    assert any("DICTIONARY" in e for e in at["ids"].encodings)
    assert "DELTA_BINARY_PACKED" in at["doc_id"].encodings and "DELTA_BINARY_PACKED" in at["n_tokens"].encodings
    assert at["doc_id"].has_offset_index and at["doc_id"].has_column_index


def check_packing(rows, packed, capacity):
    want = Counter()
    for i, ids in true_ids(rows):
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[(i, n, at, len(cut), zlib.crc32(little(cut)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    rows = awkward_rows()
    packed, stored = packing.pack_documents(docs(spark, rows), WORD_BPE, capacity)
    n = check_packing(rows, packed.collect(), capacity)
    total = sum(len(ids) for _, ids in true_ids(rows))
    assert n <= math.ceil(total / capacity) + 1
    if capacity == 64:
        unique = packed.where("doc_id < 100")
        assert packing.sequences(unique, stored).agg(F.sum(F.size("ids"))).first()[0] == unique.agg(F.sum("length")).first()[0]


def fewest_by_brute_force(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for at in range(len(bins)):
            if bins[at] + sizes[k] <= capacity and bins[at] not in bins[:at]:
                place(k + 1, bins[:at] + [bins[at] + sizes[k]] + bins[at + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_bin_completion_finds_the_optimum_of_small_cases():
    rng = random.Random(2)
    worse = 0
    for _ in range(150):
        capacity = rng.randint(8, 30)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        patterns = packing.plan(dict(Counter(sizes)), capacity)
        used = Counter()
        for p in patterns:
            assert sum(x * k for x, k in p.parts) <= capacity and p.times > 0
            for x, k in p.parts:
                used[x] += k * p.times
        assert used == Counter(sizes)
        worse += sum(p.times for p in patterns) > fewest_by_brute_force(sizes, capacity)
    assert worse <= 3


def test_packing_beats_best_fit_where_it_wastes():
    # best-fit decreasing needs 4 bins of 100, three do
    assert sum(p.times for p in packing.plan({51: 1, 27: 1, 26: 3, 23: 3, 24: 1, 22: 1, 20: 1}, 100)) == 3


def test_the_first_descent_is_whole_whatever_the_bound():
    # best-fit decreasing needs 6 and 7 sequences
    first = {13: 2, 10: 1, 19: 1, 22: 1, 20: 1, 23: 1, 16: 2, 18: 2, 26: 1, 29: 1}
    assert sum(p.times for p in packing.plan(first, 50, nodes=0)) == 5
    second = {4: 1, 10: 3, 7: 3, 9: 1, 5: 2, 11: 2, 8: 1, 12: 1}
    assert sum(p.times for p in packing.plan(second, 20, nodes=0)) == 6


def test_dominated_fillings_are_not_kept():
    assert packing.dominates([10, 5], [6, 4, 5]) and packing.dominates([10], [9]) and packing.dominates([7], [])
    assert packing.dominates([50, 3], [1] * 52) and not packing.dominates([50, 1], [2] * 26)
    assert not packing.dominates([6, 4], [10]) and not packing.dominates([5, 5], [6, 3]) and not packing.dominates([8], [9])
    assert packing.dominates([8, 7], [5, 4, 3, 3]) and not packing.dominates([8, 7], [5, 5, 5])
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.randint(10, 60)
        counts = np.bincount([rng.randint(1, capacity) for _ in range(20)], minlength=capacity + 1)
        largest = int(np.nonzero(counts)[0][-1])
        counts[largest] -= 1
        found = packing.fillings(counts, largest, capacity, limit=50)
        assert not any(packing.dominates(a, b) for a in found for b in found if a is not b)


def bpe_reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    rng = random.Random(3)
    alphabet = " \n\t\r 　ab'stré漢😀1٣!#<|>́"
    odd = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    rows = awkward_rows() + [(3000 + i, t) for i, t in enumerate(odd)]
    e = bpe_reference()
    want = Counter()
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[(i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs(spark, rows), BYTE_BPE, public_tokenizers.PATTERN).collect())) == want
    some = byte_bpe.encode(docs(spark, [(1, "don't 漢"), (2, None)]), BYTE_BPE, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {1: e.encode_ordinary("don't 漢"), 2: []}


def test_byte_bpe_looks_the_chunks_of_texts_up_together(monkeypatch):
    """Words are remembered without stops and line ends; ragged texts and giant chunks come out alike."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(" \n\t\x85\u2003aé'st1.,:#ß漢😀") for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["tender, award.\nTender tender! award", "a\n\nb c\n", "it's, it's. 'll.", "x" * 3000 + ". y", None, ""]
    e, seen = bpe_reference(), []
    bpe = byte_bpe.ByteBpe(BYTE_BPE, public_tokenizers.PATTERN)
    whole = bpe._chunk
    monkeypatch.setattr(bpe, "_chunk", lambda chunk: seen.append(chunk) or whole(chunk))
    assert bpe.digests(["tender, award.\nTender tender! award"])[0][0] == len(e.encode_ordinary(texts[-6]))
    assert not {" award.\nTender", " tender!"} & set(seen) and {"tender", " tender", " award", "\nTender"} <= set(seen)
    for text, found in zip(texts, bpe.digests(texts), strict=True):
        ids = e.encode_ordinary(text or "")
        decimal, data = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text or ""))
        assert found == (len(ids), decimal, data) == bpe.digest(text)
    assert bpe.digests([]) == []


def test_perfect_hash_is_minimal():
    keys = [f"key-{i}".encode() for i in range(2000)]
    h = byte_bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(2000)) and sorted(h.values) == list(range(2000))
    assert h.get(b"absent") == -1 and byte_bpe.PerfectHash([]).get(b"") == -1


def components_by_brute_force(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def true_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(4)
    rows = awkward_rows()
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400)).split()
    for k in range(80):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = f"n{k}"
        rows.append((500 + k, " ".join(near)))
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    prints = [true_fingerprint(t) for _, t in known]
    linked = [(i, j) for i in range(len(known)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = components_by_brute_force(len(known), linked)
    want = Counter((known[i][0], f"{prints[i]:016x}", known[root[i]][0]) for i in range(len(known)))
    assert len(set(root)) < len(known) - 100
    for tile in (4096, 3):
        found = simhash.near_groups(docs(spark, rows), tile=tile).where("doc_id IS NOT NULL").collect()
        assert Counter(map(tuple, found)) == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert kept == {known[i][0] for i in range(len(known)) if root[i] == i} | {None}


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, b = "one two three four five six seven eight", "red green blue black white brown grey pink"
    rows = [(1, a), (5, a), (5, b), (7, "something else entirely is written here"), (7, "something else entirely is written here")]
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows)).collect())
    assert kept == Counter([rows[0], rows[2], rows[3], rows[4]])


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (2000, 1299), (2000, 2001)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    want = {i: 0 for i in range(61)} | {i: 1000 for i in [*range(1000, 1300), 2000, 2001]}
    assert got == want
    assert common.components(df.where("a < 0")).count() == 0


def vectors():
    rng = np.random.default_rng(6)
    rows, n = [], 0
    def add(v, dim=8):
        nonlocal n
        rows.append((n, v))
        n += 1
    for _ in range(150):
        add(rng.normal(size=8).astype(np.float32).tolist())
    center = rng.normal(size=8)
    for k in range(120):
        add((center + 0.25 * (k % 4) * rng.normal(size=8)).astype(np.float32).tolist())
    for _ in range(30):
        add(rows[3][1])
    add([2 * x for x in rows[3][1]])
    for bad in (None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7):
        add(bad)
    for k in range(5):
        add([1.0, 0.1 * k, 0.0])
    add([3e38] * 8)
    return rows


@pytest.mark.parametrize("block", [2048, 40])
def test_cover_tree(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "n", "dim", "cell", "label", "weight")])
    able = [i for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in able}
    unit = {i: v / np.abs(v).max() for i, v in unit.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [(i, j) for i in able for j in able if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    links = Counter(x for pair in linked for x in pair)
    root = components_by_brute_force(len(rows), linked)
    want = {i: (links[i], root[i], root[i] == i) for i in range(len(rows))}
    found = cover_tree.near_groups(df, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == want and len(found) == len(rows)


def test_cover_tree_by_vector_and_in_double(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.1, 0.0]), (7, [0.1, 1.0, 0.0]), (3, [0.0, 0.0, 2.0])]
    rows += [(10, [1e200, 0.0]), (11, [1e200, 1e199]), (12, [0.9 + 1e-12, math.sqrt(1 - 0.81)]), (13, [1.0, 0.0])]
    found = cover_tree.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect())
    assert got == [(3, 0, 3), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (10, 3, 10), (11, 3, 10), (12, 3, 10), (13, 3, 10)]


@pytest.mark.parametrize("spread", [1e-9, 1e-3, 0.02, 0.06])
def test_walk_of_dense_groups(spread):
    rng = np.random.default_rng(8)
    center = rng.normal(size=32)
    x = (center / np.linalg.norm(center) + spread * rng.normal(size=(300, 32))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    weights = rng.integers(1, 4, 300)
    trees = []
    for part in (slice(0, 180), slice(180, 300)):
        t = cover_tree.Tree(np.arange(300)[part], weights[part], x[part])
        t.build()
        t = cover_tree.Tree.unpack(t.pack())
        assert all(np.linalg.norm(t.unit[t.start[k] : t.end[k]] - t.unit[t.center[k]], axis=1).max() <= t.radius[k] for k in range(len(t.center)))
        trees.append(t)
    counts = np.zeros(300, int)
    for a, b in ((0, 0), (0, 1), (1, 1)):
        walk = cover_tree.Walk(trees[a], trees[b], 0.9)
        walk.run()
        ids, n, _, _ = walk.found()
        np.add.at(counts, ids, n)
    assert (counts == near @ weights - weights).all()


def toxic_docs(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefgh") * rng.randint(2, 5) + rng.choice("xyz") for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scum", "trash", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_docs()
    extra = [(9000, None), (9001, ""), (None, "scum trash idiot"), (9002, "x " * 50_000), (5, rows[5][1])]
    df = docs(spark, rows + extra)
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(df, known).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in found if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 80 and right >= 0.97 * len(held)
    # labels of the held-out fold change nothing
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = toxicity.toxicity(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert Counter((r["doc_id"], r["score"]) for r in again) == Counter((r["doc_id"], r["score"]) for r in found)
    clean = toxicity.keep_clean(df, known)
    assert clean.columns == df.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in found if not r["predicted"])


def test_labelled_clean_rows_count_for_nothing(spark):
    """Unlabelled text is drawn whatever the labels say; with a given prior only confirmed rows matter."""
    rows, labels = toxic_docs(900)
    kind = "doc_id long, quality int, toxic int"
    df = docs(spark, rows, clash=False)
    some = [x for x in labels if x[2] and x[0] % 2]
    whole, bare = (toxicity.fit(df, spark.createDataFrame(x, kind), prior=0.2) for x in (some + [x for x in labels if not x[2]], some))
    assert whole == bare
    # half the toxic documents are unconfirmed, and still found
    right = sum((bare.score(t) >= 0.5) == bool(y) for (_, t), (_, _, y) in zip(rows, labels))
    assert right >= 0.97 * len(rows)


def brute_nnpu(texts, confirmed, prior, steps=1500, rate=0.1, l2=2e-4):
    """The same learning with dense tables and the risk written out."""
    p, u = [toxicity.features(t) for t in confirmed], [toxicity.features(t) for t in texts]
    z = {}
    for f in {f for x in p + u for f in x}:
        a, b = (np.array([x.get(f, 0.0) for x in rows]) for rows in (p, u))
        z[f] = abs(a.mean() - b.mean()) / math.sqrt(((b * b).mean() - b.mean() ** 2) / len(p) + 1e-9)
    names = sorted((f for f in z if z[f] >= toxicity.LEAST_Z), key=lambda f: (-z[f], f))[: toxicity.MAX_FEATURES]
    xp, xu = (np.array([[x.get(f, 0.0) for f in names] + [1.0] for x in rows]) for rows in (p, u))
    w = np.zeros(len(names) + 1)
    m, v, decay, clamped = w.copy(), w.copy(), np.array([l2] * len(names) + [0.0]), 0
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-xp @ w)), 1 / (1 + np.exp(-xu @ w))
        negative = -np.log1p(1e-12 - su).mean() + prior * np.log1p(1e-12 - sp).mean()
        of_negative = (xu.T @ su) / len(xu) - prior * (xp.T @ sp) / len(xp)
        of_positive = -prior * (xp.T @ (1 - sp)) / len(xp)
        clamped += negative < 0
        g = (of_positive + of_negative if negative >= 0 else -of_negative) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip(names, w[:-1])), w[-1], clamped


def test_toxicity_is_non_negative_pu_learning(spark):
    rows, labels = toxic_docs(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    training = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    confirmed = [rows[i][1] for i in training if labels[i][2]]
    weights, intercept, _ = brute_nnpu([rows[i][1] for i in training], confirmed, 0.2)
    model = toxicity.fit(docs(spark, rows, clash=False), known, prior=0.2)
    assert set(model.weights) == set(weights) and len(weights) >= 3
    want = toxicity.Model(weights, intercept)
    for _, text in rows:
        assert model.score(text) == pytest.approx(want.score(text), abs=1e-6)


def test_the_clamp_acts_and_keeps_unlabelled_text_apart():
    """Few rows, many features: a plain corrected risk falls far below zero, the clamped one does not."""
    rng = np.random.default_rng(11)
    dense = np.concatenate((rng.normal(0.3, 1, (15, 300)), rng.normal(0, 1, (40, 300))))
    y = np.arange(55) < 15
    x = toxicity.Sparse(np.tile(np.arange(300), 55), dense.ravel(), np.full(55, 300), 300)
    w, clamped = toxicity.nnpu(x, y, 0.4, steps=400)

    def negative(w):
        z = dense @ w[:-1] + w[-1]
        return np.logaddexp(0, z[~y]).mean() - 0.4 * np.logaddexp(0, z[y]).mean()

    plain = np.zeros(301)
    for _ in range(4000):
        s = 1 / (1 + np.exp(-(dense @ plain[:-1] + plain[-1])))
        r = np.where(y, -0.4 / 15, s / 40)
        plain -= 0.5 * np.append(dense.T @ r, r.sum())
    assert clamped > 20 and negative(plain) < -1 and negative(w) > 0.1 * negative(plain)


def test_a_repeated_id_does_not_outgrow_the_sample(spark):
    rows, labels = toxic_docs(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    often = next(i for i, _, y in labels if y and zlib.crc32(str(i).encode()) % 5)
    more = [rows[often]] * 400 + [(often, f"scum number {k}") for k in range(300)]
    once = toxicity.training_rows(docs(spark, rows, clash=False), known).collect()
    copies = toxicity.training_rows(docs(spark, rows + more[:400], clash=False), known).collect()
    assert Counter(map(tuple, copies)) == Counter(map(tuple, once))
    some = Counter(r["positive"] for r in toxicity.training_rows(docs(spark, rows + more, clash=False), known, 30).collect())
    assert some == {True: 30, False: 30}


def test_toxicity_without_positives(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs(spark), none).collect()} == {0}


def test_empty_tables(spark, tmp_path):
    nothing = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack_documents(nothing, WORD_BPE)[0].count() == 0
    token_files.write_tokens(nothing, str(tmp_path / "t"), WORD_BPE)
    assert token_files.digests(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == 0
    assert byte_bpe.round_trip(nothing, BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    assert simhash.near_groups(nothing).count() == simhash.keep_one(nothing).count() == 0
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert cover_tree.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(page):
    return [b.text for b in blocks(page, Path(None, "", ()))]


def test_blocks():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>A</a><li>B</ul></nav>
    <p>one &amp; <b>two\n  three<br>four<p>five<script>var a="</p><p>no";</script> six</div><!-- <p>hidden --> <td>7&nbsp;8</td>&copy; end"""
    assert texts_of(page) == ["A", "B", "one & two three four", "five six", "7 8", "© end"]
    assert texts_of("") == texts_of("<p></p>  ") == [] and texts_of("bare < text & more") == ["bare < text & more"]
    assert texts_of("<div>" * 3000 + "deep") == ["deep"]


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){f(i)}", "<!-- f()", 'a="<b \'";', "if(a<b&&c>d)'", "</scripts>x</script", "x='</style>'"])
def test_only_its_own_end_tag_ends_a_script(script):
    assert texts_of(f"<p>a</p><script>{script}</script><p>b<p>c</p><script>g()</script>d") == ["a", "b", "c", "d"]
    assert texts_of(f"<p>a<Script type=x>{script}</SCRIPT\n>b") == ["ab"]
    assert texts_of(f"<textarea>{script}</textarea>b")[-1] == "b"
    assert texts_of(f"a<style>p<{{}}</style >b<script>{script}") == ["ab"]


def test_only_the_own_end_tag_ends_what_holds_no_markup():
    assert texts_of("A<script src=a.js/>var x=1;</script>B<style/>p{}</style>C") == ["ABC"]
    assert texts_of("<p>a<span/>b<svg/>c<svg><path/>hidden</svg>d") == ["abcd"]


def test_a_head_ends_where_something_else_begins():
    assert texts_of("<head><meta><p>early</p><p>text") == ["early", "text"]
    assert texts_of("<html><head><title>T</title>\n<script>x()</script> bare text<div>more") == ["bare text", "more"]
    assert texts_of("<head><title>T</title></head><body>b") == ["b"]


@pytest.mark.parametrize("page, n", [
    ("<a " * 300_000, 1), ("<a '" * 250_000, 1), ('<a "> text " ' * 60_000, 1), ("<b>" * 60_000 + "</i>" * 60_000, 0),
    ("<div>" * 60_000 + "x", 1), ("<p><button>" + "<div>x" * 40_000, 40_000), ("<!-- " * 200_000, 0), ("<i>x" * 60_000, 1),
])
def test_broken_pages_take_linear_time(page, n):
    started = time.process_time()
    found = blocks(page, Path(None, "", ()))
    assert len(found) == n and time.process_time() - started < 5
    assert len(html_crf.model().labels(found)) == n


def test_a_leading_break_leaves_the_path_right():
    page = "<nav><ul><li><a href=x>A</a></li></ul></nav><article><br>First<br>line</article><div class=ad> <br/> <b><br>Buy</b></div> <br>end"
    found = blocks(page, Path(None, "", ()))
    assert [(b.text, b.path.tag) for b in found] == [("A", "li"), ("First line", "article"), ("Buy", "div"), ("end", "")]
    assert found[2].path.names == ("ad",)


def test_extraction_of_unseen_pages():
    crf = html_crf.model()
    right = total = 0
    for page, labels in labelled_pages(120, seed=77):
        got = crf.labels(blocks(page, Path(None, "", ())))
        right += sum(int(a) == y for a, (_, y) in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    crf = html_crf.model()
    for page, _ in labelled_pages(40, seed=5):
        found = blocks(page, Path(None, "", ()))[:9]
        emit = [crf.bias + sum(crf.weights.get(f, 0.0) for f in [*html_crf.path_features(b.path), *html_crf.text_features(b)]) for b in found]

        def score(y):
            chain = [0, *y, 0]
            return sum(crf.chain[a][b] for a, b in zip(chain, chain[1:])) + sum(e for e, on in zip(emit, y) if on)

        best = max(score([k >> t & 1 for t in range(len(found))]) for k in range(1 << len(found)))
        assert score([int(x) for x in crf.labels(found)]) == pytest.approx(best)


def test_extract(spark):
    page = '<body><div class="nav"><a href="/">Home</a></div><article><h1>Title</h1><p>Some  text here, and more of it.</p></article><footer>&copy; us</footer>'
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    text = "Title\n\nSome text here, and more of it."
    want = Counter([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)])
    assert Counter(map(tuple, html_crf.extract(df).collect())) == want
