"""The audit of sources, centroid clustering and nearest-neighbour search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderwatch.llm import centroids, divergence, stable_search
from tests.llm.helpers import CLASHES

LOWER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audit_by_brute_force(rows, top=10, least=10):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, found in mine:
            counts[source].update(t for t in found if t in kept)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))

        def value(p, q):
            return (p - q) ** 2 // (p + q)

        def rank(source, part, items, limit):
            for n, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]):
                out[(lang, source, part, item, v, n + 1)] += 1

        for source, c in counts.items():
            others = [(o, sum(value(share(c, t), share(counts[o], t)) for t in kept)) for o in counts if o != source]
            rank(source, "pair", others, None)
            more = [(t, value(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            rank(source, "term", more, top)
    return out


def source_rows():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "abcdeéñ漢" for b in "xyzwßü"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "Z", "é", None])
        bias = words[: 12 + 6 * (len(source or "") + ord((source or "a")[0]) % 5)]
        rows.append((lang, source, " ".join(rng.choice(bias).swapcase() if rng.random() < 0.2 else rng.choice(bias) for _ in range(rng.randint(0, 40)))))
    rows += [("en", "quiet", None), ("en", "quiet", "1 2 3"), ("xx", "a", "too rare"), ("xx", "b", "words"), ("yy", "alone", "word " * 20), (None, None, None)]
    rows += [("en", "s1", "common word " * 30_000), ("fr", "s2", "AbCİÉ|def`ghi{jkl mno\u0085pq\x00r")] * 12
    return rows


@pytest.mark.parametrize("held", [divergence.HELD_TERMS, 30])
def test_audit(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = source_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    df = df.select("*", *[F.lit("c").alias(c) for c in [*CLASHES, "n", "item", "value", "part", "term", "total"]]).repartition(5)
    found = divergence.audit(df)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == audit_by_brute_force(rows)


def test_audit_keeps_other_bounds(spark):
    rows = source_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    found = divergence.audit(df, top=3, least_documents=2)
    assert Counter(map(tuple, found.collect())) == audit_by_brute_force(rows, top=3, least=2)
    assert divergence.audit(df.where("lang = 'nowhere'")).count() == 0
    alone = divergence.audit(df.where("lang = 'yy'")).collect()
    assert alone == []


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband(k):
    rng = random.Random(k)
    for size in (0, 1, 40, 700):
        wide = rng.choice([3, 30, 1000])
        n = np.array([rng.randint(1, wide) for _ in range(size)], np.int64)
        lang_n = n + np.array([rng.randint(0, wide) for _ in range(size)], np.int64)
        term = [f"{x:04d}".encode() for x in rng.sample(range(10_000), size)]
        beaten = [sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and term[j] < term[i] for j in range(size)) for i in range(size)]
        assert set(divergence.skyband(n, lang_n, term, k).tolist()) == {i for i in range(size) if beaten[i] < k}


def test_terms_are_cut_as_stated():
    for text in ["", "Ab`c{d|eİé x\x00y z", "a1b2", "漢字 KK", "\x7f@[A]^Z_`a"]:
        assert [t.decode() for t in divergence.terms(text.encode())] == TERM.findall(text.translate(LOWER))


def clusters_by_brute_force(rows, k=16, rounds=3):
    able = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(able, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, x in able:
            by[nearest(x)[1]].append(x)
        for j, xs in by.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs)]
    last = [(i, *nearest(x)) for i, x in able]
    of = Counter()
    for _, d, j in last:
        of[j] += d
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return Counter((i, j, d, of[j], of.total(), digest[j]) for i, d, j in last)


def vectors(dim=64, n=500, bad=True):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, dim))
    rows = [(i, (middle[i % 9] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)] + [(5, rows[11][1]), (5, rows[5][1]), (40, rows[40][1])]
    if bad:
        for v in (None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim - 1), [1.0] * (dim + 1)):
            rows.append((1000 + 20 * len(rows), v))
        rows += [(None, rows[3][1]), (None, rows[4][1])]
    return rows


def as_frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.select("*", *[F.lit(1).alias(c) for c in ("x", "cluster", "key", "dim", "cell", "label", "ids", "list", "own", "n", "first")]).repartition(3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_centroid_clusters(spark, kind):
    rows = vectors()
    found = centroids.centroid_clusters(as_frame(spark, rows, kind))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == clusters_by_brute_force(rows)


def test_few_vectors_make_few_clusters(spark):
    rows = vectors(bad=False)[:5] + [(None, vectors()[20][1])]
    assert Counter(map(tuple, centroids.centroid_clusters(as_frame(spark, rows)).collect())) == clusters_by_brute_force(rows)
    assert centroids.centroid_clusters(as_frame(spark, rows).limit(0)).count() == 0


def test_far_components_are_held(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.5] * 64), (4, [2.0**21] * 64)]
    found = {r["vec_id"]: r["distance"] for r in centroids.centroid_clusters(as_frame(spark, rows)).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 0}


def test_bounds_spare_distances_and_change_nothing():
    """Against plain rounds: loosening by total displacement is right, also when a centroid comes back."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(40 * m, 9, (300, 64)) for m in range(6)]).astype(np.int64)
    c = [x[rng.choice(len(x), 16, replace=False)]]
    cluster, far, seen, _ = centroids.first_seen(x, c[0])
    spared = 0
    for step in range(6):
        back = c[0] if step == 3 else c[-1] + rng.integers(-3, 4, c[0].shape)
        c.append(back)
        cluster, far, seen, checked = centroids.reassigned(x, cluster, far, seen, np.stack(c))
        d = ((x[:, None, :] - c[-1]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        known = np.sqrt(((x[:, None, :] - np.stack(c)[seen, np.arange(16)]) ** 2).sum(2))
        assert np.allclose(far, known)
        spared += x.shape[0] * 16 - checked.sum()
    assert spared > 0.5 * 6 * x.shape[0] * 16


def test_exact_distances_beyond_doubles():
    rng = np.random.default_rng(6)
    x, c = (rng.integers(-centroids.FARTHEST, centroids.FARTHEST, (n, 64)) for n in (20, 5))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert centroids.all_squared(x, c).tolist() == want


def dot(a, b):
    total = 0.0
    for u, v in zip(a, b):
        total += float(u) * float(v)
    return total


def neighbours_by_brute_force(rows, k=20):
    able = [(n, i, [float(np.float32(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, i, v in able:
        if i % 20 == 0:
            found = sorted((-dot(v, w), j) for m, j, w in able if m != n and len(w) == len(v))[:k]
            out.setdefault((i, tuple(v)), []).append([(r + 1, j, -s) for r, (s, j) in enumerate(found)])
    return out


@pytest.mark.parametrize("block", [4096, 60])
def test_nearest(spark, block):
    """With near certainty asked of every neighbour the result is that of brute force."""
    rows = vectors(dim=12) + [(20 * i, [0.1 * i, 1.0, 2.0]) for i in range(1, 5)]
    got = stable_search.nearest(as_frame(spark, rows), chance=1 - 1e-9, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = Counter((i, *hit) for (i, _), lists in neighbours_by_brute_force(rows).items() for hits in lists for hit in hits)
    assert Counter(map(tuple, got.collect())) == want


def test_nearest_in_double_and_nothing(spark):
    rows = [(20, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [-1e200, 1.0]), (3, [1e-200, 1.0]), (4, [1e100, 1.0])]
    found = stable_search.nearest(as_frame(spark, rows, "double")).collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 1), (2, 4), (3, 3), (4, 2)]
    assert [r["score"] for r in found] == [math.inf, 1e300, 1.0, -math.inf]
    assert stable_search.nearest(as_frame(spark, rows).limit(0)).count() == 0
    assert stable_search.nearest(as_frame(spark, [(20, [1.0, 2.0]), (1, None)])).count() == 0


def test_recall_on_the_test_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = neighbours_by_brute_force(rows)
    right = total = 0
    found = defaultdict(set)
    for r in stable_search.nearest(df, block=256).collect():
        found[r["query_id"]].add((r["vec_id"], r["score"]))
    for (i, _), lists in want.items():
        total += len(lists[0])
        right += len(found[i] & {(j, s) for _, j, s in lists[0]})
    assert right >= 0.93 * total


def test_quantiles_and_blocks():
    # printed tables of the chi-square distribution
    assert stable_search.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-4)
    assert stable_search.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert stable_search.chi_square_quantile(0.9, 16) == pytest.approx(23.542, abs=1e-3)
    rng = np.random.default_rng(7)
    p = rng.normal(size=(1000, 16))
    parts = stable_search.leaves(p, 50)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 50
    low, high = (np.stack([f(p[x], axis=0) for x in parts]) for f in (np.min, np.max))
    near = stable_search.box_distance(p[:20], low, high)
    for i in range(20):
        for j, x in enumerate(parts):
            assert near[i, j] <= ((p[x] - p[i]) ** 2).sum(1).min() + 1e-9


def test_the_stopping_test_spares_pairs_where_there_is_structure():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=32) + 0.05 * rng.normal(size=(400, 32)) for _ in range(10)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    none = np.zeros(0)
    space = stable_search.Space(32, 1.0, 1.0 + 1e-9, none.astype(np.int64), none)
    p = space.project(x)
    parts = stable_search.leaves(p)
    order = np.concatenate(parts)
    low, high = (np.stack([f(p[y], axis=0) for y in parts]) for f in (np.min, np.max))
    ids = np.arange(len(x))[order]
    q = x[::40]
    best, verified = stable_search.search_block(
        space, x[order], ids, ids, np.array([len(y) for y in parts]), low, high, q, np.full(len(q), -np.inf), 21, stable_search.chi_square_quantile(0.95, 16)
    )
    assert verified < 0.35 * len(q) * len(x)
    true = np.argsort(-(q @ x.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(best.id, true)]) > 0.95
