"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tenderwatch.llm import (
    byte_bpe,
    centroids,
    cover_tree,
    divergence,
    exact_dedup,
    hash_tree,
    html_crf,
    packing,
    secret_ledger,
    simhash,
    stable_search,
    token_files,
    toxicity,
)
from tenderwatch.llm.common import table
from tenderwatch.sources.storage import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)[0]


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_files.digests(token_files.read_tokens(spark, path))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.find_secrets(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.place(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_groups(table(spark, sf_dir, "embeddings"))


def op11_skyband_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_stable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_search.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (
        op1_best_fit_packing,
        op2_html_crf,
        op3_token_files,
        op4_byte_bpe,
        op5_secret_ledger,
        op6_hash_tree,
        op7_exact_dedup,
        op8_simhash,
        op9_toxicity,
        op10_cover_tree,
        op11_skyband_audit,
        op12_ns_bounds,
        op13_stable_search,
    )
    return {f.__name__: f for f in found}


_OP7 = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
  FROM d WINDOW w AS (PARTITION BY t)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, 12 AS least_n,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hit,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part,
    regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gap
  FROM d
  UNION ALL
  SELECT doc_id, 1, 'access', 18, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0),
    regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT doc_id, 2, 'hex', 16, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0),
    regexp_split_to_array(t, '[0-9a-f]+') FROM d
), u AS (
  SELECT doc_id, k, kind, least_n, unnest(range(1, len(hit) + 1)) AS i, unnest(hit) AS h, unnest(part) AS g,
    unnest(gap[1:len(hit)]) AS before FROM m
), s AS (
  SELECT doc_id, k, kind, least_n, length(g) AS n, length(h) AS w,
    sum(length(before) + length(h)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM u
), kept AS (SELECT doc_id, k, kind, e - w AS b, e FROM s WHERE n >= least_n),
f AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, k) AS spans FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


def _drawn(key: str, node: hash_tree.Node, path: str = "") -> str:
    """The shard of a key as nested SQL: at each level the child of the smallest draw."""
    if not node.children:
        return str(node.shard)
    names = sorted(node.children)
    if len(names) == 1:
        return _drawn(key, node.children[names[0]], f"{path}{names[0]}.")
    draws = [
        f"-ln((CAST('0x' || substr(md5({key} || '/{path}{n}'), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)}) / {node.children[n].weight}"
        for n in names
    ]
    cases = " ".join(f"WHEN {k + 1} THEN {_drawn(key, node.children[n], f'{path}{n}.')}" for k, n in enumerate(names))
    lowest = f"list_position([{', '.join(draws)}], list_min([{', '.join(draws)}]))"
    return f"CASE {lowest} {cases} END"


def _op6() -> str:
    """The CRC is folded over the bytes with a table that the polynomial's rule gives."""
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], repeat([CAST(0 AS BIGINT)], 8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS text_crc32
  FROM d, crc
), p AS (
  SELECT *, {_drawn(key, hash_tree.tree())} AS shard, {_drawn(key, hash_tree.tree(added=1))} AS grown_shard FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard FROM p
"""


_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), able AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b
  ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
  SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT b, c FROM reached JOIN links ON node = a
), groups AS (
  SELECT node, min(c) AS component_id FROM reached GROUP BY node
)
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM groups
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), u AS (SELECT r, lang, source, unnest(found) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM u JOIN kept USING (lang, term) GROUP BY lang, source, term),
sources AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
    CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _op12() -> str:
    """The rounds one after another; distances, sums and quotients in integers."""
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"""d{i} AS (
  SELECT r, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}
), a{i} AS (
  SELECT r, any_value(x) AS x, arg_min(k, d::HUGEINT * 1000 + k) AS k, min(d) AS d FROM d{i} GROUP BY r
)""")
        if i < centroids.ROUNDS:
            steps.append(f"""m{i} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY k, i),
c{i + 1} AS (
  SELECT k, coalesce(any_value(moved), any_value(c)) AS c FROM c{i}
  LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM m{i} GROUP BY k) USING (k) GROUP BY k
)""")
    last = centroids.ROUNDS
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM v ORDER BY k LIMIT 16
), {", ".join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secret_ledger": _OP5,
        "op6_hash_tree": _op6(),
        "op7_exact_dedup": _OP7,
        "op10_cover_tree": _OP10,
        "op11_skyband_audit": _OP11,
        "op12_ns_bounds": _op12(),
    }
