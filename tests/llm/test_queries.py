"""The registered queries: names, SQL where there is some, and the pipeline stage by stage."""


import duckdb
import pytest

import corpus_pipeline
from tenderwatch.llm import packing, queries, toxicity
from tests.llm.test_native import LOWER, spans
from tests.llm.test_python import check_packing, components_by_brute_force, true_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = queries.queries()[name](spark, SF_DIR).select(*columns)
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input against brute force; the last in full."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            verdict = toxicity.toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
            bad = {r["doc_id"] for r in verdict.collect() if r["predicted"]}
            kept = [r for r in kept if r[0] not in bad]
        elif name == "exact_dedup":
            last = {}
            for r in kept:
                key = (r[1] or "").translate(LOWER)
                last[key] = max(last.get(key, -1), r[0])
            kept = [r for r in kept if last[(r[1] or "").translate(LOWER)] == r[0]]
        elif name == "simhash_near_dedup":
            kept.sort()
            prints = [true_fingerprint(r[1]) for r in kept]
            near = [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
            root = components_by_brute_force(len(kept), near)
            kept = [r for i, r in enumerate(kept) if root[i] == i]
        elif name == "secret_scans":
            clean = []
            for r in kept:
                text, found = r[1], [tuple(map(int, x.split(":")[1:])) for x in spans(r[1]).split(",") if x]
                merged = []
                for a, b in sorted(found):
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in reversed(merged):
                    text = text[:a] + "[secret]" + text[b:]
                clean.append((r[0], text, *r[2:-1], len(text)))
            kept = clean
        else:
            assert k == len(corpus_pipeline.STAGES) - 1
            check_packing([r[:2] for r in kept], docs.collect(), packing.CAPACITY)
            continue
        assert docs.columns == columns
        assert sorted(rows) == sorted(kept)
