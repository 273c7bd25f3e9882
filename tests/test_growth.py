"""What keeps bytes moved and written in proportion to the input, and few."""

import re
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenderwatch.functions import normalise as N
from tenderwatch.operators import ingest, normalise, search
from tenderwatch.operators.scale import first_per_key
from tenderwatch.plans import catalog
from tenderwatch.plans.pipeline import Pipeline, pipeline
from tenderwatch.sources import testdata
from tenderwatch.sources.key_index import KeyIndex
from tenderwatch.sources.part_store import PartStore
from tenderwatch.sources.readers import scan_notices
from tenderwatch.sources.storage import settle, shared_root
from tenderwatch.streaming.ingest import _as_stored

SF_DIR = "/root/testdata/sf0.001"


def codecs(folder):
    files = [pq.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
    return {m.row_group(g).column(c).compression for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)}


@pytest.fixture
def large(spark):
    """Plans as for tables of which none can be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("build", [testdata.raw_notices, testdata.arriving_notices])
def test_lines_are_dealt_by_order_once_and_customers_go_to_orders(spark, large, build):
    df = build(spark, SF_DIR)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#\w+(?:, (\w+)#)?", text)
    assert keys.count(("l_orderkey", "l_linenumber")) == 0 and keys.count(("l_orderkey", "")) == 1
    dealt = text.splitlines()
    custkey = next(n for n, line in enumerate(dealt) if "hashpartitioning(o_custkey" in line)
    assert "l_orderkey" not in " ".join(dealt[custkey : custkey + 4])  # orders alone move by customer


def test_copies_and_orphans_of_lines_are_as_before(spark, tmp_path):
    """The first copy of a line counts, even where its part is unknown."""
    for name in ("region", "nation", "supplier", "customer", "orders", "part"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").limit(50)
    first = lines.withColumn("l_shipdate", F.col("l_shipdate") - F.expr("INTERVAL 9000 DAYS")).withColumn("l_partkey", F.lit(-1).cast("long"))
    lines.unionByName(first.where("l_linenumber = 1")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = testdata.raw_notices(spark, str(tmp_path))
    known = lines.where("l_linenumber <> 1").select("l_orderkey", "l_linenumber").distinct()
    assert found.where("id % 10 = 1").isEmpty() and found.count() == known.count()


def test_stored_tables_are_packed(spark):
    stored = settle(spark.range(10), "packed")
    assert codecs(Path(urlparse(stored.inputFiles()[0]).path).parent) == {"ZSTD"}


@pytest.mark.parametrize(("name", "label"), [("scan_notices_xml", "xml"), ("scan_notices_csv", "csv"), ("scan_notices_json_array", "arrays"), ("scan_notices_json", "json")])
def test_landed_text_is_compressed_and_shared_out(spark, monkeypatch, name, label):
    monkeypatch.setitem(catalog._LANDED_AS, "maxRecordsPerFile", 1000)
    p = pipeline(spark, SF_DIR)
    n = catalog._QUERIES[name](p).count()
    assert n == p.raw.count()
    newest = max(Path(shared_root(spark)).rglob(f"landed-{label}-*"), key=lambda f: f.stat().st_mtime)
    files = [f for f in newest.rglob("part-*") if f.is_file()]
    assert files and all(f.suffix == ".gz" for f in files)
    assert label == "arrays" or len(files) >= n / 1000


def test_small_parts_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    """Tasks follow the rows, parts their size; each part is a sorted stretch of the key."""
    monkeypatch.setattr("tenderwatch.sources.part_store.TASK_ROWS", 1000)
    store = PartStore(spark, str(tmp_path / "s"), "raw_id", part_rows=10)
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("raw_id"))
    store.write({"t": rows}, "a")
    parts = store.parts("t")
    assert parts.agg(F.sum("n_rows"), F.max("n_rows")).first() == (5000, 10) and parts.count() < 520
    files = [f.name for f in (tmp_path / "s" / "t").rglob("*.parquet")]
    assert len({name.split("-")[1] for name in files}) <= 6
    assert codecs(tmp_path / "s") >= {"ZSTD"} and codecs(tmp_path / "s" / "t") == {"ZSTD"}
    for file in list((tmp_path / "s" / "t").rglob("*.parquet"))[:20]:
        ids = pq.read_table(file, partitioning=None)["raw_id"].to_pylist()
        assert ids == list(range(ids[0], ids[0] + len(ids)))


def test_index_segments_are_packed(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "k"), "k", bucket_keys=10)
    index.add(spark.range(100).select(F.col("id").cast("string").alias("k")), "w", 0)
    assert codecs(tmp_path / "k") == {"ZSTD"}


def test_streamed_landings_and_stores_are_packed(spark):
    before = set(Path(shared_root(spark)).rglob("landing-*"))
    catalog._QUERIES["stream_ingest"](pipeline(spark, SF_DIR)).count()
    landed = [f for d in set(Path(shared_root(spark)).rglob("landing-*")) - before for f in d.rglob("part-*")]
    assert landed and all(f.suffix == ".gz" for f in landed)


@pytest.mark.parametrize("name", ["record_issues_write", "modified_contracts", "upsert_contracts"])
def test_joins_move_hashes_packed(spark, large, name):
    df = catalog._QUERIES[name](pipeline(spark, SF_DIR))
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").splitlines()
    moved = [text[n + 1] for n, line in enumerate(text) if "Exchange hashpartitioning(raw_id" in line]
    assert sum("packed#" in line for line in moved) >= 2
    assert not any(re.search(r"[\[ ](old_)?row_hash#\d+[,\]]|AS (old_)?row_hash#", line) for line in moved)
    computed = [line for line in text if "Filter" in line and "sha2(" in line]
    assert not computed  # no hash is computed once more to filter by it


def test_packed_hashes_are_equal_where_hashes_are(spark):
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:62], digest + "\n", "\x00" * 33 + digest, "", "ñ", None, "x" * 32, "\x00" * 32]
    rows = spark.createDataFrame(enumerate(texts), "i int, h string").withColumn("p", N.pack_hash(F.col("h")))
    found = rows.select("h", "p", N.unpack_hash(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert all(r["back"] == r["h"] for r in found)
    assert len({bytes(r["p"]) for r in found if r["p"] is not None}) == len(texts) - 1
    assert [r["n"] for r in found][:2] == [32, 97]


def test_odd_hashes_are_compared_as_before(spark):
    """Hashes of another kind, in capitals or missing."""
    digest = "0123456789abcdef" * 4

    def rows(hashes):
        return spark.createDataFrame(
            [(i, i, h, 100, False, False) for i, h in enumerate(hashes)],
            "id long, raw_id long, row_hash string, confidence int, is_incomplete boolean, is_suspicious boolean",
        )
    now, old = rows([digest, digest, "x", "x", None, digest, digest]), rows([digest, digest.upper(), "x", "y", "x", None])
    changed = search.modified_contracts(now, old)
    assert changed.columns == ["raw_id", "id", *now.columns[2:]]
    assert {(r["raw_id"], r["row_hash"]) for r in changed.collect()} == {(1, digest), (3, "x")}
    actions = normalise.upsert_actions(now, old, True)
    assert actions.columns == [*now.columns, "action"]
    found = [(r["row_hash"], r["action"]) for r in actions.orderBy("raw_id").collect()]
    assert found == list(zip([digest, digest, "x", "x", None, digest, digest], ["skip", "update", "skip", "update", "update", "insert", "insert"]))


def test_snapshot_is_not_stored_and_notices_lie_by_id(spark):
    p = Pipeline(spark, SF_DIR)
    before = set(Path(shared_root(spark)).rglob("earlier_contracts-*"))
    assert p.earlier_contracts.count() == p.raw.count()
    assert set(Path(shared_root(spark)).rglob("earlier_contracts-*")) == before
    for file in p.raw.inputFiles():
        ids = pq.read_table(urlparse(file).path, columns=["id"], partitioning=None)["id"].to_pylist()
        assert ids == sorted(ids)


def test_notices_of_a_batch_move_once(spark, large, tmp_path):
    """Single notices and copies come out of one exchange, whatever is known of their keys."""
    p = pipeline(spark, SF_DIR)
    p.arriving.drop("fuente_id").write.json(str(tmp_path / "in"))
    landed = settle(ingest.conform_schema(scan_notices(spark, str(tmp_path / "in"), "JSON"), 1))
    stored = p.arriving.where("fecha_adjudicacion < '1998-01-01'").select("id_del_proceso")
    found = _as_stored(ingest.insert_ignore(ingest.coerce_types(landed), stored, ["_arrival"]), 5)
    rows = found.collect()
    assert min(r["id"] for r in rows) >= 5 and all(r["sincronizado_en"] for r in rows)
    text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple").split("== Initial Plan ==")[0].splitlines()
    dealt = [n for n, line in enumerate(text) if "Exchange hashpartitioning(id_del_proceso" in line]
    wide = [n for n in dealt if "Reused" not in text[n] and "entidad#" in text[n + 1]]
    assert len(wide) == 1 and any("ReusedExchange" in line for line in text)


def test_choosing_csv_columns_compiles(spark, tmp_path):
    """A row's columns are taken in one loop over where they stand, not by a choice for each."""
    (tmp_path / "a.csv").write_text("entidad,id_del_proceso,unknown\nA,p1,x\nB\n")
    df = scan_notices(spark, str(tmp_path), "CSV")
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "CASE WHEN" not in text
    assert {(r["id_del_proceso"], r["entidad"], r["precio_base"]) for r in df.collect()} == {("p1", "A", None), (None, "B", None)}


def test_keys_stored_or_repeated_are_found_together(spark):
    """Copies among arriving and stored keys, keys without a value, and nothing to compare with."""
    schema = "k string, at int, v string"
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), ("b", 0, "z"), ("c", 1, "w"), (None, 1, "n")], schema)
    stored = spark.createDataFrame([("b", 0, ""), ("b", 1, ""), ("c", 0, ""), (None, 0, "")], schema)
    found = sorted(map(tuple, first_per_key(rows, "k", ["at"], stored).collect()))
    assert found == [("a", 1, "y")]
    assert sorted(map(tuple, first_per_key(rows, "k", ["at"], stored.limit(0)).collect())) == [("a", 1, "y"), ("b", 0, "z"), ("c", 1, "w")]
    assert ingest.insert_ignore(rows, stored, ["at"], "k").count() == 2


def test_upsert_merge_computes_its_actions_once(spark, large):
    p = pipeline(spark, SF_DIR)
    df = catalog._QUERIES["upsert_merge"](p)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    moved = re.findall(r"Exchange hashpartitioning\((?:old_)?raw_id#", text)
    assert len(moved) == 3  # contracts, the stored state that decides, and the stored rows


def test_upsert_merge_of_odd_rows(spark):
    """Rows without an id meet nothing; hashes of another kind, in capitals or missing come out as they went in."""
    digest = "0123456789abcdef" * 4
    schema = "id long, raw_id long, row_hash string, confidence int, is_incomplete boolean, is_suspicious boolean"

    def rows(found):
        return spark.createDataFrame([(i, raw_id, h, 100, False, False) for i, (raw_id, h) in enumerate(found)], schema)
    stored = rows([(1, digest), (2, "x"), (3, None), (4, digest.upper()), (None, "null"), (6, "gone?")])
    fresh = rows([(1, digest), (2, "y"), (3, digest), (4, digest), (None, "new"), (7, None)])
    merged = normalise.upsert_merge(normalise.upsert_actions(fresh, stored, True), stored)
    assert merged.columns == stored.columns
    found = sorted(((r["raw_id"], r["row_hash"]) for r in merged.collect()), key=str)
    want = [(1, digest), (2, "y"), (3, digest), (4, digest), (None, "null"), (None, "new"), (6, "gone?"), (7, None)]
    assert found == sorted(want, key=str)
