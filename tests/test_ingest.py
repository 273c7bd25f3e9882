"""Readers, insert-ignore, incremental ingest and exports."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.operators import ingest, syncs
from tenderwatch.sources.manifest import Manifest
from tenderwatch.sources.readers import scan_notices
from tenderwatch.sources.sinks import export_csv, write_by_month
from tenderwatch.streaming.ingest import add_batch, rejects, stored_notices, stream_ingest


def test_json_array(spark, tmp_path):
    rows = [
        {"id_del_proceso": "p1", "entidad": "A", "urlproceso": {"url": "https://x"}, "precio_base": "10.5", "other": 1},
        {"id_del_proceso": "p2", "fecha_adjudicacion": "2024-01-02T03:04:05.000", "precio_base": 7},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    df = scan_notices(spark, str(tmp_path), "json", lines=False)
    assert df.drop("_arrival").columns == [n for n, _ in S.NOTICE_FIELDS]
    typed = ingest.coerce_types(ingest.conform_schema(df, 4)).orderBy("id_del_proceso").collect()
    assert [r["fuente_id"] for r in typed] == [4, 4]
    assert json.loads(typed[0]["urlproceso"]) == {"url": "https://x"}
    assert [float(r["precio_base"]) for r in typed] == [10.5, 7.0]
    assert str(typed[1]["fecha_adjudicacion"]) == "2024-01-02 03:04:05"


def test_csv_any_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('precio_base,id_del_proceso,extra\n"1,5",p1,x\n,"p ""2""",y\n')
    df = ingest.conform_schema(scan_notices(spark, str(tmp_path), "CSV"), 1)
    rows = {r["id_del_proceso"]: r["precio_base"] for r in df.collect()}
    assert rows == {"p1": "1,5", 'p "2"': None}
    assert "extra" not in df.columns


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rows><row><id_del_proceso>p1</id_del_proceso><entidad>A &amp; B</entidad></row></rows>")
    assert scan_notices(spark, str(tmp_path), "XML").select("id_del_proceso", "entidad").collect() == [("p1", "A & B")]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        scan_notices(spark, "/nowhere", "PDF")


def test_insert_ignore(spark):
    incoming = spark.createDataFrame(
        [("a", 2), ("a", 1), ("b", 1), (None, 1), (None, 1), ("c", 5)], "id_del_proceso string, seq int"
    )
    stored = spark.createDataFrame([("b", 0), (None, 0)], "id_del_proceso string, seq int")
    added = ingest.insert_ignore(incoming, stored, ["seq"])
    assert sorted(map(tuple, added.collect()), key=str) == sorted([("a", 1), (None, 1), (None, 1), ("c", 5)], key=str)
    r = ingest.sync_result(incoming, added).first()
    assert (r["fetched"], r["inserted"], r["duplicates"], r["since"]) == (6, 4, 2, None)
    assert ingest.insert_ignore(incoming, stored.unionByName(added), ["seq"]).where("id_del_proceso IS NOT NULL").count() == 0


def _land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_two_runs(spark, tmp_path):
    landing, target, offsets = tmp_path / "in", str(tmp_path / "raw"), str(tmp_path / "offsets")

    def run():
        stream_ingest(spark, str(landing), target, offsets, source_id=2).awaitTermination()
        return stored_notices(spark, target)

    _land(landing, "1.json", [{"id_del_proceso": "a", "entidad": "x"}, {"id_del_proceso": "a", "entidad": "y"}, {"entidad": "k"}])
    assert run().count() == 2
    _land(landing, "2.json", [{"id_del_proceso": "a", "entidad": "z"}, {"id_del_proceso": "b"}, {"entidad": "k"}])
    stored = run()
    assert Counter(r["id_del_proceso"] for r in stored.collect()) == {"a": 1, "b": 1, None: 2}
    assert stored.where("id_del_proceso = 'a'").first()["entidad"] == "x"
    assert stored.select("id").distinct().count() == stored.count() == 4
    assert run().count() == 4  # nothing new landed


def _csv_text(rows):
    names = sorted({n for r in rows for n in r})
    return ",".join(names) + "\n" + "\n".join(",".join(r.get(n, "") for n in names) for r in rows) + "\n"


def _xml_text(rows):
    return "<rows>" + "".join("<row>" + "".join(f"<{n}>{v}</{n}>" for n, v in r.items()) + "</row>" for r in rows) + "</rows>"


@pytest.mark.parametrize("fmt, write", [("CSV", _csv_text), ("XML", _xml_text)])
def test_stream_of_any_format_restarts_from_its_checkpoint(spark, tmp_path, fmt, write):
    landing, target = tmp_path / "in", str(tmp_path / "raw")
    landing.mkdir()

    def run():
        stream_ingest(spark, str(landing), target, str(tmp_path / "offsets"), 3, fmt).awaitTermination()
        return Counter((r["id_del_proceso"], r["entidad"]) for r in stored_notices(spark, target).collect())

    for k in range(3):
        (landing / f"a [{k}] {{x}}.dat").write_text(write([{"id_del_proceso": f"p{k}", "entidad": f"e{k}"}, {"entidad": "k"}]))
    first = Counter({(f"p{k}", f"e{k}"): 1 for k in range(3)} | {(None, "k"): 3})
    assert run() == first
    (landing / "b.dat").write_text(write([{"id_del_proceso": "p1", "entidad": "later"}, {"id_del_proceso": "p9", "entidad": "new"}]))
    assert run() == first + Counter({("p9", "new"): 1})


def arrived(df):
    order = F.struct(F.current_timestamp().alias("at"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("split"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("_arrival", order)


def test_retried_batch_is_taken_once(spark, tmp_path):
    target = str(tmp_path / "raw")
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "id_del_proceso string, precio_base string")
    for _ in range(2):
        add_batch(arrived(df), target, 1, "w", 0)
    assert stored_notices(spark, target).count() == 2
    # a lost job has left half of a batch behind: it is invisible, and the retry replaces it
    stored_notices(spark, target).drop("writer", "batch").write.parquet(f"{target}/writer=w/batch=1")
    assert stored_notices(spark, target).count() == 2
    more = df.unionByName(df.limit(1).withColumn("id_del_proceso", F.lit("c")))
    assert add_batch(arrived(more), target, 1, "w", 1)["inserted"] == 1
    assert add_batch(arrived(more), target, 1, "w", 1) == {}
    rows = stored_notices(spark, target).collect()
    assert sorted(r["id_del_proceso"] for r in rows) == ["a", "b", "c"] and len({r["id"] for r in rows}) == 3


def test_first_to_arrive_wins_and_nothing_vanishes(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "raw")
    day = "2023-05-05T00:00:00"
    full = {"id_del_proceso": "k", "entidad": "buyer", "precio_base": "5", "fecha_de_publicacion_del": day}
    _land(landing, "1.json", [full, {"id_del_proceso": "k", "fecha_de_publicacion_del": day}])
    _land(landing, "2.json", [{"id_del_proceso": "u", "fecha_de_publicacion_del": "15/10/2023"}, {"id_del_proceso": "n"}])
    _land(landing, "3.json", [{"id_del_proceso": "o", "fecha_de_publicacion_del": "2019-01-01T00:00:00", "precio_base": "x"}])
    counts = add_batch(scan_notices(spark, str(landing), "JSON"), target, 1, "w", 0, since="2020-01-01")
    assert counts == {"fetched": 5, "inserted": 1, "duplicates": 1, "rejected": 2, "outside": 1, "bad_values": 2}
    assert stored_notices(spark, target).first()["entidad"] == "buyer"
    kept = {(r["id_del_proceso"], r["reason"], r["value"]) for r in rejects(spark, target).collect()}
    assert kept == {("u", "UNREADABLE", "15/10/2023"), ("u", "UNDATED", None), ("n", "UNDATED", None), ("o", "UNREADABLE", "x")}


def test_two_streams_and_a_lost_checkpoint_share_a_store(spark, tmp_path):
    target = str(tmp_path / "raw")
    for source, name in ((1, "a"), (2, "b")):
        _land(tmp_path / name, "1.json", [{"id_del_proceso": f"{name}{i}"} for i in range(5)] + [{"id_del_proceso": "both"}])
        stream_ingest(spark, str(tmp_path / name), target, str(tmp_path / f"offsets-{name}"), source).awaitTermination()
    assert Counter(r["fuente_id"] for r in stored_notices(spark, target).collect()) == {1: 6, 2: 5}
    _land(tmp_path / "a", "2.json", [{"id_del_proceso": "new"}])
    stream_ingest(spark, str(tmp_path / "a"), target, str(tmp_path / "offsets-new"), 1).awaitTermination()
    rows = stored_notices(spark, target).collect()
    assert len(rows) == len({r["id"] for r in rows}) == len({r["id_del_proceso"] for r in rows}) == 12


def test_concurrent_change_of_a_manifest_is_noticed(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"), "k string, n bigint")
    m.put({"k": "a", "n": 1}, ["k"])
    seen = m.version()
    m.put({"k": "a", "n": 2}, ["k"])
    with pytest.raises(RuntimeError):
        m.put({"k": "b", "n": 3}, ["k"], after=seen)
    for n in range(6):
        m.put({"k": f"x{n}", "n": n}, ["k"])
    assert m.rows().count() == 7 and len(list((tmp_path / "m").glob("v=*"))) <= 4


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id_del_proceso,entidad,nombre_del_proveedor\np1,Buyer1,Supp1\n")
    (tmp_path / "b.csv").write_text('"nombre_del_proveedor","id_del_proceso",entidad,precio_base\nSupp2,p2,Buyer2,7\n')
    (tmp_path / "c.csv").write_text("\ufeffentidad,id_del_proceso\nBuyer3,p3\n")
    rows = scan_notices(spark, str(tmp_path), "CSV").collect()
    assert {(r["id_del_proceso"], r["entidad"], r["nombre_del_proveedor"], r["precio_base"]) for r in rows} == {
        ("p1", "Buyer1", "Supp1", None), ("p2", "Buyer2", "Supp2", "7"), ("p3", "Buyer3", None, None),
    }


def bytes_read(spark):
    return sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_csv_is_read_once(spark, tmp_path):
    """Headers cost no second pass over the landed files, and a file may be read by many tasks."""
    landing = tmp_path / "in"
    landing.mkdir()
    for k in range(3):
        lines = [f"p{k}-{n},{'x' * 80},Buyer {n}" for n in range(20_000)]
        (landing / f"{k}.csv").write_text("id_del_proceso,pad,entidad\n" + "\n".join(lines) + "\n\n")
    (landing / "other.csv").write_text("entidad,unknown,id_del_proceso,precio_base\nBuyer,u,q1,7\nshort\n")
    (landing / "headless.csv").write_text("nothing,known\n1,2\n")
    size = sum(f.stat().st_size for f in landing.iterdir())
    before = bytes_read(spark)
    rows = scan_notices(spark, str(landing), "CSV")
    # stored lines are compressed Parquet, read in part for the headers
    assert bytes_read(spark) - before < 1.3 * size
    found = {r["id_del_proceso"]: (r["entidad"], r["precio_base"]) for r in rows.where("NOT id_del_proceso LIKE 'p%'").collect()}
    assert found == {"q1": ("Buyer", "7")}
    assert rows.count() == 60_003 and rows.where("id_del_proceso IS NULL").count() == 2
    assert rows.where("id_del_proceso = 'p1-19999'").first()["entidad"] == "Buyer 19999"


def test_a_large_xml_file_is_shared_out(spark, tmp_path):
    row = "<row>\n <id_del_proceso>p{0}</id_del_proceso><entidad> A &amp; &lt;{0} </entidad><urlproceso><url>http://x/{0}</url></urlproceso>\n</row>"
    odd = "<row/> <row a='1' /><row a='b'><entidad>attr</entidad></row><rows><row\n><entidad>nested</entidad></row></rows>"
    body = "".join(row.format(n) if n % 100 else odd for n in range(4000))
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<rows>\n{body}</rows>\n')
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        cut = scan_notices(spark, str(tmp_path), "XML")
        assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        rows = Counter(map(tuple, cut.drop("_arrival").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    whole = scan_notices(spark, str(tmp_path), "XML", whole=True)
    plain = spark.read.option("rowTag", "row").schema(S.LANDED_SCHEMA).xml(str(tmp_path))
    assert rows == Counter(map(tuple, whole.drop("_arrival").collect())) == Counter(map(tuple, plain.collect()))
    assert sum(rows.values()) == 3960 + 4 * 40


def test_publication_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "by_month")
    days = spark.range(400).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("fecha_de_publicacion_del"))
    write_by_month(days.unionByName(days.limit(1).withColumn("fecha_de_publicacion_del", F.lit(None).cast("timestamp"))), path, "fecha_de_publicacion_del")
    kept = ingest.publication_window(spark.read.parquet(path), "2020-03-01", "2020-03-31")
    plan = kept._jdf.queryExecution().toString()
    assert kept.count() == 31
    assert "PushedFilters: [IsNotNull(fecha_de_publicacion_del), GreaterThanOrEqual" in plan
    assert "PartitionFilters: [isnotnull(published_month" in plan
    assert spark.read.parquet(path).count() == 401


def test_due_sources(spark):
    rows = [
        (1, "2020-01-01 12:00:00", 5, True), (2, "2020-01-02 12:00:01", 5, True), (3, None, 5, True), (4, None, 5, False),
    ]
    df = spark.createDataFrame(rows, "id int, last string, every_days int, active boolean").withColumn("last_sync", F.col("last").cast("timestamp"))
    assert sorted(r["id"] for r in syncs.due_sources(df, "2020-01-07 12:00:00").collect()) == [1, 3]


def test_export_format(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"; b', None), (2, "é\nline", "x")], 'id int, `na"me.x` string, note string')
    export_csv(df.coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.startswith(b'\xef\xbb\xbf"id";"na""me.x";"note"\n')
    assert data.decode("utf-8-sig") == '"id";"na""me.x";"note"\n"1";"a ""q""; b";""\n"2";"é\nline";"x"\n'


def test_every_exported_file_has_mark_and_header(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("ñ "), F.col("id").cast("string")).alias("name")).repartition(5)
    export_csv(df.where("id % 7 > 0"), str(tmp_path / "out"))
    files = [f.read_bytes() for f in (tmp_path / "out").glob("part-*")]
    assert len(files) == 5 and all(f.startswith('\ufeff"id";"name"\n'.encode()) and f.count(b'"id"') == 1 for f in files)
    back = spark.read.options(header=True, sep=";", quote='"', escape='"').csv(str(tmp_path / "out"))
    assert back.columns == ["id", "name"]
    want = [(str(i), f"ñ {i}") for i in range(1000) if i % 7]
    assert sorted(map(tuple, back.collect())) == sorted(want)
    export_csv(df.limit(0), str(tmp_path / "none"))
    assert [f.read_bytes() for f in (tmp_path / "none").glob("part-*")] == ['\ufeff"id";"name"\n'.encode()]
