import bz2
import datetime
import gzip
import lzma

from pyspark.sql import functions as F

from glyphlake.functions.patterns import Pattern
from glyphlake.operators.indexes import postings
from glyphlake.sources import files
from glyphlake.streaming import fresh


def write(root, tree):
    for name, body in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)


def test_walk_and_decoding(spark, tmp_path):
    write(tmp_path, {".gitignore": b"*.log\n/skip/\n", "a.txt": b"one", "b.log": b"x", "skip/c.txt": b"x", "sub/.ignore": b"d.txt\n", "sub/d.txt": b"x", "sub/e.txt": b"\xef\xbb\xbfbom", "node_modules/f.txt": b"x", ".h/g.txt": b"x", "u16.txt": "é".encode("utf-16")})
    found = files.walk(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a.txt", "sub/e.txt", "u16.txt"}
    texts = {r.path: r.text for r in files.as_corpus(found).df.collect()}
    assert texts == {"a.txt": "one", "sub/e.txt": "bom", "u16.txt": "é"}
    everything = files.walk(spark, str(tmp_path), show_hidden=True, skip_dirs=False, respect_ignore=False)
    assert everything.count() == 10 and files.walk(spark, str(tmp_path), max_size=1, respect_ignore=False).count() == 3


def test_compression_and_encodings(spark, tmp_path):
    write(tmp_path, {"a.gz": gzip.compress(b"gz"), "b.bz2": bz2.compress(b"bz"), "c.xz": lzma.compress(b"xz"), "d.txt": b"plain", "e.gz": b"broken"})
    texts = {r.path: r.text for r in files.as_corpus(files.walk(spark, str(tmp_path)), decompress=True).df.collect()}
    assert texts == {"a.gz": "gz", "b.bz2": "bz", "c.xz": "xz", "d.txt": "plain", "e.gz": "broken"}
    raw = spark.createDataFrame([(bytearray("é\x80".encode("cp1252", "ignore") + b"\x80"),)], "content binary")
    assert raw.select(files.decode(F.col("content"), "latin1")).first()[0] == "é€"
    assert spark.createDataFrame([(bytearray("日本".encode("shift_jis")),)], "c binary").select(files.decode(F.col("c"), "shift_jis")).first()[0] == "日本"
    upper = files.preprocess(files.walk(spark, str(tmp_path)), lambda _, body: body.upper(), ["*.txt"])
    assert bytes(upper.where("path = 'd.txt'").first().content) == b"PLAIN"


def test_a_stream_keeps_the_index_fresh(spark, tmp_path):
    schema = "doc_id long, path string, text string, mtime timestamp, deleted boolean"
    t = datetime.datetime(2024, 1, 1)
    batches = [
        [(1, "a", "alpha", t, False), (2, "b", "beta", t, False)],
        [(2, "b", "later beta", t + datetime.timedelta(1), False), (2, "b", "old", t, False), (1, "a", None, t, True), (3, "c", "gamma", t, False)],
    ]
    keeper = fresh.IndexKeeper(spark, str(tmp_path / "index"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keeper.follow(fresh.watch(spark, str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination(120)
        assert keeper.current()[0] == k
    _, rows, docs = keeper.current()
    assert {(r.doc_id, r.text) for r in docs.collect()} == {(2, "later beta"), (3, "gamma")}
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in postings(docs).collect()}
    keeper.merge(spark.createDataFrame(batches[0], schema), 1)
    assert keeper.current()[0] == 1


def test_live_matches_and_windows(spark, tmp_path):
    rows = [(1, "a", "x\nneedle", datetime.datetime(2024, 1, 1), False), (2, "b", "needle", datetime.datetime(2024, 1, 1), True)]
    spark.createDataFrame(rows, "doc_id long, path string, text string, mtime timestamp, deleted boolean").write.parquet(str(tmp_path / "in"))
    stream = fresh.live_matches(fresh.watch(spark, str(tmp_path / "in")), Pattern("needle", fixed=True))
    stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert [(r.doc_id, r.line_number) for r in spark.table("live").collect()] == [(1, 2)]
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 1, 5), "a"), (datetime.datetime(2024, 1, 1, 1, 50), "a"), (datetime.datetime(2024, 1, 1, 2), "b")], "ts timestamp, event_type string")
    assert sorted((r.start.hour, r.event_type, r.n) for r in fresh.windowed_counts(events).collect()) == [(1, "a", 2), (2, "b", 1)]


def test_segments_are_written_as_one_and_count_by_their_order(spark, tmp_path):
    schema, t = "doc_id long, path string, text string, mtime timestamp, deleted boolean", datetime.datetime(2024, 1, 1)
    keeper, held = fresh.IndexKeeper(spark, str(tmp_path), most=3), {}
    for k in range(5):
        rows = [(k, "p", f"text {k}", t, False), (k - 1, "p", f"again {k}", t, False), (k - 2, "p", None, t, True)]
        keeper.merge(spark.createDataFrame(rows, schema), k)
        held |= {k: f"text {k}", k - 1: f"again {k}"}
        held.pop(k - 2, None)
        number, postings_, docs = keeper.current()
        assert number == k and {r.doc_id: r.text for r in docs.collect()} == held and len(keeper.segments()) < 3
        assert {tuple(r) for r in postings_.collect()} == {tuple(r) for r in postings(docs).collect()}


def test_labels_and_type_files(spark):
    from glyphlake.functions import paths
    from glyphlake.sources import files

    assert [files.from_label(x) for x in (" Latin1\n", "windows-1251", "SJIS", "utf8", "UNICODE", "x-cp1250")] == ["cp1252", "cp1251", "cp932", "utf-8", "utf-16-le", "cp1250"]
    rows = spark.createDataFrame([(bytearray("“é”".encode("cp1252")),)], "b binary")
    assert rows.select(files.decode(rows.b, "iso-8859-1").alias("t")).first().t == "“é”"
    types = paths.read_types("mine: *.mine, *.my | docs\nweb:include:js,css\n-zig\npy: *.pyw  # more")
    assert types["mine"] == ("docs", ("*.mine", "*.my")) and "*.scss" in types["web"][1] and "zig" not in types and types["py"][1][-1] == "*.pyw"
