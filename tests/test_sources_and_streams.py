import io
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.operators.hooks import ByteEmbedder
from marlstone.sources import attachments, databases, files, tables
from marlstone.streaming import embedding


def docx(text, table):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p(text) + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in table) + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}>{p('head')}</w:hdr>")
    return out.getvalue()


def png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def test_parsers():
    data = docx("main text", ["a", "b"])
    assert files.docx_text(data) == {"main": "main text", "tables": "a | b"}
    assert files.docx_text(data, tables=False, headers=True)["header"] == "head"
    assert files.html_text("<head><title>t</title></head><p>a &amp; b<script>x</script><p>c") == "a & b\nc" and files.html_text(None) is None
    assert files.image_size(png(3, 5)) == (3, 5, "png") and files.image_size(b"xx") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01\x01\x11\x00"
    assert files.image_size(jpeg) == (9, 7, "jpeg")


def test_load(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>page</p>")
    (tmp_path / "b.docx").write_bytes(docx("word", ["x"]))
    (tmp_path / "c.xlsx").write_text("plain fallback")
    (tmp_path / "d.txt").write_text("  ")
    (tmp_path / "e.png").write_bytes(png(2, 4))
    found = files.load_documents(spark, str(tmp_path)).where("metadata NOT LIKE '%png%'")
    got = {r["content"]: r["metadata"] for r in found.collect()}
    assert set(got) == {"page", "word\nx", "plain fallback"} and '"filetype":".html"' in got["page"]
    i = files.images(files.files(spark, str(tmp_path), "*.png")).first()
    assert (i["width"], i["height"], i["format"], i["ocr_text"]) == (2, 4, "png", None)


def test_pdf_pages(spark):
    pages = spark.createDataFrame([("f", 1, "One  page é " * 20), ("f", 2, "tiny"), ("f", 3, "Three pages " * 20)], "path string, page_no int, text string")
    assert files.pdf_documents(pages).count() == 2
    text = files.pdf_documents(pages, to_pages=False).first()["content"]
    assert text.startswith("\n\n--- 页面 1 ---\n\nOne page ") and "é" not in text and "--- 页面 3 ---" in text


def test_attachments(spark, tmp_path):
    store = attachments.AttachmentStore(spark, str(tmp_path))
    rows = [store.store(f"f{i}.txt", f"content {i}".encode(), '{"k": 1}') for i in range(3)]
    meta = store.table(rows)
    assert {r["file_id"] for r in store.listing().collect()} == {r["file_id"] for r in rows}
    assert store.listing(rows[0]["file_id"][:8]).count() == 3 and store.listing("19990101").count() == 0
    got = {bytes(r["content"]) for r in store.contents(meta).collect()}
    assert got == {b"content 0", b"content 1", b"content 2"}
    left = store.delete(meta, rows[0]["file_id"])
    assert left.count() == 2 and store.listing().count() == 2
    (tmp_path / "src.txt").write_text("x")
    assert store.store_file(str(tmp_path / "src.txt"))["file_size"] == 1


def test_report_and_tables(spark, tmp_path, sf):
    docs = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, content string")
    files.report(docs, "T", str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text == "# T\n\n## 1\n\na\n\n## 2\n\nb\n\n"
    tables.register(spark, sf, "ns_", ("nation",))
    assert tables.sql(spark, "SELECT n_name FROM ns_nation WHERE n_nationkey = :k", k=3).count() == 1
    tables.snapshot(docs, str(tmp_path / "s"), "id")
    assert tables.read(spark, str(tmp_path / "s"), "parquet").count() == 2
    docs.write.json(str(tmp_path / "j.json"))
    docs.write.csv(str(tmp_path / "c.csv"), header=True)
    assert tables.read(spark, str(tmp_path / "j.json")).count() == tables.read(spark, str(tmp_path / "c.csv")).count() == 2


def test_worker_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("1", "abc", None, "pending"), ("2", None, None, "pending"), ("3", "x", [1.0], "completed")], "id string, content string, embedding array<float>, embedding_status string")
    e = ByteEmbedder(4)
    want = {tuple(map(str, r)) for r in embedding.embed_pending(rows, e).collect()}
    rows.write.parquet(str(tmp_path / "in"))
    q = embedding.embedding_worker(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), rows.schema, e, None)
    assert embedding.wait(q, 60)
    got = spark.read.parquet(str(tmp_path / "out")).select(rows.columns)
    assert {tuple(map(str, r)) for r in got.collect()} == want
    assert {r["id"]: r["embedding_status"] for r in got.collect()} == {"1": "completed", "2": "failed", "3": "completed"}
    assert embedding.embed_backlog(rows, e, 1).where("embedding_status = 'pending'").count() == 1


def test_stream_windows(spark, tmp_path, sf):
    events = tables.parquet(spark, sf, "events").select("ts", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    agg = {"n": F.count(F.lit(1))}
    out = embedding.windowed(stream, "1 hour", late="10 minutes", by=("event_type",), **agg)
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = embedding.windowed(events, "1 hour", by=("event_type",), **agg)
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in want.collect()}
    assert embedding.windowed(events, "1 hour", "30 minutes", **agg).agg(F.sum("n")).first()[0] == 2 * events.count()


def test_sqlite_and_workbooks(spark, tmp_path):
    for k in range(2):
        con = sqlite3.connect(f"{tmp_path}/d{k}.db")
        con.execute('CREATE TABLE "items" (id INTEGER, name TEXT, price REAL, note BLOB)')
        con.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(i, f"n{i}", i / 4, None if i % 2 else b"raw") for i in range(k, k + 3)])
        con.commit()
        con.close()
    got = databases.sqlite_table(spark, f"file://{tmp_path}/*.db", "items", "id long, name string, price double, note string").drop("path").collect()
    assert sorted(tuple(r) for r in got if r["note"] is None) == [(1, "n1", 0.25, None), (1, "n1", 0.25, None), (3, "n3", 0.75, None)]
    assert len(got) == 6 and {r["note"] for r in got} == {None, "raw"}
    with pytest.raises(Exception, match="no such table"):
        databases.sqlite_table(spark, f"file://{tmp_path}/d0.db", "none", "id long").collect()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(f"{tmp_path}/b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="First"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row><row r="4"/></sheetData></worksheet>')
    rows = databases.workbook_rows(spark, f"file://{tmp_path}/*.xlsx").drop("path").collect()
    assert [tuple(r) for r in rows] == [("First", 1, ["name", None, "1.5"]), ("First", 3, [None, "rich", "in"])]


def test_stream_join_and_state(spark, sf, tmp_path):
    events = tables.parquet(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    events.where("event_id % 2 = 0").repartition(3).write.parquet(f"{tmp_path}/a")
    events.where("event_id % 2 = 1").repartition(3).write.parquet(f"{tmp_path}/b")
    read = lambda x: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}")
    right = lambda df: df.select(F.col("user_id").alias("other"), F.col("ts").alias("at"), F.col("event_id").alias("right_id"))
    near = F.col("at").between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    how = lambda a, b: embedding.joined(a, right(b), F.col("user_id") == F.col("other"), near, "400 days").select("event_id", "right_id")
    q = how(read("a"), read("b")).writeStream.format("memory").queryName("ms_joined").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = how(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"))
    assert sorted(map(tuple, spark.table("ms_joined").collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    q = embedding.running(read("a"), "user_id", "value").writeStream.format("memory").queryName("ms_running").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(300)
    last = spark.table("ms_running").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    want = spark.read.parquet(f"{tmp_path}/a").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert {r["user_id"]: (r["n"], round(r["total"], 6)) for r in last.collect()} == {r["user_id"]: (r["n"], round(r["total"], 6)) for r in want.collect()}
