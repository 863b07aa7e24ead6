"""Containers, pages, memory files, sinks and streams on files in a fresh folder."""

import hashlib
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from glossweave.operators.covers import choose
from glossweave.operators.paragraphs import page_paragraphs
from glossweave.sources import containers, memory_files, sinks
from glossweave.sources.pages import _stretches, read_elements, with_elements
from glossweave.streaming import ingest, memory, status

OPF = """<?xml version="1.0"?><package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>
<dc:title>A &amp; B</dc:title><dc:title>Second</dc:title><dc:creator id="c">Ann</dc:creator>
<dc:language>EN-us</dc:language><meta content="cov" name="cover"/></metadata><manifest>
<item id="c1" href="c1.xhtml"/><item id="cov" href="img/c.jpg"/></manifest></package>"""


def book(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return path


def shelf(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    book(folder / "one .epub", {"OEBPS/p.opf": OPF, "OEBPS/c1.xhtml": "<p>Hello there</p><p>Figure 1</p><p>Figure 1</p>",
                                "OEBPS/img/c.jpg": b"12", "OEBPS/img/big.jpg": b"1234"})
    book(folder / "two_x.epub", {"a.htm": "<h1>T</h1>"})
    book(folder / "no_html.epub", {"a.txt": "x"})
    (folder / "bad.epub").write_bytes(b"not a zip")
    (folder / "other.txt").write_text("x")
    return folder


def test_containers(spark, tmp_path):
    folder = shelf(tmp_path)
    files = containers.read_containers(spark, str(folder))
    assert files.count() == 4
    listed = containers.members(files)
    valid = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.is_valid
             for r in containers.valid_containers(files, listed).collect()}
    assert valid == {"one .epub": True, "two_x.epub": True, "no_html.epub": False, "bad.epub": False}
    found = {r.filename: r for r in containers.scan(spark, str(folder)).collect()}
    assert {n: (r.title, r.author, r.language) for n, r in found.items()} == {
        "one.epub": ("A & B", "Ann", "en-us"), "two_x.epub": ("two x", None, "en")}
    sums = {r.md5 for r in containers.file_hash(files).collect()}
    assert hashlib.md5((folder / "bad.epub").read_bytes()).hexdigest() in sums
    covers = choose(containers.cover_candidates(listed)).collect()
    assert [(r.member, r.chosen_by) for r in covers] == [("OEBPS/img/c.jpg", "package")]
    items = with_elements(containers.container_items(listed))
    rows = page_paragraphs(items, ["book_id", "item_id"]).orderBy("id").collect()
    assert [(r.id, r.text, r.original_id) for r in rows] == [
        ("OEBPS_c1.xhtml_0", "Hello there", None), ("OEBPS_c1.xhtml_1", "Figure 1", None),
        ("OEBPS_c1.xhtml_2", "Figure 1", "OEBPS_c1.xhtml_1")]


def test_page_reading():
    page = ("<div class='Main nav-bar' id=top>loose text<p>One <b>two</b><p>Three<br>four</div>"
            "<ul><li>a<li>b <a href=x>link</a></ul><script>var x='<p>no</p>'</script><h2>Part <i>1</i></h2>")
    got = {(e["tag"], e["doc_pos"]): e for e in read_elements(page)}
    texts = [(e["tag"], e["text"], e["bare"]) for e in got.values()]
    assert ("div", None, ["loose text"]) in texts
    assert ("p", "Onetwo", []) in texts and ("p", "Threefour", []) in texts
    assert ("li", "a", []) in texts and ("li", "blink", []) in texts and ("a", "link", []) in texts
    assert next(e["title"] for e in got.values() if e["tag"] == "h2") == "Part 1"
    assert read_elements(None) == []


def test_references_without_their_semicolon():
    page = '<title>a &amp; b&amp</title><p id="x&amp">c &ampx; &quot;d&quot; &#233; &#23 e&lt; \ue000</p>'
    title, p = read_elements(page)
    assert title["title"] == "a & b&amp"
    assert p["text"] == 'c &ampx; "d" é &#23 e< \ue000'
    assert p["elem_id"] == "x&amp"


def test_elements_come_in_bounded_stretches():
    pages = pa.array(["x" * 600_000, "x" * 600_000, None, "x" * 3_000_000, "x", "y"])
    assert list(_stretches(pages)) == [(0, 1), (1, 2), (3, 1), (4, 2)]
    assert list(_stretches(pages.slice(0, 0))) == []


def test_excluded_marks(spark):
    page = "<p class='nav'>navigation text</p><p id='page-header'>header text</p><p class='indexed'>kept text</p><nav><p>inside nav</p></nav>"
    items = with_elements(spark.createDataFrame([(1, "i", page)], "page_id int, item_id string, html string"))
    assert [r.text for r in page_paragraphs(items, ["page_id", "item_id"]).orderBy("idx").collect()] == [
        "kept text", "inside nav"]


def test_memory_files(spark, tmp_path):
    h = lambda t: hashlib.md5(t.encode()).hexdigest()
    data = {"cache": {h(t): {"source": t, "translated": x, "timestamp": ts} for t, x, ts in
                      [("a", "甲", 1000.0), ("b", "", 1000.0), ("c", "丙", 5.0), ("d", "丁", 2592000.0)]}}
    path = tmp_path / "cache.json"
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
    read = memory_files.read_memory_json(spark, str(path))
    assert read.count() == 4
    held = spark.createDataFrame([(h("d"),)], "source_hash string")
    new = memory_files.new_entries(read, held)
    assert sorted(r.source_text for r in new.collect()) == ["a", "c"]
    again = new.select("source_hash").union(held)
    assert memory_files.new_entries(read, again).count() == 0
    live = memory_files.not_expired(read, 2592000 + 1000.0)
    assert sorted(r.source_text for r in live.collect()) == ["a", "b", "d"]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("b", "line 1\nline 2", "note"), ("c", "text", "")],
                                  "book_id string, listing string, note string")
    folder = str(tmp_path / "texts")
    sinks.write_listing_texts(texts, folder)
    back = sinks.read_listing_texts(spark, folder)
    assert {(r.book_id, r.kind, r.text.rstrip("\n")) for r in back.collect()} == {
        ("b", "listing", "line 1\nline 2"), ("b", "note", "note"), ("c", "listing", "text")}
    table = str(tmp_path / "table")
    sinks.write_table(texts.select("book_id", "listing"), table, by=["book_id"])
    old = sinks.read_table(spark, table, "listing string, added int, book_id string")
    assert [r.added for r in old.collect()] == [None, None]
    sinks.run_stats_json(texts.select("book_id"), str(tmp_path / "stats"))
    assert spark.read.schema("book_id string").json(str(tmp_path / "stats")).count() == 2
    plan = sinks.archive_plan(
        spark.createDataFrame([("a.epub",), ("b.epub",), ("c.txt",)], "filename string"),
        spark.createDataFrame([("a.epub",)], "filename string"), F.lit("20240101_000000"))
    assert {r.filename: r.target for r in plan.collect()} == {
        "a.epub": "a_20240101_000000.epub", "b.epub": "b.epub"}


def test_ingest_stream(spark, tmp_path):
    folder = shelf(tmp_path)
    books, checkpoint = str(tmp_path / "books"), str(tmp_path / "cp")
    stream = ingest.container_stream(spark, str(folder), files_per_batch=2)
    assert stream.isStreaming
    ingest.ingest(stream, books, checkpoint).awaitTermination(120)
    read = lambda: spark.read.schema(ingest.BOOK_ROWS).parquet(books).collect()
    assert sorted(r.filename for r in read()) == ["one.epub", "two_x.epub"]
    book(folder / "three.epub", {"a.html": "<p>x</p>"})
    ingest.ingest(ingest.container_stream(spark, str(folder)), books, checkpoint).awaitTermination(120)
    assert sorted(r.filename for r in read()) == ["one.epub", "three.epub", "two_x.epub"]


def _files(spark, rows, schema, folder):
    for n, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_memory_streams(spark, tmp_path):
    schema = "source_text string, translated_text string, ts timestamp_ntz"
    from datetime import datetime

    rows = [("a", "1", datetime(2024, 1, 1)), ("a", "2", datetime(2024, 1, 2)), ("b", "3", datetime(2024, 1, 3)),
            ("c", " ", datetime(2024, 1, 3))]
    folder = _files(spark, rows, schema, str(tmp_path / "tm"))
    entries = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(folder)
    q = memory.first_entries(entries).writeStream.format("memory").queryName("first_tm").trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_tm").count() == 3
    deltas = str(tmp_path / "deltas")
    one = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
    memory.upsert_stream(one, deltas, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.source_text: r.translated_text for r in memory.current(spark, deltas).collect()}
    assert got["b"] == "3" and got["a"] in ("1", "2") and "c" not in got


def test_live_totals(spark, tmp_path):
    schema = "book_id string, seq long, status string, error_message string"
    rows = [("a", 1, "scanning", ""), ("a", 2, "failed", "boom"), ("a", 3, "translating", ""), ("b", 1, "pending", None)]
    folder = _files(spark, rows, schema, str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).parquet(folder)
    q = status.live_status(stream).writeStream.outputMode("complete").format("memory").queryName(
        "live_status").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.book_id: (r.status, r.error_message) for r in spark.table("live_status").collect()}
    assert got == {"a": ("translating", "boom"), "b": ("pending", None)}
    usage = spark.createDataFrame([("b", "s", 1000000, 1000000)],
                                  "book_id string, step string, input_tokens long, output_tokens long")
    assert float(status.live_tokens(usage).first().cost) == 3.0


def test_link_sheet(spark, tmp_path):
    from glossweave.sources.tables import read_link_sheet

    (tmp_path / "links.csv").write_text(
        "文件名,分享链接,提取码,备注\nDeep_Work.epub,https://s/1,ab12,\n,https://s/2,,x\n", encoding="utf-8")
    rows = read_link_sheet(spark, str(tmp_path / "links.csv")).collect()
    assert {(r.filename, r.share_url, r.extract_code) for r in rows} == {
        ("Deep_Work.epub", "https://s/1", "ab12"), (None, "https://s/2", None)}


def test_archiving_stream(spark, tmp_path):
    folder, archive = shelf(tmp_path), tmp_path / "done"
    files = ingest.container_stream(spark, str(folder), str(archive), files_per_batch=1)
    ingest.ingest(files, str(tmp_path / "b"), str(tmp_path / "c")).awaitTermination(120)
    moved = [p.name for p in archive.rglob("*.epub")]
    left = [p.name for p in folder.glob("*.epub")]
    assert moved and sorted(moved + left) == ["bad.epub", "no_html.epub", "one .epub", "two_x.epub"]
