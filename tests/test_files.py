"""Archives, images and pipelines on files made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import tables
from foliospark.functions import text as tx
from foliospark.pictures_catalogue import jpeg_bytes
from foliospark.plans import pipelines, printing
from foliospark.sources import archives as ar
from foliospark.sources import images as im
from foliospark.sources import prompts, texts
from foliospark.sources.models import HttpAdapter, HttpFetcher, TableAdapter, TableFetcher

RED = np.zeros((100, 100, 3), np.uint8)
RED[:, :, 0] = 200
GREY = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 100, axis=0).repeat(3, axis=2)


def docx(spark, *docs):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in docs], "doc_path string, archive binary")


def reply(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_decoding(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    photo = jpeg_bytes(spark, 16, 64, 48)
    rows = spark.createDataFrame([(1, bytearray(im.png_bytes(pixels))), (2, bytearray(im.png_bytes(pixels[:, :, :3]))), (3, bytearray(photo)), (4, bytearray(b"<svg/>")), (5, None), (1, bytearray(im.png_bytes(pixels))), (6, bytearray(photo[:100]))], "k int, c binary")
    got = [(r.k, r.pixels) for r in im.decode_images(rows, F.col("c")).collect()]
    assert sorted(k for k, _ in got) == [1, 1, 2, 3, 4, 5, 6]
    found = {k: p and im.pixel_array(*p) for k, p in got}
    assert (found[1] == pixels).all() and (found[2] == pixels[:, :, :3]).all() and found[4] is None and found[5] is None
    assert found[3].shape == (48, 64, 3) and found[3][24, 4, 0] > 180 > 40 > found[3][24, 4, 1] and abs(int(found[3][24, 50, 0]) - 120) < 4
    assert im.dimensions(photo) == (64, 48) and im.dimensions(im.png_bytes(pixels)) == (5, 7)
    grey = im.pixel_array(2, 2, 1, bytes([1, 2, 3, 4]))
    assert grey.shape == (2, 2, 3) and (grey[:, :, 2] == [[1, 2], [3, 4]]).all()


def test_saturation():
    white = np.full((100, 100, 3), 255, np.uint8)
    one_percent = np.full((100, 100, 3), 128, np.uint8)
    one_percent[0] = (255, 0, 0)
    clear = np.dstack((RED, np.zeros((100, 100), np.uint8)))
    got = [im.coloured_ratio(p) >= im.RATIO_CUT for p in (RED, GREY, white, np.zeros((50, 50, 3), np.uint8), one_percent, clear)]
    assert got == [True, False, False, False, False, False]


def test_list_and_rebuild(spark):
    data = ar.write_archive([("[Content_Types].xml", b"x"), ("word/media/image1.png", b"a" * 10), ("word/media/figura2.JPG", b"b" * 300), ("word/media/sub/image1.png", b"c")])
    docs = docx(spark, ("a.docx", data), ("bad.docx", b"no zip"))
    rows = ar.list_entries(docs, 100).orderBy("doc_path", "entry_idx").collect()
    assert [(r.original_name, r.format, r.kept) for r in rows[:3]] == [("image1.png", "png", False), ("figura2.JPG", "jpg", True), ("image1.png", "png", False)]
    assert rows[0].content is None and rows[3].error.startswith("BadZipFile")
    good = docs.where("doc_path = 'a.docx'")
    new = spark.createDataFrame([("a.docx", "word/media/sub/image1.png", bytearray(b"new"))], "doc_path string, path_in_zip string, new_content binary")
    both = {r.doc_path: r for r in ar.rebuild_archives(docs, new).collect()}
    assert both["bad.docx"].error.startswith("BadZipFile") and both["bad.docx"].archive is None and both["a.docx"].error is None
    wanted = spark.createDataFrame([("a.docx", "word/media/figura2.JPG"), ("a.docx", "word/media/none.png"), ("other", "x"), ("a.docx", "word/media/figura2.JPG")], "doc_path string, path_in_zip string")
    assert [(r.original_name, bytes(r.content)) for r in ar.entries_from_list(docs, wanted).where("error is null").collect()] == [("figura2.JPG", b"b" * 300)]
    back = ar.rebuild_archives(good, new)
    contents = {r.path_in_zip: bytes(r.content) for r in ar.list_entries(back).collect()}
    assert contents == {"word/media/image1.png": b"a" * 10, "word/media/figura2.JPG": b"b" * 300, "word/media/sub/image1.png": b"new"}
    assert ar.rebuild_archives(good, new.limit(0)).first().archive is None


def test_text(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {ns}><w:body><w:p><w:r><w:t>Bom </w:t></w:r><w:r><w:t>dia</w:t><w:br/><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    docs = docx(spark, ("a", ar.write_archive([(ar.DOCUMENT, xml.encode())])), ("b", ar.write_archive([("x", b"")])), ("c", ar.write_archive([(ar.DOCUMENT, b"<w")])))
    rows = {r.doc_path: (r.text, r.error) for r in ar.extract_text(docs).collect()}
    assert rows["a"] == ("Bom dia\nx\ty\nA\nB", None)
    assert rows["b"][1] == "no word/document.xml" and rows["c"][1].startswith("ParseError")


def test_folders_and_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.PNG", "b.txt", "sub/c.png"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in im.read_images(spark, str(tmp_path)).collect()] == ["a.PNG"]
    (tmp_path / "list.txt").write_text("# note\n\n uva, pera ,\nmanga\n")
    assert [r.item for r in texts.read_items(spark, str(tmp_path / "list.txt")).collect()] == ["uva", "pera", "manga"]
    (tmp_path / "env").write_text("# x\nkey = 1=2\nKEY=3\nbare\n")
    assert [tuple(r) for r in texts.read_settings(spark, str(tmp_path / "env")).collect()] == [("KEY", "3")]
    (tmp_path / "~$a.docx").write_bytes(b"")
    (tmp_path / "a.DOCX").write_bytes(b"z")
    assert ar.read_archives(spark, str(tmp_path)).count() == 1
    assert [r.item for r in texts.items_of_args(spark, "a, b", "c").collect()] == ["a", "b", "c"]


class Counting:
    """An adapter that counts the requests that it is really asked."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def ask(self, requests):
        calls = self.calls
        count = F.udf(lambda x: (calls.add(1), x)[1], "string")
        return self.inner.ask(requests).withColumn("key", count("key"))


def test_process_documents(spark, tmp_path):
    grey, big = im.png_bytes(GREY), im.png_bytes(np.full((20, 30, 3), 90, np.uint8))
    data = ar.write_archive([("word/media/red.png", im.png_bytes(RED)), ("word/media/grey.png", grey), ("word/media/bad.svg", b"<svg/>"), ("word/media/small.png", b"1")])
    docs = docx(spark, ("a.docx", data), ("copy.docx", data), ("broken.docx", data[:40]))
    import base64
    import hashlib

    def key(stage, content):
        return hashlib.sha256(f"{stage}:".encode() + content).hexdigest()

    url = "data:image/png;base64," + base64.b64encode(big).decode()
    triage = spark.createDataFrame([(key("triage", grey), 200, reply('{"should_colorize": true}')), (key("triage", b"<svg/>"), 429, "")], "key string, status int, body string")
    colour = spark.createDataFrame([(key("colour", grey), 200, reply(url))], "key string, status int, body string")
    asked = [spark.sparkContext.accumulator(0) for _ in range(2)]
    counting = [Counting(TableAdapter(t), n) for t, n in zip((triage, colour), asked, strict=True)]
    out = pipelines.process_documents(docs, *counting, "2B", answers=str(tmp_path / "answers"))
    everything = out.images.collect(), out.summary.collect(), out.archives.collect()
    assert [n.value for n in asked] == [2, 2]  # one call for each different picture, whatever is read how often
    assert [a.error is not None for a in everything[2] if a.doc_path == "broken.docx"] == [True]
    pipelines.process_documents(docs, *counting, "2B", answers=str(tmp_path / "answers")).summary.collect()
    assert [n.value for n in asked] == [3, 3]  # a later run asks again only for what failed
    stages = {r.original_name: (r.stage, r.coloured) for r in out.images.where("doc_path = 'a.docx'").collect()}
    assert stages == {"red.png": ("local", False), "grey.png": ("approved", True), "bad.svg": ("fail_open", False)}
    row = out.summary.where("doc_path = 'a.docx'").first()
    assert (row.listed, row.skipped, row.coloured, row.skipped_local, row.skipped_triage) == (4, 1, 1, 1, 0)
    back = {r.original_name: bytes(r.content) for r in ar.list_entries(out.archives.where("doc_path = 'a.docx'")).collect()}
    assert im.dimensions(back["grey.png"]) == (256, 100) and back["small.png"] == b"1"
    off = pipelines.process_documents(docs, TableAdapter(triage), TableAdapter(colour), no_triage=True)
    assert {r.stage for r in off.images.collect()} == {"approved"}
    with pytest.raises(ValueError):
        pipelines.process_documents(docs, None, None, "many")


def test_routines(spark):
    docs = docx(spark, ("a", ar.docx_of_lines(["one"])), ("b", ar.docx_of_lines(["two"])), ("c", b""))
    rows = json.dumps([{"data": "05/03/26", "campo": "x"}, {"data": "01/03/26", "campo": "y", "experiencia": "z"}, {"data": "soon"}])
    answers = docs.sparkSession.createDataFrame([("one", 200, reply("Here: " + rows)), ("two", 200, reply("none"))], "t string, status int, body string").select(F.sha2("t", 256).alias("key"), "status", "body")
    got, rejected = pipelines.compile_routines(docs, TableAdapter(answers))
    assert [r.data for r in pipelines.ordered_report(got).orderBy("rn").collect()] == ["01/03/26", "05/03/26", "soon"]
    assert sorted(r.doc_path for r in rejected.collect()) == ["b", "c"]
    report = docx(spark, ("r", pipelines.write_report(got)))
    assert ar.extract_text(report).first().text.split("\n")[3:6] == ["01/03/26", "y", "z"]
    with pytest.raises(ValueError):
        pipelines.write_report(got.limit(0))


def test_generate_and_print(spark, tmp_path):
    items = json.dumps([{"index": 9, "name": "Uva", "slug": "../x", "prompt": "p1"}, {"name": "Pera", "prompt": "p2"}])
    prompts = pipelines.synthesise_prompts(spark.createDataFrame([(f"```json\n{items}\n```",)], "reply string"))
    assert [(r.rn, r.slug) for r in prompts.orderBy("rn").collect()] == [(1, "01_uva"), (2, "02_pera")]
    image = "data:image/png;base64," + __import__("base64").b64encode(im.png_bytes(RED)).decode()
    answers = spark.createDataFrame([("1:1|p1", 200, reply(image)), ("1:1|p2", 500, "")], "k string, status int, body string").select(F.sha2("k", 256).alias("key"), "status", "body")
    done = {r["rn"]: r for r in pipelines.generate_images(prompts, TableAdapter(answers)).collect()}
    assert [r.slug for r in pipelines.ready(pipelines.save_generated(pipelines.generate_images(prompts, TableAdapter(answers)), str(tmp_path))).collect()] == ["01_uva"]
    assert [p.name for p in tmp_path.iterdir()] == ["01_uva.png"]
    assert done[1]["status"] == "done" and bytes(done[1]["content"]) == im.png_bytes(RED) and done[2]["status"] == "error"
    paths = spark.createDataFrame([(f"/x/{i}_bolo.png", 100, 50) for i in range(7)], "path string, width int, height int")
    cells = pipelines.lay_out_cards(paths).withColumn("data_uri", F.lit(None).cast("string"))
    pages = pipelines.cards_html(cells, "A & B").orderBy("page").collect()
    assert len(pages) == 2 and "A &amp; B" in pages[0].html and pages[0].html.count("BOLO") == 6
    sheet = bytes(printing.cards_pdf(cells.withColumns({"content": F.lit(im.png_bytes(RED)), "book": F.lit(1), "label": F.lit("Pêra (é) ✓")}), ["book"]).first().pdf)
    check_pdf(sheet, pages=2)
    two = pipelines.lay_out_two_up(paths)
    check_pdf(bytes(printing.two_up_pdf(two.withColumns({"content": F.lit(jpeg_bytes(spark, 16)), "book": F.lit(1)}), ["book"]).first().pdf), pages=4)
    assert two.count() == 8 and two.where("rotated").count() == 8


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("../a.bin", bytearray(b"1")), ("b.bin", None)], "name string, content binary")
    pipelines.write_files(rows, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.bin"]


def test_stream(spark, tmp_path):
    import datetime

    from foliospark.streaming import cascade as sc

    t = datetime.datetime(2026, 1, 1)
    items = spark.createDataFrame([(1, 10, t), (2, 500, t), (3, 500, t), (4, 500, t)], "k int, n int, ts timestamp")
    items.write.parquet(str(tmp_path / "in"))
    verdicts = spark.createDataFrame([(2, True, None), (3, False, None)], "k int, should_colorize boolean, error string")
    judged = sc.judge_stream(sc.stream_table(spark, str(tmp_path / "in"), items.schema), verdicts, "k", F.col("n") < 200)
    query = sc.stage_counts(judged, "ts").writeStream.outputMode("complete").format("memory").queryName("stages").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.stage, r.n) for r in spark.sql("SELECT stage, n FROM stages").collect()} == {("local", 1), ("approved", 1), ("triage", 1), ("fail_open", 1)}


def check_pdf(data, pages):
    """Every object lies where the table of places says; streams have the length they declare."""
    import re

    start = int(re.search(rb"startxref\n(\d+)\n%%EOF", data).group(1))
    lines = data[start:].split(b"\n")
    count = int(lines[1].split()[1])
    for i, line in enumerate(lines[3 : 2 + count], 1):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj\n" % i)
    for m in re.finditer(rb"/Length (\d+)>>\nstream\n", data):
        assert data[m.end() + int(m.group(1)) :].startswith(b"\nendstream")
    assert data.count(b"/Type/Page/") == pages and f"/Count {pages}/".encode() in data


@pytest.fixture
def server():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, status, body, kind="application/json"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body["n"]))
            failed = body["n"] == 2 or (body["n"] == 3 and [n for _, n in seen].count(3) < 2)
            self.answer(503 if failed else 200, b"busy" if failed else json.dumps({"n": body["n"]}).encode())

        def do_GET(self):
            seen.append(("get", self.path))
            self.answer(*((404, b"") if "none" in self.path else (200, b"bytes", "image/webp")))

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_http(spark, server):
    at, seen = server
    requests = spark.createDataFrame([(f"k{n}", json.dumps({"n": n})) for n in (1, 2, 3)], "key string, body string")
    got = {r.key: (r.status, r.body) for r in HttpAdapter(at, lambda: "s3cret", workers=1, tries=2).ask(requests).collect()}
    assert got == {"k1": (200, '{"n": 1}'), "k2": (503, "busy"), "k3": (200, '{"n": 3}')}
    assert sorted(n for _, n in seen) == [1, 2, 2, 3, 3] and {a for a, _ in seen} == {"Bearer s3cret"}
    dead = HttpAdapter("http://127.0.0.1:9", lambda: "x", tries=1).ask(requests.limit(1)).first()
    assert dead.status == 0 and "error" in dead.body
    urls = spark.createDataFrame([(f"{at}/a",), (f"{at}/none",), (f"{at}/a",), ("no url",)], "url string")
    files = {r.url[-4:]: (r.status, r.content and bytes(r.content), r.content_type) for r in HttpFetcher(tries=1).get(urls).collect()}
    assert files["none"][:2] == (404, None) and files[f"{at}/a"[-4:]] == (200, b"bytes", "image/webp") and files[" url"][0] == 0
    assert [p for g, p in seen if g == "get"].count("/a") == 1


def test_url_answers(spark):
    replies = spark.createDataFrame([("a", "see http://x/1.png", None), ("b", "http://x/gone", None), ("c", None, "status 500"), ("d", "no", None)], "key string, image string, error string")
    files = spark.createDataFrame([("http://x/1.png", 200, bytearray(b"p"), "image/jpg")], "url string, status int, content binary, content_type string")
    got = {r.key: (r.content and bytes(r.content), r.format, r.error) for r in pipelines.resolve_images(replies, TableFetcher(files)).collect()}
    assert got["a"] == (b"p", "jpg", None) and got["b"][2] == "download: status 0" and got["c"][2] == "status 500" and got["d"][2] == "no image in the reply"
    assert {r.key for r in pipelines.resolve_images(replies).where("error like '%fetcher%'").collect()} == {"a", "b"}


def test_prompts(spark, tmp_path):
    (tmp_path / "mine").write_text("My prompt\nof two lines")
    (tmp_path / "blank").write_text(" \n")
    read = lambda name, builtin: prompts.read_prompt(spark, str(tmp_path / name), builtin, "last")
    assert [read("mine", "b"), read("blank", "b"), read("none", "b"), read("none", " "), prompts.read_prompt(spark, None, None, "last")] == ["My prompt\nof two lines", "b", "b", "last", "last"]


def test_number_all(spark):
    names = [f"x{n}" for n in ("1" + "0" * 24, "99999999999999999999", 7, "007", 10)] + ["a", "X8", None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)] * 3, "name string, k int").repartition(3)
    got = tables.number_all(df, [tx.natural_key(F.col("name")), "k"]).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 25))
    assert [r.name for r in got][::3] == [None, "a", "x007", "x7", "X8", "x10", "x99999999999999999999", "x1" + "0" * 24]
    assert tables.number_all(df.limit(0), ["k"]).count() == 0


def test_shared_folder(spark):
    path = tables.shared_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    with tables.scratch(spark):
        held = tables.materialise(spark.range(3))
        where = held.inputFiles()[0].rsplit("/", 1)[0]
        assert held.count() == 3 and tables.path_exists(spark, where)
    assert not tables.path_exists(spark, where)


def test_decoding_in_turns(spark, monkeypatch):
    """Files of a turn lie in several folders and go; more turns give the same pixels; nulls, repeats and broken pictures keep their rows."""
    written = []
    wrote = im.write_files
    monkeypatch.setattr(im, "write_files", lambda rows, folder, *names: (written.append((folder, [r._file for r in rows.select("_file").collect()])), wrote(rows, folder, *names)))
    pictures = [im.png_bytes(np.full((2, 3, 3), i, np.uint8)) for i in range(12)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*pictures, pictures[0], b"broken", None])], "n int, content binary")
    want = {i: bytes([i]) * 18 for i in range(12)} | {12: bytes(18), 13: None, 14: None}
    for turn_files, folder_files in ((1 << 18, 1 << 10), (5, 2)):
        monkeypatch.setattr(im, "TURN_FILES", turn_files)
        monkeypatch.setattr(im, "FOLDER_FILES", folder_files)
        written.clear()
        found = im.decode_images(rows, F.col("content")).collect()
        assert {r.n: r.pixels and bytes(r.pixels.data) for r in found} == want
        assert len(written) == (1 if turn_files > 13 else 3) and sum(len(x) for _, x in written) == 13
        assert len({x.split("/")[0] for _, names in written for x in names}) == (1 if turn_files > 13 else 3)
        assert not any(tables.path_exists(spark, folder) for folder, _ in written)
    assert im.decode_images(rows.limit(0), F.col("content")).count() == 0


def test_measured_where_they_are(spark, monkeypatch):
    """Pictures are measured, judged and resized without a file, with the pixels that the image source gives."""
    photo, pixels = jpeg_bytes(spark, 16, 64, 48), np.random.default_rng(1).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    png = im.png_bytes(pixels)
    contents = [png, im.png_bytes(pixels[:, :, :3]), photo, png, b"<svg/>", None, photo[:100], png[:50], b""]
    rows = spark.createDataFrame([(i, c and bytearray(c)) for i, c in enumerate(contents)], "n int, content binary").repartition(2)
    want = {r.n: r.pixels and tuple(r.pixels) for r in im.decode_images(rows, F.col("content")).collect()}
    monkeypatch.setattr(im, "write_files", lambda *_: pytest.fail("a file for each picture"))
    got = {r.n: r.p and (r.p.height, r.p.width, r.p.channels, r.p.data) for r in rows.select("n", im.pixels_of(spark, F.col("content")).alias("p")).collect()}
    assert got == want and [got[i] is None for i in range(9)] == [False] * 4 + [True] * 5
    measured = {r.n: r for r in im.measure_images(rows).collect()}
    assert [(measured[i].width, measured[i].height, measured[i].error) for i in (0, 2, 5, 7)] == [(5, 7, None), (64, 48, None), (None, None, "undecodable"), (5, 7, "undecodable")]
    assert measured[0].ratio == im.coloured_ratio(pixels) and measured[2].ratio == im.coloured_ratio(im.pixel_array(*want[2])) and measured[4].ratio is None
    small = im.resize_to_match(rows.withColumn("new", F.lit(im.png_bytes(RED))), "content", "new")
    assert {r.n: r.resized and im.dimensions(bytes(r.resized)) for r in small.collect()} == {0: (5, 7), 1: (5, 7), 2: (64, 48), 3: (5, 7), 4: None, 5: None, 6: None, 7: (5, 7), 8: None}
