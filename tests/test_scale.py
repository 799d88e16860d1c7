"""Numbering of skewed groups, requests spaced over all workers, progress over a stream."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from foliospark import tables
from foliospark.operators import relational
from foliospark.plans import pipelines
from foliospark.sources import models
from foliospark.streaming import cascade, progress


def numbers(rows, by):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: tuple((r[b] is None, r[b]) for b in (*by, "v", "id"))):
        k = tuple(r[b] for b in by)
        seen[k] = seen.get(k, 0) + 1
        out[r["id"]] = seen[k]
    return out


def test_groups_of_any_size_are_numbered(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 101).alias("v"), F.lit("x").alias("rn_"), F.lit(1).alias("_place_"))
    rows = [r.asDict() for r in df.collect()]
    for by in ([], ["g"], ["g", "v"]):
        out = tables.number_groups(df, by, ["v", "id"])
        assert out.columns == [*df.columns, "rn"] and dict(out.dtypes)["rn"] == "bigint"
        assert {r.id: r.rn for r in out.collect()} == numbers(rows, by)
    plan = tables.number_groups(df, ["g"], ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert tables.number_groups(df.limit(0), ["g"], ["v", "id"]).count() == 0
    ties = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "g string, v int")
    assert sorted(tuple(r) for r in tables.number_groups(ties, ["g"], ["v"]).collect()) == [("a", 1, 1), ("a", 1, 2), ("b", 1, 1)]


def test_books_side_by_side(spark):
    rows = [(b, f"/x/i{n}.png", 100, 50) for b in ("p", "q") for n in range(1, 12 if b == "p" else 3)]
    df = spark.createDataFrame(rows, "book string, path string, width int, height int")
    two = pipelines.lay_out_two_up(df, by=["book"])
    pairs = sorted((r.book, r.pair, r.side, r.path) for r in two.collect())
    assert [p for b, *p in pairs if b == "q"] == [[0, 0, "/x/i1.png"], [0, 1, "/x/i2.png"]]
    assert [x for b, _, _, x in pairs if b == "p"] == [f"/x/i{n}.png" for n in [*range(1, 12), 11]]
    cells = pipelines.lay_out_cards(df, by=["book"]).collect()
    assert sorted((r.book, r.page, r.local) for r in cells) == sorted([("p", n // 6, n % 6) for n in range(11)] + [("q", 0, 0), ("q", 0, 1)])
    reports = spark.createDataFrame([("a", "02/03/26", "d", 1), ("a", "01/03/26", "d", 2), ("b", "soon", "d", 3)], "book string, data string, doc_path string, seq int")
    assert sorted((r.book, r.rn, r.data) for r in pipelines.ordered_report(reports, ["book"]).collect()) == [("a", 1, "01/03/26"), ("a", 2, "02/03/26"), ("b", 1, "soon")]


def test_starts_lie_apart():
    starts = [(models.next_start(now / 100, 0.0, w, 5, 0.3), w) for w in range(5) for now in range(0, 900, 7)]
    assert all(s >= 0 for s, _ in starts)
    grid = {(round(s / 0.3), w) for s, w in starts}
    assert all(k % 5 == w for k, w in grid) and all(abs(s / 0.3 - round(s / 0.3)) < 1e-6 for s, _ in starts)
    assert models.next_start(5.0, 0.0, 2, 3, 0.0) == 5.0


@pytest.fixture
def server():
    starts = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            starts.append((time.time(), self.rfile.read(int(self.headers["Content-Length"])).decode()))
            time.sleep(0.4 if len(starts) % 4 == 0 else 0.02)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", starts
    httpd.shutdown()


@pytest.mark.parametrize(("n", "user", "delay"), [(12, 0, 0.3), (8, 3, 0.1), (3, 0, 0.0)])
def test_requests_are_spaced_over_all_workers(spark, server, n, user, delay):
    url, starts = server
    requests = spark.range(n, numPartitions=3).select(F.format_string("k%03d", n - F.col("id")).alias("key"), F.col("id").alias("order"), F.col("id").cast("string").alias("body"))
    adapter = models.HttpAdapter(url, lambda: "secret", workers=user)
    answers = models.KeptAnswers(adapter).ask(requests)
    assert answers.count() == n and {r.status for r in answers.collect()} == {200} and len(starts) == n  # each asked once, however often read
    gaps = [b[0] - a[0] for a, b in zip(sorted(starts), sorted(starts)[1:], strict=False)]
    assert all(g >= delay / 4 for g in gaps)  # the server sees a start later by the time that a connection takes, a worker's first most
    assert sum(gaps) > (n - 1) * delay - 0.3
    if delay and not user:
        assert max(gaps) < 2.5  # and no longer than a worker's turns
        first = [int(b) for _, b in sorted(starts)][:3]
        assert first == [0, 1, 2]


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    for k, v in progress.STATE_STORE.items():
        spark.conf.set(k, v)
    schema = "job string, at long, kind string, note string"
    events = spark.range(60).select(F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("j"), F.col("id") % 4)).alias("job"), F.col("id").alias("at"), F.when(F.col("id") % 5 == 0, "bad").when(F.col("id") % 13 == 0, None).otherwise("ok").alias("kind"), F.lit("n").alias("note"))
    for i in range(3):  # three micro-batches, each of several files' rows in any order
        events.where(f"at >= {20 * i} and at < {20 * i + 20}").orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files go by their time
    stream = cascade.stream_table(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    out = progress.stream_progress(stream, "job", ["at"], F.col("kind") == "ok", F.col("kind") == "bad", ["note"])
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = relational.progress(events, ["job"], ["at"], F.col("kind") == "ok", F.col("kind") == "bad")
    columns = ["job", "at", "note", "completed", "success", "failed"]
    read = lambda df: sorted(((r.job or "", *tuple(r)[1:]) for r in df.select(*columns).collect()))
    assert read(spark.read.parquet(str(tmp_path / "out"))) == read(want)
