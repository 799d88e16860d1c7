"""Model and download adapters: how a pipeline asks, replaceable in tests; and the table in which answers are kept."""

from __future__ import annotations

import json
import math
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import layout
from foliospark.tables import materialise, number_all, path_exists, shared_dir

ANSWERS = "key string, status int, body string"
FILES = "url string, status int, content binary, content_type string"
TRIES, WAIT_MS, JITTER_MS = 3, 1200, 400
#: From the moment at which the last worker is ready to the first start, so that none misses its first turn: a task asks about once a
#: second whether the others are there.
LEAD_MS = 1500


def wait_ms(attempt, jitter):
    """Milliseconds to wait after a failed attempt (from 1); for numbers and columns alike."""
    return attempt * WAIT_MS + jitter % JITTER_MS


class TableAdapter:
    """Answers from a table (key, status, body); a key without an answer has status 0."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def ask(self, requests: DataFrame) -> DataFrame:
        found = requests.select("key").join(self.answers, "key", "left")
        return found.select("key", F.coalesce("status", F.lit(0)).alias("status"), "body")


def _tried(call: urllib.request.Request, timeout: float, tries: int) -> tuple[int, bytes, str]:
    """(status, body, content type) of a call, repeated after waits while it fails; status 0 if no answer came."""
    status, body, kind = 0, b"", ""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(call, timeout=timeout) as r:
                return r.status, r.read(), r.headers.get("Content-Type") or ""
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read()[:200]
        except OSError as e:
            status, body = 0, json.dumps({"error": {"message": str(e)[:200]}}).encode()
        if attempt < tries:
            time.sleep(wait_ms(attempt, random.randrange(JITTER_MS)) / 1000)
    return status, body, kind


def next_start(now: float, began: float, worker: int, workers: int, delay: float) -> float:
    """When a worker may start its next request: the first of its own moments, began + (worker + k * workers) * delay, that is not past.

    The moments of different workers lie `delay` or more apart, so requests of all of them do, also of workers that are behind.
    """
    if delay <= 0:
        return now
    turn = workers * delay
    return began + worker * delay + max(0, math.ceil((now - began - worker * delay) / turn - 1e-9)) * turn


def dispatched(requests: DataFrame, order: list[str], workers: int, delay_ms: int, call: Callable[[dict], tuple], schema: str) -> DataFrame:
    """call(row) of each request from `workers` tasks that run at once, no two starts within delay_ms anywhere; written before it is used.

    The requests are numbered in their order; request i falls to worker i % workers, which keeps its order. The workers are one barrier
    stage: they agree on the moment from which their starts are counted, and if one is lost all begin anew. A cluster with fewer task
    slots than workers gets as many workers as it has.
    """
    spark = requests.sparkSession
    workers = max(1, min(workers, spark.sparkContext.defaultParallelism))
    columns = [f.strip().split()[0] for f in schema.split(",")]
    numbered = number_all(requests, order, "_place").withColumn("_worker", ((F.col("_place") - 1) % workers).cast("int"))
    delay = delay_ms / 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        first = next(batches, None)  # at hand before the starts are counted
        began = max(map(float, context.allGather(repr(time.time())))) + (LEAD_MS / 1000 if delay else 0)
        worker = context.partitionId()
        started = None
        for batch in chain([] if first is None else [first], batches):
            rows = []
            for row in batch.to_dict("records"):
                earliest = time.time() if started is None else max(time.time(), started + delay)
                started = next_start(earliest, began, worker, workers, delay)
                time.sleep(max(0.0, started - time.time()))
                rows.append(call(row))
            yield pd.DataFrame(rows, columns=columns)

    dealt = numbered.repartitionById(workers, "_worker").sortWithinPartitions("_place").drop("_worker", "_place")
    return materialise(dealt.mapInPandas(run, schema, barrier=True))


class HttpAdapter:
    """Posts each request's JSON (key, body) from the executors, spaced and retried; the secret stays out of every column.

    Workers and spacing follow the dispatch policy for the number of requests, unless the user names a number of workers. Requests
    start in the order of their column `order`, if they have one, else of their keys, spaced over all workers (see dispatched).
    """

    def __init__(self, endpoint: str, secret: Callable[[], str], workers: int = 0, tries: int = TRIES, timeout: float = 120.0):
        self.endpoint, self.secret, self.workers, self.tries, self.timeout = endpoint, secret, workers, tries, timeout

    def ask(self, requests: DataFrame) -> DataFrame:
        endpoint, secret, tries, timeout = self.endpoint, self.secret, self.tries, self.timeout
        order = ["order", "key"] if "order" in requests.columns else ["key"]
        requests = materialise(requests.select(*dict.fromkeys([*order, "key", "body"])))
        policy = layout.dispatch_policy(F.lit(requests.count()), F.lit(self.workers))
        workers, delay_ms = requests.sparkSession.range(1).select(policy.alias("p")).select("p.*").first()

        def post(row: dict) -> tuple:
            headers = {"Content-Type": "application/json", "Authorization": f"Bearer {secret()}"}
            status, answer, _ = _tried(urllib.request.Request(endpoint, row["body"].encode(), headers), timeout, tries)
            return row["key"], status, answer.decode(errors="replace")

        return dispatched(requests, order, workers, delay_ms, post, ANSWERS)


class KeptAnswers:
    """An adapter's answers, asked for once and kept in a table under `path`: written before they are used, read by every result that
    needs them, and found again by later runs with the same path. Answers of a status but 200 are asked for again in a later `ask`."""

    def __init__(self, adapter, path: str | None = None):
        self.adapter, self.path = adapter, path

    def _kept(self, spark) -> DataFrame:
        best = F.max_by(F.struct("status", "body"), F.struct((F.col("status") == 200).cast("int"), "at"))
        return spark.read.schema(f"{ANSWERS}, at timestamp").parquet(self.path).groupBy("key").agg(best.alias("a")).select("key", "a.*")

    def ask(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        self.path = self.path or shared_dir(spark)
        if "order" in requests.columns:
            requests = requests.groupBy("key").agg(F.min("order").alias("order"), F.min_by("body", "order").alias("body"))
        requests = missing = requests.dropDuplicates(["key"])
        if path_exists(spark, self.path):
            missing = requests.join(self._kept(spark).where("status = 200").select("key"), "key", "left_anti")
        self.adapter.ask(missing).select("key", F.col("status").cast("int").alias("status"), "body", F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)
        return self._kept(spark).join(requests.select("key"), "key", "left_semi")


class TableFetcher:
    """Downloads from a table (url, status, content, content_type)."""

    def __init__(self, files: DataFrame):
        self.files = files

    def get(self, urls: DataFrame) -> DataFrame:
        found = urls.select("url").distinct().join(self.files, "url", "left")
        return found.select("url", F.coalesce("status", F.lit(0)).cast("int").alias("status"), "content", "content_type")


class HttpFetcher:
    """Downloads each different URL once, from the executors."""

    def __init__(self, tries: int = TRIES, timeout: float = 120.0):
        self.tries, self.timeout = tries, timeout

    def get(self, urls: DataFrame) -> DataFrame:
        tries, timeout = self.tries, self.timeout

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for url in batch["url"]:
                    try:
                        status, body, kind = _tried(urllib.request.Request(url), timeout, tries)
                    except ValueError:  # no URL that can be opened
                        status, body, kind = 0, b"", ""
                    yield pd.DataFrame([(url, status, body if status == 200 else None, kind)], columns=["url", "status", "content", "content_type"])

        return urls.select("url").distinct().mapInPandas(fetch, FILES)
