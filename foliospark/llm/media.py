"""Interleaved document sequences: HTML becomes ordered text and media-reference structs whose payloads are joined by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import mapped, materialise, shared_dir

BLOCK = 64
RATE = 8000
SCHEME = "media:"
#: A digest of more references is split over so many parts of the join.
HOT_REFERENCES = 10_000
SALTS = 8

SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string>>"


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """data with bytes 0 appended up to a positive multiple of block."""
    return data + bytes(-len(data) % block if data else block)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = struct.pack("<4sI", b"data", len(samples)) + samples + bytes(len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(body), b"WAVE") + fmt + body


def from_wav(data: bytes) -> bytes:
    """The samples of a WAV file of 8-bit samples; ValueError if it isn't one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, bits = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            bits = struct.unpack_from("<H", data, at + 22)[0]
        if kind == b"data":
            if bits != 8 or at + 8 + size > len(data):
                raise ValueError("no complete 8-bit samples")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(samples: bytes) -> str:
    """Mean, root mean square around 128, zero crossings and histogram entropy of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    if not n:
        return "n=0"
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    share = counts[counts > 0] / n
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"n={n};mean={counts @ values / n:.6f};rms={(counts @ values**2 / n) ** 0.5:.6f};crossings={crossings};bits={-(share @ np.log2(share)):.6f}"


class _Sequence(HTMLParser):
    """Text and media references in page order; a figure's caption, or else the reference's alt, goes with the reference."""

    SKIP = {"script", "style", "template", "noscript"}
    BREAK = {"p", "div", "figure", "figcaption", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "section", "article", "blockquote", "pre"}
    MEDIA = {"img", "audio", "video", "source", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.skip = self.figure = 0
        self.caption = False
        self.opened: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.caption and self.opened:
            for i in self.opened:
                self.items[i]["text"] = text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.opened = []
        elif tag == "figcaption":
            self.caption = True
        elif tag in self.MEDIA:
            at = dict(attrs)
            if (src := at.get("src") or "").startswith(SCHEME):
                self.opened.append(len(self.items))
                self.items.append({"kind": "media", "text": at.get("alt"), "digest": src[len(SCHEME) :]})

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BREAK:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure":
            self.opened = []

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered structs {pos, kind: text or media, text (a reference's caption), digest}; none for null or empty."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame, html: str = "html", out: str = "sequence") -> DataFrame:
    """Add the interleaved sequence of each page; null or empty HTML has an empty one, repeated rows each their own, `out` is replaced."""

    @F.pandas_udf(SEQUENCE)
    def parse(column):
        return column.map(parse_sequence)

    return pages.withColumn(out, parse(F.col(html)))


def store_payloads(rows: DataFrame, payload: str, path: str) -> DataFrame:
    """Write each row's payload as an 8-bit WAV file in a Parquet media column (digest, media) under path; the stored table, read back.

    Null payloads count as empty. The digest is the payload's SHA-256; equal payloads may be stored more than once under one digest.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for first in range(0, len(column), 256):
                data = [pad(x.as_py() or b"") for x in column.slice(first, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array(list(map(to_wav, data)), pa.binary())], names=["digest", "media"])

    schema = "digest string, media binary"
    rows.select(F.col(payload).cast("binary")).transform(mapped, store, schema).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


MEDIA_FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row for each digest; the bytes are read where they lie and aren't shuffled."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0), batch.column(1), strict=True):
                data = media.as_py()
                samples = from_wav(data)
                rows.append((digest.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            names = [x.split()[0] for x in MEDIA_FEATURES.split(", ")]
            kinds = [pa.int64() if "bigint" in x else pa.string() for x in MEDIA_FEATURES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = stored.transform(mapped, describe, MEDIA_FEATURES)
    return found.groupBy("digest").agg(*[F.min(c).alias(c) for c in found.columns[1:]])


def resolve(sequences: DataFrame, media: DataFrame, keep: list[str], out: str = "sequence") -> DataFrame:
    """One row for each media reference, in its place: `keep`, pos, caption, digest and the columns of `media` (null if it has none).

    Digests of more than HOT_REFERENCES references are split over SALTS parts of the join; they are few (at most one in HOT_REFERENCES
    references), so Spark may broadcast their list by its size.
    """
    refs = sequences.select(*keep, F.explode(out).alias("_item")).where(F.col("_item.kind") == "media")
    refs = refs.select(*keep, F.col("_item.pos").alias("pos"), F.col("_item.text").alias("caption"), F.col("_item.digest").alias("digest"))
    hot = materialise(refs.groupBy("digest").count().where(F.col("count") > HOT_REFERENCES).select("digest", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*keep, "pos"), F.lit(SALTS)).cast("int")).otherwise(0)
    refs = refs.join(hot, "digest", "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = media.join(hot, "digest", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return refs.join(salted, ["digest", "_salt"], "left").drop("_salt")


def op9_interleaved_media(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes as a media payload that its own page refers to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    features = describe_media(store_payloads(docs, "text", shared_dir(spark)))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                digest = hashlib.sha256(pad(data)).hexdigest()
                html.append(f'<article><p>document</p><figure><audio src="{SCHEME}{digest}"></audio><figcaption>{escape(str(len(data)))}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string())], names=["doc_id", "html"])

    pages = docs.transform(mapped, render, "doc_id bigint, html string")
    found = resolve(interleave(pages).drop("html"), features, ["doc_id"])
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), *columns)
