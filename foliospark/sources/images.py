"""Images as rows: files, dimensions from headers, pixels by Spark's image source, saturation, resizing."""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.tables import delete_path, materialise, shared_dir, write_files

EXTENSIONS = ("png", "jpg", "jpeg", "webp")
#: Fixed values of the saturation rule.
SATURATION_CUT, RATIO_CUT, SAMPLE_PIXELS, OPAQUE = 0.15, 0.05, 250_000, 128
#: What pixels_of gives: a row of Spark's image source, whose fields mean what decode_images says.
PIXELS = "origin string, height int, width int, channels int, mode int, data binary"
#: Pictures that are files at the same time while they are decoded, and those of one folder, about.
TURN_FILES, FOLDER_FILES = 1 << 18, 1 << 10


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a folder's images, not of its sub-folders; extensions in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.where(tx.extension(F.col("path")).isin(*EXTENSIONS)).select("path", "content")


def pixels_of(spark: SparkSession, content: Column) -> Column:
    """PIXELS of each picture, as decode_images has them, decoded where its row is: no file is written and no row moves.

    It calls what Spark's image source decodes a file's bytes with. That is no SQL function but a method of a Scala object, which
    expressions reach by its class; so this needs a classic session. A decoder's exception makes a null. The executors' ImageIO is told
    not to keep each picture's bytes in a temporary file, which takes most of the time of a small one.
    """
    jvm, to = spark._jvm, spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    catalyst, sql = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql
    kind = lambda name: jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    of = lambda name: sql.types.ObjectType(kind(name))
    held = lambda value, name="java.lang.String": catalyst.Literal(value, of(name))
    seq = lambda *x: jvm.PythonUtils.toSeq(list(x))

    def static(name, returns, method, arg):
        return catalyst.objects.StaticInvoke(kind(name), returns, method, seq(arg), seq(), True, True, True, jvm.scala.Option.empty())

    def call(target, method, returns, *args, null_if_null=True):
        return catalyst.objects.Invoke(target, method, returns, seq(*args), seq(), null_if_null, True, True)

    in_memory = F.reflect(F.lit("javax.imageio.ImageIO"), F.lit("setUseCache"), F.lit(False)).isNotNull()
    data, told, scala_object = to.expression(content._jc), to.expression(F.when(in_memory, content)._jc), "org.apache.spark.ml.image.ImageSchema$"
    name = catalyst.If(catalyst.IsNull(data), held(None), held(scala_object))  # of the data, lest the object become a constant of the plan
    at = call(static("java.lang.Class", of("java.lang.Class"), "forName", name), "getField", of("java.lang.reflect.Field"), held("MODULE$"))
    decoder = call(at, "get", of(scala_object), held(None, "java.lang.Object"), null_if_null=False)
    found = call(decoder, "decode", of("scala.Option"), held(None), told, null_if_null=False)
    image = call(catalyst.objects.UnwrapOption(of("org.apache.spark.sql.Row"), found), "getStruct", of("org.apache.spark.sql.Row"), to.expression(F.lit(0)._jc))
    values = call(image, "toSeq", of("scala.collection.immutable.Seq"))
    pixels = static("org.apache.spark.sql.catalyst.InternalRow", sql.types.DataType.fromDDL(PIXELS), "fromSeq", values)
    return Column(to.column(catalyst.TryEval(pixels)))


def decode_images(rows: DataFrame, content: Column, out: str = "pixels") -> DataFrame:
    """Add `out`: struct(height, width, channels, data) of the decoded picture, data in rows of blue, green, red and perhaps alpha bytes.

    PNG and JPEG of all kinds, by Spark's image source; null for anything else. The source reads files, so each different picture is
    written once to the shared folder, under its digest: in turns of about TURN_FILES pictures, each dealt over sub-folders of about
    FOLDER_FILES by the digest. A turn's files are deleted when its pixels stand in a table. For pictures that stand in many places;
    files cost milliseconds each, so many different ones go by pixels_of.
    """
    spark = rows.sparkSession
    named = rows.withColumn("_name", F.sha2(content, 256))
    pictures = materialise(named.select("_name", content.alias("_content")).where("_content is not null").dropDuplicates(["_name"]))
    count = pictures.count()
    turns, folders = max(1, -(-count // TURN_FILES)), max(1, -(-min(count, TURN_FILES) // FOLDER_FILES))
    digits = F.conv(F.substring("_name", 1, 15), 16, 10).cast("long")
    placed = pictures.withColumns({"_turn": digits % turns, "_file": F.concat_ws("/", F.floor(digits / turns) % folders, "_name")})
    decoded = [_decode_turn(placed.where(F.col("_turn") == turn), out) for turn in range(turns)]
    images = reduce(DataFrame.unionByName, decoded)
    return named.drop(out).join(images, "_name", "left").drop("_name")


def _decode_turn(pictures: DataFrame, out: str) -> DataFrame:
    """(_name, out) of the decodable pictures (_name, _file, _content), whose files stand in the shared folder only meanwhile."""
    spark = pictures.sparkSession
    folder = shared_dir(spark)
    write_files(pictures, folder, "_file", "_content")
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*").where("height > 0")
    pixels = F.struct("height", "width", F.col("nChannels").alias("channels"), "data").alias(out)
    made = materialise(images.select(F.substring_index("origin", "/", -1).alias("_name"), pixels))
    delete_path(spark, folder)
    return made


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width, 3 or 4) 8-bit pixels."""
    h, w, c = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)), axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pixel_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(height, width, 3 or 4) red, green, blue and alpha bytes of decoded data; grey ones are repeated."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, [2, 1, 0, 3][:channels]]


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG or WEBP; None if there is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", data, 16)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            return struct.unpack_from("<H", data, 26)[0] & 0x3FFF, struct.unpack_from("<H", data, 28)[0] & 0x3FFF
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h
            at += 2 + size
    except struct.error:
        pass
    return None


def header_size(content: Column | str) -> Column:
    """struct(width, height) by the header; null fields if there is none."""

    def sizes(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions(x or b"") or (None, None) for x in column], columns=["width", "height"], dtype="Int32")

    return F.pandas_udf(sizes, "width int, height int")(content)


def coloured_ratio(pixels: np.ndarray, step: int | None = None) -> float:
    """Share of opaque pixels of a saturation of SATURATION_CUT or more; large images are sampled on a grid; 0 without opaque pixels."""
    if step is None:
        count = pixels.shape[0] * pixels.shape[1]
        step = max(1, count // SAMPLE_PIXELS) if count > SAMPLE_PIXELS else 1
    seen = pixels[::step, ::step].reshape(-1, pixels.shape[2]).astype(np.float64)
    if pixels.shape[2] == 4:
        seen = seen[seen[:, 3] >= OPAQUE]
    if not len(seen):
        return 0.0
    high, low = seen[:, :3].max(axis=1), seen[:, :3].min(axis=1)
    return float(np.mean(np.divide(high - low, high, out=np.zeros_like(high), where=high > 0) >= SATURATION_CUT))


def _measured(pixels: Column) -> Column:
    """struct(width, height, ratio) of decoded pictures; null fields for the others."""

    def measure(column: pd.DataFrame) -> pd.DataFrame:
        rows = column[["height", "width", "channels", "data"]].itertuples(index=False)
        found = [(None, None, None) if r.data is None else (int(r.width), int(r.height), coloured_ratio(pixel_array(int(r.height), int(r.width), int(r.channels), r.data))) for r in rows]
        return pd.DataFrame(found, columns=["width", "height", "ratio"]).astype({"width": "Int32", "height": "Int32", "ratio": "float64"})

    return F.pandas_udf(measure, "width int, height int, ratio double")(pixels)


def measure_images(images: DataFrame, content: str = "content") -> DataFrame:
    """Add width, height, ratio, coloured and error. Undecodable images have an error and count as not coloured: they pass on."""
    measured = images.withColumns({"_seen": _measured(pixels_of(images.sparkSession, F.col(content))), "_size": header_size(F.col(content))})
    coloured = F.coalesce(F.col("_seen.ratio") >= RATIO_CUT, F.lit(False))
    error = F.when(F.col("_seen.width").isNull(), "undecodable")
    return measured.select(*images.columns, F.coalesce("_seen.width", "_size.width").alias("width"), F.coalesce("_seen.height", "_size.height").alias("height"), F.col("_seen.ratio").alias("ratio"), coloured.alias("coloured"), error.alias("error"))


def resize_pixels(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resizing with pixel centres aligned."""
    h, w, _ = pixels.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float64)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def _resized(pixels: Column, width: str, height: str) -> Column:
    def resize(column: pd.DataFrame, width: pd.Series, height: pd.Series) -> pd.Series:
        rows = zip(column[["height", "width", "channels", "data"]].itertuples(index=False), width, height, strict=True)
        made = [None if r.data is None or pd.isna(w) else png_bytes(resize_pixels(pixel_array(int(r.height), int(r.width), int(r.channels), r.data), int(w), int(h))) for r, w, h in rows]
        return pd.Series(made, dtype=object)

    return F.pandas_udf(resize, "binary")(pixels, width, height)


def _resize(rows: DataFrame, content: str, width: Column, height: Column, needed: Column) -> DataFrame:
    """Add _made: content as a PNG of (width, height) where `needed`, null if it can't be decoded; only those are decoded."""
    marked = rows.withColumns({"_need": F.coalesce(needed, F.lit(False)), "_w": width.cast("int"), "_h": height.cast("int")})
    return marked.withColumn("_made", _resized(pixels_of(rows.sparkSession, F.when(F.col("_need"), F.col(content))), "_w", "_h"))


def resize_to_match(rows: DataFrame, original: str, new: str, out: str = "resized") -> DataFrame:
    """`new` (PNG or JPEG) resized to the dimensions of `original`, as PNG; equal dimensions leave the bytes as they are; undecodable ones
    are null."""
    sized = rows.withColumns({"_want": header_size(F.col(original)), "_have": header_size(F.col(new))})
    known = F.col("_want.width").isNotNull() & F.col("_have.width").isNotNull()
    differs = known & ((F.col("_want.width") != F.col("_have.width")) | (F.col("_want.height") != F.col("_have.height")))
    made = _resize(sized, new, F.col("_want.width"), F.col("_want.height"), differs)
    return made.select(*[c for c in rows.columns if c != out], F.when(differs, F.col("_made")).when(known, F.col(new)).alias(out))


def cap_resolution(rows: DataFrame, content: str, slot_w: Column | float, slot_h: Column | float, dpi: int = 300, out: str = "capped") -> DataFrame:
    """Pictures with more pixels than their place (millimetres; numbers, or columns) takes at `dpi` made smaller, as PNG; others, and
    undecodable ones, as they are."""
    most_w, most_h = ((F.lit(x) / 25.4 * dpi).cast("int") for x in (slot_w, slot_h))
    sized = rows.withColumns({"_size": header_size(F.col(content)), "_most_w": most_w, "_most_h": most_h})
    w, h = F.col("_size.width"), F.col("_size.height")
    scale = F.least(F.col("_most_w").cast("double") / w, F.col("_most_h").cast("double") / h)
    over = F.coalesce((w > F.col("_most_w")) | (h > F.col("_most_h")), F.lit(False))
    made = _resize(sized, content, F.greatest(F.lit(1), (w * scale).cast("int")), F.greatest(F.lit(1), (h * scale).cast("int")), over)
    return made.select(*[c for c in rows.columns if c != out], F.coalesce(F.when(over, F.col("_made")), F.col(content)).alias(out))
