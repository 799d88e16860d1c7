"""JSON, base64 and message functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension, and image extensions of URLs.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "svg": "image/svg+xml"}
URL_EXTENSIONS = "png|jpg|jpeg|webp"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often it is used: an expression that is used twice would be computed, and compiled, twice."""
    return F.transform(F.array(c), use)[0]


def strip_fences(c: Column) -> Column:
    """Without the lines that open or close a code fence, if the text starts with one."""
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: ~F.ltrim(x).startswith("```"))
    return F.when(bare.startswith("```"), F.array_join(lines, "\n")).otherwise(bare)


def json_object(c: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    found = F.regexp_extract(strip_fences(c), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_array(c: Column) -> Column:
    found = F.regexp_extract(strip_fences(c), r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def triage_verdict(c: Column) -> Column:
    """struct(should_colorize, reason, error) of a model's reply; a missing flag is false, a reply without an object or of wrong types is an error."""

    def read(found: Column) -> Column:
        return F.struct(found.alias("found"), F.from_json(found, "should_colorize boolean, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("parsed"))

    def judged(x: Column) -> Column:
        error = F.when(x["found"].isNull(), "no JSON object").when(x["parsed"]["_bad"].isNotNull(), "bad JSON")
        return F.struct(
            F.when(error.isNull(), F.coalesce(x["parsed"]["should_colorize"], F.lit(False))).alias("should_colorize"),
            F.when(error.isNull(), F.coalesce(x["parsed"]["reason"], F.lit(""))).alias("reason"),
            error.alias("error"),
        )

    return bound(bound(bound(c, json_object), read), judged)


def routine_rows(c: Column) -> Column:
    """array of (data, campo, experiencia) of a reply; null if it can't be read."""
    return F.from_json(json_array(c), "array<struct<data:string,campo:string,experiencia:string>>")


def prompt_items(c: Column) -> Column:
    return F.from_json(json_array(c), "array<struct<index:int,name:string,slug:string,prompt:string>>")


def chat_request(model: Column, messages: Column, aspect: Column | None = None) -> Column:
    """Request JSON; empty fields are left out."""
    config = F.when(aspect.isNotNull(), F.struct(aspect.alias("aspect_ratio"))) if aspect is not None else F.lit(None).cast("struct<aspect_ratio:string>")
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), config.alias("image_config")))


def data_url(content: Column, ext: Column) -> Column:
    """data: URL of binary content; the type follows the extension, PNG if unknown."""
    kind = F.coalesce(*[F.when(F.lower(ext) == e, m) for e, m in MEDIA_TYPES.items()], F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def image_reference(c: Column) -> Column:
    """struct(kind, value) of the image that a reply's text holds: a data URL of over 50 bytes, an image URL, any URL, over 100 characters
    of plain base64, else nothing."""

    def parts(x: Column) -> Column:
        return F.struct(
            F.regexp_extract(x, r"(data:image/[a-zA-Z0-9+.-]+;base64,[A-Za-z0-9+/=]+)", 1).alias("data"),
            F.regexp_extract(x, rf"(?i)(https?://[^\s\"'<>)]+\.(?:{URL_EXTENSIONS}))", 1).alias("image"),
            F.regexp_extract(x, r"(https?://[^\s\"'<>)]+)", 1).alias("plain"),
            F.regexp_replace(x, r"^\s+|\s+$", "").alias("bare"),
        )

    def chosen(p: Column) -> Column:
        found = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        base64 = (F.length(p["bare"]) > 100) & p["bare"].rlike("^[A-Za-z0-9+/]+=*$")
        return F.when(F.length(p["data"]) > 50, found("data", p["data"])).when(p["image"] != "", found("image_url", p["image"])).when(p["plain"] != "", found("url", p["plain"])).when(base64, found("base64", p["bare"])).otherwise(F.lit(None))

    return bound(bound(c, parts), chosen)


def data_url_extension(c: Column) -> Column:
    return F.when(F.regexp_extract(c, "^data:image/([^;]*);", 1).isin("jpeg", "jpg"), "jpg").otherwise("png")


def content_type_extension(c: Column) -> Column:
    """File extension of a download by its content type, PNG if unknown."""
    return F.when(c.contains("jpeg") | c.contains("jpg"), "jpg").when(c.contains("webp"), "webp").otherwise("png")


def unwrap_response(status: Column, body: Column) -> Column:
    """struct(content, image, error) of a chat response: a status but 200, an error or no choices are errors; an image is looked for in
    the images, then the content's parts, then the text."""
    message = F.get_json_object(body, "$.error.message")
    content = F.get_json_object(body, "$.choices[0].message.content")
    image = F.coalesce(F.get_json_object(body, "$.choices[0].message.images[0].image_url.url"), F.get_json_object(body, "$.choices[0].message.content[0].image_url.url"), image_reference(F.coalesce(content, F.lit("")))["value"])
    error = F.when(status != 200, F.concat(F.lit("status "), status.cast("string"))).when(message.isNotNull(), message).when(F.get_json_object(body, "$.choices[0]").isNull(), "no choices")
    return bound(F.struct(content.alias("content"), image.alias("image"), error.alias("error")), lambda x: F.struct(F.when(x["error"].isNull(), x["content"]).alias("content"), F.when(x["error"].isNull(), x["image"]).alias("image"), x["error"].alias("error")))
