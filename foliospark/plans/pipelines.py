"""The batch pipelines: colour the pictures of documents, compile routines, generate pictures, lay out cards and pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import structured as st
from foliospark.functions import text as tx
from foliospark.operators import cascade, layout, relational
from foliospark.plans import options
from foliospark.sources import archives as ar
from foliospark.sources import images as im
from foliospark.sources.models import KeptAnswers
from foliospark.tables import materialise, number_groups, write_files

DONE, ERROR = "done", "error"


@dataclass
class Coloured:
    """What the document pipeline gives: one row an image, one a document, and the rebuilt archives."""

    images: DataFrame
    summary: DataFrame
    archives: DataFrame


def _request(key, content, ext, prompt: str, model: str):
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(st.data_url(content, ext).alias("url")).alias("image_url")))
    return key.alias("key"), st.chat_request(F.lit(model), F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))).alias("body")


def request_key(stage: str, content) -> object:
    """Names a request by its content, so that equal pictures are asked for once and a retried task finds the answer."""
    return F.sha2(F.concat(F.lit(stage + ":").cast("binary"), content), 256)


def judge_images(items: DataFrame, triage, prompt: str = "", model: str = "triage", enabled: bool = True, key: str = "image_key") -> DataFrame:
    """Add stage and reason to images (image_key, content, format): the saturation rule, then the model for those that pass it."""
    measured = materialise(im.measure_images(items))  # what the local rule lets pass is read three times

    def ask(rows: DataFrame) -> DataFrame:
        keyed = rows.select(key, "content", "format", request_key("triage", F.col("content")).alias("_ask"))
        asked = keyed.dropDuplicates(["_ask"]).select(*_request(F.col("_ask"), F.col("content"), F.col("format"), prompt, model))
        answers = triage.ask(asked)
        reply = st.unwrap_response(F.col("status"), F.col("body"))
        verdict = st.triage_verdict(F.coalesce(reply["content"], F.lit("")))
        read = answers.select(F.col("key").alias("_ask"), reply["error"].alias("_e"), verdict.alias("_v"))
        joined = keyed.select(key, "_ask").join(read, "_ask", "left")
        return joined.select(key, F.col("_v.should_colorize").alias("should_colorize"), F.col("_v.reason").alias("reason"), F.coalesce("_e", "_v.error").alias("error"))

    return cascade.run_cascade(measured.withColumnRenamed("error", "decode_error"), F.col("coloured"), F.col("decode_error"), ask, key, enabled).drop("ratio", "coloured")


def resolve_images(found: DataFrame, fetch=None) -> DataFrame:
    """(key, content, format, error) of replies (key, image, error): inline data is decoded, and URLs are fetched if there is a fetcher."""
    found = found.withColumn("_i", st.image_reference(F.coalesce("image", F.lit(""))))
    data = F.when(F.col("_i.kind") == "data", F.substring_index("_i.value", ",", -1)).when(F.col("_i.kind") == "base64", F.col("_i.value"))
    found = found.withColumn("_data", F.try_to_binary(data, F.lit("base64"))).withColumn("_url", F.when(F.col("_i.kind").isin("url", "image_url"), F.col("_i.value")))
    error = F.when(F.col("_url").isNotNull(), "the image is at a URL, and there is no fetcher").when(F.col("_data").isNull(), "no image in the reply")
    inline = found.select("key", F.col("_data").alias("content"), st.data_url_extension(F.coalesce("_i.value", F.lit(""))).alias("format"), F.coalesce("error", error).alias("error"), "_url")
    if fetch is None:
        return inline.drop("_url")
    files = materialise(fetch.get(inline.where("_url is not null and (error is null or error like 'the image is at%')").select(F.col("_url").alias("url"))))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    files = files.select(F.col("url").alias("_url"), F.when(F.col("status") == 200, F.col("content")).alias("_file"), st.content_type_extension(kind).alias("_ext"), F.when((F.col("status") != 200) | F.col("content").isNull(), F.concat(F.lit("download: status "), F.col("status").cast("string"))).alias("_failed"))
    both = inline.join(files, "_url", "left")
    at_url = F.col("_url").isNotNull() & ((F.col("error") == "the image is at a URL, and there is no fetcher") | F.col("error").isNull())
    return both.select("key", F.when(at_url, F.col("_file")).otherwise(F.col("content")).alias("content"), F.when(at_url, F.col("_ext")).otherwise(F.col("format")).alias("format"), F.when(at_url, F.col("_failed")).otherwise(F.col("error")).alias("error"))


def process_documents(docs: DataFrame, triage, colour, min_size: str | int = 0, no_triage: bool = False, triage_prompt: str = "", colour_prompt: str = "", fetch=None, answers: str | None = None) -> Coloured:
    """Pictures of documents (doc_path, archive) judged, coloured, resized to the original and put back.

    `triage` and `colour` are model adapters, `fetch` a downloader for answers that are URLs. A picture that the model doesn't colour
    keeps its original; a document of which nothing was replaced has a null archive; one that can't be read has an error. Each different
    request is made once: answers are written, below `answers` or else in the shared folder, before the three results read them.
    """
    triage = KeptAnswers(triage, f"{answers}/triage" if answers else None)
    colour = KeptAnswers(colour, f"{answers}/colour" if answers else None)
    session = docs.sparkSession
    least = session.range(1).select(tx.parse_size(F.lit(str(min_size)))).first()[0]
    if least is None:
        raise ValueError(f"size {min_size!r} can't be read")
    listed = materialise(ar.list_entries(docs, least))
    pictures = listed.where("kept and error is null").withColumn("image_key", F.concat_ws("!", "doc_path", "path_in_zip")).drop("error")
    judged = materialise(judge_images(pictures, triage, triage_prompt, enabled=not no_triage))
    wanted = judged.where(cascade.kept(F.col("stage"))).withColumn("_ask", request_key("colour", F.col("content")))
    asked = wanted.dropDuplicates(["_ask"]).select(*_request(F.col("_ask"), F.col("content"), F.col("format"), colour_prompt, "colour"))
    reply = st.unwrap_response(F.col("status"), F.col("body"))
    found = resolve_images(colour.ask(asked).select("key", reply["image"].alias("image"), reply["error"].alias("error")), fetch)
    found = found.select(F.col("key").alias("_ask"), F.col("content").alias("_new"), F.col("error").alias("_error"))
    answered = materialise(wanted.select("image_key", "content", "_ask").join(found, "_ask", "left"))
    resized = im.resize_to_match(answered, "content", "_new", "new_content")
    done = materialise(resized.select("image_key", "new_content", F.coalesce("_error", F.when(F.col("new_content").isNull(), "no usable image")).alias("error")))
    result = judged.join(done, "image_key", "left").withColumn("coloured", F.col("new_content").isNotNull())
    images = result.select("doc_path", "entry_idx", "original_name", "path_in_zip", "size", "format", "stage", "reason", "coloured", "error")
    rebuilt = ar.rebuild_archives(docs, result.where("coloured").select("doc_path", "path_in_zip", "new_content"))
    counts = listed.groupBy("doc_path").agg(F.count("path_in_zip").alias("listed"), F.count_if(~F.col("kept") & F.col("error").isNull()).alias("skipped"), F.max("error").alias("error"))
    stages = images.groupBy("doc_path").agg(F.count_if("coloured").alias("coloured"), F.count_if(F.col("stage") == cascade.LOCAL).alias("skipped_local"), F.count_if(F.col("stage") == cascade.TRIAGE).alias("skipped_triage"))
    return Coloured(images, counts.join(stages, "doc_path", "left").na.fill(0, ["coloured", "skipped_local", "skipped_triage"]), rebuilt)


def compile_routines(docs: DataFrame, model, prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows (doc_path, seq, data, campo, experiencia) of all documents' replies, and the documents that gave none."""
    texts = ar.extract_text(docs)
    asked = texts.where("error is null").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    message = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(prompt + "\n"), "text").alias("text"))).alias("content")))
    answers = KeptAnswers(model).ask(asked.select("key", st.chat_request(F.lit("routine"), message).alias("body")))
    reply = st.unwrap_response(F.col("status"), F.col("body"))
    read = answers.select("key", reply["error"].alias("_e"), st.routine_rows(F.coalesce(reply["content"], F.lit(""))).alias("_rows"))
    joined = texts.withColumn("key", F.sha2("text", 256)).join(read, "key", "left")
    error = F.coalesce("error", "_e", F.when(F.col("_rows").isNull(), "reply holds no rows"))
    judged = joined.select("doc_path", error.alias("error"), "_rows")
    rows = judged.where("error is null").select("doc_path", F.posexplode("_rows").alias("seq", "r"))
    empty = F.lit("")
    rows = rows.select("doc_path", "seq", *[F.coalesce(f"r.{c}", empty).alias(c) for c in ("data", "campo", "experiencia")])
    return rows, judged.where("error is not null").select("doc_path", "error")


def ordered_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with rn, their number in their report (each value of `by`, or all rows) by date, then raw text; reports of any length."""
    return number_groups(rows, by or [], [tx.resilient_date(F.col("data")), "data", "doc_path", "seq"])


def reports(rows: DataFrame, *by: str) -> DataFrame:
    """(by, archive): a report document of each group's rows (data, campo, experiencia, doc_path, seq) in order; a group is one document."""
    key = F.struct(tx.resilient_date(F.col("data")).isNull(), tx.resilient_date(F.col("data")), "data", "doc_path", "seq")
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(key.alias("o"), F.struct("data", "campo", "experiencia").alias("r")))).alias("held"))

    @F.pandas_udf("binary")
    def make(column):
        return column.map(lambda cells: ar.report_docx([(c["data"], c["campo"], c["experiencia"]) for c in cells]))

    return held.where(F.size("held") > 0).select(*by, make(F.transform("held", lambda x: x["r"])).alias("archive"))


def write_report(rows: DataFrame) -> bytes:
    """The bytes of one report. No rows are an error."""
    made = reports(rows).first()
    if made is None:
        raise ValueError("there are no rows to report")
    return bytes(made["archive"])


def synthesise_prompts(reply: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(rn, name, slug, prompt, status) of a model's item list (one row, column reply): numbered anew, slugs made clean and unique."""
    rows = reply.select(F.posexplode(st.prompt_items(F.col("reply"))).alias("pos", "i")).select("pos", "i.*")
    numbered = rows.withColumn("rn", F.col("pos") + 1)
    made = tx.slug(F.col("rn"), F.coalesce(F.col("name"), F.lit("")))
    return numbered.select("rn", F.coalesce("name", F.lit("")).alias("name"), made.alias("slug"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.lit("pending").alias("status"))


def generate_images(prompts: DataFrame, model, aspect: str = "1:1", fetch=None, answers: str | None = None) -> DataFrame:
    """Add status (done or error), content, format and error to each prompt; each different prompt is sent once."""
    options.check_aspect(aspect)
    key = F.sha2(F.concat_ws("|", F.lit(aspect), "prompt"), 256)
    message = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text"))).alias("content")))
    keyed = prompts.withColumn("key", key)
    place = [F.col("rn").alias("order")] if "rn" in prompts.columns else []  # prompts go out in their order
    replies = KeptAnswers(model, answers).ask(keyed.select("key", *place, st.chat_request(F.lit("image"), message, F.lit(aspect)).alias("body")))
    reply = st.unwrap_response(F.col("status"), F.col("body"))
    found = resolve_images(replies.select("key", reply["image"].alias("image"), reply["error"].alias("error")), fetch)
    keep = [c for c in prompts.columns if c not in ("status", "content", "format", "error")]
    joined = keyed.select(*keep, "key").join(found, "key", "left")
    error = F.coalesce("error", F.when(F.col("content").isNull(), "no image in the reply"))
    return joined.select(*keep, F.when(error.isNull(), DONE).otherwise(ERROR).alias("status"), "content", F.when(error.isNull(), F.col("format")).alias("format"), error.alias("error"))


def ready(items: DataFrame, path: str = "path") -> DataFrame:
    """Generated items that are done and have a file: those that cards and two-up pages are made of."""
    return items.where((F.col("status") == DONE) & (F.coalesce(F.col(path), F.lit("")) != ""))


def save_generated(items: DataFrame, folder: str) -> DataFrame:
    """Write the pictures of generated items (slug, status, content, format) into a folder; the items with their path."""
    named = items.withColumn("_name", F.when((F.col("status") == DONE) & F.col("content").isNotNull(), F.concat("slug", F.lit("."), "format")))
    write_files(named.where("_name is not null"), folder, "_name", "content")
    return named.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "_name")).drop("_name")


def lay_out_cards(items: DataFrame, name: str = "path", columns: int = 2, rows: int = 3, uppercase: bool = True, by: list[str] | None = None) -> DataFrame:
    """Cells of the card sheets of each value of `by` (or of one) in natural order of file names, then of whole names."""
    options.check_grid(columns, rows)
    label = tx.card_label(F.col(name))
    numbered = number_groups(items, by or [], [tx.natural_key(tx.basename(F.col(name))), name])
    return layout.card_cells(numbered, columns=columns, rows=rows).withColumn("label", tx.upper_label(label) if uppercase else label)


def cards_html(cells: DataFrame, title: str = "", columns: int = 2, by: list[str] | None = None) -> DataFrame:
    """(by, page, html) of each page of a card sheet."""
    by = by or []
    card = F.concat(F.lit("<figure>"), F.coalesce(F.concat(F.lit('<img src="'), F.col("data_uri"), F.lit('">')), F.lit("")), F.lit("<figcaption>"), tx.html_escape(F.col("label")), F.lit("</figcaption></figure>"))
    pages = cells.withColumn("_card", card).groupBy(*by, "page").agg(relational.ordered_text(F.col("local"), F.col("_card"), "").alias("_cards"))
    return pages.select(*by, "page", F.concat(F.lit(f'<section style="grid-template-columns:repeat({columns},1fr)"><h1>'), tx.html_escape(F.lit(title)), F.lit("</h1>"), "_cards", F.lit("</section>")).alias("html"))


def lay_out_two_up(images: DataFrame, options_: layout.TwoUpOptions | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, pair, side, path, rotated, draw_w, draw_h) of images (by, path, width, height) two a page, in natural order in each book."""
    o, by = (options_ or layout.TwoUpOptions()).settled(), by or []
    numbered = number_groups(images.select(*by, "path", "width", "height"), by, [tx.natural_key(tx.basename(F.col("path"))), "path"])
    pairs = layout.pair_two_up(numbered.withColumn("_image", F.struct("path", "width", "height")), "_image", duplicate=o.duplicate, partition=by, none=None)
    sides = pairs.select(*by, "pair", F.posexplode(F.array("left", "right")).alias("side", "_i")).where(F.col("_i.path") != "")
    placed = sides.select(*by, "pair", "side", F.col("_i.path").alias("path"), *(F.col(f"_i.{c}").cast("double").alias(c) for c in ("width", "height")))
    return layout.place_in_slot(placed, "width", "height", o)
