"""Card sheets and two-up pages as PDF documents: each page is a row of its own, and a document its pages' parts in order."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import layout
from foliospark.sources import images as im
from foliospark.sources.files import write_folder
from foliospark.tables import materialise

POINT = 72 / 25.4
#: What is drawn: a picture, or a text, in a box of millimetres from the top left corner of a page.
ITEM = "struct<page:int,kind:string,x:double,y:double,w:double,h:double,rotated:boolean,text:string,size:double,content:binary,pixels:struct<height:int,width:int,channels:int,data:binary>>"
#: Colours of labels, page labels and cut lines (red, green, blue), the dash, and the header of a card sheet.
INK, GREY, CUT, DASH = "0.118 0.161 0.231", "0.392 0.455 0.545", "0.706 0.706 0.706", 2.0
TITLE, TITLE_SIZE, PAGE_SIZE, HEADER_CELL, CELL_MARGIN = "Fichas Pedagógicas", 14.0, 9.0, 8.0, 1.0
#: Helvetica's widths of what a page label holds, a thousandth of its size each.
PAGE_LABEL_WIDTHS = {"P": 667, "á": 556, "g": 556, ".": 278, " ": 278, "/": 278}
DIGIT_WIDTH = 556
#: Objects that come before those of the pages: tree, bold and regular font, catalog.
FIRST_ID = 5
#: Sections of a document, in order: start, pages, tree and its pages, catalog and table, table of the pages, end.
START, PAGES, TREE, KIDS, TABLE, ENTRIES, END = range(7)
KID = "%010d 0 R "
START_TEXT = "%PDF-1.4\n"


def _object(number: int, head: str, stream: bytes | None = None) -> bytes:
    body = head.encode("latin-1") if stream is None else f"<<{head}/Length {len(stream)}>>\nstream\n".encode() + stream + b"\nendstream"
    return f"{number} 0 obj\n".encode() + body + b"\nendobj\n"


def _picture(number: int, item) -> bytes | None:
    """A JPEG goes in as it is; other pictures as compressed pixels."""
    if item["pixels"] is None:
        return None
    p = item["pixels"]
    height, width, channels = (int(p[k]) for k in ("height", "width", "channels"))
    head = f"/Type/XObject/Subtype/Image/Width {width}/Height {height}/BitsPerComponent 8/ColorSpace"
    if bytes(item["content"][:2]) == b"\xff\xd8" and channels == 3:
        return _object(number, f"{head}/DeviceRGB/Filter/DCTDecode", bytes(item["content"]))
    pixels = im.pixel_array(height, width, channels, p["data"])[:, :, :3]
    return _object(number, f"{head}/DeviceRGB/Filter/FlateDecode", zlib.compress(pixels.tobytes()))


#: How texts are written, by kind: font, colour and what ends one.
TEXTS = {"label": ("F1", INK, " Tj ET"), "title": ("F1", INK, " Tj\nET"), "page": ("F2", GREY, " Tj\nET")}


def draw_page(items: list, page: int, stride: int, width: float, height: float, cut_at: float | None, margin: float) -> tuple[bytes, list[int]]:
    """(objects, their places in them) of a page: itself, its content, then its pictures; a page has `stride` objects, the rest null."""
    first = FIRST_ID + page * stride
    lines, made, names = [], [], []
    for item in items:
        w, h = item["w"] * POINT, item["h"] * POINT
        x, y = item["x"] * POINT, (height - item["y"]) * POINT - h  # from the bottom left corner
        if item["kind"] in TEXTS:
            font, ink, end = TEXTS[item["kind"]]
            text = item["text"].encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
            lines.append(f"BT /{font} {item['size']:g} Tf {ink} rg {x:.3f} {y:.3f} Td ({text}){end}")
        elif (data := _picture(first + 2 + len(made), item)) is not None:
            names.append(f"/I{first + 2 + len(made)} {first + 2 + len(made)} 0 R")
            turn = f"0 {h:.3f} {-w:.3f} 0 {x + w:.3f} {y:.3f}" if item["rotated"] else f"{w:.3f} 0 0 {h:.3f} {x:.3f} {y:.3f}"
            lines.append(f"q {turn} cm /I{first + 2 + len(made)} Do Q")
            made.append(data)
    if cut_at is not None:
        lines.append(f"q {CUT} RG {0.3 * POINT:.3f} w [{DASH * POINT:.3f}] 0 d {cut_at * POINT:.3f} {margin * POINT:.3f} m {cut_at * POINT:.3f} {(height - margin) * POINT:.3f} l S Q")
    own = _object(first, f"<</Type/Page/Parent 1 0 R/MediaBox[0 0 {width * POINT:.3f} {height * POINT:.3f}]/Resources<</Font<</F1 2 0 R/F2 3 0 R>>/XObject<<{''.join(names)}>>>>/Contents {first + 1} 0 R>>")
    parts = [own, _object(first + 1, "", "\n".join(lines).encode("latin-1")), *made, *(_object(first + k, "null") for k in range(2 + len(made), stride))]
    places, at = [], 0
    for part in parts:
        places.append(at)
        at += len(part)
    return b"".join(parts), places


def document_parts(items: DataFrame, by: list[str], per_page: int, width: float, height: float, cut_at: float | None = None, margin: float = 0.0) -> DataFrame:
    """(by, section, page, part) of each document: its bytes are its parts by section and page.

    items: by, page (from 0, none left out), order and item. A page's items, per_page pictures at most, meet in one row and are drawn
    there; places of objects follow from the pages' sizes by a running sum over one small row a page. No row holds a whole document.
    """
    stride = per_page + 2

    @F.pandas_udf("data binary, places array<int>")
    def draw(held: pd.Series, page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([draw_page(list(h), int(p), stride, width, height, cut_at, margin) for h, p in zip(held, page, strict=True)], columns=["data", "places"])

    grouped = items.groupBy(*by, "page").agg(F.sort_array(F.collect_list(F.struct("order", "item"))).alias("held"))
    pages = materialise(grouped.select(*by, "page", draw(F.transform("held", lambda x: x["item"]), "page").alias("d")).select(*by, "page", "d.*", F.octet_length("d.data").cast("long").alias("size")))
    fonts = [f"<</Type/Font/Subtype/Type1/BaseFont/{n}/Encoding/WinAnsiEncoding>>" for n in ("Helvetica-Bold", "Helvetica")]
    start = START_TEXT.encode() + b"".join(_object(i, f) for i, f in enumerate(fonts, 2)) + _object(4, "<</Type/Catalog/Pages 1 0 R>>")
    known = [start.index(f"{i} 0 obj".encode()) for i in (2, 3, 4)]
    so_far = W.partitionBy(*by).orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    placed = pages.select(*by, "page", "places", (F.lit(len(start)) + F.coalesce(F.sum("size").over(so_far), F.lit(0))).alias("_at"))
    totals = pages.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    tree = F.lit(len(start)) + F.col("size")
    tree_head, tree_end = F.format_string("1 0 obj\n<</Type/Pages/Count %d/Kids[", "n"), "]>>\nendobj\n"
    kid = len(KID % 0)
    table = tree + F.length(tree_head) + F.col("n") * kid + len(tree_end)
    count = F.lit(FIRST_ID) + F.col("n") * stride
    entry = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    opening = F.concat(F.lit(tree_end), F.format_string("xref\n0 %d\n", count), F.lit("0000000000 65535 f \n"), entry(tree), *(entry(F.lit(k)) for k in known))
    closing = F.format_string("trailer\n<</Size %d/Root 4 0 R>>\nstartxref\n%d\n%%%%EOF\n", count, table)
    entries = F.array_join(F.transform("places", lambda p: entry(F.col("_at") + p)), "")

    def part(df: DataFrame, section: int, page, data: Column) -> DataFrame:
        return df.select(*by, F.lit(section).alias("section"), (F.col(page) if page else F.lit(0)).cast("long").alias("page"), data.cast("binary").alias("part"))

    out = part(totals, START, None, F.lit(start))
    for more in (part(pages, PAGES, "page", F.col("data")), part(totals, TREE, None, tree_head), part(pages, KIDS, "page", F.format_string(KID, F.lit(FIRST_ID) + F.col("page") * stride)), part(totals, TABLE, None, opening), part(placed, ENTRIES, "page", entries), part(totals, END, None, closing)):
        out = out.unionByName(more)
    return out


def whole_documents(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, pdf) of document_parts, for documents that fit into a row; write_documents has no such bound."""

    @F.pandas_udf("binary")
    def join(column: pd.Series) -> pd.Series:
        return column.map(lambda held: b"".join(bytes(x) for x in held))

    held = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("section", "page", "part"))).alias("held"))
    return held.select(*by, join(F.transform("held", lambda x: x["part"])).alias("pdf"))


def write_documents(parts: DataFrame, by: list[str], folder: str, name: Column) -> None:
    """Each document as a file of the folder, called `name` (of the by columns): a task writes its parts one after another."""
    keyed = parts.withColumn("_name", name)
    dealt = keyed.repartition("_name").sortWithinPartitions("_name", "section", "page")
    write_folder(dealt, folder, "_name", "part", joined=True)


def _item(page, kind: str, x, y, w, h, rotated=None, text=None, size=None, content=None, pixels=None):
    values = {"page": page, "kind": F.lit(kind), "x": x, "y": y, "w": w, "h": h, "rotated": rotated, "text": text, "size": size, "content": content, "pixels": pixels}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in values.items()]).cast(ITEM)


def _page_label(page: Column, total: Column) -> Column:
    return F.format_string("Pág. %d / %d", page + 1, total)


def _page_label_width(label: Column) -> Column:
    """Millimetres, in Helvetica of PAGE_SIZE."""
    widths = F.create_map(*[F.lit(x) for kv in PAGE_LABEL_WIDTHS.items() for x in kv])
    letters = F.filter(F.split(label, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.coalesce(F.try_element_at(widths, c), F.lit(DIGIT_WIDTH))) / 1000.0 * PAGE_SIZE / POINT


def card_sheets(cells: DataFrame, by: list[str], content: str = "content", title: str = "", columns: int = 2, rows: int = 3) -> DataFrame:
    """document_parts of card cells (layout.card_cells, with label and picture content, null or undecodable for none): on each page the
    title, which page of how many it is, pictures contained in their cell above the label, labels shrunk to fit."""
    decoded = im.decode_images(cells, F.col(content), "pixels")
    box_h = F.col("cell_h") - layout.LABEL
    w, h = layout.fit_contain(F.col("pixels.width").cast("double"), F.col("pixels.height").cast("double"), F.col("cell_w") - 2, box_h - 2)
    picture = _item(F.col("page"), "picture", F.col("x") + (F.col("cell_w") - w) / 2, F.col("y") + (box_h - h) / 2, w, h, F.lit(False), None, None, F.col(content), F.col("pixels"))
    size = layout.label_size(F.col("label"), F.col("cell_w"))
    width = layout.text_width(F.col("label")) * size / 1000 / POINT
    label = _item(F.col("page"), "label", F.col("x") + (F.col("cell_w") - width) / 2, F.col("y") + box_h + layout.LABEL / 3, width, F.lit(layout.LABEL / 3), None, F.col("label"), size)
    drawn = F.filter(F.array(picture, label), lambda i: (i["kind"] == "label") | i["pixels"].isNotNull())
    items = decoded.select(*by, "page", F.posexplode(drawn).alias("_at", "item"), "local").select(*by, "page", F.struct(F.col("local").cast("int").alias("local"), F.col("_at").cast("int").alias("at")).alias("order"), "item")
    pages = cells.select(*by, "page").distinct()
    total = pages.groupBy(*by).agg(F.count("*").alias("_pages"))
    joined = pages.join(total, by) if by else pages.crossJoin(total)  # one row without by
    text = _page_label(F.col("page"), F.col("_pages"))
    base = lambda points: layout.MARGIN + HEADER_CELL / 2 + 0.3 * points / POINT
    wide = _page_label_width(text)
    header = F.array(
        _item(F.col("page"), "title", F.lit(layout.MARGIN + CELL_MARGIN), F.lit(base(TITLE_SIZE)), F.lit(0.0), F.lit(0.0), None, F.lit(title or TITLE), F.lit(TITLE_SIZE)),
        _item(F.col("page"), "page", F.lit(layout.A4_W - layout.MARGIN - CELL_MARGIN) - wide, F.lit(base(PAGE_SIZE)), wide, F.lit(0.0), None, text, F.lit(PAGE_SIZE)),
    )
    headers = joined.select(*by, "page", F.posexplode(header).alias("_at", "item")).select(*by, "page", F.struct(F.lit(-1).alias("local"), F.col("_at").cast("int").alias("at")).alias("order"), "item")
    return document_parts(items.unionByName(headers), by, max(1, columns) * max(1, rows), layout.A4_W, layout.A4_H)


def cards_pdf(cells: DataFrame, by: list[str], content: str = "content", title: str = "", columns: int = 2, rows: int = 3) -> DataFrame:
    """(by, pdf) of card_sheets."""
    return whole_documents(card_sheets(cells, by, content, title, columns, rows), by)


def two_up_books(placed: DataFrame, by: list[str], options: layout.TwoUpOptions | None = None, content: str = "content") -> DataFrame:
    """document_parts of placed pictures (pipelines.lay_out_two_up, with content): two to a landscape page, turned where that was decided,
    with a dashed cut line between them. With `optimize`, pictures of more pixels than their place takes at max_dpi are made smaller
    first; others go in as they are, so JPEG isn't encoded anew and quality has no say. Undecodable pictures leave their place empty."""
    o = (options or layout.TwoUpOptions()).settled()
    slot_w, slot_h = o.slot()
    if o.optimize:
        placed = im.cap_resolution(placed, content, F.col("draw_w"), F.col("draw_h"), o.max_dpi, content)
    decoded = im.decode_images(placed, F.col(content), "pixels")
    half = layout.A4_H / 2
    seen_w, seen_h = F.col("draw_w"), F.col("draw_h")  # as seen on the page, after the turn
    x = F.col("side") * half + o.margin + (F.lit(slot_w) - seen_w) / 2
    picture = _item(F.col("pair"), "picture", x, F.lit(o.margin) + (F.lit(slot_h) - seen_h) / 2, seen_w, seen_h, F.col("rotated"), None, None, F.col(content), F.col("pixels"))
    items = decoded.select(*by, F.col("pair").alias("page"), F.col("side").cast("int").alias("order"), picture.alias("item"))
    return document_parts(items, by, 2, layout.A4_H, layout.A4_W, half if o.cut_line else None, o.margin)


def two_up_pdf(placed: DataFrame, by: list[str], options: layout.TwoUpOptions | None = None, content: str = "content") -> DataFrame:
    """(by, pdf) of two_up_books."""
    return whole_documents(two_up_books(placed, by, options, content), by)
