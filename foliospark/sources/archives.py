"""Document archives (.docx) as rows: entries, text, rebuilt archives."""

from __future__ import annotations

import io
import posixpath
import re
import warnings
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = "word/media/"
DOCUMENT = "word/document.xml"

#: What a broken, encrypted or null archive raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, TypeError, ValueError, NotImplementedError, RuntimeError)

#: Rows, and bytes of them, that Python gives back at once: a table costs about a millisecond, whatever it holds.
BATCH_ROWS, BATCH_BYTES = 1 << 12, 4 << 20

ENTRY_SCHEMA = "doc_path string, entry_idx int, original_name string, path_in_zip string, size bigint, format string, kept boolean, content binary, error string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(doc_path, archive) of the .docx files of a folder, without the lock files that begin with ~$."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(name).endswith(".docx") & ~name.startswith("~$")).select(F.col("path").alias("doc_path"), F.col("content").alias("archive"))


def in_batches(rows: Iterable[tuple], columns: list[str], content: int) -> Iterator[pd.DataFrame]:
    """Rows in tables of bounded size; `content` is the place of their bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[content] or b"")
        if weight >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def list_entries(archives: DataFrame, min_size: int = 0, prefix: str = MEDIA, with_content: bool = True, wanted: str | None = None) -> DataFrame:
    """One row for each archive entry below prefix, in archive order; entries under min_size are listed but not inflated (kept is false).

    An archive that can't be read gives one row with its error. Size, prefix and the column `wanted` (paths; others aren't listed) are
    arguments, so that nothing is inflated in vain.
    """
    paths = F.col(wanted) if wanted else F.lit(None).cast("array<string>")

    columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def of_archive(path: str, data: bytes, listed: set[str] | None) -> list[tuple]:
        rows = []
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i, info in enumerate(z.infolist()):
                    if info.is_dir() or not info.filename.startswith(prefix) or (listed is not None and info.filename not in listed):
                        continue
                    kept = info.file_size >= min_size
                    ext = posixpath.splitext(info.filename)[1].lstrip(".").lower()
                    rows.append((path, i, posixpath.basename(info.filename), info.filename, info.file_size, ext, kept, z.read(info) if kept and with_content else None, None))
        except UNREADABLE as e:
            return [(path, None, None, None, None, None, False, None, f"{type(e).__name__}: {e}")]
        return rows

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = (x for batch in batches for x in zip(batch["doc_path"], batch["archive"], batch["only"], strict=True))
        rows = (row for path, data, only in archives for row in of_archive(path, data, None if only is None else set(only)))
        for held in in_batches(rows, columns, columns.index("content")):
            yield held.astype({"entry_idx": "Int32", "size": "Int64"})

    return archives.select("doc_path", "archive", paths.alias("only")).mapInPandas(entries, ENTRY_SCHEMA)


def entries_from_list(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The listed entries (doc_path, path_in_zip) with their content; only they are inflated."""
    listed = wanted.groupBy("doc_path").agg(F.collect_set("path_in_zip").alias("_wanted"))
    return list_entries(archives.join(listed, "doc_path"), wanted="_wanted")


#: What stands between the pieces of a document's text, by the event and element that part them. Of equal neighbours in a run of
#: separators a line break wins over a cell bar, and neither opens a text.
LINE, BAR = "\x1e", "\x1f"
STARTS = {"p": LINE, "tr": LINE, "tc": BAR, "br": "\n", "cr": "\n", "tab": "\t"}
ENDS = {"p": LINE, "tr": LINE}


def document_text(xml: bytes) -> str:
    """Text of a document part: paragraphs and rows on lines of their own, cells parted by " | ", breaks and tabs kept, lines trimmed,
    empty lines dropped. Nothing but the text is held, so a part of any length is read in little memory."""
    pieces: list[str] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def hear(data: str) -> None:
        pieces.append(data.translate({0x1E: " ", 0x1F: " "}))

    def start(tag: str, _) -> None:
        name = tag.rpartition(" ")[2]
        if name in STARTS:
            pieces.append(STARTS[name])
        parser.CharacterDataHandler = hear if name == "t" else None

    def end(tag: str) -> None:
        name = tag.rpartition(" ")[2]
        if name in ENDS:
            pieces.append(ENDS[name])
        parser.CharacterDataHandler = None

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise ElementTree.ParseError(str(e)) from e
    text = re.sub(f"{LINE}+", "\n", "".join(pieces))
    text = re.sub(f"(^|[\n ]){BAR}+", r"\1", text)
    return "\n".join(x for x in map(str.strip, re.sub(f"{BAR}+", " | ", text).split("\n")) if x)


def extract_text(archives: DataFrame) -> DataFrame:
    """(doc_path, text, error) of each archive; an archive without a document part, or with a broken one, has an error."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["doc_path"], batch["archive"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows.append((path, document_text(z.read(DOCUMENT)), None))
                except KeyError:
                    rows.append((path, None, f"no {DOCUMENT}"))
                except (*UNREADABLE, ElementTree.ParseError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_path", "text", "error"])

    return archives.select("doc_path", "archive").mapInPandas(texts, "doc_path string, text string, error string")


def write_archive(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def rebuild_archive(data: bytes, swaps: dict[str, bytes]) -> tuple[bytes, int]:
    """(archive, entries replaced): every entry in its place, with its name, date, attributes, comment and method; entries of a listed
    name get its content, the others keep their own, those that share a name each theirs."""
    out, count = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        new.comment = old.comment
        for info in old.infolist():
            kept = zipfile.ZipInfo(info.filename, info.date_time)
            for field in ("compress_type", "comment", "external_attr", "internal_attr", "create_system", "extra"):
                setattr(kept, field, getattr(info, field))
            replaced = info.filename in swaps
            count += replaced
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", UserWarning)  # a name that comes twice is meant
                new.writestr(kept, swaps[info.filename] if replaced else old.read(info))
    return out.getvalue(), count


def replace_entries(data: bytes, swaps: dict[str, bytes]) -> tuple[bytes | None, int]:
    """rebuild_archive of an archive that has an entry of a listed name; others are only read (what can't be is an error), with None."""
    with zipfile.ZipFile(io.BytesIO(data)) as old:
        if not any(info.filename in swaps for info in old.infolist()):
            for info in old.infolist():
                old.read(info)
            return None, 0
    return rebuild_archive(data, swaps)


def rebuild_archives(archives: DataFrame, replacements: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_path, archive, replaced, error): each archive with the replacement contents (doc_path, path_in_zip, new_content) put in.

    Replacements are grouped by archive, which bounds a group by one archive's size; archives of which no entry is listed have a null
    archive, and so have those that can't be read, with an error. keep: both have the archive as it was instead.
    """
    grouped = replacements.groupBy("doc_path").agg(F.collect_list(F.struct("path_in_zip", "new_content")).alias("new"))

    def of_archive(path: str, data: bytes, new) -> tuple:
        swaps = {r["path_in_zip"]: bytes(r["new_content"]) for r in new} if new is not None else {}
        try:
            made, count = replace_entries(data, swaps)
            error = None
        except UNREADABLE as e:
            made, count, error = None, 0, f"{type(e).__name__}: {e}"
        return path, data if keep and made is None else made, count, error

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = (x for batch in batches for x in zip(batch["doc_path"], batch["archive"], batch["new"], strict=True))
        yield from in_batches((of_archive(*x) for x in archives), ["doc_path", "archive", "replaced", "error"], 1)

    return archives.join(grouped, "doc_path", "left").select("doc_path", "archive", "new").mapInPandas(rebuild, "doc_path string, archive binary, replaced int, error string")


def docx_of_lines(lines: list[str], more: Iterable[tuple[str, bytes]] = ()) -> bytes:
    """A minimal document of one paragraph a line, and `more` entries."""
    from xml.sax.saxutils import escape

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    clean = [re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", x) for x in lines]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in clean)
    return write_archive([("[Content_Types].xml", b"<Types/>"), (DOCUMENT, f"<w:document {space}><w:body>{body}</w:body></w:document>".encode()), *more])


def report_docx(rows: list[tuple[str, str, str]], header: tuple[str, str, str] = ("Data", "Campo", "Experiência")) -> bytes:
    """A document with one three-column table."""
    from xml.sax.saxutils import escape

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p></w:tc>'
    table = "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in [header, *rows])
    return write_archive([("[Content_Types].xml", b"<Types/>"), (DOCUMENT, f"<w:document {space}><w:body><w:tbl>{table}</w:tbl></w:body></w:document>".encode())])
