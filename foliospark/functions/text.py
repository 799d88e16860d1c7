"""String, date and number functions as Column expressions; none runs Python on the executors.

Missing values: a null input gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What folder names begin with and their length, and names that stand for empty ones.
FOLDER_PREFIX, FOLDER_LENGTH, NO_FOLDER, NO_ITEM = "imagens ", 45, "doc", "item"

#: White space that a trim takes: all of it, not spaces alone.
_EDGE = " \t\n\x0b\f\r"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGE))


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into a plain letter and marks, and those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x250)]
    pairs += [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0x1E00, 0x1F00)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def strip_accents(c: Column) -> Column:
    """Letters without their marks, composed or not; letters that don't decompose (ß, ø, º) stay. ASCII texts are passed on as they are."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}", "")).otherwise(c)


def basename(c: Column) -> Column:
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def extension(c: Column) -> Column:
    """Lower-case extension without its dot; empty if none."""
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def folder_name(c: Column, prefix: str = FOLDER_PREFIX, length: int = FOLDER_LENGTH) -> Column:
    plain = F.regexp_replace(F.lower(strip_accents(stem(c))), "[^a-z0-9]+", " ")
    cut = F.trim(F.substring(F.trim(plain), 1, length))
    return F.concat(F.lit(prefix), F.when(cut == "", NO_FOLDER).otherwise(cut))


def slug(number: Column, name: Column) -> Column:
    """Two-digit number (longer ones whole), underscore, name in lower case with letters, digits and underscores alone."""
    plain = F.replace(F.lower(trim(name)), F.lit(" "), F.lit("_"))
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    bare = F.when(ascii_only, F.regexp_replace(plain, "[^a-z0-9_]+", "")).otherwise(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", ""))
    return F.format_string("%02d_%s", number, F.when(bare == "", NO_ITEM).otherwise(bare))


def theme_slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def title_case(c: Column) -> Column:
    """First letter after any separator in upper case, the rest as it is; ß and the like, whose upper case is longer, stay."""
    parts = F.regexp_extract_all(c, F.lit(r"((?:[A-Za-z0-9_]|[^\x00-\x7F\s])+|(?:[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|\s)+)"), 1)

    def up(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        upper = F.upper(first)
        return F.concat(F.when(F.length(upper) == 1, upper).otherwise(first), F.substring(w, F.lit(2), F.length(w)))

    return F.array_join(F.transform(parts, up), "")


def card_label(c: Column) -> Column:
    bare = F.regexp_replace(stem(c), r"^\d+[_\s-]+", "")
    return title_case(trim(F.translate(bare, "_-", "  ")))


def upper_label(c: Column) -> Column:
    return F.upper(c)


def strip_two_up(c: Column) -> Column:
    return trim(F.regexp_replace(trim(c), r"(?i)(\s*_2up)+$", ""))


def path_key(c: Column) -> Column:
    """Key under which names that differ in accents, dashes, case and spacing meet."""
    plain = F.translate(c, "–—ºª", "--oa")
    return F.trim(F.regexp_replace(F.lower(strip_accents(plain)), r"\s+", " "))


def parse_size(c: Column) -> Column:
    """Bytes of "20KB", "1MB", "500B", "2K", "100"; 0 for empty; null for anything else."""
    text = F.upper(trim(c))
    number, unit = F.regexp_extract(text, r"^([+-]?\d+)\s*(KB|MB|B|K)?$", 1), F.regexp_extract(text, r"^([+-]?\d+)\s*(KB|MB|B|K)?$", 2)
    factor = F.when(unit.isin("KB", "K"), 1024).when(unit == "MB", 1048576).otherwise(1)
    return F.when(text == "", F.lit(0).cast("long")).when(number != "", number.try_cast("long") * factor)


def obfuscate(c: Column) -> Column:
    return F.when(F.octet_length(c) <= 8, "****").otherwise(F.concat(F.substring(c, 1, 6), F.lit("..."), F.substring(c, -4, 4)))


def clean_lines(c: Column) -> Column:
    """Lines trimmed, empty ones dropped, joined again."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), "\n")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def truncate_message(c: Column, length: int = 200) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def fill_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{{." + name + "}}"), value)
    return template


def format_tenths(c: Column) -> Column:
    """One decimal, ties to the even digit."""
    return F.format_string("%.1f", F.bround(c, 1))


def format_whole(c: Column) -> Column:
    return F.format_string("%.0f", F.bround(c, 0))


def split_items(c: Column) -> Column:
    """Comma-separated items, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), trim), lambda x: x != "")


def resilient_date(c: Column, year: int = 2026) -> Column:
    """Date of "dd/MM/yy", "dd/MM/yyyy" or "dd/MM" (in `year`; 29/02 of a common year is 1 March); null if none of them.

    A placeholder "/YY" or "/yy" stands for the year. Two-digit years from 69 on are of the last century.
    """
    text = F.regexp_replace(trim(c), "/(YY|yy)$", f"/{year % 100:02d}")
    day, month = F.regexp_extract(text, r"^(\d{2})/(\d{2})", 1), F.regexp_extract(text, r"^(\d{2})/(\d{2})", 2)
    tail = F.regexp_extract(text, r"^\d{2}/\d{2}/(\d{4}|\d{2})$", 1)
    century = F.when(tail.try_cast("int") >= 69, F.concat(F.lit("19"), tail)).otherwise(F.concat(F.lit("20"), tail))
    full = F.when(F.length(tail) == 4, tail).when(F.length(tail) == 2, century)
    dated = F.try_to_date(F.concat_ws("-", full, month, day), "yyyy-MM-dd")
    bare = F.regexp_replace(text, r"^(\d{2})/(\d{2})$", "$2-$1")
    short = F.when(bare == "02-29", F.lit(f"{year}-03-01" if year % 4 else f"{year}-02-29")).otherwise(F.concat(F.lit(f"{year}-"), bare))
    return F.when(tail != "", dated).when(text.rlike(r"^\d{2}/\d{2}$"), F.try_to_date(short, "yyyy-MM-dd"))


def saturation(*channels: Column) -> Column:
    high, low = F.greatest(*channels), F.least(*channels)
    return F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high)


def clamp(c: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def natural_key(c: Column) -> Column:
    """Sort key by which "img2" comes before "img10": runs of digits by value, other runs without case; the raw name breaks ties.

    A run of digits becomes its length without leading zeros, in ten digits, and then the digits, so that runs of any length compare by
    value.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)

    def by_value(digits: Column) -> Column:
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.struct(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), by_value(F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(F.lower(r))).alias("runs"), c.alias("raw"))


def first_filled(*texts: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.when(trim(t) != "", t) for t in texts])


def day_stamp(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy")


def second_stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")
