"""Options, their checks and the names of what is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as tx

#: Aspect ratios that an image request may name.
ASPECTS = ("1:1", "2:3", "3:2", "3:4", "4:3", "4:5", "5:4", "9:16", "16:9", "21:9", "auto")

#: Endings of the files that are written.
COLOURED, REBUILT, CARDS, TWO_UP = "_colorida.", " colorida.docx", "_fichas_a4.", "_2up.pdf"


def check_aspect(aspect: str) -> str:
    if aspect not in ASPECTS:
        raise ValueError(f"aspect {aspect!r} is none of {', '.join(ASPECTS)}")
    return aspect


def check_grid(columns: int, rows: int) -> None:
    if not (1 <= columns <= 6 and 1 <= rows <= 6):
        raise ValueError("columns and rows go from 1 to 6")


def coloured_name(file: Column) -> Column:
    return F.concat(tx.stem(file), F.lit(COLOURED), tx.extension(file))


def rebuilt_name(file: Column) -> Column:
    return F.concat(tx.stem(file), F.lit(REBUILT))


def cards_name(file: Column, ext: str = "html") -> Column:
    return F.concat(tx.stem(file), F.lit(CARDS + ext))


def two_up_name(file: Column) -> Column:
    return F.concat(tx.strip_two_up(tx.stem(file)), F.lit(TWO_UP))
