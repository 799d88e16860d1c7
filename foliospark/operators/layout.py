"""Pages, pairs and placements as Column expressions and window plans; lengths are millimetres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as tx

#: A4, margins and bands of a card sheet.
A4_W, A4_H = 210.0, 297.0
MARGIN, HEADER, LABEL, GAP = 10.0, 12.0, 9.0, 4.0


@dataclass(frozen=True)
class TwoUpOptions:
    margin: float = 5.0
    rotate_threshold: float = 15.0
    fit: str = "contain"
    auto_rotate: bool = True
    duplicate: bool = True
    cut_line: bool = True
    optimize: bool = True
    max_dpi: int = 300
    quality: int = 85

    def settled(self) -> TwoUpOptions:
        """Values out of range give way to the defaults."""
        d = TwoUpOptions()
        return TwoUpOptions(
            self.margin if self.margin > 0 else d.margin,
            self.rotate_threshold if self.rotate_threshold > 0 else d.rotate_threshold,
            self.fit or d.fit,
            self.auto_rotate,
            self.duplicate,
            self.cut_line,
            self.optimize,
            self.max_dpi if self.max_dpi > 0 else d.max_dpi,
            self.quality if 1 <= self.quality <= 100 else d.quality,
        )

    def slot(self) -> tuple[float, float]:
        """Width and height of one half of a landscape page."""
        return A4_H / 2 - 2 * self.margin, A4_W - 2 * self.margin


def settled_options(margin: Column, threshold: Column, fit_mode: Column, dpi: Column, quality: Column) -> Column:
    """struct of options, those out of range, empty or null giving way to the defaults."""
    d = TwoUpOptions()
    return F.struct(
        F.when(margin > 0, margin).otherwise(d.margin).alias("margin"),
        F.when(threshold > 0, threshold).otherwise(d.rotate_threshold).alias("rotate_threshold"),
        F.when(fit_mode != "", fit_mode).otherwise(d.fit).alias("fit"),
        F.when(dpi > 0, dpi).otherwise(d.max_dpi).alias("max_dpi"),
        F.when(quality.between(1, 100), quality).otherwise(d.quality).alias("quality"),
    )


#: Widths of Helvetica Bold's characters from space to tilde, in thousandths of its size.
HELVETICA_BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
#: Label sizes in points, and the width of other characters.
LABEL_MOST, LABEL_LEAST, LABEL_STEP, OTHER_WIDTH, MM_A_POINT = 12.0, 8.0, 0.5, 556, 25.4 / 72


def text_width(label: Column) -> Column:
    """Width in thousandths of the font's size; accented letters are as wide as plain ones."""
    widths = F.array(*map(F.lit, HELVETICA_BOLD))
    codes = F.transform(F.split(tx.strip_accents(label), ""), lambda c: F.ascii(c) - 31)
    return F.aggregate(F.filter(codes, lambda i: i > -31), F.lit(0), lambda n, i: n + F.when(i.between(1, len(HELVETICA_BOLD)), F.get(widths, i - 1)).otherwise(OTHER_WIDTH))


def label_size(label: Column, cell_w: Column) -> Column:
    """Largest size, in steps, at which the label leaves a millimetre at both sides of its cell; LABEL_LEAST if none does."""
    point = text_width(label) / F.lit(1000.0) * F.lit(MM_A_POINT)
    fitting = F.floor((cell_w - 2) / point / LABEL_STEP + F.lit(1e-9)) * LABEL_STEP
    return F.when(point > 0, F.greatest(F.lit(LABEL_LEAST), F.least(F.lit(LABEL_MOST), fitting))).otherwise(LABEL_MOST)


def number_rows(df: DataFrame, order: list, partition: list | None = None, out: str = "rn") -> DataFrame:
    """1-based numbers by one window: each group of the partition meets in one task. tables.number_groups has no such bound."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)))


def card_cells(df: DataFrame, rn: str = "rn", columns: int = 2, rows: int = 3, header: float = HEADER) -> DataFrame:
    """Page, local place, column, row, x, y and cell size of numbered cards."""
    columns, rows = columns if columns > 0 else 2, rows if rows > 0 else 3
    size = columns * rows
    width = (A4_W - 2 * MARGIN - (columns - 1) * GAP) / columns
    height = (A4_H - 2 * MARGIN - header - (rows - 1) * GAP) / rows
    local = (F.col(rn) - 1) % size
    df = df.withColumn("page", F.floor((F.col(rn) - 1) / size).cast("int")).withColumn("local", local.cast("int"))
    df = df.withColumn("col", (F.col("local") % columns).cast("int")).withColumn("row", F.floor(F.col("local") / columns).cast("int"))
    return df.withColumns({
        "x": F.lit(MARGIN) + F.col("col") * F.lit(width + GAP),
        "y": F.lit(MARGIN + header) + F.col("row") * F.lit(height + GAP),
        "cell_w": F.lit(width),
        "cell_h": F.lit(height),
    })


def card_pages(cells: DataFrame, keys: list[str], partition: list[str] | None = None) -> DataFrame:
    """One row for each page with its cards in order."""
    return cells.groupBy(*(partition or []), "page").agg(F.sort_array(F.collect_list(F.struct("local", *keys))).alias("cards"))


def fit_contain(w: Column, h: Column, max_w, max_h) -> tuple[Column, Column]:
    scale = F.least(F.lit(max_w) / w, F.lit(max_h) / h)
    return w * scale, h * scale


def fit(w: Column, h: Column, max_w: float, max_h: float, mode: str = "contain") -> tuple[Column, Column]:
    """Cover if mode says so in any case, else contain; nothing for images without area."""
    a, b = F.lit(max_w) / w, F.lit(max_h) / h
    scale = F.greatest(a, b) if mode.lower() == "cover" else F.least(a, b)
    some = (w > 0) & (h > 0)
    return F.when(some, w * scale).otherwise(F.lit(0.0)), F.when(some, h * scale).otherwise(F.lit(0.0))


def place_in_slot(df: DataFrame, w: str, h: str, options: TwoUpOptions | None = None) -> DataFrame:
    """rotated, draw_w and draw_h: rotated iff that is allowed and gains rotate_threshold percent of area or more."""
    o = (options or TwoUpOptions()).settled()
    slot_w, slot_h = o.slot()
    pw, ph = fit(F.col(w), F.col(h), slot_w, slot_h, o.fit)
    rw, rh = fit(F.col(h), F.col(w), slot_w, slot_h, o.fit)
    area, turned = pw * ph, rw * rh
    gain = F.when(area > 0, (turned - area) / area * 100)
    rotated = F.coalesce(F.lit(o.auto_rotate) & (gain >= o.rotate_threshold), F.lit(False))
    return df.withColumns({"rotated": rotated, "draw_w": F.when(rotated, rw).otherwise(pw), "draw_h": F.when(rotated, rh).otherwise(ph)})


def pair_two_up(df: DataFrame, item: str, rn: str = "rn", duplicate: bool = True, partition: list[str] | None = None, none="") -> DataFrame:
    """Pairs (1, 2), (3, 4), ...; an odd last item stands twice, or alone with `none` on the right side."""
    side = (F.col(rn) - 1) % 2
    pairs = df.groupBy(*(partition or []), F.floor((F.col(rn) - 1) / 2).cast("int").alias("pair")).agg(F.max(F.when(side == 0, F.col(item))).alias("left"), F.max(F.when(side == 1, F.col(item))).alias("right"))
    return pairs.withColumn("right", F.coalesce("right", F.col("left") if duplicate else F.lit(none)))


def capped_dimensions(w: Column, h: Column, slot_w: float, slot_h: float, dpi: int = 300) -> tuple[Column, Column]:
    """Pixels after the resolution is capped for a slot: uniform scale, truncated, one pixel at least; smaller images stay."""
    most_w, most_h = int(slot_w / 25.4 * dpi), int(slot_h / 25.4 * dpi)
    scale = F.least(F.lit(float(most_w)) / w, F.lit(float(most_h)) / h)
    over = (w > most_w) | (h > most_h)
    return tuple(F.when(over, F.greatest(F.lit(1), (x * scale).cast("int"))).otherwise(x.cast("int")) for x in (w, h))


def dispatch_policy(n: Column, user: Column) -> Column:
    """struct(workers, delay_ms) for n model calls; a user's number of workers wins."""
    workers = F.when(user > 0, user).when(n <= 3, n).when(n <= 10, F.lit(4)).otherwise(F.lit(5))
    delay = F.when(user > 0, 100).when(n <= 3, 0).when(n <= 10, 150).otherwise(300)
    return F.struct(workers.cast("int").alias("workers"), delay.cast("int").alias("delay_ms"))
