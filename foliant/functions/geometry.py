"""Page geometry and paper formats: units, orientation, format matching, crops, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Paper formats with width and height in points, in their declared order, and in mm where those are stated.
PAPER_FORMATS = [
    ("A0", 2383.94, 3370.39), ("A1", 1683.78, 2383.94), ("A2", 1190.55, 1683.78), ("A3", 841.89, 1190.55), ("A4", 595.28, 841.89),
    ("A5", 419.53, 595.28), ("A6", 297.64, 419.53), ("A7", 209.76, 297.64), ("A8", 147.40, 209.76),
    ("B0", 2834.65, 4008.19), ("B1", 2004.09, 2834.65), ("B2", 1417.32, 2004.09), ("B3", 1000.63, 1417.32), ("B4", 708.66, 1000.63),
    ("B5", 498.90, 708.66), ("B6", 354.33, 498.90), ("C4", 649.13, 918.43), ("C5", 459.21, 649.13), ("C6", 323.15, 459.21),
    ("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0), ("Tabloid", 792.0, 1224.0), ("Ledger", 1224.0, 792.0), ("Executive", 522.0, 756.0),
    ("JIS-B4", 728.50, 1031.81), ("JIS-B5", 515.91, 728.50),
]
# Formats that are tried first.
COMMON_FORMATS = ["A4", "Letter", "A3", "Legal", "A5", "Tabloid", "Ledger"]
TOLERANCE, POINTS_PER_INCH, MM_PER_INCH = 5.0, 72.0, 25.4
DETECTION_ORDER = COMMON_FORMATS + [n for n, _, _ in PAPER_FORMATS if n not in COMMON_FORMATS]
#: Other spellings, without separators and in upper case.
ALIASES = {n.replace("-", "").upper(): n for n, _, _ in PAPER_FORMATS} | {"JB4": "JIS-B4", "JB5": "JIS-B5"}


def paper_formats(spark: SparkSession) -> DataFrame:
    """The 26 formats: name, width_pt, height_pt, declared, detect_ord."""
    rows = [(n, w, h, k, DETECTION_ORDER.index(n)) for k, (n, w, h) in enumerate(PAPER_FORMATS)]
    return spark.createDataFrame(rows, "name string, format_width double, format_height double, declared int, detect_ord int")


def to_mm(pt: Column) -> Column:
    return pt * MM_PER_INCH / POINTS_PER_INCH


def to_inches(pt: Column) -> Column:
    return pt / POINTS_PER_INCH


def from_mm(mm: Column) -> Column:
    return mm * POINTS_PER_INCH / MM_PER_INCH


def from_inches(inches: Column) -> Column:
    return inches * POINTS_PER_INCH


def parse_page_size(text: Column) -> Column:
    """``W x H pts`` as (width_pt, height_pt); null where there is no match."""
    pattern = r"(?i)([0-9.]+)\s*x\s*([0-9.]+)\s*pts"
    size = F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("width_pt"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("height_pt"))
    return F.when(text.rlike(pattern), size)


def page_size_lines(output: Column) -> Column:
    """``Page N size: W x H pts`` lines as an array of (page_number, width_pt, height_pt); of equal numbers the last counts."""
    pattern = r"(?i)^Page\s+(\d+)\s+size:\s*([0-9.]+)\s*x\s*([0-9.]+)\s*pts"
    lines = F.filter(F.split(output, "\n", -1), lambda x: x.rlike(pattern))
    kinds = (("page_number", "int"), ("width_pt", "double"), ("height_pt", "double"))
    return F.transform(lines, lambda x: F.struct(*[F.regexp_extract(x, pattern, k).try_cast(t).alias(n) for k, (n, t) in enumerate(kinds, 1)]))


def effective_size(text: Column, rotation: Column) -> Column:
    """Parsed size with the sides swapped at a rotation by 90 or 270 degrees."""
    pattern = r"(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)"
    w, h = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    turned = F.coalesce(rotation, F.lit(0)).isin(90, 270)
    return F.when(text.rlike(pattern), F.struct(F.when(turned, h).otherwise(w).alias("width_pt"), F.when(turned, w).otherwise(h).alias("height_pt")))


def is_landscape(w: Column, h: Column) -> Column:
    return w > h


def is_portrait(w: Column, h: Column) -> Column:
    return h > w


def is_square(w: Column, h: Column) -> Column:
    return F.abs(w - h) <= 1.0


def area(w: Column, h: Column) -> Column:
    return w * h


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(0.0)


def in_unit(w: Column, h: Column, unit: str = "pt") -> Column:
    to = {"mm": to_mm, "in": to_inches}.get(unit, lambda x: x)
    return F.struct(to(w).alias("width"), to(h).alias("height"), F.lit(unit if unit in ("mm", "in") else "pt").alias("unit"))


def matches(w: Column, h: Column, fw: Column, fh: Column, tolerance: float = TOLERANCE, ignore_orientation: bool = True) -> Column:
    straight = (F.abs(w - fw) <= tolerance) & (F.abs(h - fh) <= tolerance)
    turned = (F.abs(w - fh) <= tolerance) & (F.abs(h - fw) <= tolerance)
    return straight | turned if ignore_orientation else straight


def matching_formats(sizes: DataFrame, w: str = "width_pt", h: str = "height_pt", tolerance: float = TOLERANCE) -> DataFrame:
    """Sizes with each format that they match; the other side has 26 rows, whatever the data."""
    formats = F.broadcast(paper_formats(sizes.sparkSession))
    return sizes.join(formats, matches(F.col(w), F.col(h), F.col("format_width"), F.col("format_height"), tolerance))


def detect_format(w: Column, h: Column, tolerance: float = TOLERANCE) -> Column:
    """The first format that matches, common ones first, as one expression: no join, no shuffle."""
    return F.coalesce(*[F.when(matches(w, h, F.lit(fw), F.lit(fh), tolerance), n) for n, fw, fh in sorted(PAPER_FORMATS, key=lambda f: DETECTION_ORDER.index(f[0]))])


def format_of_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(table, F.upper(F.translate(name, "-_ ", "")))


def format_description(name: Column, w: Column, h: Column) -> Column:
    return F.format_string("%s (%.0f × %.0f mm)", name, F.round(to_mm(w)), F.round(to_mm(h)))


def size_description(w: Column, h: Column, tolerance: float = TOLERANCE) -> Column:
    """Format or Custom, orientation (a square is portrait), and the size in mm; null sizes are unknown."""
    way = F.when(is_landscape(w, h), "Landscape").otherwise("Portrait")
    named = F.coalesce(detect_format(w, h, tolerance), F.lit("Custom"))
    text = F.format_string("%s %s (%.1f × %.1f mm)", named, way, F.round(to_mm(w), 1), F.round(to_mm(h), 1))
    return F.when(w.isNull() | h.isNull(), "Unbekannt").otherwise(text)


def start_psm(w: Column, h: Column, default: int = 3) -> Column:
    """Segmentation mode to start with: the default for A4 and unknown formats' absence of a size, else 12."""
    return F.when(w.isNull() | (detect_format(w, h) == "A4"), default).otherwise(12)


def uniform_sizes(pages: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, uniform): whether all pages are within tolerance of the first."""
    first = pages.groupBy(key).agg(F.min(F.struct("page_number", "width_pt", "height_pt")).alias("first"), F.min("width_pt").alias("w0"), F.max("width_pt").alias("w1"), F.min("height_pt").alias("h0"), F.max("height_pt").alias("h1"))
    far = [F.abs(F.col(c) - F.col(f"first.{f}")) <= tolerance for c, f in (("w0", "width_pt"), ("w1", "width_pt"), ("h0", "height_pt"), ("h1", "height_pt"))]
    return first.select(key, (far[0] & far[1] & far[2] & far[3]).alias("uniform"))


def margins(values: Column) -> Column:
    """CSS shorthand of 1 to 4 values as [top, right, bottom, left]; any other number is no margin."""
    at = [F.try_element_at(values, F.lit(k)) for k in range(1, 5)]
    n = F.size(values)
    zero = F.lit(0.0)
    return (
        F.when(n == 1, F.array(at[0], at[0], at[0], at[0]))
        .when(n == 2, F.array(at[0], at[1], at[0], at[1]))
        .when(n == 3, F.array(at[0], at[1], at[2], at[1]))
        .when(n == 4, F.array(*at))
        .otherwise(F.array(zero, zero, zero, zero))
    )


def crop_box(w: Column, h: Column, percent: Column, given: Column, upper: bool) -> Column:
    """(x, y, width, height) of the upper or lower share of a page, less margins."""
    m = margins(given)
    top, right, bottom, left = (m[k] for k in range(4))
    high = h * (percent / 100)
    y = (h - high if upper else F.lit(0.0)) + bottom
    return F.struct(left.alias("x"), y.alias("y"), (w - left - right).alias("width"), (high - top - bottom).alias("height"))


def fit(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """How a page comes to lie in a target: turned if the orientations differ, scaled, centred unless both offsets are under a point."""
    turn = (w > h) != (to_w > to_h)
    sw, sh = F.when(turn, h).otherwise(w), F.when(turn, w).otherwise(h)
    scale = F.least(to_w / sw, to_h / sh)
    x, y = (to_w - sw * scale) / 2, (to_h - sh * scale) / 2
    return F.struct(turn.alias("rotated"), scale.alias("scale"), x.alias("offset_x"), y.alias("offset_y"), (~((x < 1.0) & (y < 1.0))).alias("centred"))


def valid_rotation(angle: Column) -> Column:
    return F.coalesce(angle.isin(90, 180, 270), F.lit(False))
