"""Output canvas, letterbox and caption size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipquarry.functions.semantics import or_default, round_half_up

# Default canvas, canvas bounds, caption ratios, positions and fonts.
CANVAS_W, CANVAS_H = 1080, 1920
CANVAS_MIN, CANVAS_MAX_W, CANVAS_MAX_H = 128, 2160, 3840
CAPTION_SIZES = {"small": 0.014, "medium": 0.0175, "large": 0.022, "xlarge": 0.028}
DEFAULT_SIZE = "medium"
BOTTOM_MARGINS = {"bottom": 0.14, "lower": 0.26}
CAPTION_FONTS = ["strong", "clean", "typewriter", "serif"]
MIN_FONT_PX = 16
SAFE_WIDTH = 0.92
GLYPH_WIDTH = 0.62
CHUNK_BORDER, CUE_BORDER = 0.12, 0.14


def even(n: Column) -> Column:
    """Nearest even whole number, 2 at least."""
    return F.greatest(F.lit(2), round_half_up(n / 2) * 2).cast("bigint")


def stitch_canvas(width: Column, height: Column) -> tuple[Column, Column]:
    """The requested canvas when both sides are positive and in bounds, else the default."""
    w, h = even(width), even(height)
    fits = (
        (width > 0) & (height > 0) & w.between(CANVAS_MIN, CANVAS_MAX_W) & h.between(CANVAS_MIN, CANVAS_MAX_H)
    )
    usable = F.coalesce(fits, F.lit(False))
    return (
        F.when(usable, w).otherwise(F.lit(CANVAS_W)).cast("bigint"),
        F.when(usable, h).otherwise(F.lit(CANVAS_H)).cast("bigint"),
    )


def reel_canvas(width: Column, height: Column) -> tuple[Column, Column]:
    """Missing sides are defaulted one by one and nothing is bounded."""
    return even(or_default(width, CANVAS_W)), even(or_default(height, CANVAS_H))


def letterbox(width: Column, height: Column, canvas_w: Column, canvas_h: Column) -> dict[str, Column]:
    """Size of a clip fitted into a canvas, and its offset from the top left."""
    scale = F.least(canvas_w / width, canvas_h / height)
    fit_w, fit_h = round_half_up(width * scale), round_half_up(height * scale)
    return {
        "fit_w": fit_w,
        "fit_h": fit_h,
        "pad_x": F.floor((canvas_w - fit_w) / 2).cast("bigint"),
        "pad_y": F.floor((canvas_h - fit_h) / 2).cast("bigint"),
    }


def _lookup(values: dict[str, float], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, key)


def caption_ratio(size_name: Column) -> Column:
    named = _lookup(CAPTION_SIZES, F.lower(F.coalesce(size_name, F.lit(DEFAULT_SIZE))))
    return F.coalesce(named, F.lit(CAPTION_SIZES[DEFAULT_SIZE]))


def caption_position(position: Column) -> Column:
    known = F.lower(position)
    return F.when(known.isin("middle", "bottom"), known).otherwise(F.lit("lower"))


def caption_margin(position: Column, height: Column) -> Column:
    """Distance from the lower edge; null for centred captions."""
    return _lookup(BOTTOM_MARGINS, caption_position(position)) * height


def caption_font(name: Column) -> Column:
    known = F.lower(name)
    return F.when(known.isin(CAPTION_FONTS), known).otherwise(F.lit(CAPTION_FONTS[0]))


def caption_font_px(width: Column, height: Column, longest: Column, ratio: Column) -> Column:
    """Font size by frame height, shrunk where the longest text would leave the frame."""
    by_width = F.floor((width * F.lit(SAFE_WIDTH)) / (longest * F.lit(GLYPH_WIDTH)))
    return F.greatest(F.lit(MIN_FONT_PX), F.least(round_half_up(height * ratio), by_width)).cast("bigint")
