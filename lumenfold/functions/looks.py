"""Colours, css values and boxes, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.keys import half_up

#: Fixed value: the form of a css colour that is read.
RGB = r"(?i)^rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:\s*[,/]\s*([\d.]+%?))?\s*\)$"


def parse_rgb(value: Column) -> Column:
    """Struct r, g, b, a; null for anything else."""
    v = F.trim(value)
    part = lambda i: half_up(F.regexp_extract(v, RGB, i).cast("double")).cast("int")
    raw = F.regexp_extract(v, RGB, 4)
    alpha = F.when(raw == "", 1.0).when(raw.endswith("%"), F.regexp_replace(raw, "%", "").try_cast("double") / 100).otherwise(raw.try_cast("double"))
    alpha = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)), 4)
    return F.when(v.rlike(RGB), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b"), alpha.alias("a")))


def hex8(color: Column) -> Column:
    """#rrggbbaa of a struct r, g, b, a."""
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(color["r"]), two(color["g"]), two(color["b"]), two(half_up(color["a"] * 255)))


def _channel(color: Column, at: int) -> Column:
    return F.conv(F.substring(F.regexp_replace(color, "#", ""), at, 2), 16, 10).cast("double") / 255


def luminance(color: Column) -> Column:
    """Of #rrggbb or #rrggbbaa; 0 for less."""
    return F.when(F.length(F.regexp_replace(color, "#", "")) >= 6, 0.2126 * _channel(color, 1) + 0.7152 * _channel(color, 3) + 0.0722 * _channel(color, 5)).otherwise(0.0)


def alpha_of(color: Column) -> Column:
    """1 where there is none."""
    return F.when(F.length(F.regexp_replace(color, "#", "")) == 8, _channel(color, 7)).otherwise(1.0)


def rgb_of(color: Column) -> Column:
    """#rrggbb in lower case."""
    raw = F.regexp_replace(color, "#", "")
    return F.lower(F.when(F.length(raw) >= 6, F.concat(F.lit("#"), F.substring(raw, 1, 6))).otherwise(color))


def pixels(value: Column) -> Column:
    """Number of a value in px, else null."""
    return F.regexp_extract(F.trim(value), r"(?i)^(-?[\d.]+)px$", 1).try_cast("double")


def families(value: Column) -> Column:
    """Font families without quotes."""
    return F.filter(F.transform(F.split(value, ","), lambda p: F.regexp_replace(F.trim(p), "^[\"']|[\"']$", "")), lambda p: p != "")


def track_count(value: Column) -> Column:
    """Tracks of a grid template: what white space outside of parentheses parts; none and null have none.

    What nested parentheses hold counts as one, at any depth.
    """
    text = F.trim(value)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("inside"))

    def step(state: Column, ch: Column) -> Column:
        depth = F.when(ch == "(", state["depth"] + 1).when(ch == ")", F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"])
        ends = ch.rlike(r"\s") & (state["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(ends & state["inside"], state["n"] + 1).otherwise(state["n"]).alias("n"), (~ends).alias("inside"))

    count = F.aggregate(F.split(text, ""), start, step, lambda s: s["n"] + F.when(s["inside"], 1).otherwise(0))
    return F.when(value.isNull() | text.isin("", "none"), 0).otherwise(count)


def box(x, y, width, height) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip(("x", "y", "width", "height"), (x, y, width, height), strict=True)])


def union_box(boxes: Column) -> Column:
    """The box around an array of boxes; null for none."""
    least = lambda f: F.array_min(F.transform(boxes, f))
    most = lambda f: F.array_max(F.transform(boxes, f))
    x, y = least(lambda b: b["x"]), least(lambda b: b["y"])
    return F.when(F.size(boxes) > 0, box(x, y, F.greatest(F.lit(0.0), most(lambda b: b["x"] + b["width"]) - x), F.greatest(F.lit(0.0), most(lambda b: b["y"] + b["height"]) - y)))


def pad_box(b: Column, pad: float, width: Column | None = None, height: Column | None = None) -> Column:
    """`pad` on all sides, within the document where its size is given and not 0; one pixel at least."""
    x, y = F.greatest(F.lit(0.0), b["x"] - pad), F.greatest(F.lit(0.0), b["y"] - pad)
    right, bottom = b["x"] + b["width"] + pad, b["y"] + b["height"] + pad
    inside = lambda edge, most: edge if most is None else F.when(most > 0, F.least(edge, most)).otherwise(edge)
    return box(x, y, F.greatest(F.lit(1.0), inside(right, width) - x), F.greatest(F.lit(1.0), inside(bottom, height) - y))


def overlap(a: Column, b: Column) -> Column:
    """Struct of the overlap's width and height, negative where there is a gap."""
    over = lambda at, size: F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at])
    return F.struct(over("x", "width").alias("width"), over("y", "height").alias("height"))


def to_image(b: Column, image: tuple[Column, Column], document: tuple[Column, Column]) -> Column:
    """Left, top, width, height in the pixels of an image of the document, within it."""
    scale = [F.when(d > 0, i / d).otherwise(1.0) for i, d in zip(image, document, strict=True)]
    start = lambda at, i: F.greatest(F.lit(0), F.least(F.floor(b[at] * scale[i]), F.greatest(F.lit(0), image[i] - 1))).cast("long")
    length = lambda size, at, i: F.greatest(F.lit(1), F.least(F.ceil(b[size] * scale[i]), image[i] - start(at, i))).cast("long")
    return F.struct(start("x", 0).alias("left"), start("y", 1).alias("top"), length("width", "x", 0).alias("width"), length("height", "y", 1).alias("height"))


def normalised(b: Column, width: Column, height: Column) -> Column:
    """The box in parts of the document, four decimals."""
    part = lambda v, of: F.round(v / F.greatest(of, F.lit(1.0)), 4)
    return box(part(b["x"], width), part(b["y"], height), part(b["width"], width), part(b["height"], height))


def first_of(*choices: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), choices)
