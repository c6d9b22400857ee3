"""Column functions: vectors, boxes, probabilities, colours, times, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once, however often the body names it (also inside its own lambdas)."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column) -> Column:
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cos01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2."""
    return (dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)) + 1) / 2


def softmax(arr: Column, scale: float = 1.0) -> Column:
    top = F.array_max(arr)
    e = F.transform(arr, lambda x: F.exp((x - top) * scale))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def softmax_t(arr: Column, t: float = 0.1) -> Column:
    return softmax(arr, 1 / t)


def _overlap(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou_xywh(a: Column, b: Column) -> Column:
    """Of structs (x, y, w, h); 0 where the union is empty."""
    inter = _overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * _overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def to_xyxy(box: Column) -> Column:
    return F.struct(box["x"].alias("x1"), box["y"].alias("y1"), (box["x"] + box["w"]).alias("x2"), (box["y"] + box["h"]).alias("y2"))


def iou_xyxy(a: Column, b: Column) -> Column:
    inter = _overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * _overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def noisy(arr: Column, how: str) -> Column:
    """An array of probabilities as one: product (and), noisy or, or mean."""
    if how in ("prod", "and"):
        return F.aggregate(arr, F.lit(1.0), lambda s, x: s * x)
    if how == "or":
        return 1 - F.aggregate(arr, F.lit(1.0), lambda s, x: s * (1 - x))
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)


def iso_time(sec: Column, loc: str = "en", pad: bool = True) -> Column:
    """hh:mm:ss.ms with milliseconds that aren't padded (and can be 1000), as the exports write them; "de" has a comma."""
    whole = F.floor(sec).cast("long")
    ms = F.rint((sec - whole) * 1000).cast("long").cast("string")
    parts = [F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60]
    text = [F.lpad(p.cast("string"), 2, "0") if pad else p.cast("string") for p in parts]
    if pad:  # hours over 99 keep their digits
        text[0] = F.when(parts[0] < 100, text[0]).otherwise(parts[0].cast("string"))
    return F.concat(F.concat_ws(":", *text), F.lit("," if loc == "de" else "."), ms)


def timecode(sec: Column, digits: int = 3) -> Column:
    """hh:mm:ss and the rest, rounded to so many digits (which can give one digit more, as in 00:00:00.1000)."""
    whole = F.floor(sec).cast("long")
    part = F.floor((sec - whole) * 10**digits + 0.5).cast("long").cast("string")
    hms = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60)
    return hms if not digits else F.concat(hms, F.lit("."), F.when(F.length(part) < digits, F.lpad(part, digits, "0")).otherwise(part))


def display_time(sec: Column) -> Column:
    """Hours, minutes and seconds in words; what is zero is left out, and a space stays behind hours and minutes."""
    whole = F.floor(sec).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60
    return F.concat(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("") for n, unit in ((h, " h "), (m, " min "), (s, " sec"))])


def _hex2(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), _hex2(r), _hex2(g), _hex2(b))


def prob_to_hex(p: Column, active=(159, 39, 31), inactive=(255, 255, 255)) -> Column:
    return rgb_to_hex(*[F.rint(p * a + (1 - p) * i) for a, i in zip(active, inactive, strict=True)])


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Fractions in, fractions out."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = i % 6
    pick = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


#: The sixteen basic web colours.
NAMED_COLORS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "silver": (192, 192, 192), "gray": (128, 128, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0), "green": (0, 128, 0), "purple": (128, 0, 128), "teal": (0, 128, 128), "navy": (0, 0, 128),
}


def closest_color(r: Column, g: Column, b: Column) -> Column:
    """The named colour whose channel sum is nearest (the absolute value of the signed sum of differences); ties by order."""
    far = [F.struct(F.abs(F.lit(sum(c)) - (r + g + b)).cast("double").alias("d"), F.lit(k).alias("k"), F.lit(n.capitalize()).alias("n")) for k, (n, c) in enumerate(NAMED_COLORS.items())]
    return F.array_min(F.array(*far))["n"]


def label_color(label: Column) -> Column:
    """A bright hex colour from a stable hash of the label."""
    digits = F.lpad((F.crc32(label) % 1_000_000).cast("string"), 6, "0")
    return rgb_to_hex(*[F.rint((F.substring(digits, k, 2).cast("double") / 200 + 0.5) * 255) for k in (1, 3, 5)])


def count_grey(n: Column) -> Column:
    return F.greatest(F.lit(0.0), (100 - n) / 100)


def _channels(hex_color: Column) -> list[Column]:
    return [F.conv(F.substring(hex_color, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def luminance(hex_color: Column) -> Column:
    """From 0 (black) to 1 (white)."""
    r, g, b = (c / 255 for c in _channels(hex_color))
    return F.sqrt(0.299 * r * r + 0.587 * g * g + 0.114 * b * b)


def blend(a: Column, b: Column) -> Column:
    """Half of each of two hex colours."""
    return rgb_to_hex(*[F.floor((x + y) / 2 + 0.5) for x, y in zip(_channels(a), _channels(b), strict=True)])


#: Fixed value: the end of the palette from white to red.
MAP_RED = (174, 19, 19)


def colormap_pos(y: Column, invert: bool = False) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    return 1 - s if invert else s


def linear_map(y: Column, lo: float, hi: float) -> Column:
    """White at ``lo`` and below, the palette's red at ``hi`` and above."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - lo) / (hi - lo)))
    return rgb_to_hex(*[F.floor(255 + (c - 255) * s + 0.5) for c in MAP_RED])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""
    def walk(schema: T.StructType, at: str, name: str):
        for f in schema.fields:
            here, called = f"{at}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, f"{here}.", f"{called}{sep}")
            else:
                yield F.col(here).alias(called)

    return df.select(*walk(df.schema, "", ""))


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns with dotted names as nested structs."""
    def build(names: list[tuple[list[str], str]]):
        order: dict[str, list] = {}
        for parts, full in names:
            order.setdefault(parts[0], []).append((parts[1:], full))
        for head, rest in order.items():
            yield (F.col(f"`{rest[0][1]}`") if not rest[0][0] else F.struct(*build(rest))).alias(head)

    return df.select(*build([(c.split(sep), c) for c in df.columns]))


def get_path(json: Column, path: str) -> Column:
    """A dotted path into JSON text; whole numbers index lists."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, f"${steps}")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


#: Shot sizes from near to far.
SHOT_SIZES = ("Extreme Close-Up", "Close-Up", "Medium Shot", "Full Shot", "Long Shot")


def shot_size_rank(label: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, s in enumerate(SHOT_SIZES) for x in (F.lit(s), F.lit(k))]), label)


def truncate_label(label: Column, most: int = 1000) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 4), F.lit(" ..."))).otherwise(label)


def clean_ocr_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<img>.*</img>", ""), "<watermark>.*</watermark>", "")


def map_label(label: Column, lut: dict[str, str], fallback: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for p in lut.items() for x in p]), label)
    return F.coalesce(found, label if fallback is None else fallback)
