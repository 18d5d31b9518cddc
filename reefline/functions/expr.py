"""Column functions: time, text fields, geometry, boxes, scores. No Python runs on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """Microseconds, seconds, C time or time of day (then on 1900-01-01); null if none fits.

    The shape of the text chooses the parser: dates that begin with their digits are cast, which is the
    cheapest, and only texts that begin with a letter meet a pattern.
    """
    text = F.trim(c)
    sign = F.substring(text, 1, 1)
    ctime = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}\s+", ""), r"\s+", " ")
    clock = F.concat(F.lit("1900-01-01 "), F.lpad(text, 8, "0"))
    numbers = F.when(F.substring(text, 5, 1) == "-", F.when(F.length(text) >= 19, text)).when(F.length(F.split(text, ":")[0]) <= 2, F.when(F.length(F.regexp_replace(text, "[^:]", "")) == 2, clock))
    return F.when(sign.between("0", "9"), numbers.try_cast("timestamp_ntz")).otherwise(F.try_to_timestamp(ctime, F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz"))


def repair_year(time: Column, path: Column) -> Column:
    """A time of 1900 gets the date that its folder ``Month-dd-yyyy`` names."""
    day = F.try_to_timestamp(F.split(path, "/")[0], F.lit("MMMM-dd-yyyy")).cast("date").cast("timestamp_ntz")
    clock = time - F.date_trunc("day", time).cast("timestamp_ntz")
    return F.when((F.year(time) == 1900) & day.isNotNull(), day + clock).otherwise(time)


def log_field(line: Column, key: str) -> Column:
    """Value after ``key: ``, ``key:`` or ``key=`` up to ``,,``; null if the key is missing."""
    found = F.regexp_extract(line, rf"(?:^|[,\s:]){key}(?:: |:|=)(.*?)(?:,,|$)", 1)
    return F.when(found != "", found).when(line.rlike(rf"(?:^|[,\s:]){key}(?:: |:|=)"), F.lit(""))  # the second test is for empty values only


def truth(c: Column) -> Column:
    """Text booleans in any case."""
    return F.coalesce(F.upper(F.trim(c)) == "TRUE", F.lit(False))


def int_tuple(c: Column) -> Column:
    """``(1, 2, 3)`` or ``1296x972`` as an array of integers."""
    return F.transform(F.split(F.regexp_replace(c, r"[()\s]", ""), "[,x]"), lambda v: v.try_cast("int"))


def typed(c: Column) -> Column:
    """Kind of a value by the cascade date, tuple, boolean, integer, float, resolution, text."""
    t = F.trim(c)
    return (
        F.when(parse_time(t).isNotNull(), "date").when(t.rlike(r"^\(.*\)$"), "tuple").when(F.upper(t).isin("TRUE", "FALSE"), "bool")
        .when(t.try_cast("bigint").isNotNull(), "int").when(t.try_cast("double").isNotNull(), "float").when(t.rlike(r"^\d+x\d+$"), "resolution").otherwise("text")
    )


def map_of(entries: Column) -> Column:
    """A map of ``array<struct<key,value>>``; of several entries with one key the last holds, null keys none.

    The array is worked out once; entries are compared with each other only where a key is null or repeated.
    """

    def build(m: Column) -> Column:
        keys = F.transform(m, lambda e: e["key"])
        later = lambda e, i: F.exists(F.slice(m, i + 2, F.size(m)), lambda o: o["key"] == e["key"])
        single = (F.size(F.array_distinct(keys)) == F.size(m)) & ~F.exists(keys, lambda k: k.isNull())
        return F.map_from_entries(F.when(single, m).otherwise(F.filter(m, lambda e, i: e["key"].isNotNull() & ~later(e, i))))

    return F.get(F.transform(F.array(entries), build), F.lit(0))


def key_values(c: Column) -> Column:
    """``a=1:b=2,c=3`` as a map; separators count only before a letter; of a repeated key the last value holds."""
    parts = F.split(F.regexp_replace(c, r"[,:](?=[A-Za-z_])", "\u0001"), "\u0001")
    return map_of(F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("value"))))


def minutes_to(event: Column, t: Column) -> Column:
    """Minutes left, wrapping at one day."""
    return F.pmod(F.unix_micros(event.cast("timestamp")) - F.unix_micros(t.cast("timestamp")), F.lit(86_400_000_000)) / 60_000_000


def seconds_to(event: Column, t: Column) -> Column:
    return (F.unix_micros(event.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 1_000_000


def hour_bin(seconds: Column, hours: int = 2) -> Column:
    return (F.floor(seconds / (3600 * hours)) * hours).cast("int")


def in_polygon(px: Column, py: Column, vertices: list[tuple[float, float]], outline: bool = False) -> Column:
    """Even-odd rule over a fixed polygon; with ``outline`` points on an edge count as inside."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > py) != (F.lit(y2) > py)
            crossings = crossings + F.when(spans & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1), 1).otherwise(0)
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        on_edge = on_edge | (cross == 0) & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2))
    inside = crossings % 2 == 1
    return (inside | on_edge) if outline else (inside & ~on_edge)


def in_polygon_array(px: Column, py: Column, vertices: Column) -> Column:
    """The same for a polygon per row, ``array<struct<x,y>>``; strict interior."""
    n = F.size(vertices)

    def add(a: Column, i: Column) -> Column:
        p, q = F.get(vertices, i), F.get(vertices, (i + 1) % n)
        spans = (p["y"] > py) != (q["y"] > py)
        at = (q["x"] - p["x"]) * (py - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return a + F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 2 == 1


def project(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    """Perspective transform by a row-major 3x3 matrix, with x and y swapped on the way in and out."""
    w = m[6] * y + m[7] * x + m[8]
    return (m[3] * y + m[4] * x + m[5]) / w, (m[0] * y + m[1] * x + m[2]) / w


def approx_radius(x_span: Column, y_span: Column, m: list[float]) -> Column:
    det = float(np.linalg.det(np.array(m).reshape(3, 3)))
    return (x_span + y_span) * float(np.sqrt(abs(det))) / 2


def box_from_centre(xc: Column, yc: Column, w: Column, h: Column) -> list[Column]:
    return [(xc - w / 2).alias("x1"), (yc - h / 2).alias("y1"), (xc + w / 2).alias("x2"), (yc + h / 2).alias("y2")]


def box_shape(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Centre, area and aspect of a box."""
    w, h = x2 - x1, y2 - y1
    return [(x1 + w / 2).alias("u"), (y1 + h / 2).alias("v"), (w * h).alias("s"), F.try_divide(w, h).alias("r")]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes given by corners."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def round6(v: Column) -> Column:
    """The same as ``round(v, 6)``, by arithmetic unless that might be off: by decimals it takes longer than all else that is done to a row."""
    x = v * 1e6
    plain = (F.abs(v) < 1000) & (F.abs(x - F.floor(x) - 0.5) > 1e-6)
    return F.when(plain, F.floor(x + 0.5) / 1e6).otherwise(F.round(v, 6))


def crop_box(xc: Column, yc: Column, w: Column, h: Column, width: int = 1296, height: int = 972) -> list[Column]:
    d = F.floor(F.greatest(w.cast("int") + 1, h.cast("int") + 1) / 2).cast("int") + 10
    x, y = xc.cast("int"), yc.cast("int")
    return [
        F.greatest(F.lit(0), x - d).alias("left"), F.greatest(F.lit(0), y - d).alias("top"),
        F.least(F.lit(width), x + d).alias("right"), F.least(F.lit(height), y + d).alias("bottom"),
    ]


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def arg_max(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def category(bid: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.try_element_at(table, bid)


def unit_colour(v: Column, lo: float = -5.0, hi: float = 5.0) -> Column:
    return (F.greatest(F.lit(lo), F.least(F.lit(hi), v)) - lo) / (hi - lo)


def split_tag(key: Column, n: int) -> Column:
    """'val' for about one key in n, by a hash that other engines share."""
    return F.when(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)) == 0, "val").otherwise("train")


def savgol_coefficients(window: int, order: int) -> list[float]:
    """Weights of the least-squares polynomial's value in the middle of the window."""
    half = window // 2
    a = np.vander(np.arange(-half, half + 1, dtype=float) / half, order + 1, increasing=True)
    return np.linalg.pinv(a)[0].tolist()
