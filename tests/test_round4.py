"""Findings of the fourth round."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reefline.functions.expr import round6
from reefline.operators import tracks

BOX = "base_name string, frame int, box_id long, x1 double, y1 double, x2 double, y2 double"


def _boxes(n: int, seed: int, wide: float = 130.0) -> list[tuple]:
    """Boxes of two videos, corners on a coarse raster, so that sides touch and whole boxes repeat; a tenth of them tiny or wide."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w, h = r.randrange(-5, 10) * 10.0, r.randrange(0, 9) * 10.0, r.choice([10.0, 60.0, wide]), r.choice([10.0, 80.0, wide])
        if k % 10 == 0:
            w = r.choice([1e-9, 0.0, 900.0])
        rows.append((r.choice("vw"), r.randrange(3), r.randrange(n * 3 // 2), x, y, x + w, y + h))
    return rows


def _met(a: list[tuple], b: list[tuple] | None, least: float) -> list[tuple]:
    """All pairs, one by one, by the formula of the query's SQL."""
    found = []
    for p in a:
        for q in a if b is None else b:
            if None in p or None in q or p[:2] != q[:2] or b is None and not p[2] < q[2]:
                continue
            if any(map(math.isnan, p[3:] + q[3:])):
                found.append((*p[:3], q[2], "nan"))
                continue
            w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
            if w > 0 and h > 0:
                area = lambda c: (c[5] - c[3]) * (c[6] - c[4])
                if (v := w * h / (area(p) + area(q) - w * h)) > least:
                    found.append((*p[:3], q[2], v))
    return sorted(found, key=str)


def _rows(df) -> list[tuple]:
    return sorted(((*r[:4], "nan" if math.isnan(r[4]) else r[4]) for r in df.collect()), key=str)


@pytest.fixture
def conf(spark):
    held = {}

    def put(key: str, value: str) -> None:
        held.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for k, v in held.items():
        spark.conf.set(k, v)


def _shuffled(plan) -> int:
    """Rows that the exchanges of a plan have written."""
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_a_box_is_shuffled_once_without_copies(spark, conf):
    """However many cells a box covers; before, each cell had a copy."""
    conf("spark.sql.adaptive.enabled", "false")
    rows = [("v", f, f * 100 + k, k * 90.0, k * 70.0, k * 90.0 + 600, k * 70.0 + 500) for f in range(10) for k in range(20)]
    pairs = tracks.iou_pairs(spark.createDataFrame(rows, BOX), least=0.3)
    assert _rows(pairs) == _met(rows, None, 0.3)
    assert 0 < _shuffled(pairs._jdf.queryExecution().executedPlan()) <= len(rows)


@pytest.mark.parametrize("least", [0.0, 0.3, 0.95])
def test_pairs_equal_all_pairs(spark, conf, least, monkeypatch):
    """In batches and steps of a few rows, in one task or, as crowded frames, spread over many."""
    rows, other = _boxes(300, 1), [(v, f, f"n{k}", *c) for v, f, k, *c in _boxes(150, 2)]
    a, b = spark.createDataFrame(rows, BOX), spark.createDataFrame(other, BOX.replace("box_id long", "box_id string"))
    want, across = _met(rows, None, least), _met(rows, other, least)
    assert len(want) > 100 and len(across) > 100 or least > 0.9
    for batch, meet in (("10000", 1 << 18), ("3", 5)):
        conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        monkeypatch.setattr(tracks, "MEET", meet)
        assert _rows(tracks.iou_pairs(a, least=least)) == want
        assert _rows(tracks.iou_pairs(a, b, least)) == across
    assert _rows(tracks.iou_pairs(a, least=least, crowd=40)) == want
    assert _rows(tracks.iou_pairs(a, b, least, crowd=80)) == across


def test_boxes_without_numbers(spark, conf):
    """A null is no box; NaN meets all of its frame, as in SQL; corners may be infinite; nothing comes of an empty table."""
    inf, nan = math.inf, math.nan
    rows = [("v", 1, 1, 0.0, 0.0, 10.0, 10.0), ("v", 1, 2, 1.0, 1.0, 10.0, 10.0), ("v", 1, 3, 500.0, 0.0, 510.0, nan), ("v", 1, 4, nan, 0.0, 1.0, 1.0), ("v", 1, 5, 0.0, None, 10.0, 10.0)]
    rows += [("v", 1, None, 0.0, 0.0, 10.0, 10.0), (None, 1, 6, 0.0, 0.0, 10.0, 10.0), (None, 1, 7, 0.0, 0.0, 10.0, 10.0), ("v", None, 8, 0.0, 0.0, 10.0, 10.0), ("v", None, 9, 0.0, 0.0, 10.0, 10.0)]
    rows += [("w", 1, 1, 0.0, 0.0, inf, 10.0), ("w", 1, 2, 5.0, 0.0, inf, 10.0), ("w", 1, 3, 5.0, 0.0, 6.0, 10.0), ("w", 1, 4, -inf, 0.0, inf, 10.0)]
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    for crowd in (2, 50_000):
        got = _rows(tracks.iou_pairs(spark.createDataFrame(rows, BOX).where("base_name IS NULL OR base_name = 'v'"), least=0.3, crowd=crowd))
        assert got == _met([r for r in rows if r[0] == "v"], None, 0.3) and len(got) == 6
    wide = _rows(tracks.iou_pairs(spark.createDataFrame(rows, BOX).where("base_name = 'w'"), least=0.3))
    assert [r[2:] for r in wide] == [(1, 2, "nan"), (1, 4, "nan"), (2, 4, "nan")]
    assert _rows(tracks.iou_pairs(spark.createDataFrame([], BOX))) == []


def test_round6_is_round(spark):
    r = random.Random(3)
    values = [r.random() for _ in range(3000)] + [k / 1e6 + d for k in range(0, 1_000_000, 997) for d in (5e-7, 4.999999999e-7, 5.000000001e-7)] + [k * 1e-7 for k in range(-50, 50)]
    values += [-r.random() * 999 for _ in range(500)] + [0.0, -0.0, 1.0, 999.9999995, 1e3, 1e12, 123456.1234565, math.nan, None]
    x = spark.createDataFrame([(v,) for v in values], "v double").select(round6(F.col("v")).alias("a"), F.round("v", 6).alias("b"))
    assert x.where("NOT (a <=> b)").count() == 0 and x.count() == len(values)
