"""Moments and extremes of the last rows beside plain loops."""

import math
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.operators import tickwin
from tapeloom.operators.sliding import Moments, sliding

VALUE = st.one_of(st.just(math.nan), st.floats(-100, 100))


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUE, min_size=1, max_size=40), st.integers(1, 50), st.data())
def test_moments_like_loops(values, longest, data):
    x, n = np.array(values), len(values)
    begin = np.arange(n)
    length = np.array([data.draw(st.integers(0, min(longest, n - i))) for i in range(n)])
    count, mean, squares = Moments(x, longest).over(begin, length)
    for i in range(n):
        seen = [v for v in values[i : i + length[i]] if not math.isnan(v)]
        assert count[i] == len(seen)
        if seen:
            assert math.isclose(mean[i], statistics.fmean(seen), rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(squares[i], len(seen) * statistics.pvariance(seen), rel_tol=1e-9, abs_tol=1e-7)


def test_no_digits_lost():
    x = np.full(4000, 1e6)
    assert (Moments(x, 300).over(np.arange(3000), np.full(3000, 300))[2] == 0).all()
    x = 1e6 + np.random.default_rng(1).normal(0, 0.01, 4000)
    got = np.sqrt(Moments(x, 300).over(np.arange(3000), np.full(3000, 300))[2] / 300)
    np.testing.assert_allclose(got, [np.std(x[i : i + 300]) for i in range(3000)], rtol=1e-6)


def ticks(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if i < 150 else None if i < 170 else f"s{i % 5}", i, i, None if i % 9 == 4 else float(rng.integers(0, 30)), float(i % 4)) for i in range(200)]
    return data, spark.createDataFrame(data, "symbol string, ts_event long, sequence long, price double, size double")


def past(data, row, n):
    return [r for r in data if r[0] == row[0] and r[2] <= row[2]][-n:]


def check_frames(spark):
    data, rows = ticks(spark)
    frames = {f"{kind}_{n}": (kind, "price", n) for kind in ("rows", "count", "sum", "mean", "std", "max", "min") for n in (1, 6, 33)}
    out = sliding(rows, {**frames, "other": ("sum", "size", 5)}).collect()
    assert len(out) == len(data)
    by_id = {r["sequence"]: r for r in out}
    for row in data:
        got = by_id[row[2]]
        assert got["other"] == sum(r[4] for r in past(data, row, 5))
        for n in (1, 6, 33):
            frame = past(data, row, n)
            seen = [r[3] for r in frame if r[3] is not None]
            assert (got[f"rows_{n}"], got[f"count_{n}"], got[f"max_{n}"], got[f"min_{n}"]) == (len(frame), len(seen), max(seen, default=None), min(seen, default=None))
            for kind, fn in (("sum", sum), ("mean", statistics.fmean), ("std", statistics.pstdev)):
                value = got[f"{kind}_{n}"]
                assert value is None if not seen else math.isclose(value, fn(seen), rel_tol=1e-9, abs_tol=1e-9)


def check_sweeps(spark):
    data, rows = ticks(spark)
    for got in tickwin.liquidity_sweep(rows, 20, 5).collect():
        seen = [r[3] for r in past(data, data[got["sequence"]], 20) if r[3] is not None]
        cut, price, want = int(len(seen) * 0.8), got["price"], 0.0
        if len(seen) >= 5 and price is not None:
            old, new = seen[:cut], seen[cut:]
            span = max(max(old) - min(old), 2 * statistics.pstdev(seen), 1e-8)
            up, down = (max(new) - max(old)) / span, (min(old) - min(new)) / span
            if up > 0.05 and price < max(old):
                want = min(5 * up, 1.0)
            elif down > 0.05 and price > min(old):
                want = -min(5 * down, 1.0)
        assert math.isclose(got["liquidity_sweep"], want, abs_tol=1e-9)


def test_frames(spark):
    check_frames(spark)


def test_frames_in_blocks(spark, small_blocks):
    check_frames(spark)


def test_sweeps(spark):
    check_sweeps(spark)


def test_sweeps_in_blocks(spark, small_blocks):
    check_sweeps(spark)


def test_empty_table(spark):
    _, rows = ticks(spark)
    assert sliding(rows.where("sequence < 0"), {"m": ("mean", "price", 4), "n": ("rows", "price", 4)}).count() == 0
