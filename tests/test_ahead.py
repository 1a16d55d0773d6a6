"""Searches over the next rows beside plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL, SHORT
from tapeloom.operators import labels, policy, weights
from tapeloom.operators.ahead import Extremes, first_ahead, key_starts

VALUE = st.one_of(st.just(math.nan), st.integers(-5, 5).map(float))


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUE, min_size=1, max_size=40), st.integers(1, 50), st.data())
def test_extremes_like_loops(values, longest, data):
    x, n = np.array(values), len(values)
    index = Extremes(x, x, longest)
    begin = np.arange(n)
    reach = np.array([data.draw(st.integers(0, min(longest, n - i))) for i in range(n)])
    up, down = (np.array([data.draw(VALUE) for _ in range(n)]) for _ in range(2))
    got = index.first(begin, reach, up, down, 1.0)
    for i in range(n):
        want = next((k + 1 for k in range(reach[i]) if x[i + k] - 1.0 >= up[i] or x[i + k] - 1.0 <= down[i]), 0)
        assert got[i] == want
    top, bottom = index.over(begin, reach)
    for i in range(n):
        seen = [v for v in values[i : i + reach[i]] if not math.isnan(v)]
        assert (math.isnan(top[i]) and math.isnan(bottom[i])) if not seen else (top[i], bottom[i]) == (max(seen), min(seen))


def test_key_starts():
    rows = pa.table({"a": pa.array([None, None, 1.0, math.nan, math.nan, 2.0]), "b": pa.array(["x", "y", "y", "y", "y", None])})
    assert key_starts(rows, ["a"]) == [0, 2, 3, 5, 6] and key_starts(rows, ["a", "b"]) == [0, 1, 2, 3, 5, 6]


def test_key_starts_of_structs():
    key = [None, {"s": 1, "w": "a"}, {"s": 1, "w": "a"}, {"s": 1, "w": None}, {"s": 1, "w": "b"}, {"s": None, "w": None}, None]
    assert key_starts(pa.table({"k": key}), ["k"]) == [0, 1, 3, 4, 5, 6, 7]


def prices(spark, n=260):
    """One symbol with most rows, some with few, one that is null; some prices are null."""
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(-2, 3, n)).astype(float)
    data = [("hot" if i < n - 40 else None if i < n - 20 else f"s{i % 7}", i, i, None if i % 23 == 5 else float(x[i]), [LONG, SHORT, NEUTRAL][i % 3], float(1 + i % 4)) for i in range(n)]
    return data, spark.createDataFrame(data, "symbol string, ts_event long, sequence long, price double, direction int, micro_atr double")


def later(data, row, h):
    own = [r for r in data if r[0] == row[0] and r[2] > row[2]]
    return own[:h]


@pytest.fixture(params=["whole", "blocks"])
def layout(request):
    if request.param == "blocks":
        request.getfixturevalue("small_blocks")


@pytest.mark.parametrize("h", [1, 7, 40])
def test_races_and_ends(spark, layout, h):
    data, rows = prices(spark)
    rows = rows.withColumns({"up": F.col("price") + F.col("micro_atr"), "down": F.col("price") - 3})
    out = first_ahead(rows, h, {"hit": ("up", "down")}, "price", ends=[1, h], path=True).collect()
    assert len(out) == len(data)
    by_id = {r["sequence"]: r for r in out}
    for row in data:
        path, got = later(data, row, h), by_id[row[2]]
        met = [k for k, r in enumerate(path) if None not in (r[3], row[3]) and (r[3] >= row[3] + row[5] or r[3] <= row[3] - 3)]
        assert (got["hit"]["_n"], got["hit"]["ts_event"]) == (met[0] + 1, path[met[0]][1]) if met else got["hit"] is None
        assert got["_end"]["ts_event"] == path[-1][1] and got["_end_1"]["ts_event"] == path[0][1] if path else got["_end"] is None
        seen = [r[3] for r in path if r[3] is not None]
        assert (got["_from"], got["_top"], got["_bottom"]) == (row[3], max(seen, default=None), min(seen, default=None))


@pytest.mark.parametrize("latency", [0, 2])
def test_trade_paths_like_a_loop(spark, layout, latency):
    data, rows = prices(spark)
    got = {r["sequence"]: r for r in policy.trade_paths(rows, 9, 1.0, latency=latency, cost_ticks=0.5).collect()}
    want = 0
    for row in data:
        ahead = later(data, row, 9 + latency)
        path = ahead[latency:]
        if row[4] == NEUTRAL or not path:
            assert row[2] not in got
            continue
        want += 1
        entry, sign = (ahead[latency - 1][3] if latency else row[3]), 1 if row[4] == LONG else -1
        step = max(1.0, 0.5 * row[5])
        tp, sl = max(step * 1.5, 1.0), max(step, 1.0)
        gains = [None if None in (r[3], entry) else (r[3] - entry) * sign for r in path]
        met = next((k for k, g in enumerate(gains) if g is not None and (g >= tp or g <= -sl)), None)
        out = got[row[2]]
        assert out["hold_steps"] == (len(path) if met is None else met + 1)
        assert out["exit_reason"] == ("horizon" if met is None else "tp" if gains[met] >= tp else "sl")
        made = gains[-1] if met is None else tp if gains[met] >= tp else -sl
        assert out["raw_pnl_ticks"] == made
        seen = [g for g in gains if g is not None]
        assert (out["mfe_ticks"], out["mae_ticks"]) == (max(seen, default=None), min(seen, default=None))
    assert want == len(got)


def test_grid_is_each_rule_alone(spark, layout):
    _, rows = prices(spark)
    rows = rows.where("price is not null")
    rule = labels.BarrierRule(tick=1.0)
    grid = labels.label_grid(rows, [3, 20], [1.0, 2.5], [1.0, 2.0], [0.5], rule, "price").collect()
    assert len(grid) == 8
    for cell in grid:
        alone = labels.BarrierRule(horizon=cell["horizon"], tick=1.0, tp=cell["tp_mult"], sl=cell["sl_mult"], neutral=cell["neutral_mult"])
        r = labels.triple_barrier(rows, alone, "price").agg(F.avg((F.col("bias_label") == LONG).cast("double")).alias("long"), F.avg("tradeability_label").alias("event"), F.avg("realized_return").alias("made"), F.count("*").alias("rows")).first()
        assert cell["rows"] == r["rows"] and math.isclose(cell["long_share"], r["long"], abs_tol=1e-12)
        assert math.isclose(cell["event_share"], r["event"], abs_tol=1e-12) and math.isclose(cell["realized_return_mean"], r["made"], abs_tol=1e-12)


def test_rows_carry_no_forward_arrays(spark):
    """What is shuffled for the labels of a grid, for scenarios and for trade paths has no array."""
    _, rows = prices(spark, 60)
    more = rows.withColumns({"effective_horizon": F.lit(5), "label_dynamic_threshold": F.lit(1.0), "bias_label": F.col("direction"), "signal_quality": F.lit(1)})
    for out in (
        labels.label_grid(rows.where("price is not null"), [3, 500], [1.0], [1.0], [0.5], labels.BarrierRule(tick=1.0), "price"),
        policy.trade_paths(rows, 500, 1.0),
        weights.monte_carlo(more, 500, 4, price="price"),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan
        assert out.count() > 0


def test_empty_tables(spark, layout):
    _, rows = prices(spark, 60)
    none = rows.where("sequence < 0")
    assert first_ahead(none.withColumns({"up": F.lit(1.0), "down": F.lit(0.0)}), 3, {"hit": ("up", "down")}, "price", path=True).count() == 0
    assert policy.trade_paths(none, 5, 1.0, latency=1).count() == 0
