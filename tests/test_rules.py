"""State machines against plain loops, and batch against stream."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from tapeloom import plans
from tapeloom.functions import machines as Z


def feed(machine, columns):
    return Z.run(machine, list(machine.start), columns)[0]


def test_ewma_is_pandas():
    x = np.random.default_rng(0).normal(size=50)
    got = [r[0] for r in feed(Z.Ewma("x", 0.1), [x.tolist()])]
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=0.1, adjust=False).mean())


def test_page_hinkley_resets():
    out = feed(Z.PageHinkley(limit=1.0), [[0.0] * 20 + [1.0] * 20])
    alarms = [i for i, r in enumerate(out) if r[1]]
    assert alarms and alarms[0] >= 20
    assert out[alarms[0] + 1][0] <= 0.005


def test_one_at_a_time():
    out = feed(Z.OneAtATime(pause=1), [[0, 2, 5, 6, 20], [4, 9, 8, 7, 21]])
    assert [r[0] for r in out] == [True, False, True, False, True]


def test_loss_guard_opens_next_day():
    out = feed(Z.LossGuard(equity=100.0, max_loss=0.1, max_drawdown=0.9), [[1, 1, 2], [-20.0, 5.0, 5.0]])
    assert [r[0] for r in out] == [True, False, True]


def test_rate_gate_quantile():
    scores = sorted(np.random.default_rng(2).random(30).tolist())
    for q in (0.0, 0.3, 0.75, 1.0):
        assert Z.RateGate._quantile(scores, q) == pytest.approx(np.quantile(scores, q))


def signals(n, **over):
    base = dict(price=100.0, signal=1, confidence=0.9, trending=False, near_bottom=True, near_top=False, in_middle=False, range_place=0.1, volatility=1.0, reversal=0.0, reversal_direction=0, broke_out=False)
    rows = [{**base, **{k: v[i] if isinstance(v, list) else v for k, v in over.items()}} for i in range(n)]
    return [[r[c] for r in rows] for c in Z.RangeFilter.inputs]


def test_range_entry_needs_confirmations_then_locks():
    out = feed(Z.RangeFilter(needed=3), signals(6))
    assert [r[0] for r in out] == ["HOLD", "HOLD", "ENTER", "HOLD", "HOLD", "HOLD"]
    assert out[2][1] == 1


def test_range_closes_on_reversal_and_pauses():
    out = feed(Z.RangeFilter(needed=1, pause=3), signals(6, reversal=[0, 2.0, 0, 0, 0, 0]))
    assert [r[0] for r in out][:3] == ["ENTER", "CLOSE", "HOLD"]
    assert "ENTER" in [r[0] for r in out][3:]


def test_range_rejects_signals_against_the_place():
    out = feed(Z.RangeFilter(needed=1), signals(3, signal=-1))
    assert all(r[0] == "HOLD" for r in out)


def test_weak_signals_do_not_count():
    assert all(r[0] == "HOLD" for r in feed(Z.RangeFilter(needed=1), signals(4, confidence=0.2)))


def test_breakouts_move_an_unnamed_market():
    out = feed(Z.RangeFilter(needed=3), signals(6, trending=[None, None, None, None, None, False], broke_out=[False, False, True, True, False, False]))
    assert [r[3] for r in out] == ["RANGING", "RANGING", "TRENDING", "TRENDING", "TRENDING", "RANGING"]
    assert [r[2] for r in out][:3] == [1, 2, 1]  # the breakout empties the votes
    assert out[3][0] == "ENTER" and out[3][4] == "trend_confirmed"


def test_every_reason_occurs(spark, sf):
    found = {r[0] for r in plans.QUERIES["r9_market_state"](spark, sf).select("filter_reason").distinct().collect()}
    assert found >= {*Z.SITUATIONS, "range_confirmed", "trend_confirmed"} - {"range_accumulating", "trend_accumulating"}


@pytest.mark.parametrize("batch, stream", [("r9_market_state", "x9_streaming_market_state"), ("r5_page_hinkley", "x3_ordered_drift"), ("r10_event_score", "x2_streaming_event_gate"), ("r5_page_hinkley", "x3_streaming_drift")])
def test_stream_equals_batch(spark, sf, batch, stream):
    assert canonical(plans.QUERIES[batch](spark, sf)) == canonical(plans.QUERIES[stream](spark, sf))


def test_range_filter_stream_equals_batch(spark, sf):
    from tapeloom.operators import stateful as S
    from tapeloom.plans import stream_queries as Q
    from tapeloom.plans import views as V

    original, Q.events_stream = Q.events_stream, lambda s, d: V.events(s, d)
    drain, Q.S.drain = Q.S.drain, lambda df, name: df
    runner, Q.S.run_machine = Q.S.run_machine, lambda df, m, keep: S.fold(df, m).select(*keep, *m.outputs)
    try:
        batch = canonical(Q.streaming_range_filter(spark, sf))
    finally:
        Q.events_stream, Q.S.drain, Q.S.run_machine = original, drain, runner
    assert batch == canonical(plans.QUERIES["x9_streaming_range_filter"](spark, sf))


def test_feature_selection_against_pandas(spark, sf):
    from tapeloom.operators import evaluate as E
    from tapeloom.plans.eval_queries import feature_rows

    rows = feature_rows(spark, sf).withColumn("price_twin", F.col("price") * 2)
    names = ["price", "price_twin", "size", "prob_long"]
    pdf = rows.select(*names, "realized_return").toPandas().astype(float)
    m = pdf.corr(method="spearman").abs()
    order, kept, out = sorted(names, key=lambda f: m.loc[f, "realized_return"], reverse=True), [], set()
    for f in order:
        if f not in out:
            kept.append(f)
            out |= {g for g in names if g != f and m.loc[f, g] > 0.85}
    assert E.redundancy_filter(rows, names, "realized_return") == kept
    assert len(kept) == 3
    picked = E.mrmr(rows, names, "realized_return", 2)
    first = max(names, key=lambda f: m.loc[f, "realized_return"])
    second = max((f for f in names if f != first), key=lambda f: m.loc[f, "realized_return"] - m.loc[f, first])
    assert picked[0] == first or math.isclose(m.loc[picked[0], "realized_return"], m.loc[first, "realized_return"])
    assert picked[1] == second or picked[1].startswith("price")


def test_monte_carlo_is_repeatable_and_bounded(spark, sf):
    a = canonical(plans.QUERIES["l19_monte_carlo"](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        out = plans.QUERIES["l19_monte_carlo"](spark, sf)
        b = canonical(out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    r = out.agg(F.min("soft_label"), F.max("soft_label"), F.min("label_confidence"), F.max("label_confidence")).first()
    assert r[0] >= 0 and r[1] <= 1 and r[2] >= -1e-9 and r[3] <= 1


def test_partitions_do_not_matter(spark, sf):
    for name in ("j1_asof_flow_to_book", "r2_hawkes", "l5_l12_first_touch"):
        results = []
        for n in ("1", "4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(canonical(plans.QUERIES[name](spark, sf)))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert results[0] == results[1] == results[2]
