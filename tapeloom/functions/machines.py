"""Small state machines for rules that feed on their own past output.

A machine has ``inputs`` (columns it reads), ``outputs`` (name: type) and ``start`` (its first
state, JSON-like). ``step(state, *values)`` takes one row and returns (outputs tuple, next state).
The batch fold and the streaming processor both run these.

A machine whose effect on its state can be summed up for a block of rows, whatever the state is at
the block's start, says so by ``stages``: its state's parts in the order in which blocks can know
them. ``digest`` sums up what a block does to one part, given the parts before; ``advance`` applies
it. Digests are a few numbers: an affine map for decaying means and filters, a sum, a maximum.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field


class Machine:
    inputs: tuple[str, ...] = ()
    outputs: dict[str, str] = {}
    start: list = []
    #: Parts of the state, as places in it; none: its effect cannot be summed up.
    stages: tuple[tuple[int, ...], ...] = ()
    #: Name of the output that is true where the state starts afresh, which digests leave out.
    restarts: str | None = None

    def step(self, state: list, *values) -> tuple[tuple, list]:
        raise NotImplementedError

    def digest(self, stage: int, state: list, first: bool, columns: list[list]) -> list:
        """What a block's rows do to a part; ``state`` holds the earlier parts. ``first``: it is all of the state."""
        raise NotImplementedError

    def advance(self, stage: int, state: list, digest: list, first: bool) -> list:
        """The part after a block, from the state before it."""
        raise NotImplementedError


class Affine(Machine):
    """One part of the state, ``linear``, goes through each row by an affine map; ``still`` are the inputs without offset."""

    linear: tuple[int, ...] = (0,)

    def still(self, columns: list[list]) -> list[list]:
        return [[0.0] * len(c) for c in columns]

    @property
    def stages(self):
        return (self.linear,)

    def digest(self, stage, state, first, columns):
        ends = lambda begin, rows: [run(self, begin, rows)[1][i] for i in self.linear]
        if first:
            return [None, ends(state, columns)]
        at = lambda one: [1.0 if i == one else 0.0 if i in self.linear else x for i, x in enumerate(state)]
        return [[ends(at(i), self.still(columns)) for i in self.linear], ends(at(None), columns)]

    def advance(self, stage, state, digest, first):
        images, offset = digest
        if images is None:
            return offset
        return [c + sum(image[k] * state[i] for i, image in zip(self.linear, images)) for k, c in enumerate(offset)]


@dataclass
class Ewma(Affine):
    """Exponentially weighted mean, started by the first value."""

    column: str
    alpha: float
    name: str = "ewma"

    def __post_init__(self):
        self.inputs, self.outputs, self.start = (self.column,), {self.name: "double"}, [None]

    def step(self, state, x):
        y = x if state[0] is None else state[0] + self.alpha * (x - state[0])
        return (y,), [y]


@dataclass
class Macd(Affine):
    """Difference of a fast and a slow mean, less its own mean."""

    column: str = "close"
    fast: int = 12
    slow: int = 26
    signal: int = 9

    def __post_init__(self):
        self.inputs, self.outputs, self.start = (self.column,), {"macd_hist": "double"}, [None, None, None]
        self.linear = (0, 1, 2)

    def step(self, state, x):
        mean = lambda old, new, span: new if old is None else old + 2.0 / (span + 1) * (new - old)
        a, b = mean(state[0], x, self.fast), mean(state[1], x, self.slow)
        c = mean(state[2], a - b, self.signal)
        return (a - b - c,), [a, b, c]


@dataclass
class Hawkes(Affine):
    """Intensity that decays with time and jumps on each event; the first row only sets the clock."""

    alpha: float = 0.5
    beta: float = 1.0
    base: float = 0.1
    inputs = ("t_us", "is_event")
    outputs = {"intensity": "double", "counted": "boolean"}
    start = [None, 0.0]
    linear = (1,)
    stages = ((0,), (1,))  # the time of the row before, then the level

    def still(self, columns):
        return [columns[0], [False] * len(columns[1])]

    def digest(self, stage, state, first, columns):
        return [int(columns[0][-1])] if stage == 0 else super().digest(stage, state, first, columns)

    def advance(self, stage, state, digest, first):
        return digest if stage == 0 else super().advance(stage, state, digest, first)

    def step(self, state, t, is_event):
        last, level = state
        if last is None:
            return (self.base, False), [int(t), 0.0]
        level = level * math.exp(-self.beta * (t - last) / 1e6) + (self.alpha if is_event else 0.0)
        return (self.base + level, True), [int(t), level]


def settled(values: list[float], step, rows: int) -> list[float]:
    """Values after so many steps that depend on them only; stops where a step no longer changes them."""
    for _ in range(rows):
        new = step(values)
        if all(abs(a - b) <= 1e-15 * abs(b) for a, b in zip(new, values)):
            return new
        values = new
    return values


@dataclass
class KalmanLevel(Machine):
    """Local-level Kalman filter, started at the first value with variance 1; for bars, which the calendar bounds."""

    column: str = "close"
    noise: float = 1e-3
    drift: float = 1e-5

    def __post_init__(self):
        self.inputs, self.outputs, self.start = (self.column,), {"kalman_trend": "double"}, [None, 1.0]

    def step(self, state, z):
        x, p = state
        if x is None:
            x = z
        else:
            p += self.drift
        k = p / (p + self.noise)
        x += k * (z - x)
        return (x,), [x, (1 - k) * p]


@dataclass
class KalmanSlope(Affine):
    """Price and slope filter; the slope over the steepest one so far gives label and strength."""

    column: str = "price"
    process: float = 1e-4
    noise: float = 1e-2
    threshold: float = 0.05

    def __post_init__(self):
        self.inputs = (self.column,)
        self.outputs = {"trend_label": "int", "trend_strength": "double", "kalman_price": "double"}
        self.start = [None, 0.0, 1.0, 0.0, 1.0, 0.0]  # level, slope, covariance (aa, ab, bb), steepest slope

    linear = (0, 1)
    stages = ((2, 3, 4), (0, 1), (5,))  # the covariance depends on the number of rows only

    def gains(self, aa: float, ab: float, bb: float) -> tuple[float, float, list[float]]:
        """Weights of a miss for level and slope, and the covariance after a row."""
        aa, ab, bb = aa + 2 * ab + bb + self.process, ab + bb, bb + self.process
        ka, kb = aa / (aa + self.noise), ab / (aa + self.noise)
        return ka, kb, [(1 - ka) * aa, (1 - ka) * ab, bb - kb * ab]

    def digest(self, stage, state, first, columns):
        if stage == 1:
            return super().digest(stage, state, first, columns)
        return [len(columns[0])] if stage == 0 else [run(self, [*state[:5], 0.0], columns)[1][5]]

    def advance(self, stage, state, digest, first):
        if stage == 0:
            return settled(state[2:5], lambda c: self.gains(*c)[2], digest[0])
        return super().advance(stage, state, digest, first) if stage == 1 else [max(state[5], digest[0])]

    def step(self, state, z):
        x, v, aa, ab, bb, top = state
        x = z if x is None else x
        x += v  # predict
        ka, kb, (aa, ab, bb) = self.gains(aa, ab, bb)
        miss = z - x
        x, v = x + ka * miss, v + kb * miss
        top = max(top, abs(v))
        part = v / max(top, 1e-10)
        label = 1 if part > self.threshold else -1 if part < -self.threshold else 0
        return (label, abs(part), x), [x, v, aa, ab, bb, top]


@dataclass
class Fisher(Machine):
    """Turning points of the Fisher transform of a price's place in its recent range (``place`` in [-1, 1])."""

    smoothing: int = 9
    threshold: float = 0.3
    inputs = ("place", "cvd_step")
    outputs = {"fisher": "double", "fisher_signal": "int"}
    start = [0.0, 0.0, None]

    def step(self, state, place, cvd_step):
        value, fisher, mean = state
        if place is None:
            return (None, 0), state
        value = min(max(0.5 * (place + value), -0.999), 0.999)
        now = math.atanh(value) + 0.5 * fisher
        if mean is None:
            return (now, 0), [value, now, now]
        weight = 2.0 / (self.smoothing + 1)
        new_mean = weight * now + (1 - weight) * mean
        crossed_up, crossed_down = fisher <= mean and now > new_mean, fisher > mean and now <= new_mean
        signal = 0
        if crossed_up and fisher < -self.threshold and (cvd_step >= 0 or now - fisher >= self.threshold):
            signal = 1
        elif crossed_down and fisher > self.threshold and (cvd_step <= 0 or fisher - now >= self.threshold):
            signal = -1
        return (now, signal), [value, now, new_mean]


@dataclass
class PageHinkley(Machine):
    """Alarm when errors stay above their running mean; starts afresh after each alarm."""

    column: str = "error"
    delta: float = 0.005
    limit: float = 50.0

    def __post_init__(self):
        self.inputs, self.outputs, self.start = (self.column,), {"statistic": "double", "drift": "boolean"}, [0, 0.0, 0.0, 0.0]

    stages = ((0, 1), (2, 3))  # count and mean, then the drift's sum and its least value, which need the means
    restarts = "drift"

    def drifted(self, state, x):
        n, mean, total, low = state
        n += 1
        mean += (x - mean) / n
        total += x - mean - self.delta
        return [n, mean, total, min(low, total)]

    def digest(self, stage, state, first, columns):
        if stage == 0:
            return [len(columns[0]), math.fsum(columns[0])]
        state = [*state[:2], 0.0, math.inf]
        for x in columns[0]:
            state = self.drifted(state, x)
        return state[2:]

    def advance(self, stage, state, digest, first):
        n, mean, total, low = state
        if stage == 0:
            rows, added = digest
            return [n + rows, mean + (added - rows * mean) / (n + rows)]
        return [total + digest[0], min(low, total + digest[1])]

    def step(self, state, x):
        state = self.drifted(state, x)
        statistic = state[2] - state[3]
        alarm = statistic > self.limit
        return (statistic, alarm), list(self.start) if alarm else state


@dataclass
class MoveReference(Machine):
    """Reference price that follows only moves of at least ``threshold``; each move scores the earlier imbalance against it."""

    threshold: float = 0.0002
    inputs = ("price", "obi")
    outputs = {"trap_score": "double"}
    start = [None, 0.0]

    def step(self, state, price, obi):
        ref, last = state
        if ref is None:
            return (None,), [price, obi]
        move = price - ref
        if abs(move) < self.threshold:
            return (None,), [ref, obi]
        return (-math.copysign(1.0, move) * last,), [price, obi]


@dataclass
class LossGuard(Machine):
    """Accept trades until a day's loss, its trade count or the drawdown reaches a limit."""

    equity: float = 100_000.0
    max_loss: float = 0.02
    max_trades: int = 20
    max_drawdown: float = 0.05
    inputs = ("day", "pnl")
    outputs = {"accepted": "boolean", "equity_after": "double", "blocked": "boolean"}
    start: list = field(init=False)

    def __post_init__(self):
        self.start = [None, 0.0, 0, False, self.equity, self.equity]

    def step(self, state, day, pnl):
        today, loss, count, blocked, equity, peak = state
        if day != today:
            today, loss, count, blocked = int(day), 0.0, 0, False
        accepted = not blocked
        if accepted:
            equity += pnl
            peak = max(peak, equity)
            loss, count = loss + pnl, count + 1
            down = (peak - equity) / max(peak, 1)
            blocked = max(-loss, 0.0) / max(equity, 1) >= self.max_loss or down >= self.max_drawdown or count >= self.max_trades
        return (accepted, equity, blocked), [today, loss, count, blocked, equity, peak]


@dataclass
class OneAtATime(Machine):
    """Accept an interval only when the last accepted one has ended, plus a pause."""

    pause: int = 0
    inputs = ("start_at", "end_at")
    outputs = {"accepted": "boolean"}
    start = [None]

    def step(self, state, begin, end):
        free = state[0]
        ok = free is None or begin >= free
        return (ok,), [int(end) + self.pause] if ok else state


@dataclass
class RateGate(Machine):
    """Keep the strongest candidates at a target rate, by a quantile of the scores of earlier candidates.

    The state holds every earlier score, so a group must be bounded.
    """

    rate: float = 0.25
    warmup: int = 10
    inputs = ("is_candidate", "score")
    outputs = {"gate_threshold": "double", "gate": "boolean"}
    start = [0, []]

    def step(self, state, candidate, score):
        seen, scores = state
        if not candidate:
            return (None, False), [seen + 1, scores]
        limit = 0.0
        if len(scores) >= max(self.warmup, 1):
            share = len(scores) / max(seen, 1)
            keep = min(max(min(max(self.rate, 0.05), share) / max(share, 1e-9), 0.0), 1.0)
            limit = max(self._quantile(scores, 0.0 if keep >= 0.999 else 1.0 - keep), 0.0)
        bisect.insort(scores, score)
        return (limit, score >= limit), [seen + 1, scores]

    @staticmethod
    def _quantile(ordered: list[float], q: float) -> float:
        at = q * (len(ordered) - 1)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


#: Markets that a range filter tells apart.
UNCERTAIN, RANGING, TRENDING = "UNCERTAIN", "RANGING", "TRENDING"

#: What each situation does: empty the votes first, the vote cast (a number, or the signal), and the
#: direction gathered afterwards: as it was, none, or the signal's if it has one.
KEEP, DROP, SIGNAL = "keep", "drop", "signal"
SITUATIONS = {
    "low_confidence": (False, 0, KEEP),
    "microstructure_reversal": (True, None, DROP),
    "position_locked": (False, None, KEEP),
    "cooldown": (False, 0, KEEP),
    "range_midzone": (False, 0, DROP),
    "range_conflict": (False, 0, KEEP),
    "range_accumulating": (False, SIGNAL, SIGNAL),
    "trend_reversal": (True, None, DROP),
    "trend_no_signal": (False, 0, KEEP),
    "trend_same_zone": (False, None, KEEP),
    "trend_accumulating": (False, SIGNAL, SIGNAL),
}


@dataclass
class RangeFilter(Machine):
    """Enter after enough agreeing signals, hold a position, leave on reversal evidence, pause between entries.

    Where the price stands, volatility and reversal evidence come in as columns. Signals are 1 for
    long, -1 for short and 0 for none; actions are ENTER, HOLD and CLOSE. ``trending`` is what the
    regime says; where it says nothing (null), a market is ranging until its price breaks out of the
    range, which empties the votes. Each row has the market and the reason for its action: the first
    of `SITUATIONS` that holds, or the kind of confirmation it enters by.
    """

    needed: int = 3
    window: int = 8
    min_confidence: float = 0.55
    pause: int = 4
    longest: int = 8
    reversal_needed: float = 2.0
    early_confidence: float = 0.78
    early_place: float = 0.85
    early_reversal: float = 1.0
    inputs = ("price", "signal", "confidence", "trending", "near_bottom", "near_top", "in_middle", "range_place", "volatility", "reversal", "reversal_direction", "broke_out")
    outputs = {"action": "string", "action_direction": "int", "confirmations": "int", "market_state": "string", "filter_reason": "string"}
    # number of rows, recent votes, direction gathered, last entry (direction, row, price), locked, market
    start = [0, [], 0, 0, None, 0.0, False, UNCERTAIN]

    @staticmethod
    def market(before: str, trending: bool | None, broke_out: bool) -> str:
        if trending is not None:
            return TRENDING if trending else RANGING
        return {UNCERTAIN: RANGING, RANGING: TRENDING if broke_out else RANGING, TRENDING: TRENDING}[before]

    def step(self, state, price, signal, confidence, trending, near_bottom, near_top, in_middle, place, volatility, reversal, turn, broke_out):
        row, votes, gathered, last_way, last_row, last_price, locked, before = state
        row += 1
        market = self.market(before, trending, broke_out)
        since = row - last_row if last_row is not None else math.inf
        if trending is None and market != before and market == TRENDING:
            votes, gathered = [], 0
        in_range, turned = market == RANGING, reversal >= self.reversal_needed
        side = 1 if near_bottom else -1 if near_top else 0
        held = locked and since < self.longest
        holds = {
            "low_confidence": confidence < self.min_confidence and signal != 0,
            "microstructure_reversal": locked and turned,
            "position_locked": held,
            "cooldown": since < self.pause,
            "range_midzone": in_range and in_middle and side == 0,
            "range_conflict": in_range and side != 0 and signal not in (0, side),
            "range_accumulating": in_range,
            "trend_reversal": turned and gathered != 0 and turn == -gathered and not locked,
            "trend_no_signal": signal == 0,
            "trend_same_zone": signal == last_way and abs(price - last_price) < 2 * volatility,
            "trend_accumulating": True,
        }
        reason = next(name for name in SITUATIONS if holds[name])
        if reason not in ("low_confidence", "position_locked") and locked:  # the position is over
            locked, votes, gathered = False, [], 0
        empty, vote, gather = SITUATIONS[reason]
        votes = [] if empty else list(votes)
        if vote is not None:
            votes = [*votes, signal if vote == SIGNAL else vote][-self.window :]
        gathered = {KEEP: gathered, DROP: 0, SIGNAL: signal or gathered}[gather]
        confirmations = votes.count(gathered) if gathered else 0
        edge = place >= self.early_place if signal < 0 else place <= 1 - self.early_place
        early = edge and confidence >= self.early_confidence and reversal >= self.early_reversal
        goal = self.needed if in_range else 1 if early else max(2, self.needed - 1)
        if vote == SIGNAL and gathered and confirmations >= goal:
            reason = "range_confirmed" if in_range else "trend_confirmed_early" if goal == 1 else "trend_confirmed"
            return ("ENTER", gathered, 0, market, reason), [row, [], 0, gathered, row, price, True, market]
        action = "CLOSE" if reason == "microstructure_reversal" else "HOLD"
        return (action, 0, confirmations, market, reason), [row, votes, gathered, last_way, last_row, last_price, locked, market]


@dataclass
class EventScore(Machine):
    """Volume, imbalance, wall and shift conditions against the last rows, with a combined score."""

    frame: int = 50
    volume_mult: float = 1.10
    obi_limit: float = 0.08
    wall_limit: float = 0.70
    shift_limit: float = 0.75
    score_limit: float = 0.0
    inputs = ("size", "wall", "obi", "cvd", "micro_price", "liquidity_density")
    outputs = {"event_score": "double", "triggers": "int", "passed": "boolean"}
    start = [[], [], [], [], []]  # the last rows of size and of the four shifting columns

    @staticmethod
    def _z(values: list[float]) -> float:
        mean = sum(values) / len(values)
        std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
        return abs(values[-1] - mean) / std if len(values) > 1 and std > 1e-9 else 0.0

    def step(self, state, size, wall, *shifts):
        recent = [[*old, x] for old, x in zip(state, (size, *shifts))]
        mean = sum(recent[0]) / len(recent[0])
        volume = size / max(mean, 1e-9) if mean > 0 else float(size > 0)
        shift = max(self._z(v) for v in recent[1:])
        parts = [volume / self.volume_mult, abs(shifts[0]) / self.obi_limit, wall / self.wall_limit, shift / self.shift_limit]
        hits = sum(p > 1 for p in parts)
        score = sum(w * max(p - 1, 0.0) for w, p in zip((0.30, 0.30, 0.20, 0.20), parts)) + 0.50 * max(hits - 1, 0)
        return (score, hits, hits > 0 and score >= self.score_limit), [v[-self.frame :] for v in recent]


@dataclass
class SessionTotals(Machine):
    """Volume-weighted price and signed volume since the day began."""

    inputs = ("day", "price", "size", "is_buy")
    outputs = {"current_vwap": "double", "session_cvd": "double"}
    start = [None, 0.0, 0.0, 0.0]
    stages = ((0,), (1, 2, 3))  # the day, then the totals, which add up within one

    def digest(self, stage, state, first, columns):
        if stage == 0:
            return [int(columns[0][-1])]
        return [int(columns[0][-1]) != state[0], run(self, [state[0], 0.0, 0.0, 0.0], columns)[1][1:]]

    def advance(self, stage, state, digest, first):
        if stage == 0:
            return digest
        fresh, totals = digest
        return totals if fresh else [a + b for a, b in zip(state[1:], totals)]

    def step(self, state, day, price, size, is_buy):
        today, volume, paid, cvd = state if state[0] == day else (int(day), 0.0, 0.0, 0.0)
        volume, paid, cvd = volume + size, paid + price * size, cvd + (size if is_buy else -size)
        return (paid / volume if volume > 0 else price, cvd), [today, volume, paid, cvd]


def run(machine: Machine, state: list, columns: list[list]) -> tuple[list[tuple], list]:
    """Feed rows, given as columns, to a machine."""
    out = []
    for values in zip(*columns):
        result, state = machine.step(state, *values)
        out.append(result)
    return out, state
