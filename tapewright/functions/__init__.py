"""Column functions: pure expressions, evaluated inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPS


def parse_ts(ts: Column) -> Column:
    """A timestamp, or null where a string can't be read as one."""
    return F.try_to_timestamp(ts.cast("string"))


def epoch_ms(ms: Column) -> Column:
    """The timestamp of epoch milliseconds."""
    return F.timestamp_millis(ms)


def bar_start(ts: Column, unit: str = "second") -> Column:
    """The start of the bar that ``ts`` is in; ``unit`` as for ``date_trunc``."""
    return F.date_trunc(unit, ts)


def side(is_buyer_maker: Column) -> Column:
    """-1 for an aggressive sell (the buyer was the maker), else 1; unknown counts as 1."""
    return F.when(F.coalesce(is_buyer_maker, F.lit(False)), F.lit(-1)).otherwise(F.lit(1))


def buy_qty(qty: Column, is_buyer_maker: Column) -> Column:
    return F.when(side(is_buyer_maker) > 0, qty).otherwise(F.lit(0.0))


def sell_qty(qty: Column, is_buyer_maker: Column) -> Column:
    return F.when(side(is_buyer_maker) < 0, qty).otherwise(F.lit(0.0))


def notional(price: Column, qty: Column) -> Column:
    return price * qty


def order_flow(buy: Column, sell: Column) -> Column:
    return buy - sell


def imbalance(buy: Column, sell: Column) -> Column:
    """Order flow as a share of the volume."""
    return (buy - sell) / (buy + sell + EPS)


def volume_spike(volume: Column, baseline: Column) -> Column:
    return volume / (baseline + EPS)


def log_return(vwap: Column, previous: Column) -> Column:
    """0 where there is no positive previous or current price."""
    return F.when((previous > 0) & (vwap > 0), F.ln(vwap / (previous + EPS))).otherwise(F.lit(0.0))


def shock_threshold(sigma: Column, alpha: float | Column, horizon: int) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return alpha * F.sqrt(F.lit(float(horizon))) * sigma


def shock_label(future: Column, threshold: Column) -> Column:
    """1 for a fall, 2 for a rise of at least the threshold, else 0; a fall goes first where both hold."""
    return F.when(future <= -threshold, 1).when(future >= threshold, 2).otherwise(0)


def logit_adjusted(p: Column, positive: Column, negative: Column, tau: float) -> Column:
    """Probability after adding ``tau`` times the log prior ratio to its logit; unchanged for tau 0."""
    if not tau:
        return p
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    z = F.ln(p / (1 - p)) + tau * F.ln(positive / negative)
    return 1 / (1 + F.exp(-z))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return (1 + b) * precision * recall / (b * precision + recall + 1e-12)


def tail_ratio(slow: Column, fast: Column) -> Column:
    """How many times ``fast`` is in ``slow``, with a floor of 1e-12 for ``fast``."""
    return slow / F.greatest(fast, F.lit(1e-12))


def gated(p1: Column, p2: Column, tau: float | Column, tau2: float | Column, force: bool = False) -> tuple[Column, Column]:
    """(p2 or null, label): rows below the gate get label 0 and, unless forced, no second probability."""
    tau, tau2 = (t if isinstance(t, Column) else F.lit(float(t)) for t in (tau, tau2))
    passed = p1 >= tau
    second = p2 if force else F.when(passed, p2)
    return second, F.when(~passed, 0).when(p2 >= tau2, 2).otherwise(1)


def artifact_tag(horizon: Column, alpha: Column, lam: Column) -> Column:
    """For instance H30_a2_L94: the horizon, alpha in its shortest form, 100 times lambda rounded half to even."""
    whole = alpha == F.floor(alpha)
    short = F.when(whole, alpha.cast("long").cast("string")).otherwise(alpha.cast("string"))
    return F.concat(F.lit("H"), horizon.cast("string"), F.lit("_a"), short, F.lit("_L"), F.format_string("%02d", F.rint(lam * 100).cast("long")))


def precision(tp: Column, fp: Column) -> Column:
    """0 where nothing was predicted."""
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    """0 where there is nothing to find."""
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    """0 where both are 0."""
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
