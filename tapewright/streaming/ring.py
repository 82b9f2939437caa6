"""A symbol's recurrences in keyed state, slot by slot: what a bar writes doesn't depend on how much is remembered."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import BASELINE_ROWS, EPS, LAMBDA, LOOKBACK

SUMS = ("sum_pq", "sum_q", "total_vol", "buy_vol", "sell_vol", "msg_count")
LIVE_ROW = (
    "symbol string, start_ms long, total_vol double, vwap double, buy_vol double, sell_vol double, msg_count long, "
    "r_t double, sigma_hat double, OFI_t double, Imbalance_t double, VolSpike_t double, window_rows int"
)


class Ring:
    """Last price, variance and number of bars of a symbol, and by slot its last volumes and feature vectors.

    ``open`` reads the state once, ``add`` takes the next bar, ``close`` writes the numbers and the slots that changed.
    A slot is a bar's number modulo the ring's length, so a bar overwrites one volume and one vector.
    """

    def __init__(self, handle: StatefulProcessorHandle, lam: float, rows: int):
        self.lam, self.rows = lam, rows
        self.last = handle.getValueState("last", "vwap double, sig2 double, bars long")
        self.volume_slots = handle.getMapState("volumes", "slot int", "v double")
        self.vector_slots = handle.getMapState("vectors", "slot int", "x array<double>")

    def open(self) -> None:
        self.vwap, self.sig2, self.n = self.last.get() if self.last.exists() else (0.0, 0.0, 0)
        self.volumes = {k[0]: v[0] for k, v in self.volume_slots.iterator()} if self.n else {}
        self.vectors: dict[int, list[float]] = {}

    def add(self, total_vol: float, sum_pq: float, sum_q: float, buy: float, sell: float, count: int) -> tuple:
        """The bar's price, r_t, sigma_hat, OFI_t, Imbalance_t, VolSpike_t and the vectors that are remembered now."""
        price = sum_pq / sum_q if sum_q > 0 else self.vwap
        r = math.log(price / (self.vwap + EPS)) if self.n and self.vwap > 0 and price > 0 else 0.0
        self.sig2 = r * r if not self.n else self.lam * self.sig2 + (1 - self.lam) * r * r
        self.volumes[self.n % BASELINE_ROWS] = float(total_vol)
        flow = buy - sell
        spike = total_vol / (sum(self.volumes.values()) / len(self.volumes) + EPS)
        vector = [r, math.sqrt(self.sig2 + EPS), flow, flow / (buy + sell + EPS), spike]
        self.vectors[self.n % self.rows] = [*vector, float(count)]
        self.vwap, self.n = price, self.n + 1
        return (price, *vector, min(self.n, self.rows))

    def close(self, added: int) -> None:
        """Writes what the ``added`` bars changed."""
        self.last.update((self.vwap, self.sig2, self.n))
        for i in range(max(0, self.n - min(added, BASELINE_ROWS)), self.n):
            self.volume_slots.updateValue((i % BASELINE_ROWS,), (self.volumes[i % BASELINE_ROWS],))
        for slot, x in self.vectors.items():
            self.vector_slots.updateValue((slot,), (x,))

    def clear(self) -> None:
        for state in (self.last, self.volume_slots, self.vector_slots):
            state.clear()


class LiveFeatures(StatefulProcessor):
    """Bars and features of a symbol's trades; a bar is put out by an event-time timer, once no trade for it can come.

    So the last bar of a symbol that has fallen silent comes out too, as soon as the trades of others move the watermark
    past its end. A symbol without trades for ``idle_ms`` leaves the state; if it returns it starts anew.
    """

    def __init__(self, width_ms: int, lam: float, rows: int, idle_ms: int):
        self.width, self.lam, self.rows, self.idle = width_ms, lam, rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = Ring(handle, self.lam, self.rows)
        self.bars = handle.getMapState("open", "start long", ", ".join(f"{c} {'long' if c == 'msg_count' else 'double'}" for c in SUMS))
        self.marks = handle.getValueState("marks", "timer long, closed long, seen long")  # the timer that is set, ends of the last bar put out and seen

    def _set(self, timer: int, wanted: int) -> int:
        """Moves the symbol's one timer."""
        if timer != wanted:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        return wanted

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timer, closed, seen = self.marks.get() if self.marks.exists() else (-1, 0, 0)
        late = max(closed, timerValues.getCurrentWatermarkInMs())
        changed: dict[int, np.ndarray] = {}
        for chunk in rows:  # chunk by chunk: what is held are the sums of open bars
            start = (chunk["ms"] // self.width * self.width).to_numpy()
            good = start + self.width > late
            for at, sums in chunk[good].groupby(start[good])[list(SUMS)].sum().iterrows():
                if at not in changed:
                    before = self.bars.getValue((int(at),))
                    changed[int(at)] = np.array(before if before else [0.0] * len(SUMS))
                changed[int(at)] += sums.to_numpy()
        for at, sums in changed.items():
            self.bars.updateValue((at,), (*map(float, sums[:-1]), int(sums[-1])))
        if changed:
            first, idling = min(changed) + self.width, timer == seen + self.idle
            self.marks.update((self._set(timer, first if timer < 0 or idling else min(timer, first)), closed, max(seen, max(changed) + self.width)))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        _, closed, seen = self.marks.get()
        bars = sorted((k[0], v) for k, v in self.bars.iterator())
        ready = [(at, sums) for at, sums in bars if at + self.width <= watermark]
        if not bars and watermark >= seen + self.idle:
            for state in (self.ring, self.bars, self.marks):
                state.clear()
            return
        out = []
        if ready:
            self.ring.open()
            for at, (sum_pq, sum_q, total, buy, sell, n) in ready:
                price, *vector, remembered = self.ring.add(total, sum_pq, sum_q, buy, sell, n)
                out.append((key[0], at, total, price, buy, sell, n, *vector, remembered))
                self.bars.removeKey((at,))
            self.ring.close(len(ready))
            closed = ready[-1][0] + self.width
        rest = bars[len(ready) :]
        self.marks.update((self._set(-1, rest[0][0] + self.width if rest else max(seen + self.idle, watermark + 1)), closed, seen))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LIVE_ROW.split(", ")])

    def close(self) -> None:
        pass


def live_features(trades: DataFrame, width: int = 1, late: str = "5 seconds", lam: float = LAMBDA, rows: int = LOOKBACK, idle: int = 86_400) -> DataFrame:
    """Features of the bars of ``width`` seconds of a stream of trades, in one stateful step; needs the RocksDB state store.

    Rows are those of ``live.stream_features``. State per symbol: open bars, two numbers, BASELINE_ROWS volumes and
    ``rows`` vectors; a bar writes one slot of either ring. ``idle`` is in seconds of event time. Trades for a bar that
    is out, or that ended before the watermark, are dropped; trades without time or price and quantity count as in
    ``operators.bars``.
    """
    side = F.coalesce("is_buyer_maker", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    timed = trades.where("ts IS NOT NULL").withWatermark("ts", late)
    sums = timed.select(
        "symbol",
        "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        zero(F.col("price") * F.col("qty")).alias("sum_pq"),
        zero(F.col("qty")).alias("sum_q"),
        zero(F.col("qty")).alias("total_vol"),
        zero(F.when(side, 0.0).otherwise(F.col("qty"))).alias("buy_vol"),
        zero(F.when(side, F.col("qty")).otherwise(0.0)).alias("sell_vol"),
        F.lit(1).cast("long").alias("msg_count"),
    )
    processor = LiveFeatures(width * 1000, lam, rows, idle * 1000)
    out = sums.groupBy("symbol").transformWithStateInPandas(processor, outputStructType=LIVE_ROW, outputMode="Append", timeMode="EventTime")
    return out.select("symbol", F.timestamp_millis("start_ms").alias("sec"), *[c.split()[0] for c in LIVE_ROW.split(", ")[2:]])
