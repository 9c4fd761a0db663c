"""The cheapest pitch path of a series, in blocks: min-plus products of the blocks, then each block between its ends.

A row has candidates (f0, voicing) and the unvoiced state. The price of a step
depends on how much the last step's change of pitch differs from its own, so the
state of a path is a pair: its candidate in the row before and in the row. A
block's map is the price of the cheapest way from each pair ahead of it to each
pair at its end; the vector of prices runs over the maps, and back from the
cheapest end it fixes each block's first and last pair, between which the block
finds its rows. So the path is that of the whole series, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .blocks import Blocks, scanned

_NONE = 1e300  # the price of what cannot be
_PART = 1024  # rows whose steps are priced at once


@dataclass(frozen=True)
class Prices:
    """local: of a candidate's voicing (minus its logarithm), with 1 more below the cutoff; range_: of an f0 below 100 or above 350. vv: of the logarithm of a step's ratio, vvd: of its change; vuv: of a change of voicing; uu: of staying unvoiced."""

    local: float = 2.0
    vv: float = 10.0
    vvd: float = 5.0
    vuv: float = 10.0
    range_: float = 1.0
    uu: float = 0.0
    cutoff: float = 0.7


class _Rows:
    """Rows of a block as arrays: f (rows, states), with 0 for the unvoiced one, which is last; the prices of states; f of the two rows ahead."""

    def __init__(self, rows: pd.DataFrame, most: int, prices: Prices):
        self.prices, self.states = prices, most + 1
        self.first = rows["vidx"].to_numpy(np.int64) == 0
        self.f, self.local = self._read(rows["_f"], rows["_v"])
        ahead = [self._read(rows[c].iloc[:1], [[1.0] * most])[0][0] for c in ("_f2", "_f1")]
        self.before = np.concatenate([np.stack(ahead), self.f])  # row t stands at t + 2

    def _read(self, fs, vs):
        n, most, p = len(fs), self.states - 1, self.prices
        f, v, has = np.zeros((n, self.states)), np.zeros((n, most)), np.zeros((n, most), bool)
        for t, (a, b) in enumerate(zip(fs, vs)):
            k = min(len(a), len(b), most) if a is not None and b is not None else 0
            if k:
                f[t, :k], v[t, :k], has[t, :k] = np.asarray(a[:k], float), np.asarray(b[:k], float), True
        a, q = f[:, :-1], np.clip(v, 1e-6, 1.0)
        voiced = a > 0
        local = np.full((n, self.states), _NONE)
        local[:, :-1] = np.where(has, -p.local * np.log(q) + ((q < p.cutoff) & voiced) + p.range_ * (voiced & ((a < 100) | (a > 350))), _NONE)
        local[:, -1] = -p.local * np.log(np.clip(1 - v.max(1, initial=0.0), 1e-6, 1.0))
        return f, local

    def steps(self, lo: int, hi: int) -> np.ndarray:
        """Prices [row, i, j, k] of going from the pair (i, j) to (j, k), with k's own, at rows lo to hi."""
        p = self.prices
        a, b = self.before[lo : hi + 1, :, None], self.before[lo + 1 : hi + 2, None, :]  # each row's step and the one ahead of it
        both = (a > 0) & (b > 0)
        change = np.where(both, np.log(np.where(both, b, 1.0) / np.where(both, a, 1.0)), 0.0)  # of logarithms; 0 where either is unvoiced
        now, was, both, a, b = change[1:], change[:-1], both[1:], a[1:], b[1:]
        flat = np.where(both, p.vv * np.abs(now), np.where((a <= 0) & (b <= 0), p.uu, p.vuv))
        bend = np.where(both[:, None], p.vvd * np.abs(now[:, None] - was[:, :, :, None]), 0.0)
        if lo == 0 and self.first[0]:
            bend[0] = 0.0
        return np.minimum(flat[:, None] + bend + self.local[lo:hi, None, None], _NONE)

    def forward(self, d: np.ndarray, chosen: bool = True):
        """Prices d [.., i, j] of the pairs ahead, and behind each row; if chosen, with the best i of each (j, k)."""
        for lo in range(0, len(self.f), _PART):
            hi = min(lo + _PART, len(self.f))
            for t, step in zip(range(lo, hi), self.steps(lo, hi)):
                best = None
                if self.first[t]:
                    new = np.full(d.shape, _NONE)
                    new[..., -1, :] = np.minimum(d[..., -1, -1, None] + self.local[t], _NONE)
                    if chosen:
                        best = np.full(d.shape, self.states - 1)
                else:
                    all_ = d[..., None] + step
                    if chosen:
                        best = all_.argmin(-3)
                    new = np.minimum(all_.min(-3), _NONE)
                yield new, best
                d = new


def cheapest_path(df: DataFrame, b: Blocks, f0: str, voicing: str, candidates: int = 3, prices: Prices = Prices(), out: str = "f0final") -> DataFrame:
    """df with the f0 of the cheapest path, 0 where it is unvoiced.

    f0 and voicing are arrays of each row's candidates, of which the first
    `candidates` count; null and empty arrays have none, and an f0 of 0 is
    unvoiced.
    """
    states = candidates + 1
    pairs = states * states
    rows = df.select("*", F.col(f0).alias("_f"), F.col(voicing).alias("_v"))
    rows = b.windowed(rows, {"_f1": lambda s: F.lag("_f").over(s.ordered()), "_f2": lambda s: F.lag("_f", 2).over(s.ordered())}, 2, 0)

    def fold(part):
        d = np.full((pairs, pairs), _NONE)
        np.fill_diagonal(d, 0.0)
        d = d.reshape(pairs, states, states)
        for d, _ in _Rows(part, candidates, prices).forward(d, False):
            pass
        return d.reshape(-1)

    def along(maps, start):
        ahead = [start]
        for m in maps:
            ahead.append(np.minimum((ahead[-1][:, None] + m.reshape(pairs, pairs)).min(0), _NONE))
        last, out = int(ahead[-1].argmin()), []
        for m, v in zip(maps[::-1], ahead[-2::-1]):
            first = int((v + m.reshape(pairs, pairs)[:, last]).argmin())
            out.append([float(first), float(last)])
            last = first
        return out[::-1]

    def replay(part, state):
        r = _Rows(part, candidates, prices)
        d = np.full(pairs, _NONE)
        d[int(state[0])] = 0.0
        back = [best for _, best in r.forward(d.reshape(states, states))]
        j, k = divmod(int(state[1]), states)
        path = np.zeros(len(part))
        for t in range(len(part) - 1, -1, -1):
            path[t] = r.f[t, k]
            j, k = int(back[t][j, k]), j
        return part.assign(**{out: path})

    start = np.full(pairs, _NONE)
    start[-1] = 0.0  # ahead of the first row all is unvoiced, and free
    return scanned(rows, b, fold, None, start, replay, df.columns, along, **{out: DoubleType()})
