"""Change points and piecewise-linear models of one series at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.units import SECONDS


#: Costs of standardised features that differ by less are equal.
TIE = 1e-7


def pelt(signal: np.ndarray, penalty: float, min_size: int = 2) -> list[int]:
    """The last-plus-one positions of the segments of least squared deviation plus penalty (Killick et al. 2012)."""
    n = len(signal)
    if n < 2 * min_size:
        return [n] if n else []
    sums = np.vstack([np.zeros(signal.shape[1]), np.cumsum(signal, axis=0)])
    squares = np.concatenate([[0.0], np.cumsum((signal**2).sum(axis=1))])

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        return squares[b] - squares[a] - ((sums[b] - sums[a]) ** 2).sum(axis=1) / (b - a)

    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    # A start that t beats stays beaten once a segment may begin at t.
    until = np.full(n + 1, n + 1)
    starts = np.arange(n + 1)
    for t in range(min_size, n + 1):
        fit = starts[: t - min_size + 1]
        fit = fit[(until[fit] > t) & np.isfinite(best[fit])]
        held = best[fit] + cost(fit, t)
        k = int(held.argmin())
        # Of starts that are equally good but for rounding the first counts.
        k = int(np.flatnonzero(held <= held[k] + TIE)[0])
        best[t], back[t] = held[k] + penalty, fit[k]
        lost = fit[held > best[t] + TIE]
        until[lost] = np.minimum(until[lost], t + min_size)
    ends, t = [], n
    while t > 0:
        ends.append(t)
        t = back[t]
    return ends[::-1]


def change_spans(df: DataFrame, keys: list[str], at: str, features: list[str], penalty: float, min_size: int = 2) -> DataFrame:
    """(keys, span, start, end): spans between change points of the standardised features; rows with a null take no part.

    One series is in memory at a time; its cost grows with the square of its
    length where no start is ever ruled out, so series of more than some ten
    thousand rows should be split by a further key or averaged first.
    """

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        x = pdf[features].to_numpy(float)
        std = x.std(axis=0)
        ends = pelt((x - x.mean(axis=0)) / np.where(std > 0, std, 1.0), penalty, min_size)
        starts = [0, *ends[:-1]]
        out = pd.DataFrame({"span": range(1, len(ends) + 1), "start": pdf[at].iloc[starts].to_numpy(), "end": pdf[at].iloc[[e - 1 for e in ends]].to_numpy()})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "span", "start", "end"]]

    rows = df.select(*keys, at, *[F.col(c).cast("double").alias(c) for c in features]).dropna(subset=[at, *features])
    kind = rows.schema[at].dataType.simpleString()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.groupBy(*keys).applyInPandas(spans, f"{kinds}, span int, start {kind}, end {kind}")


@dataclass(frozen=True)
class Search:
    """Differential evolution (Storn and Price 1997) over the breaks."""

    population: int = 50
    rounds: int = 300
    tolerance: float = 1e-3
    seed: int = 0


def hinge_fit(x: np.ndarray, y: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, float]:
    """Values at the breaks of the best continuous line through them, and its squared residuals; breaks include both ends."""
    basis = np.column_stack([np.ones_like(x), x - breaks[0], *[np.maximum(0.0, x - b) for b in breaks[1:-1]]])
    beta, *_ = np.linalg.lstsq(basis, y, rcond=None)
    rest = y - basis @ beta
    at = np.column_stack([np.ones_like(breaks), breaks - breaks[0], *[np.maximum(0.0, breaks - b) for b in breaks[1:-1]]])
    return at @ beta, float(rest @ rest)


def spaced(u: np.ndarray, lo: float, gap: float) -> np.ndarray:
    """Breaks at least ``gap`` apart, from slacks."""
    return lo + gap * np.arange(1, len(u) + 1) + np.sort(u)


class Sums:
    """Sums over the rows behind each point of a series, from which the squared residuals of many sets of breaks follow at once.

    ``x`` rises from 0 to 1.  The sums behind a break give the products of its
    hinge with all others, so a set of k breaks costs k*k, however long the
    series is.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.n = x, len(x)
        behind = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0.0)
        self.s = [behind(x**p) for p in range(3)]
        self.t = [behind(y * x**p) for p in range(2)]
        self.yy = float(y @ y)

    def residuals(self, breaks: np.ndarray) -> np.ndarray:
        """The squared residuals of each row of rising interior breaks."""
        rows, k = breaks.shape
        at = np.searchsorted(self.x, breaks, "right")
        s0, s1, s2, t0, t1 = (v[at] for v in (*self.s, *self.t))
        g, r = np.empty((rows, k + 2, k + 2)), np.empty((rows, k + 2))
        g[:, 0, 0], g[:, 0, 1], g[:, 1, 1] = self.s[0][0], self.s[1][0], self.s[2][0]
        g[:, 0, 2:], g[:, 1, 2:] = s1 - breaks * s0, s2 - breaks * s1
        for i in range(k):
            b = breaks[:, i : i + 1]
            g[:, i + 2, i + 2 :] = s2[:, i:] - (b + breaks[:, i:]) * s1[:, i:] + b * breaks[:, i:] * s0[:, i:]
        upper = np.triu_indices(k + 2, 1)
        g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
        r[:, 0], r[:, 1], r[:, 2:] = self.t[0][0], self.t[1][0], t1 - breaks * t0
        # Breaks that coincide make equal columns; the least ridge keeps the system solvable.
        held = g + np.eye(k + 2) * (1e-12 * self.n)
        beta = np.linalg.solve(held, r[..., None])[..., 0]
        return np.maximum(0.0, self.yy - 2 * (r * beta).sum(1) + np.einsum("ri,rij,rj->r", beta, g, beta))


def fit_segments(x: np.ndarray, y: np.ndarray, n_segments: int, min_length: float = 0.0, search: Search = Search()) -> tuple[np.ndarray, np.ndarray, float]:
    """(breaks, values, squared residuals) of the best ``n_segments`` joined lines; ValueError if they do not fit.

    A generation of the search is solved at once, from sums; the breaks found
    are fitted once more on the rows themselves.
    """
    lo, hi = float(x.min()), float(x.max())
    slack = hi - lo - n_segments * min_length
    if slack < 0 or hi == lo or len(x) < 2:
        raise ValueError("the series is too short for so many segments")

    def solve(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        breaks = np.concatenate([[lo], spaced(u, lo, min_length), [hi]])
        return breaks, *hinge_fit(x, y, breaks)

    k = n_segments - 1
    if not k:
        return solve(np.zeros(0))
    order = np.argsort(x, kind="stable")
    spread = y.std() or 1.0
    sums = Sums((x[order] - lo) / (hi - lo), (y[order] - y.mean()) / spread)
    steps = min_length * np.arange(1, k + 1)
    scores = lambda u: sums.residuals((steps + np.sort(u, axis=1)) / (hi - lo))
    rng, n = np.random.default_rng(search.seed), search.population
    # One start in each of ``n`` equal parts of every break's range.
    pop = (np.stack([rng.permutation(n) for _ in range(k)], axis=1) + rng.random((n, k))) / n * slack
    score = scores(pop)
    for _ in range(search.rounds):
        lead = pop[score.argmin()]
        a, b = rng.integers(n, size=(2, n))
        trial = np.clip(lead + rng.uniform(0.5, 1.0) * (pop[a] - pop[b]), 0, slack)
        cross = rng.random((n, k)) < 0.7
        cross[np.arange(n), rng.integers(k, size=n)] = True
        trial = np.where(cross, trial, pop)
        new = scores(trial)
        better = new <= score
        pop[better], score[better] = trial[better], new[better]
        if score.std() <= search.tolerance * abs(score.mean()) + 1e-12:
            break
    best, value, step = pop[score.argmin()].copy(), float(score.min()), slack / 50
    moves = np.vstack([np.eye(k), -np.eye(k)])
    while step > slack * 1e-7:  # local refinement
        trial = np.clip(best + step * moves, 0, slack)
        new = scores(trial)
        if new.min() < value:
            best, value = trial[new.argmin()], float(new.min())
        else:
            step /= 2
    return solve(best)


def bic(ssr: float, n: int, n_segments: int) -> float:
    """A perfect fit is minus infinity."""
    return (-np.inf if ssr <= 0 else n * np.log(ssr / n)) + (2 * n_segments + 1) * np.log(n)


def _table(breaks: np.ndarray, values: np.ndarray, per: float) -> pd.DataFrame:
    rate = np.append(np.diff(values) / np.diff(breaks) * per, np.nan)
    return pd.DataFrame({"at": breaks, "value": values, "rate": rate})


def piecewise(df: DataFrame, keys: list[str], at: str, value: str, unit: str = "D", n_segments: int | None = None, breaks: list[float] | None = None, max_segments: int = 6, min_length: float = 0.0, search: Search = Search()) -> DataFrame:
    """(keys, at, value, rate): joined lines through a series whose ``at`` is in seconds; rates are per unit.

    With ``breaks`` between these, the first and the last one included, with
    ``n_segments`` so many, else as many as the Bayesian information criterion
    prefers, up to the first that does not fit.
    Series are fitted in parallel, one at a time in memory.
    """
    per = SECONDS[unit]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        zero = x.min()
        x = x - zero
        if breaks is not None:
            edges = np.array(sorted(breaks)) - zero
            out = _table(edges, hinge_fit(x, y, edges)[0], per)
        else:
            found, least = None, np.inf
            for n in [n_segments] if n_segments else range(1, max_segments + 1):
                try:
                    got = fit_segments(x, y, n, min_length, search)
                except ValueError:
                    if n_segments or found is None:
                        raise
                    break
                score = bic(got[2], len(x), n)
                if found is None or score < least:
                    found, least = got, score
            out = _table(found[0], found[1], per)
        out["at"] += zero
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "at", "value", "rate"]]

    rows = df.select(*keys, F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("y")).dropna(subset=["x", "y"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    # The rows are few for the work in them; a given number of partitions keeps adaptive execution from putting all series into one task.
    spread = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else rows
    out = spread.groupBy(*keys).applyInPandas(fit, f"{kinds}, at double, value double, rate double")
    return out.withColumn("rate", F.nanvl("rate", F.lit(None)))


def commute_spans(commutes: DataFrame, keys: list[str], penalty: float = 100.0, min_size: int = 2) -> DataFrame:
    """Stretches of time between moves of home or work, from (date, direction, start_*, end_*, *_address).

    Home is the start of a morning and the end of any other ride.  Each span
    counts all its commutes and names its most frequent home and work address.
    """
    morning = F.col("direction") == "Morning"
    swap = lambda a, b: F.when(morning, F.col(a)).otherwise(F.col(b))
    placed = commutes.select(
        *keys, "date",
        swap("start_lat", "end_lat").alias("home_lat"), swap("start_lon", "end_lon").alias("home_lon"), swap("end_lat", "start_lat").alias("work_lat"), swap("end_lon", "start_lon").alias("work_lon"),
        swap("start_address", "end_address").alias("home"), swap("end_address", "start_address").alias("work"),
    )
    spans = change_spans(placed, keys, "date", ["home_lat", "home_lon", "work_lat", "work_lon"], penalty, min_size)
    # Spans of a key do not overlap, so the last one that starts at or before a date is the only one that can hold it.
    from waymark.operators.timeseries import asof

    held = asof(placed, spans.select(*keys, F.col("start").alias("date"), "span", "start", "end"), keys, "date", ["span", "start", "end"]).where("date <= end")
    out = held.groupBy(*keys, "span").agg(F.first("start").alias("s"), F.first("end").alias("e"), F.count(F.lit(1)).alias("n_commutes"), F.expr("mode(home, true)").alias("home_address"), F.expr("mode(work, true)").alias("work_address"))
    return out.select(*keys, F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"), "n_commutes", "home_address", "work_address")
