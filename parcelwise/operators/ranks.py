"""Exact order statistics by counting, without sorting or gathering a group.

Doubles become whole numbers of the same order: their 64 bits, flipped where negative. A pass
counts rows by the leading bits; only the prefixes that hold a wanted rank are looked at in the
next pass, some bits longer, until a prefix holds one value. Infinities and NaN (the greatest)
are values like others, and there are at most 64 passes.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that a pass may send to the driver.
COUNTS = 1 << 17
_TOP = np.uint64(1 << 63)


def _ordered(v: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    u = v.view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def _double(u: int) -> float:
    raw = np.array([u], np.uint64)
    return float(np.where(raw & _TOP, raw & ~_TOP, ~raw).view(np.float64)[0])


def _counted(rows: DataFrame, kind: str, depth: int, bits: int, wanted: dict) -> list:
    """(g, prefix, n, low, high) by group and prefix of depth + bits bits, of the rows whose first ``depth`` bits are wanted."""
    drop, cut = np.uint64(64 - depth - bits), np.uint64(64 - depth)

    def run(batches):
        total: dict = {}
        for pdf in batches:
            for g, mine in pdf.groupby("g", sort=False):
                u = _ordered(mine["v"].to_numpy(float))
                if depth:
                    u = u[np.isin(u >> cut, wanted.get(g, np.zeros(0, np.uint64)))]
                u.sort()
                prefix, at, n = np.unique(u >> drop, return_index=True, return_counts=True)
                for p, a, c in zip(prefix.tolist(), at.tolist(), n.tolist(), strict=True):
                    before = total.get((g, p), (0, 1 << 64, -1))
                    total[g, p] = (before[0] + c, min(before[1], int(u[a])), max(before[2], int(u[a + c - 1])))
        # Whole numbers of 64 bits, less 2**63, are longs in the same order.
        out = [(g, p - (1 << 63), n, lo - (1 << 63), hi - (1 << 63)) for (g, p), (n, lo, hi) in total.items()]
        yield pd.DataFrame(out, columns=["g", "p", "n", "lo", "hi"])

    found = rows.mapInPandas(run, f"g {kind}, p long, n long, lo long, hi long").groupBy("g", "p").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sorted(((r["g"], r["p"] + (1 << 63), r["n"], r["lo"] + (1 << 63), r["hi"] + (1 << 63)) for r in found.collect()), key=lambda r: r[1])


def order_statistics(rows: DataFrame, group: str, value: str, quantiles: tuple[float, ...]) -> dict:
    """{group: {quantile: value}}, exact, with linear interpolation; null groups and values don't count.

    Groups and quantiles are few: of each wanted rank only counts of prefixes reach the driver, at
    most about COUNTS a pass. NaN is the greatest value. Between an infinity and another value
    the result is NaN or that infinity, as doubles have it.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null")
    kind = rows.schema["g"].dataType.simpleString()
    # (prefix, rows under it) of each open rank; its value once known.
    sizes, open_, known, depth, wanted = {}, {}, {}, 0, {}
    while not depth or open_:
        most = max(1, len({(g, p) for (g, _), (p, _) in open_.items()}))
        bits = min(64 - depth, 16, max(1, (COUNTS // most).bit_length() - 1))
        parts: dict = {}
        for g, p, n, lo, hi in _counted(rows, kind, depth, bits, wanted):
            parts.setdefault((g, p >> bits if depth else 0), []).append((p, n, lo, hi))
        if not depth:
            sizes = {g: sum(x[1] for x in mine) for (g, _), mine in parts.items()}
            open_ = {(g, k): (0, 0) for g, n in sizes.items() for q in quantiles for k in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}
        depth += bits
        ends = {key: list(accumulate(x[1] for x in mine)) for key, mine in parts.items()}
        for (g, k), (prefix, under) in list(open_.items()):
            mine, upto = parts[g, prefix], ends[g, prefix]
            at = bisect_right(upto, k - under)
            p, n, lo, hi = mine[at]
            if lo == hi:
                known[g, k] = _double(lo)
                del open_[g, k]
            else:
                open_[g, k] = (p, under + upto[at] - n)
        wanted = {}
        for (g, _), (p, _) in open_.items():
            wanted.setdefault(g, set()).add(p)
        wanted = {g: np.array(sorted(ps), np.uint64) for g, ps in wanted.items()}
    out: dict = {}
    for g, n in sizes.items():
        for q in quantiles:
            at = q * (n - 1)
            low, high = known[g, int(at)], known[g, min(int(at) + 1, n - 1)]
            out.setdefault(g, {})[q] = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
    return out


def share_under(value: Column, breaks: list[float]) -> Column:
    """Share in per cent of ``breaks`` (sorted) that lie under the value."""

    @F.pandas_udf("double")
    def rank(v: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(breaks), v.to_numpy(float), side="left") * 100.0 / len(breaks)
        return pd.Series(found).where(v.notna().to_numpy())

    return rank(value)
