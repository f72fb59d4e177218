"""Two-stage suffix sorting with numpy.

A suffix that is smaller than its successor (the suffix one later) is of the *rising* kind, any other *falling*.  Only
rising suffixes are sorted directly.  Falling ones are induced: buckets of equal first symbols are scanned in order,
and each suffix met puts the one before it, if falling, at the next free place of its bucket, whose falling suffixes
come first.  Whole buckets are scanned at once.  Order is exact up to ``depth`` symbols and arbitrary beyond.
"""

from __future__ import annotations

import numpy as np

_PACKED = 7  # symbols of nine bits in a key


def _rising(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    step[-1] = -1
    differs = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(differs[::-1])[::-1]] > 0


def _sort_directly(t: np.ndarray, at: np.ndarray, depth: int, deep: np.ndarray) -> np.ndarray:
    """Suffixes ``at`` in order of their first ``depth`` symbols; those not ``deep`` only of the first few."""
    padded = np.concatenate((t, np.zeros(depth + _PACKED, t.dtype))).astype(np.uint64)
    keys = np.zeros(len(padded) - _PACKED + 1, np.uint64)
    for j in range(_PACKED):
        keys = (keys << np.uint64(9)) | padded[j : j + len(keys)]
    order = at[np.argsort(keys[at], kind="stable")]
    first = keys[order]
    group = np.cumsum(np.concatenate(([0], first[1:] != first[:-1])))  # equal so far
    for d in range(_PACKED, depth, _PACKED):
        size = np.bincount(group)
        open_ = np.flatnonzero((size[group] > 1) & deep[order])
        if not len(open_):
            break
        now = keys[order[open_] + d]
        rank = np.lexsort((now, group[open_]))
        order[open_] = order[open_[rank]]
        now, g = now[rank], group[open_]
        cut = np.zeros(len(order), bool)
        cut[open_[1:]] = (now[1:] != now[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(cut)
    return order


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Start positions of all suffixes of symbols below 512, by their first ``depth`` symbols.

    If only the ``wanted`` suffixes need be in order, only the rising ones that these lead to are sorted deeply."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    rising = _rising(t)
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rises = np.bincount(t[rising], minlength=len(sizes))
    out = np.zeros(n, np.int64)
    deep = rising
    if wanted is not None:
        leads_to = np.minimum.accumulate(np.where(rising, np.arange(n), n)[::-1])[::-1][wanted]
        deep = np.zeros(n, bool)
        deep[leads_to[leads_to < n]] = True
    direct = _sort_directly(t, np.flatnonzero(rising), depth, deep)
    first_rise = starts + sizes - rises
    done = np.cumsum(rises) - rises
    for c in np.flatnonzero(rises):
        out[first_rise[c] : first_rise[c] + rises[c]] = direct[done[c] : done[c] + rises[c]]
    head = starts.copy()

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~rising[before]]
        if len(before):
            symbols = t[before]
            rank = np.argsort(symbols, kind="stable")
            before, symbols = before[rank], symbols[rank]
            new = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            run = np.flatnonzero(new)
            within = np.arange(len(symbols)) - np.repeat(run, np.diff(np.append(run, len(symbols))))
            out[head[symbols] + within] = before
            np.add.at(head, symbols[run], np.diff(np.append(run, len(symbols))))

    out[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        at = starts[c]
        while at < head[c]:  # falling suffixes of a bucket may put others of the same bucket behind them
            at, met = head[c], out[at : head[c]].copy()
            induce(met)
        induce(out[first_rise[c] : first_rise[c] + rises[c]])
    return out


def common_prefix_reaches(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes ``a`` and ``b`` of bytes agree in their first ``length`` bytes (both are that long)."""
    if not len(a):
        return np.zeros(0, bool)
    words = np.ndarray((len(t) - 7,), "<u8", t.tobytes(), strides=(1,))
    equal = np.ones(len(a), bool)
    for d in [*range(0, length - 8, 8), length - 8]:
        i = np.flatnonzero(equal)
        equal[i] = words[a[i] + d] == words[b[i] + d]
    return equal
