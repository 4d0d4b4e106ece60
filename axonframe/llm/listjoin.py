"""Numpy helpers for joins within sorted lists: tasks read the entries of a list in order of size.

A list's entries come as Arrow batches in order of the list's keys and, within it, of ``n``. Pairs
are looked at in blocks of a fixed number, so memory does not depend on how many a list has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs that are looked at in one go.
PAIRS = 1 << 20
#: Pairs that a task looks at in one list at most, about.
WORK = 1 << 26


def columns(batch: pa.RecordBatch, bits: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """Arrays by name; ``bits`` become unsigned, since numpy counts those of a negative number's absolute value."""
    out = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
    return out | {s: out[s].view(np.uint64) for s in bits}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def windows(group: np.ndarray, n: np.ndarray, longest: tuple[int, int]):
    """For entries in order of (group, n): the next ones of the group whose n fits, as blocks of pairs (i, j).

    n fits if it is at most the first one's times ``longest[0] / longest[1]``.
    """
    key, n = group.astype(np.int64) << 32, n.astype(np.int64)
    count = np.searchsorted(key + n, key + n * longest[0] // longest[1], "right") - np.arange(len(n)) - 1
    done, total, at = 0, np.cumsum(count), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        c = count[at:end]
        i = np.repeat(np.arange(at, end), c)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        done, at = int(total[end - 1]), end


def alone(rows: dict[str, np.ndarray], bits: tuple[str, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that entry ``i`` has and entry ``j`` has not."""
    return sum(np.bitwise_count(rows[s][i] & ~rows[s][j]).astype(np.int64) for s in bits)


def whole_lists(batches, keys: tuple[str, ...], bits: tuple[str, ...] = ()):
    """Yields the entries of whole lists, as many as have come together, as arrays by name."""
    held = []
    last = lambda rows: tuple(rows[k][-1] for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch, bits)
        if held and last(held[-1]) != tuple(rows[k][0] for k in keys):
            yield joined(held)
            held = []
        starts = np.flatnonzero(np.diff(runs(*[rows[k] for k in keys]))) + 1
        if len(starts):
            yield joined([*held, {k: x[: starts[-1]] for k, x in rows.items()}])
            held = []
            rows = {k: x[starts[-1] :] for k, x in rows.items()}
        held.append(rows)
    if held:
        yield joined(held)
