"""Weighted MinHash signatures of multisets by Poisson processes over dyadic weight ranges.

An element of weight w takes part in the weight ranges (0, 1], (1, 2], (2, 4],
(4, 8], ... that begin below w. Each range has one Poisson process in time whose
rate is the range's width; its points are the same in every text. A point lies
at a level within its range - the bits of the level split the range in halves
again and again - and counts only where the level is at most w. A point falls
on one of the signature's components at random. A component holds the earliest
time of its points: two texts agree there with a chance of exactly their
weighted Jaccard similarity. A process stops once it is later than the latest
component, so a text of many elements costs little more than a point for each.
"""

from __future__ import annotations

import numpy as np

from quillgrid.llm.arrays import mix

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: How many points each running process makes in round 0, 1, 2, ...; the last holds from then on.
BLOCKS = (1, 1, 2, 4, 8, 16, 32)


def multisets(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, their owners, their counts), by owner and value."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    if not len(v):
        return v, o, np.zeros(0, np.int64)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return v[at], o[at], np.diff(np.append(at, len(v)))


def signatures(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, texts: int, size: int) -> np.ndarray:
    """A signature of ``size`` (a power of two) 32-bit components for each of ``texts`` multisets; 0s for empty ones."""
    keys, text, weight, level = [values], [owner], [counts], [np.zeros(len(values), np.int64)]
    j, many = 1, np.flatnonzero(counts > 1)
    while len(many):
        keys.append(mix(values[many] + np.array([j], np.uint64) * _GOLD))
        text.append(owner[many]), weight.append(counts[many]), level.append(np.full(len(many), j))
        j, many = j + 1, many[counts[many] > 2**j]
    key, text, weight, level = (np.concatenate(x) for x in (keys, text, weight, level))
    width = np.where(level == 0, 1, 2.0 ** np.maximum(level - 1, 0))
    earliest = np.full(texts * size, np.inf)
    latest = np.full(texts, np.inf)
    time, made, turn = np.zeros(len(key)), 0, 0
    while len(key):
        block = BLOCKS[min(turn, len(BLOCKS) - 1)]
        x = mix(key[:, None] + (np.arange(made + 1, made + block + 1, dtype=np.uint64) * _GOLD)[None, :])
        gap = -np.log((np.right_shift(x, _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gap[:, 0] += time
        t = np.cumsum(gap, axis=1)
        y = mix(x)
        part = (y & _U(size - 1)).astype(np.int64)
        half = (np.maximum(width, 1).astype(np.int64)).astype(np.uint64)
        place = ((y >> _U(8)) & (half - _U(1))[:, None]).astype(np.int64)
        counted = (level == 0)[:, None] | (width.astype(np.int64)[:, None] + 1 + place <= weight[:, None])
        counted &= t < latest[text][:, None]
        slot = text[:, None] * size + part
        np.minimum.at(earliest, slot[counted], t[counted])
        time = t[:, -1]
        there = np.unique(text)
        latest[there] = earliest.reshape(texts, size)[there].max(axis=1)
        on = time < latest[text]
        key, text, weight, level, width, time = key[on], text[on], weight[on], level[on], width[on], time[on]
        made, turn = made + block, turn + 1
    bits = np.where(np.isinf(earliest), 0.0, earliest).view(np.uint64)
    return (mix(bits) >> _U(32)).astype(np.uint32).reshape(texts, size)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` components, different from band to band."""
    texts, size = signature.shape
    s = signature.reshape(texts, size // rows, rows).astype(np.uint64)
    out = np.zeros((texts, size // rows), np.uint64) + np.arange(size // rows, dtype=np.uint64) * _GOLD
    for k in range(rows):
        out = mix(out ^ s[:, :, k])
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the multiset intersection; each multiset is (ascending values, counts)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    return int(np.minimum(a[1][at[same]], b[1][same]).sum())
