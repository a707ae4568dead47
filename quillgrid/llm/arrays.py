"""Arrow batches as flat byte arrays, and vectorised words, hashes and shingles.

All functions work on a *chunk*: the UTF-8 bytes of some whole texts end to end
(``data``) and the places where each text begins, plus the end (``offs``). A
chunk holds about ``CHUNK`` bytes, or one longer text, so temporaries stay
bounded by the longest text and never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64

_STEP = _U(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 bytes of a little-endian word.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 512

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text: digits, a-z and all beyond ASCII.
WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
#: [^\x20\x09-\x0D]
DARK = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with the bytes and offsets of ``column``; a null text counts as empty."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, body = texts.buffers()
    offs = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that don't cross a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def padded(data: np.ndarray) -> np.ndarray:
    """A copy of ``data`` with eight spare bytes."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = data
    return out


def strides(spare: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place but the last seven, as unaligned little-endian words."""
    return np.ndarray((len(spare) - 7,), "<u8", spare.data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies.

    Eight bytes are mixed in at a time, each mixed with all before it; spans
    beyond ``_LONG`` bytes go through xxh3. Unequal spans share a hash with a
    chance of 2**-64; where that would give a wrong result, spans are compared
    (``equal_spans``, ``span_ids``).
    """
    import xxhash

    length = ends - starts
    word = strides(padded(data))
    h = mix(length.astype(np.uint64) * _STEP + _STEP)
    many = np.flatnonzero((length > 0) & (length <= _LONG))
    at, left, own = starts[many], length[many], h[many]
    while len(many):
        own = mix(own ^ (word[at] & _FRONT[np.minimum(left, 8)])) + _STEP
        h[many] = own
        on = left > 8
        many, at, left, own = many[on], at[on] + 8, left[on] - 8, own[on]
    for k in np.flatnonzero(length > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return mix(h)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` of ``data`` and at ``b`` of ``other`` are the same.

    ``other`` is ``data`` by default; one that is given has eight spare bytes at its end.
    """
    left = strides(padded(data))
    right = left if other is None else strides(other)
    same = np.ones(len(a), bool)
    many = np.flatnonzero((length > 0) & (length <= _LONG))
    a_, b_, n = a[many], b[many], length[many]
    while len(many):
        keep = _FRONT[np.minimum(n, 8)]
        same[many] &= (left[a_] & keep) == (right[b_] & keep)
        on = n > 8
        many, a_, b_, n = many[on], a_[on] + 8, b_[on] + 8, n[on] - 8
    body = data if other is None else other
    for k in np.flatnonzero(length > _LONG).tolist():
        same[k] = np.array_equal(data[a[k] : a[k] + length[k]], body[b[k] : b[k] + length[k]])
    return same


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal for two spans exactly if their bytes are equal."""
    _, first, ids = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    length = ends - starts
    fine = length == length[first][ids]
    fine[fine] = equal_spans(data, starts[fine], starts[first][ids][fine], length[fine])
    if not fine.all():  # spans that share a hash with another one
        own: dict[bytes, int] = {}
        for k in np.flatnonzero(~fine).tolist():
            ids[k] = len(first) + own.setdefault(data[starts[k] : ends[k]].tobytes(), len(own))
    return ids


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = WORD, lower: bool = True):
    """(starts, ends, hashes, index of each text's first word) of the chunk's words."""
    starts, ends = runs(inside[data], offs)
    return starts, ends, span_hashes(LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offs)


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _STEP) | _U(1)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and the text of each.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    parts, owners = [], []
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += hashes[k : n - size + 1 + k] * _PLACE[k]
        whole = text[: n - size + 1] == text[size - 1 :]
        parts.append(total[whole])
        owners.append(text[: n - size + 1][whole])
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[firsts[t] : firsts[t + 1]]
        parts.append((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True))
        owners.append(np.array([t]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return mix(np.concatenate(parts))[order], owner[order]


def per_text(values: np.ndarray, owner_first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` for each text; ``owner_first`` has where each text's values begin, plus the end."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return sums[owner_first[1:]] - sums[owner_first[:-1]]
