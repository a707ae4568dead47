"""Byte-level BPE over Arrow batches: ids and counts exactly as the tokenizers library gives them.

A text is cut into pre-tokens with array operations, each pre-token is looked
up in a bounded table (by its hash, then compared byte for byte), and only
pre-tokens that a worker hasn't seen are encoded. Texts outside the character classes that the array code knows
(scripts beyond Latin and Cyrillic, rare white space, special strings) go to an
exact slow path whole, so every text has the library's own result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable

import numpy as np

from quillgrid.llm import arrays

_U = np.uint64
#: The pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, BLANK, LETTER, DIGIT, OTHER, UNKNOWN = range(6)


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[9:14] = BLANK
    c[32] = SPACE
    c[28:32] = UNKNOWN
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = LETTER
    c[0x80:0xC0] = LETTER  # continuation bytes; their lead byte decides
    c[0xC0:0x100] = UNKNOWN
    c[0xC3:0xCA] = c[0xD0:0xD2] = LETTER  # U+00C0-U+027F, U+0400-U+047F
    return c


CLASS = _classes()
#: Second bytes after 0xC2 of characters that are neither letters, numbers nor white space.
_LATIN_MARKS = np.zeros(256, bool)
_LATIN_MARKS[[*range(0xA1, 0xAA), *range(0xAB, 0xB2), 0xB4, *range(0xB6, 0xB9), 0xBB, 0xBF]] = True


def pretokens(data: np.ndarray, offs: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(where each pre-token begins, which texts these places are right for)."""
    n, texts = len(data), len(offs) - 1
    if not n:
        return np.zeros(0, np.int64), np.ones(texts, bool)
    c = CLASS[data]
    at = np.flatnonzero(data == 0xC2)
    at = at[at + 1 < n]
    at = at[_LATIN_MARKS[data[at + 1]]]
    c[at] = c[at + 1] = OTHER
    at = np.flatnonzero(data == 0xE2)
    at = at[at + 2 < n]
    at = at[(data[at + 1] == 0x80) & (data[at + 2] >= 0x90) & (data[at + 2] <= 0xA6)]
    c[at] = c[at + 1] = c[at + 2] = OTHER  # U+2010-U+2026: dashes, quotes, dots
    at = np.flatnonzero(data == 0xC3)
    at = at[at + 1 < n]
    c[at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]] = UNKNOWN
    bad = np.flatnonzero(c == UNKNOWN)
    odd = [np.searchsorted(offs, bad, "right") - 1]
    raw = data.tobytes() if specials else b""
    for s in specials:
        k = raw.find(s)
        while k >= 0:
            odd.append(np.searchsorted(offs, [k], "right") - 1)
            k = raw.find(s, k + 1)
    fine = np.ones(texts, bool)
    fine[np.concatenate(odd)] = False

    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    white = c <= BLANK
    before = np.empty(n, np.uint8)
    before[0] = UNKNOWN + 1
    before[1:] = c[:-1]
    before[begin[:n]] = UNKNOWN + 1
    start = np.where(white, before > BLANK, (before != c) & (before != SPACE))
    start[:-1] |= white[:-1] & ~white[1:] & ~begin[1:n]
    p = np.flatnonzero(start & (data == 39))
    if len(p):
        end = offs[np.searchsorted(offs, p, "right")]
        one = np.where(p + 1 < end, data[np.minimum(p + 1, n - 1)], 0)
        two = np.where(p + 2 < end, data[np.minimum(p + 2, n - 1)], 0)
        single = np.isin(one, (115, 116, 109, 100))  # s t m d
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        for which, length in ((single, 2), (double, 3)):
            q, e = p[which], end[which]
            start[q + 1] = False
            q, e = q + length, e
            q = q[q < e]
            start[q] = True
    return np.flatnonzero(start), fine


class Pieces:
    """A bounded table from a pre-token to what ``encode`` gives for it.

    A pre-token is found by its 64-bit hash; the table keeps the bytes of its
    entries, and a hit counts only where they are the same. When it is full,
    entries that no chunk has found again go; most pre-tokens of a large
    collection stand in it once or twice. ``encode`` gets at most ``AT_ONCE``
    pre-tokens in a call, as what a library returns for each is far larger than
    the ids in it.
    """

    AT_ONCE = 4096
    #: Bytes of spellings beyond which a table is full, however few its entries.
    MOST_SPELT = 1 << 24

    def __init__(self, encode: Callable[[list[bytes]], list], bits: int = 20, most: int = 400_000, ids: bool = True):
        self.encode, self.mask, self.most, self.ids = encode, _U(2**bits - 1), most, ids
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.n, self.used, self.spelt = 0, 0, 0
        self.length, self.place = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.size, self.spell_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.hot = np.zeros(1 << 16, bool)  # which entries a chunk has found in the table
        self.pool, self.spelling = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint8)

    def _make_room(self) -> None:
        """Keep the hot entries, at most half of what the table may hold."""
        kept = np.flatnonzero(self.hot[: self.n])[-(self.most // 2) :]
        lengths, sizes, at = self.length[kept], self.size[kept], self.spell_at[kept]
        if not len(kept) or sizes.sum() > self.MOST_SPELT // 2:
            return self.clear()
        hashes = arrays.span_hashes(self.spelling, at, at + sizes) | _U(1)
        body = self.spelling[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        ids = self.all_ids(kept) if self.ids else None
        self.clear()
        self._file(hashes, self._put(lengths, ids, sizes, body))

    def _add(self, raw: list[bytes]) -> np.ndarray:
        """Entries for these pre-tokens; where to find them is the caller's concern."""
        new = []
        for k in range(0, len(raw), self.AT_ONCE):
            some = raw[k : k + self.AT_ONCE]
            found = self.encode(some)
            lengths = np.array([len(x) for x in found] if self.ids else found, np.int32)
            ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())) if self.ids else None
            new.append(self._put(lengths, ids, np.array([len(x) for x in some], np.int64), np.frombuffer(b"".join(some), np.uint8)))
        return np.concatenate(new)

    def _put(self, lengths: np.ndarray, ids: np.ndarray | None, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
        while self.n + len(lengths) > len(self.length):
            self.length, self.place, self.size, self.spell_at, self.hot = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.place, self.size, self.spell_at, self.hot))
        new = np.arange(self.n, self.n + len(lengths), dtype=np.int32)
        self.length[new] = lengths
        if ids is not None:
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.place[new] = self.used + np.cumsum(lengths) - lengths
            self.used += len(ids)
        while self.spelt + len(body) + 8 > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        self.spelling[self.spelt : self.spelt + len(body)] = body
        self.size[new], self.spell_at[new] = sizes, self.spelt + np.cumsum(sizes) - sizes
        self.spelt += len(body)
        self.n += len(lengths)
        return new

    def _file(self, hashes: np.ndarray, new: np.ndarray) -> None:
        first, second = (hashes & self.mask).astype(np.int64), ((hashes >> _U(32)) & self.mask).astype(np.int64)
        slot = np.where(self.keys[first] == 0, first, second)
        self.keys[slot], self.entry[slot] = hashes, new
        clash = self.keys[slot] != hashes  # two of these met in one slot; the later stays
        self.entry[slot[~clash]] = new[~clash]

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each pre-token; valid until the next call."""
        if self.n > self.most or self.spelt > self.MOST_SPELT:
            self._make_room()
        h = arrays.span_hashes(data, starts, ends) | _U(1)
        first = (h & self.mask).astype(np.int64)
        out = self.entry[first]
        miss = np.flatnonzero(self.keys[first] != h)
        if len(miss):
            second = ((h[miss] >> _U(32)) & self.mask).astype(np.int64)
            out[miss] = self.entry[second]
            miss = miss[self.keys[second] != h[miss]]
        found = np.ones(len(out), bool)
        found[miss] = False
        self.hot[out[found]] = True
        raw = None
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = miss[at]
            entries = self._add([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self._file(new, entries)
            out[miss] = entries[back]
        fine = self.size[out] == ends - starts
        fine[fine] = arrays.equal_spans(data, starts[fine], self.spell_at[out[fine]], (ends - starts)[fine], self.spelling)
        wrong = np.flatnonzero(~fine)
        if len(wrong):  # another pre-token has this hash: these get entries of their own, without a place in the table
            raw = raw or data.tobytes()
            own: dict[bytes, list[int]] = {}
            for k in wrong.tolist():
                own.setdefault(raw[starts[k] : ends[k]], []).append(k)
            for entry, places in zip(self._add(list(own)), own.values()):
                out[places] = entry
        return out

    def all_ids(self, entries: np.ndarray) -> np.ndarray:
        lengths = self.length[entries]
        shift = self.place[entries] - (np.cumsum(lengths) - lengths)
        return self.pool[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


_tokenizers: dict[str, object] = {}
_tables: dict[tuple, Pieces] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation or padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def specials(path: str) -> tuple[bytes, ...]:
    return tuple(x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values())


def encode_chunk(path: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, where each text's ids begin, plus the end)."""
    t = tokenizer(path)
    key = ("ids", path)
    if key not in _tables:
        _tables[key] = Pieces(lambda pieces: [e.ids for e in t.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)])
    table = _tables[key]
    starts, fine = pretokens(data, offs, specials(path))
    n = len(offs) - 1
    if not fine.all():
        text = np.searchsorted(offs, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        keep = fine[text]
        starts, ends, text = starts[keep], ends[keep], text[keep]
    else:
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offs, starts, "right") - 1
    entries = table.look(data, starts, ends) if len(starts) else np.zeros(0, np.int32)
    ids = table.all_ids(entries) if len(entries) else np.zeros(0, np.uint32)
    lengths = np.bincount(text, table.length[entries], n).astype(np.int64) if len(starts) else np.zeros(n, np.int64)
    if fine.all():
        return ids, np.concatenate([[0], np.cumsum(lengths)])
    raw, places, parts = data.tobytes(), np.concatenate([[0], np.cumsum(lengths)]), []
    for i in range(n):
        if fine[i]:
            parts.append(ids[places[i] : places[i + 1]])
        else:
            parts.append(np.array(t.encode(raw[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32))
            lengths[i] = len(parts[-1])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


class Merges:
    """Token counts by byte-pair merging with a heap and a linked list; no ids are made for a text.

    The lowest-ranked adjacent pair is popped again and again (ties: the
    leftmost); the count is the number of bytes less the number of merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = self.byte_letters()
        symbol = {c: b for b, c in enumerate(letters)}
        self.first = list(range(256))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            new = symbol.setdefault(a + b, len(symbol))
            self.pairs[symbol[a], symbol[b]] = (rank, new)
        self.special = [x["content"] for x in spec["added_tokens"]]

    @staticmethod
    def byte_letters() -> list[str]:
        """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 is itself, the rest count up from 256."""
        out, more = [], 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                out.append(chr(b))
            else:
                out.append(chr(more))
                more += 1
        return out

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        pairs = self.pairs
        sym = list(piece)
        heap = []
        for i in range(n - 1):
            m = pairs.get((sym[i], sym[i + 1]))
            if m is not None:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            merged += 1
            if k < n:
                left[k] = i
                m = pairs.get((new, sym[k]))
                if m is not None:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = left[i]
            if h >= 0:
                m = pairs.get((sym[h], new))
                if m is not None:
                    heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return n - merged


def _counter(path: str) -> tuple[Merges, Pieces]:
    key = ("count", path)
    if key not in _tables:
        m = Merges(path)
        _tables[key] = (m, Pieces(lambda pieces: [m.count(p) for p in pieces], 21, 1_500_000, ids=False))
    return _tables[key]


def count_text(m: Merges, text: str) -> int:
    """One text on the exact slow path: special strings are one token each, the rest is cut by ``PATTERN``."""
    import regex

    total, rest = 0, [text]
    if m.special:
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(m.special, key=len, reverse=True)) + ")")
        rest = cut.split(text)
    for k, part in enumerate(rest):
        if k % 2:
            total += 1
        else:
            total += sum(m.count(p.encode()) for p in regex.findall(PATTERN, part, flags=regex.V0))
    return total


def count_chunk(path: str, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Tokens of each text."""
    m, table = _counter(path)
    starts, fine = pretokens(data, offs, tuple(s.encode() for s in m.special))
    n = len(offs) - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    text = np.searchsorted(offs, starts, "right") - 1
    if not fine.all():
        keep = fine[text]
        starts, ends, text = starts[keep], ends[keep], text[keep]
    out = np.zeros(n, np.int64)
    if len(starts):
        entries = table.look(data, starts, ends)
        out = np.bincount(text, table.length[entries], n).astype(np.int64)
    raw = data.tobytes() if not fine.all() else b""
    for i in np.flatnonzero(~fine):
        out[i] = count_text(m, raw[offs[i] : offs[i + 1]].decode())
    return out


def library_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["PATTERN", "Merges", "Pieces", "count_chunk", "count_text", "encode_chunk", "library_path", "pretokens", "specials", "tokenizer"]
