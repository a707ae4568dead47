"""Counts and statistics of whole texts, vectorised over a chunk."""

from __future__ import annotations

import numpy as np

from quillgrid.llm import arrays

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"!?;:,.()[]{}\"'/\\-_=+@^~`")] = True


def _owner_first(owner: np.ndarray, texts: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(texts + 1))


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    Words are runs without white space (space, \\t-\\r), compared as they are. A
    line counts as repeated if it has a word and equals an earlier line; a word
    is in a repeat if a window of three words that it's in occurs twice or more.
    """
    texts, n = len(offs) - 1, len(data)
    dark = arrays.DARK[data]
    starts, ends = arrays.runs(dark, offs)
    firsts = np.searchsorted(starts, offs)
    word = arrays.span_ids(data, starts, ends)
    flag = lambda mask: arrays.per_text(mask.astype(np.int64), offs)
    out = {"n_words": np.diff(firsts), "word_chars": flag(dark & ((data & 0xC0) != 0x80)), "n_symbols": flag(SYMBOLS[data])}

    cut = np.flatnonzero(data == 10)
    line_from = np.unique(np.concatenate([offs[:-1], cut + 1]))
    line_from = line_from[line_from < n]
    # a line feed ends its line; the next text's first line begins at its offset
    line_to = np.minimum(np.append(line_from[1:], n), offs[np.searchsorted(offs, line_from, "right")]) if len(line_from) else line_from
    line_to = line_to - ((line_to > line_from) & (data[np.maximum(line_to - 1, 0)] == 10)) if len(line_from) else line_to
    has_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[has_word], line_to[has_word]
    owner = np.searchsorted(offs, line_from, "right") - 1
    h = arrays.span_ids(data, line_from, line_to)
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][again], minlength=texts).astype(np.int64)
    out["n_lines"] = np.bincount(owner, minlength=texts).astype(np.int64)

    repeated = np.zeros(len(word), bool)
    if len(word) >= 3:
        text = np.repeat(np.arange(texts), np.diff(firsts))
        at = np.flatnonzero(text[:-2] == text[2:])
        own = word.astype(np.uint64)
        w = arrays.mix(own[at] + arrays.mix(own[at + 1] + arrays.mix(own[at + 2] + _U(1))))
        order = np.lexsort((w, text[at]))
        same, place = np.zeros(len(at) + 1, bool), at[order]
        same[1:-1] = (w[order][1:] == w[order][:-1]) & (text[place[1:]] == text[place[:-1]])
        for k in range(3):
            same[1:-1] &= word[place[1:] + k] == word[place[:-1] + k]
        twice = at[order[same[:-1] | same[1:]]]
        for k in range(3):
            repeated[twice + k] = True
    out["n_repeat_words"] = arrays.per_text(repeated.astype(np.int64), firsts)
    return out


STATISTICS = (
    "words", "mean_word_length", "long_word_share", "short_word_share", "distinct_word_share", "repeat_word_share", "dup_line_share", "words_per_line", "line_end_stop_share", "symbol_rate", "punctuation_rate", "bang_rate", "upper_rate", "upper_word_share", "title_word_share",
    "digit_rate", "beyond_ascii_rate", "white_rate", "stop_rate", "adjacent_repeat_share", "lone_mark_share",
)


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The ``STATISTICS`` of each text as doubles; 0 where a text has no words."""
    texts = len(offs) - 1
    base = base_counts(data, offs)
    dark = arrays.DARK[data]
    starts, ends = arrays.runs(dark, offs)
    firsts = np.searchsorted(starts, offs)
    text = np.repeat(np.arange(texts), np.diff(firsts))
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    length = chars[ends] - chars[starts]
    flag = lambda mask: arrays.per_text(mask.astype(np.int64), offs)
    of_words = lambda mask: arrays.per_text(mask.astype(np.int64), firsts)
    w, c = np.maximum(base["n_words"], 1), np.maximum(flag(lead), 1)
    upper = (data >= 65) & (data <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    n_up = ups[ends] - ups[starts]
    hashes = arrays.span_hashes(arrays.LOWER[data], starts, ends)
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    lets = np.concatenate([[0], np.cumsum(letter)])
    stop = np.isin(data, (46, 33, 63))
    nxt = np.zeros(len(data), bool)
    if len(data):
        nxt[:-1] = data[1:] == 10
        nxt[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    lines = np.maximum(base["n_lines"], 1)
    first_up = upper[starts] if len(starts) else np.zeros(0, bool)
    return {
        "words": base["n_words"].astype(float),
        "mean_word_length": base["word_chars"] / w,
        "long_word_share": of_words(length >= 12) / w,
        "short_word_share": of_words(length <= 2) / w,
        "distinct_word_share": np.bincount(text[order][fresh], minlength=texts) / w,
        "repeat_word_share": base["n_repeat_words"] / w,
        "dup_line_share": base["n_dup_lines"] / lines,
        "words_per_line": base["n_words"] / lines,
        "line_end_stop_share": flag(stop & nxt) / lines,
        "symbol_rate": base["n_symbols"] / w,
        "punctuation_rate": flag(_SPECIAL[data]) / w,
        "bang_rate": flag(data == 33) / w,
        "upper_rate": flag(upper) / c,
        "upper_word_share": of_words((n_up >= 2) & (n_up * 2 >= length)) / w,
        "title_word_share": of_words(first_up & (n_up == 1)) / w,
        "digit_rate": flag((data >= 48) & (data <= 57)) / c,
        "beyond_ascii_rate": flag(lead & (data >= 128)) / c,
        "white_rate": flag(~dark) / c,
        "stop_rate": flag(stop) / w,
        "adjacent_repeat_share": of_words(twin) / w,
        "lone_mark_share": of_words(lets[ends] == lets[starts]) / w,
    }
