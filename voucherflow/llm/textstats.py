"""Counts over one text, as UTF-8 bytes; shared by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
ONE_SYMBOL = bytes(35 if b in SYMBOLS else b for b in range(256))
TAILS = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
UPPER, LOWER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
MARKS = b".,;:!?'\"()-"
ENDS = (b".", b"!", b"?", b'"', b":")


def among(text: bytes, some: bytes) -> int:
    """How many bytes of the text are among these."""
    return len(text) - len(text.translate(None, some))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.sort(g)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
    hit = twice[at] == g
    inside = np.zeros(n, bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def stats(text: bytes) -> dict[str, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    points = len(text) - among(text, TAILS)
    seen = set(words)
    marked = text.translate(ONE_SYMBOL)
    return {
        "n_chars": points,
        "n_words": len(words),
        "word_chars": points - among(text, SPACE),
        "n_symbols": among(text, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_distinct": len(seen),
        "n_upper": among(text, UPPER),
        "n_lower": among(text, LOWER),
        "n_digit": among(text, DIGIT),
        "n_marks": among(text, MARKS),
        "n_shouts": text.count(b"!"),
        "n_bars": text.count(b"|"),
        "n_stops": text.count(b".") + text.count(b"?") + text.count(b"!"),
        "n_ended_lines": sum(x.rstrip().endswith(ENDS) for x in lines),
        "n_symbol_runs": marked.count(b"###"),
        "n_symbol_ends": marked.count(b"# ") + marked.count(b"#\n"),
        "longest_word": max(map(len, seen), default=0),
        "longest_line": max(map(len, lines), default=0),
    }
