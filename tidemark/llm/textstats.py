"""Counts over texts and lines that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm import textkernel as tk

#: Common function words of English, French, German and Spanish.
FUNCTION_WORDS = sorted(set("""
the of and to in a is that it as was for on are by be with this from at or an not have which but
le la les de des du et un une en est que qui dans pour pas sur au par plus ce il elle
der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an
el los las y del se un una por con no para su al lo como esta pero que
""".split()))

_table = lambda text: np.isin(np.arange(256), np.frombuffer(text.encode(), np.uint8))
UPPER, LOWER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
SYMBOL, PIPE, END = _table("#$%&*@^~<>{}[]\\=+_"), _table("|"), _table(".!?:;\"')")
SHOUT = _table("!")
LEAD = ~((np.arange(256) >= 128) & (np.arange(256) < 192))  # first bytes of characters
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Stats:
    """Line by line counts for a slice of texts; sum them over lines for whole texts."""

    def __init__(self, col: pa.Array):
        self.lines = lines = tk.Lines(col)
        data, start, end = lines.data, lines.start, lines.end
        sums = lambda mask: tk.group_sums(mask[data], start, end).astype(np.float64)
        self.rows, self.row, self.blank = len(lines.ptr) - 1, lines.row(), lines.blank
        self.chars, self.upper, self.lower, self.digit = sums(LEAD), sums(UPPER), sums(LOWER), sums(DIGIT)
        self.symbol, self.pipe, self.shout = sums(SYMBOL), sums(PIPE), sums(SHOUT)
        last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
        self.ends = END[last] & ~self.blank if len(end) else np.zeros(0, bool)
        self.hash = lines.hashes()
        folded = FOLD[data]
        words = tk.Words(None, data=(folded, np.append(lines.raw_start, len(data))))
        self.words, self.word_hash, self.word_ptr = np.diff(words.ptr).astype(np.float64), words.hash, words.ptr
        same = np.zeros(len(words.hash), bool)
        if len(same):
            same[1:] = words.hash[1:] == words.hash[:-1]
            same[words.ptr[:-1][np.diff(words.ptr) > 0]] = False
        self.echo = self._over(same)
        self.function = self._over(np.isin(words.hash, tk.hash_words(FUNCTION_WORDS)))
        self.word_bytes = self._over(words.end - words.start)
        order = np.lexsort((self.hash, self.row))
        h, r = self.hash[order], self.row[order]
        twin = np.zeros(len(h) + 1, bool)
        twin[1:-1] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        self.repeated, self.later = np.zeros(len(h), bool), np.zeros(len(h), bool)
        self.repeated[order], self.later[order] = twin[1:] | twin[:-1], twin[:-1]
        self.repeated &= ~self.blank
        self.later &= ~self.blank

    def _over(self, per_word: np.ndarray) -> np.ndarray:
        total = np.zeros(len(per_word) + 1)
        np.cumsum(per_word, out=total[1:])
        return total[self.word_ptr[1:]] - total[self.word_ptr[:-1]]

    def text(self, per_line: np.ndarray) -> np.ndarray:
        """Sum over the lines of each text."""
        return np.bincount(self.row, weights=per_line, minlength=self.rows)
