"""Tokens of many pages at once: one pass of one pattern, then arrays.

Words, runs of digits, of template marks and of dots, and line breaks. The
classifier of problem 6 and the languages of problem 3 read the same tokens.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|\d+|[{}<>%$\[\]@#=|\\]+|[.:;/]{2,}|\n")
#: Distinct tokens remembered by a worker.
REMEMBERED = 400_000


class Vocabulary(dict):
    """Token -> number; arrays give each number's hash (digits count only by their number), whether it is a word, and what `row` says of it."""

    def __init__(self, row=None):
        super().__init__()
        self.row = row
        self.clear()

    def clear(self):
        super().clear()
        self._hash, self._word, self._row = [], [], []
        self["\n"]  # number 0

    def __missing__(self, t: str) -> int:
        k = self[t] = len(self._hash)
        self._hash.append(zlib.crc32(("0" * len(t) if t.isdigit() else t).encode("utf-8", "surrogatepass")) & 0x7FFFFFFF)
        self._word.append(t[0].isalpha())
        self._row.append(self.row(t) if self.row and t[0].isalpha() else -1)
        return k

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, is a word, row) by number."""
        return np.array(self._hash, np.int64), np.array(self._word, bool), np.array(self._row, np.int64)


class Tokens:
    """The tokens of texts that are lists of lines: `line` numbers the lines of all texts, `first` has the number of each text's first line (and, last, their total)."""

    def __init__(self, texts: list[list[str]], vocabulary: Vocabulary):
        if len(vocabulary) > REMEMBERED:
            vocabulary.clear()
        found = TOKEN.findall("\n".join([x for t in texts for x in t] + [""]).lower())
        number = np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found))
        self.hash, self.word, self.row = (a[number] for a in vocabulary.arrays())
        ends = number == 0
        self.line = np.cumsum(ends) - ends
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
