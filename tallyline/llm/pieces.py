"""Fast splitting of texts into cached pieces for byte-level vocabularies.

Before a space that a non-space follows, the tokenizers' split pattern always starts a new match, whatever stands before. A text can
therefore be cut there, each distinct piece split and encoded once, and the text's result put together from the pieces'. Texts in which
a space is followed by other white space or ends the text take the whole pattern instead; results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Distinct pieces kept by one worker, unless its ``cached`` is set. Half of them are the newer: when these are full, they become the older, whose
#: pieces stay if they come up again.
CACHED = 600_000

#: Below this character, Python's letters and the pattern's are the same in every version of Unicode.
PLAIN = "\u0250"


class Irregular(Exception):
    """A piece that can't be cut off on its own."""


class Pieces(dict):
    """text -> the encoder's value of each of its pieces, in order; values are looked up by piece. A match of the pattern is a piece too."""

    def __init__(self, pattern: str, encode: Callable[[str], object], join: Callable[[list], object]):
        super().__init__()
        self.find, self.encode, self.join = regex.compile(pattern).findall, encode, join
        self.spaces: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.cached = CACHED

    def value(self, match: str) -> object:
        """Of one match of the pattern."""
        cache = self.spaces if match.isspace() else self
        found = cache.get(match)
        if found is None:
            found = self.older.get(match)
            if found is None:
                found = self.encode(match)
            if len(match) <= 64:
                cache[match] = found
        return found

    def __missing__(self, piece: str) -> object:
        found = self.older.get(piece)
        if found is not None:
            self[piece] = found
            return found
        start = piece[0] == " "
        if start and piece[1:2].isspace() or piece == " ":
            raise Irregular
        plain = piece.isascii() or max(piece) < PLAIN
        if plain and piece[start:].isalpha():
            found = self.encode(piece)
        elif plain and piece[-1] in ",." and piece[start:-1].isalpha():
            found = self.join([self.value(piece[:-1]), self.value(piece[-1])])
        else:
            found = self.join([self.value(m) for m in self.find(piece)])
        if len(piece) <= 64:
            self[piece] = found
        return found

    def values_of(self, text: str) -> list:
        """Values whose join is the text's."""
        if len(self) >= self.cached // 2:
            self.older = dict(self)
            self.clear()
        if not text:
            return []
        if "\0" not in text:
            try:
                return [self[p] for p in text.replace(" ", "\0 ").split("\0") if p]
            except Irregular:
                pass
        return [self.value(m) for m in self.find(text)]
