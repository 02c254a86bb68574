"""Cutting a text at spaces where no token can cross, and bounded caches of what the pieces between them become."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# A space before a non-space begins a pre-token of the byte-level pattern, whatever stands before it.
_BEFORE_WORD = re.compile(r" (?=\S)")
# In piece vocabularies runs of spaces belong to what follows: only a single space between two others is a cut.
_SINGLE = re.compile(r"(?<=[^ ]) (?=[^ ])")
_NOT_SINGLE = re.compile(r"^ |  | $")
_SPACE_RUN = re.compile(r" (?:\s|$)")


def byte_units(text: str) -> list[str]:
    """Units of a byte-level vocabulary; all but the first are preceded by one space."""
    return _BEFORE_WORD.split(text) if _SPACE_RUN.search(text) else text.split(" ")


def piece_units(text: str) -> list[str]:
    """Units of a piece vocabulary, each preceded by one space or the dummy prefix."""
    return _SINGLE.split(text) if _NOT_SINGLE.search(text) else text.split(" ")


class UnitCache(dict):
    """Unit to value. ``fill`` computes many at once; ``fixed`` entries stay, others go when the limit is reached."""

    def __init__(self, make: Callable[[list[str]], Iterable], fixed: dict | None = None, limit: int = 400_000):
        super().__init__(fixed or {})
        self.make, self.fixed, self.limit = make, fixed or {}, limit

    def fill(self, lists: Iterable[list[str]]) -> None:
        """Make sure that every unit of ``lists`` is here until the next call."""
        wanted = set().union(*lists) if not isinstance(lists, set) else lists
        missing = list(wanted.difference(self))
        if len(self) + len(missing) > self.limit + len(self.fixed):
            self.clear()
            self.update(self.fixed)
            missing = list(wanted.difference(self))
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            self.update(zip(some, self.make(some), strict=True))
