"""A bounded memo for the results of pure functions of short strings."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from typing import Any


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make`` and keeps it.

    It is emptied when it holds ``limit`` keys, and keys longer than ``longest`` are never
    kept, so its memory is bounded. Results never depend on what it holds.
    """

    def __init__(self, make: Callable[[Any], Any], limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: Hashable) -> Any:
        value = self.make(key)
        if not isinstance(key, (str, bytes)) or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value

    def all(self, keys: Iterable) -> Iterable:
        return map(self.__getitem__, keys)


class AgingMemo(Memo):
    """A memo that, when full, forgets only what was not asked for since it was last full."""

    def __init__(self, make: Callable[[Any], Any], limit: int = 1_000_000, longest: int = 64):
        super().__init__(make, limit, longest)
        self.old: dict = {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, (str, bytes)) or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
