"""A bounded memory of results that many texts share."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """Remembers ``compute``'s results for strings, in two generations.

    ``compute`` takes a list of distinct strings and returns their values, none of them None. When
    the young generation holds ``limit`` entries it becomes the old one, and only what is asked for
    again moves back; so at most about twice ``limit`` entries and one text's own parts are held.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 150_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def many(self, keys: list) -> list:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        unseen = []
        for key in set(keys).difference(self.young):
            value = self.old.get(key)
            if value is None:
                unseen.append(key)
            else:
                self.young[key] = value
        if unseen:
            self.young.update(zip(unseen, self.compute(unseen), strict=True))
        return list(map(self.young.__getitem__, keys))
