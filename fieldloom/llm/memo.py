"""A cache of bounded size for values that a worker derives from short texts."""

from __future__ import annotations

#: Entries in one of a cache's two generations, and the longest key it keeps; they bound a worker's memory, not the result.
GENERATION, LONGEST = 300_000, 64


class Memo:
    """Values by key for at most two generations; what is asked for again moves to the younger."""

    def __init__(self, make, generation: int | None = None):
        self.make, self.generation, self.young, self.old = make, generation or GENERATION, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(key) <= LONGEST:
                if len(self.young) >= self.generation:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found
