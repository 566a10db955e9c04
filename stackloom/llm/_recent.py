"""A bounded dict of values that a worker keeps over its tasks."""

from __future__ import annotations

#: Longer keys are never kept, so entries of a few hundred bytes each bound a cache in bytes.
LONGEST = 64


class Recent:
    """Two generations of at most ``limit`` entries each, with keys of ``LONGEST`` characters at most.

    Entries that no batch has asked for while ``limit`` newer ones came are forgotten.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that have no entry; the others are young entries from now on."""
        new = keys - self.young.keys()
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, set(keys)
        again = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        return new - again

    def trim(self) -> None:
        """Forget what only the batch just done needed: entries of long keys, and all if it had more than the limit."""
        for k in [k for k in self.young if len(k) > LONGEST]:
            del self.young[k]
        if len(self.young) > self.limit:
            self.young = {}
