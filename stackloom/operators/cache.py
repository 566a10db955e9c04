"""A table kept between reads for as long as its fingerprint stays the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.operators import catalog
from stackloom.sources.store import Library


class Cached:
    """``read()``, persisted; read anew once ``fingerprint()`` differs, as another process may write between two reads.

    The fingerprint should be small: it is taken before every use.  What is persisted stays on the executors' disks where memory is short,
    and is computed again by its lineage where an executor is lost.
    """

    def __init__(self, read: Callable[[], DataFrame], fingerprint: Callable[[], object]):
        self._read, self._fingerprint = read, fingerprint
        self._seen: object = None
        self._table: DataFrame | None = None

    def get(self, force: bool = False) -> DataFrame:
        now = self._fingerprint()
        if force or self._table is None or now != self._seen:
            self.close()
            self._seen, self._table = now, self._read().persist(StorageLevel.MEMORY_AND_DISK)
        return self._table

    def close(self) -> None:
        """Lets the persisted table go."""
        if self._table is not None:
            self._table.unpersist()
            self._table = None


def vectors(library: Library, dim: int) -> Cached:
    """The chunks with a vector of ``dim`` numbers, kept while the documents embedded and the last time of indexing are the same."""
    read = lambda: library.chunks.read().filter(F.size("embedding") == dim)
    return Cached(read, lambda: tuple(catalog.fingerprint(library.meta.read()).first()))
