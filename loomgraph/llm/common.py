"""What several text operators share: word splitting, digests, bounded memos and temporary column names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from contextlib import suppress
from itertools import islice
from sys import getsizeof
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and maps ASCII bytes that are neither letters nor digits to a space.
LOWER_ALNUM = bytes(LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, as UTF-8; bytes.split() splits on just these six."""
    return text.encode().split() if text else []


class Memo:
    """A function's results, in ``limit`` bytes at most.

    Once it is full, an eighth of it goes, what came first before the rest; what is still used comes back by one more computation. So
    memory stays bounded, however long the keys are. What would fill a large part alone is computed anew each time. The function must not return None.
    """

    #: Bytes of an entry's place in the table, and the part of all that one entry may have.
    PLACE, PART = 100, 128

    def __init__(self, compute: Callable[[Any], Any], limit: int = 64 << 20):
        self.compute, self.limit = compute, limit
        self.room = limit
        self.known: dict = {}

    def __getitem__(self, key: Any) -> Any:
        value = self.known.get(key)
        return self.missed(key) if value is None else value

    def missed(self, key: Any) -> Any:
        value = self.compute(key)
        size = self.PLACE + getsizeof(key) + getsizeof(value)
        if size * self.PART <= self.limit:
            if size > self.room:
                for k in list(islice(self.known, len(self.known) // 8 + 1)):
                    self.room += self.PLACE + getsizeof(k) + getsizeof(self.known.pop(k))
            self.room -= size
            self.known[key] = value
        return value

    def many(self, keys: list) -> list:
        """The results of all keys, in their order."""
        out = list(map(self.known.get, keys))
        if None in out:
            at = -1
            with suppress(ValueError):  # there is no further None
                while True:
                    at = out.index(None, at + 1)
                    out[at] = self[keys[at]]  # a key may come twice
        return out


_HELD: dict = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the worker's later tasks until another key is asked for.

    Workers outlive an operator, so each holds the tables and memos of one at a time. Running tasks keep their own.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # what the last one freed goes back to the system, where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows that go to Python at once, at most. Spark's own number, 10,000, is for narrow rows; here they are texts.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Just these columns under the keys' names; a column that has a dot or quote in its name is found too.

    Where operators on texts begin, so it also sets the session's number of rows in a batch, unless that is lower already.
    """
    if not 0 < int(df.sparkSession.conf.get(_BATCH)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    quoted: Iterable[Column] = (F.col(f"`{c.replace('`', '``')}`").alias(k) for k, c in columns.items())
    return df.select(*quoted)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % folds).cast("int"), F.lit(-1))
