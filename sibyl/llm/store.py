"""Sorted arrays of 64-bit keys with values, in the shared folder, memory-mapped by the workers.

A store is cut by key range: file i holds the keys from bounds[i] on. Look-ups sort their keys first, so that each file is
walked forward once and only the pages that hold wanted keys are read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np

from .common import local_path, put_file

#: Files that a worker keeps mapped at once.
MOST_OPEN = 2_000
#: Odd constants of a 64-bit mixing function.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Range of an unsigned key: its top 32 bits, scaled to the number of shards."""
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def put_arrays(folder: str, shard: int, arrays: list[np.ndarray]) -> None:
    """Writes one shard: sorted keys, then the values in that order."""
    head = np.array([len(arrays), len(arrays[0])], np.int64).tobytes()
    put_file(os.path.join(local_path(folder), f"keys-{shard:06d}"), head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


@dataclass
class Store:
    """Shards 0 to shards - 1 of a folder; kinds: the numpy types of the values."""

    folder: str
    shards: int
    kinds: tuple[str, ...]
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "shards": self.shards, "kinds": self.kinds, "_maps": {}}

    def _arrays(self, shard: int) -> list[np.ndarray] | None:
        if shard not in self._maps:
            while len(self._maps) >= MOST_OPEN:  # the longest open is closed: no view of it outlives find()
                del self._maps[next(iter(self._maps))]
            path = os.path.join(local_path(self.folder), f"keys-{shard:06d}")
            self._maps[shard] = None
            if os.path.exists(path):
                data = np.memmap(path, np.uint8, "r")
                n, at, out = int(data[8:16].view(np.int64)[0]), 16, []
                for kind in ("u8", *self.kinds):
                    size = np.dtype(kind).itemsize * n
                    out.append(data[at : at + size].view(kind))
                    at += size
                self._maps[shard] = out
        return self._maps[shard]

    def find(self, keys: np.ndarray, shard: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of each key, 0 where it is not there. shard: the keys' shards, of a store that is not cut by key range."""
        order = np.argsort(keys)
        if shard is not None:
            order = order[np.argsort(shard[order], kind="stable")]
        ordered = keys[order]
        first = runs(ordered)
        wanted, some = ordered[first], order[first]
        where = shard_of(wanted, self.shards).astype(np.int64) if shard is None else shard[some]
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        got = [np.zeros(len(wanted), k) for k in self.kinds]
        for a, e in zip(starts := runs(where), np.append(starts, len(where))[1:], strict=True):
            arrays = self._arrays(int(where[a]))
            if arrays is None or not len(arrays[0]):
                continue
            part = wanted[a:e]
            at = np.minimum(np.searchsorted(arrays[0], part), len(arrays[0]) - 1)
            there = arrays[0][at] == part
            for g, x in zip(got, arrays[1:], strict=True):
                g[a:e][there] = x[at[there]]
        return [g[back] for g in got]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def build(df, name: str, shards: int) -> Store:
    """A store from a table: its first column is the key (long), the others are values (long). Keys must be distinct; they are mixed, so look them up by mix(key)."""
    from pyspark.sql import functions as F

    from .common import new_folder

    names = df.columns
    folder, kinds = new_folder(df.sparkSession, name), ("i8",) * (len(names) - 1)

    def route(batches):
        import pyarrow as pa

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(mix(key), shards).astype(np.int32)), *b.columns], ["shard", *names])

    def put(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            shard = b.column(0).to_numpy(zero_copy_only=False)
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            for s in np.unique(shard):
                held.setdefault(int(s), []).append([c[shard == s] for c in columns])
        for s in sorted(held):
            columns = [np.concatenate(c) for c in zip(*held.pop(s), strict=True)]
            key = mix(columns[0].view(np.uint64))
            order = np.argsort(key)
            put_arrays(folder, s, [key[order], *[c[order] for c in columns[1:]]])
            yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64())], ["n"])

    columns = ", ".join(f"`{c}` long" for c in names)
    df.select(*[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(route, f"shard int, {columns}").repartitionById(shards, "shard").mapInArrow(put, "n long").agg(F.sum("n")).first()
    return Store(folder, shards, kinds)
