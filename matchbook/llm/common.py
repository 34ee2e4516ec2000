"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: An id table of at most this many rows (8 bytes each) may be broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str = "text") -> Column:
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only if it was counted and found within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of a text column (a row at least), so that
    a worker's memory depends on its longest text and not on how many rows Arrow sends."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


class UnitMemory:
    """Encodes texts that fall into units whose ids do not depend on their neighbours: each
    distinct unit is encoded once and remembered; all are forgotten beyond `memory` bytes.

    cuts says of the texts' bytes, one after the other, and their starts where a unit begins;
    learn gives the ids of new units, one after the other, and how many each has."""

    def __init__(self, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], memory: int = 48 << 20):
        self.cuts, self.learn, self.memory = cuts, learn, memory
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.held = 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. An empty text has none."""
        if self.held > self.memory:
            self.forget()
        texts = texts.cast(pa.binary())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = (offsets - offsets[0]).astype(np.int64)
        starts = ends[:-1][ends[:-1] < len(raw)]
        begin = self.cuts(raw, starts)
        begin[starts] = True
        at = np.flatnonzero(begin)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        place, known = self.place, len(self.place)
        of = np.fromiter((place.setdefault(u, len(place)) for u in units.dictionary.to_pylist()), np.int64, len(units.dictionary))
        if len(place) > known:
            new = list(islice(place, known, None))
            ids, counts = self.learn(new)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
            self.held += sum(map(len, new)) + 120 * len(new) + 4 * len(ids)
        order = of[units.indices.to_numpy()]
        begins = self.first[order]
        n = self.first[order + 1] - begins
        upto = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(begins - upto[:-1], n)
        where += np.arange(len(where))
        return self.ids[where], np.diff(upto[np.searchsorted(at, ends)])
