"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary is a SentencePiece BPE model whose pieces never cross from a
non-blank to a blank, so a text falls into units (blanks, then non-blanks), and equal
units of a batch are encoded once. The batch's distinct units are concatenated and
their suffixes sorted (as far as the longest piece), INDEX characters at a time, a longer
unit in windows that overlap by the longest piece; every piece is looked up by
binary search, which gives all places where it occurs as one range. The occurrences
are edges over the text, sorted by position. They are then relaxed in the model's own
order: again and again the edge with the best score (leftmost on ties) that spans
exactly two current symbols of its unit joins them: in many units side by side. A unit of
more than LONG_UNIT characters (texts without blanks) is cut where no edge crosses, and in
each stretch all edges are joined at once that no other can forestall. A shortest path by
score would differ from the model, so that order is kept; the ids equal the library's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import UnitMemory, slices, whole_text

BLANK = "▁"
#: Characters indexed at once, of units that are relaxed side by side, and of long units relaxed at once.
INDEX, LONG_UNIT, STRETCH = 1 << 17, 64, 1 << 16


@dataclass
class Pieces:
    """text and score of every id; which ids are bytes, which are control or unknown."""

    text: list[str]
    score: np.ndarray
    byte_id: list[int]
    silent: frozenset[int]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_id = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
        silent = frozenset(i for i in range(n) if sp.is_control(i))
        return cls([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), byte_id, silent, sp.unk_id())

    def __post_init__(self) -> None:
        special = {*self.byte_id, *self.silent, self.unknown}
        normal = [i for i in range(len(self.text)) if i not in special]
        self.id_of = {self.text[i]: i for i in normal}
        alphabet = sorted({c for i in normal for c in self.text[i]})
        self.other = len(alphabet) + 1
        self.code = np.full(0x110000, self.other, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.full(self.other + 1, -1, np.int64)
        for k, c in enumerate(alphabet):
            self.single[k + 1] = self.id_of.get(c, -1)
        joined = [i for i in normal if len(self.text[i]) > 1]
        joined.sort(key=lambda i: (-self.score[i], i))
        self.ids = np.array(joined, np.int64)  # by rank
        self.lengths = np.array([len(self.text[i]) for i in joined], np.int64)
        self.width = -(-int(self.lengths.max(initial=1)) // 4)
        rows = np.zeros((len(joined), 4 * self.width), np.uint64)
        for r, i in enumerate(joined):
            rows[r, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]
        self.low = _pack_rows(rows, self.width)
        for r, n in enumerate(self.lengths):
            rows[r, n:] = 0xFFFF
        self.high = _pack_rows(rows, self.width)
        raw = [b"" if i in self.silent else b" \xe2\x81\x87 " if i == self.unknown else self.text[i].replace(BLANK, " ").encode() for i in range(len(self.text))]
        for b, i in enumerate(self.byte_id):
            raw[i] = bytes([b])
        # once more as the first piece of a text: without the blank that encoding put before it
        self.raw = pa.array(raw + [r.removeprefix(b" ") if t.startswith(BLANK) else r for r, t in zip(raw, self.text, strict=True)], pa.binary())


def _pack_rows(rows: np.ndarray, width: int) -> list[np.ndarray]:
    return [rows[:, 4 * w] << np.uint64(48) | rows[:, 4 * w + 1] << np.uint64(32) | rows[:, 4 * w + 2] << np.uint64(16) | rows[:, 4 * w + 3] for w in range(width)]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted key the number of sorted suffixes before it (right: or equal to it)."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        before, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, w in zip(keys, wanted, strict=True):
            a, b = k[mid], w[open_]
            before |= same & (a < b)
            same &= a == b
        up = before | same if right else before
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
    return lo


def _edges(codes: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(start, rank) of every occurrence of every piece of two or more characters, by start."""
    if len(codes) <= INDEX:
        return _window_edges(codes, v)
    found = [(a, _window_edges(codes[a : a + INDEX + 4 * v.width], v)) for a in range(0, len(codes), INDEX)]
    kept = [(start[start < INDEX] + np.int32(a), rank[start < INDEX]) for a, (start, rank) in found]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _window_edges(codes: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([codes, np.zeros(4 * v.width + 4, np.uint16)]).astype(np.uint64)
    n = len(codes)
    four = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
    keys = [four[4 * w : 4 * w + n] for w in range(v.width)]
    # sorted by four characters, then by twice as many until the longest piece is covered
    sorted_by, known = four[:n], 4
    while True:
        suffixes = np.argsort(sorted_by)
        known *= 2
        if known >= 8 * v.width:
            break
        ahead = sorted_by[suffixes]
        place = np.zeros(n + known, np.uint64)
        place[suffixes] = np.cumsum(np.concatenate([[False], ahead[1:] != ahead[:-1]])).astype(np.uint64)
        place[:n] += np.uint64(1)
        sorted_by = place[:n] << np.uint64(32) | place[known // 2 : n + known // 2]
    keys = [k[suffixes] for k in keys]
    first, end = _bound(keys, v.low, False), _bound(keys, v.high, True)
    found = end - first
    rank = np.repeat(np.arange(len(found), dtype=np.int32), found)
    at = np.repeat(first - (np.cumsum(found) - found), found)
    at += np.arange(len(rank))
    start = suffixes[at].astype(np.int32)
    order = np.argsort(start)
    return start[order], rank[order]


def _merged(codes: np.ndarray, unit: np.ndarray, long: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Relaxes the edges of all units. long: the starts and ends of the long ones. Gives the
    starts of the symbols that remain and the id of each (-1 where a character is no piece)."""
    start, rank = _edges(codes, v)
    end = start + v.lengths[rank].astype(np.int32)
    symbol = v.single[codes]
    nxt = np.arange(1, len(codes) + 2)
    alive = np.ones(len(codes) + 1, bool)
    if len(long):
        of_long = np.zeros(len(start), bool)
        for a, b in long.tolist():
            i, j = np.searchsorted(start, [a, b])
            of_long[i:j] = True
        if len(codes) <= 4 * STRETCH:  # many units, which no edge leaves, at once
            _relaxed_alone(start[of_long], end[of_long], rank[of_long], v, nxt, alive, symbol)
        for a, b in long.tolist() if len(codes) > 4 * STRETCH else ():
            i, j = np.searchsorted(start, [a, b])
            cuts = _stretches(start[i:j] - a, end[i:j] - a, b - a)
            for c, d in zip(cuts, cuts[1:]):
                x, y = i + np.searchsorted(start[i:j], [a + c, a + d])
                # boundaries are counted from the stretch, as are those that its edges name
                after, there, ids = np.arange(1, d - c + 2), np.ones(d - c + 1, bool), symbol[a + c : a + d]
                _relaxed_alone(start[x:y] - (a + c), end[x:y] - (a + c), rank[x:y], v, after, there, ids)
                nxt[a + c : a + d], alive[a + c : a + d] = after[:-1] + (a + c), there[:-1]
        start, end, rank = start[~of_long], end[~of_long], rank[~of_long]
    while len(start):
        middle = nxt[start]
        # an edge whose end or start is no boundary any more, or that is joined, is over
        useful = alive[start] & alive[end] & (middle < end)
        start, end, rank, middle = start[useful], end[useful], rank[useful], middle[useful]
        ready = np.flatnonzero(nxt[middle] == end)
        if not len(ready):
            break
        of = unit[start[ready]]
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best = np.minimum.reduceat(rank[ready].astype(np.int64) << 32 | np.arange(len(ready)), begins) & 0xFFFFFFFF
        chosen = ready[best]
        s = start[chosen]
        alive[middle[chosen]] = False
        nxt[s] = end[chosen]
        symbol[s] = v.ids[rank[chosen]]
    left = np.flatnonzero(alive[:-1] & (codes > 0))
    return left, symbol[left]


def _relaxed_alone(start: np.ndarray, end: np.ndarray, rank: np.ndarray, v: Pieces, nxt: np.ndarray, alive: np.ndarray, symbol: np.ndarray) -> None:
    """Relaxes the edges (by start) of a stretch that no edge leaves, many joins a round. Sets
    its parts of nxt, alive and symbol; nxt and alive have one entry more than the stretch.

    An edge that spans two current symbols is ready; its key is (rank, start). The model
    joins the ready edge of the least key. An edge of more symbols is joined no sooner than
    the least ready edge inside it: its bound is the greater of that key and its own; one
    without is over. So a ready edge can be joined at once if no edge over one of its ends
    has a lower bound, and if the same holds for the ends of all larger edges of lower keys
    around it, which its join may make ready. The least ready edge always can. Ready edges of
    one piece that overlap in a chain (runs of a character) are joined alternately.
    """
    never = np.iinfo(np.int64).max
    start, end = start.astype(np.int64), end.astype(np.int64)
    key = rank.astype(np.int64) << 32 | start
    while len(start):
        middle = nxt[start]
        useful = alive[start] & alive[end] & (middle < end)
        start, end, key, middle = start[useful], end[useful], key[useful], middle[useful]
        spans_two = nxt[middle] == end
        ready, wide = np.flatnonzero(spans_two), np.flatnonzero(~spans_two)
        if not len(ready):
            break
        s, m, e, k = start[ready], middle[ready], end[ready], key[ready]
        ready_end, ready_key, over = (np.full(len(nxt), never) for _ in range(3))
        ready_end[s], ready_key[s], over[m] = e, k, k
        # the least and greatest ready edge inside each wider one
        w_start, w_end, w_key = start[wide], end[wide], key[wide]
        least, most = np.full(len(wide), never), np.full(len(wide), -1)
        at, of = w_start, np.arange(len(wide))
        while len(of):
            inside = ready_end[at] <= w_end[of]
            found, held = ready_key[at[inside]], of[inside]
            least[held] = np.minimum(least[held], found)
            most[held] = np.maximum(most[held], found)
            at = nxt[at]
            more = at < w_end[of]
            at, of = at[more], of[more]
        open_ = most >= 0
        wide, w_start, w_end, w_key, least, most = wide[open_], w_start[open_], w_end[open_], w_key[open_], least[open_], most[open_]
        bound = np.maximum(w_key, least)
        wider_over = np.full(len(nxt), never)
        at, of = nxt[w_start], np.arange(len(wide))
        while len(of):
            np.minimum.at(wider_over, at, bound[of])
            at = nxt[at]
            more = at < w_end[of]
            at, of = at[more], of[more]
        both = np.minimum(wider_over, over)
        ends_bound = np.minimum(both[w_start], both[w_end])
        waits = np.zeros(len(nxt), bool)
        of = np.flatnonzero((w_key < most) & (ends_bound < most))
        at = w_start[of]
        while len(of):
            hit = (ready_end[at] <= w_end[of]) & (ready_key[at] > w_key[of]) & (ready_key[at] > ends_bound[of])
            waits[at[hit]] = True
            at = nxt[at]
            more = at < w_end[of]
            at, of = at[more], of[more]
        left, own = over[s] >> 32, k >> 32
        sound = (k <= wider_over[s]) & (k <= wider_over[e]) & (k <= over[e]) & ~waits[s] & (own <= left)
        place = np.arange(len(ready))
        head = np.maximum.accumulate(np.where(left != own, place, 0))
        even = (place - head) % 2 == 0
        failed = np.cumsum(even & ~sound)
        chosen = even & sound & (failed == failed[head])
        # a chain whose head fails has failed[head] counted already
        chosen &= sound[head]
        alive[m[chosen]] = False
        nxt[s[chosen]] = e[chosen]
        symbol[s[chosen]] = v.ids[own[chosen]]
        left_over = np.zeros(len(start), bool)
        left_over[ready[~chosen]] = True
        left_over[wide] = True
        start, end, key = start[left_over], end[left_over], key[left_over]


def _stretches(start: np.ndarray, end: np.ndarray, size: int) -> list[int]:
    """Boundaries that no edge covers, about STRETCH characters apart where there are such."""
    covered = np.zeros(size + 1, np.int32)
    np.add.at(covered, start + 1, 1)
    np.subtract.at(covered, end, 1)
    free = np.flatnonzero(np.cumsum(covered) == 0)
    free = free[(free > 0) & (free < size)]
    picked = np.searchsorted(free, np.arange(STRETCH, size, STRETCH))
    return [0, *sorted(set(free[picked[picked < len(free)]].tolist())), size]


def _encode_units(units: list[str], v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct units, one after the other, and how many each has."""
    text = "".join(u + "\0" for u in units)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
    codes = v.code[points]
    ends = np.cumsum(sizes) - 1
    codes[ends] = 0
    unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    long = sizes > LONG_UNIT + 1
    left, ids = _merged(codes, unit, np.stack([ends - sizes + 1, ends], axis=1)[long], v)
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [[v.byte_id[b] for b in chr(points[left[k]]).encode()] for k in unknown.tolist()]
        times = np.ones(len(ids), np.int64)
        times[unknown] = [len(s) for s in spelled]
        left, wide = np.repeat(left, times), np.repeat(ids, times)
        wide[np.repeat(ids < 0, times)] = [i for s in spelled for i in s]
        ids = wide
    return ids, np.bincount(unit[left], minlength=len(units))


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A unit begins at a blank behind a non-blank."""
    begin = np.zeros(len(raw), bool)
    begin[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
    return begin


def encoder(v: Pieces) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    def learn(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, a = [], [], 0
        while a < len(units):
            some, size = [], 0
            while a < len(units) and (not some or size < INDEX):
                some.append(units[a].decode().replace(" ", BLANK))
                size += len(some[-1]) + 1
                a += 1
            i, c = _encode_units(some, v)
            ids.append(i.astype(np.int32))
            counts.append(c)
        return np.concatenate(ids), np.concatenate(counts)

    memory = UnitMemory(_cuts, learn)

    def encode_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The model puts a blank before a text, and has one sign for U+2581 and a blank."""
        plain = pc.replace_substring(texts.cast(pa.string()), BLANK, " ")
        return memory(pc.if_else(pc.equal(pc.binary_length(plain), 0), "", pc.binary_join_element_wise("", plain, " ")))

    return encode_all


@lru_cache(maxsize=1)
def worker_pieces(path: str) -> tuple[Pieces, Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """One model and memory for all tasks that a Python worker runs with a model."""
    v = Pieces.load(path)
    return v, encoder(v)


def encode_texts(texts: list[str], v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    return encoder(v)(pa.array(texts, pa.string()))


def decode_lists(ids: pa.Array, v: Pieces) -> pa.Array:
    """The texts of lists of ids: bytes are put together, broken ones shown as U+FFFD, and
    the blank that encoding put before a text is taken off again."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat[ends[:-1][sizes > 0]] += len(v.text)
    raw = v.raw.take(pa.array(flat))
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(at[ends])), raw.buffers()[2] or pa.py_buffer(b"")])
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def decode_ids(ids: list[int], v: Pieces) -> str:
    return decode_lists(pa.array([ids], pa.list_(pa.int32())), v)[0].as_py()


def _encode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    _, encode_all = worker_pieces(path)
    for batch in (s for b in batches for s in slices(b, "__text", 1 << 21)):
        ids, counts = encode_all(batch.column("__text"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
        yield pa.RecordBatch.from_arrays([lists if f.name == "piece_ids" else batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all) and piece_ids, the ids of the whole text.

    Null and empty texts have no ids. A column piece_ids that the table has is replaced.
    Characters that are no piece are spelled in bytes. Repeated rows are each answered.
    """
    kept = [c for c in docs.columns if c != "piece_ids"] if carry is None else carry
    rows = docs.select(*kept)
    out = T.StructType([*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(out)
    return docs.select(*kept, whole_text(text).alias("__text")).mapInArrow(lambda it: _encode(it, path, schema), out)


def _decode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    v, _ = worker_pieces(path)
    for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
        texts = decode_lists(batch.column("__ids"), v)
        yield pa.RecordBatch.from_arrays([texts if f.name == "decoded" else batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def decode(rows: DataFrame, path: str, ids: str = "piece_ids", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all) and decoded, the text of the ids; null and empty
    lists give the empty text. A literal U+2581 in a text comes back as a blank, as the
    model has one sign for both."""
    kept = [c for c in rows.columns if c != "decoded"] if carry is None else carry
    out = T.StructType([*rows.select(*kept).schema.fields, T.StructField("decoded", T.StringType())])
    schema = to_arrow_schema(out)
    return rows.select(*kept, F.col(ids).alias("__ids")).mapInArrow(lambda it: _decode(it, path, schema), out)
