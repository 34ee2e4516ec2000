"""Token ids as binary segments, packed by an adaptive context-mixing range coder.

A segment holds whole documents: its number of ids, its documents and their lengths,
and blocks of BLOCK ids. Each block starts from fresh state, has its own length and a
crc32 of its coded bytes and of its ids, and can be decoded alone.

The model of a block predicts an id from its last two ids (order 2), from its last
(order 1) and from all before (order 0: a majority vote). What comes is one of eight
symbols: a hit of order 2, 1 or 0, or the size class of a literal. Their frequencies
are mixed from three adaptive counts: one under the confidence of order 2, one under
that of order 1, one without context. A literal's remaining bits follow as they are.
Blocks of a segment are coded side by side, a numpy lane each, with a carry-less
64-bit range coder that moves 16 bits at a time.

Segments are rows of a Parquet dataset, so Spark's commit protocol makes them safe
against lost executors and any store Spark can write to will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.common import UnitMemory, slices, whole_text

MAGIC = b"IDS2"
#: Ids of a block, ids after which a segment closes, lanes coded at once.
BLOCK, SEGMENT, LANES = 2048, 1 << 23, 4096
_ORDER1, _ORDER2 = 10, 11  # bits of the prediction tables
#: Symbols: hits of order 2, 1 and 0, then five classes of literals, with their first ids and
#: binary digits. The last class has as many digits as the segment's largest id needs.
_HITS, _FIRST, _DIGITS = 3, (0, 256, 1280, 5376, 21760), (8, 10, 12, 14)
_MOST = 1 << 17
#: Counts grow by _ADD and are halved every _AGE ids, so mixed totals stay below 2**15.
_ADD, _AGE = 24, 128
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)
_ALL = _U(0xFFFFFFFFFFFFFFFF)
#: Four 16-bit numbers lie in a word: ones, and the top bit of each.
_ONES, _TOPS = _U(0x0001000100010001), _U(0x8000800080008000)
_FIELD = _U(0xFFFF)


class _Lanes:
    """State of the model for many blocks at once; all tables are flat, a lane after the other.
    A context's eight counts are two words of four 16-bit numbers, summed up by a multiplication."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.one = np.zeros(lanes << _ORDER1, np.uint32)  # id << 2 | confidence
        self.two = np.zeros(lanes << _ORDER2, np.uint32)
        self.vote, self.votes = np.zeros(lanes, np.uint32), np.zeros(lanes, np.int32)
        # counts under the confidence of order 2 (5 contexts a lane), of order 1 (5), and without context
        self.counts = np.full(lanes * 20, _ONES * _U(4), _U)
        self.any_low, self.any_high = np.full(lanes, _ONES * _U(4), _U), np.full(lanes, _ONES * _U(4), _U)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.step = 0

    def predict(self) -> None:
        """Sets the ids predicted by order 2 and 1 (p2, p1), the mixed frequencies (low, high),
        their running sums (sums_low, sums_high) and total."""
        if self.step % _AGE == _AGE - 1:
            for c in (self.counts, self.any_low, self.any_high):
                c >>= _U(1)
                c &= ~_TOPS
                c += _ONES
        self.step += 1
        self.h1 = ((self.last * np.uint32(0x9E3779B1)) >> np.uint32(32 - _ORDER1)) + (self.lane << _ORDER1)
        self.h2 = ((self.last * np.uint32(0x85EBCA6B) + self.before * np.uint32(0xC2B2AE35)) >> np.uint32(32 - _ORDER2)) + (self.lane << _ORDER2)
        self.e1, self.e2 = self.one.take(self.h1), self.two.take(self.h2)
        row = self.lane * 20
        self.r2 = row + (((self.e2 & np.uint32(3)) + (self.e2 > 0)) << np.uint32(1))
        self.r1 = row + (((self.e1 & np.uint32(3)) + (self.e1 > 0)) << np.uint32(1))
        self.r1 += 10
        take = self.counts.take
        self.low = take(self.r2) << _U(1)
        self.low += take(self.r1)
        self.low += self.any_low
        self.high = take(self.r2 + 1) << _U(1)
        self.high += take(self.r1 + 1)
        self.high += self.any_high
        self.sums_low = self.low * _ONES
        self.sums_high = (self.high + (self.sums_low >> _U(48))) * _ONES
        self.total = self.sums_high >> _U(48)
        self.p2, self.p1 = self.e2 >> np.uint32(2), self.e1 >> np.uint32(2)

    def range_of(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a symbol's share of the total begins, and its size."""
        self.upper = symbol > 3
        self.at = ((symbol & 3) << 4).astype(_U)
        size = np.where(self.upper, self.high, self.low)
        size >>= self.at
        size &= _FIELD
        end = np.where(self.upper, self.sums_high, self.sums_low)
        end >>= self.at
        end &= _FIELD
        return end - size, size

    def symbol_at(self, value: np.ndarray) -> np.ndarray:
        """The symbol whose share of the total holds the value."""
        all_four = value * _ONES | _TOPS
        return (np.bitwise_count(all_four - self.sums_low & _TOPS) + np.bitwise_count(all_four - self.sums_high & _TOPS)).astype(np.int64)

    def learn(self, ids: np.ndarray) -> None:
        more = _U(_ADD) << self.at
        for r in (self.r2, self.r1):
            r += self.upper
            self.counts[r] = self.counts.take(r) + more
        above = more * self.upper
        self.any_high += above
        self.any_low += more - above
        fresh = ids << np.uint32(2)
        for table, entry, guess, h in ((self.one, self.e1, self.p1, self.h1), (self.two, self.e2, self.p2, self.h2)):
            # a right guess gains confidence, up to 3; a wrong one is replaced
            table[h] = np.where(guess == ids, np.minimum(entry + np.uint32(1), entry | np.uint32(3)), fresh)
        self.votes += np.where(self.vote == ids, np.int32(1), np.int32(-1))
        self.vote = np.where(self.votes < 0, ids, self.vote)
        np.abs(self.votes, out=self.votes)
        self.before, self.last = self.last, ids

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.counts = self.counts[: n * 20]
        self.one, self.two = self.one[: n << _ORDER1], self.two[: n << _ORDER2]
        for name in ("lane", "vote", "votes", "last", "before", "any_low", "any_high"):
            setattr(self, name, getattr(self, name)[:n])


def _share(span: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The range of one count: span // total but for the last bits, by exact division of floats
    (numbers below 2**52), which is faster than that of 64-bit integers."""
    return ((span >> _U(12)).astype(np.float64) / total).astype(_U) << _U(12)


def _classes(top: int) -> tuple[np.ndarray, np.ndarray]:
    """By symbol: the first id of a literal class, and its binary digits (top: of the last)."""
    return np.array([0] * _HITS + list(_FIRST), np.uint32), np.array([0] * _HITS + [*_DIGITS, top], _U)


def _encode_lanes(ids: np.ndarray, sizes: np.ndarray, top: int) -> list[bytes]:
    """ids (steps, lanes) with sizes falling from lane to lane."""
    n = len(sizes)
    model = _Lanes(n)
    first, digits = _classes(top)
    literal = (np.searchsorted(first[_HITS:], ids, side="right") + (_HITS - 1)).astype(np.int8)
    low, span = np.zeros(n, _U), np.full(n, _ALL)
    room = np.empty((ids.shape[0] * 3 + 8, n), np.uint16)
    used = np.zeros(n, np.int64)
    live = n
    for t in range(ids.shape[0]):
        now = int(np.searchsorted(-sizes, -t, side="left"))
        if now < live:
            live = now
            model.shrink(live)
        x = ids[t, :live]
        model.predict()
        symbol = literal[t, :live].astype(np.int64)
        symbol[model.vote == x] = 2
        symbol[model.p1 == x] = 1
        symbol[model.p2 == x] = 0
        begin, size = model.range_of(symbol)
        lo, sp = low[:live], span[:live]
        sp[:] = _share(sp, model.total)
        begin *= sp
        lo += begin
        sp *= size
        sp >>= digits.take(symbol)
        lo += ((x - first.take(symbol)) * (symbol >= _HITS)).astype(_U) * sp
        _shift(lo, sp, room, used, live)
        model.learn(x)
    for _ in range(4):
        room[used, np.arange(n)] = (low >> _U(48)).astype(np.uint16)
        used += 1
        low <<= _U(16)
    return [room[: used[i], i].astype(">u2").tobytes() for i in range(n)]


def _shift(lo: np.ndarray, sp: np.ndarray, room: np.ndarray | None, used: np.ndarray, live: int, code: np.ndarray | None = None) -> None:
    """Moves settled 16-bit units out of the range; the decoder (code given) takes units in."""
    some = None
    while True:
        l, s = (lo, sp) if some is None else (lo[some], sp[some])
        settled = (l ^ (l + s)) < _TOP
        narrow = ~settled & (s < _BOTTOM)
        go = np.flatnonzero(settled | narrow)
        if not len(go):
            return
        trim = np.flatnonzero(narrow)
        idx = go if some is None else some[go]
        if len(trim):
            at = trim if some is None else some[trim]
            sp[at] = (_U(0) - lo[at]) & (_BOTTOM - _U(1))
        if code is None:
            room[used[idx], idx] = (lo[idx] >> _U(48)).astype(np.uint16)
        else:
            code[idx] = (code[idx] << _U(16)) | room[used[idx], idx].astype(_U)
        used[idx] += 1
        lo[idx] <<= _U(16)
        sp[idx] <<= _U(16)
        some = idx


def _decode_lanes(coded: list[bytes], sizes: np.ndarray, top: int) -> np.ndarray:
    n = len(sizes)
    units = [np.frombuffer(c, ">u2") for c in coded]
    room = np.zeros((max(map(len, units)) + 8, n), np.uint16)
    for i, u in enumerate(units):
        room[: len(u), i] = u
    model = _Lanes(n)
    first, digits = _classes(top)
    low, span, code = np.zeros(n, _U), np.full(n, _ALL), np.zeros(n, _U)
    used = np.full(n, 4)
    for k in range(4):
        code = (code << _U(16)) | room[k].astype(_U)
    out = np.zeros((int(sizes.max()), n), np.uint32)
    live = n
    for t in range(out.shape[0]):
        now = int(np.searchsorted(-sizes, -t, side="left"))
        if now < live:
            live = now
            model.shrink(live)
        model.predict()
        lo, sp, co = low[:live], span[:live], code[:live]
        sp[:] = _share(sp, model.total)
        symbol = model.symbol_at(np.minimum((co - lo) // sp, model.total - _U(1)))
        begin, size = model.range_of(symbol)
        begin *= sp
        lo += begin
        sp *= size
        extra = digits.take(symbol)
        sp >>= extra
        x = np.where(symbol == 0, model.p2, np.where(symbol == 1, model.p1, model.vote))
        some = np.flatnonzero(symbol >= _HITS)
        if len(some):
            rest = np.minimum((co[some] - lo[some]) // sp[some], (_U(1) << extra[some]) - _U(1))
            lo[some] += rest * sp[some]
            x[some] = first.take(symbol[some]) + rest.astype(np.uint32)
        out[t, :live] = x
        _shift(lo, sp, room, used, live, co)
        model.learn(x)
    return out


def pack(ids: np.ndarray) -> bytes:
    """All blocks of a run of ids, each below 2**17: number of ids and digits of the last
    class, then a size and two checksums a block, then the coded blocks."""
    if len(ids) and int(ids.max()) >= _MOST:
        raise ValueError(f"ids must be below {_MOST}")
    top = max(int(ids.max(initial=0)) - _FIRST[-1], 0).bit_length()
    n = -(-len(ids) // BLOCK)
    sizes = np.full(n, BLOCK)
    if n:
        sizes[-1] = len(ids) - (n - 1) * BLOCK
    lanes = np.zeros((n, BLOCK), np.uint32)
    lanes.ravel()[: len(ids)] = ids
    coded: list[bytes] = []
    for a in range(0, n, LANES):
        coded += _encode_lanes(np.ascontiguousarray(lanes[a : a + LANES, : sizes[a]].T), sizes[a : a + LANES], top)
    heads = b"".join(struct.pack("<III", len(c), zlib.crc32(c), zlib.crc32(lanes[i, : sizes[i]].astype("<u4").tobytes())) for i, c in enumerate(coded))
    return MAGIC + struct.pack("<QI", len(ids), top) + heads + b"".join(coded)


def unpack(data: bytes) -> np.ndarray:
    """The ids again; ValueError if a checksum is wrong."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    total, top = struct.unpack_from("<QI", data, 4)
    n = -(-total // BLOCK)
    heads = [struct.unpack_from("<III", data, 16 + 12 * i) for i in range(n)]
    sizes = np.full(n, BLOCK)
    if n:
        sizes[-1] = total - (n - 1) * BLOCK
    at, coded = 16 + 12 * n, []
    for size, check, _ in heads:
        coded.append(data[at : at + size])
        at += size
        if zlib.crc32(coded[-1]) != check:
            raise ValueError("a block's bytes do not match their checksum")
    out = np.zeros((n, BLOCK), np.uint32)
    for a in range(0, n, LANES):
        ids = _decode_lanes(coded[a : a + LANES], sizes[a : a + LANES], top)
        out[a : a + ids.shape[1], : ids.shape[0]] = ids.T
    for i, (_, _, check) in enumerate(heads):
        if zlib.crc32(out[i, : sizes[i]].astype("<u4").tobytes()) != check:
            raise ValueError("a block's ids do not match their checksum")
    return out.ravel()[:total]


#: Kinds of bytes: ASCII letters, digits, blanks, other signs, the apostrophe, bytes of longer characters.
_LETTER, _DIGIT, _BLANK, _SIGN, _QUOTE, _LONG = range(1, 7)
_KIND = np.full(256, _LONG, np.uint8)
_KIND[:128] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[39] = _QUOTE
#: _CUT[a, b]: whether a unit may begin at a byte of kind b behind one of kind a.
_CUT = np.ones((7, 7), bool)
_CUT[range(7), range(7)] = False
_CUT[_BLANK] = _CUT[_LONG] = _CUT[:, _LONG] = False
_CUT[_SIGN, _QUOTE] = _CUT[_QUOTE, _SIGN] = _CUT[_QUOTE, _LETTER] = False
#: Last and last but one bytes that blanks of several bytes have.
_WIDE = np.zeros((2, 256), bool)
_WIDE[0, [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE[1, [0x80, 0x81, 0x9A, 0xC2]] = True


@lru_cache(maxsize=1)
def word_encoder(path: str) -> UnitMemory:
    """Encodes as the tokenizers library does by default, a unit at a time with a memory of
    units that lasts as long as the Python worker, over all tasks that it runs.

    The vocabulary's own split ends a run of letters, digits or other signs where another
    kind follows, and joins one blank to what comes after it; a text is cut at such places
    where both sides are ASCII, and before a blank that no other blank precedes. Strings of
    added tokens are units of their own, as in the library.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or (t.normalized and not t.special) for t in added):
        raise ValueError("an added token of this vocabulary takes in what is beside it")
    special = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None

    def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        kind = _KIND[raw]
        begin = np.zeros(len(raw), bool)
        begin[1:] = _CUT.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]
        wide = np.flatnonzero((kind[1:] == _BLANK) & (kind[:-1] == _LONG)) + 1
        begin[wide] = ~(_WIDE[0, raw[wide - 1]] & _WIDE[1, raw[wide - 2]])
        for m in special.finditer(raw) if special else ():
            a, b = m.span()
            if np.searchsorted(starts, a, side="right") == np.searchsorted(starts, b - 1, side="right"):  # in one text
                begin[a] = True
                begin[a + 1 : b] = False
                begin[b : b + 1] = True
        return begin

    # by id: whether a blank begins it
    blank = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    blank[[i for t, i in tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
    joins = tokenizer.encode(" a b", add_special_tokens=False).ids == [i for u in (" a", " b") for i in tokenizer.encode(u, add_special_tokens=False).ids] and not any(t.content.replace(" ", "").isalpha() for t in added)

    def each(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for a in range(0, len(texts), 4096) for e in tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of a blank and letters are encoded many at a time, joined: a blank behind a letter
        always begins a unit, and only there an id begins with a blank."""
        texts = [u.decode() for u in units]
        word = np.fromiter((joins and t[0] == " " and t[1:].isalpha() for t in texts), bool, len(texts))
        words, rest = [t for t, w in zip(texts, word, strict=True) if w], [t for t, w in zip(texts, word, strict=True) if not w]
        joined, _ = each(["".join(words[a : a + 512]) for a in range(0, len(words), 512)])
        begins = np.flatnonzero(blank[joined])
        if len(begins) != len(words):  # another vocabulary's split
            return each(texts)
        other, sizes = each(rest)
        counts = np.empty(len(texts), np.int64)
        counts[word], counts[~word] = np.diff(begins, append=len(joined)), sizes
        of_word = np.repeat(word, counts)
        ids = np.empty(len(of_word), np.int32)
        ids[of_word], ids[~of_word] = joined, other
        return ids, counts

    return UnitMemory(cuts, learn, memory=200 << 20)


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode = word_encoder(vocabulary)
    shard, nth = TaskContext.get().partitionId(), 0
    docs: list = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(np.concatenate(parts))], pa.binary())],
            names=["shard", "segment", "n_tokens", "doc_ids", "lengths", "data"],
        )

    for batch in (s for b in batches for s in slices(b, "text")):
        ids, counts = encode(batch.column("text"))
        ends = np.cumsum(counts)
        closed = np.insert(ids, ends, end_id).astype(np.uint32)  # an end after each document
        docs += batch.column("doc_id").to_pylist()
        lengths += (counts + 1).tolist()
        parts.append(closed)
        size += len(closed)
        if size >= SEGMENT:
            yield close()
            docs, lengths, parts, size, nth = [], [], [], 0, nth + 1
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, text: str = "text", id_col: str = "doc_id") -> None:
    """Writes the ids of all documents to `path`, in ascending id order (shard, segment,
    place in the segment), each document closed by end_id.

    Null texts count as empty: their only id is end_id. Null ids come first; repeated ids
    stay together. A segment closes at the first slice of texts
    after SEGMENT ids. An empty
    table writes an empty dataset.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"
    rows.mapInArrow(lambda it: _segments(it, vocabulary, end_id), schema).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, segment, docs, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "doc_ids", "lengths", "data")), strict=True):
            ids = unpack(data).astype("<u4")
            ends = np.cumsum(lengths)
            raw = ids.tobytes()
            checks = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(checks, pa.int64()), lists],
                names=["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
            )


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids. Checks every block."""
    files = spark.read.schema("shard int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, data binary").parquet(path)
    sizes = files.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # a row a shard, then the segments within each shard
    before = shards.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")
    starts = sizes.withColumn("first", inside).join(before, "shard").select("shard", "segment", (F.col("base") + F.col("first")).alias("base"))
    columns = "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long, ids array<int>"

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _documents(batches):
            yield b if with_ids else b.drop_columns(["ids"])

    docs = files.mapInArrow(lean, columns if with_ids else columns.rsplit(",", 1)[0])
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
