"""Near-duplicate embeddings by spherical-cap filters.

1. Equal vectors form a class; a class goes on once, with its smallest id and its number of
   members, so that thousands of copies cost what one does.
2. A filter is a direction of a structured random product code: one word from the codebook of
   each block of a rotated space, joined. A vector passes the filters whose inner product with
   it reaches a height. List decoding finds all of them block by block, best words first, and
   leaves what the best words of the blocks to come can't lift over the height.
3. Classes meet in the filters that they share. A filter of more than BLOCK classes is cut
   into blocks that meet two by two, each pair in a group of its own; vectors stay in tasks.
   A pair is counted in the least filter that both pass, so no list of pairs is needed: what
   leaves a task is, a class and filter, how many links it has there and the least id of the
   classes it hangs together with there.
4. Cosines are computed in double precision from the vectors as they came; no pair below the
   threshold is linked. Components join what the filters found.

Height and codebooks follow from the number of vectors: a random vector passes a filter with
probability PER_FILTER / n, and codebooks grow until, in a seeded simulation of pairs at just
the threshold, RECALL of them share a filter. As the filters know nothing of the data, that
share holds for any data; pairs above the threshold are found more often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import small_side
from matchbook.operators.graph import connected_components
from matchbook.session import stage_table

#: Vectors that meet in a filter if directions are spread evenly.
PER_FILTER = 64
#: Share of simulated pairs at just the threshold that the filters must bring together.
RECALL = 0.99
#: Classes of a filter that one group compares; larger filters are cut.
BLOCK = 8192
#: Filters of up to this many classes are compared side by side.
SMALL = 128
#: Words of a block's codebook beyond which a block more is taken, and codes at most.
WORDS, MOST_CODES = 512, 400
_PAIRS = 1 << 18


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows in a pseudo-random rotation: rounds of sign flips and a Hadamard transform."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, however large or small their numbers."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass(frozen=True)
class Filters:
    """`codes` product codes of `blocks` codebooks of `words` words each, in as many rotations,
    for vectors of up to `size` numbers (a power of two), and the height to be reached."""

    size: int
    codes: int
    blocks: int
    words: int
    height: float
    seed: int = 7

    @cached_property
    def made(self) -> list[tuple[np.ndarray, list[tuple[slice, np.ndarray]]]]:
        """The signs and the codebooks of each code."""
        cuts = np.linspace(0, self.size, self.blocks + 1).astype(int)
        out = []
        for c in range(self.codes):
            rng = np.random.default_rng([self.seed, self.size, c])
            signs, books = rng.choice([-1.0, 1.0], (3, self.size)), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                w = rng.standard_normal((self.words, hi - lo))
                books.append((slice(lo, hi), w / np.sqrt((w * w).sum(1, keepdims=True)) * np.sqrt((hi - lo) / self.size)))
            out.append((signs, books))
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit rows reach, rows ascending, then filters."""
        wide = np.zeros((len(x), self.size))
        wide[:, : x.shape[1]] = x
        found = [self._of_code(c, wide) for c in range(self.codes)]
        row, code = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], code[order]

    def _of_code(self, c: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(wide)
        signs, books = self.made[c]
        turned = rotated(wide, signs)
        scores = [turned[:, part] @ words.T for part, words in books]
        best = [s.max(1) for s in scores]
        row, code, score = np.arange(n), np.full(n, c, np.int64), np.zeros(n)
        for b, s in enumerate(scores):
            to_come = sum(best[b + 1 :], np.zeros(n))
            order = np.argsort(-s, 1)
            # one ascending array of all rows' falling scores, which lie within -1..1
            line = (4.0 * np.arange(n)[:, None] - np.take_along_axis(s, order, 1)).ravel()
            least = np.clip(self.height - score - to_come[row], -2.0, 2.0)
            count = np.searchsorted(line, 4.0 * row - least, side="right") - row * self.words
            which = np.repeat(np.arange(len(row)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            word = order[row[which], nth]
            row, code, score = row[which], code[which] * self.words + word, score[which] + s[row[which], word]
        order = np.lexsort((code, row))
        return row[order], code[order]


def cap_height(dim: int, share: float) -> float:
    """The height over which a cap holds this share of the unit sphere in `dim` dimensions."""
    t = np.linspace(0, 1, 200_001)
    density = (1 - t * t) ** ((dim - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(np.interp(-share, -above / (2 * above[0]), t))


def design(n: int, size: int, cosine: float, recall: float = RECALL, seed: int = 7) -> Filters:
    """Filters for n vectors: codes of about one filter a vector each, as many as it takes
    until simulated pairs at just the threshold share a filter as often as asked for."""
    share = min(0.02, PER_FILTER / max(n, 1))
    blocks = max(2, int(np.ceil(np.log(1 / share) / np.log(WORDS))))
    words = int(np.ceil(share ** (-1 / blocks)))
    rng = np.random.default_rng([seed, 1])
    x = unit(rng.standard_normal((1500, size)))
    y = rng.standard_normal(x.shape)
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y
    most = Filters(size, MOST_CODES, blocks, words, cap_height(size, share), seed)
    met = np.zeros(len(x), bool)
    for c in range(MOST_CODES):
        (i, f), (j, g) = most._of_code(c, x), most._of_code(c, y)
        met[i[np.isin(i + 1j * f, j + 1j * g)]] = True
        if met.mean() >= recall:
            break
    return Filters(size, c + 1, blocks, words, most.height, seed)


def padded(dim: Column) -> Column:
    """The power of two, 8 at least, that holds so many numbers."""
    return F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(dim))).cast("int"))


def _coded(filters: dict[int, Filters], schema: pa.Schema):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            sizes = batch.column("size").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, made = batch.take(pa.array(at)), filters[int(sizes[at[0]])]
                step = max(1, (2 << 20) // (8 * max(made.size, made.words)))
                for a in range(0, own.num_rows, step):
                    part = own.slice(a, step)
                    row, found = made.decode(unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    columns = [part.column(f.name) if f.name != "filters" else pa.ListArray.from_arrays(pa.array(ends), pa.array(found)) for f in schema]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return code


def hanging(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes hangs together with by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


class _Group:
    """Rows of one or more filters, sorted by group: finds links and counts them."""

    def __init__(self, batch: pa.RecordBatch, cosine: float):
        self.batch, self.cosine, self.n = batch, cosine, batch.num_rows
        self.members = batch.column("members").to_numpy()
        self.filter = batch.column("filter").to_numpy()
        self.first = batch.column("first").to_numpy()
        self.links = np.zeros(self.n)
        self.root = np.arange(self.n)
        lists = batch.column("filters")
        self.held, self.of = lists.flatten().to_numpy(), np.repeat(np.arange(self.n), lists.value_lengths().to_numpy())

    def units(self, lo: int, hi: int, dim: int) -> np.ndarray:
        return unit(self.batch.column("vector").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))

    def below(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(row from lo, filter) of the filters below the rows' own, filters as small numbers,
        those of most rows first; filters of a single row are left out."""
        a, b = np.searchsorted(self.of, [lo, hi])
        of, held = self.of[a:b] - lo, self.held[a:b]
        keep = held < self.filter[lo + of]
        of, held = of[keep], held[keep]
        _, nth, count = np.unique(held, return_inverse=True, return_counts=True)
        keep = count[nth] > 1
        place = np.empty(len(count), np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(count))
        return of[keep], place[nth[keep]]

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.links += np.bincount(p, self.members[q], self.n) + np.bincount(q, self.members[p], self.n)

    def count_few(self, a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> None:
        """Counts linked pairs of rows a, b (from lo) of which no filter below holds both."""
        of, held = self.below(lo, hi)
        begins = np.searchsorted(of, np.arange(hi - lo + 1))
        size, width = np.diff(begins), int(held.max(initial=0)) + 1

        def keys(rows: np.ndarray) -> np.ndarray:
            """The filters below of each row, told apart by the pair they are of."""
            n = size[rows]
            at = np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return np.repeat(np.arange(len(rows)), n) * width + held[at]

        for k in range(0, len(a), _PAIRS // 8):
            p, q = a[k : k + _PAIRS // 8], b[k : k + _PAIRS // 8]
            own = np.ones(len(p), bool)
            own[np.intersect1d(keys(p), keys(q)) // width] = False
            self.add(p[own] + lo, q[own] + lo)

    def bits(self, lo: int, hi: int) -> np.ndarray:
        """The filters below as bits, a row of words each."""
        of, held = self.below(lo, hi)
        bits = np.zeros((int(held.max(initial=0)) // 64 + 1, hi - lo), np.uint64)
        np.bitwise_or.at(bits, (held // 64, of), np.uint64(1) << (held % 64).astype(np.uint64))
        return bits

    def count_many(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray, lo: int) -> None:
        for k in range(0, len(a), _PAIRS):
            p, q = a[k : k + _PAIRS], b[k : k + _PAIRS]
            for word in bits:
                own = (word[p] & word[q]) == 0
                p, q = p[own], q[own]
                if not len(p):
                    break
            self.add(p + lo, q + lo)

    def small(self, lo: int, ends: np.ndarray, dim: int) -> None:
        """Filters side by side: all their pairs in one list. Rows lo.. to the ends of groups."""
        x = self.units(lo, int(ends[-1]), dim)
        starts = np.concatenate([[lo], ends[:-1]]) - lo
        end_of = np.repeat(ends - lo, ends - lo - starts)
        later = end_of - np.arange(len(x)) - 1
        a = np.repeat(np.arange(len(x)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        near = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + _PAIRS]], x[b[k : k + _PAIRS]]) for k in range(0, max(len(a), 1), _PAIRS)]) >= self.cosine
        a, b = a[near], b[near]
        if len(a):
            self.count_few(a, b, lo, int(ends[-1]))
            self.root[lo : lo + len(x)] = lo + hanging(len(x), a, b)

    def large(self, lo: int, hi: int, dim: int, split: int) -> None:
        """One filter in tiles. Where two blocks meet, rows from split on are the second
        block, and only pairs across are looked at."""
        x, bits = self.units(lo, hi, dim), self.bits(lo, hi)
        label = np.arange(hi - lo)
        rows, first = (hi - lo, 0) if split == hi else (split - lo, split - lo)
        for r in range(0, rows, 256):
            near = x[r : min(r + 256, rows)] @ x[first:].T >= self.cosine
            if split == hi:
                near &= np.arange(r, r + len(near))[:, None] < np.arange(hi - lo)
            a, b = np.nonzero(near)
            a, b = a + r, b + first
            self.count_many(a, b, bits, lo)
            # links inside one part of the forest say nothing new
            new = label[a] != label[b]
            if new.any():
                u, inverse = np.unique(np.concatenate([label[a[new]], label[b[new]]]), return_inverse=True)
                half = len(inverse) // 2
                label[u] = u[hanging(len(u), inverse[:half], inverse[half:])]
                label = label[label]
        self.root[lo:hi] = lo + label

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        least = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.first)
        root = least[self.root]
        keep = pa.array(np.flatnonzero((self.links > 0) | (root != self.first)))
        own = {"links": pa.array(self.links.astype(np.int64)), "root": pa.array(root)}
        return pa.RecordBatch.from_arrays([(own.get(f.name, None) if f.name in own else self.batch.column(f.name)).take(keep) for f in schema], schema=schema)


def _compared(cosine: float, schema: pa.Schema):
    """Partitions sorted by (dim, filter, i, j, side): compares the rows of each group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def groups(b: pa.RecordBatch) -> np.ndarray:
            """Where groups end."""
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "filter", "i", "j")])
            return np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, b.num_rows)

        def done(b: pa.RecordBatch) -> pa.RecordBatch:
            g, ends = _Group(b, cosine), groups(b)
            dims, side, cut = b.column("dim").to_numpy(), b.column("side").to_numpy(), b.column("j").to_numpy() != b.column("i").to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            k = 0
            while k < len(ends):
                lo, hi = int(starts[k]), int(ends[k])
                if hi - lo > SMALL or cut[lo]:
                    g.large(lo, hi, int(dims[lo]), lo + int(np.searchsorted(side[lo:hi], 1)) if cut[lo] else hi)
                    k += 1
                    continue
                last = k
                while last < len(ends) and ends[last] - starts[last] <= SMALL and not cut[starts[last]] and dims[starts[last]] == dims[lo] and ends[last] - lo <= 1 << 13:
                    last += 1
                g.small(lo, ends[k:last], int(dims[lo]))
                k = last
            return g.found(schema)

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < BLOCK:
                continue
            b = whole()
            ends = groups(b)
            waiting = []
            if len(ends) > 1:
                yield done(b.slice(0, int(ends[-2])))
                b = b.slice(int(ends[-2]))
            waiting = [b]
        if waiting:
            yield done(whole())

    return compare


def _usable(vector: str) -> Column:
    """Holding no null and no number that is not finite, and not all zero."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda v: v != 0), F.lit(False))


def embedding_links(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least `cosine` that were found),
    component_id (smallest vec_id reachable by links) and kept (whether that is its own).

    A row is a vector: repeated rows link with each other. Vectors that are null, empty, zero
    or hold null or non-finite numbers link with nothing, nor do vectors of different lengths
    with each other, nor rows without an id, which have no component and are not kept. Rows
    of one id and different vectors are one node of a component. An empty table gives no
    rows; other columns are not looked at."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    given = given.withColumn("usable", _usable("vector") & F.col("vec_id").isNotNull())
    # two hashes of different seeds name a class
    keys = {"k1": F.when(F.col("usable"), F.xxhash64("vector")), "k2": F.when(F.col("usable"), F.xxhash64(F.lit(7), "vector"))}
    given = given.withColumns(keys)
    classes = given.where("usable").groupBy("k1", "k2", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
    classes = classes.withColumn("size", padded(F.size("vector")))
    n = vectors.count()
    # sizes are powers of two: some thirty at most
    made = {r["size"]: design(n, r["size"], cosine) for r in given.where("usable").select(padded(F.size("vector")).alias("size")).distinct().collect()}
    schema = T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])
    coded = stage_table(classes.mapInArrow(_coded(made, to_arrow_schema(schema)), schema), "caps")

    each = coded.select(F.size("vector").alias("dim"), "k1", "k2", "first", "members", "vector", "filters", F.explode("filters").alias("filter"))
    hot = stage_table(each.groupBy("dim", "filter").count().where(F.col("count") > block).select("dim", "filter", F.ceil(F.col("count") / block).cast("int").alias("n_blocks")), "caps-hot")
    each = each.join(small_side(hot, hot.count()), ["dim", "filter"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    own = F.pmod("k1", F.col("n_blocks")).cast("int")
    each = each.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    each = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    each = each.select("dim", "filter", "i", "j", "side", "k1", "k2", "first", "members", "vector", "filters")
    order = ["dim", "filter", "i", "j"]
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("k1", "k2", "first", "links", "root")])
    met = each.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_compared(cosine, to_arrow_schema(out)), out)
    met = stage_table(met, "caps-met")

    links = met.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    copies = coded.where("members > 1").select("k1", "k2", "first", "members")
    known = copies.join(links, ["k1", "k2"], "full").select("k1", "k2", "first", (F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # a row of a class stands below its smallest id; ids of several classes are one node
    below = given.where("usable").select("vec_id", "k1", "k2").join(copies.select("k1", "k2", "first"), ["k1", "k2"]).select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    edges = met.select(F.col("first").alias("a"), F.col("root").alias("b")).union(below).where("a <> b").distinct()
    components = connected_components(edges).withColumnRenamed("node", "vec_id")
    rows = given.select("vec_id", "k1", "k2").join(known.select("k1", "k2", "links"), ["k1", "k2"], "left").join(components, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
