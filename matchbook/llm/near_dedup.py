"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Documents
   with the same set form a class; only its smallest id goes on, so that thousands
   of copies cost what one does.
2. A class keeps, of its minima, the low b bits, packed into longs, and one key a
   band of ROWS minima.
3. A band bucket is dealt into slots of about SLOT classes by the low bits of one hash, and
   the classes of a slot are paired with its first (small stars, not all pairs). As slots
   are a power of two and the hash knows no band, classes that share many buckets meet in
   the same pair, which counts once. Bit counts of the packed signatures give a similarity
   estimate, corrected for chance collisions; what is clearly below the threshold goes.
4. What remains is confirmed on the full sets, linked, and joined to components.
   Buckets whose classes are then in more than one component are dealt anew. At last
   every pair of classes from different components that shares a bucket is compared, so
   that no link is lost: a bucket is cut into blocks, and blocks meet two by two in tasks of
   their own. They meet twice: first with signatures alone, which leaves the classes with
   a pair that may be a link, then these with their texts, and only links leave a task.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import slices, small_side, whole_text
from matchbook.operators.graph import connected_components
from matchbook.session import stage_table

MINIMA, ROWS, BITS, BANDS = 128, 3, 4, 21
#: Longs of a packed signature.
LONGS = MINIMA * BITS // 64
#: An estimate has a standard error of 0.037 at a similarity of 0.8; pairs are dropped five errors below it.
SLACK = 0.19
SLOT, STAR_ROUNDS = 4, 2
#: Classes of a bucket that one task compares with as many others at the end.
PAIR_BLOCK = 512
SIGNATURE = [f"s{i}" for i in range(LONGS)]
#: Bytes of text hashed at once.
CHUNK = 1 << 22

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE[_BLANK] = 0
for _upper in range(65, 91):  # A-Z hash as a-z
    _BYTE[_upper] = _BYTE[_upper + 32]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, cache: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    while len(cache[0]) < n:
        cache[0] = np.concatenate([cache[0], cache[0] * (_BASE ** np.uint64(len(cache[0])))])
    return cache[0]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has. Words are hashed as polynomials
    of their bytes, all at once."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[raw]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begins, ends), prepend=0)
    if not len(begins):
        return np.zeros(0, np.uint64), counts
    raw = raw[begins[0] :]
    begins = begins - begins[0]
    within = np.arange(len(raw)) - np.repeat(begins, np.diff(begins, append=len(raw)))
    longest = int(within.max()) + 1
    values = _BYTE[raw]
    values *= _powers(longest)[within]
    return _mix(np.add.reduceat(values, begins)), counts


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one
    shingle of all of them, a text without words none."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        size, a = 0, k
        while k < len(texts) and (k == a or size + len(texts[k]) <= CHUNK):
            size += len(texts[k])
            k += 1
        hashes, counts = _word_hashes(texts[a:k])
        n = max(0, len(hashes) - words + 1)
        whole = np.zeros(n, np.uint64)
        for j in range(words):
            whole += hashes[j : j + n] * _STEP[j]
        whole = _mix(whole)
        at = 0
        for m in counts.tolist():
            if m >= words:
                out.append(np.unique(whole[at : at + m - words + 1]))
            elif m:
                out.append(_mix((hashes[at : at + m] * _STEP[:m]).sum(keepdims=True) + np.uint64(m)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
    return out


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text")):
        texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
        sets = shingle_sets(texts, words)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        minima = np.zeros((MINIMA, len(sets)), np.uint64)
        group = max(1, (1 << 18) // max(1, int(sizes.max(initial=1))))
        for a in range(0, len(full), group):
            some = full[a : a + group]
            joined = np.concatenate([sets[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            for k in range(MINIMA):
                minima[k, some] = np.minimum.reduceat(joined * _MUL[k] + _ADD[k], starts)
        mixed = _mix(minima)
        low = (mixed & np.uint64((1 << BITS) - 1)).reshape(LONGS, MINIMA // LONGS, -1)
        packed = np.zeros((LONGS, len(sets)), np.uint64)
        for j in range(MINIMA // LONGS):
            packed |= low[:, j] << np.uint64(BITS * j)
        keys = np.zeros((BANDS, len(sets)), np.uint64)
        for band in range(BANDS):
            for r in range(ROWS):
                keys[band] = _mix(keys[band] * _STEP[r] + mixed[band * ROWS + r] + np.uint64(band))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
        flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, BANDS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.string()), *[pa.array(packed[i].view(np.int64)) for i in range(LONGS)], bands],
            names=["doc_id", "n_shingles", "digest", *SIGNATURE, "bands"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets have 100 * intersection >= percent * union."""
    memo: OrderedDict[tuple, np.ndarray] = OrderedDict()

    def shingles(key: int, text: str) -> np.ndarray:
        if (key, text) in memo:
            memo.move_to_end((key, text))
        else:
            memo[key, text] = shingle_sets([text.encode()], words)[0]
            if len(memo) > 64:
                memo.popitem(last=False)
        return memo[key, text]

    for batch in (s for b in batches for s in slices(b, "text_a")):
        linked = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            p, q = shingles(a, x), shingles(b, y)
            if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                linked.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= percent * (len(p) + len(q) - both))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _met(batches: Iterator[pa.RecordBatch], words: int, percent: int, least: float, likely: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Links between classes of different components in each meeting of two blocks of a
    bucket (rows sorted by meeting). A pair is compared in the first bucket that it shares,
    and not at all if bit counts rule it out or the block has already joined the two.
    With the schema `likely` no texts are read: the rows of a pair that counts allow come back."""
    meeting: list[tuple] = []
    at = None

    def solve() -> Iterator[pa.RecordBatch]:
        reps, own = [r[0] for r in meeting], np.array([r[5] for r in meeting])
        first, second = (at[1], at[2]) if at else (0, 0)
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        root = {r[2]: r[2] for r in meeting}
        if len(root) < 2 or not len(left) or not len(right):
            return

        def find(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        part = np.array([r[2] for r in meeting])
        sig = np.array([r[7 : 7 + LONGS] for r in meeting], np.int64).view(np.uint64)
        unequal = np.zeros((len(left), len(right)), np.int64)
        for k in range(LONGS):
            x = sig[left, k][:, None] ^ sig[right, k][None, :]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            unequal += np.bitwise_count(x & np.uint64(0x1111111111111111))
        chance = 2.0**-BITS
        near = ((1 - unequal / MINIMA) - chance) / (1 - chance) >= least
        near &= part[left][:, None] != part[right][None, :]
        if likely is not None:
            some = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([meeting[x][k] for x in some.tolist()], f.type) for k, f in enumerate(likely)], schema=likely)
            return
        sets: dict[int, np.ndarray] = {}
        found: list[tuple[int, int]] = []
        for x, y in zip(*(side[k].tolist() for side, k in zip((left, right), np.nonzero(near), strict=True)), strict=True):
            if (first == second and x >= y) or find(part[x]) == find(part[y]):
                continue
            if any(k < at[0] for k in meeting[x][6] if k in meeting[y][6]):
                continue
            for i in (x, y):
                if i not in sets:
                    sets[i] = shingle_sets([meeting[i][7 + LONGS].encode()], words)[0]
            p, q = sets[x], sets[y]
            if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= percent * (len(p) + len(q) - both):
                found.append((reps[x], reps[y]))
                root[find(part[x])] = find(part[y])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    texts = [] if likely is not None else ["text"]
    for batch in (s for b in batches for s in (slices(b, "text") if texts else [b])):
        for row in zip(*(batch.column(c).to_pylist() for c in ("rep", "key", "component", "i", "j", "own", "keys", *SIGNATURE, *texts)), strict=True):
            if at != (row[1], row[3], row[4]):
                yield from solve()
                meeting, at = [], (row[1], row[3], row[4])
            meeting.append(row)
    yield from solve()


def _estimate(a: str, b: str) -> F.Column:
    """Similarity from packed signatures: the share of equal b-bit values, less what
    chance gives, 2**-b."""
    unequal = F.lit(0)
    for c in SIGNATURE:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(x)
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(MINIMA))) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Words are lower-cased (A-Z) runs of non-blanks. Documents are linked if their sets
    of distinct `words`-word shingles have a Jaccard similarity of percent/100 or more.
    Null, empty and blank texts have no shingles, link with nothing, and are kept.
    Texts without enough words have one shingle of all their words. If one id has
    several texts, each is tested and links of any hold for the id; a null id stays
    alone. 21 bands of 3 minima miss a link at 0.8 with a chance of 3e-7.
    """
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    schema = "doc_id long, n_shingles long, digest string, " + ", ".join(f"{c} long" for c in SIGNATURE) + ", bands array<long>"
    signed = stage_table(body.mapInArrow(lambda it: _signatures(it, words), schema), "near-signed")
    known = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    signature = [F.first(c).alias(c) for c in (*SIGNATURE, "bands")]
    classes = stage_table(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), *signature), "near-classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    banded = stage_table(banded.join(shared, "key"), "near-banded")
    sigs = classes.select("rep", *SIGNATURE)

    def placed_in(component: DataFrame | None) -> DataFrame:
        """Band rows with their components; of later rounds only buckets with several."""
        if component is None:
            return banded.select("rep", "key", F.col("rep").alias("component"))
        rows = banded.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
        open_keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return stage_table(rows.join(open_keys, "key"), "near-open")

    def texts_of(reps: DataFrame) -> DataFrame:
        needed = stage_table(reps.distinct().toDF("doc_id"), "near-needed")
        return stage_table(body.join(small_side(needed, needed.count()), "doc_id", "left_semi").distinct(), "near-texts")

    links, component, tried = None, None, None
    least = percent / 100 - SLACK
    for turn in range(STAR_ROUNDS):
        placed = placed_in(component)
        slots = placed.groupBy("key").agg(F.expr(f"shiftleft(1L, cast(floor(log2(greatest(count(*) / {SLOT}, 1))) AS int)) - 1").alias("mask"))
        dealt = placed.join(slots, "key").withColumn("slot", F.xxhash64("rep", F.lit(turn)).bitwiseAND(F.col("mask")))
        first = dealt.groupBy("key", "slot").agg(F.min(F.struct("rep", "component")).alias("c"))
        pairs = dealt.join(first, ["key", "slot"]).where("component <> c.component").select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        p, q = sigs.alias("p"), sigs.alias("q")
        pairs = pairs.join(p, F.col("a") == F.col("p.rep")).join(q, F.col("b") == F.col("q.rep")).where(_estimate("p", "q") >= least).select("a", "b")
        pairs = stage_table(pairs, "near-pairs")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        texts = texts_of(pairs.select(F.explode(F.array("a", "b"))))
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        new = stage_table(both.mapInArrow(lambda it: _confirmed(it, words, percent), "a long, b long"), "near-links")
        links = new if links is None else links.union(new)
        component = connected_components(links)
    if tried is not None:
        placed = placed_in(component)
        keys = placed.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        blocks = placed.groupBy("key").agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks"))
        dealt = placed.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        dealt = dealt.select("rep", "key", "component", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")).select("rep", "key", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

        def meet(rows: DataFrame) -> DataFrame:
            return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

        narrow = dealt.join(keys, "rep").join(sigs, "rep").select("rep", "key", "component", "i", "j", "own", "keys", *SIGNATURE)
        schema = to_arrow_schema(narrow.schema)
        likely = stage_table(meet(narrow).mapInArrow(lambda it: _met(it, words, percent, least, schema), narrow.schema), "near-likely")
        full = likely.join(texts_of(likely.select("rep")).toDF("rep", "text"), "rep")
        new = stage_table(meet(full).mapInArrow(lambda it: _met(it, words, percent, least), "a long, b long"), "near-links")
        links = links.union(new)
        component = connected_components(links)
    of_class = classes.select("digest", F.col("rep").alias("node"))
    if component is not None:
        of_class = of_class.join(component, "node", "left")
    else:
        of_class = of_class.withColumn("component", F.col("node"))
    reached = of_class.select("digest", F.coalesce("component", "node").alias("component"))
    return signed.join(reached, "digest", "left").select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that near_duplicates keeps, all columns as they came."""
    gone = stage_table(near_duplicates(docs, words, percent, text, id_col).where("NOT kept").select(id_col).distinct(), "near-gone")
    return docs.join(small_side(gone, gone.count()), id_col, "left_anti")
