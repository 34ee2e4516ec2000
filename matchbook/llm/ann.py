"""Nearest neighbours by additive quantisation, with an exact check.

A vector's direction is coded as a sum of one entry from each of LEVELS codebooks, all of
full dimension; its length and the length of what the code leaves are kept. Codebooks are
learned on a bounded sample: k-means of residuals level by level, then sweeps that fit
each book to what the others leave. Encoding is a beam search over the levels. Queries are
scored against the codes by table lookup (a table of inner products a level). The best are
scored again on the original vectors, and so is every vector whose code leaves it room to be
among the k best: a code is off by no more than the query's length times what it leaves. So
near copies that no code tells apart, and directions the sample has not seen, lose nothing.

All vectors are indexed. Codes and vectors are packed into blocks of at most BLOCK, and
query blocks meet code blocks in an equi-join on the query block's number; each
meeting gives one row a query. These are merged in steps of FAN, so no row or task
gathers more than FAN lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.session import stage_table

LEVELS, WORDS, BEAM = 24, 256, 4
#: Vectors the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 8192
ROUNDS, SWEEPS = 4, 4
BLOCK, QUERIES, FAN = 8192, 2048, 64
#: What single precision may add to the length that a code of a direction leaves.
ROUNDING = 1e-4


@dataclass
class Quantiser:
    """books: (levels, words, dimensions)."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Quantiser:
        """Needs at least one vector. Fewer than WORDS vectors leave unused words at zero."""
        rng = np.random.default_rng(seed)
        books = np.zeros((LEVELS, WORDS, x.shape[1]), np.float32)
        rest = x.copy()
        for book in books:
            n = min(WORDS, len(x))
            book[:n] = rest[rng.choice(len(x), n, replace=False)]
            for _ in range(ROUNDS):
                near = _nearest(rest, book)
                count = np.bincount(near, minlength=WORDS)
                total = np.zeros_like(book)
                np.add.at(total, near, rest)
                book[count > 0] = total[count > 0] / count[count > 0, None]
            rest -= book[_nearest(rest, book)]
        self = cls(books)
        # all books again, each to the mean of what the others leave of its vectors
        codes = self.encode(x)
        left = x - self.decode(codes)
        for _ in range(SWEEPS):
            for level, book in enumerate(books):
                of = codes[:, level]
                count = np.bincount(of, minlength=WORDS)
                total = np.zeros_like(book)
                np.add.at(total, of, left)
                step = total / np.maximum(count, 1)[:, None]
                book += step
                left -= step[of]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (n, levels), by beam search: the BEAM best sums so far are carried on."""
        out = np.empty((len(x), LEVELS), np.uint8)
        norms = (self.books**2).sum(axis=2)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            n = len(part)
            rest, cost, codes = part[:, None, :], (part**2).sum(axis=1)[:, None], np.zeros((n, 1, 0), np.uint8)
            for level, book in enumerate(self.books):
                width = rest.shape[1]
                costs = cost[:, :, None] - 2 * (rest.reshape(-1, rest.shape[2]) @ book.T).reshape(n, width, WORDS) + norms[level]
                costs = costs.reshape(n, -1)
                best = np.argpartition(costs, BEAM - 1, axis=1)[:, :BEAM]
                row = np.arange(n)[:, None]
                beam, word = best // WORDS, best % WORDS
                cost = costs[row, best]
                rest = rest[row, beam] - book[word]
                codes = np.concatenate([codes[row, beam], word[:, :, None].astype(np.uint8)], axis=2)
            out[a : a + n] = codes[np.arange(n), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(LEVELS), codes].sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries and words: (levels, queries, words)."""
        return np.einsum("qd,lwd->lqw", queries, self.books, optimize=True).astype(np.float32)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    norm = (book**2).sum(axis=1)
    return np.concatenate([(norm - 2 * (x[a : a + 4096] @ book.T)).argmin(axis=1) for a in range(0, len(x), 4096)])


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a non-null, non-zero vector of finite components, of the
    most frequent length (ties: the shorter). Of several vectors with one id, the smallest counts."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.expr("forall(v, x -> x IS NOT NULL AND x = x AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = lengths[0]["n"] if lengths else 0
    return rows.where(F.size("v") == n).groupBy("id").agg(F.min("v").alias("v"))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths; by way of the largest component, so that neither
    very large nor very small ones leave the range of doubles."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    unit = x / largest
    length = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return unit / length, (largest * length)[:, 0]


def _packed(batches: Iterator[pd.DataFrame], quantiser: Quantiser) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), BLOCK):
            part = b.iloc[a : a + BLOCK].sort_values("id")
            x = np.stack(part["v"].to_numpy()).astype(float)
            unit, length = _directions(x)
            codes = quantiser.encode(unit.astype(np.float32))
            left = length * (np.sqrt(((unit - quantiser.decode(codes)) ** 2).sum(axis=1)) + ROUNDING)
            packed = {"ids": part["id"].to_numpy(np.int64), "codes": np.ascontiguousarray(codes.T), "lengths": length, "rests": left, "vectors": x}
            yield pd.DataFrame({name: [v.tobytes()] for name, v in packed.items()})


def _exact(x: np.ndarray, q: np.ndarray, measure: str) -> np.ndarray:
    """The measure of each row, added up in the order of the components."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += x[:, j] * q[j] if measure == "ip" else (x[:, j] - q[j]) ** 2
    return total if measure == "ip" else -total


def _meet(batches: Iterator[pd.DataFrame], quantiser: Quantiser, k: int, keep: int, measure: str) -> Iterator[pd.DataFrame]:
    """For each query block and code block: each query's k best vectors, ties to the smaller id."""
    for b in batches:
        for row in b.itertuples():
            ids, lengths, rests = np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths), np.frombuffer(row.rests)
            vectors = np.frombuffer(row.vectors).reshape(len(ids), -1)
            codes = np.frombuffer(row.codes, np.uint8).reshape(LEVELS, -1)
            asking = np.frombuffer(row.q_ids, np.int64)
            queries = np.frombuffer(row.q_vectors).reshape(len(asking), -1)
            units, sizes = _directions(queries)

            def about(some: np.ndarray, q: np.ndarray, size: float, vectors: np.ndarray = vectors, lengths: np.ndarray = lengths) -> tuple[np.ndarray, np.ndarray]:
                if measure == "ip":
                    return vectors[some] @ q, 1e-12 * size * lengths[some]
                found = -((vectors[some] - q) ** 2).sum(axis=1)
                return found, 1e-12 * np.abs(found)

            def kth(found: np.ndarray, off: np.ndarray) -> float:
                return np.partition(found - off, -k)[-k] if len(found) > k else -np.inf

            near, far = [], []
            for a in range(0, len(asking), 128):
                tables = quantiser.tables(units[a : a + 128].astype(np.float32))
                score = np.zeros((tables.shape[1], len(ids)), np.float32)
                for level in range(LEVELS):
                    score += np.take(tables[level], codes[level], axis=1)
                for i, coded in enumerate(score, a):
                    q, size = queries[i], sizes[i]
                    guess, room = size * lengths * coded, size * rests
                    if measure == "l2":
                        guess, room = 2 * guess - lengths**2 - size**2, 2 * room + 1e-12 * (lengths**2 + size**2)
                    others = ids != asking[i]
                    guess[~others] = -np.inf
                    first = np.argpartition(guess, -keep)[-keep:] if len(ids) > keep else np.arange(len(ids))
                    first = first[others[first]]
                    if not len(first):
                        near.append(ids[:0])
                        far.append(np.zeros(0))
                        continue
                    # the k-th best of these must be reached, but for what rounding may take
                    least = kth(*about(first, q, size))
                    some = np.flatnonzero(others & ~(guess + room < least)) if least > -np.inf else np.flatnonzero(others)
                    found, off = about(some, q, size)
                    some = some[~(found + off < kth(found, off))]
                    found = -_exact(vectors[some], q, measure)
                    best = np.lexsort((ids[some], found))[:k]
                    near.append(ids[some[best]])
                    far.append(found[best])
            yield pd.DataFrame({"query_id": asking, "part": row.part, "ids": near, "far": far})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, keep: int = 500, measure: str = "ip", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best found among the
    vectors with another id, by inner product ("ip") or negative squared distance ("l2"),
    in double precision on the original vectors, ties to the smaller id.

    Of each block the `keep` best codes of a query are scored exactly, k at least, then whatever
    their k-th best doesn't rule out. Rows that `usable` refuses take no part.
    With fewer than k candidates all are returned; no vectors or queries give no rows.
    """
    spark = vectors.sparkSession
    base = stage_table(usable(vectors, id_col, vector), "ann-vectors")
    asked = base.join(usable(queries, id_col, vector).select("id"), "id", "left_semi")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rate = min(1.0, 1.5 * SAMPLE / n)
    drawn = base.where(F.pmod(F.xxhash64("id", F.lit("ann sample")), F.lit(1 << 30)) <= int(rate * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    drawn = drawn or base.orderBy("id").limit(SAMPLE).collect()
    quantiser = Quantiser.fit(_directions(np.array([r["v"] for r in drawn], float))[0].astype(np.float32))
    parts = -(-n // BLOCK)
    codes = stage_table(base.repartition(parts, "id").mapInPandas(lambda it: _packed(it, quantiser), "ids binary, codes binary, lengths binary, rests binary, vectors binary").withColumn("part", F.spark_partition_id()), "ann-codes")

    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # blocks of queries for all cores where there are few blocks of codes
    n_blocks = max(-(-n_asked // QUERIES), min(-(-n_asked // 64), -(-spark.sparkContext.defaultParallelism // parts)))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        part = block.sort_values("id")
        return pd.DataFrame({"q_block": block["q_block"].iloc[:1].to_numpy(), "q_ids": [part["id"].to_numpy(np.int64).tobytes()], "q_vectors": [np.stack(part["v"].to_numpy()).astype(float).tobytes()]})

    # about QUERIES queries a block at most, by a hash
    numbered = asked.withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    blocks = stage_table(numbered.groupBy("q_block").applyInPandas(pack, "q_block long, q_ids binary, q_vectors binary"), "ann-queries")
    meetings = codes.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition("q_block", "part").join(blocks, "q_block")
    found = meetings.mapInPandas(lambda it: _meet(it, quantiser, k, max(k, keep), measure), "query_id long, part int, ids array<long>, far array<double>")
    lists = found.select("query_id", "part", F.arrays_zip("far", "ids").alias("near"))
    while True:  # merge FAN lists at a time, the best k of them stay
        lists = lists.groupBy("query_id", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    return lists.select("query_id", F.posexplode("near").alias("at", "c")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.ids").alias("vec_id"), (-F.col("c.far")).alias("score"))
