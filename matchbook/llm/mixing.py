"""Mixing sources to target weights.

Sizes are words. A source's target is water-filled: the mix is `share` of all
words, split by weight, no source above `limit` times its own size, the excess
shared again by weight. Documents fall into blocks of about BLOCK_WORDS words by
a hash of their id. A source gives whole passes over its blocks and then blocks
in the order of a permutation, up to its target; the last block gives single
documents. These exact block quotas are split among output shards by a tree of
multivariate hypergeometric draws: each node divides what it got between two
halves of its shards, seeded by the node, so every shard can walk its own path in
a task of its own. Shards draw disjoint intervals of the permuted blocks and
shuffle their rows locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.common import small_side, word_count
from matchbook.operators.prefix import running_sums
from matchbook.session import stage_table

#: Words of a block (hash buckets, so about that many).
BLOCK_WORDS = 200_000
#: Words of an output shard.
SHARD_WORDS = 4_000_000


def draw(*parts: Column | str) -> Column:
    """A uniform 60-bit number from the parts' text, the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass
class SourcePlan:
    """rank: place of the source among all. target: words wanted. passes: whole passes
    over the source. rest: words wanted of a further, partial pass."""

    source: str | None
    rank: int
    size: int
    target: float
    passes: int
    rest: float
    blocks: int


def water_fill(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of `total` by weight, none above limit * size, the excess shared again by
    weight until none is above. If the limits together are below total, all get their limit."""
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    targets = [0.0] * len(sizes)
    left, weight = total, float(sum(weights))
    for k, i in enumerate(order):
        cap = limit * sizes[i]
        if left * weights[i] <= cap * weight:  # nobody from here on is above
            for j in order[k:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = cap
        left -= cap
        weight -= weights[i]
    return targets


def plan_sources(sized: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> list[SourcePlan]:
    """One entry a source, in code point order, null last. The driver holds a row a
    source: sources are names in a catalogue, their number does not grow with the documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    ws = [weights[i % len(weights)] for i in range(len(totals))]
    targets = water_fill(sizes, ws, share * sum(sizes), limit)
    plans = []
    for i, (r, t) in enumerate(zip(totals, targets, strict=True)):
        passes = int(t // r["size"]) if r["size"] else 0
        plans.append(SourcePlan(r["source"], i, r["size"], t, passes, t - passes * r["size"], r["size"] // BLOCK_WORDS + 1))
    return plans


def _split(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks from the root to one leaf of the tree: (first block, blocks) by source."""
    before, have, lo, hi = np.zeros_like(quotas), quotas, 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        given = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have
        if shard < mid:
            have, hi = given, mid
        else:
            before, have, lo = before + given, have - given, mid
    return before, have


class Mixture:
    """A planned mix of docs.

    sources: a row a source (rank, source, source_size, target). documents: a row a
    document (id, size, source_size, target). rows(): the mix itself.

    Weights go to sources in code point order, null last, repeating. Null and empty texts
    have size 0; they are taken with their block. The taken words of a source differ from
    its target by at most about half a document. No document is taken more often than
    `limit` rounded up, once in each pass. Repeated ids are taken together. An empty table
    gives an empty mix. The same input gives the same mix.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7, text: str = "text", id_col: str = "doc_id", source_col: str = "source"):
        self.docs, self.seed, self.text, self.id_col, self.source_col = docs, str(seed), text, id_col, source_col
        self.spark = docs.sparkSession
        sizes = stage_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size")), "mix-sizes")
        self.plans = plan_sources(sizes, weights, share, limit)
        self.shards = max(1, -(-int(sum(p.target for p in self.plans)) // SHARD_WORDS))
        rows = [(p.source, p.rank, p.size, p.target, p.passes, p.rest, p.blocks) for p in self.plans]
        self.sources = self.spark.createDataFrame(rows, "source string, rank int, source_size long, target double, passes int, rest double, n_blocks long")
        placed = self._placed(sizes.withColumn("key", self._key("id")))
        self.documents = placed.select(F.col("id").alias(id_col), "size", "source_size", "target")
        self._narrow = placed.select("rank", "block", "key", "size", "passes", "rest")

    def _key(self, id_col: str) -> Column:
        return F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def _placed(self, rows: DataFrame, source: str = "source") -> DataFrame:
        """rows with their source's plan and their block; one plan row a source is broadcast."""
        plan = F.broadcast(self.sources.withColumnRenamed("source", "of_source"))
        block = F.pmod(draw(self.seed, "block", F.col("key")), F.col("n_blocks"))
        return rows.join(plan, F.col(source).eqNullSafe(F.col("of_source"))).withColumn("block", block)

    def _units(self) -> tuple[DataFrame, DataFrame]:
        """Which blocks each shard takes in which pass, and the documents taken of a block
        that is taken in part."""
        blocks = self._narrow.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        drawn = draw(self.seed, "order", F.col("rank").cast("string"), F.col("block").cast("string"))
        blocks = blocks.withColumns({"place": F.struct(drawn.alias("drawn"), "block"), "one": F.lit(1)})
        # a large source has many blocks, so they are not numbered in one window
        blocks = running_sums(blocks, ["rank"], "place", ["one", "words"])
        blocks = blocks.select("rank", "block", "words", "passes", "rest", F.col("before_one").alias("at"), F.col("before_words").alias("before"))
        blocks = stage_table(blocks.withColumn("partial", F.expr("before < rest AND before + words > rest")), "mix-blocks")
        counts = {r["rank"]: r for r in blocks.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.expr("before < rest")).alias("more")).collect()}
        n_blocks = np.array([counts[p.rank]["n"] for p in self.plans], np.int64)
        quotas = np.array([counts[p.rank]["n"] * p.passes + counts[p.rank]["more"] for p in self.plans], np.int64)
        shards = self.shards
        seed = int(self.seed)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for shard in b["id"]:
                    first, n = _split(quotas, int(shard), shards, seed)
                    yield pd.DataFrame({"rank": np.arange(len(quotas), dtype=np.int32), "mix_shard": np.int32(shard), "first": first, "n": n, "of": n_blocks})[n > 0]

        drawn = self.spark.range(shards).mapInPandas(walk, "rank int, mix_shard int, first long, n long, of long")
        units = drawn.select("rank", "mix_shard", "of", F.explode(F.expr("sequence(first, first + n - 1)")).alias("unit"))
        units = units.select("rank", "mix_shard", F.expr("unit % of").alias("at"), F.expr("cast(unit div of AS int)").alias("mix_pass"))
        units = stage_table(units.join(blocks, ["rank", "at"]).selectExpr("rank", "block", "mix_shard", "mix_pass", "partial AND mix_pass = passes AS partial", "rest - before AS room"), "mix-units")
        cut = units.where("partial").select("rank", "block", "room")
        inside = Window.partitionBy("rank", "block").orderBy("nth", "key").rangeBetween(Window.unboundedPreceding, 0)
        chosen = self._narrow.join(cut, ["rank", "block"]).withColumn("nth", draw(self.seed, "cut", F.col("key"))).select("rank", "key", "size", "room", F.sum("size").over(inside).alias("upto"))
        return units, stage_table(chosen.where("upto - size / 2D <= room").select("rank", "key").distinct(), "mix-cut")

    def rows(self) -> DataFrame:
        """The columns of docs once for each time a document is taken, with size, mix_pass
        (0, 1, ...), mix_shard and mix_order (place within the shard)."""
        added = ("size", "mix_shard", "mix_pass", "mix_order")
        columns = [c for c in self.docs.columns if c not in added]
        if not self.plans:
            return self.docs.select(*columns).limit(0).selectExpr("*", "0L size", "0 mix_shard", "0 mix_pass", "0L mix_order")
        units, chosen = self._units()
        whole = self.docs.select(F.struct(*columns).alias("d"), self._key(self.id_col).alias("key"), F.col(self.source_col).cast("string").alias("own"), word_count(self.text).alias("size"))
        placed = self._placed(whole, "own").join(small_side(units, units.count()), ["rank", "block"])
        taken = placed.join(small_side(chosen.withColumn("in_cut", F.lit(True)), chosen.count()), ["rank", "key"], "left").where("NOT partial OR in_cut")
        order = draw(self.seed, "shuffle", F.col("mix_shard").cast("string"), F.col("mix_pass").cast("string"), F.col("key"))
        return taken.select("d.*", "size", "mix_shard", "mix_pass", order.alias("mix_order"))


def dealt(mixed: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix dealt by shard, each shard in its local order, for writing. With the number of
    shards each is a partition of its own; without, a partition may hold several."""
    whole = mixed.repartition("mix_shard") if shards is None else mixed.repartitionById(shards, "mix_shard")
    return whole.sortWithinPartitions("mix_shard", "mix_order")
