"""Choosing controls: optimal assignment, greedy matching, splits of groups.

Optimal choices are made in the connected components of a block's (a site's, a stratum's)
allowed pairs, which are matching problems of their own: Spark deals the components, a task
solves one. A component's pairs are held by one task, whatever its number of slots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.graph import connected_components
from matchbook.operators.prefix import ranged, running_sums
from matchbook.session import stage_table

#: Slots and candidates up to which a component is solved on a grid.
MAX_BLOCK = 2048
#: Pairs up to which a block's components are found in the task that solves them.
SMALL_BLOCK = 1 << 16


def _assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of rows to distinct columns (rows <=
    columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)  # 1-based, 0 is free
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        best, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j]:
            seen[j] = True
            reduced = cost[row_of[j] - 1] - row_price[row_of[j]] - col_price[1:]
            closer = ~seen[1:] & (reduced < best[1:])
            best[1:][closer] = reduced[closer]
            back[1:][closer] = j
            step = np.where(seen, np.inf, best)
            step[0] = np.inf
            nxt = int(step.argmin())
            delta = step[nxt]
            row_price[row_of[seen]] += delta
            col_price[seen] -= delta
            best[~seen] -= delta
            j = nxt
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def _assign_sparse(slots: np.ndarray, candidates: np.ndarray, cost: np.ndarray, unserved: float) -> np.ndarray:
    """The same over a list of pairs (slot and candidate numbers): the place in the list of each
    slot's pair, -1 for slots that stay without one, which costs `unserved`. Memory grows with
    the pairs, not with slots times candidates; a search ends at the first free candidate."""
    order = np.lexsort((candidates, slots))
    n, m = int(slots.max()) + 1, int(candidates.max()) + 1
    first = np.searchsorted(slots[order], np.arange(n + 1)).tolist()
    to, price, place = candidates[order].tolist(), cost[order].tolist(), order.tolist()
    slot_price, candidate_price = [0.0] * n, [0.0] * m
    slot_of, pair_of = [-1] * m, [-1] * n
    for s in range(n):
        away: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        closed: set[int] = set()
        heap: list[tuple[float, int]] = []
        # the cheapest way to leave a slot on the path without a candidate
        give_up, who, at, base, end = np.inf, -1, s, 0.0, -1
        while True:
            start = base - slot_price[at]
            if start + unserved < give_up:
                give_up, who = start + unserved, at
            for e in range(first[at], first[at + 1]):
                j = to[e]
                d = start + price[e] - candidate_price[j]
                if j not in closed and d < away.get(j, np.inf):
                    away[j], back[j] = d, (at, e)
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in closed or heap[0][0] > away[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or give_up < heap[0][0]:
                least = give_up
                break
            base, j = heapq.heappop(heap)
            closed.add(j)
            if slot_of[j] < 0:
                least, end = base, j
                break
            done.append(j)
            at = slot_of[j]
        slot_price[s] += least
        for j in done:
            slot_price[slot_of[j]] += least - away[j]
            candidate_price[j] += away[j] - least
        if end < 0:
            # the slot that gives up frees its candidate for the path before it
            end = to[pair_of[who]] if who != s else -1
            pair_of[who] = -1
        while end >= 0:
            i, e = back[end]
            freed = to[pair_of[i]] if i != s else -1
            slot_of[end], pair_of[i] = i, e
            end = freed
    return np.array([place[e] if e >= 0 else -1 for e in pair_of])


def _components(slots: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The component of each pair of slot and candidate numbers, by the first slot's number."""
    above = list(range(int(slots.max()) + 1))
    slot_of: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for s, c in zip(slots.tolist(), candidates.tolist(), strict=True):
        u, v = root(s), root(slot_of.setdefault(c, s))
        if u != v:
            above[max(u, v)] = min(u, v)
    return np.array([root(s) for s in slots.tolist()])


def _cheapest(slots: np.ndarray, candidates: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, candidates and costs of the cheapest choice among one component's pairs."""
    (s, of_s), (c, of_c) = np.unique(slots, return_inverse=True), np.unique(candidates, return_inverse=True)
    high = (float(np.abs(costs).max()) + 1) * (len(s) + 1) * 4
    if max(len(s), len(c)) > MAX_BLOCK:
        # of repeated pairs the cheapest
        best = pd.DataFrame({"s": of_s, "c": of_c, "cost": costs}).sort_values("cost", kind="stable").drop_duplicates(["s", "c"])
        got = _assign_sparse(best["s"].to_numpy(), best["c"].to_numpy(), best["cost"].to_numpy(), high)
        best = best.iloc[got[got >= 0]]
        return s[best["s"]], c[best["c"]], best["cost"].to_numpy()
    grid = np.full((len(s), len(c) + len(s)), high)  # a spare column a slot
    np.minimum.at(grid, (of_s, of_c), costs)
    got = _assign(grid)
    taken = np.flatnonzero((got < len(c)) & (grid[np.arange(len(s)), got] < high))
    return s[taken], c[got[taken]], grid[taken, got[taken]]


def _chosen(batches: Iterator[pd.DataFrame], block: str) -> Iterator[pd.DataFrame]:
    """The cheapest choices of blocks; rows are sorted by block. Holds a batch and a block."""
    names = [block, "slot", "candidate", "cost"]

    def of_rows(rows: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
        slots, candidates, costs = (rows[n].to_numpy() for n in names[1:])
        picked, of = [], []
        for i, j in zip([0, *ends], ends, strict=False):
            where = slice(i, j)
            part = _components(np.unique(slots[where], return_inverse=True)[1], np.unique(candidates[where], return_inverse=True)[1])
            for x in sorted(set(part.tolist())):
                one = part == x
                picked.append(_cheapest(slots[where][one], candidates[where][one], costs[where][one]))
                of.append(np.full(len(picked[-1][0]), i))
        columns = [np.concatenate(x) for x in zip(*picked, strict=True)]
        return pd.DataFrame({block: rows[block].iloc[np.concatenate(of)].reset_index(drop=True), **dict(zip(names[1:], columns, strict=True))})

    held = None
    for b in batches:
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(rows):
            continue
        name, before = rows[block], rows[block].shift()
        starts = np.flatnonzero((name.ne(before) & ~(name.isna() & before.isna())).to_numpy()[1:]) + 1
        if len(starts):
            yield of_rows(rows, starts.tolist())
        held = rows.iloc[starts[-1] :] if len(starts) else rows
    if held is not None and len(held):
        yield of_rows(held, [len(held)])


def optimal(costs: DataFrame, block: str) -> DataFrame:
    """block, slot, candidate, cost: of (block, slot, candidate, cost) pairs the cheapest
    choice of distinct candidates for as many slots as can have one. A pair that is absent
    is not allowed. Ties go to whichever the ordered ids give. Blocks of at most SMALL_BLOCK pairs
    are split into components in the task that solves them, larger ones in Spark. Components of more
    than MAX_BLOCK slots or candidates are solved on the list of their pairs, not on a grid."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(("slot", "candidate", "cost"), _cheapest(*(pdf[n].to_numpy() for n in ("slot", "candidate", "cost"))), strict=True))
        return pd.DataFrame({block: pdf[block].iloc[np.zeros(len(got["slot"]), int)].reset_index(drop=True), **got})

    kinds = dict(costs.dtypes)
    schema = f"{block} {kinds[block]}, slot {kinds['slot']}, candidate {kinds['candidate']}, cost double"
    pairs = stage_table(costs.select(block, "slot", "candidate", F.col("cost").cast("double").alias("cost")), "optimal-pairs")
    large = stage_table(pairs.groupBy(F.col(block).alias("__large")).count().where(F.col("count") > SMALL_BLOCK).select("__large"), "optimal-large")
    same = F.col(block).eqNullSafe(F.col("__large"))
    small = pairs.join(large, same, "left_anti").repartition(block).sortWithinPartitions(block, "slot", "candidate", "cost").mapInPandas(lambda batches: _chosen(batches, block), schema)
    if large.isEmpty():
        return small
    pairs = stage_table(pairs.join(large, same, "left_semi"), "optimal-pairs")
    # structs with null fields are equal, so null blocks are a block
    sides = {side: F.struct(block, side) for side in ("slot", "candidate")}
    for side, key in sides.items():
        nodes = stage_table(pairs.select(key.alias(f"{side}_key")).distinct().withColumn(f"{side}_node", F.monotonically_increasing_id() * 2 + int(side == "slot")), "optimal-nodes")
        pairs = pairs.withColumn(f"{side}_key", key).join(nodes, f"{side}_key").drop(f"{side}_key")
    pairs = stage_table(pairs, "optimal-pairs")
    found = connected_components(pairs, "slot_node", "candidate_node").withColumnRenamed("node", "slot_node")
    return pairs.join(found, "slot_node").select(block, "slot", "candidate", "cost", "component").groupBy("component").applyInPandas(solve, schema).union(small)


def _one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by component and order those whose both sides are free when their
    turn comes. Holds the sides taken in one component."""
    component, taken_a, taken_b = None, set(), set()
    for batch in batches:
        keep = []
        for k, (c, a, b) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("__component", "__a", "__b")), strict=True)):
            if c != component:
                component, taken_a, taken_b = c, set(), set()
            if a not in taken_a and b not in taken_b:
                taken_a.add(a)
                taken_b.add(b)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


def greedy(pairs: DataFrame, order: Sequence[Column], a: str = "a", b: str = "b", most: int = 1 << 20) -> DataFrame:
    """One-to-one matching that takes pairs in `order` (ending in unique ids) whenever both
    sides are free, as one pass over the sorted pairs would. Null sides are a side like others.

    Pairs of different connected components don't touch each other, so a component is one
    sorted pass in a task, whatever its depth. One of more than `most` pairs goes through by
    its leading range partitions: what the first pairs take does not depend on later ones, so
    they are settled, all pairs of taken sides leave, and the rest, which mostly falls apart,
    is split into components anew."""
    orders = [f"__o{i}" for i in range(len(order))]
    left = stage_table(pairs.select(F.col(a).alias("__a"), F.col(b).alias("__b"), *[o.alias(n) for o, n in zip(order, orders, strict=True)]), "greedy")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        # sides by hash: a collision joins two components, which changes nothing but their task
        sides = left.withColumns({"__u": F.xxhash64(F.lit(0), "__a"), "__v": F.xxhash64(F.lit(1), "__b")})
        found = connected_components(sides, "__u", "__v").select(F.col("node").alias("__u"), F.col("component").alias("__component"))
        placed = ranged(sides.join(found, "__u").drop("__u", "__v"), ["__component", *orders], "greedy-components")
        parts = placed.groupBy("__component", "__part").count()
        group = Window.partitionBy("__component")
        parts = parts.withColumns({"before": F.coalesce(F.sum("count").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        parts = stage_table(parts.select("__component", "__part", ((F.col("before") + F.col("count") > most) & (F.col("before") > 0)).alias("later")), "greedy-parts")
        now = placed.join(parts, ["__component", "__part"])
        first = now.where("NOT later").select("__component", "__a", "__b", *orders).repartition("__component").sortWithinPartitions("__component", *orders)
        got = stage_table(first.mapInArrow(_one_pass, first.schema).select("__a", "__b"), "greedy-taken")
        taken.append(got)
        if parts.where("later").isEmpty():
            break
        rest = now.where("later").select("__a", "__b", *orders)
        for side in ("__a", "__b"):
            gone = got.select(F.col(side).alias("__gone")).distinct()
            rest = rest.join(gone, F.col(side).eqNullSafe(F.col("__gone")), "left_anti")
        left = stage_table(rest, "greedy")
    out = reduce(DataFrame.union, taken, left.select("__a", "__b").limit(0))
    return out.select(F.col("__a").alias(a), F.col("__b").alias(b))


def group_split(rows: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """rows with split: whole groups go to test with chance `share`, by a hash of the group."""
    u = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(1_000_000))
    return rows.withColumn("split", F.when(u < int(share * 1_000_000), "test").otherwise("train"))


def stratified_split(sites: DataFrame, id_col: str, stratum: str, share: float, least: int, seed: int = 0) -> DataFrame:
    """sites (a row a group, not a row an observation) with split: of each stratum the share
    that comes first by a hash, rounded up, goes to test. Strata of fewer than `least` rows
    become one, 'other'. Null strata are a stratum."""
    counts = sites.groupBy(stratum).agg(F.count("*").alias("__n"))
    whole = sites.withColumnRenamed(stratum, "__s").join(counts.withColumnRenamed(stratum, "__s"), "__s", "left")
    named = whole.withColumn(stratum, F.when(F.col("__n") < least, "other").otherwise(F.col("__s"))).drop("__s", "__n")
    by = Window.partitionBy(stratum)
    at = F.row_number().over(by.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col))
    return named.withColumn("split", F.when(at <= F.ceil(share * F.count("*").over(by)), "test").otherwise("train"))


def balanced_folds(rows: DataFrame, group: str, folds: int = 2, label: str | None = None) -> DataFrame:
    """group, n, fold: groups by size, largest first, dealt forth and back over the folds, for
    each class mix apart if a label is given, so that folds differ by at most a group."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), (F.round(F.avg(label)).cast("int") if label else F.lit(0)).alias("mix"))
    at = F.row_number().over(Window.partitionBy("mix").orderBy(F.desc("n"), group)) - 1
    lap, place = F.floor(at / folds), at % folds
    return sizes.withColumn("fold", F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")).select(group, "n", "fold")


def _placed_by_spread(counts: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each group (a row of class counts): groups of the most uneven counts first,
    each to the fold that keeps the classes' shares over the folds most even, then to the
    fold of the fewest rows, then to the first."""
    total = np.maximum(counts.sum(0), 1).tolist()
    held = [[0.0] * folds for _ in total]
    shares = [[0.0] * folds for _ in total]
    rows, fold = [0.0] * folds, np.zeros(len(counts), int)

    def spread(share: list[float]) -> float:
        mean = 0.0
        for x in share:
            mean += x
        mean /= folds
        off = 0.0
        for x in share:
            off += (x - mean) * (x - mean)
        return math.sqrt(off / folds)

    # plain numbers: a call of numpy costs more than a group's few sums
    for g in np.argsort(-counts.std(1), kind="stable").tolist():
        own = counts[g].tolist()
        n = math.fsum(own)
        best = None
        for f in range(folds):
            uneven = 0.0
            for c, x in enumerate(own):
                share = shares[c]
                kept, share[f] = share[f], (held[c][f] + x) / total[c]
                uneven += spread(share)
                share[f] = kept
            way = (round(uneven / len(own), 12), rows[f] + n, f)
            if best is None or way < best:
                best = way
        f = fold[g] = best[2]
        rows[f] += n
        for c, x in enumerate(own):
            held[c][f] += x
            shares[c][f] = held[c][f] / total[c]
    return fold


def _nearest_in_rate(counts: np.ndarray, fold: np.ndarray, folds: int) -> int | None:
    """The fold with both classes whose share of the first is nearest to that of all; the
    first of equals; None if no fold has both."""
    rate = counts[:, 0].sum() / counts.sum()
    ways = [(abs(own[0] / own.sum() - rate), f) for f in range(folds) if (own := counts[fold == f].sum(0)).min() > 0]
    return min(ways)[1] if ways else None


def nested_group_folds(rows: DataFrame, group: str, label: str, outer: int = 5, inner: int = 4) -> DataFrame:
    """group, n, n_negative, fold, inner_fold, split: whole groups dealt to outer folds by the
    spread of their class counts (labels 0 and 1; others don't count). The fold nearest in class
    rate is the test; the other groups are dealt again, and of these inner folds the one
    nearest in rate is the validation; the rest trains. Equal inputs give equal folds. Where
    no fold has both classes, ValueError. A null group is a group.

    Placing is one group after the other, so it runs in one task on a row a group; rows only
    are counted."""
    kind = dict(rows.dtypes)[group]
    counts = rows.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group, na_position="first", ignore_index=True)
        own = pdf[["n_negative", "n_positive"]].to_numpy(float)
        fold = _placed_by_spread(own, outer)
        test = _nearest_in_rate(own, fold, outer)
        if test is None:
            raise ValueError("no fold has both classes")
        rest = np.flatnonzero(fold != test)
        inside = np.full(len(own), -1)
        inside[rest] = _placed_by_spread(own[rest], inner)
        validation = _nearest_in_rate(own[rest], inside[rest], inner)
        split = np.where(fold == test, "test", np.where(inside == validation, "validation", "train"))
        return pd.DataFrame({group: pdf[group], "n": own.sum(1).astype(np.int64), "n_negative": own[:, 0].astype(np.int64), "fold": fold.astype(np.int32), "inner_fold": pd.array(np.where(inside < 0, None, inside), dtype="Int32"), "split": split})

    return counts.groupBy().applyInPandas(place, f"{group} {kind}, n long, n_negative long, fold int, inner_fold int, split string")


def training_weights(rows: DataFrame, site: str, label: str) -> DataFrame:
    """rows with weight: 1 / rows of the site times n / (2 rows of the class), over its mean."""
    by_site = rows.groupBy(site).agg(F.count("*").alias("in_site"))
    by_class = rows.groupBy(label).agg(F.count("*").alias("in_class"))
    n = rows.agg(F.count("*").alias("n"))
    raw = rows.join(by_site, site).join(by_class, label).join(F.broadcast(n)).withColumn("raw", (1 / F.col("in_site")) * (F.col("n") / (2 * F.col("in_class"))))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).withColumn("weight", F.col("raw") / F.col("mean")).drop("in_site", "in_class", "n", "raw", "mean")


def threshold_search(scored: DataFrame, score: str, truth: str, fold: str) -> DataFrame:
    """threshold, mean_ba, min_ba, recall of the best threshold among 0, 1, all scores and
    their midpoints: by mean balanced accuracy over folds, then the worst fold's, then
    recall, then the smaller threshold. guess is score >= threshold.

    Counts per fold and score are running sums over range partitions, so no threshold meets
    every row and no task all scores. Rows without a score are never guessed."""
    ends = scored.sparkSession.createDataFrame([(0.0,), (1.0,)], "t double")
    # midpoints lie between neighbours, which a range partition has but for its last value's
    values = ranged(scored.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("t")).distinct(), ["t"], "thresholds")
    firsts = values.groupBy(F.col("__part").alias("__of")).agg(F.min("t").alias("first"))
    firsts = firsts.select("__of", F.lead("first").over(Window.orderBy("__of")).alias("following"))  # a row a partition
    after = values.join(firsts, F.col("__part") == F.col("__of")).select("t", F.coalesce(F.lead("t").over(Window.partitionBy("__part").orderBy("t")), "following").alias("n"))
    candidates = values.select("t").union(after.where("n IS NOT NULL").select((F.col("t") + F.col("n")) / 2)).union(ends).distinct()
    folds = scored.groupBy(fold).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    steps = scored.where(F.col(score).isNotNull()).groupBy(fold, F.col(score).cast("double").alias("t")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("m"))
    # thresholds and scores on one axis per fold: what lies below a threshold is not guessed
    marks = candidates.join(F.broadcast(folds.select(fold))).select(fold, "t", F.lit(0).alias("p"), F.lit(0).alias("m"), F.lit(True).alias("is_threshold"))
    axis = steps.withColumn("is_threshold", F.lit(False)).unionByName(marks).groupBy(fold, "t").agg(F.sum("p").alias("p"), F.sum("m").alias("m"), F.bool_or("is_threshold").alias("is_threshold"))
    totals = steps.groupBy(fold).agg(F.sum("p").alias("all_p"), F.sum("m").alias("all_m"))
    at = running_sums(axis, [fold], "t", ["p", "m"]).where("is_threshold").join(F.broadcast(folds.join(totals, fold)), fold)
    at = at.select(fold, "t", "pos", "neg", (F.col("all_p") - F.col("before_p")).alias("tp"), (F.col("all_m") - F.col("before_m")).alias("fp"))
    at = at.withColumn("recall", F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).withColumn("ba", (F.col("recall") + 1 - F.col("fp") / F.nullif(F.col("neg"), F.lit(0))) / 2)
    out = at.groupBy(F.col("t").alias("threshold")).agg(F.round(F.avg("ba"), 9).alias("mean_ba"), F.round(F.min("ba"), 9).alias("min_ba"), F.round(F.avg("recall"), 9).alias("recall"))
    return out.orderBy(F.desc("mean_ba"), F.desc("min_ba"), F.desc("recall"), "threshold").limit(1)
