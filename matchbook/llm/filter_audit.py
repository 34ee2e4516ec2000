"""How filters of a corpus overlap, by inclusion and exclusion.

Each document is tested by five filters at once. For every set of filters, J(set) is the
number of documents that fail all of them: the sum of the products of their flags. From the
32 joint counts of a part of the corpus all else follows without another look at it:

- survivors of a set of filters: the sum of (-1)^|T| J(T) over its subsets T (Moebius);
- removed by a filter after others: survivors before less survivors after;
- redundant: what fails the filter, J of it alone, less what it removed;
- unique failures: the sum of (-1)^(|T|-1) J(T) over the sets T that hold the filter;
- Shapley value: (-1)^(|T|-1) J(T) is the Harsanyi dividend of T in the game "documents that
  a set of filters removes", and each of its filters gets an equal share of it.

Documents are reduced to five flags in Arrow batches, then to a row a text, then to a row a
pattern of flags; only the last are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import slices, whole_text

#: The filters' letters: few words, few distinct words, many capitals, symbols, copies.
FILTERS = "ABCDE"
_OF = ("n", "good", "toxic")
_BLANKS = np.isin(np.arange(256), [0x20, *range(9, 14)])
_FLAGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("fails", T.IntegerType())])


@dataclass(frozen=True)
class Limits:
    """A text fails A below least_words words, B below least_distinct distinct words in 100,
    C above most_capitals A-Z in 100 code points, D if it holds one of the symbols."""

    least_words: int = 100
    least_distinct: int = 80
    most_capitals: int = 10
    symbols: str = "#$%&*|"


def text_failures(texts: pa.Array, limits: Limits) -> np.ndarray:
    """Bits 0 to 3: whether the text fails A, B, C, D. Null is the empty text, which has no
    words and no characters and fails A alone."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[ends[1:]] - upto[ends[:-1]]

    word = ~_BLANKS[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    starts[heads] = word[heads]
    at = np.flatnonzero(starts)
    # a word ends before the next blank or document
    stop = np.append(~word, True)
    stop[heads] = True
    stops = np.flatnonzero(stop)
    after = stops[np.searchsorted(stops, at, side="right")]
    # words one after the other, without what lies between
    size = after - at
    offsets = np.concatenate([[0], np.cumsum(size)])
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes())]).dictionary_encode()
    of = np.searchsorted(ends, at, side="right") - 1
    kinds = max(1, len(held.dictionary))
    distinct = np.bincount(np.unique(of * kinds + held.indices.to_numpy()) // kinds, minlength=n) if len(at) else np.zeros(n, np.int64)

    words = total(starts)
    points = total((raw & 0xC0) != 0x80)
    capitals = total((raw >= 65) & (raw <= 90))
    symbols = total(np.isin(np.arange(256), list(limits.symbols.encode()))[raw])
    fails = (words < limits.least_words, 100 * distinct < limits.least_distinct * words, 100 * capitals > limits.most_capitals * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _flagged(limits: Limits, schema: pa.Schema):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = [pa.array(text_failures(part.column("text"), limits)) if f.name == "fails" else part.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return flag


def failure_patterns(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, fails (bit k for the k-th filter) and the documents, good and toxic ones of that
    pattern. A document is good or toxic if any label of its id says so; labels of no document
    count nowhere. Bit 4 is E: the same text stands under a smaller doc_id anywhere in docs. A
    null id is smaller than none and no id is smaller than it; rows of one id and text are not
    copies of each other."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("text"))
    given = given.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    flagged = given.mapInArrow(_flagged(limits, to_arrow_schema(_FLAGS)), _FLAGS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = flagged.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # ids lie together after the join, so their rows are counted where they are
    by_id = both.groupBy("doc_id", "digest", "part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    # a text is a row a part and label: its copies are added up before they are sent
    by_text = by_id.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("passes", F.col("unnamed") + F.when(first, F.col("of_least")).otherwise(0))
    passes = F.col("passes")
    by_text = by_text.withColumn("of", F.explode(F.array(F.struct(F.lit(0).alias("e"), passes.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - passes).alias("n")))))
    n = F.col("of.n")
    return by_text.groupBy("part", F.col("fails").bitwiseOR(F.col("of.e")).alias("fails")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def joint_failures(patterns: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """part and, for documents, good and toxic ones, an array of J over all sets of filters
    (place: the set as bits): sums of products of flags."""
    each = patterns.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
    # the flag of a filter that is not in the set counts as 1
    flags = [F.greatest(F.shiftright("fails", k).bitwiseAND(1), 1 - F.shiftright("set", k).bitwiseAND(1)) for k in range(n_filters)]
    product = reduce(Column.__mul__, flags)
    sums = each.groupBy("part", "set").agg(*[F.sum(F.col(of) * product).alias(of) for of in _OF])
    whole = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("set", *_OF))).alias("sets"))
    return whole.select("part", *[F.col("sets")[of].alias(of) for of in _OF])


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row a part, order of the filters and step, from the joint counts alone."""
    m = len(filters)
    steps = []
    for order in permutations(range(m)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(filters[x] for x in order), step, 1 << k, before, before | 1 << k))
            before |= 1 << k
    plan = joint.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int")
    # as many rows as orders have steps, whatever the data
    rows = joint.crossJoin(F.broadcast(plan))

    def over(sets: str, weight: str, of: str = "n") -> Column:
        """The sum of weight * J over the sets t for which `sets` holds."""
        return F.expr(f"aggregate(sequence(0, {(1 << m) - 1}), 0L, (x, t) -> if({sets}, x + {weight} * {of}[t], x))")

    moebius, dividend = "(1 - 2 * (bit_count(t) % 2))", "(2 * (bit_count(t) % 2) - 1)"
    survivors = lambda of, place: over(f"(t & {place}) = t", moebius, of)
    lost = {name: survivors(of, "before") - survivors(of, "after") for name, of in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))}
    holds = "(t & filter) = filter"
    rows = rows.withColumns({"kept": survivors("n", "after"), "unique_fails": over(holds, dividend), "shapley": over(holds, f"{dividend} * ({factorial(m)} div bit_count(t))"), **lost})
    redundant = (F.element_at("n", F.col("filter") + 1) - F.col("removed")).alias("redundant")
    return rows.select("part", "filter_order", "step", "kept", "removed", redundant, "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The interactions of the five filters in each part (lang; null: empty string) of docs.
    An empty table has no parts and gives no rows; other columns are not looked at."""
    return interactions(joint_failures(failure_patterns(docs, labels, limits)))
