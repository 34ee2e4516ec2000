"""Exact dedup by content sort.

Sampled splitters range-partition the rows by (leading characters, digest, id);
Spark's external sort puts equal texts next to each other; a streaming pass
compares each text in full with its neighbour. The id is part of the order, so
the copies of one text may spread over many partitions: no task holds a hot
group, and the runs that touch a partition's edges are stitched afterwards from
one marker row a partition. Splitters hold only the leading characters and a
digest, so that sampling stays small however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import whole_text
from matchbook.session import stage_table

#: Characters of the text that lead the sort key.
LEAD = 48
_MARK = ("first_head", "first_size", "last_run", "last_head", "last_size")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], sized: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours in one sorted partition and gives each row
    the id at the head of its run. If sizes are wanted, rows of the run that is still
    open wait (ids only, no texts). The last row is a marker with the partition's edges."""
    part = TaskContext.get().partitionId()
    run, head, size = -1, None, 0  # of the open run
    prev = first = first_text = last_text = None
    waiting: list[pa.RecordBatch] = []

    def out(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def rows(b: pa.RecordBatch, runs: np.ndarray, heads: pa.Array, new: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        marks = {"part": np.full(len(runs), part), "run": runs, "is_head": new, "size": sizes}
        return out(len(runs), {k: b.column(k) for k in names} | {k: pa.array(v) for k, v in marks.items()} | {"head_id": heads})

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, ids = batch.column("__text"), batch.column("__id")
        new = np.ones(n, bool)
        new[0] = run < 0 or text[0].as_py() != prev
        new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        prev = text[n - 1].as_py()
        runs = run + np.cumsum(new)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        heads = pc.if_else(pa.array(begin >= 0), ids.take(pa.array(np.maximum(begin, 0))), pa.scalar(head, pa.int64()))
        base = max(run, 0)
        counts = np.bincount(runs - base)
        counts[0] += size
        if first is None and runs[-1] > 0:
            first = (head if run == 0 else ids[0].as_py(), int(counts[0]))
        if new.any():
            edge = np.flatnonzero(new)
            first_text = text[int(edge[0])].as_py() if run < 0 else first_text
            last_text = text[int(edge[-1])].as_py()
        if sized:
            if runs[-1] > run and waiting:
                for b in waiting:
                    k = b.num_rows
                    yield rows(b, np.full(k, run), pa.repeat(pa.scalar(head, pa.int64()), k), np.zeros(k, bool), np.full(k, counts[0]))
                waiting = []
            done = int(np.searchsorted(runs, runs[-1]))
            if done:
                yield rows(batch.slice(0, done), runs[:done], heads.slice(0, done), new[:done], counts[runs[:done] - base])
            waiting.append(batch.slice(done))
        else:
            yield rows(batch, runs, heads, new, np.zeros(n, np.int64))
        run, head, size = int(runs[-1]), heads[n - 1].as_py(), int(counts[-1])
    if run < 0:
        return
    for b in waiting:
        k = b.num_rows
        yield rows(b, np.full(k, run), pa.repeat(pa.scalar(head, pa.int64()), k), np.zeros(k, bool), np.full(k, size))
    first = first or (head, size)
    marker = {"part": part, "first_text": first_text, "last_text": last_text, "first_head": first[0], "first_size": first[1], "last_run": run, "last_head": head, "last_size": size}
    yield out(1, {k: pa.array([v], schema.field(k).type) for k, v in marker.items()})


def _stitched(markers: DataFrame) -> list[tuple]:
    """(part, run, head, size, goes on from the partition before) of the runs at the
    edges, those across an edge joined. One row a partition, without its texts."""
    spark = markers.sparkSession
    parts = sorted(r[0] for r in markers.select("part").collect())
    if not parts:
        return []
    prior = spark.createDataFrame(list(zip(parts[1:], parts, strict=False)), "part int, prior int")
    same = {r[0] for r in markers.alias("m").join(prior, "part").join(markers.select(F.col("part").alias("prior"), F.col("last_text").alias("prior_text")), "prior").where("first_text = prior_text").select("part").collect()}
    chains: list[list] = []
    where: list[tuple[int, int, int, bool]] = []
    for r in sorted(markers.select("part", *_MARK).collect(), key=lambda r: r["part"]):
        if r["part"] in same:
            chains[-1][1] += r["first_size"]
        else:
            chains.append([r["first_head"], r["first_size"]])
        where.append((r["part"], 0, len(chains) - 1, r["part"] in same))
        if r["last_run"]:
            chains.append([r["last_head"], r["last_size"]])
            where.append((r["part"], r["last_run"], len(chains) - 1, False))
    return [(p, run, *chains[c], on) for p, run, c, on in where]


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "smallest", normalise: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Finds texts that are equal after `normalise` (default: no change).

    Without `carry`: one row per input row: id, keep_id (the row that stays), group_size,
    kept, text_sha256. With `carry`: the rows that stay, with those columns alone.
    keep: "smallest" or "largest" id of equal texts stays. Null texts count as empty
    and equal the empty text. With `carry`, of repeated rows one stays; without, each
    repeated row with the kept id says kept.
    A null id sorts below all others. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    body = whole_text(text) if normalise is None else F.coalesce(normalise, F.lit(""))
    names = ["__id", "__sha"] if carry is None else [f"__c{i}" for i in range(len(carry))]
    # an unchanged text travels once, as the sort's own column; a flag restores its nulls
    share_text = carry is not None and normalise is None and text in carry
    kept = [] if carry is None else [(F.col(c).isNull() if c == text and share_text else F.col(c)).alias(n) for c, n in zip(carry, names, strict=True)]
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), body.alias("__text"), *kept)
    rows = rows.withColumn("__sha", F.sha2(F.col("__text"), 256)).withColumn("__lead", F.substring("__text", 1, LEAD))
    order = [F.asc("__lead"), F.asc("__sha"), F.asc_nulls_first("__id") if keep == "smallest" else F.desc_nulls_last("__id")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__lead")
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in names]
    if share_text:
        fields.append(T.StructField("__text", T.StringType()))
    added = "part int, run long, head_id long, is_head boolean, size long, first_text string, last_text string, first_head long, first_size long, last_run long, last_head long, last_size long"
    out = T.StructType(fields + T.StructType.fromDDL(added).fields)
    schema = to_arrow_schema(out)
    passed = [f.name for f in fields]
    sized = carry is None
    staged = stage_table(rows.mapInArrow(lambda it: _runs(it, passed, sized, schema), out), "exact-runs")
    edges = docs.sparkSession.createDataFrame(_stitched(staged.where("last_run IS NOT NULL")), "part int, run long, edge_head long, edge_size long, goes_on boolean")
    # two rows a partition at most
    joined = staged.where("last_run IS NULL").join(F.broadcast(edges), ["part", "run"], "left")
    if carry is None:
        ids = joined.select(F.col("__id").alias(id_col), F.when(F.col("goes_on").isNull(), F.col("head_id")).otherwise(F.col("edge_head")).alias("keep_id"), F.coalesce("edge_size", "size").alias("group_size"), F.col("__sha").alias("text_sha256"))
        return ids.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    flag = f"__c{carry.index(text)}" if share_text else None
    back = [(F.when(~F.col(n), F.col("__text")) if n == flag else F.col(n)).alias(c) for c, n in zip(carry, names, strict=True)]
    return joined.where(F.col("is_head") & ~F.coalesce("goes_on", F.lit(False))).select(*back)
