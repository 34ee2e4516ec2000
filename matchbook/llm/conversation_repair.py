"""The cheapest repair of each conversation's structure, by a DP shared in a trie.

A conversation becomes a signature, a letter a row for its role and fault. How cheaply it can
be brought to the wanted order of roles depends on the signature alone, and the cheapest way
to finish from a place in it depends on the rows from there on alone. So distinct signatures
are sorted last row first and walked as a prefix trie: each node holds one DP layer, four
costs for the rows behind it, computed once for all signatures that share them, and a
signature's end in the trie emits its answer by a walk back along the layers.

Rows travel narrow (a digest for the text) until the answers are known. Only the last step
brings texts together, sorted, and hashes them in a stream: a conversation of any length
takes a task's time, not its memory. What is held whole is a byte a row of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.operators.prefix import ranged
from matchbook.session import stage_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults in the order in which the first one counts; a letter of a signature is role * 4 + fault.
OK, BLANK, DUPLICATE, CUT = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that a new or changed row takes in each state, and where it leads.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_VISIBLE = r"[^\x20\x09-\x0D]"
_NONE = 1 << 60


def _kept(state: int, role: int) -> int | None:
    """The state after a row that keeps its role, or None where the order forbids it."""
    if role == SYSTEM:
        return AFTER_S if state == START else None
    if role == USER:
        return None if state == AFTER_U else AFTER_U
    return AFTER_A if role == ASSISTANT and state == AFTER_U else None


def _with_inserts(cost: list[int]) -> tuple[int, ...]:
    u, a = min(cost[AFTER_U], INSERT + cost[AFTER_A]), min(cost[AFTER_A], INSERT + cost[AFTER_U])
    return min(cost[START], INSERT + u), min(cost[AFTER_S], INSERT + u), u, a


#: Costs to finish where no rows are left.
END = _with_inserts([0, _NONE, _NONE, 0])


def _row_costs(letter: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits a row can take: (initial, cost, state after it)."""
    role, fault = divmod(letter, 4)
    out = []
    for state in range(4):
        ways = [("D", DELETE, state)]
        if fault in (OK, CUT):
            extra = TRUNCATED * (fault == CUT)
            after = _kept(state, role)
            if after is not None:
                ways.append(("K", KEEP + extra, after))
            ways.append(("R", REROLE + extra, NEXT[state]))
        out.append(ways)
    return out


_WAYS = [_row_costs(letter) for letter in range(16)]


def layer(letter: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to finish from each state, from a row and the costs behind it."""
    return _with_inserts([min(cost + behind[after] for _, cost, after in ways) for ways in _WAYS[letter]])


def audit_of(letters: Iterable[int], layers: list[tuple[int, ...]]) -> str:
    """The initials of the cheapest edits in order, the ASCII-least of the cheapest: D before
    I before K before R. layers[k]: costs before the k-th row."""
    out, state = [], START
    for k, letter in enumerate([*letters, None]):
        while True:
            left = layers[k][state]
            ways = [] if letter is None else [w for w in _WAYS[letter][state] if w[1] + layers[k + 1][w[2]] == left]
            if ways and ways[0][0] == "D":
                break
            if INSERT + layers[k][NEXT[state]] == left:
                out.append("I")
                state = NEXT[state]
                continue
            break
        if letter is not None:
            initial, _, state = ways[0]
            out.append(initial)
    return "".join(out)


def _answers(schema: pa.Schema):
    """Sorted signatures, last row first, to their costs and audits."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, layers = b"", [END]
        for batch in batches:
            costs, audits = [], []
            for text in batch.column("reversed").to_pylist():
                word = text.encode()
                same = 0
                for x, y in zip(path, word):  # noqa: B905
                    if x != y:
                        break
                    same += 1
                del layers[same + 1 :]
                for x in word[same:]:
                    layers.append(layer(x - 65, layers[-1]))
                path = word
                costs.append(layers[-1][START])
                audits.append(audit_of((x - 65 for x in reversed(word)), layers[::-1]))
            yield pa.RecordBatch.from_arrays([batch.column("reversed"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], schema=schema)

    return walk


def repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature of the rows."""
    schema = T.StructType([T.StructField("reversed", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    words = signatures.select(F.reverse("signature").alias("reversed")).distinct()
    walked = words.repartitionByRange("reversed").sortWithinPartitions("reversed").mapInArrow(_answers(to_arrow_schema(schema)), schema)
    return walked.select(F.reverse("reversed").alias("signature"), "cost", "audit")


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after a damage drawn from crc32 of `conv_id:turn`; nulls of any of the four columns
    are one space there, as are null roles and texts. Dropped rows stay with dropped set, so
    that their conversation is not lost."""
    draw = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    role = F.when(draw == 4, F.lit("user")).otherwise(_spaced("role"))
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (draw == 0).alias("dropped"), F.when(draw == 3, 2).otherwise(1).alias("copies"))
    return given.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, its signature, gaps, blank, duplicate and truncated of damaged rows, which
    stand by turn, nulls first; rows of one turn by role and the text's digest. Faults: blank, then
    role and text seen earlier, then a last visible character other than . ! or ?"""
    digest = F.unhex(F.sha2("text", 256))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("visible"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("ended"), CUT).otherwise(OK)
    role = F.when(F.startswith("role", F.lit("s")), SYSTEM).when(F.startswith("role", F.lit("u")), USER).when(F.startswith("role", F.lit("a")), ASSISTANT).otherwise(OTHER)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.col("text").rlike(_VISIBLE).alias("visible"), ended.alias("ended"), "dropped")
    narrow = narrow.withColumn("nth", seen).select("conv_id", "turn", "role", "digest", "dropped", "nth", fault.alias("fault"), role.alias("kind"))
    letter = F.when(F.col("dropped"), F.lit("")).otherwise(F.chr(65 + F.col("kind") * 4 + F.col("fault")))
    placed = ranged(narrow.withColumn("letter", letter), ["conv_id", F.col("turn").asc_nulls_first()], "turns")
    # a piece for each conversation and range of turns; all rows of a turn lie in one
    shown, turn = ~F.col("dropped"), F.when(~F.col("dropped"), F.col("turn"))
    counts = [F.count(F.when(shown & (F.col("fault") == k), 1)).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    known = F.struct(F.col("turn").isNotNull(), "turn", "role", "digest", "nth", "letter")
    pieces = placed.groupBy("conv_id", "__part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(known)), lambda x: x["letter"]), "").alias("piece"), F.min(turn).alias("low"), F.max(turn).alias("high"), F.size(F.array_distinct(F.collect_list(turn))).alias("turns"), *counts
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "piece"))), lambda x: x["piece"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    return pieces.groupBy("conv_id").agg(whole.alias("signature"), gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def illegal() -> Column:
    """Neighbouring rows of a signature whose roles are not system-user, user-assistant or
    assistant-user."""

    def role(k: Column) -> Column:
        return F.shiftright(F.ascii(F.substring("signature", k, F.lit(1))) - 65, 2)

    def bad(k: Column) -> Column:
        a, b = role(k), role(k + 1)
        return ~(((a == USER) & (b == ASSISTANT)) | ((b == USER) & a.isin(SYSTEM, ASSISTANT)))

    n = F.length("signature")
    return F.when(n < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), bad))).cast("long")


def _hashed(schema: pa.Schema):
    """Rows by conversation, its audit first and then its rows in order, to digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, place, state, digest, lines = None, None, 0, START, None, 0
        done: list[tuple] = []

        def line(role: str, text: str) -> None:
            nonlocal lines
            digest.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1

        def inserts() -> None:
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                state = NEXT[state]
                line("user" if state == AFTER_U else "assistant", "")
                place += 1

        def close() -> None:
            if audit is not None:
                inserts()
                done.append((conv, digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)
            done.clear()
            return out

        for rows in batches:
            for c, a, role, text in zip(*(rows.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True):
                if a is not None:
                    close()
                    conv, audit, place, state, digest, lines = c, a, 0, START, hashlib.sha256(), 0
                    continue
                inserts()
                edit = audit[place]
                place += 1
                if edit == "K":
                    state = {"s": AFTER_S, "u": AFTER_U}.get(role[:1], AFTER_A)
                    line(role, text)
                elif edit == "R":
                    state = NEXT[state]
                    line("user" if state == AFTER_U else "assistant", text)
            yield batch()
        close()
        yield batch()

    return run


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and the sha256 of its repaired lines `role:text`. A conversation's rows go to
    one task, as its hash runs through all of them, but pass as a stream."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])
    heads = audits.select("conv_id", F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))])
    turns = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_hashed(to_arrow_schema(schema)), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """A row a conv_id of the table, the null one too: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 after the damage. A conversation that lost all
    rows has zeros, an empty audit and the hash of the empty string. Repeated rows are
    duplicates of each other; an empty table gives no rows; other columns are not looked at."""
    rows = damaged(conversations)
    known = signatures(rows)
    # some signatures are those of a third of all conversations: such keys split on this side
    answered = known.join(repairs(known), "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal().alias("illegal"), "cost", "audit")
    answered = stage_table(answered, "repairs")
    digests = repaired_digests(rows, answered)
    return answered.join(digests.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
