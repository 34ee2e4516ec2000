"""Chat formatting, with DataFrame functions alone.

A template names, by role, what stands before and after a turn's text and whether
the text counts for the loss. A finite-state machine over the roles says whether
the turns are in order and where not. Control strings inside texts and roles are
escaped reversibly: "<", k backslashes, "|" becomes "<", k + 1 backslashes, "|".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before and after hold {role}. moves: allowed steps of the machine, state to role."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("user", "assistant")


CHATML = Template()
#: Turns of a conversation whose places are found together, and the first turn of each such group.
GROUP = 128
GROUPS = f"sequence(0, size(pieces) - 1, {GROUP})"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """turns (conv_id, turn, role, text) to a row a conversation: conv_id, formatted,
    segments (array of start, length, loss over code points of `formatted`; the texts
    alone, in order), valid, and first_bad (index of the first turn out of order).

    Rows are put in order by turn (null first), then role and text, so ties and repeated
    rows have one result. Null texts and roles count as empty; a role's line breaks and
    backslashes are written as \\n and \\\\. Conversations out of order are formatted
    all the same. A null conv_id is a conversation. No rows, no conversations.
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    turn = F.struct(F.col("turn"), escaped(role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    before = "concat(" + ", x.role, ".join(_quoted(p) for p in template.before.split("{role}")) + ")"
    after = "concat(" + ", x.role, ".join(_quoted(p) for p in template.after.split("{role}")) + ")"
    loss = " OR ".join(f"x.role = {_quoted(r)}" for r in template.loss_roles) or "false"
    body = r"regexp_replace(x.text, r'<(\\*)\|', r'<\\$1|')"
    pieces = grouped.withColumn("pieces", F.expr(f"transform(turns, x -> named_struct('b', {before}, 't', {body}, 'a', {after}, 'loss', {loss}))"))
    moves = " ".join(f"WHEN s.state = {_quoted(a)} AND x.role IN ({', '.join(map(_quoted, b))}) THEN x.role" for a, b in template.moves.items())
    machine = f"""aggregate(turns, named_struct('state', 'start', 'n', 0, 'bad', cast(null AS int)),
      (s, x) -> named_struct('state', CASE {moves} ELSE 'refused' END, 'n', s.n + 1,
        'bad', coalesce(s.bad, CASE WHEN (CASE {moves} ELSE 'refused' END) = 'refused' THEN s.n END)))"""
    # groups of GROUP turns: offsets of groups first, then places within them
    group = f"slice(pieces, i + 1, {GROUP})"
    starts = f"""aggregate(transform({GROUPS}, i -> aggregate({group}, 0, (n, x) -> n + length(x.b) + length(x.t) + length(x.a))), named_struct('p', 0, 'a', cast(array() AS array<int>)),
      (s, n) -> named_struct('p', s.p + n, 'a', concat(s.a, array(s.p))), s -> s.a)"""
    segments = f"""flatten(zip_with({GROUPS}, starts, (i, o) -> aggregate({group}, named_struct('p', o, 'a', cast(array() AS array<struct<start: int, length: int, loss: boolean>>)),
      (s, x) -> named_struct('p', s.p + length(x.b) + length(x.t) + length(x.a), 'a', concat(s.a, array(named_struct('start', s.p + length(x.b), 'length', length(x.t), 'loss', x.loss)))),
      s -> s.a)))"""
    ends = ", ".join(map(_quoted, template.ends))
    return pieces.withColumns({"machine": F.expr(machine), "starts": F.expr(starts)}).select(
        "conv_id",
        F.expr("array_join(transform(pieces, x -> concat(x.b, x.t, x.a)), '')").alias("formatted"),
        F.expr(segments).alias("segments"),
        F.expr(f"machine.bad IS NULL AND machine.state IN ({ends})").alias("valid"),
        F.col("machine.bad").alias("first_bad"),
    )


def parse_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """The turns again from `formatted` alone: conv_id, turns (array of role, text), for
    templates whose parts start and end with control strings as CHATML's do."""
    head, tail = template.before.split("{role}")
    role = f"substring_index(x, {_quoted(tail)}, 1)"
    text = f"substring(x, length({role}) + {len(tail) + 1})"
    chunks = F.expr(f"transform(filter(split(formatted, r'{_literal(head)}'), (c, i) -> i > 0), c -> substring(c, 1, length(c) - {len(template.after)}))")
    back = r"regexp_replace({}, r'<\\(\\*)\|', r'<$1|')"
    plain = rf"array_join(transform(split({back.format(role)}, r'\\\\'), p -> replace(p, '\\n', '\n')), '\\')"
    return formatted.withColumn("chunks", chunks).withColumn("turns", F.expr(f"transform(chunks, x -> named_struct('role', {plain}, 'text', {back.format(text)}))")).drop("chunks")


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() or c in "<>_ \n" else "\\" + c for c in s)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks of the written output, read from `formatted` and `segments`."""
    turns = parse_chats(formatted)
    loss = r"array_join(transform(filter(segments, s -> s.loss), s -> regexp_replace(substring(formatted, s.start + 1, s.length), r'<\\(\\*)\|', r'<$1|')), '')"
    return turns.withColumn("loss", F.expr(loss)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
