"""Language identification with a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of a bounded sample of
labelled documents. Prediction reads every byte of every text: texts are cut into
chunks of CHUNK bytes that run side by side, each position gets a distribution over
the languages from both directions' states, and a document's probabilities are the
mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchbook.llm.common import slices, whole_text

HIDDEN, CHUNK, LANES = 12, 128, 2048
#: Bounds of the training sample: documents a language, windows a document, characters a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 400, 4, 64
STEPS, BATCH, RATE = 220, 256, 0.01
PAD = 256
UNKNOWN = "und"


def _tanh_gates(x: np.ndarray) -> np.ndarray:
    """Sigmoid in place, by the cheaper tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Model:
    """tables: by direction, what each byte adds to the gates (3 * hidden, 257); loops:
    the recurrent weights (3 * hidden, hidden). Gates in order update, reset, new state.
    The pad column shuts the update gate, so padding leaves a state as it is."""

    languages: list[str]
    tables: list[np.ndarray]
    loops: list[np.ndarray]
    heads: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Model:
        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        tables = [weights(3 * HIDDEN, PAD + 1) for _ in range(2)]
        for t in tables:
            t[:, PAD] = 0
            t[:HIDDEN, PAD] = -1e4
        n = len(languages)
        return cls(languages, tables, [weights(3 * HIDDEN, HIDDEN) for _ in range(2)], [weights(n, HIDDEN) for _ in range(2)], np.zeros((n, 1), np.float32))

    def states(self, ids: np.ndarray, way: int, trace: list | None = None) -> np.ndarray:
        """ids (steps, lanes) to states (steps, hidden, lanes) in one direction."""
        steps, lanes = ids.shape
        h = np.zeros((HIDDEN, lanes), np.float32)
        out = np.empty((steps, HIDDEN, lanes), np.float32)
        table, loop = self.tables[way], self.loops[way]
        inputs, back = np.empty((3 * HIDDEN, lanes), np.float32), np.empty((3 * HIDDEN, lanes), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(table, ids[t], axis=1, out=inputs, mode="clip")
            np.matmul(loop, h, out=back)
            inputs[: 2 * HIDDEN] += back[: 2 * HIDDEN]
            gates = _tanh_gates(inputs[: 2 * HIDDEN])
            new = gates[HIDDEN:] * back[2 * HIDDEN :]
            new += inputs[2 * HIDDEN :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((t, h.copy(), gates.copy(), new.copy(), back[2 * HIDDEN :].copy()))
            new -= h
            new *= gates[:HIDDEN]
            h = np.add(h, new, out=out[t])
        return out

    def probabilities(self, ids: np.ndarray, states: list[np.ndarray] | None = None) -> np.ndarray:
        """The distribution at each position: (steps, languages, lanes)."""
        forth, back = states or [self.states(ids, 0), self.states(ids, 1)]
        p = np.matmul(self.heads[0], forth)
        p += np.matmul(self.heads[1], back)
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, ids: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all unpadded positions, in the order of weights()."""
        traces: list[list] = [[], []]
        states = [self.states(ids, w, traces[w]) for w in range(2)]
        p = self.probabilities(ids, states)
        real = (ids != PAD).astype(np.float32)
        p[:, label, np.arange(len(label))] -= 1
        p *= (real / real.sum())[:, None, :]
        tables, loops, heads = [], [], []
        for way in range(2):
            heads.append(np.einsum("tlb,thb->lh", p, states[way], optimize=True))
            from_head = np.matmul(self.heads[way].T, p)
            table, loop, dh = np.zeros_like(self.tables[way]), np.zeros_like(self.loops[way]), np.zeros((HIDDEN, ids.shape[1]), np.float32)
            onto = np.zeros((ids.shape[0], 3 * HIDDEN, ids.shape[1]), np.float32)
            for t, h, gates, new, back in reversed(traces[way]):
                dh = dh + from_head[t]
                z, r = gates[:HIDDEN], gates[HIDDEN:]
                dz = dh * (new - h) * z * (1 - z)
                dn = dh * z * (1 - new * new)
                dr = dn * back * r * (1 - r)
                at = onto[t]
                at[:HIDDEN], at[HIDDEN : 2 * HIDDEN], at[2 * HIDDEN :] = dz, dr, dn
                into = np.concatenate([dz, dr, dn * r])
                loop += into @ h.T
                dh = dh * (1 - z) + self.loops[way].T @ into
            flat = ids.ravel()
            by_byte = np.moveaxis(onto, 1, 0).reshape(3 * HIDDEN, -1)
            for k in range(3 * HIDDEN):
                table[k] = np.bincount(flat, by_byte[k], PAD + 1)
            table[:, PAD] = 0
            tables.append(table)
            loops.append(loop)
        return [*tables, *loops, *heads, p.sum(axis=(0, 2))[:, None]]

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, *self.heads, self.bias]


def _chunks(data: np.ndarray, begin: np.ndarray, size: np.ndarray, steps: int) -> np.ndarray:
    """(steps, lanes) ids: bytes from each begin on, padded after size."""
    at = np.arange(steps)[:, None]
    ids = data[np.minimum(begin[None, :] + at, max(len(data) - 1, 0))].astype(np.int16) if len(data) else np.zeros((steps, len(begin)), np.int16)
    return np.where(at < size[None, :], ids, PAD)


def train(windows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Adam on random batches with as many windows of each language; the same windows give the same model."""
    rng = np.random.default_rng(seed)
    languages = sorted({w[0] for w in windows})
    model = Model.fresh(languages, rng)
    if not languages:
        return model
    raw = [t.encode()[:WINDOW] for _, t in windows]
    size = np.array([len(r) for r in raw])
    ids = _chunks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, WINDOW)
    label = np.array([languages.index(w[0]) for w in windows])
    of = [np.flatnonzero(label == k) for k in range(len(languages))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    for step in range(1, STEPS + 1):
        some = np.concatenate([rng.choice(o, max(1, BATCH // len(languages))) for o in of])
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for w, g, (m, v) in zip(model.weights(), model.gradients(ids[:, some], label[some]), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def sample_windows(labelled: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, window) pairs: at most SAMPLE_DOCS documents of each language, drawn by
    a hash of the id, at most SAMPLE_WINDOWS windows of each, anywhere in the text."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 40))
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, int((1 << 40) * 4.0 * SAMPLE_DOCS / n)))])
    near = rows.where(draw < F.element_at(limits, F.col(lang)))
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy(lang).orderBy(draw, text))).where(F.col("nth") <= SAMPLE_DOCS)
    start = F.pmod(F.xxhash64(F.col(id_col), F.col("k")), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1) + 1
    cut = first.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(SAMPLE_WINDOWS), 1 + F.floor(F.length(text) / WINDOW)).cast("int"))))
    picked = cut.select(lang, F.substring(F.col(text), start.cast("int"), F.lit(WINDOW)).alias("window")).where(F.col("window").rlike(r"\p{L}"))
    return sorted((r[0], r[1]) for r in picked.collect())


def _predict(batches: Iterator[pa.RecordBatch], model: Model, column: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    languages = np.array([*model.languages, UNKNOWN], dtype=object)
    for batch in (s for b in batches for s in slices(b, column)):
        text = batch.column(column).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        lettered = batch.column("__letters").to_numpy(zero_copy_only=False) & bool(model.languages)
        size = np.where(lettered, np.diff(offsets), 0)
        n_chunks = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(size)), n_chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        begin, length = offsets[:-1][doc] + nth * CHUNK, np.minimum(size[doc] - nth * CHUNK, CHUNK)
        total = np.zeros((len(size), max(1, len(model.languages))))
        by_length = np.argsort(-length, kind="stable")
        for a in range(0, len(doc), LANES):
            some = by_length[a : a + LANES]
            ids = _chunks(data, begin[some], length[some], int(length[some].max()))
            p = model.probabilities(ids)
            p *= (ids != PAD)[:, None, :]
            np.add.at(total, doc[some], p.sum(axis=0).T)
        best = total.argmax(axis=1)
        score = total[np.arange(len(size)), best] / np.maximum(size, 1)
        names = languages[np.where(size > 0, best, len(model.languages))]
        columns = {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(np.where(size > 0, np.clip(score, 0, 1), 0.0))}
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[Column | str] | None = None) -> DataFrame:
    """The columns `carry` (default: all), lang_pred and score of every row.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where the
    model knows no language; else the language with the largest mean probability over the
    text's bytes (ties: first in code point order). Columns named lang_pred or score that
    the table already has are replaced. Repeated rows are each answered alike.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")] if carry is None else carry
    rows = docs.select(*kept)
    out = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # a text that is carried anyway is sent once; a null one has no letters
    column = text if any(c == text for c in kept if isinstance(c, str)) and isinstance(docs.schema[text].dataType, T.StringType) else "__text"
    extra = [] if column == text else [whole_text(text).alias("__text")]
    rows = docs.select(*kept, *extra, whole_text(text).rlike(r"\p{L}").alias("__letters"))
    schema = to_arrow_schema(out)
    return rows.mapInArrow(lambda it: _predict(it, model, column, schema), out)
