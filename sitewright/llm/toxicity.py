"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are its distinct words, neighbouring pairs and pairs that skip one word, hashed to BITS
bits. Words are runs of letters, digits and characters beyond ASCII, lower-cased. Each coordinate has its own
learning rate, and the L1 term leaves few weights, which are sent to every task; their number is at most two
to the power BITS, whatever the input.

The fit takes at most ``fit_rows`` labelled texts (those with the smallest hashes of their ids), whole. All
texts are scored, whole, in one pass without a shuffle.

Null text counts as empty; its score is that of the bias alone. Rows without a label, or with a null one,
teach nothing. Without labelled rows every score is 0.25. Rows with equal ids are scored each; labels of equal
ids all teach, and so do their texts, unless they are more than ``fit_rows`` then: of each id and label one does. Of an empty table the result is empty. `score` keeps all columns of
its rows; their names must differ from the one it adds, which is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import drop, filled, save, short_batches

BITS = 20
FIT_ROWS = 16_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    passes: int = 4


@dataclass(frozen=True)
class Weights:
    bias: float
    place: np.ndarray
    value: np.ndarray


def features(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of each occurrence in a block of rows."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out, own = [W.mix(words + np.uint64(1))], [rows]
    for skip, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > skip:
            same = rows[skip:] == rows[:-skip]
            out.append(W.mix(words[:-skip] * np.uint64(salt) + words[skip:])[same])
            own.append(rows[skip:][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(own)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.lower(filled(F.col(text_col).cast("string"))).alias("text"))


@dataclass
class State:
    """What FTRL-proximal knows between passes: bounded by the coordinates, whatever the rows."""

    bias: float
    bias_n: float
    z: np.ndarray
    n: np.ndarray

    @classmethod
    def start(cls, rows: int, positive: int) -> State:
        return cls(float(np.log((positive + 0.5) / (rows - positive + 1.5))), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS))

    def weights(self, how: Ftrl) -> Weights:
        z, n = self.z, self.n
        w = np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))
        place = np.flatnonzero(w)
        return Weights(self.bias, place, w[place])


def learn(rows: Iterable[tuple[np.ndarray, int]], state: State, how: Ftrl) -> State:
    """One pass of FTRL-proximal over (features, label) in order; no row is held."""
    n, z = state.n, state.z
    for x, y in rows:
        zx, nx = z[x], n[x]
        root = np.sqrt(nx)
        w = np.where(np.abs(zx) <= how.l1, 0.0, (np.sign(zx) * how.l1 - zx) / ((how.beta + root) / how.alpha + how.l2))
        p = 1 / (1 + np.exp(-np.clip(state.bias + w.sum(), -35, 35)))
        g = p - y
        step = (np.sqrt(nx + g * g) - root) / how.alpha
        z[x] = zx + g - step * w
        n[x] = nx + g * g
        state.bias_n += g * g
        state.bias -= 0.1 * g / (1 + np.sqrt(state.bias_n))
    return state


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, how: Ftrl = Ftrl()) -> Weights:
    """Weights from the labelled texts of a bounded sample; their features are made in many tasks, and each pass
    streams them through one, which keeps the state alone."""
    with short_batches(docs.sparkSession):
        return _fit(docs, labels, id_col, text_col, label_col, fit_rows, how)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, how: Ftrl) -> Weights:
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("fit"))
    # the id and the label alone are ordered; the texts of the chosen rows follow
    marks = marks.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"), order.alias("order")).orderBy("order", "id", "y").limit(fit_rows)
    marks = save(marks, "toxicity-sample")
    chosen = _rows(docs, id_col, text_col).join(F.broadcast(marks), "id").select("order", "y", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = W.texts(batch.column(2))
            out = []
            for i, j in W.blocks(ends):
                h, _, _, at = W.word_hashes(data, ends[i : j + 1], inner=True)
                f, row = features(h, at)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(j - i + 1))
                f = f[order]
                out += [np.unique(f[a:b]).astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["order", "y", "x"])

    made = save(chosen.mapInArrow(hashed, "order long, y int, x binary"), "toxicity-features")
    rows, positive = made.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not rows:
        drop(marks, made)
        return Weights(float(np.log(1 / 3)), np.zeros(0, np.int64), np.zeros(0))
    if rows > fit_rows:
        one = F.row_number().over(Window.partitionBy("order", "y").orderBy("x"))
        every, made = made, save(made.withColumn("n", one).where("n = 1").drop("n"), "toxicity-features")
        drop(every)
        rows, positive = made.agg(F.count("*"), F.sum("y")).first()
    # the state goes from pass to pass as the row before all others, through the shared folder and not the driver
    names = ["first", "order", "y", "x", "bias", "bias_n", "z", "n"]
    schema = "first int, order long, y int, x binary, bias double, bias_n double, z binary, n binary"
    begin = State.start(rows, positive)
    state = spark.createDataFrame([(0, None, None, None, begin.bias, begin.bias_n, None, None)], schema)
    rest = made.withColumn("first", F.lit(1)).select("first", "order", "y", "x", *[F.lit(None).cast(t).alias(c) for c, t in (("bias", "double"), ("bias_n", "double"), ("z", "binary"), ("n", "binary"))])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            skip = 0
            if own is None and b.num_rows:
                own, skip = _read_state(b), 1
            learn(((x.view(np.uint32), y) for y, x in list(zip(b.column(2).to_pylist(), W.binaries(b.column(3)), strict=True))[skip:]), own, how)
        W.give_back()
        if own is not None:
            values = [[0], [None], [None], [None], [own.bias], [own.bias_n], [own.z.tobytes()], [own.n.tobytes()]]
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = _read_state(b).weights(how)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, w.place)), pa.array(np.append(w.bias, w.value))], ["place", "value"])

    for _ in range(how.passes):
        ordered = state.union(rest).coalesce(1).sortWithinPartitions("first", "order", "y", "x")
        before, state = state, save(ordered.mapInArrow(train, schema), "toxicity-state")
        drop(before)
    got = sorted(state.mapInArrow(weigh, "place long, value double").collect())
    drop(marks, made, state)
    place, value = np.array([r.place for r in got]), np.array([r.value for r in got])
    return Weights(float(value[0]), place[1:], value[1:])


def _read_state(b: pa.RecordBatch) -> State:
    z, n = (np.frombuffer(b.column(i)[0].as_py() or bytes(8 << BITS)).copy() for i in (6, 7))
    return State(b.column(4)[0].as_py(), b.column(5)[0].as_py(), z, n)


def score(docs: DataFrame, weights: Weights, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with their scores; no column is lost, and no row moves. Run it with batches of texts kept short
    (common.limit_batches) where texts may be long."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sent.value.place] = sent.value.value
        some = w != 0
        for batch in batches:
            data, ends = W.texts(batch.column(batch.num_columns - 1))
            out = []
            for i, j in W.blocks(ends):
                h, _, _, at = W.word_hashes(data, ends[i : j + 1], inner=True)
                f, row = features(h, at)
                k = some[f]
                pair = np.unique(row[k] << BITS | f[k])
                out.append(np.bincount(pair >> BITS, weights=w[pair & ((1 << BITS) - 1)], minlength=j - i))
            total = sent.value.bias + (np.concatenate(out) if out else np.zeros(0))
            value = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], value], [*batch.schema.names[:-1], score_col])
        W.give_back()

    rows = docs.select("*", F.lower(filled(F.col(text_col).cast("string"))).alias("_toxicity_text"))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return rows.mapInArrow(scored, schema)


def held_out(id_col: str):
    return F.crc32(filled(F.col(id_col).cast("string")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, held_out, score, predicted for each row. Labels of held-out ids are not used."""
    weights = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, fit_rows)
    with short_batches(docs.sparkSession):
        scored = score(docs.select(id_col, text_col), weights, text_col)
        return save(scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), "toxicity-scores")
