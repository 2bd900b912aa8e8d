"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Each word has a sparse random index vector, drawn for the slot its hash falls into. A word's vector is its own index
vector plus those of its neighbours in the labelled sample, scaled to length one. The shape of a word (case and the marks
around it) has a vector of its own. A document is the mean of its words' vectors, the mean of its shapes', the lengths of
both means (texts that repeat themselves have long ones) and its number of words. A network with one hidden layer, in
numpy, gives a logit, which a temperature found on held-back rows of the sample turns into a probability.

The model is fitted on at most ``max_docs`` labelled rows, chosen by a hash of the id, all with their whole texts; that
bound is the only limit. Scores use the text alone.

Cases: null and empty texts get the score of a document without words; without labelled rows of both labels every score
is 0.5; equal texts get equal scores; repeated rows are scored each, and those with a null id; empty tables give no rows;
very long texts are scored whole, by a task that holds their words; columns other than doc_id and text are not read,
whatever their names. Of conflicting labels of an id the largest counts, of its texts the first by their bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veilgrid.llm.common import labelled_sample, remembering

#: Slots of words and of shapes, dimensions, nonzeros of an index vector, words on either side that count as neighbours.
SLOTS, SHAPES, DIM, NONZERO, NEAR = 1 << 14, 1 << 10, 48, 6, 2
#: Bound of the labelled sample; hidden units; a share of 1 / HELD_BACK of the sample sets the temperature.
MAX_DOCS, HIDDEN, HELD_BACK = 6000, 24, 5
#: Distinct words that a worker remembers.
CACHE_WORDS = 250_000
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    """Upper case letters as A, lower case as a, digits as 9, other characters as they are; runs count once."""
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Slots:
    """Slots of words, remembered per worker: slot of the lower-case letters and digits, slot of the shape."""

    def __init__(self, limit: int = CACHE_WORDS):
        self.known: dict[str, int] = {}
        self.limit = limit

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > self.limit:
                known.clear()
                new = set(words)
            for w in new:
                core = "".join(filter(str.isalnum, w.lower()))
                known[w] = zlib.crc32(core.encode()) % SLOTS * SHAPES + zlib.crc32(_shape(w).encode()) % SHAPES
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return both // SHAPES, both % SHAPES


_SLOTS = Slots()


def index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    at = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, NONZERO)), axis=1)
    return out / np.sqrt(NONZERO)


def word_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Index vectors plus the neighbours' in ``docs``, scaled."""
    index = index_vectors(SLOTS, 1)
    context = np.zeros_like(index)
    for words in docs:
        for k in range(1, NEAR + 1):
            for a, b in ((words[:-k], words[k:]), (words[k:], words[:-k])):
                if len(a):
                    order = np.argsort(a, kind="stable")
                    slots, start = np.unique(a[order], return_index=True)
                    context[slots] += np.add.reduceat(index[b[order]], start, axis=0)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return unit(index + unit(context)).astype(np.float32)


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    n = len(words)
    if not n:
        return np.zeros(2 * DIM + 4, np.float32)
    sums = np.zeros((2, DIM))
    for at in range(0, n, 65536):  # bounds the memory for long texts
        sums[0] += vectors[words[at : at + 65536]].sum(axis=0, dtype=np.float64)
        sums[1] += shape_vectors[shapes[at : at + 65536]].sum(axis=0, dtype=np.float64)
    a, b = sums / n
    return np.concatenate([a, b, [np.linalg.norm(a), np.linalg.norm(b), np.log1p(n), len(np.unique(words)) / n]]).astype(np.float32)


@dataclass
class Model:
    """What scoring needs; ``layers`` is None if there was nothing to learn from."""

    vectors: np.ndarray
    shape_vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def features(self, text: str | None) -> np.ndarray:
        return pooled(*_SLOTS.of(text or ""), self.vectors, self.shape_vectors)

    @staticmethod
    def forget() -> None:
        _SLOTS.known.clear()

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(x))
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, decay: float = 1e-3, seed: int = 7) -> tuple:
    """Weights of the two layers, by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            h = np.tanh(x[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[i].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one that makes the log loss of held-back rows least."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    s = np.where(y == 1, 1.0, -1.0) * logits
    return float(grid[np.argmin([np.logaddexp(0, -s / t).mean() for t in grid])])


def fit(rows: list[tuple[int, str, int]]) -> Model:
    slots = [_SLOTS.of(text) for _, text, _ in rows]
    model = Model(word_vectors([a for a, _ in slots]), index_vectors(SHAPES, 2))
    y = np.array([label for *_, label in rows])
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([pooled(a, b, model.vectors, model.shape_vectors) for a, b in slots]).astype(np.float64)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    held = np.array([zlib.crc32(f"t{i}".encode()) % HELD_BACK == 0 for i, *_ in rows])
    z = (x - model.mean) / model.scale
    if len(set(y[held].tolist())) == 2 and len(set(y[~held].tolist())) == 2:
        model.layers = train(z[~held], y[~held])
        model.temperature = temperature(model.logits(x[held]), y[held])
    else:
        model.layers = train(z, y)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, max_docs: int = MAX_DOCS) -> Model:
    return fit(labelled_sample(docs, labels, "quality", keep, max_docs))


def with_score(docs: DataFrame, model, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 added, in place of a column of that name; ``model`` has ``features`` and ``probabilities``. The model is a few MB
    whatever the input, and goes to the executors as a broadcast variable."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        remembering(type(m).__module__, m.forget)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([m.features(t) for t in batch.column(at).to_pylist()])
                score = m.probabilities(x)
            else:
                score = []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    rows = with_score(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), model)
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
