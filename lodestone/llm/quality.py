"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled good; unlabelled text is any document, its label
hidden. With the estimated class prior p, the risk of a scorer f is
``p * E_positive[loss(f)] + max(0, E_unlabelled[loss(-f)] - p * E_positive[loss(-f)])``;
where the bracket is negative, the step goes the other way, as published for this
estimator. f is a small network over surface statistics of the whole text, so its logistic
value is comparable between texts of any length. The prior is estimated without negatives: a
network that tells positives from unlabelled text is fitted on each half of both; on the other half,
the share of unlabelled documents above a threshold over that of positives is at least the
prior, and near it where hardly any but positives are; the least such quotient is taken.

A text without words has nothing to judge; its score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.samples import fold, labelled
from lodestone.llm.tokens import slices, words

#: Trusted positives and unlabelled documents to fit on at most.
POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE = 16, 1500, 0.02
#: Steps of the network that tells positives from unlabelled rows.
TELL_STEPS = 60

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*|<>{}[]=~^\\/_@+")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?!'\"()-")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
NAMES = (
    "words_log", "word_bytes", "upper", "digit", "mark", "stop", "letter", "lines_per_word", "repeat_next", "repeat_second",
    "distinct", "mark_words", "upper_words", "long_words", "short_words", "line_repeats", "half_mark", "half_upper", "half_repeat",
)


def _share(flags: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The share of set flags in each run [at[i], at[i+1]) over ``size``."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(size, 1)


def statistics(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows from, to, and a matrix of the statistics in ``NAMES`` for each text."""
    for lo, hi, data, offsets in slices(column):
        s, e, h, first = words(data, offsets)
        n_bytes, n_words = np.diff(offsets), np.diff(first)
        out = np.zeros((hi - lo, len(NAMES)), np.float32)
        doc = np.repeat(np.arange(hi - lo), n_words)
        out[:, 0] = np.log1p(n_words)
        size = e - s
        out[:, 1] = np.bincount(doc, size, hi - lo) / np.maximum(n_words, 1)
        for k, table in ((2, _UPPER), (3, _DIGIT), (4, _MARK), (5, _STOP), (6, _LETTER)):
            out[:, k] = _share(table[data], offsets, n_bytes)
        out[:, 7] = _share(data == 10, offsets, n_words)
        for k, gap in ((8, 1), (9, 2)):
            same = np.zeros(len(h), bool)
            same[gap:] = (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap]) if len(h) > gap else False
            out[:, k] = _share(same, first, n_words)
        repeat = np.zeros(len(h), bool)
        repeat[1:] = h[1:] == h[:-1]
        # distinct words among each block of 64, so that length does not matter
        block = doc * np.int64(1 << 32) + (np.arange(len(h)) - first[doc]) // 64
        order = np.lexsort((h, block))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (block[order][1:] != block[order][:-1])
        out[:, 10] = np.bincount(doc[order][new], minlength=hi - lo) / np.maximum(n_words, 1)
        total_mark = np.concatenate(([0], np.cumsum(_MARK[data])))
        total_upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
        marked, upper = total_mark[e] > total_mark[s], (total_upper[e] - total_upper[s]) * 2 > size
        out[:, 11], out[:, 12] = _share(marked, first, n_words), _share(upper & (size > 1), first, n_words)
        out[:, 13], out[:, 14] = _share(size > 20, first, n_words), _share(size < 3, first, n_words)
        text = data.tobytes()
        later = (np.arange(len(h)) - first[doc]) * 2 >= n_words[doc]
        for k, flags in ((16, marked), (17, upper), (18, repeat)):
            out[:, k] = _share(flags & later, first, n_words / 2)
        for i in range(hi - lo):
            lines = [x for x in text[offsets[i] : offsets[i + 1]].split(b"\n") if x]
            out[i, 15] = 1 - len(set(lines)) / len(lines) if lines else 0.0
        yield lo, hi, out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(f.astype(np.float64), -30, 30))), 0.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimated share of positives among ``unlabelled``."""
    rng = np.random.default_rng(1)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    if len(p) < 4 or len(u) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        model = fit(positive[p[k::2]], unlabelled[u[k::2]], 0.5, tell=True)
        a, b = model.score(positive[p[1 - k :: 2]]), model.score(unlabelled[u[1 - k :: 2]])
        found.append([(b >= t).mean() / (a >= t).mean() for t in np.quantile(a, np.linspace(0.02, 0.5, 25))])
    return float(np.clip(np.mean(found, axis=0).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, tell: bool = False) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss by Adam over all rows.

    ``tell``: minimise the loss of telling positives from unlabelled rows instead.
    """
    rng = np.random.default_rng(0)
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    theta = {"w1": rng.normal(0, 0.3, (p.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))

    def back(x: np.ndarray, a: np.ndarray, g: np.ndarray) -> dict:
        d = np.outer(g, theta["w2"]) * (1 - a * a)
        return {"w1": x.T @ d, "b1": d.sum(0), "w2": a.T @ g, "b2": np.array([g.sum()])}

    batch = 2048
    steps = TELL_STEPS if tell else STEPS
    for step in range(1, steps + 1):
        x, z = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        ax, az = np.tanh(x @ theta["w1"] + theta["b1"]), np.tanh(z @ theta["w1"] + theta["b1"])
        fx, fz = ax @ theta["w2"] + theta["b2"], az @ theta["w2"] + theta["b2"]
        negative = np.logaddexp(0, fz).mean() - prior * np.logaddexp(0, fx).mean()
        pos_grad, neg_x, neg_z = -prior * sigmoid(-fx) / batch, -prior * sigmoid(fx) / batch, sigmoid(fz) / batch
        if tell:
            gx, gz = pos_grad, neg_z * (1 - prior)
        elif negative >= 0:
            gx, gz = pos_grad + neg_x, neg_z
        else:  # the step that raises the negative part again
            gx, gz = -neg_x, -neg_z
        one, two = back(x, ax, gx), back(z, az, gz)
        for k in theta:
            g = one[k] + two[k] + 1e-4 * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            rate = RATE * (1 - step / (steps + 1))
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta["w1"], theta["b1"], theta["w2"], float(theta["b2"][0]), prior)


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded DataFrame of ``text, label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in statistics(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1).slice(lo, hi - lo)], ["x", "label"])

    got = rows.select("text", F.col("label").cast("int")).mapInArrow(run, "x array<float>, label int").toPandas()
    if not len(got):
        return np.zeros((0, len(NAMES))), np.zeros(0, int)
    x = np.stack(got.x.to_numpy())
    order = np.lexsort(x.T)
    return x[order], got.label.to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, folds: int, part: int) -> Model | None:
    """The model from a bounded sample outside the held-out fold; None without positives."""
    held = fold("id", folds, part)
    positive, _ = _matrix(labelled(docs, labels.where("quality = 1"), "quality", POSITIVES, held))
    pool = docs.select(F.col("doc_id").alias("id"), "text").where(~held)
    share = min(1.0, 1.25 * UNLABELLED / max(1, pool.count()))
    pick = pool.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", F.lit(0).alias("label"))
    unlabelled, _ = _matrix(pick)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, part: int = 2, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its whole text.

    A null text counts as empty; a text without words scores 0. Labels other than 1 are not
    used; without a trusted positive every score is 0.5. Repeated rows are scored alike.
    """
    model = train(docs, labels, folds, part)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in statistics(batch.column(1)):
                score = model.score(x) if model is not None else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= least).astype(np.int32))], ["id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"id {id_type}, score double, predicted int").withColumnRenamed("id", "doc_id")
    return out.select("doc_id", fold("doc_id", folds, part).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, part: int = 2, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``.

    The model is that of :func:`classify`; rows are judged where they are, without a join.
    """
    model = train(docs, labels, folds, part)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in statistics(batch.column(at)):
                score = model.score(x) if model is not None else np.full(hi - lo, 0.5)
                yield batch.slice(lo, hi - lo).filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
