"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

A window is one word, lower-cased and written twice, so that the block's fixed cost does
not hide how well a dictionary covers it. Its distance is its compressed length under the
ordinary dictionary less that under the toxic one. A document's windows are counted at each of
several thresholds, in bytes and as a share of what could be saved at all; the weights of these counts and of
their shares of the document's words are calibrated by a logistic regression, whose value is the score.

The toxic dictionary is trained on those parts of words of toxic documents whose grams
stand in toxic documents far more often than their share (likelihood ratio over different
contexts, so that copies of one text count once), because most of a toxic document's text
is ordinary; the ordinary dictionary is trained on windows of ordinary documents and is
the first part of the content that toxic text is compared with. Half of the bounded sample trains the dictionaries, the other half
calibrates the thresholds. A sample too small for the dictionary trainer gives dictionaries of
plain content; without any toxic part every score is the toxic share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.samples import fold, labelled
from lodestone.llm.tokens import LOWER, SPACE, mix, slices, words

#: Labelled documents of each class to fit on at most.
PER_CLASS = 2500
#: Bytes of each dictionary.
DICT_BYTES = 4096
#: Bytes of a gram, and twice the log likelihood ratio from which one is toxic.
GRAM = 5
RATIO = 24.0
#: How many times more frequent such a gram is in toxic documents, at least.
LIFT = 8.0
#: Windows of ordinary text that train the ordinary dictionary at most.
ORDINARY_WINDOWS = 60_000
#: Thresholds at which windows are counted: bytes, and least share of what could be saved.
THRESHOLDS = [(k, 0.0) for k in range(1, 9)] + [(2, 0.5), (2, 0.6), (2, 0.8)]
#: The threshold of the windows that are reported as toxic.
REPORTED = (2, 0.5)
#: Weight of the squares in the calibration.
RIDGE = 1.0


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    floor: int
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores from the texts' counts (a column for each threshold, then words)."""
        if self.weights is None:
            return np.full(len(counts), self.prior)
        z = (_features(counts) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(counts: np.ndarray) -> np.ndarray:
    n, words_ = counts[:, :-1].astype(np.float64), counts[:, -1:]
    return np.hstack([np.log1p(n), np.sqrt(n / np.maximum(words_, 1)), np.log1p(words_)])


def _window(word: bytes) -> bytes:
    return b" " + word + b" " + word + b" "


def _train(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-DICT_BYTES:] or b" " * 8


def _lengths(dictionary: bytes, windows: list[bytes]) -> np.ndarray:
    import zstandard

    spec = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    coder = zstandard.ZstdCompressor(compression_params=spec, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    if not windows:
        return np.zeros(0, np.int64)
    out = coder.multi_compress_to_buffer(windows, threads=1)
    return np.array([len(out[i]) for i in range(len(out))], np.int64)


def _grams(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-case bytes, places, values and contexts of the grams of GRAM bytes that lie in a word
    (a space may come first). A gram's context is its word with both neighbours, so copies of a
    text and near copies add next to nothing."""
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        s, e, h, _ = words(data, offsets, lower=True)
        low = LOWER[data]
        if len(low) < GRAM or not len(h):
            continue
        around = mix(np.roll(h, 1) * np.uint64(3) + np.roll(h, -1) * np.uint64(5) + h)
        solid = ~SPACE[low]
        n = len(low) - GRAM + 1
        inside = solid[1 : n + 1].copy()
        for k in range(2, GRAM):
            inside &= solid[k : n + k]
        at = np.flatnonzero(inside)
        value = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            value = value << np.uint64(8) | np.where(solid[at + k], low[at + k], 32).astype(np.uint64)
        yield low.tobytes(), at, value, around[np.searchsorted(s, at + 1, "right") - 1]


def _contexts(texts: list[str]) -> dict[int, int]:
    """In how many different contexts each gram stands."""
    seen = [np.stack([value, mix(value * np.uint64(3) + around)]) for _, _, value, around in _grams(texts)]
    if not seen:
        return {}
    both = np.concatenate(seen, axis=1)
    own = both[0][np.unique(both[1], return_index=True)[1]]
    one, n = np.unique(own, return_counts=True)
    return dict(zip(one.tolist(), n.tolist(), strict=True))


def _toxic_grams(toxic: list[str], ordinary: list[str]) -> np.ndarray:
    """Grams whose contexts are in toxic documents far more often than contexts are."""
    a, b = _contexts(toxic), _contexts(ordinary)
    total = sum(a.values()), sum(b.values())
    share = total[0] / max(1, sum(total))
    found = []
    for w, k in a.items():
        n = k + b.get(w, 0)
        if k < 4 or k * total[1] < LIFT * (n - k + 0.5) * total[0]:
            continue
        ratio = 2 * (k * math.log(k / n / share) + ((n - k) * math.log((n - k) / n / (1 - share)) if n > k else 0.0))
        if ratio >= RATIO:
            found.append(w)
    return np.array(sorted(found), np.uint64)


def _toxic_parts(texts: list[str], grams: np.ndarray) -> list[bytes]:
    """The longest parts of words that marked grams cover, as windows, as often as they occur."""
    out = []
    for low, at, value, _ in _grams(texts):
        hit = at[np.isin(value, grams)]
        cover = np.zeros(len(low) + 2, bool)
        for k in range(GRAM):
            cover[hit + k + 1] = True
        edge = np.flatnonzero(cover[1:] != cover[:-1])
        out += [_window(part) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) for part in low[i:j].split()]
    return out


def _counts(model: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows from, to, and for each text its numbers of windows at each threshold, and of words."""
    for lo, hi, data, offsets in slices(column):
        s, e, h, first = words(data, offsets, lower=True)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        text = LOWER[data].tobytes()
        windows = [_window(text[i:j]) for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]
        plain, toxic = (_lengths(d, windows) for d in (model.ordinary, model.toxic))
        out = np.zeros((hi - lo, len(THRESHOLDS) + 1), np.int64)
        for k, t in enumerate(THRESHOLDS):
            total = np.concatenate(([0], np.cumsum(_flags(plain, toxic, *t, model.floor)[back])))
            out[:, k] = total[first[1:]] - total[first[:-1]]
        out[:, -1] = np.diff(first)
        yield lo, hi, out


def _flags(plain: np.ndarray, toxic: np.ndarray, least: int, ratio: float, floor: int) -> np.ndarray:
    """Windows that toxic text shortens by ``least`` bytes and by ``ratio`` of what can be saved at all."""
    saved = plain - toxic
    return (saved >= least) & (saved >= ratio * (plain - floor))


def fit(sample: DataFrame) -> Model:
    """The model from a bounded DataFrame of ``text, label``."""
    rows = sample.toPandas().sort_values(["label", "text"]).reset_index(drop=True)
    rows["text"] = rows.text.fillna("")
    prior = (rows.label.sum() + 0.5) / (len(rows) + 1)
    half = rows.index.to_numpy() % 2 == 0
    toxic, ordinary = (rows.text[half & (rows.label == y)].tolist() for y in (1, 0))
    marked = _toxic_parts(toxic, _toxic_grams(toxic, ordinary))
    if not marked or half.all():
        return Model(b" " * 8, b" " * 8, 0, prior)
    plain = [_window(w) for x in ordinary for w in sorted(set(x.encode().lower().split()))]
    step = max(1, len(plain) // ORDINARY_WINDOWS)
    common = _train(plain[::step])
    # toxic text is ordinary text with toxic parts: what is common to both cancels out
    model = Model(common, common + _train(marked), 0, prior)
    model.floor = int(min(_lengths(d, plain[::step] + marked).min() for d in (model.ordinary, model.toxic)))
    rest = rows[~half]
    x, y = _features(np.concatenate([n for _, _, n in _counts(model, pa.array(rest.text))])), rest.label.to_numpy()
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag(np.append(np.full(x.shape[1], RIDGE), 1e-6))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    model.weights = w
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, toxic_windows, score, predicted`` for every document, from its whole text.

    A null text counts as empty: it has no window, and the score of a document without words.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = THRESHOLDS.index(REPORTED)
        for batch in batches:
            for lo, hi, n in _counts(model, batch.column(1)):
                score = model.score(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n[:, at], pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "toxic_windows", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, toxic_windows long, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, part: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted, toxic_windows`` for every document.

    Labels are learned outside the held-out fold only. Empty tables of labels give every
    document the score 0.5; repeated rows are scored alike; other columns are not read.
    """
    model = fit(labelled(docs, labels, "toxic", per_class, fold("doc_id", folds, part)))
    return score_documents(docs, model).select("doc_id", fold("doc_id", folds, part).alias("held_out"), "score", "predicted", "toxic_windows")
