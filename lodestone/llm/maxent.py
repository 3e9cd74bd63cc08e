"""A hashed maximum-entropy language model with class-factored softmax.

A word's class is a hash of its last two bytes, and its row a hash of the whole word within
its class; the commonest words have rows of their own. P(word | history) is
P(class | history) * P(row | class, history) * P(word | row). The first two factors are
softmaxes of weighted features, the third is a smoothed share of counts with one more slot for
all unseen words of the row, so the model sums to one over known words and one unseen word for
each hashed row. The features, with u the word before, k its class and b the class of the word
before that:

* class: u's row (bigram), b with k (trigram of classes)
* row in its class: k (bigram), b (skip)

Counts are exact and taken over all training text. Every feature counts pairs that are gathered
where the text is and summed by shuffles; a class's weights depend on no other class, so each is
trained in its own task by gradient updates, observed less expected counts, over all of its pairs.
The number of rows is ``ROWS`` times the cube root of the training tokens, 522 bytes of weights each. Weights of
more than ``MODEL_BYTES`` stay in a written table: the texts are then scored in passes, each
with the weights of a range of rows that is within the bound, and a text's sums are added up. What
stays whole on the driver and in tasks are at most 40 bytes a row: places, counts and shares.

Scoring looks common words up in a broadcast table; the counts of the rest come by a join.
Words are compared by 64-bit hashes: two of 10**7 words have the same one with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.samples import fold
from lodestone.llm.tokens import LOWER, mix, slices, words
from lodestone.plans.stages import materialise

#: Classes, and classes of a word before, the last of which says that there is none.
CLASSES = 64
BEFORE = CLASSES + 1
#: Rows for each cube root of the number of training tokens.
ROWS = 240
#: Commonest words whose counts are looked up in a broadcast table (never fewer than own rows).
COMMON = 200_000
#: Distinct words, or tokens, that a task counts before it passes its counts on.
COUNTED, PAIRED = 2_000_000, 3_000_000
#: Rows of a class that are summed up together.
CHUNK = 256
#: Bytes of weights that are fetched and broadcast at a time, those of a row, and rows of one class in a row of their table.
MODEL_BYTES, ROW_BYTES, SPAN = 256 << 20, 4 * BEFORE * 2 + 2, 4096
#: Gradient updates, their step, and what is added to counts in the step's scale.
STEPS, RATE, SMOOTH = 8, 0.5, 3.0
#: The token after a text's last word, in class 0; its hash is that of no word's.
_END_HASH = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Tokens:
    """Tokens of a few texts: each text's words, then its end."""

    hashes: np.ndarray
    classes: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def before(self, values: np.ndarray, back: int, none: int) -> np.ndarray:
        """The value of the token ``back`` places before each token in its text, or ``none``."""
        out = np.full(len(values), none, values.dtype)
        out[back:] = values[:-back]
        out[np.arange(len(values)) - self.first[self.doc] < back] = none
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    s, e, h, first = words(data, offsets, lower=True)
    docs = len(offsets) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(first))
    hashes, classes = np.full(len(h) + docs, _END_HASH), np.zeros(len(h) + docs, np.int64)
    hashes[at] = h
    if len(h):
        tail = LOWER[data[e - 1]].astype(np.uint64) << np.uint64(8) | np.where(e - s > 1, LOWER[data[e - 2]], 0).astype(np.uint64)
        classes[at] = (mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    first = first + np.arange(docs + 1)
    return Tokens(hashes, classes, np.repeat(np.arange(docs), np.diff(first)), first)


@dataclass
class Layout:
    """Where the words' rows are. Rows are numbered by class: own rows, then hashed ones."""

    own: np.ndarray  # sorted hashes of words with own rows
    own_row: np.ndarray
    start: np.ndarray  # first row of each class, and the number of rows; the latter is also the row of no word
    hashed: np.ndarray  # first hashed row of each class

    def rows(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        room = (self.start[1:] - self.hashed)[classes]
        out = self.hashed[classes] + ((hashes >> np.uint64(1)).astype(np.int64) % room)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            out = np.where(self.own[at] == hashes, self.own_row[at], out)
        return out


def layout(own: np.ndarray, classes: np.ndarray, others: np.ndarray, rows: int) -> Layout:
    """The layout of words with own rows, for ``others`` further distinct words of each class."""
    number = np.maximum(1, np.round(rows * others / max(1, others.sum()))).astype(np.int64)
    mine = np.bincount(classes, minlength=CLASSES)
    start = np.concatenate(([0], np.cumsum(mine + number)))
    order = np.lexsort((own, classes))
    row = np.empty(len(own), np.int64)
    row[order] = np.arange(len(own)) + np.concatenate(([0], np.cumsum(number)))[classes[order]]
    by_hash = np.argsort(own)
    return Layout(own[by_hash], row[by_hash], start, start[:-1] + mine)


@dataclass
class Model:
    """Weights (natural logs): ``base[row] + near[row, k] + skip[row, b] - norm[class, k, b]`` is a row's log
    probability in its class, ``go[u, class] + tri[k, b, class] - total[u, b]`` the class's."""

    layout: Layout
    room: np.ndarray
    base: np.ndarray
    near: np.ndarray
    skip: np.ndarray
    norm: np.ndarray
    go: np.ndarray
    tri: np.ndarray
    total: np.ndarray
    low: int = 0  # the first row whose weights are here; ``norm`` and ``tri`` are, whatever the rows

    def log10(self, t: Tokens, rows: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's row and class; of a part of the rows, its share of that.

        The shares of all parts add up to the whole. What depends on classes alone is in the share of the first rows.
        """
        c, k, b, u = t.classes, t.before(t.classes, 1, CLASSES), t.before(t.classes, 2, CLASSES), t.before(rows, 1, self.layout.start[-1])
        if len(self.base) == self.layout.start[-1] + 1:
            z = self.base[rows] - self.norm.reshape(-1)[(c * BEFORE + k) * BEFORE + b] + self.tri.reshape(-1)[(k * BEFORE + b) * CLASSES + c]
            z += self.near.reshape(-1)[rows * BEFORE + k]
            z += self.skip.reshape(-1)[rows * BEFORE + b]
            z += self.go.reshape(-1)[u * CLASSES + c]
            z -= self.total.reshape(-1)[u * BEFORE + b]
            return z.astype(np.float64) / np.log(10)
        z = np.zeros(len(rows))
        if self.low == 0:
            z += self.tri[k, b, c] - self.norm[c, k, b]
        own, before = rows - self.low, u - self.low
        here, there = (np.flatnonzero((x >= 0) & (x < len(self.base))) for x in (own, before))
        z[here] += self.base[own[here]].astype(np.float64) + self.near[own[here], k[here]] + self.skip[own[here], b[here]]
        z[there] += self.go[before[there], c[there]].astype(np.float64) - self.total[before[there], b[there]]
        return z / np.log(10)


def count_words(docs: DataFrame) -> DataFrame:
    """``h, class, c``: the hash, class and count of each token over all texts of ``docs`` (``id, text``)."""

    def merged(held: list) -> list:
        h, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, k, n = h[order], k[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return [(h[at], k[at], np.add.reduceat(n, at))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h, k, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(n)], ["h", "class", "c"])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                t = tokens(data, offsets)
                h, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
                held.append((h, t.classes[at], n))
                size += len(h)
                if size > COUNTED:
                    held = merged(held)
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield out()
                        held, size = [], 0
        if held:
            held = merged(held)
            yield out()

    return docs.mapInArrow(run, "h long, class int, c long").groupBy("h").agg(F.max("class").alias("class"), F.sum("c").alias("c"))


def _pair_counts(docs: DataFrame, known: object) -> DataFrame:
    """``class, kind, chunk, pairs``: what stands where, summed over all texts of ``docs``.

    ``pairs`` is a matrix of 32-bit floats. Kinds: 0, the rows of a class's chunk by the class before; 1, by the class before
    that; 2, by the class after; 3, of a class, by both classes before; 4, of a class, by the class before and after.
    """
    wide = {0: BEFORE, 1: BEFORE, 2: CLASSES, 3: BEFORE, 4: CLASSES}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Layout(**known.value)
        none = place.start[-1]
        starts = np.append(place.start, none + 1)

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                width = wide[kind]
                # keys of a class, then of its chunks of rows, lie together
                edges = [starts[k] + np.arange(0, max(1, starts[k + 1] - starts[k]), CHUNK) for k in range(BEFORE)] if kind < 3 else [np.array([k * BEFORE]) for k in range(BEFORE)]
                of = np.repeat(np.arange(BEFORE), [len(x) for x in edges])
                edges = np.concatenate(edges)
                cut = np.searchsorted(keys, np.append(edges, edges[-1] + max(CHUNK, BEFORE)) * width)
                chunk = np.concatenate([np.arange((of == k).sum()) for k in range(BEFORE)])
                some = np.flatnonzero(np.diff(cut))
                local = keys - np.repeat(edges * width, np.diff(cut))
                blobs = [[x[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in some] for x in (local, n)]
                yield pa.RecordBatch.from_arrays([pa.array(of[some].astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array(chunk[some].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], ["class", "kind", "chunk", "keys", "counts"])

        held, size = [[] for _ in wide], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                t = tokens(data, offsets)
                one, back = np.unique(t.hashes, return_inverse=True)
                kind_of = np.zeros(len(one), np.int64)
                kind_of[back] = t.classes
                rows = place.rows(one, kind_of)[back]
                c, k, b, u = t.classes, t.before(t.classes, 1, CLASSES), t.before(t.classes, 2, CLASSES), t.before(rows, 1, none)
                starts_here = np.full(len(t.first) - 1, none * BEFORE + CLASSES)  # no word, and none before it
                for i, x in enumerate((np.concatenate((rows * BEFORE + k, starts_here)), rows * BEFORE + b, u * CLASSES + c, (c * BEFORE + k) * BEFORE + b, (k * BEFORE + b) * CLASSES + c)):
                    held[i].append(x)
                size += len(c)
                if size > PAIRED:
                    yield from out()
                    held, size = [[] for _ in wide], 0
        if size:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, kind, chunk, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                at = total.setdefault((k, kind, chunk), np.zeros((CHUNK if kind < 3 else BEFORE) * wide[kind], np.float32))
                at[np.frombuffer(keys.as_buffer(), np.uint32)] += np.frombuffer(counts.as_buffer(), np.uint32)
        if total:
            k, kind, chunk = (pa.array([x[i] for x in total], pa.int32()) for i in range(3))
            yield pa.RecordBatch.from_arrays([k, kind, chunk, pa.array([x.tobytes() for x in total.values()], pa.binary())], ["class", "kind", "chunk", "pairs"])

    parts = docs.mapInArrow(gather, "class int, kind int, chunk int, keys binary, counts binary")
    return materialise(parts.repartition("class", "kind", "chunk").mapInArrow(add, "class int, kind int, chunk int, pairs binary"), "pairs")


def climb(pairs: np.ndarray, seen1: np.ndarray, seen2: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a softmax with two features, and the log of its sums.

    An outcome x after features i and j has the weight w1[i, x] + w2[j, x]. ``pairs`` counts the features
    together, ``seen1`` and ``seen2`` each with the outcomes. Each update steps along the gradient
    of the log likelihood, scaled by the counts.
    """
    w1, w2 = np.zeros(seen1.shape, np.float32), np.zeros(seen2.shape, np.float32) + base.astype(np.float32)
    for _ in range(STEPS):
        e1, e2 = np.exp(w1), np.exp(w2)
        q = pairs / np.maximum(e1 @ e2.T, 1e-30)
        for w, seen, expected in ((w1, seen1, e1 * (q @ e2)), (w2, seen2, e2 * (q.T @ e1))):
            w += RATE * np.clip((seen - expected) / (np.minimum(seen, expected) + SMOOTH), -2, 2)
    w1 = w1.astype(np.float16)
    extra = (w2 - base).astype(np.float16)
    return w1, extra, np.log(np.maximum(np.exp(w1.astype(np.float32)) @ np.exp(extra.astype(np.float32) + base).T, 1e-30))


def _train_class(part: dict[tuple, np.ndarray], size: int, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Both factors' weights that belong to one class with ``size`` rows."""

    def whole(kind: int, width: int, rows: int) -> np.ndarray:
        got = [part.get((kind, i), np.zeros((CHUNK if kind < 3 else BEFORE) * width, np.float32)).reshape(-1, width) for i in range(-(-rows // CHUNK) if kind < 3 else 1)]
        return np.concatenate(got)[:rows]

    k, b, after = whole(0, BEFORE, size), whole(1, BEFORE, size), whole(2, CLASSES, size)
    base = np.log(k.sum(1) + np.float32(0.5)).astype(np.float32)
    base -= np.log(np.exp(base).sum())
    near, skip, norm = climb(whole(3, BEFORE, BEFORE), np.ascontiguousarray(k.T), np.ascontiguousarray(b.T), base)
    go, tri, total = climb(k, after, whole(4, CLASSES, BEFORE), classes)
    return {"base": base, "near": near.T, "skip": skip.T, "norm": norm, "go": go, "tri": tri + classes, "total": total}


_TYPES = {"base": np.float32, "near": np.float16, "skip": np.float16, "norm": np.float32, "go": np.float16, "tri": np.float32, "total": np.float16}


#: Weights of rows, of which a range can be taken, and of classes.
_BY_ROW, _BY_CLASS = ("base", "near", "skip", "go", "total"), ("norm", "tri")


def train(docs: DataFrame, place: Layout, totals: np.ndarray) -> DataFrame:
    """``class, first, n`` and weights from all texts of ``docs`` (``id, text``); ``totals`` are the classes' tokens.

    A row has up to ``SPAN`` model rows of one class, from ``first``; a class's first also has what belongs to all of it.
    """
    classes = _class_logs(totals)
    sizes = np.append(np.diff(place.start), 1)
    pairs = _pair_counts(docs, docs.sparkSession.sparkContext.broadcast(vars(place)))
    types, by_row, by_class, span = dict(_TYPES), _BY_ROW, _BY_CLASS, SPAN

    def fit(table: pa.Table) -> pa.Table:
        k = table.column("class")[0].as_py()
        part = {(kind, chunk): np.frombuffer(p.as_buffer(), np.float32) for kind, chunk, p in zip(table.column("kind").to_pylist(), table.column("chunk").to_pylist(), table.column("pairs"), strict=True)}
        found = _train_class(part, int(sizes[k]), classes)
        found = {name: np.ascontiguousarray(found[name].astype(t)) for name, t in types.items()}
        cuts = range(0, int(sizes[k]), span)
        out = {"class": pa.array([k] * len(cuts), pa.int32()), "first": pa.array([int(place.start[k]) + at for at in cuts]), "n": pa.array([min(span, int(sizes[k]) - at) for at in cuts])}
        out |= {name: pa.array([found[name][at : at + span].tobytes() for at in cuts], pa.binary()) for name in by_row}
        out |= {name: pa.array([b"" if at else found[name].tobytes() for at in cuts], pa.binary()) for name in by_class}
        return pa.table(out)

    return pairs.groupBy("class").applyInArrow(fit, "class int, first long, n long, " + ", ".join(f"{n} binary" for n in (*_BY_ROW, *_BY_CLASS)))


def _class_logs(totals: np.ndarray) -> np.ndarray:
    return np.log((totals + 1) / (totals.sum() + CLASSES)).astype(np.float32)


def fetch(weights: DataFrame, place: Layout, totals: np.ndarray, room: np.ndarray, low: int, high: int) -> Model:
    """The model with the weights of the rows from ``low`` to before ``high``; classes that nothing was counted for have their defaults."""
    sizes, rows = np.diff(place.start), high - low
    base = np.zeros(int(place.start[-1]) + 1, np.float32)
    base[:-1] = -np.log(np.repeat(sizes, sizes))
    m = Model(
        place, room, base[low:high].copy(), np.zeros((rows, BEFORE), np.float16), np.zeros((rows, BEFORE), np.float16), np.zeros((CLASSES, BEFORE, BEFORE), np.float32),
        np.zeros((rows, CLASSES), np.float16), np.tile(_class_logs(totals), (BEFORE, BEFORE, 1)), np.zeros((rows, BEFORE), np.float16), low,
    )
    # the rows of the range, and one more row for each class with what all its rows share
    for r in weights.where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).select("first", "n", *_BY_ROW).collect():
        a, b = max(low, r["first"]), min(high, r["first"] + r["n"])
        for name in _BY_ROW:
            into = getattr(m, name)
            into[a - low : b - low] = np.frombuffer(r[name], _TYPES[name]).reshape(r["n"], *into.shape[1:])[a - r["first"] : b - r["first"]]
    if low == 0:
        for r in weights.where(F.length("tri") > 0).select("class", *_BY_CLASS).collect():
            k = r["class"]
            m.tri[k] = np.frombuffer(r["tri"], np.float32).reshape(m.tri[k].shape)
            if k < CLASSES:
                m.norm[k] = np.frombuffer(r["norm"], np.float32).reshape(m.norm[k].shape)
    return m


def _vocabulary_cut(vocab: DataFrame, most: tuple[int, int]) -> tuple[int, ...]:
    """For each number in ``most``, the least level of counts that no more words reach; levels are eighths of log2."""
    got = {r.level: r.n for r in vocab.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 8 x 64 rows
    out = []
    for limit in most:
        seen, cut = 0, 1 << 30
        for level in sorted(got, reverse=True):
            seen += got[level]
            if seen > limit:
                break
            cut = level
        out.append(cut)
    return tuple(out)


def _level() -> F.Column:
    return F.floor(F.log2("c") * 8).cast("int")


def build(vocab: DataFrame, train_docs: DataFrame) -> tuple[Iterator[Model], np.ndarray, np.ndarray, np.ndarray, int]:
    """The models of ranges of rows that are within ``MODEL_BYTES``, most often one of all rows, sorted hashes and counts of common words, and totals and distinct words of all training tokens."""
    sums = {r["class"]: r for r in vocab.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    totals, distinct = (np.array([sums[k][x] if k in sums else 0 for k in range(CLASSES)], np.int64) for x in "cv")
    rows = int(ROWS * max(1, int(totals.sum())) ** (1 / 3))
    own_cut, cut = _vocabulary_cut(vocab, (rows // 2, max(COMMON, rows // 2)))
    top = vocab.where(_level() >= min(own_cut, cut)).select("h", "class", "c", (_level() >= own_cut).alias("own")).toPandas().sort_values("h")
    h, c = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    own = top.own.to_numpy(bool)
    own_class = top["class"].to_numpy(np.int64)[own]
    place = layout(h[own], own_class, distinct - np.bincount(own_class, minlength=CLASSES), rows // 2)

    def row_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = place.rows(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(r), batch.column(2)], ["row", "c"])

    room = np.ones(int(place.start[-1]) + 1)
    sums_of = vocab.where(_level() < own_cut).select("h", "class", "c").mapInArrow(row_of, "row long, c long").groupBy("row").agg(F.sum(F.col("c") + 1).alias("c")).toPandas()
    room[sums_of.row.to_numpy(np.int64)] += sums_of.c.to_numpy(np.int64)
    weights = materialise(train(train_docs, place, totals), "weights")
    step = min(len(room), max(1, MODEL_BYTES // ROW_BYTES))
    models = (fetch(weights, place, totals, np.log10(room), low, min(low + step, len(room))) for low in range(0, len(room), step))
    order = np.argsort(h)
    return models, h[order], c[order], totals, int(distinct.sum())


def _scorer(lookup: Broadcast, floor: float, first: bool, keyed: bool):
    """Texts (``id, text`` and, if ``keyed``, ``key``) to the sums of each, and its unknown words; passes but the first give the model's share only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights, hashes, counts = lookup.value
        place, key = Layout(**place), TaskContext.get().partitionId() << 40
        model = Model(layout=place, **weights)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                t = tokens(data, offsets)
                one, back = np.unique(t.hashes, return_inverse=True)
                kind_of = np.zeros(len(one), np.int64)
                kind_of[back] = t.classes
                rows = place.rows(one, kind_of)
                docs_, n = hi - lo, np.diff(t.first)
                keys = batch.column(2).slice(lo, docs_).to_numpy() if keyed else key + np.arange(docs_)
                key += docs_
                found = model.log10(t, rows[back])
                if not first:
                    none = pa.array(np.zeros(docs_, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).slice(lo, docs_), pa.nulls(docs_, pa.int64()), none, none, pa.array(np.zeros(docs_)), pa.array(np.bincount(t.doc, found, docs_))], NAMES)
                    continue
                hashed = rows >= place.hashed[kind_of]
                at = np.minimum(np.searchsorted(hashes, one), max(0, len(hashes) - 1))
                known = hashes[at] == one if len(hashes) else np.zeros(len(one), bool)
                share = np.where(known, np.log10(np.where(known, counts[at] if len(counts) else 0, 0) + 1.0), 0.0)
                found = found + np.where(hashed, share - model.room[rows], 0.0)[back]
                sums = [np.bincount(t.doc, known[back], docs_).astype(np.int64), np.bincount(t.doc, (share - floor)[back], docs_), np.bincount(t.doc, found, docs_)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).slice(lo, docs_), pa.nulls(docs_, pa.int64()), pa.array(n), *map(pa.array, sums)], NAMES)
                rare = np.flatnonzero(~known[back])
                if len(rare):
                    # each unknown word once for each of its texts
                    word, doc = back[rare], t.doc[rare]
                    pair, times = np.unique(doc * np.int64(len(one)) + word, return_counts=True)
                    doc, word = pair // len(one), pair % len(one)
                    zero = np.zeros(len(pair))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), batch.column(0).slice(lo, docs_).take(pa.array(doc)), pa.array(one[word].view(np.int64)), pa.array(times), pa.array(np.zeros(len(pair), np.int64)), pa.array(zero), pa.array(zero)], NAMES)

    return run


def score_texts(docs: DataFrame, train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` for every text of ``docs``.

    Both scores are sums of log10 probabilities over a text's tokens: of the add-one
    unigram model, and of the model described above. A null text counts as empty, which is
    the end alone. Rows are scored one by one, so repeated ids and null ids give a result
    for each row. Without training text, all words are unseen. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learn = train_docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocab = materialise(count_words(learn), "vocabulary")
    models, hashes, counts, totals, distinct = build(vocab, learn)
    total = int(totals.sum())
    floor = np.log10(total + distinct + 1)
    sc, parts = docs.sparkSession.sparkContext, None
    for model in models:
        # broadcasts hold arrays, no objects of this package: those are pickled by name, which executors may not know
        lookup = sc.broadcast((vars(model.layout), {k: v for k, v in vars(model).items() if k != "layout"}, hashes, counts))
        if parts is None and len(model.base) < model.layout.start[-1] + 1:
            own = materialise(own.withColumn("key", F.monotonically_increasing_id()), "keyed")  # rows keep their keys through all passes
        scored = own.mapInArrow(_scorer(lookup, floor, model.low == 0, "key" in own.columns), f"key long, id {kind}, h long, n long, n_known long, base double, model double")
        scored = materialise(scored, "parts")
        parts = scored if parts is None else parts.unionByName(scored)
        lookup.unpersist()
    if "key" in own.columns:
        sums = parts.where("h is null").groupBy("key").agg(F.any_value("id").alias("id"), *(F.sum(c).alias(c) for c in ("n", "n_known", "base", "model")))
        parts = sums.select("key", "id", F.lit(None).cast("long").alias("h"), "n", "n_known", "base", "model").unionByName(parts.where("h is not null"))
    rare = parts.where("h is not null").select("key", "h", "n").join(vocab.select("h", "c").hint("merge"), "h")
    rare = rare.groupBy("key").agg(F.sum("n").alias("r_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("r_log"))
    whole = parts.where("h is null").join(rare.hint("merge"), "key", "left")
    more = F.coalesce("r_log", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


NAMES = ["key", "id", "h", "n", "n_known", "base", "model"]


def score_documents(docs: DataFrame, folds: int = 7, part: int = 2) -> DataFrame:
    """:func:`score_texts` of all documents, learned outside the held-out fold, with ``held_out``."""
    held = fold("doc_id", folds, part)
    out = score_texts(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
