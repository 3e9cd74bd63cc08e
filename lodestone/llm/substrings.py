"""Removal of repeated passages by backward search in one FM-index per shard of passages.

A passage is a window of 20 consecutive words. Equal windows must meet in one shard without
every document meeting every shard, so windows are routed by content: a window's anchor is
the smallest of its 16 five-word hashes, and neighbouring windows with one anchor travel as
one segment of words. Only segments whose anchor occurs again anywhere are looked at, and
equal segments are one: all but the first of them repeat it in full.

A shard indexes its segments' words as strings over the alphabet of their five-word hashes,
taken at every fifth word, so a window is a pattern of four symbols. The index holds the
Burrows-Wheeler transform in a wavelet tree of packed bit rows with popcount ranks; segments
stream through it by backward search, which gives for each position how many symbols match
elsewhere (matching statistics) and, at four, the interval of all equal windows. A window is
removed if that interval holds an earlier start.

Anchors that occur very often (a passage that a third of all documents share) would put all
text around that passage into one shard; their windows are routed one by one, by the hash
of the whole window. So that one window's places do not all meet in one shard either, they are dealt
over several first; each shard's index finds the first of its places, and only these go on to the
next round, until one shard holds a window's places. A false match needs equal 64-bit hashes in each
of the four symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import _power, grams, mix, slices, words
from lodestone.plans.stages import materialise

#: Words in a window and in a symbol, symbols in a window.
WINDOW, GRAM = 20, 5
DEPTH = WINDOW // GRAM
SPAN = WINDOW - GRAM + 1
#: Occurrences of an anchor from which its windows are routed one by one.
HOT = 4000
#: Segments in a shard, about.
SHARD = 15_000


class WaveletTree:
    """A sequence of symbols below ``size`` with ranks, as one packed bit row for each binary digit."""

    def __init__(self, seq: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.rows = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            pad = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            pad[: len(bit)] = bit
            packed = np.packbits(pad, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.rows.append((level, packed, before, len(bit) - int(bit.sum())))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``end``."""
        lo, hi = np.zeros(len(end), np.int64), end.astype(np.int64)
        for level, packed, before, zeros in self.rows:
            one = ((symbol >> level) & 1).astype(bool)
            ends = []
            for at in (lo, hi):
                word = at >> 6
                part = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
                ones = before[word] + np.bitwise_count(part)
                ends.append(np.where(one, zeros + ones, at - ones))
            lo, hi = ends
        return hi - lo


class FmIndex:
    """An FM-index of a text of symbols (0 separates) for patterns of up to ``DEPTH`` symbols."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < DEPTH:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            key = rank * (int(rank.max(initial=0)) + 1) + after
            rank = np.unique(key, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.last = WaveletTree(text[self.suffixes - 1], size)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern (a row): how many of its last symbols occur more than once together,
        and the interval of suffixes that begin with them, as far as that was so."""
        c = patterns[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        matched = (hi - lo > 1).astype(np.int64)
        live = np.flatnonzero(matched)
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[live, k]
            new_lo = self.first[c] + self.last.rank(c, lo[live])
            new_hi = self.first[c] + self.last.rank(c, hi[live])
            more = new_hi - new_lo > 1
            live = live[more]
            lo[live], hi[live] = new_lo[more], new_hi[more]
            matched[live] += 1
        return matched, lo, hi


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, windows, anchor, content hash and times (1, or 2: the anchor is
    twice in its text) of each run of windows with one anchor."""
    _, _, h, first = words(data, offsets)
    g = grams(h, GRAM)
    n = len(g) - SPAN + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    low = g
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    valid = doc[:n] == doc[WINDOW - 1 :][:n]
    fresh = np.ones(n, bool)
    fresh[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1]) | ~valid[:-1]
    start = np.flatnonzero(fresh & valid)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    stop = np.flatnonzero(np.concatenate((fresh[1:] | ~valid[1:], [True])) & valid) + 1
    anchor, count = low[start], stop - start
    order = np.argsort(g, kind="stable")
    same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twin = np.zeros(len(g), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    place = start + (g[start[:, None] + np.arange(SPAN)] == anchor[:, None]).argmax(1)
    total = np.zeros(len(g) + 1, np.uint64)
    up, down = _power(len(g))
    np.cumsum(g * up[: len(g)], out=total[1:])
    content = mix((total[stop + SPAN - 1] - total[start]) * down[start])
    return doc[start], start - first[doc[start]], count, anchor.view(np.int64), content.view(np.int64), np.where(twin[place], 2, 1)


def _repeats(shard: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window (both relative) of each run of windows of the shard's
    segments that also start earlier in the shard."""
    text = shard.column("segment").combine_chunks()
    parts = [(lo, words(data, offsets)) for lo, _, data, offsets in slices(text)]
    h = np.concatenate([p[2] for _, p in parts])
    size = np.concatenate([np.diff(p[3]) for _, p in parts])
    first = np.concatenate(([0], np.cumsum(size)))
    g = grams(h, GRAM)
    symbols = np.unique(g, return_inverse=True)[1] + 1
    # every fifth position of a segment, for each of the five starts, then a separator
    seg = np.repeat(np.arange(len(size)), size - GRAM + 1)
    place = np.arange(len(seg)) - np.repeat(np.concatenate(([0], np.cumsum(size - GRAM + 1)))[:-1], size - GRAM + 1)
    order = np.lexsort((place, place % GRAM, seg))
    seg, place = seg[order], place[order]
    chain = seg * GRAM + place % GRAM
    gap = np.cumsum(np.concatenate(([0], chain[1:] != chain[:-1])))
    string = np.zeros(len(seg) + int(gap[-1]) + 2, np.int64)
    at = np.arange(len(seg)) + gap
    string[at] = symbols[first[seg] + place]
    index = FmIndex(string, int(symbols.max()) + 1)
    window = np.flatnonzero(place + SPAN <= size[seg] - GRAM + 1)
    matched, lo, hi = index.search(string[at[window][:, None] + np.arange(DEPTH)])
    again = np.flatnonzero(matched == DEPTH)
    if not len(again):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    when = np.full(len(string), len(string), np.int64)
    ids, tags, starts = shard.column("id").to_numpy(), shard.column("tag").to_numpy(), shard.column("start").to_numpy().astype(np.int64)
    of, tag, pos = ids[seg[window]], tags[seg[window]], starts[seg[window]] + place[window]
    order = np.lexsort((tag, pos, of))
    # rows that are given twice have one place
    new = (of[order][1:] != of[order][:-1]) | (pos[order][1:] != pos[order][:-1]) | (tag[order][1:] != tag[order][:-1])
    when[at[window[order]]] = np.concatenate(([0], np.cumsum(new)))
    ranges, back = np.unique(np.stack([lo[again], hi[again]]), axis=1, return_inverse=True)
    ordered = np.append(when[index.suffixes], len(string))
    earliest = np.minimum.reduceat(ordered, ranges.T.reshape(-1))[::2]
    hit = window[again[earliest[back.reshape(-1)] < when[at[window[again]]]]]
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    key = np.sort(seg[hit] * (1 << 32) + place[hit])
    new = np.concatenate(([True], key[1:] != key[:-1] + 1))
    last = np.concatenate((new[1:], [True]))
    return key[new] >> 32, key[new] & 0xFFFFFFFF, key[last] & 0xFFFFFFFF


def repeated_spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``id, tag, first, last``: runs of words that some window with an earlier start also has.

    ``docs`` has ``id, tag, text``; ids are not null.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                doc, start, n, anchor, content, times = _runs(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo).take(pa.array(doc)) for i in (0, 1)), *(pa.array(x.astype(t)) for x, t in ((start, np.int32), (n, np.int32), (anchor, np.int64), (content, np.int64), (times, np.int32)))],
                    ["id", "tag", "start", "n", "anchor", "content", "times"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(runs, f"id {kind}, tag long, start int, n int, anchor long, content long, times int")
    seen = rows.groupBy("anchor").agg(F.sum("times").alias("seen")).where("seen > 1")
    again = materialise(rows.drop("times").join(seen.hint("merge"), "anchor"), "segments")
    firsts = again.groupBy("anchor", "content", "n").agg(F.min(F.struct("id", "start", "tag")).alias("one"), F.max("seen").alias("seen"))
    firsts = materialise(firsts.select("anchor", "content", "n", "one.id", "one.tag", "one.start", "seen"), "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for key, tag, blob, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                own = open_.decompress(blob.as_buffer()).split()
                for p in parts:
                    if p["seen"] < HOT:
                        out.append((p["anchor"], key, tag, p["start"], b" ".join(own[p["start"] : p["start"] + p["n"] + WINDOW - 1]), 1))
                    else:
                        for i in range(p["start"], p["start"] + p["n"]):
                            window = b" ".join(own[i : i + WINDOW])
                            out.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), key, tag, i, window, 1 + p["seen"] // HOT))
            route, ids, tags, start, text, deal = zip(*out, strict=True) if out else ((), (), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(ids, batch.schema.field(0).type), pa.array(tags, pa.int64()), pa.array(start, pa.int32()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(deal, pa.int64())], ["route", "id", "tag", "start", "segment", "deal"])

    shape = f"route long, id {kind}, tag long, start int, segment string, deal long"
    wanted = firsts.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n", "anchor", "seen")).alias("parts"))
    segments = packed.join(wanted.hint("merge"), ["id", "tag"]).select("id", "tag", "packed", "parts").mapInArrow(cut, shape)
    segments = materialise(segments, "cut")

    def sharded(rows: DataFrame) -> DataFrame:
        shards = max(1, -(-rows.count() // SHARD))
        return rows.withColumn("shard", F.pmod(F.xxhash64("route", F.pmod(F.xxhash64("id", "tag", "start"), "deal")), F.lit(shards))).groupBy("shard")

    def reduce(table: pa.Table) -> pa.Table:
        gone = np.zeros(len(table), bool)
        gone[_repeats(table)[0]] = True
        return table.select(["route", "id", "tag", "start", "segment", "deal"]).append_column("gone", pa.array(gone))

    # windows that are dealt over several shards: only the first of each shard goes on
    found, hot = [], segments.where("deal > 1")
    segments = segments.where("deal = 1")
    while not hot.isEmpty():
        seen = materialise(sharded(hot).applyInArrow(reduce, f"{shape}, gone boolean"), "round")
        found.append(seen.where("gone").select("id", "tag", F.col("start").cast("long").alias("first"), (F.col("start") + WINDOW - 1).cast("long").alias("last")))
        left = seen.where("not gone").drop("gone").withColumn("deal", F.when(F.col("deal") <= HOT, 1).otherwise(F.floor(F.col("deal") / HOT) + 1).cast("long"))
        segments, hot = segments.unionByName(left.where("deal = 1")), left.where("deal > 1")

    def search(table: pa.Table) -> pa.Table:
        row, first, last = _repeats(table)
        start = table.column("start").to_numpy()[row].astype(np.int64)
        return pa.table({**{c: table.column(c).take(pa.array(row)) for c in ("id", "tag")}, "first": pa.array(start + first), "last": pa.array(start + last + WINDOW - 1)})

    inside = sharded(segments).applyInArrow(search, f"id {kind}, tag long, first long, last long")
    for part in found:
        inside = inside.union(part)
    one = firsts.select("anchor", "content", "n", F.col("id").alias("one_id"), F.col("tag").alias("one_tag"), F.col("start").alias("one_start"))
    copies = again.join(one.hint("merge"), ["anchor", "content", "n"]).where("id <> one_id or start <> one_start or tag <> one_tag")
    return inside.union(copies.select("id", "tag", F.col("start").cast("long"), (F.col("start") + F.col("n") + WINDOW - 2).cast("long")))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, n_words, n_removed, kept`` for every document; kept joins what is left by spaces.

    Words are runs of bytes without ASCII white space, unchanged. A word goes if a window of
    20 words that covers it has a word sequence that also starts earlier: in a document with
    a smaller id, or earlier in the same one. Windows are judged on the input. Null and empty
    texts have no words; a text of fewer than 20 words stays as it is. Rows that repeat an id
    with its text are cut alike and do not repeat each other. Rows of one id with different texts are each cut
    by their own spans; ``tag``, a hash of the text, tells them apart and orders starts at the same
    place. Rows without an id take no part and keep their words. Other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(3)
        for batch in batches:
            blobs = [coder.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "tag", "packed"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            total, gone, left = [], [], []
            for blob, spans in zip(batch.column(2), batch.column(3), strict=True):
                text = open_.decompress(blob.as_buffer()).split()
                total.append(len(text))
                if spans.is_valid:
                    flat = spans.values.flatten()
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, flat[0].to_numpy(), 1)
                    np.add.at(cover, flat[1].to_numpy() + 1, -1)
                    text = [w for w, c in zip(text, np.cumsum(cover)[:-1].tolist(), strict=True) if not c]
                gone.append(total[-1] - len(text))
                left.append(b" ".join(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["id", "tag", "n_words", "n_removed", "kept"])

    packed = own.mapInArrow(pack, f"id {kind}, tag long, packed binary")
    # spans of repeated rows are the same ones, and so one
    spans = repeated_spans(own.where("id is not null"), packed).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    out = packed.join(materialise(spans, "spans").hint("merge"), ["id", "tag"], "left").select("id", "tag", "packed", "spans")
    return out.mapInArrow(keep, f"id {kind}, tag long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def kept_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`drop_repeats`."""
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


