"""b-bit MinHash near-duplicate groups, confirmed on full shingle sets.

Each text's set of distinct 5-word shingles gets 125 minima. Five minima make one of
25 band keys; two texts whose sets have a Jaccard similarity of 0.85 share none of them
with a probability of 4e-7. The lowest two bits of each minimum are packed into four
longs, and the share of equal two-bit lanes, less what equals by chance, estimates the
similarity of a candidate pair before its full sets are compared.

Groups of any size: equal sets are one class from the start. First each class is compared
with one other, the smallest first class of a few of its buckets; then with the first
class of any bucket that is still in another component. Classes of one bucket that are
in different components after that are compared with each other in blocks, by signatures
of 1024 lanes, and the likely pairs of them by their full sets. So no link that could join
components is left out, and few pairs are written down that are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import mix, shingles, slices, words
from lodestone.operators.components import connected_components
from lodestone.plans.stages import materialise

BANDS, ROWS, BITS = 25, 5, 2
LANES = BANDS * ROWS
#: Lanes of the signatures that are taken of what the first rounds leave, the estimate that
#: lies five standard deviations below 0.85 there, and classes in a block of a bucket.
WIDE, LEAST_WIDE, BLOCK = 1024, 0.784, 1024
#: Bands of the first round, which compares each class with one other.
FIRST_BANDS = 5
#: Estimated similarity below which a candidate pair is not compared: six standard
#: deviations of the estimate below a similarity of 0.85.
LEAST_ESTIMATE = 0.62

_SEED = mix(np.arange(1, 2 * LANES + 1, dtype=np.uint64))
_MUL, _ADD = _SEED[:LANES] | np.uint64(1), _SEED[LANES:]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' offsets in them."""
    _, _, h, first = words(data, offsets, lower=True)
    g, at = shingles(h, first, n)
    own = [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64)))


def _sketch(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and packed low bits (texts x 4) of the non-empty sets."""
    minima = np.empty((LANES, len(at) - 1), np.uint64)
    for k in range(LANES):
        minima[k] = np.minimum.reduceat(g * _MUL[k] + _ADD[k], at[:-1])
    bands = np.empty((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at) - 1, b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ minima[b * ROWS + r])
        bands[:, b] = key
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    packed = np.zeros((len(at) - 1, 4), np.uint64)
    for k in range(LANES):
        packed[:, k // 32] |= low[k] << np.uint64(BITS * (k % 32))
    return bands, packed


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """``id, n_shingles, k1, k2, bands, s0..s3`` per document; k1 and k2 identify the set.

    A null text or one without words has n_shingles 0 and nulls for the rest.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                g, at = _sets(data, offsets, n)
                size = np.diff(at)
                has = np.flatnonzero(size)
                start = at[:-1][has]
                none = np.ones(hi - lo, bool)
                none[has] = False
                longs = np.zeros((6, hi - lo), np.uint64)
                bands = np.zeros((0, BANDS), np.uint64)
                if len(has):
                    bands, packed = _sketch(g, np.append(start, len(g)))
                    longs[0, has] = np.add.reduceat(g, start)
                    longs[1, has] = np.bitwise_xor.reduceat(mix(g), start)
                    longs[2:, has] = packed.T
                ends = np.concatenate(([0], np.cumsum(~none) * BANDS)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64)), mask=pa.array(none))
                cols = [pa.array(x.view(np.int64), mask=none) for x in longs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), *cols[:2], lists, *cols[2:]],
                    ["id", "n_shingles", "k1", "k2", "bands", "s0", "s1", "s2", "s3"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_shingles long, k1 long, k2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def estimate(a: str, b: str) -> Column:
    """The collision-corrected similarity of two packed signatures in columns a_s0.., b_s0.."""
    differ = F.lit(0)
    for i in range(4):
        x = F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))
        odd = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(odd)
    by_chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(LANES)) - by_chance) / (1 - by_chance)


def _sides(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) with both packed signatures and set sizes."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("s0", "s1", "s2", "s3", "n_shingles"))), side)
    return pairs


def _within_buckets(inside: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Pairs (a, b) of classes in one bucket and different components that wide signatures call likely.

    ``inside`` has ``band, n, rep, component``. A bucket is cut into blocks, and each pair
    of blocks is compared in one group, so that no group grows with the bucket. A pair is
    named once, in the first bucket that it shares.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = (mix(np.arange(k, k + WIDE, dtype=np.uint64)) for k in (1 << 20, 1 << 21))
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                g, at = _sets(data, offsets, n)
                low = np.empty((WIDE, hi - lo), np.uint8)
                for k in range(WIDE):
                    low[k] = mix(np.minimum.reduceat(g * (mul[k] | np.uint64(1)) + add[k], at[:-1])) & np.uint64(3)
                packed = np.packbits(((low.T[:, :, None] >> np.arange(2, dtype=np.uint8)) & 1).reshape(hi - lo, -1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in packed], pa.binary())], ["rep", "wide"])

    def pairs(key: tuple, part: pa.Table) -> pa.Table:
        sign = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint64).reshape(len(part), -1)
        bands = np.array(part.column("bands").to_pylist(), np.int64)
        rep, comp, block = (part.column(c).to_numpy() for c in ("rep", "component", "block"))
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        odd, a, b = np.uint64(0x5555555555555555), [], []
        for r in left:
            x = sign[right] ^ sign[r]
            same = 1 - np.bitwise_count((x | x >> np.uint64(1)) & odd).sum(1) / WIDE
            near = right[((same - 0.25) / 0.75 >= LEAST_WIDE) & (comp[right] != comp[r]) & ((rep[right] > rep[r]) if i == j else True)]
            common = bands[near] == bands[r]
            near = near[bands[r][common.argmax(1)] == key[0].as_py()] if len(near) else near
            a += np.minimum(rep[near], rep[r]).tolist()
            b += np.maximum(rep[near], rep[r]).tolist()
        return pa.table({"a": pa.array(a, part.schema.field("rep").type), "b": pa.array(b, part.schema.field("rep").type)})

    ids = inside.select(F.col("rep").alias(id_col)).distinct()
    wide = docs.select(id_col, text_col).join(ids.hint("merge"), id_col, "left_semi").mapInArrow(widen, f"rep {id_type}, wide binary")
    own = materialise(wide.join(classes.select("rep", "bands"), "rep"), "wide")
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = inside.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component").join(own, "rep")
    return rows.groupBy("band", "i", "j").applyInArrow(pairs, f"a {id_type}, b {id_type}")


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) for which 100 * intersection >= percent * union of the full sets."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ids = pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                g, at = _sets(data, offsets, n)
                own = [g[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["id", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = docs.select(id_col, text_col).join(ids.hint("merge"), id_col, "left_semi").mapInArrow(sets, f"id {id_type}, own binary")
    own = materialise(own, "sets")
    both = pairs.select("a", "b").join(own.select(F.col("id").alias("a"), F.col("own").alias("a_own")), "a")
    both = both.join(own.select(F.col("id").alias("b"), F.col("own").alias("b_own")), "b").select("a", "b", "a_own", "b_own")
    return both.mapInArrow(compare, f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every document.

    Words are lower-cased in A-Z. Documents whose sets of distinct n-word shingles have
    100 * intersection >= percent * union are linked; component_id is the smallest id
    reachable over links, kept says whether that is the document itself. Documents
    without words (null and empty texts) have n_shingles 0 and are alone; a text of
    fewer than n words is one shingle. Equal texts are linked whatever their number.
    Rows are kept one for one. Rows that repeat an id are one document with several texts:
    each has its own n_shingles, and the links of all of them hold for all. Null ids are
    alone, with a null component and kept null. Other columns are not read. An empty table gives an empty result.
    """
    signed = materialise(signatures(docs, id_col, text_col, n), "signatures")
    own = signed.where("n_shingles > 0 and id is not null")
    classes = own.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"))
    member = own.select("id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("id", "rep")
    member = materialise(member, "members")
    # an id with several texts may be in several classes, which are then linked
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    same = materialise(member.join(several.hint("merge"), "id").where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "same")
    first = own.join(member.where("id = rep").select("id"), "id", "left_semi").withColumnRenamed("id", "rep")
    first = materialise(first.dropDuplicates(["rep", "k1", "k2", "n_shingles"]), "classes")
    buckets = first.select(F.posexplode("bands").alias("at", "band"), "rep")

    def placed(comp: DataFrame) -> DataFrame:
        return buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = _sides(pairs, first).where(near & (estimate("a", "b") >= LEAST_ESTIMATE)).select("a", "b")
        return materialise(_confirmed(materialise(likely, "pairs"), docs, id_col, text_col, n, percent), "links")

    near = F.expr(f"100 * least(a_n_shingles, b_n_shingles) >= {percent} * greatest(a_n_shingles, b_n_shingles)")
    # each class with the smallest first class of its first few buckets: one pair a class
    few = buckets.where(F.col("at") < FIRST_BANDS)
    leaders = few.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    links = same.union(confirmed(few.join(leaders, "band").where("a < rep").groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a"))))
    comp = connected_components(links, "a", "b")
    # each class with its buckets' first classes, where those are in another component
    whole = placed(comp)
    leaders = whole.groupBy("band").agg(F.min("rep").alias("a"), F.min_by("component", "rep").alias("ca"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "a", "ca")
    star = materialise(whole.join(leaders, "band").where("component <> ca").select("a", F.col("rep").alias("b")).distinct(), "star")
    if not star.isEmpty():
        links = links.union(confirmed(star))
        comp = connected_components(links, "a", "b")
        # what is left: buckets whose classes are still in several components
        whole = placed(comp)
        mixed = whole.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("band", "n")
        inside = materialise(whole.join(mixed, "band"), "mixed")
        if not inside.isEmpty():
            likely = materialise(_within_buckets(inside, first, docs, id_col, text_col, n).join(star, ["a", "b"], "left_anti"), "pairs")
            if not likely.isEmpty():
                links = links.union(materialise(_confirmed(likely, docs, id_col, text_col, n, percent), "links"))
                comp = connected_components(links, "a", "b")

    found = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = signed.select("id", "n_shingles").join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
