"""Fill-in-the-middle transformation with a sparse exception index for offsets.

A text is cut between units, which are runs of ASCII letters and single other characters. All
work is on UTF-8 bytes. Where a character is one byte, positions in bytes and in code points
differ by a constant; only the multibyte characters are recorded, each with its place and its excess
bytes, and a binary search in them converts a cut from one to the other. Texts are taken in chunks, whose
units and excess bytes are summed first; the index is made of the chunks that hold a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import slices

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts left as they are, and percent of the others whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a chunk.
CHUNK = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
INNER = np.zeros(256, bool)
INNER[0x80:0xC0] = True
#: Bytes beyond the first of a character, by its first byte.
EXCESS = np.zeros(256, np.int64)
EXCESS[0xC0:0xE0], EXCESS[0xE0:0xF0], EXCESS[0xF0:] = 1, 2, 3


class Places:
    """Units, bytes and code points of the texts that lie at ``offsets`` in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int | None = None):
        self.data, self.chunk = data, chunk or CHUNK
        self.begins = offsets[:-1][np.diff(offsets) > 0]
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        units, excess = [0], [0]
        for c in range(-(-len(data) // self.chunk)):
            starts, _, after = self.index(c)
            units.append(units[-1] + len(starts))
            excess.append(excess[-1] + int(after[-1]))
        self.units, self.excess = np.array(units), np.array(excess)

    def index(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: where its units begin, where its multibyte characters do, and the excess bytes before each and after all."""
        if c not in self.held:
            lo, hi = c * self.chunk, min(len(self.data), (c + 1) * self.chunk)
            part, letter = self.data[lo:hi], LETTER[self.data[max(0, lo - 1) : hi]]
            inside = ~INNER[part]
            inside[1 if lo == 0 else 0 :] &= ~(letter[1:] & letter[:-1])
            inside[self.begins[np.searchsorted(self.begins, lo) : np.searchsorted(self.begins, hi)] - lo] = True
            wide = np.flatnonzero(part >= 0xC0)
            if len(self.held) > 3:
                self.held.pop(next(iter(self.held)))
            self.held[c] = np.flatnonzero(inside) + lo, wide + lo, np.concatenate(([0], np.cumsum(EXCESS[part[wide]])))
        return self.held[c]

    def units_before(self, at: np.ndarray) -> np.ndarray:
        """The number of units that begin before each byte."""
        out, of = np.full(len(at), self.units[-1]), at // self.chunk
        for c in np.unique(of[at < len(self.data)]):
            here = of == c
            out[here] = self.units[c] + np.searchsorted(self.index(int(c))[0], at[here])
        return out

    def byte_of(self, unit: np.ndarray) -> np.ndarray:
        """The byte at which each unit begins; the end, for the unit after the last."""
        out, of = np.full(len(unit), len(self.data)), np.searchsorted(self.units, unit, "right") - 1
        for c in np.unique(of[unit < self.units[-1]]):
            here = of == c
            out[here] = self.index(int(c))[0][unit[here] - self.units[c]]
        return out

    def points_before(self, at: np.ndarray) -> np.ndarray:
        """The number of code points before each byte: the bytes, less the excess of the multibyte characters before it."""
        out, of = at - self.excess[-1], at // self.chunk
        for c in np.unique(of[at < len(self.data)]):
            here = of == c
            _, wide, after = self.index(int(c))
            out[here] = at[here] - self.excess[c] - after[np.searchsorted(wide, at[here])]
        return out


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the id alone; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every document.

    ``n`` counts units. The first two draws of a document, modulo n + 1, say after how many units the
    prefix and the middle end. ``form`` is "psm" (prefix, suffix, middle), "spm" (suffix, prefix,
    middle) or "plain": empty texts, texts that hold a mark, and ``plain`` percent of the rest
    stay as they are and have null lengths. A null text counts as empty. Rows are independent, so
    repeated rows give repeated results; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(i).to_numpy() for i in range(2, 6)]
            for lo, hi, data, offsets in slices(batch.column(1)):
                places = Places(data, offsets)
                first = places.units_before(offsets)
                n = np.diff(first)
                a, b = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
                cuts = [places.byte_of(first[:-1] + x) for x in (np.minimum(a, b), np.maximum(a, b))]
                # a text's last unit is followed by the next text's first
                cuts = [np.minimum(x, offsets[1:]) for x in cuts]
                points = [places.points_before(x) for x in (offsets[:-1], *cuts)]
                lengths = [points[1] - points[0], points[2] - points[1]]
                forms, out = [], []
                for i in range(hi - lo):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    x, y = int(cuts[0][i] - offsets[i]), int(cuts[1][i] - offsets[i])
                    if not text or h[2][lo + i] % 100 >= 100 - plain or any(mark in text for mark in marks):
                        forms.append("plain")
                        out.append(text)
                    elif h[3][lo + i] % 100 < suffix_first:
                        forms.append("spm")
                        out.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                bare = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(forms), *(pa.array(x, mask=bare) for x in lengths), pa.array(out, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(id_col, seed))))
    return own.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that :func:`transform` was given, from its form and output.

    Marks open with "<" and close with ">", so none can begin inside a part and end inside
    a mark: the first of each kind is the one that was put in.
    """
    after = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    rest = F.lit(1 << 30)
    body = F.substring(output, F.lit(4), rest)
    second, third = F.instr(body, after), F.instr(body, F.lit(MIDDLE))
    one, two, middle = F.substring(body, F.lit(1), second - 1), F.substring(body, second + 3, third - second - 3), F.substring(body, third + 3, rest)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of :func:`transform`."""
    rows = transform(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, from lists of units."""
    draw = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    held = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
        WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, {draw} FROM given),
        cut AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR {held} OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM parts"""
