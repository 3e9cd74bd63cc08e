"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text is cut into halves, wherever that is, until no part has more than ``LEAF`` characters.
The leaves are encoded in parallel, and neighbours are joined level by level. Around a join,
the text is split anew by the vocabulary's pattern: from the last place in the left side where
a piece must begin (white space after another character) on to a growing part of the right
side, until a piece ends where one of the right side's own pieces ends. From there on the right
side's tokens hold, before the place the left side's do, and only the pieces between are
encoded anew. A piece that is itself cut is joined from its halves' tokens: a window of tokens
around the cut is encoded anew and grows until its first and last token are the ones that the two
sides had there; every adjacent pair of tokens is then one that BPE itself leaves apart. So the
joined sequence is the encoding of the whole text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.tokens import slices
from lodestone.llm.worker import kept

#: Characters of a leaf at most, and characters around a join that are split anew at first.
LEAF, AROUND = 2048, 64
#: Leaves of one text that a task encodes at once.
THREADS = 2

#: The vocabulary's published split pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.ranks = ranks
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        # the pattern's \s is Unicode white space; Python's also holds 0x1C-0x1F
        self.pieces = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str, leaf: int = LEAF, each: Callable = map) -> list[int]:
        """Ids of a whole text; its special tokens' strings are never cut.

        ``each`` maps a function over a text's leaves; a pool's ``map`` does so in parallel.
        """
        if self.parts is None or not any(x in text for x in self.special):
            return self.tree(text, leaf, each)
        out: list[int] = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else self.tree(part, leaf, each)
        return out

    def tree(self, text: str, leaf: int = LEAF, each: Callable = map) -> list[int]:
        """Ids of a text without special tokens: leaves first, then joins, level by level."""
        cuts = [text]
        while any(len(x) > leaf for x in cuts):
            cuts = [y for x in cuts for y in ((x[: len(x) // 2], x[len(x) // 2 :]) if len(x) > 1 else (x,))]
        if len(cuts) == 1:
            return self.core.encode_ordinary(text)
        level = list(zip(cuts, each(self.core.encode_ordinary, cuts), strict=True))
        while len(level) > 1:
            level = [self.join(*level[i], *level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][1]

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> tuple[str, list[int]]:
        """The text and ids of two neighbours with ids ``a`` and ``b``."""
        start, width = self.safe_start(left), AROUND
        tail = left[start:]
        while True:
            head = right[:width]
            whole = len(head) == len(right)
            new_ends = self.ends(tail + head, whole)
            own_ends = [0, *self.ends(head, whole)]
            stop = next((e - len(tail) for e in new_ends if e - len(tail) in own_ends), None)
            if stop is not None:
                break
            width *= 2
        cuts = [0, *(e for e in new_ends if e <= len(tail) + stop)]
        new = [(tail + head)[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        before, after = self.pieces.findall(tail), self.pieces.findall(head[:stop])
        # a side of one piece has its tokens already
        ids_before = [a] if start == 0 and len(before) == 1 else [self.core._encode_single_piece(x) for x in before]
        ids_after = [b] if stop == len(right) and len(after) == 1 else [self.core._encode_single_piece(x) for x in after]
        if len(new) == len(before) == len(after) == 1:
            ids = self.join_piece(ids_before[0], ids_after[0])
        else:
            ids = [t for x in new for t in self.core._encode_single_piece(x)]
        return left + right, a[: len(a) - sum(map(len, ids_before))] + ids + b[sum(map(len, ids_after)) :]

    @staticmethod
    def safe_start(text: str) -> int:
        """The last place where a piece begins whatever follows the text: a space after no white space."""
        at = text.rfind(" ", 1)
        while at > 0 and text[at - 1].isspace():
            at = text.rfind(" ", 1, at)
        return max(0, at)

    def ends(self, text: str, whole: bool) -> list[int]:
        """Where the pieces of a text end; unless it is whole, without those that what follows could change."""
        found = [m.end() for m in self.pieces.finditer(text)]
        return found if whole else [e for e in found if e < len(text) - 1]

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of one piece that is cut into two encoded ones."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            new = self.core._encode_single_piece(self.core.decode_bytes(a + b))
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + new + right[k:]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.core.decode_bytes(ids).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in each Python process."""
    return kept(("bpe", path), lambda: Bpe(path))


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns batches of ids and texts into batches of ``id, ids, decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                for lo, hi, _, _ in slices(texts):
                    ids = [bpe.encode(t or "", each=pool.map) for t in texts.slice(lo, hi - lo).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                        ["id", "ids", "decoded"],
                    )

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` for every document: token ids, and the text they decode to.

    A null text counts as empty and gives no ids and an empty text. Special tokens'
    strings in a text become their ids, and ids decode back to those strings. Rows are
    independent: repeated rows give repeated results, other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_encoder(path), f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what :func:`encode_documents` gives.

    The digests are taken in the process that made the ids, so that neither ids nor texts leave it.
    """
    id_type, encode = docs.schema["doc_id"].dataType.simpleString(), _encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(1 << 17)]
        for batch in encode(batches):
            keys, n, a, b = batch.column(0), [], [], []
            for ids, text in zip(batch.column(1), batch.column(2), strict=True):
                ids = ids.values.to_numpy()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(hashlib.sha256(text.as_buffer()).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
