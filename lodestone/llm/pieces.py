"""SentencePiece encoding and decoding of whole texts with offsets into the original bytes.

A text is normalised by the model's compiled character map: at each place the longest prefix that
the map holds is replaced, any other character stays, spaces become a visible letter, and for
every byte of the result the byte of the original that it comes from is recorded. The map is a
double array, read as it is; it is only walked at characters that some entry begins with, and the
runs between stay as they are.

Normalised text is merged by the library, in windows that begin with the space letter after another
letter: no piece of the vocabulary has a space letter behind another letter, so no merge
crosses that place (vocabularies that have such a piece get the whole text as one window). The
pieces' lengths, summed up, are places in the normalised text, and the record gives each piece
its span of the original's bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.tokens import slices
from lodestone.llm.worker import kept

#: The letter that stands for a space (fixed value).
SPACE = "▁"
#: Characters of a window; it goes on to the end of its last word.
WINDOW = 1 << 16
#: Types of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled map from prefixes to replacements: a double array and a pool of strings."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.pool = compiled[4 + size :]
        self.heads = {b for b in range(256) if self.units and self._child(self._offset(self.units[0]), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (8 if unit & 0x200 else 0)

    def _child(self, at: int, byte: int) -> int | None:
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest entry that ``text`` has at ``at``, and its replacement."""
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            child = self._child(node, text[i])
            if child is None:
                break
            unit = self.units[child]
            node = child ^ self._offset(unit)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


class Pieces:
    """A SentencePiece model read from its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        defined = sorted((p.piece.encode() for p in spec.pieces if p.type == DEFINED), key=len, reverse=True)
        # where the plain runs between candidates end
        heads = b"".join(re.escape(bytes([b])) for b in sorted(self.map.heads))
        self.defined = re.compile(b"|".join(map(re.escape, defined))) if defined else None
        some = ([b"|".join(map(re.escape, defined))] if defined else []) + ([b"[" + heads + b"]"] if heads else []) + ([b" "] if self.squeeze else [])
        self.stops = re.compile(b"|".join(some)) if some else None
        crossing = self.suffix or any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces if p.type in (NORMAL, DEFINED, UNUSED))
        self.cuts = None if crossing or not self.escape else re.compile(f"(?<!{SPACE}){SPACE}")
        #: Bytes of normalised text that ids stand for; -1 - x for the id of the byte x, less for ids that only a text tells.
        self.lengths = np.array([-1 - int(p.piece[3:5], 16) if p.type == BYTE else len(p.piece.encode()) if p.type in (NORMAL, DEFINED, UNUSED) else -1000 for p in spec.pieces])
        #: Bytes that ids decode to; none for ids whose text the library must tell.
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, DEFINED, UNUSED) else None for p in spec.pieces]
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the merges alone: what they get is normalised already
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces = b"", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of ``text`` it comes from."""
        raw = text.encode()
        parts, begins, starts = self.replaced(raw)
        first, last = 0, len(raw)
        if self.squeeze:
            parts, begins, first, last = self.squeezed(parts, begins, starts, last)
        if not parts and not (self.prefix and self.suffix and first < len(raw)):
            return "", np.array([last])
        if self.prefix:
            at = len(parts) if self.suffix else 0
            parts.insert(at, b" ")
            begins.insert(at, np.array([last if self.suffix else first]))
        joined, source = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(begins)
        mark = SPACE.encode() if self.escape else b" "
        if mark != b" ":
            source = np.repeat(source, np.where(joined == 32, len(mark), 1))
        return joined.tobytes().replace(b" ", mark).decode(), np.append(source, last)

    def replaced(self, raw: bytes) -> tuple[list[bytes], list[np.ndarray], list[int]]:
        """Parts of the text after replacement, with the source of each of their bytes and of each part."""
        if self.stops is None:
            return ([raw], [np.arange(len(raw))], [0]) if raw else ([], [], [])
        parts, begins, starts, at = [], [], [], 0

        def plain(end: int) -> None:
            if end > at:
                parts.append(raw[at:end])
                begins.append(np.arange(at, end))
                starts.append(at)

        while (m := self.stops.search(raw, at)) is not None:
            i = m.start()
            own = self.defined.match(raw, i) if self.defined else None
            got = (own.end() - i, own.group()) if own else self.map.longest(raw, i) if raw[i] in self.map.heads else None
            if got is None:  # the character itself: its first byte and what continues it
                end = i + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                got = end - i, raw[i:end]
            plain(i)
            parts.append(got[1])
            begins.append(np.full(len(got[1]), i))
            starts.append(i)
            at = i + got[0]
        plain(len(raw))
        return parts, begins, starts

    @staticmethod
    def squeezed(parts: list[bytes], begins: list[np.ndarray], starts: list[int], end: int) -> tuple[list[bytes], list[np.ndarray], int, int]:
        """Parts without spaces at both ends and behind others, and where what is left begins and ends in the source."""
        first = next((at for part, at in zip(parts, starts, strict=True) if part != b" "), end)
        kept, sources, spaced = [], [], True
        for part, source in zip(parts, begins, strict=True):
            n = len(part) - len(part.lstrip(b" ")) if spaced else 0
            if part[n:]:
                spaced = part.endswith(b" ")
                kept.append(part[n:])
                sources.append(source[n:])
        while kept and kept[-1].endswith(b" "):
            bare = kept[-1].rstrip(b" ")
            end, sources[-1], kept[-1] = int(sources[-1][len(bare)]), sources[-1][: len(bare)], bare
            if not bare:
                kept.pop()
                sources.pop()
        return kept, sources, first, end

    def windows(self, normal: str) -> Iterator[str]:
        """The normalised text in parts that no piece crosses."""
        at = 0
        while at < len(normal):
            cut = self.cuts.search(normal, at + WINDOW) if self.cuts else None
            end = cut.start() if cut else len(normal)
            yield normal[at:end]
            at = end

    def merged(self, window: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a window's pieces and their lengths in bytes."""
        ids = self.merges.encode(window, return_type="numpy")
        n = self.lengths[ids]
        if n.min(initial=0) >= 0:
            return ids, n
        if n.min() < -256:
            return ids, np.array([len(p.surface.encode()) for p in self.merges.encode(window, return_type="proto").pieces])
        # the last of the bytes of a character has its length
        byte = np.where(n < 0, -1 - n, 0x80)
        first = np.flatnonzero((byte & 0xC0) != 0x80)
        long = 1 + (byte[first] >= 0xC0) + (byte[first] >= 0xE0) + (byte[first] >= 0xF0)
        n = np.maximum(n, 0)
        n[first + long - 1] = long
        return ids, n

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and where each piece begins and ends in the text's bytes."""
        normal, source = self.normalise(text)
        got = [self.merged(x) for x in self.windows(normal)]
        if not got:
            return (np.zeros(0, np.int32),) * 3
        ids, n = (np.concatenate(x) for x in zip(*got, strict=True))
        ends = np.cumsum(n)
        return ids, source[ends - n], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes it."""
        ids = ids.tolist()
        parts = [self.bytes[i] for i in ids]
        if None in parts or not self.escape or not self.prefix or self.squeeze or self.suffix:
            return self.whole.decode(ids)
        raw = b"".join(parts)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.whole.decode(ids)
        return text[1:] if parts and parts[0][:1] == b" " else text


def load(path: str) -> Pieces:
    """The model at ``path``, read once in each Python process."""

    def read() -> Pieces:
        with open(path, "rb") as f:
            return Pieces(f.read())

    return kept(("pieces", path), read)


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns batches of ids and texts into batches of ``id, ids, begins, ends, decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1)):
                got = [model.encode(t or "") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                at = pa.array(np.cumsum([0] + [len(x[0]) for x in got]), pa.int32())
                flat = [np.concatenate([x[k] for x in got]).astype(np.int32) for k in range(3)]
                text = pa.array([model.decode(x[0]) for x in got], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in flat), text], ["id", "ids", "begins", "ends", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, begins, ends, decoded)`` for every document: ids of pieces without begin and end
    ids, the span of each in the text's UTF-8 bytes, and the text that the ids decode to.

    Of the ids that stand for the bytes of one unknown character the last has its span. A null text counts as empty
    and gives no ids. Rows are independent: repeated rows give repeated results, other columns are
    not read, and an empty table gives an empty result. ``path`` is read by every Python worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_encoder(path), f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spanned`` of what :func:`encode_documents` gives.

    ``spanned`` is the sum of the spans' lengths, which is the number of bytes of the text. Digests
    are taken in the process that made the ids.
    """
    kind, encode = docs.schema["doc_id"].dataType.simpleString(), _encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(1 << 16)]
        for batch in encode(batches):
            out: list[tuple] = []
            for ids, begins, ends, text in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                own = ids.values.to_numpy().tolist()
                digest = hashlib.sha256(",".join([names[i] if i < len(names) else str(i) for i in own]).encode()).hexdigest()
                out.append((len(own), digest, hashlib.sha256(text.as_buffer()).hexdigest(), int(ends.values.to_numpy().sum(dtype=np.int64) - begins.values.to_numpy().sum(dtype=np.int64))))
            n, a, b, c = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned long")
