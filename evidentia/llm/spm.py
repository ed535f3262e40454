"""SentencePiece encoding with byte offsets, and decoding.

Ids come from the sentencepiece library.  Offsets come from the model's own
normaliser, applied here: the longest prefix found in the compiled character map
is replaced, and every normalised byte remembers the source byte it came from, so
that each piece projects to a span of the original text.  A model without a map
changes nothing but spaces: there the spans are a running sum of piece lengths.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import KEPT, by_size, serve, small_batches, texts_of

SPACE = "▁"
#: Words kept in each of the two generations of a worker's cache, and characters from which on a word is not kept.
MAX_WORDS, LONG_WORD = 300_000, 256


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 and the strings it leads to."""

    def __init__(self, data: bytes) -> None:
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, dtype="<u4", count=size // 4, offset=4).tolist() if data else []
        self.pool = data[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest prefix of data[at:] in the map."""
        if not self.units:
            return None
        jump = lambda unit: unit >> 10 << ((unit & 512) >> 6)
        node, found = jump(self.units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[k]:
                break
            unit = self.units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.pool[found[0] : self.pool.index(b"\0", found[0])], found[1]


class Normaliser:
    """The normaliser of a model, with alignment."""

    def __init__(self, spec: object) -> None:
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def plain(self) -> bool:
        """Only a prefix is added and spaces are escaped."""
        return not self.map.units and self.prefix and not self.trim and self.escape

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, source): source[i] is where normalised byte i came from; one more entry holds the end."""
        space = SPACE.encode() if self.escape else b" "
        out, source = bytearray(), []

        def put(part: bytes, at: int) -> None:
            out.extend(part)
            source.extend([at] * len(part))

        at, steps = 0, []
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                width = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
                found = data[at : at + width], width
            steps.append((found[0], at, at + found[1]))
            at += found[1]
        if self.trim:
            while steps and not steps[0][0].strip(b" "):
                steps.pop(0)
            while steps and not steps[-1][0].strip(b" "):
                steps.pop()
        if steps and self.prefix:
            put(space, steps[0][1])
        end, after_space = steps[0][1] if steps else 0, bool(self.trim)
        for part, start, stop in steps:
            for k in range(len(part)):
                c = part[k : k + 1]
                if c != b" ":
                    put(c, start)
                elif not (self.trim and after_space):
                    put(space, start)
                after_space = c == b" "
            end = stop
        return bytes(out), np.array([*source, end], dtype=np.int64)


class Pieces:
    """A model: ids, spans and texts."""

    def __init__(self, path: str, most: int = MAX_WORDS) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalise = Normaliser(proto.normalizer_spec)
        kinds = proto.SentencePiece
        self.end = self.library.eos_id()
        self.ints = list(range(len(proto.pieces)))
        self.decimals = [str(i) for i in self.ints]
        is_byte = [p.type == kinds.BYTE for p in proto.pieces]
        self.piece_bytes = np.array([1 if b else len(p.piece.encode()) for p, b in zip(proto.pieces, is_byte, strict=True)], dtype=np.int64)
        self.source_bytes = np.array([1 if b else len(p.piece.replace(SPACE, " ").encode()) for p, b in zip(proto.pieces, is_byte, strict=True)], dtype=np.int64)
        self.source_bytes[[self.end, self.library.bos_id()]] = self.piece_bytes[[self.end, self.library.bos_id()]] = 0
        # no piece runs from other characters into a space, so nothing merges across the start of a word
        self.by_word = self.normalise.plain and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback
        self.by_word = self.by_word and not any(p.type == kinds.USER_DEFINED or re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces)
        self.most = most
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _units(self, text: str) -> list[str] | None:
        """Parts that are encoded one by one, each without its leading space; None if the text must be encoded whole."""
        if not self.by_word or SPACE in text or not text:
            return None
        return text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [x[1:] for x in re.findall(" +[^ ]*", f" {text}")]

    def _known(self, needed: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of units; those of under LONG_WORD characters are kept, in two generations of `most` each."""
        found = {u: self.cache[u] for u in needed & self.cache.keys()}
        again = {u: self.older[u] for u in (needed - found.keys()) & self.older.keys()}
        order, same = list(needed - found.keys() - again.keys()), self.ints.__getitem__
        for unit, ids in zip(order, self.library.encode(order, num_threads=1) if order else (), strict=True):
            # an empty unit is one space
            again[unit] = tuple(map(same, ids)) if unit else (self.library.piece_to_id(SPACE),)
        for unit, ids in again.items():
            if len(unit) < LONG_WORD:
                if len(self.cache) >= self.most:
                    self.cache, self.older = {}, self.cache
                self.cache[unit] = ids
        return found | again

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text as the library's encode() gives them, and the end id."""
        split = [self._units(t) for t in texts]
        found = self._known(set().union(*(u for u in split if u))).__getitem__
        whole = iter(self.library.encode([t for t, u in zip(texts, split, strict=True) if u is None], num_threads=1))
        return [[*(next(whole) if u is None else chain.from_iterable(map(found, u))), self.end] for u in split]

    def ends(self, text: str, ids: list[int]) -> np.ndarray:
        """End of every piece's span in the UTF-8 bytes of the text; a span starts where the one before it ends."""
        if self.by_word and SPACE not in text:
            ends = np.cumsum(self.source_bytes[ids])
            return ends - 1 if text else ends  # the prefix has no source
        normal, source = self.normalise(text.encode())
        sizes = self.piece_bytes[ids]
        ends = np.cumsum(sizes)
        if ends[-1] != len(normal):  # unknown pieces have the size of what they stand for
            unknown = np.flatnonzero(np.array(ids) == self.library.unk_id())
            surfaces = self.library.encode(text, return_type="proto").pieces
            for k in unknown:
                sizes[k] = len(surfaces[int(k)].piece.encode())
            ends = np.cumsum(sizes)
        return source[np.minimum(ends, len(normal))]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_MODELS: dict[str, Pieces] = {}
KEPT["spm"] = _MODELS.clear


def model(path: str) -> Pieces:
    """This process's model for the file."""
    serve("spm")
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): ids with the end id, and the byte span of each in the text.

    A null text is an empty one and has the end id alone; the end id's span is
    empty and at the text's end.  Ids may repeat or be null.
    """
    small_batches(docs.sparkSession)
    fields = [(id_col, docs.schema[id_col].dataType), ("ids", T.ArrayType(T.IntegerType())), ("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = model(path), pa.list_(pa.int32())
        for batch in by_size(batches, "t", 2 << 20):
            texts = texts_of(batch.column(1))
            ids = own.encode(texts)
            ends = [own.ends(t, x) for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array([np.r_[0, e[:-1]] for e in ends], kind), pa.array(ends, kind)], [f[0] for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): the library's decode() of column ids; a null array gives a null text."""
    fields = [(id_col, encoded.schema[id_col].dataType), ("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [f[0] for f in fields])

    return encoded.select(id_col, "ids").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) per row of docs.

    encode() and decode() in one pass, so that no id crosses to the JVM.
    spans_crc32 is that of the span ends as little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    fields = [(id_col, docs.schema[id_col].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("spans_crc32", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in by_size(batches, "t", 2 << 20):
            texts, rows = texts_of(batch.column(1)), []
            for text, ids in zip(texts, own.encode(texts), strict=True):
                decimal = " ".join(map(own.decimals.__getitem__, ids))
                decoded = own.decode(ids)
                rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(own.ends(text, ids).astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], [f[0] for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
