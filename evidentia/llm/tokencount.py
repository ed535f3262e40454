"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole.  The byte lengths of its tokens give their
spans, the spans are merged with the sections' intervals, and a token that runs
across a boundary goes to one section by a stated rule, so the sections' counts
add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import KEPT, by_size, serve, small_batches, texts_of

#: Where a token across a boundary goes: the section of its first byte, of its last
#: byte, or the one that holds most of its bytes (the earliest of those).
RULES = ("start", "end", "largest")
_SENTENCE = re.compile(rb"[.!?]\s+")
#: Characters of a run of white space from which on the library's pattern, which keeps a state for each, is not asked.
LONG_RUN = 100_000
#: White space as Unicode has it (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How a pattern ends that takes a run of white space, but for the last character before a word, as one piece (fixed values).
_RUNS = r"|\s+(?!\S)|\s+"
Sections = Callable[[bytes], np.ndarray]


def lines(data: bytes) -> np.ndarray:
    """Starts of the sections: a line, with the line ends that follow it."""
    ends = np.frombuffer(data, dtype=np.uint8) == 10
    return np.r_[0, np.flatnonzero(ends[:-1] & ~ends[1:]) + 1] if len(ends) else np.zeros(1, dtype=np.int64)


def lead_and_lines(data: bytes) -> np.ndarray:
    """Like lines(), with the first sentence of a text as a section of its own."""
    starts = lines(data)
    found = _SENTENCE.search(data)
    return np.unique(np.r_[starts, found.end()]) if found and found.end() < len(data) else starts


class Counter:
    """A tiktoken vocabulary with the byte length of each token."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.runs = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}") if pattern.endswith(_RUNS) else None

    def ids(self, text: str) -> np.ndarray:
        """The ids that encode_ordinary() gives, also for runs of white space on which it gives up.

        Such a run is one piece of the pattern, up to its last character where a
        word follows; so it goes to the library as a piece, and what is around it as
        texts of their own.
        """
        found: list[int] = []
        at = 0
        for run in self.runs.finditer(text) if self.runs else ():
            end = run.end() - (run.end() < len(text))
            found += self.library.encode_ordinary(text[at : run.start()])
            found += self.library._encode_single_piece(text[run.start() : end].encode())
            at = end
        return np.array(found + self.library.encode_ordinary(text[at:]), dtype=np.int64)

    def ends(self, text: str) -> np.ndarray:
        """The end of every token in the text's UTF-8 bytes."""
        return np.cumsum(self.sizes[self.ids(text)])


_COUNTERS: dict[str, Counter] = {}
KEPT["tokencount"] = _COUNTERS.clear


def counter(path: str, pattern: str) -> Counter:
    """This process's vocabulary for the file."""
    serve("tokencount")
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, pattern)
    return _COUNTERS[path]


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) per section: how many tokens it gets, and how many of those cross a boundary.

    ends: of the tokens; starts: of the sections, from 0 on, up to `size` bytes.
    """
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    to = {"start": first, "end": last}.get(rule)
    across = np.flatnonzero(first != last)
    if to is None:
        to = first.copy()
        stops = np.r_[starts[1:], size]
        for k in across.tolist():
            own = np.arange(first[k], last[k] + 1)
            to[k] = own[np.argmax(np.minimum(stops[own], ends[k]) - np.maximum(starts[own], begins[k]))]
    n = len(starts)
    return np.bincount(to, minlength=n), np.bincount(to[across], minlength=n)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections: Sections = lead_and_lines, rule: str = "largest") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens): a row per section.

    start and end are in characters, sections count from 0.  A null or empty text
    has one empty section without tokens.  Ids may repeat or be null; other
    columns are ignored.
    """
    assert rule in RULES
    small_batches(docs.sparkSession)
    fields = [(id_col, docs.schema[id_col].dataType), ("section", T.IntegerType()), *((n, T.LongType()) for n in ("start", "end", "n_tokens", "n_crossing", "doc_tokens"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in by_size(batches, "t", 2 << 20):
            made: list[tuple[np.ndarray, ...]] = []
            for k, text in enumerate(texts_of(batch.column(1))):
                data = text.encode()
                ends, starts = own.ends(text), sections(data)
                tokens, crossing = attribute(ends, starts, len(data), rule)
                chars = np.r_[0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)]
                n = len(starts)
                made.append((np.full(n, k), np.arange(n), chars[starts], chars[np.r_[starts[1:], len(data)]], tokens, crossing, np.full(n, len(ends))))
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[2:])], [f[0] for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
