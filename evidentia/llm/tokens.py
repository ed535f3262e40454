"""Token ids by the tokenizers library, with a bounded cache of words.

Where a tokenizer drops white space, its ids of a text are those of the text's
words one after the other.  Words seen before come from the cache.  A new word is
cut by the tokenizer's own pattern and its parts go to the library's BPE model
directly; texts beyond Latin-1, and tokenizers of another build, go through the
whole library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from evidentia.llm.common import KEPT, serve

#: What str.split() takes for white space besides space, tab and line ends, and what tokenizers may see otherwise.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Latin-1 without white space.
_LATIN = [c for c in map(chr, range(0x100)) if not c.isspace()]
#: Words kept in each of the two generations of a worker's cache.
MAX_WORDS = 400_000
#: Characters from which on a word is not kept.
LONG_WORD = 256
#: Words that go to the library in one call.
TOGETHER = 512


class Words(dict):
    """Ids of words as bytes, in two generations: what was asked for since the last turn stays."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def keep(self, word: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) < LONG_WORD:
            self.keep(word, ids)
        return ids


class Encoder:
    """Ids of texts exactly as `encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str, most: int = MAX_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        normal, ids = self.library.normalizer, lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.by_word = normal is not None and all(ids(f"a{c}b.{c}{c}ç") == ids("a") + ids("b.") + ids("ç") and not ids(c) for c in " \t\n\r")
        self.lowers = self.by_word and all(normal.normalize_str(c) == c.lower() for c in _LATIN)
        self.parts, self.alphabet = self._pattern()
        self.model = self.library.model
        # words of texts that Latin-1 holds, lowered, and words as they stand in any other text
        self.plain, self.other = Words(self._by_model, most), Words(self._by_library, most)

    def _pattern(self) -> tuple[regex.Pattern | None, dict[int, str]]:
        """The pattern whose matches are the model's words, and the byte-level names of Latin-1's characters; no pattern if the tokenizer is built otherwise."""
        built = json.loads(self.library.to_str())
        cutters = (built.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [c["type"] for c in cutters]
        if not self.lowers or built["model"]["type"] != "BPE" or built["model"].get("dropout") or kinds != ["Split", "ByteLevel"]:
            return None, {}
        cut, level = cutters
        if (cut["behavior"], cut["invert"], level["use_regex"], level["add_prefix_space"]) != ("Removed", True, False, False) or "Regex" not in cut["pattern"]:
            return None, {}
        from tokenizers.pre_tokenizers import ByteLevel

        names = ByteLevel(add_prefix_space=False, use_regex=False)
        return regex.compile(cut["pattern"]["Regex"]), {ord(c): names.pre_tokenize_str(c)[0][0] for c in _LATIN}

    def _by_library(self, word: str) -> bytes:
        return np.array(self.library.encode_batch_fast([word], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _by_model(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin-1."""
        if self.parts is None or len(word) >= LONG_WORD:
            return self._by_library(word)
        parts = self.parts.findall(word)
        if len(parts) == 1 and parts[0] == word:
            return array(self.dtype.char, [t.id for t in self.model.tokenize(word.translate(self.alphabet))]).tobytes()
        return b"".join([self.plain[p] for p in parts])

    def _latin(self, text: str) -> bool:
        if not self.lowers or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _learn(self, words: set[str]) -> None:
        """Bring words to the cache of other words, many at a time."""
        missing = [w for w in words if w not in self.other and w not in self.other.older and len(w) < LONG_WORD]
        for at in range(0, len(missing), TOGETHER):
            group = missing[at : at + TOGETHER]
            for w, made in zip(group, self.library.encode_batch_fast(group, add_special_tokens=False), strict=True):
                self.other.keep(w, np.array(made.ids, dtype=self.dtype).tobytes())

    def ids(self, text: str) -> bytes:
        """The ids of a text as bytes of dtype."""
        if not self.by_word or _ODD.search(text):
            return self._by_library(text)
        if self._latin(text):
            return b"".join(map(self.plain.__getitem__, text.lower().split()))
        words = text.split()
        for at in range(0, len(words), self.other.most):
            self._learn(set(words[at : at + self.other.most]))
        return b"".join(map(self.other.__getitem__, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.ids(t), dtype=self.dtype) for t in texts]


_ENCODERS: dict[tuple[str, int], Encoder] = {}
KEPT["tokens"] = _ENCODERS.clear


def encoder(path: str, most: int = MAX_WORDS) -> Encoder:
    """This process's encoder for the file, which keeps up to `most` words in each generation."""
    serve("tokens")
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
