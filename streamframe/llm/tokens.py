"""Token ids of whole texts, through a per-worker cache of space-separated chunks.

The vocabularies used here drop white space and never join across it, so a text's
ids are its chunks' ids in a row. Unseen chunks are encoded many at a time with a
separator between them whose single id marks where each chunk ends.
"""

from __future__ import annotations

import os
import sys
import types
from struct import pack
from unicodedata import is_normalized

import numpy as np

_SEPARATOR = "\x01"
_ROUND = 256
#: Punctuation that is looked for behind letters.
_TRAILING = b".,!?;:*$%&#|"


def _letters(core: bytes) -> str:
    """The lower-cased word that a chunk of letters is, or an empty string where it may be more than that."""
    if core.isalpha():  # of bytes: ASCII letters, in lower case by now or not
        return core.decode().lower()
    if not core or core.isascii():
        return ""
    word = core.decode("utf-8", "surrogatepass")
    lower = word.lower()
    # a lower case that depends on the word's end, or is longer, is left to the tokenizer itself
    plain = lower.isalpha() and len(lower) == len(word) and "\u03c2" not in lower and "\u03c3" not in lower
    return lower if plain and is_normalized("NFC", word) and is_normalized("NFC", lower) else ""


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + n) for n in range(256))
    return [chr(b) if b in printable else next(rest) for b in range(256)]


class ChunkTokenizer:
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.cache, self.older = Tokenizer.from_file(path), cached, {}, {}
        mark = self._plain(_SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 else None
        self.lower = self._plain("The ABC") == self._plain("the abc")
        self._word = self._direct()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[bytes]) -> None:
        """Put the ids of unseen chunks into the cache. Letters and the punctuation after them are
        tokens of their own in any case, so such a chunk's ids are those of its two parts; and a
        word of letters goes to the vocabulary's model itself, past all splitting."""
        if len(self.cache) + len(chunks) > self.cached:
            self.older, self.cache = self.cache, {}
        known, older, word = self.cache, self.older, self._word
        other: list[bytes] = []
        for c in chunks:
            ids = older.get(c)
            if ids is None:
                core = c.rstrip(_TRAILING)
                letters = word and _letters(core)
                if not letters:
                    other.append(c)
                    continue
                ids = known.get(core) or older.get(core)
                if ids is None:
                    ids = known[core] = word(letters)
                if len(core) < len(c):
                    tail = c[len(core) :]
                    if tail not in known:
                        self._encode_chunks([tail])
                    ids += known[tail]
            known[c] = ids
        self._encode_chunks(other)

    def _direct(self):
        """The ids of a lower-case word of letters by the model alone, if it is proven to give what the tokenizer gives."""
        model, table = self.tokenizer.model, _byte_letters()

        def word(letters: str) -> bytes:
            s = letters if letters.isascii() else "".join(map(table.__getitem__, letters.encode()))
            ids = [t.id for t in model.tokenize(s)]
            return pack(f"<{len(ids)}I", *ids)

        proof = ("a", "the", "token", "\u00e9t\u00e9", "\u00fc\u00dfig", "\u4e2d\u6587", "ni\u00f1o", "zzyzx")
        same = all(word(w) == np.array(self._plain(w), "<u4").tobytes() for w in proof)
        return word if same and self.lower and self._plain("ab,") == self._plain("ab") + self._plain(",") else None

    def _encode_chunks(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), _ROUND):
            part = chunks[at : at + _ROUND]
            words = [c.decode("utf-8", "surrogatepass") for c in part]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if self.mark is None or len(ends) != len(part) - 1:
                found = [np.array(self._plain(w), "<u4").tobytes() for w in words]
            else:
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                found = [data[s:e] for s, e in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]
            self.cache.update(zip(part, found))

    def encode(self, text: str | bytes | None) -> bytes:
        if not text:
            return b""
        text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        # the vocabulary is lower case; special tokens' strings are not to come about
        chunks = text.split() if b"<|" in text or not self.lower else text.lower().split()
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            pass
        if len(chunks) > self.cached:  # one text fills the cache
            return np.array(self._plain(text.decode("utf-8", "surrogatepass")), "<u4").tobytes()
        self._learn([c for c in dict.fromkeys(chunks) if c not in self.cache])
        # a change of generations empties the cache: what it held of this text is learned again
        missing = [c for c in dict.fromkeys(chunks) if c not in self.cache]
        if missing:
            self._learn(missing)
        return b"".join(map(self.cache.__getitem__, chunks))


def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker and vocabulary, kept between tasks."""
    kept = sys.modules.setdefault("_streamframe_worker", types.ModuleType("_streamframe_worker"))
    made = kept.__dict__.setdefault("tokenizers", {})
    if path not in made:
        made[path] = ChunkTokenizer(path)
    return made[path]
