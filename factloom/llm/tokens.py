"""Cached whole-text encoding with public tokenizer files; one encoder per Python worker and file."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

#: Words and runs of letters held by an encoder's caches; later ones are encoded anew. Bounds a worker's memory, changes no result.
CACHE_WORDS = 500_000

#: Words of letters that composition leaves alone, in UTF-8 (A-Z, a-z and the letters of U+00C0..U+00FF), and ASCII
#: punctuation after them: two pieces of the pre-tokenizer.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


def as_ids(ids: list[int], width: int = 4) -> bytes:
    """Little-endian numbers of `width` bytes (2 or 4)."""
    return struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet as a str.translate table: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """Ids by word: a word not held is made once by `make`. Look-ups stay in C, so texts need one pass."""

    def __init__(self, make: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.make(word)
        return ids

    def trim(self, most: int) -> None:
        """Forget the words that came last, beyond `most`."""
        for word in list(islice(reversed(self), max(0, len(self) - most))):
            del self[word]


class WordEncoder:
    """Ids of a tokenizers file whose pre-tokenizer drops white space, so words at ASCII white space are independent."""

    def __init__(self, path: str, narrow: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.width = 2 if narrow and self.size <= 1 << 16 else 4
        self.known, self.letters, self.rest = Cache(self._word), Cache(self._letters), Cache(self._whole)
        self.alphabet = byte_letters()
        spec = json.loads(self.library.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        #: Plain words go to the model directly only under the rules that this relies on.
        self.direct = steps == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE" and "[\\p{L}]+" in str(spec["pre_tokenizer"]).replace("\\\\", "\\")

    def _whole(self, piece: bytes) -> bytes:
        return as_ids(self.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids, self.width)

    def _letters(self, word: bytes) -> bytes:
        return as_ids([t.id for t in self.library.model.tokenize(word.decode("latin-1").translate(self.alphabet))], self.width)

    def _word(self, word: bytes) -> bytes:
        """Ids of one word. Plain words are joined from the ids of their letters and their punctuation."""
        plain = _PLAIN.fullmatch(word) if self.direct else None
        if plain is None:
            return self._whole(word)
        head, tail = plain.groups()
        ids = self.letters[head.lower() if head.isascii() else head.decode("utf-8").lower().encode("utf-8")]
        return ids + self.rest[tail] if tail else ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, as bytes: of 32 bits, or of 16 in a narrow encoder whose vocabulary allows it."""
        find = self.known.__getitem__
        out = [b"".join(map(find, t.split())) for t in texts]
        for held in (self.known, self.letters, self.rest):
            held.trim(CACHE_WORDS)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, narrow: bool = False) -> WordEncoder:
    return WordEncoder(path, narrow)


def grouped(texts: list[bytes], most: int = 8_000_000):
    """Index ranges of consecutive texts of at most about `most` bytes, so that a batch's ids fit in memory."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
