"""Token ids of public tokenizers, equal to the library's, at the cost of one lookup per word.

A tokenizer file first cuts a text into words and then encodes every word by itself. Both families used here always cut
before a single blank between two other characters, around a single line end between two, and between a letter and a
full stop or comma, so the ids of a text are those of the parts between such places. `WordEncoder` encodes each new part once with the library and keeps the ids of
parts it has seen. Texts with characters outside a plain set, with white space in a row, or with what may be a special
token go to the library as they are; long ones of them are cut at safe boundaries first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Letters of the plain set: ASCII and the composed letters of Latin-1 and Latin Extended-A (without dotted capital I).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
# Texts are told apart on their UTF-8 bytes: those of the plain set are ASCII or start with C3, C4 or C5, where the four
# characters that are no such letters (multiplication and division sign, dotted I, long s) are looked for.
_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_NO_LETTERS = ("\u00d7".encode(), "\u00f7".encode(), "\u0130".encode(), "\u017f".encode())
# A blank between two ASCII letters starts a word in both families, and no special token holds one.
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_ONE_WORD = re.compile(rf" ?[{_LETTERS}]+")
#: Letters as `a`, full stops and commas as `.`, all else as `-`, byte by byte, for plain texts.
_CLASSES = bytes(46 if chr(b) in ".," else 97 if chr(b).isalpha() or b >= 128 else 45 for b in range(256))
# Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order
# (a blank is U+0120).
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = dict(zip((b for b in range(256) if b not in _SELF), range(256, 512), strict=False))
_BLANKS = ("", " ", "\n")
_RUNS = ("  ", " \n", "\n ", "\n\n")
LONG_TEXT = 1 << 16
#: Parts that a task keeps, at some 230 bytes each. Frequent ones are soon back when the table starts anew.
KNOWN_WORDS = 1_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """The text in pieces of about `size` characters whose encodings joined are the encoding of the text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class _Known(dict):
    """The number of each part; parts seen for the first time are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = at = len(self)
        self.new.append(part)
        return at


class WordEncoder:
    """Ids and counts of texts by one tokenizer file; one instance serves one task at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.lower = self.library.normalizer is not None  # the family that lower-cases and drops white space
        self._forget()

    def _forget(self) -> None:
        """Start the word table anew, so that its memory stays bounded."""
        self.known, self.learned = _Known(), 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.n_ids = 0

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts numbered since the last call. A part that is one word goes to the library's model directly."""
        for i in range(0, len(parts), 1024):
            some = parts[i : i + 1024]
            found: list[int] = []
            ends = np.zeros(len(some), np.int64)
            for j, part in enumerate(some):
                if _ONE_WORD.fullmatch(part):
                    plain = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
                    plain = plain.replace(" ", "\u0120")
                    found += [token.id for token in self.model.tokenize(plain)]
                else:
                    found += self.library.encode(part, add_special_tokens=False).ids
                ends[j] = len(found)
            ids, counts = np.array(found, np.uint32), np.diff(ends, prepend=0)
            at, stop = self.learned, self.learned + len(some)
            while stop > len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.starts[at:stop], self.counts[at:stop] = self.n_ids + ends - counts, counts
            self.n_ids += len(ids)
            self.learned = stop

    def _plain(self, text: str) -> bool:
        data = text.encode()
        if b"<|" in data or data.translate(None, _PLAIN_BYTES):
            return False
        if not text.isascii() and any(c in data for c in _NO_LETTERS):
            return False
        return self.lower or not (
            any(pair in text for pair in _RUNS) or text[:1] in _BLANKS or text[-1:] in _BLANKS or "\t" in text or "\r" in text
        )

    def _parts(self, text: str) -> list[str]:
        kinds = text.encode().translate(_CLASSES)
        if not (kinds[:1] == b"." or b"-." in kinds or b".." in kinds):  # then both marks follow a letter and start a word
            text = text.replace(",", " ,").replace(".", " .") if self.lower else text.replace(",", "\0,").replace(".", "\0.")
        if self.lower:
            return text.lower().split()
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of plain texts, and how many each text has."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._parts(text)
            sizes[i] = len(own)
            words += own
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        return at, sizes

    def _by_library(self, text: str) -> np.ndarray:
        parts = self.library.encode_batch_fast(list(safe_pieces(text)), add_special_tokens=False)
        return np.concatenate([np.array(p.ids, np.uint32) for p in parts])

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        at, sizes = self._words([texts[i] for i in plain])
        out[plain] = _sums(self.counts[at], sizes)
        for i in set(range(len(texts))).difference(plain):
            out[i] = len(self._by_library(texts[i]))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and the number of ids of each text."""
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        at, sizes = self._words([texts[i] for i in plain])
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(counts.sum())]
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain] = own = _sums(counts, sizes)
        if len(plain) == len(texts):
            return ids, lengths
        parts: list[np.ndarray] = [ids[:0]] * len(texts)
        for i, part in zip(plain, np.split(ids, np.cumsum(own)[:-1]), strict=False):
            parts[i] = part
        for i in set(range(len(texts))).difference(plain):
            parts[i] = self._by_library(texts[i])
            lengths[i] = len(parts[i])
        return np.concatenate(parts), lengths


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    totals = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return totals[ends] - totals[ends - sizes]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    return WordEncoder(path)
