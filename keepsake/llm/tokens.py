"""Exact token ids at the speed of a table: words are encoded once each and joined.

Both tokenizers cut a text into pieces before they merge anything, and no piece reaches across a border
between a non-blank and a blank. So the ids of a text are the ids of its blank-separated words in a row,
and a worker that remembers the ids of words as bytes only encodes new words: a byte-level tokenizer takes all
new words of a text at once, another one word by word, where letters and the signs behind them are pieces of their
own that are remembered too. Texts in which blanks stand together, or which hold a special token's string or
characters that libraries class differently, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Bytes of a generation of a worker's table of words; its table of pieces (byte-level: of signs) has half as many. A full generation
#: becomes the old one, whose entries move to the new one as they are met again.
TABLE = 32 << 20
#: Bytes that an entry takes beside its ids and the characters of its word; the longest word that is remembered.
ENTRY, LONGEST = 180, 64
#: Characters that Python counts as blanks and the tokenizers don't.
ODD = re.compile("[\x1c-\x1f]")
#: What a word of a byte-level text must not hold, if it is to stand between single spaces or line ends.
ODD_BYTES = re.compile("[\\s\x00\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Letters that every library counts as letters, then signs that none counts as letters, digits or contractions.
PARTS = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?*#$%&|()\"-]*)")

#: Signs that none counts as letters, digits or contractions; what a word ends with where such signs are a piece apart.
SIGNS, ENDS = '.,;:!?*#$%&|()"-', frozenset(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _byte_signs() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Odd(Exception):
    pass


class Encoder(dict):
    """Calling it gives a text's ids as little-endian unsigned 32-bit integers, as the library gives them without
    added special tokens. As a dict it maps words to ids. Texts that hold the string of a special token, which the
    library turns into that token, go to the tokenizer whole."""

    def __init__(self, path: str, table: int = TABLE):
        super().__init__()
        self.tokenizer, self.shown = load(path), _byte_signs()
        self.space = self.shown[32]
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.left, self.old = table, {}
        self.parts, self.parts_left, self.old_parts = {}, table // 2, {}
        self.table = table

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one piece, which the tokenizer's model merges."""
        found = self.parts.get(text)
        if found is None:
            found = self.old_parts.get(text)
            if found is None:
                shown = text.replace(" ", self.space) if text.isascii() and text != "\n" else text.encode().decode("latin-1").translate(self.shown)
                found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(text) <= LONGEST:
                self.parts_left -= len(text) + len(found) + ENTRY
                if self.parts_left < 0:
                    self.old_parts, self.parts, self.parts_left = self.parts, {}, self.table // 2
                self.parts[text] = found
        return found

    def word(self, word: str) -> bytes:
        raise NotImplementedError

    def age(self) -> None:
        self.old, self.left = dict(self), self.table
        self.clear()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.word(word)
        if len(word) <= LONGEST:
            self.left -= len(word) + len(found) + ENTRY
            if self.left < 0:
                self.age()
            self[word] = found
        return found

    def joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))

    def by_words(self, text: str) -> bytes:
        raise NotImplementedError

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        for s in self.special:
            if s in text:
                return self.whole(text)
        return self.by_words(text)


@cache
def encoder(kind: type[Encoder], path: str, table: int = TABLE) -> Encoder:
    """The worker's own: its tables outlive a task."""
    return kind(path, table)


class LowerWords(Encoder):
    """For a tokenizer that lower-cases, drops blanks and ends words: each word stands alone."""

    def word(self, word: str) -> bytes:
        m = PARTS.fullmatch(word)
        if not m:
            return self.whole(word)
        return self.piece(m[1].lower()) + (self.piece(m[2]) if m[2] else b"")

    def by_words(self, text: str) -> bytes:
        return self.whole(text) if ODD.search(text) else self.joined(text.split())


class ByteWords(Encoder):
    """For a byte-level tokenizer whose pieces may begin with one space.

    Words are kept as they follow a space, with a line end before them as they follow that, and with a
    null before them as they begin a text. A new word that is empty or holds a blank shows that blanks stand
    together or that there are others than spaces and line ends: then the text goes to the tokenizer whole, as
    does one that holds a null. A text's new words are encoded in one call: a token that begins with a space or
    a line end begins a word, and no other does.
    """

    def __init__(self, path: str, table: int = TABLE):
        super().__init__(path, table)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith((self.space, self.shown[10]))]] = True

    def new(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that the newer generation lacks, in a text's order. All are remembered, and what they
        are without signs behind."""
        found = {w: self.old.get(w) for w in words}
        parted, lost = {}, {}
        for w, ids in found.items():
            if ids is None:
                stem = w.rstrip(SIGNS)
                if len(stem) < len(w) and stem[-1:] in ENDS:
                    parted[w] = stem
                    if stem not in self and stem not in self.old:
                        lost[stem] = None
                else:
                    lost[w] = None
        if lost:
            found.update(self.at_once(list(lost)))
        for w, stem in parted.items():
            found[w] = (found.get(stem) or self.get(stem) or self.old[stem]) + self.piece(w[len(stem) :])
        for w, ids in found.items():
            if len(w) <= LONGEST:
                self.left -= len(w) + len(ids) + ENTRY
                if self.left < 0:
                    self.age()
                self[w] = ids
        return found

    def at_once(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The words with their ids, from one call of the library."""
        bare = [w[1:] if w[:1] in ("\0", "\n") else w for w in words]
        if "" in bare or ODD_BYTES.search("".join(bare)):
            raise _Odd
        text = "".join([w[1:] if w[0] == "\0" else w if w[0] == "\n" else " " + w for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        first = self.leads[ids]
        first[0] = True
        at = np.flatnonzero(first)
        if len(at) != len(words) or any(s in text for s in self.special):
            raise _Odd
        data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        return zip(words, [data[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True)

    def by_words(self, text: str) -> bytes:
        if "\0" in text:
            return self.whole(text)
        words = ("\0" + text.replace("\n", " \n")).split(" ")
        found = list(map(self.get, words))
        lost = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not lost:
            return b"".join(found)
        try:
            new = self.new(lost)
        except _Odd:
            return self.whole(text)
        return b"".join([new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)])
