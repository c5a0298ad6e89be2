"""Token ids by the tokenizers library, each distinct word encoded once where it can be remembered.

Both vocabularies cut a text before a single space between printable characters, whatever stands around it, so the ids of a
text are those of its words in a row; the byte-level one also cuts before a line feed between such characters, and both
before a mark after a letter. A word whose ends could merge with white space beside it has no code of its own: the whole text
then goes through the library. What is remembered is bounded by twice ``limit`` words a worker, in flat arrays.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import row_chunks

END = b"\0\0\0\0"  # id 0 closes a document


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def solid(c: str) -> bool:
    """A character that is white space in no version of Unicode."""
    return c.isalnum() or "!" <= c <= "~"


def letter(c: str) -> bool:
    """A Latin letter; after one, punctuation always begins a token of its own."""
    return "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u024f" and c.isalpha() and len(c.lower()) == 1


class CodeTable:
    """Codes of words in flat arrays: the 128-bit hash of a word, and where its ids begin and how many there are (-1: it has none
    of its own). About 35 bytes a word."""

    RECENT = 100_000  # words that are merged into the rest together

    def __init__(self):
        self.parts = [self.empty(), self.empty()]  # the rest and the recent ones, each sorted by hash
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0

    @staticmethod
    def empty() -> tuple[np.ndarray, ...]:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are known, the places of their ids and their numbers."""
        known, start, size = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        for keys, checks, starts, sizes in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                here = (keys[at] == key) & (checks[at] == check)
                known |= here
                start[here], size[here] = starts[at[here]], sizes[at[here]]
        return known, start, size

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New words with their ids in a row; returns where each begins."""
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.empty(max(need, len(self.ids)), "<u4")])
        self.ids[self.used:need] = ids
        real = np.maximum(size, 0)
        start = self.used + np.cumsum(real) - real
        self.used = need
        self.parts[1] = self.merged(self.parts[1], (key, check, start, size.astype(np.int32)))
        if len(self.parts[1][0]) > self.RECENT:
            self.parts = [self.merged(*self.parts), self.empty()]
        return start

    @staticmethod
    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


def digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def taken(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` one after another."""
    ends = np.cumsum(size)
    return ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordCoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``spaced``: ids depend on the space before a word (byte-level vocabularies); otherwise white space only separates and
    case doesn't count. A text that holds the string of a special token goes through the library whole, which makes one id
    of it, or ordinary text with ``special_as_text``.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 400_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()})
        self.spaced, self.limit, self.known, self.older = spaced, limit, CodeTable(), CodeTable()
        self.marks = {c: self.whole(c) for c in ".,;:!?"}
        self.newline = len(self.whole("\n")) // 4

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def codable(self, word: str) -> bool:
        if not self.spaced:
            return word != ""
        bare = word.removeprefix("\n")
        return bare != "" and solid(bare[0]) and solid(bare[-1])

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has (-1: no code of its own), and all of them in a row."""
        cores = [w[:-1] if len(w) > 1 and w[-1] in self.marks and letter(w[-2]) else w for w in words]
        plain = list(dict.fromkeys(c for c, w in zip(cores, words) if self.codable(w)))
        units = [w if w[0] == "\n" else f" {w}" for w in plain] if self.spaced else plain
        codes = {w: array("I", code.ids).tobytes() for w, code in zip(plain, self.library.encode_batch_fast(units, add_special_tokens=False))}
        found = [(codes[c] + self.marks[w[-1]] if c is not w else codes[c]) if self.codable(w) else None for c, w in zip(cores, words)]
        none = -1 if self.spaced else 0  # between spaces there is nothing to encode
        return np.array([none if c is None else len(c) // 4 for c in found], np.int32), np.frombuffer(b"".join(c or b"" for c in found), "<u4")

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Texts in words; with ``spaced``, those that begin a line carry its line feed, the first one too."""
        if self.spaced:
            return pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        return pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word (-1: no code of its own), and all of them in a row."""
        if len(self.known) + len(words) > self.limit:  # words that come again soon are kept once more
            self.known, self.older = CodeTable(), self.known
        key, check = digests(words)
        known, start, size = self.known.find(key, check)
        new = np.flatnonzero(~known)
        if len(new):
            before, at, n = self.older.find(key[new], check[new])
            again, fresh = new[before], new[~before]
            n, at = n[before], at[before]
            sizes, ids = self.learn([words[i] for i in fresh])
            rows, all_sizes = np.concatenate([again, fresh]), np.concatenate([n, sizes])
            start[rows] = self.known.add(key[rows], check[rows], all_sizes, np.concatenate([taken(self.older.ids, at, np.maximum(n, 0)), ids]))
            size[rows] = all_sizes
        return size, taken(self.known.ids, start, np.maximum(size, 0))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each run of texts: their ids, every text closed by id 0, and the places where texts begin (and the last ends)."""
        for part in row_chunks(texts.fill_null("")):
            lists = self.split(part)
            words = lists.flatten().dictionary_encode()
            size, flat = self.codes(words.dictionary.to_pylist())
            index, first = words.indices.to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            length = np.maximum(size, 0).astype(np.int64)
            own, begin = length[index], (np.cumsum(length) - length)[index]
            if self.spaced:  # the line feed put before each text
                own[first] -= self.newline
                begin[first] += self.newline
            bad = np.logical_or.reduceat((size < 0)[index], first)
            low = pc.ascii_lower(part) if self.special else None
            for token in self.special:
                bad |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
            if bad.any():
                yield from self.with_whole(part, bad, own, begin, first, flat)
                continue
            yield assemble(own, begin, first, flat)

    def with_whole(self, part: pa.Array, bad: np.ndarray, own, begin, first, flat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``encode``, where some texts hold a word without a code of its own and go through the library whole."""
        ids, offsets = assemble(np.maximum(own, 0), begin, first, flat)
        parts = [np.frombuffer(self.whole(part[i].as_py()) + END, "<u4") if bad[i] else ids[offsets[i]:offsets[i + 1]] for i in range(len(part))]
        yield np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@lru_cache(2)
def coder_of(path: str, spaced: bool, limit: int) -> WordCoder:
    """The coder of a worker process, which keeps what it knows from task to task."""
    return WordCoder(path, spaced, limit)


def assemble(own: np.ndarray, begin: np.ndarray, first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from the codes of their words: ``own`` ids of each word from ``begin`` in ``flat`` on."""
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(own, first) + 1)])
    ids = np.zeros(offsets[-1], "<u4")
    keep = np.ones(len(ids), bool)
    keep[offsets[1:] - 1] = False
    ids[keep] = taken(flat, begin, own)
    return ids, offsets
