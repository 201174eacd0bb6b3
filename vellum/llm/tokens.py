"""Exact, memoised encoding with the ``tokenizers`` library.

A byte-pair tokenizer splits a text into pieces before merging, and no merge
crosses a split.  So each distinct piece is encoded once by the library, and a
text's ids are its pieces' ids joined.  The strings of special tokens in a text
give their ids, as in the library.

Texts are worked on many at a time, as arrays: where the splitter is known to
cut (at white space, and before a stop or comma after an ASCII letter or digit)
gives the pieces, a polynomial hash of each is looked up in a table of open
addresses, the bytes found there are compared, and ids are gathered.  Texts whose
white space the splitter treats otherwise are cut by its own pattern.  The table
is bounded: when full it is emptied.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from vellum.llm.memory import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Slots of the table, and pieces and bytes of pieces that it holds at most.
SLOTS, ENTRIES, POOL = 1 << 21, 1_000_000, 1 << 25
#: Text that is worked on at once, in bytes; a longer one is cut at white space into parts of about so many.
TOGETHER = 1 << 17
#: Words in one call of the library.
WORDS = 100

# Fixed value: the byte-level splitter's pattern as its tokenizer file states it.
_SPACE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space that is not a single space or line feed between other characters, in UTF-8.
_SPACES = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = np.arange(256)
_ALNUM = ((_BYTE >= 48) & (_BYTE < 58)) | ((_BYTE >= 65) & (_BYTE < 91)) | ((_BYTE >= 97) & (_BYTE < 123))
_STOP = (_BYTE == 44) | (_BYTE == 46)
_WHITE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE < 14))


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def _flat(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of all members of runs (first, length), run by run."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Pieces and their ids: hash slots, and pools of key bytes and ids."""

    def __init__(self):
        # powers of the base and of its inverse modulo 2**64
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        powers = lambda b: np.concatenate([[_U(1)], np.cumprod(np.full(4 * TOGETHER, b))])
        self._up, self._down = powers(_BASE), powers(inverse)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self._hash = np.zeros(SLOTS, _U)
        self._slot = np.zeros(SLOTS, np.int32)
        self._keys, self._ids = np.empty(0, np.uint8), np.empty(0, "<u4")
        self._entry = np.empty((4, 0), np.int32)  # first key byte, key bytes, first id, ids
        self._used = np.zeros(3, np.int64)  # key bytes, ids, entries

    def full(self, pieces: int, size: int) -> bool:
        return self.n + pieces > ENTRIES or self._used[0] + size > POOL

    def hashes(self, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        s = np.concatenate([[_U(0)], np.cumsum((text.astype(_U) + _U(1)) * self._up[: len(text)])])
        h = (s[first + length] - s[first]) * self._down[first] + length.astype(_U)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        return (h ^ (h >> _U(31))) | _U(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if there is none."""
        out = np.full(len(h), -1, np.int64)
        at = (h >> _U(43)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            held = self._hash[at]
            hit = held == h[todo]
            out[todo[hit]] = self._slot[at[hit]]
            more = ~hit & (held != 0)
            todo, at = todo[more], (at[more] + 1) % SLOTS
        return out

    def add(self, h: np.ndarray, keys: list[bytes], ids: list[bytes]) -> None:
        """New pieces; their hashes differ."""
        sizes = np.array([[len(k) for k in keys], [len(x) // 4 for x in ids]], np.int64)
        used, n = self._used, len(keys)
        self._keys = _put(self._keys, used[0], np.frombuffer(bytearray().join(keys), np.uint8))
        self._ids = _put(self._ids, used[1], np.frombuffer(bytearray().join(ids), "<u4"))
        ends = np.cumsum(sizes, axis=1)
        rows = np.stack([used[0] + ends[0] - sizes[0], sizes[0], used[1] + ends[1] - sizes[1], sizes[1]]).astype(np.int32)
        if used[2] + n > self._entry.shape[1]:
            self._entry = np.concatenate([self._entry[:, : used[2]], np.empty((4, max(n, int(used[2]), 1024)), np.int32)], axis=1)
        self._entry[:, used[2] : used[2] + n] = rows
        todo, at = np.arange(n), (h >> _U(43)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self._hash[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self._hash[at[won]], self._slot[at[won]] = h[todo[won]], used[2] + todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], at[left]
            at = np.where(self._hash[at] != 0, (at + 1) % SLOTS, at)
        self._used = used + [ends[0, -1], ends[1, -1], n]
        self.n += n

    def same(self, entry: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> bool:
        """Whether the entries' keys are the pieces."""
        key, size = self._entry[0, entry].astype(np.int64), self._entry[1, entry]
        return bool((size == length).all()) and bool((self._keys[_flat(key, length)] == text[_flat(first, length)]).all())

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each entry."""
        n = self._entry[3, entry].astype(np.int64)
        return self._ids[_flat(self._entry[2, entry].astype(np.int64), n)], n


def _put(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    if used + len(new) > len(pool):
        pool = np.concatenate([pool[:used], np.empty(max(len(new), int(used), 4096), pool.dtype)])
    pool[used : used + len(new)] = new
    return pool


class Encoder:
    """``encode(text)`` gives the ids of UTF-8 bytes as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        # special tokens' strings are cut out of a text as the library does; what is left is ordinary text, also where lower-casing makes one
        added = self._tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("tokens added with options are not supported")
        self._special = {t.content.encode(): _little([i]) for i, t in added.items()}
        self._specials = re.compile(b"(" + b"|".join(sorted(map(re.escape, self._special), key=len, reverse=True)) + b")")
        self._tok.encode_special_tokens = True
        self._tok.no_padding()
        self._tok.no_truncation()
        self._table: Table | None = None

    def _plain(self, text: bytes) -> bool:
        """Whether arrays cut this text as the splitter does."""
        raise NotImplementedError

    def _folded(self, text: bytes) -> bytes:
        """What can be done to plain texts before they are cut, to know more pieces again."""
        return text

    def _bounds(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) of pieces of texts that begin at ``starts``."""
        raise NotImplementedError

    def _pieces(self, text: bytes) -> list[str]:
        """Pieces by the splitter's own pattern."""
        raise NotImplementedError

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text."""
        held: list[bytes | list[bytes]] = []
        size = 0
        for text in texts:
            if any(x in text for x in self._special):
                held.append([self._special[x] if k % 2 else self.encode(x) for k, x in enumerate(self._specials.split(text))])
            elif len(text) > TOGETHER or not self._plain(text):
                held.append([self._alone(text)])
            else:
                held.append(text)
                size += len(text)
            if size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def forget(self) -> None:
        self._table = None

    def _alone(self, text: bytes) -> bytes:
        """A long text in parts, one that arrays don't cut by its pieces."""
        if not self._plain(text):
            return b"".join(self._library(self._pieces(text)))
        parts, at = [], 0
        while at < len(text):
            end = text.find(b" ", at + TOGETHER // 2)
            end = len(text) if end < 0 else end
            parts.append(text[at:end])
            at = end
        return b"".join([self._arrays([p])[0] if len(p) <= 2 * TOGETHER else b"".join(self._library(self._pieces(p))) for p in parts])

    def _together(self, held: list[bytes | list[bytes]]) -> Iterator[bytes]:
        done = iter(self._arrays([x for x in held if isinstance(x, bytes)]))
        return (next(done) if isinstance(x, bytes) else b"".join(x) for x in held)

    def _arrays(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        if self._table is None:
            self._table = Table()
        table = self._table
        joined = self._folded(b"".join(texts))
        if not joined:
            return texts
        text = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([0, *map(len, texts)])
        first, length = self._bounds(text, starts[:-1])
        h = table.hashes(text, first, length)
        entry = table.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if table.full(len(new), int(length[new].sum())):
                table.clear()
                new = np.arange(len(h))
            hs, at = np.unique(h[new], return_index=True)
            keys = [joined[a : a + n] for a, n in zip(first[new[at]].tolist(), length[new[at]].tolist(), strict=True)]
            table.add(hs, keys, self._library([k.decode("utf-8", "replace") for k in keys]))
            entry[new] = table.find(h[new])
        if not table.same(entry, text, first, length):  # two pieces with one hash
            return [b"".join(self._library(self._pieces(x))) for x in texts]
        flat, n = table.ids(entry)
        ends = np.concatenate([[0], np.cumsum(n)])
        at = ends[np.searchsorted(first, starts)] * 4
        ids = flat.tobytes()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _library(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            out += [_little(e.ids) for e in self._tok.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
        return out


class WordEncoder(Encoder):
    """For the lower-casing splitter that drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self._tok.get_vocab()
        self._ends = bytearray(max(vocab.values()) + 1)
        for token, i in vocab.items():
            self._ends[i] = token.endswith("</w>")

    def _plain(self, text: bytes) -> bool:
        return b"\xcc" not in text and b"\xcd" not in text  # a mark may compose with the letter before it

    def _folded(self, text: bytes) -> bytes:
        return text.lower()

    def _pieces(self, text: bytes) -> list[str]:
        # white space always separates
        return [x.decode("utf-8", "replace") for x in text.split()]

    def _bounds(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ink = ~_WHITE[text]
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        begin[starts[starts < len(text)]] = True
        begin[1:] |= _STOP[text[1:]] & _ALNUM[text[:-1]]
        begin &= ink
        first = np.flatnonzero(begin)
        # a piece goes on to the next one or to white space
        gap = np.flatnonzero(~ink)
        stop = np.append(gap, len(text))[np.searchsorted(gap, first)]
        return first, np.minimum(np.append(first[1:], len(text)), stop) - first

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Words go in together; each ends with the one id that ends a word."""
        words = [k for k, p in enumerate(pieces) if p.isalpha()]
        out: list = [None] * len(pieces)
        for i in range(0, len(words), WORDS):
            part = words[i : i + WORDS]
            ids = self._tok.encode_batch_fast([" ".join([pieces[k] for k in part])], add_special_tokens=False)[0].ids
            ends = [k + 1 for k, x in enumerate(ids) if self._ends[x]]
            if len(ends) == len(part):
                flat, a = _little(ids), 0
                for k, b in zip(part, ends, strict=True):
                    out[k] = flat[4 * a : 4 * b]
                    a = b
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, super()._library([pieces[k] for k in rest]), strict=True):
            out[k] = x
        return out


class SpaceEncoder(Encoder):
    """For the byte-level splitter whose words take the one space before them."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self._tok.get_vocab()
        # a sign of the byte alphabet stands for one byte
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self._bytes[i] = len(token)

    def _plain(self, text: bytes) -> bool:
        # one space, or one line feed, between other characters always begins a piece
        return not any(x in text for x in _SPACES) and text[:1] not in (b" ", b"\n") and text[-1:] not in (b" ", b"\n")

    def _pieces(self, text: bytes) -> list[str]:
        return _SPACE_PIECES.findall(text.decode("utf-8", "replace"))

    def _bounds(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = text == 10
        begin = line | (text == 32)
        begin[1:] |= line[:-1] | (_STOP[text[1:]] & _ALNUM[text[:-1]])
        begin[starts[starts < len(text)]] = True
        first = np.flatnonzero(begin)
        return first, np.diff(np.append(first, len(text)))

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Words that begin with their space go in together; byte lengths tell whose ids are whose."""
        words = [k for k, p in enumerate(pieces) if p[:1] == " " and p[1:].isalpha()]
        out: list = [None] * len(pieces)
        for i in range(0, len(words), WORDS):
            part = [pieces[k] for k in words[i : i + WORDS]]
            ids = np.array(self._tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.cumsum([len(p.encode()) for p in part])
            ends = np.cumsum(self._bytes[ids])
            at = np.searchsorted(ends, stops) + 1
            if len(ids) == at[-1] and (ends[at - 1] == stops).all():
                flat, a = ids.tobytes(), 0
                for k, b in zip(words[i : i + WORDS], (4 * at).tolist(), strict=True):
                    out[k] = flat[a:b]
                    a = b
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, super()._library([pieces[k] for k in rest]), strict=True):
            out[k] = x
        return out


_CACHE: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each Python worker: its memo serves all its tasks."""
    key = (kind, path)
    if key not in _CACHE:
        _CACHE[key] = kind(path)
        gc.freeze()
    claim(f"encoder {path}", _CACHE[key].forget)
    return _CACHE[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
