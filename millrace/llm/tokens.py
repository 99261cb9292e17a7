"""Encoding of texts with a published BPE vocabulary, at corpus speed.

A BPE file's pre-tokenizer never joins what stands on both sides of a single
blank, so a text's ids are its blank-separated parts' ids in a row. Natural
text repeats its parts, and a bounded cache of them saves most of the library's
work; what is not in the cache is encoded by the ``tokenizers`` library.
``encode`` gives exactly what the library gives for the whole text, special
tokens that are spelt out in it included.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np
import regex

#: Chars for which this module's own pre-tokenizing is known to equal the library's.
_PLAIN = re.compile(r"[\x20-\x7e\nÀ-įı-ſ]*")
_TWO_SPACES = re.compile(r"\s\s")
#: White space besides the blank and the line end.
_ODD_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

#: Punctuation that a split leaves in one piece of its own after a word; no apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Stands for the ids of a part that is not encoded yet.
_LACKS = b"\xff\xff"
#: New parts that wait at most, besides those of one text, to be encoded together.
_MOST_NOTED = 20_000

#: The split patterns of the two published vocabularies.
SPLITS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_CHARS = _byte_chars()


def _shown(piece: str) -> str:
    """A text as byte-level BPE files spell its bytes."""
    if piece.isascii() and "\n" not in piece:
        return piece.replace(" ", "\u0120")
    return piece.encode().decode("latin-1").translate(_BYTE_CHARS)


class _Memo(dict):
    """Calls ``make`` for a key it lacks; forgets all when it holds ``most`` keys."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


class _Tails(_Memo):
    """While ``noted`` is a list, a key it lacks is put there, and ``_LACKS`` stands for its ids."""

    noted: list[str] | None = None

    def __missing__(self, key: str) -> bytes:
        if self.noted is None:
            return super().__missing__(key)
        self.noted.append(key)
        return _LACKS


class Encoder:
    """Encodes texts with one vocabulary file; ``most`` bounds the cache's entries."""

    def __init__(self, path: str, most: int = 1_200_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        #: Texts that hold one of these go to the library whole.
        self.added = tuple(t.content for t in self.full.get_added_tokens_decoder().values() if t.content)
        self.model = self.full.model
        self.model._resize_cache(0)
        self.words = self.full.normalizer is not None
        self.kind = "word" if self.words else "byte"
        self.split = regex.compile(SPLITS[self.kind])
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: The ids of tokens that begin with a blank, and of the line end.
        self.blanks = frozenset(k for t, k in self.full.get_vocab().items() if t[:1] == "\u0120")
        self.line_ends = frozenset(k for k in [self.full.token_to_id("\u010a")] if k is not None)
        self.tails = _Tails(self._tail, most)
        self.raw = _Memo(self._ids, most // 4)
        self.marks = _Memo(self._piece, 100_000)

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-tokenized piece, by the library's BPE model."""
        return array(self.code, [t.id for t in self.model.tokenize(_shown(piece))]).tobytes()

    def _ids(self, text: str) -> bytes:
        """The ids of a text without looking it up first."""
        if not _PLAIN.fullmatch(text):
            return array(self.code, self.full.encode(text, add_special_tokens=False).ids).tobytes()
        if self.words:
            text = text.lower()
            if text.isalpha():
                return self._piece(text)
        elif text[:1] == " " and text[1:].isalpha():
            return self._piece(text)
        marks = self.marks
        return b"".join([marks[p] if len(p) < 5 else self._piece(p) for p in self.split.findall(text)])

    def _tail(self, part: str) -> bytes:
        """The ids of a part that a single blank or line end sets off from the one before."""
        core = part.rstrip(_MARKS)
        if core != part and core.isalpha() and _PLAIN.fullmatch(core):
            return self.tails[core] + self.marks[part[len(core) :]]
        return self._ids(part if self.words or part[:1] == "\n" else " " + part)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian bytes of ``dtype``; null is empty."""
        if not text:
            return b""
        if any(t in text for t in self.added) or self.words and any(t in text.lower() for t in self.added):
            return array(self.code, self.full.encode(text, add_special_tokens=False).ids).tobytes()
        if self.words:
            return b"".join(map(self.tails.__getitem__, text.replace("\n", " ").split(" ")))
        parts = text.replace("\n", " \n").split(" ")
        if ("" in parts or "\n" in parts or any(map(text.__contains__, _ODD_SPACES))) and _TWO_SPACES.search(text):
            return b"".join(map(self.raw.__getitem__, _CUT.split(text)))
        first = self.raw[parts[0]]
        del parts[0]
        return first + b"".join(map(self.tails.__getitem__, parts))


    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """What :meth:`encode` gives for each text; parts not met before are encoded together."""
        if self.words or self.code != "H" or self.full.get_vocab_size() > _LACKS[0] << 8:
            return list(map(self.encode, texts))
        out: list[bytes] = []
        noted: list[str] = []
        lacking: list[tuple[int, int, int]] = []
        for text in texts:
            n = len(noted)
            self.tails.noted = noted
            try:
                out.append(self.encode(text))
            finally:
                self.tails.noted = None
            if len(noted) > n:
                lacking.append((len(out) - 1, n, len(noted)))
            if len(noted) > _MOST_NOTED:
                self._settle(out, noted, lacking)
        self._settle(out, noted, lacking)
        return out

    def _settle(self, out: list[bytes], noted: list[str], lacking: list[tuple[int, int, int]]) -> None:
        """Put the ids of the parts ``noted`` where ``_LACKS`` stands for them in ``out``; forgets both lists.

        No id's high byte is that of ``_LACKS``, so that it is found at whole ids only.
        """
        new = dict.fromkeys(noted, b"")
        self._learn(new)
        for k, first, end in lacking:
            known = out[k].split(_LACKS)
            pieces = [b""] * (2 * len(known) - 1)
            pieces[::2] = known
            pieces[1::2] = map(new.__getitem__, noted[first:end])
            out[k] = b"".join(pieces)
        if len(self.tails) + len(new) > self.tails.most:
            self.tails.clear()
        self.tails.update(new)
        noted.clear()
        lacking.clear()

    def _learn(self, new: dict[str, bytes]) -> None:
        """What :meth:`_tail` gives for each part, words of letters many at a call; their cores are added."""
        known, marks = self.tails.get, self.marks
        plain: dict[str, bytes] = {}
        wide: dict[str, bytes] = {}
        lines: dict[str, bytes] = {}
        marked: list[tuple[str, str]] = []
        for part in new:
            core, line = part, part[:1] == "\n"
            if not part.isalpha():
                core = part.rstrip(_MARKS)
                if not (core[1:] if line else core).isalpha() or core == part and not line:
                    new[part] = self._tail(part)
                    continue
                if core != part and (ids := known(core)):
                    new[part] = ids + marks[part[len(core) :]]
                    continue
            if core.isascii() or _PLAIN.fullmatch(core):
                (lines if line else plain if core.isascii() else wide)[core] = b""
                if core != part:
                    marked.append((part, core))
            else:
                new[part] = self._tail(part)
        for cores in (plain, wide, lines):
            self._words(cores)
            new.update(cores)
        for part, core in marked:
            new[part] = new[core] + marks[part[len(core) :]]

    def _words(self, cores: dict[str, bytes]) -> None:
        """Fill in the ids of plain words of letters that a blank stands before, or that begin with a line end.

        They are given to the model as one piece. Where as many of its tokens
        begin with a blank (are a line end) as there are words, no token holds
        one elsewhere, so no merge went over a word's edge, and each has its own.
        """
        names = list(cores)
        for at in range(0, len(names), 64):
            some = names[at : at + 64]
            lines = some[0][0] == "\n"
            heads = self.line_ends if lines else self.blanks
            ids = [t.id for t in self.model.tokenize(_shown("".join(some) if lines else " " + " ".join(some)))]
            starts = [i for i, k in enumerate(ids) if k in heads]
            if len(starts) != len(some):
                cores.update((w, self._tail(w)) for w in some)
                continue
            data, size = array(self.code, ids).tobytes(), self.dtype.itemsize
            starts.append(len(ids))
            cores.update(zip(some, [data[size * i : size * j] for i, j in pairwise(starts)], strict=True))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file; Python workers keep it between tasks.

    Workers collect garbage after each task; what is kept, caches above all, is
    taken out of that, since going through it takes longer than many a task.
    """
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
        gc.freeze()
    return _LOADED[path]
