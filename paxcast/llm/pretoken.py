"""Whole texts to ids through a cache of pre-tokens.

A space between two visible characters always begins a new match of the
pre-token pattern, so a text without other runs of white space is cut there by
``str.split`` and each run is looked up whole. Runs not seen before, and texts
holding longer white space, go through the pattern.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from itertools import chain

import regex

#: Entries a worker's caches may hold before they are emptied.
CACHE_ENTRIES = 600_000


def kept(key: tuple, make: Callable):
    """What ``make`` gives, made once in a Python worker and found there by the
    tasks that it runs later."""
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class _Cache(dict):
    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


#: In place of a run's ids (which are bytes): the run is bordered by further white
#: space, so the pattern must see the whole text.
SPACED = "spaced"


class _Spaced(Exception):
    """A run bordered by further white space: the pattern must see the whole text."""


class Encoder:
    """``text -> ids`` as little-endian unsigned 32-bit bytes."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], limit: int = CACHE_ENTRIES):
        self.find = regex.compile(pattern).findall
        self.pieces = _Cache(encode_piece, limit)
        self.runs = _Cache(self._run, limit)

    def _run(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Spaced
        return self._all(" " + run)

    def _all(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __call__(self, text: str) -> bytes:
        first, space, rest = text.partition(" ")
        if not space or not first or first[-1].isspace():
            return self._all(text)
        try:
            return self._all(first) + b"".join(map(self.runs.__getitem__, rest.split(" ")))
        except _Spaced:
            return self._all(text)


class _Aged:
    """Values by key. When half the limit has gathered, what was not asked for since
    the turn before is dropped; the rest stays."""

    def __init__(self, limit: int):
        self.now, self.old, self.limit = {}, {}, limit

    def turn(self) -> None:
        if 2 * len(self.now) >= self.limit:
            self.now, self.old = {}, self.now

    def missing(self, keys) -> list:
        """The distinct keys without a value; ``now`` holds the others until the next turn."""
        out = []
        for key in set(keys).difference(self.now):
            value = self.old.get(key, self)
            if value is self:
                out.append(key)
            else:
                self.now[key] = value
        return out


class BatchEncoder:
    """As ``Encoder``, for many texts at a time: the pre-tokens of all texts that
    were not seen before are encoded together. Each of its caches has two halves of
    ``CACHE_ENTRIES`` and keeps what is in use."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[bytes]], limit: int = 2 * CACHE_ENTRIES):
        self.find = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.pieces, self.runs = _Aged(limit), _Aged(limit)

    def _learn(self, pieces) -> None:
        new = self.pieces.missing(pieces)
        self.pieces.now.update(zip(new, self.encode_pieces(new)))

    def _join(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.now.__getitem__, pieces))

    def _learn_runs(self, runs) -> None:
        """A run bordered by further white space gets SPACED."""
        known, good = self.runs.now, []
        for run in self.runs.missing(runs):
            if not run or run[0].isspace() or run[-1].isspace():
                known[run] = SPACED
            else:
                good.append(run)
        if not good:
            return
        pieces = self.find(" " + " ".join(good))
        self._learn(pieces)
        starts = [at for at, piece in enumerate(pieces) if piece[0] == " "]  # runs hold no space themselves
        value = self.pieces.now
        for run, a, b in zip(good, starts, [*starts[1:], len(pieces)], strict=True):
            known[run] = value[pieces[a]] if b - a == 1 else self._join(pieces[a:b])

    def many(self, texts: list[str]) -> list[bytes]:
        self.pieces.turn()
        self.runs.turn()
        cut, new, value = [], [], self.runs.now.get
        for text in texts:
            first, space, rest = text.partition(" ")
            if not space or not first or first[-1].isspace():
                cut.append((self.find(text), [], [], []))
                continue
            runs = rest.split(" ")
            values = list(map(value, runs))
            gaps = [at for at, v in enumerate(values) if v is None]
            new += [runs[at] for at in gaps]
            cut.append((self.find(first), runs, values, gaps))
        self._learn_runs(new)
        self._learn(chain.from_iterable(pieces for pieces, *_ in cut))
        out, spaced = [], []
        for text, (pieces, runs, values, gaps) in zip(texts, cut):
            for at in gaps:
                values[at] = value(runs[at])
            try:
                out.append(self._join(pieces) + b"".join(values))
            except TypeError:  # a value is SPACED
                spaced.append((len(out), self.find(text)))
                out.append(b"")
        self._learn(chain.from_iterable(pieces for _, pieces in spaced))
        for at, pieces in spaced:
            out[at] = self._join(pieces)
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]
