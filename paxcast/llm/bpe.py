"""Byte-pair merging with a hierarchical-bitmap rank queue (used by operator 3).

Pending merges wait in buckets, one per merge rank; a bucket holds positions of
a doubly linked list of symbols. A two-level bitmap says which buckets hold
something: find-first-set on the summary word, then on the word below, gives
the lowest pending rank (256 ranks to a word) without a heap over all pairs. Entries are
never deleted when a neighbour changes; a popped entry whose symbols no longer
form the rank's pair is stale and skipped. A piece of n bytes has at most 3n
entries, so a piece of a hundred thousand bytes costs no more per byte than a
short one (but for the bucket's own ordering).

Many pieces share one queue: their symbols stand in one list with separators
between them, which form no pair, so that a bucket is popped once for all pieces
and each piece still sees its own merges lowest rank first, leftmost first.
"""

from __future__ import annotations

import base64

import numpy as np

#: Bytes of pieces that share a queue; a longer piece has one of its own.
GROUP_BYTES = 1 << 15
#: Symbols that no pair has: between two pieces, and the right half of a merge.
SEPARATOR, MERGED = -1, -2


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """The merges of a rank file by ids: a pair's rank is the id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        get = ranks.get
        #: By left symbol, then right symbol, and the other way round: the rank of the pair.
        self.by_left, self.by_right = {}, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    self.by_left.setdefault(left, {})[right] = rank
                    self.by_right.setdefault(right, {})[left] = rank
        self.of_bytes = np.array([get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.n_words = (max(ranks.values()) >> 8) + 1

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.many([piece])[0], "<u4").tolist()

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in map(self.ranks.get, pieces)]
        group, size = [], 0
        for at, piece in enumerate(pieces):
            if out[at]:
                continue
            if group and size + len(piece) > GROUP_BYTES:
                self._fill(out, pieces, group)
                group, size = [], 0
            group.append(at)
            size += len(piece)
        if group:
            self._fill(out, pieces, group)
        return out

    def _fill(self, out: list[bytes], pieces: list[bytes], group: list[int]) -> None:
        for at, ids in zip(group, self._merge([pieces[at] for at in group])):
            out[at] = ids

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Merges through one queue: lowest rank first, leftmost first among equals."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(1, len(pieces) + 1), lengths)
        n = len(data) + len(pieces) + 1
        symbol = np.full(n, SEPARATOR, np.int64)
        symbol[place] = self.single[data]
        symbol = symbol.tolist()
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))

        first = self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        paired = np.flatnonzero((first >= 0) & (np.diff(place) == 1))
        paired = paired[np.argsort(first[paired], kind="stable")]
        pending = np.full(n, SEPARATOR, np.int64)  # rank of the pair that begins at a position
        pending[place[paired]] = first[paired]
        pending = pending.tolist()
        found, at = np.unique(first[paired], return_index=True)
        at = [*at.tolist(), len(paired)]
        positions = place[paired].tolist()
        buckets = {rank: positions[a:b] for rank, a, b in zip(found.tolist(), at, at[1:])}
        words, summary = [0] * self.n_words, 0
        for rank in buckets:
            words[rank >> 8] |= 1 << (rank & 255)
            summary |= 1 << (rank >> 8)

        none: dict[int, int] = {}
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            with_right = self.by_left.get(rank, none).get
            with_left = self.by_right.get(rank, none).get
            lower = False
            for popped, i in enumerate(bucket, 1):
                if pending[i] != rank:
                    continue  # stale
                j = following[i]
                following[i] = k = following[j]
                preceding[k] = i
                before = preceding[i]
                symbol[i], symbol[j] = rank, MERGED
                pending[j] = None
                pending[i] = fresh = with_right(symbol[k])
                if fresh is not None:
                    if fresh in buckets:
                        buckets[fresh].append(i)
                    else:
                        buckets[fresh] = [i]
                        words[fresh >> 8] |= 1 << (fresh & 255)
                        summary |= 1 << (fresh >> 8)
                        lower = fresh < rank
                pending[before] = fresh = with_left(symbol[before])
                if fresh is not None:
                    if fresh in buckets:
                        buckets[fresh].append(before)
                    else:
                        buckets[fresh] = [before]
                        words[fresh >> 8] |= 1 << (fresh & 255)
                        summary |= 1 << (fresh >> 8)
                        lower = lower or fresh < rank
                if lower:  # that merge comes before the rest of this bucket
                    if popped < len(bucket):
                        buckets[rank] = bucket[popped:]
                        words[high] |= 1 << (rank & 255)
                        summary |= 1 << high
                    break

        left = np.array(symbol, np.int64)[place]
        alive = left >= 0
        ids = left[alive].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], np.cumsum(lengths)])]
        bounds = (4 * ends).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]
