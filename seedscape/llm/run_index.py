"""A run-length index over a block of repetitive strings.

The suffixes of all strings are sorted and their Burrows-Wheeler transform is cut into
runs of equal letters. Within a run the neighbours of a suffix move along with it: if
suffix x sits inside a run, then x - 1 has the neighbour of x, one to the left, and a
common prefix one longer. So neighbour and common prefix are sampled at the run ends
only, and every other position follows from the next sample in the text.
"""

from __future__ import annotations

import numpy as np

#: Bytes packed into the first sort key.
_PACKED = 7


def _suffix_ranks(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every suffix, by prefix doubling. ``ends`` has, for each position, that of its string's
    terminator; terminators sort before all bytes, in the order of the strings."""
    n = len(text)
    at = np.arange(n, dtype=np.int64)
    padded = np.append(text, np.zeros(_PACKED, np.uint8)).astype(np.uint64)
    left = np.minimum(ends - at, _PACKED)
    key = np.zeros(n, np.uint64)
    for i in range(_PACKED):
        key |= np.where(left > i, padded[i : i + n], np.uint64(0)) << np.uint64(8 * (_PACKED - i))
    key |= left.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    group = _group_starts(key[order])
    rank[order] = group
    terminators = np.flatnonzero(left == 0)
    rank[terminators] = np.arange(len(terminators))
    tied = _tied(group)
    active = order[tied]
    active = active[left[active] > 0]
    step = _PACKED
    while len(active):
        first, then = rank[active], rank[np.minimum(active + step, ends[active])]
        pair = first * n + then
        order = np.argsort(pair, kind="stable")
        active, first, pair = active[order], first[order], pair[order]
        group = _group_starts(pair)
        rank[active] = first + group - _group_starts(first)
        active = active[_tied(group)]
        step *= 2
    return rank


def _group_starts(values: np.ndarray) -> np.ndarray:
    """For sorted values, the index of the first equal one."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _tied(group: np.ndarray) -> np.ndarray:
    """Whether a group start is shared with another element."""
    tied = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    return tied


class RunIndex:
    """Run-compressed transform of ``strings``, with samples at the run ends."""

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(strings) else np.zeros(0, np.int64)
        self.size = int(lengths.sum() + len(strings))
        self.text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.ends = np.repeat(self.starts + lengths, lengths + 1)
        self.longest = int(lengths.max(initial=0))
        if not self.size:
            return
        rank = _suffix_ranks(self.text, self.ends)
        sorted_ = np.empty(self.size, np.int64)
        sorted_[rank] = np.arange(self.size)
        before = np.append(0, self.text[:-1]).astype(np.int64)[sorted_]
        is_start = np.zeros(self.size, bool)
        is_start[self.starts] = True
        cut = before[1:] != before[:-1]
        own = is_start[sorted_]  # a string's start is preceded by a terminator of its own: a run of one
        cut |= own[1:] | own[:-1]
        heads = np.flatnonzero(np.append(True, cut))
        tails = np.flatnonzero(np.append(cut, True))
        self.runs = len(heads)
        self.before = self._sample(sorted_, rank, sorted_[heads], -1)
        self.behind = self._sample(sorted_, rank, sorted_[tails], 1)

    def _sample(self, sorted_: np.ndarray, rank: np.ndarray, suffixes: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
        """Positions left of the sampled suffixes, with their neighbours on one side and common prefixes."""
        at = np.unique(np.append(suffixes - 1, self.ends[self.starts]))
        at = at[at >= 0]
        beside = rank[at] + side
        inside = (beside >= 0) & (beside < self.size)
        neighbour = np.where(inside, sorted_[np.clip(beside, 0, self.size - 1)], -1)
        common = np.zeros(len(at), np.int64)
        left = np.where(inside, np.minimum(self.ends[at] - at, self.ends[neighbour] - neighbour), 0)
        open_ = np.flatnonzero(left > 0)
        width = 32
        while len(open_):
            far = common[open_][:, None] + np.arange(width)
            a = self.text[np.minimum(at[open_][:, None] + far, self.size - 1)]
            b = self.text[np.minimum(neighbour[open_][:, None] + far, self.size - 1)]
            differs = a != b
            same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
            common[open_] = np.minimum(common[open_] + same, left[open_])
            open_ = open_[(same == width) & (common[open_] < left[open_])]
        return at, neighbour, common

    def neighbours(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For every position its neighbour among the sorted suffixes and the length of their common
        prefix, streamed along the text from the samples."""
        at, neighbour, common = self.before if side < 0 else self.behind
        here = np.arange(self.size)
        sample = np.searchsorted(at, here)
        ahead = at[sample] - here
        return neighbour[sample] - ahead, common[sample] + ahead

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest prefix of each suffix that occurs elsewhere in the block."""
        lengths = [self.neighbours(side)[1] for side in (-1, 1)] if self.size else [np.zeros(0, np.int64)]
        return np.maximum.reduce(lengths)

    def repeats_earlier(self, length: int) -> np.ndarray:
        """Whether the ``length`` letters from each position on also start earlier in the block."""
        if not self.size:
            return np.zeros(0, bool)
        here = np.arange(self.size)
        least = here.copy()
        for side in (-1, 1):  # all places of a string are neighbours of each other; the first is their minimum
            neighbour, common = self.neighbours(side)
            onward = np.where(common >= length, neighbour, here)
            seen = here.copy()
            while True:
                lower = np.minimum(seen, seen[onward])
                further = onward[onward]
                if np.array_equal(further, onward) and np.array_equal(lower, seen):
                    break
                seen, onward = lower, further
            least = np.minimum(least, seen)
        return least < here
