"""Merges of a byte-level BPE vocabulary, applied to many words at once.

A word's ids are what is left when of all adjacent pairs the one of the lowest
rank (the leftmost of several) is merged, again and again. All words take one
merge a round: they are the columns of a matrix that has a row per byte.
"""

from __future__ import annotations

import json

import numpy as np

#: Bytes of a word, at most; longer ones are left to the library.
LONGEST = 30
#: Bits of a place in a word, and what no pair has.
_BITS, _NONE = 5, np.int32(0x7FFFFFFF)
_SLOT_BITS = 18
_MIX = np.uint32(0x9E3779B1)
#: No id of a vocabulary.
NOBODY = 0xFFFF


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Merges:
    """The pairs of a vocabulary with their ranks."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        """byte_ids: id of each byte; left, right, merged: ids of a pair and of what it becomes, by rank; all uint32 below NOBODY."""
        self.byte_ids, self.merged = byte_ids, merged
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint32)
        self.ranks = np.full(1 << _SLOT_BITS, -1, np.int32)
        key = (left << np.uint32(16)) | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.ranks[slot[todo]] < 0
            takers = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.ranks[slot[takers]], self.keys[slot[takers]] = takers, key[takers]
            todo = todo[self.ranks[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
        pair = np.arange(1 << 16)
        #: Rank of each pair of bytes.
        self.first = self.rank(self.byte_ids[pair >> 8], self.byte_ids[pair & 255])

    @staticmethod
    def of(text: str) -> Merges | None:
        """The merges of a tokenizer file; None if more than byte-level merges decides about a word."""
        model = (whole := json.loads(text))["model"]
        cut = whole.get("pre_tokenizer") or {}
        plain = (
            not whole.get("normalizer")
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(
                model.get(k)
                for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk")
            )
        )
        if not plain:
            return None
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if max(len(pairs), *vocabulary.values()) >= NOBODY:
            return None
        try:
            of = lambda tokens: np.array([vocabulary[t] for t in tokens], np.uint32)
            left, right = of(a for a, _ in pairs), of(b for _, b in pairs)
            # A pair that stands twice has two ranks.
            twice = len(np.unique((left << np.uint32(16)) | right, return_counts=True)[0]) < len(pairs)
            return None if twice else Merges(of(_byte_chars()), left, right, of(a + b for a, b in pairs))
        except KeyError:
            return None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for those that do not merge."""
        key = (left << np.uint32(16)) | right
        slot = self._slot(key)
        out = self.ranks[slot]
        todo = np.flatnonzero((self.keys[slot] != key) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
            found = out[todo] = self.ranks[slot[todo]]
            todo = todo[(found >= 0) & (self.keys[slot[todo]] != key[todo])]
        return out

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of words of 1 to LONGEST bytes, which stand in a row."""
        if not len(size):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        m, rows = len(size), int(size.max()) + 2
        ends = np.cumsum(size)
        # A column per word: its bytes begin in row 1; row 0 and the row behind it hold an id that merges with nothing.
        row = np.arange(1, len(flat) + 1) - np.repeat(ends - size, size)
        at = row * m + np.repeat(np.arange(m), size)
        ids = np.full(rows * m, NOBODY, np.uint32)
        ids[at] = self.byte_ids[flat]
        # A pair's rank and place: the smallest is the one to merge.
        pair = np.full(rows * m, _NONE, np.int32)
        ranks = self.first[(flat[:-1].astype(np.int64) << 8) | flat[1:]]
        ranks[ends[:-1] - 1] = -1
        some = np.flatnonzero(ranks >= 0)
        pair[at[some]] = (ranks[some] << _BITS) | row[some].astype(np.int32)
        after = np.arange(m, (rows + 1) * m)
        before = after - 2 * m
        column, open_ = np.arange(m), pair.reshape(rows, m)
        while True:
            low = open_.min(0)
            live = np.flatnonzero(low < _NONE)
            if not len(live):
                break
            low, column = low[live], column[live]
            row = (low & ((1 << _BITS) - 1)).astype(np.int64)
            p = row * m + column
            gone, ahead = after[p], before[p]
            behind = after[gone]
            new = self.merged[low >> _BITS]
            ids[p], ids[gone], pair[gone] = new, NOBODY, _NONE
            after[p], before[behind] = behind, p
            ranks = self.rank(np.concatenate([ids[ahead], new]), np.concatenate([new, ids[behind]]))
            ranks = np.where(ranks < 0, _NONE, (ranks << _BITS) | np.concatenate([ahead // m, row]).astype(np.int32))
            pair[ahead], pair[p] = ranks[: len(p)], ranks[len(p) :]
            # Words that are done need no more look-ups.
            open_ = pair.reshape(rows, m)[:, column] if len(column) < m else open_
        held = (ids != NOBODY).reshape(rows, m)
        return ids.reshape(rows, m).T[held.T].astype(np.int32), held.sum(0)
