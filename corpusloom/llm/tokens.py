"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

Both vocabularies split a text into words before any merge. No word spans a space
or line feed that has no other white space beside it, and none spans a letter and
a sign (but for apostrophes). So a text's ids are
those of its pieces, and a piece that was met before costs a look-up. Pieces are
cut and hashed (64 bits) for many texts at once, without a Python string for
each; the bytes of every piece are compared with those that the look-up found.
A text for which the rule does not hold, or one with a piece whose hash stands for
other bytes, is encoded whole. Where merges alone decide about a word of letters (the
byte-level vocabulary), new words are merged many at a time (see merges).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np

from corpusloom.llm.hashing import join_texts, lane_hashes, span_lanes, spans_of
from corpusloom.llm.merges import LONGEST, Merges
from corpusloom.llm.worker import kept

#: Pieces that a worker remembers; past it the memory is emptied and refilled.
MEMORY = 1_500_000
#: Slots of the look-up table, and how many are tried for a hash.
_SLOT_BITS, _PROBES = 22, 32
#: A special token of both vocabularies: what stands on either side of it is encoded apart.
APART = "<|endoftext|>"
#: Bytes of a word that counts as short where words are merged many at a time.
SHORT = 11
#: Text that is cut and hashed at once.
CHUNK_CHARS = 250_000


class _Table:
    """Open-addressing map from 64-bit hashes to numbers, many at a time."""

    def __init__(self):
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.values = np.full(1 << _SLOT_BITS, -1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for those that are not there."""
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.values[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        for _ in range(_PROBES):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << _SLOT_BITS) - 1)
            found = self.values[slot[left]]
            out[left] = found
            left = left[(found >= 0) & (self.keys[slot[left]] != h[left])]
        out[left] = -1
        return out

    def add(self, h: np.ndarray, first: int) -> bool:
        """Number distinct new hashes from `first` on; False if one finds no slot."""
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        left = np.arange(len(h))
        for _ in range(_PROBES):
            if not len(left):
                return True
            free = self.values[slot[left]] < 0
            # Of several that want one free slot the first one gets it.
            takers = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.values[slot[takers]] = takers + first
            self.keys[slot[takers]] = h[takers]
            left = left[self.values[slot[left]] != left + first]
            slot[left] = (slot[left] + 1) & ((1 << _SLOT_BITS) - 1)
        return not len(left)


def _append(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """An array with `new` behind its first `used` values; room is doubled when it runs out."""
    if used + len(new) > len(old):
        old = np.concatenate([old, np.zeros(max(len(old), len(new), 1 << 16), old.dtype)])
    old[used : used + len(new)] = new
    return old


#: 1 for ASCII letters, 2 for ASCII signs; the apostrophe is neither, since it may begin a word's ending.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2

#: 1 for the bytes of ASCII letters and of letters from U+00C0 to U+023F (two of which are signs).
_LETTER = (_KIND == 1).astype(np.uint8)
_LETTER[0x80:0xC0] = _LETTER[0xC3:0xC9] = 1


def _at_signs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut pieces also between letters and signs: both vocabularies do so before any merge."""
    kind = _KIND[data]
    cut = np.flatnonzero(kind[:-1] + kind[1:] == 3)
    cut = cut[kind[cut] > 0] + 1
    if not len(cut):
        return starts, ends
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class Encoder:
    """Encodes lists of texts into one flat array of ids and their lengths."""

    def __init__(self, path: str, keep_space: bool, memory: int = MEMORY):
        """keep_space: the vocabulary's words carry the space before them and keep
        their case; else white space is dropped and letters are put in lower case."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = self.tokenizer.token_to_id(APART)
        self.keep_space = keep_space
        #: None where more than merges decides about a word of letters.
        self.merges = Merges.of(Path(path).read_text("utf-8")) if keep_space else None
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        ends = lambda t: t.startswith("\u0120") if keep_space else t.endswith("</w>")
        self.mark[[i for t, i in vocabulary.items() if ends(t)]] = True
        self.limit = memory
        self._reset()

    def _reset(self) -> None:
        self.table = _Table()
        self.n, self.n_ids = 0, 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.whole = np.zeros(0, bool)
        #: The bytes of the pieces, as lanes.
        self.lanes, self.n_lanes = np.zeros(0, np.uint64), 0
        self.lane_at, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        #: The first lane of each piece, once more: most pieces have no other.
        self.head = np.zeros(0, np.uint64)

    def _remember(self, lanes: np.ndarray, n: np.ndarray, size: np.ndarray, which: np.ndarray) -> None:
        """Keep the bytes of the spans `which`, which are about to be learned in this order."""
        n_of = n[which]
        ends = np.cumsum(n_of)
        at = np.repeat((np.cumsum(n) - n)[which] - (ends - n_of), n_of) + np.arange(int(ends[-1]))
        self.lane_at = _append(self.lane_at, self.n, self.n_lanes + ends - n_of)
        self.bytes = _append(self.bytes, self.n, size[which])
        self.head = _append(self.head, self.n, lanes[at[ends - n_of]])
        self.lanes = _append(self.lanes, self.n_lanes, lanes[at])
        self.n_lanes += len(at)

    def _same(self, lanes: np.ndarray, n: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each span's bytes are those of the piece that it was looked up as."""
        first = np.cumsum(n) - n
        same = (self.bytes[at] == size) & (self.head[at] == lanes[first])
        if len(lanes) > len(n) and len(longer := np.flatnonzero(same & (n > 1))):
            # The lanes behind the first one, of both sides.
            more = n[longer] - 1
            ends = np.cumsum(more)
            step = np.arange(int(ends[-1])) - np.repeat(ends - more, more) + 1
            theirs = self.lanes[np.repeat(self.lane_at[at[longer]], more) + step]
            same[longer] = np.logical_and.reduceat(theirs == lanes[np.repeat(first[longer], more) + step], ends - more)
        return same

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Add the pieces data[begin:end]. With spaces kept, a piece with other white space at an end
        marks its text for encoding as a whole; so does one that may hold a special token."""
        n = len(begin)
        size = end - begin
        stop = np.cumsum(size)
        first = stop - size
        flat = data[np.repeat(begin - first, size) + np.arange(int(stop[-1]))]
        in_word = _LETTER[flat]
        in_word[:-1][(flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))] = 0  # multiplication and division signs
        letters = np.add.reduceat(in_word, first, dtype=np.int64)
        plain = (flat[first] == 32) & (letters == size - 1) & (size > 1) if self.keep_space else letters == size
        raw = flat.tobytes()
        pieces = {i: raw[a:b].decode() for i, a, b in zip(*(x[~plain].tolist() for x in (np.arange(n), first, stop)), strict=True)}
        odd = np.zeros(n, bool)
        words, rest = [], []
        for i, p in pieces.items():
            w = p[1:] if self.keep_space and p[0] == " " else p
            if w.isalpha() and (w.isascii() or max(w) < "\u0250") and (w is not p or not self.keep_space):
                words.append(i)
            elif "<|" in w or self.keep_space and w != w.strip() and p != "\n":
                odd[i] = True
            else:
                rest.append(i)
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def learned(part, ids: np.ndarray, size_of: np.ndarray) -> None:
            sizes[part] = size_of
            starts[part] = self.n_ids + np.cumsum(size_of) - size_of
            self.flat = _append(self.flat, self.n_ids, ids)
            self.n_ids += len(ids)

        # Short and long words apart: merges take as many rounds as the longest word needs.
        for some in (plain & (size <= SHORT), plain & (size > SHORT)) if self.merges else (plain,):
            which, at_once = np.flatnonzero(some), 4096 if self.merges else 512
            text = flat[np.repeat(some, size)]
            ends = np.cumsum(size[which])
            for i in range(0, len(which), at_once):
                a, b = int(ends[i - 1]) if i else 0, ends[i : i + at_once]
                span = text[a : b[-1]]
                # Words without a space of their own are parted by one.
                joined = span if self.keep_space else np.insert(span, b[:-1] - a, 32)
                part = which[i : i + at_once]
                cut = lambda part=part: [raw[x:y].decode() for x, y in zip(first[part].tolist(), stop[part].tolist(), strict=True)]
                learned(part, *self._words(joined.tobytes().decode(), len(part), cut))
        for i in range(0, len(words), 512):
            part = [pieces[k] for k in words[i : i + 512]]
            learned(words[i : i + 512], *self._words(("" if self.keep_space else " ").join(part), len(part), lambda part=part: part))
        for i in range(0, len(rest), 512):
            learned(rest[i : i + 512], *self._apart([pieces[k] for k in rest[i : i + 512]]))
        self.starts = _append(self.starts, self.n, starts)
        self.sizes = _append(self.sizes, self.n, sizes)
        self.whole = _append(self.whole, self.n, odd)
        self.n += n

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _words(self, text: str, n: int, pieces: Callable[[], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of n (not 0) pieces that are one word each, encoded as
        running text: the words' own marks (a space in front, an end of word) part them."""
        if self.merges:
            data = np.frombuffer(text.encode(), np.uint8)
            size = np.diff(np.flatnonzero(data == 32), append=len(data))
            if len(size) == n and size.max() <= LONGEST:
                return self.merges.encode(data, size)
        ids = self._ids(text)
        at = np.flatnonzero(self.mark[ids])
        if len(at) != n or (at[0] != 0 if self.keep_space else at[-1] != len(ids) - 1):
            return self._apart(pieces())
        return ids, np.diff(at, append=len(ids)) if self.keep_space else np.diff(at, prepend=-1)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any pieces, with a special token between them."""
        ids = self._ids(APART.join(pieces))
        apart = ids == self.apart
        return ids[~apart], np.diff(np.flatnonzero(apart), prepend=-1, append=len(ids)) - 1

    def _cut(self, data: np.ndarray, bounds: np.ndarray):
        """Starts and ends of all pieces, and the texts to be encoded whole."""
        inside = (data != 32) & (data != 10)
        if not self.keep_space:
            kind = _KIND[data]
            # A border inside a run is as good as one beside it.
            open_at = np.concatenate([[True], ~inside[:-1] | (kind[:-1] + kind[1:] == 3)])
            close_at = np.concatenate([open_at[1:] | ~inside[1:], [True]])
            return np.flatnonzero(inside & open_at), np.flatnonzero(inside & close_at) + 1, np.zeros(len(bounds) - 1, bool)
        starts, ends = spans_of(inside)
        # A single space goes to the word behind it, a single line feed is a piece of
        # its own; any other white space between, before or after words is not cut.
        text = np.searchsorted(bounds, starts, "right") - 1
        first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        gap = starts - np.concatenate([[0], ends[:-1]])
        bad = np.zeros(len(bounds) - 1, bool)
        bad[text[~first & (gap != 1)]] = True
        bad[text[first & (starts != bounds[text])]] = True
        last = np.concatenate([first[1:], [True]]) if len(text) else first
        bad[text[last & (ends != bounds[text + 1] - 1)]] = True
        # Texts of nothing but white space have no word.
        bad |= (np.bincount(text, minlength=len(bad)) == 0) & (np.diff(bounds) > 1)
        joined = ~first & (gap == 1)
        feed = np.flatnonzero(joined & (data[starts - 1] == 10))
        starts = np.where(joined & (data[starts - 1] == 32), starts - 1, starts)
        if len(feed):
            at = ends[feed - 1]
            starts, ends = np.insert(starts, feed, at), np.insert(ends, feed, at + 1)
        starts, ends = _at_signs(data, starts, ends)
        return starts, ends, bad

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as int32, number of ids of each text)."""
        parts = [self._encode(texts[i:j]) for i, j in slices(texts, CHUNK_CHARS)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = join_texts(texts)
        if not self.keep_space:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, bad = self._cut(data, bounds)
        size = ends - starts
        lanes, n_lanes = span_lanes(data, starts, ends)
        h = lane_hashes(lanes, n_lanes, size)
        at = self.table.get(h)
        if len(new := np.flatnonzero(at < 0)):
            known, first, number = np.unique(h[new], return_index=True, return_inverse=True)
            if self.n + len(known) > self.limit or not self.table.add(known, self.n):
                self._reset()
                new = np.arange(len(h))
                known, first, number = np.unique(h, return_index=True, return_inverse=True)
                if not self.table.add(known, 0):
                    raise RuntimeError("the look-up table is too small")
            at[new] = number + self.n
            place = new[first]
            self._remember(lanes, n_lanes, size, place)
            self._learn(data, starts[place], ends[place])
        sizes = self.sizes[at]
        counts = np.searchsorted(starts, bounds)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        lengths = np.diff(total[counts])
        # Gather: position within a piece plus the piece's start in the memory.
        out = self.flat[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(int(total[-1]))]
        odd = self.whole[at] | ~self._same(lanes, n_lanes, size, at)
        if odd.any():
            bad[np.searchsorted(bounds, starts[odd], "right") - 1] = True
        if bad.any():
            parts = np.split(out, np.cumsum(lengths)[:-1])
            which = np.flatnonzero(bad).tolist()
            codes = self.tokenizer.encode_batch([texts[i] for i in which], add_special_tokens=False)
            for i, code in zip(which, codes, strict=True):
                parts[i] = np.array(code.ids, np.int32)
                lengths[i] = len(code.ids)
            out = np.concatenate(parts)
        return out, lengths


def encoder(path: str, keep_space: bool) -> Encoder:
    """The encoder of this Python worker; it is kept between tasks of operators on token ids."""
    known = kept("tokens")
    if (path, keep_space) not in known:
        known[path, keep_space] = Encoder(path, keep_space)
    return known[path, keep_space]


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], chars: int = 2_000_000):
    """Cut a list of texts into runs of about so many characters, to bound memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_runs(batch, column: int | str, chars: int = 2_000_000, rows: int = 256):
    """(first row, texts) of a batch in runs of about so many characters; only a run is in Python's memory."""
    held: list[str] = []
    size = first = 0
    for at in range(0, batch.num_rows, rows):
        for i, t in enumerate(batch.column(column).slice(at, rows).to_pylist(), at):
            if held and size + len(t) > chars:
                yield first, held
                held, size, first = [], 0, i
            held.append(t)
            size += len(t)
    if held:
        yield first, held
