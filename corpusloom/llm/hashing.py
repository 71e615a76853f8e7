"""Hashes of many byte spans at once, and the spans themselves as 8-byte lanes.

A span is cut into lanes of eight bytes, the last one filled with zeros. Each lane
is mixed with the key of its place before the lanes are added up, so no shift or
exchange of bytes cancels out; the length enters last. Equal lanes and equal
lengths mean equal bytes, which lets a caller check what a hash found.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIZE = np.uint64(0xD6E8FEB86659FD93)
#: By bytes in a last lane: what of it belongs to the span; 0 stands for a full one.
_MASK = np.array([(1 << 64) - 1, *((1 << 8 * k) - 1 for k in range(1, 8))], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lanes of all spans in a row, number of lanes of each). Spans are not empty."""
    size = ends - starts
    n = (size + 7) >> 3
    upto = np.cumsum(n)
    at = np.repeat(starts - 8 * (upto - n), n) + 8 * np.arange(int(upto[-1]) if len(upto) else 0)
    words = np.zeros((len(data) >> 3) + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    # A shift by 64 gives 0.
    lanes = (words[word] >> shift) | (words[word + 1] << (np.uint64(64) - shift))
    lanes[upto - 1] &= _MASK[size & 7]
    return lanes, n


def lane_hashes(lanes: np.ndarray, n: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span from its lanes and its bytes."""
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = (np.arange(len(lanes)) - np.repeat(first, n) + (seed + 1)).astype(np.uint64)
    keyed = mix(lanes ^ (place * _GOLDEN))
    total = np.add.reduceat(keyed, first) if len(lanes) > len(n) else keyed
    return mix(total + size.astype(np.uint64) * _SIZE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span."""
    return lane_hashes(*span_lanes(data, starts, ends), ends - starts, seed)


def join_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a line feed behind each, and where each begins."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
