"""Vectorised 64-bit hashes of the words of many texts at once.

A word is taken in blocks of eight bytes; each block is mixed into the hash by a step that
is one-to-one in the block and in the hash so far. Words of up to eight bytes, and words of
one length that differ in one block, thus never collide; all others do with a chance of
about 2**-64, repetitive words among them.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] for each span."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from every place
    length = ends - starts
    h = length.astype(np.uint64) * _BASE
    left, at = np.arange(len(starts)), starts
    done = 0
    while len(left):
        size = length[left] - done
        block = blocks[at] & _FIRST[np.minimum(size, 8)]
        g = (h[left] ^ block) * _STEP[0]
        g = (g ^ (g >> np.uint64(32))) * _STEP[1]
        h[left] = g ^ (g >> np.uint64(29))
        more = size > 8
        left, at, done = left[more], at[more] + 8, done + 8
    return mix(h)


#: Bytes that end a word: space and 0x09-0x0D.
SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_BYTE = np.arange(256).astype(np.uint8)
LOWER_BYTE[ord("A") : ord("Z") + 1] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each text, and word offsets by text.

    data holds the UTF-8 bytes of all texts, text i being data[offsets[i]:offsets[i+1]].
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE_BYTE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    start[firsts] = word[firsts]
    end = word.copy()
    end[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    end[lasts] = word[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(LOWER_BYTE[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles of one text, sorted.

    A text with fewer words than size has one shingle, its whole word sequence.
    """
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * _BASE + words[k : n - width + 1 + k]
    return np.unique(mix(total))
