"""Token ids of whole texts for the word-level BPE vocabulary, a batch at a time.

The vocabulary's rule cuts lower-cased text into words before it merges pairs, so the
ids of a text are those of its words in order. Words of a batch are found and hashed
with numpy, looked up in a table of words met before, and only new words go through
the tokenizer. Texts with characters outside the first 304 code points, or that hold a
special token, go through the tokenizer as they are. Either way the ids are the same.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .wordhash import span_hashes

EDGE = 304
SLICE_CHARS = 400_000
SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)
#: Contractions that the vocabulary's pattern takes as one word, after the apostrophe.
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(EDGE, dtype=np.uint32), np.full(EDGE, OTHER, np.uint8)
    for i in range(EDGE):
        c = chr(i)
        if len(c.lower()) == 1 and ord(c.lower()) < EDGE:
            lower[i] = ord(c.lower())
        elif c.lower() != c:
            kind[i] = STRANGE
            continue
        group = unicodedata.category(c)
        if c in " \t\n\r\x0b\x0c":
            kind[i] = SPACE
        elif group[0] == "C" or c.isspace():
            kind[i] = STRANGE
        elif group[0] == "L":
            kind[i] = LETTER
        elif group[0] == "N":
            kind[i] = NUMBER
    return lower, kind


LOWER, KIND = _tables()


class WordTable:
    """Open-addressing table from word hash to a run of ids."""

    def __init__(self, bits: int = 16):
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.starts, self.ids, self.count, self.filled = np.zeros(1 << bits, np.int64), np.zeros(4 << bits, np.int32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is new."""
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = numbers[free]  # of several for one place the last one stays
            won = free[self.slots[at[free]] == numbers[free]]
            self.keys[at[won]] = keys[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Add new, distinct words with the runs of ids that they stand for."""
        total = self.count + len(keys)
        if total + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(total, len(self.starts)), np.int64)])
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.int32)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        numbers = np.arange(self.count, total, dtype=np.int32)
        self.starts[self.count + 1 : total + 1] = self.filled + np.cumsum(lengths)
        self.count, self.filled = total, self.filled + len(ids)
        if total * 2 > len(self.keys):
            full = self.slots >= 0
            old_keys, old = self.keys[full], self.slots[full]
            size = len(self.keys)
            while total * 2 > size:
                size *= 4
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._place(old_keys, old)
        self._place(keys, numbers)


class WordTokenizer:
    """Token ids of texts; keeps at most most_words words and then begins anew.

    Workers are used again from task to task and keep their table, so its bound is a
    worker's memory: below 2**19 words with what a slice adds, the table stays at 2**20
    places and about 30 MB, whatever a worker has read.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, lengths = [], []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            got = self._whole(" ".join(part))
            stops = np.flatnonzero(self.ends[got])
            if len(stops) == len(part) and (not len(got) or stops[-1] == len(got) - 1):
                ids.append(got)
                lengths.append(np.diff(stops, prepend=-1))
            else:  # a word that the vocabulary has no end for
                each = [self._whole(w) for w in part]
                ids += each
                lengths.append(np.array([len(x) for x in each]))
        self.table.add(keys, np.concatenate(lengths), np.concatenate(ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        low = 0
        while low < len(texts):
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= SLICE_CHARS:
                size += len(texts[high])
                high += 1
            out += self._encode_slice(texts[low:high])
            low = high
        return out

    def _encode_slice(self, texts: list[str]) -> list[np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        n = len(points)
        kind = np.full(n + 1, SPACE, np.uint8)
        inside = np.minimum(points, EDGE - 1)
        kind[:n] = np.where(points < EDGE, KIND[inside], STRANGE)
        low = LOWER[inside]
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(kind[:n] == STRANGE), side="right") - 1).tolist()
        odd = set(odd) | {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:n] != kind[: n - 1]
        start[offsets] = True
        start |= kind == NUMBER
        start[n] = True
        for p in np.flatnonzero(low == ord("'")).tolist():
            if not start[p] or not start[p + 1] or kind[p + 1] != LETTER:
                continue  # in a longer run of signs, or no letter follows in this text
            q = min(p + 3, int(offsets[np.searchsorted(offsets, p, side="right")]))
            tail = "".join(map(chr, low[p + 1 : q]))
            cut = 1 if tail[:1] in SHORT else 2 if tail in LONG else 0
            if cut:
                start[p + 1] = False
                start[p + 1 + cut] = True
        at = np.flatnonzero(start)
        begins, stops = at[:-1], at[1:]
        word = kind[begins] != SPACE
        begins, stops = begins[word], stops[word]
        keys = span_hashes(low.astype("<u2").view(np.uint8), 2 * begins, 2 * stops)  # two bytes a character
        if self.table.count > self.most_words:
            self.table = WordTable()
        numbers = self.table.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            whole = low.tobytes().decode("utf-32-le")
            self._learn(fresh, [whole[begins[i] : stops[i]] for i in new[first].tolist()])
            numbers = self.table.find(keys)
        begin = self.table.starts[numbers]
        lengths = self.table.starts[numbers + 1] - begin
        ends = np.cumsum(lengths)
        ids = self.table.ids[np.repeat(begin - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.searchsorted(begins, offsets)]
        return [self._whole(t) if i in odd else ids[edges[i] : edges[i + 1]] for i, t in enumerate(texts)]
