"""Token ids of many texts, computed once for each distinct piece between which the tokenizer never merges.

A byte-level BPE tokenizer first cuts a text into pieces (words with the space before
them, numbers, punctuation, white space) and merges only inside a piece. Pieces are found
for a whole batch with array operations, hashed, and only those not seen before go
through the tokenizer's model. Strings of added tokens (`<|endoftext|>`) get their own id, as
the tokenizer as loaded gives it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from cashweave.llm.common import mix, segment_hash_of

# Fixed values of the tokenizer's cutting rule: the endings that stay with an apostrophe.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, WHITE, OTHER = range(4)
KNOWN_PIECES = 1_000_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First code point of each piece; `bounds` are the texts' starts and the end. A piece lies in one text."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    kinds, length = kind[starts], ends - starts
    keep = np.zeros(n + 1, bool)
    keep[starts] = True
    # white space: its last character leads the next piece or stands alone
    at = np.flatnonzero((kinds == WHITE) & ~first[ends])
    last = ends[at] - 1
    leads = points[last] == 32
    keep[last] = True
    keep[ends[at][leads]] = False
    # an apostrophe by itself takes a short ending with it
    alone = (kinds == OTHER) & (length == 1) & (points[starts] == 39) & keep[starts] & ~first[ends]
    for i in np.flatnonzero(alone):
        a, b = ends[i], ends[i] + length[i + 1]
        if kinds[i + 1] != LETTER:
            continue
        head = "".join(map(chr, points[a : min(b, a + 2)]))
        size = 1 if head[0] in ENDINGS_1 else 2 if head in ENDINGS_2 else 0
        if size:
            keep[a] = False
            if a + size < b:
                keep[a + size] = True
    return np.flatnonzero(keep[:n])


class Encoder:
    """Ids of batches of texts by a `tokenizers` file of a byte-level BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        # a text is first cut at the strings of added tokens, the longest at each place
        self.added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = ["?"] * 256
        for byte in range(128):
            table[byte] = letters.pre_tokenize_str(chr(byte))[0][0]
        for point in range(128, 0x800):  # two-byte characters show what each higher byte is written as
            for byte, letter in zip(chr(point).encode(), letters.pre_tokenize_str(chr(point))[0][0], strict=True):
                table[byte] = letter
        for lead in range(0xE1, 0xF0):
            table[lead] = letters.pre_tokenize_str(chr((lead - 0xE0) << 12))[0][0][0]
        table[0xE0] = letters.pre_tokenize_str("ࠀ")[0][0][0]
        for lead in range(0xF0, 0xF5):
            table[lead] = letters.pre_tokenize_str(chr(max(0x10000, (lead - 0xF0) << 18)))[0][0][0]
        self.table = {byte: letter for byte, letter in enumerate(table)}
        self.forget()

    def forget(self) -> None:
        """Known pieces: sorted hashes, and where in `ids` the ids of each begin and how many they are."""
        self.keys = np.empty(0, np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        tokenize, table, ids, sizes = self.model.tokenize, self.table, [], []
        for piece in pieces:
            found = tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(table))
            sizes.append(len(found))
            ids += [t.id for t in found]
        size = np.array(sizes, np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.begin, begin), (self.size, size)))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(code points, their bounds by text) and what `encode` gives, with the ids of added tokens where their strings stand."""
        points, bounds = code_points(texts)
        if self.cut is None or not any(a in t for a in self.added for t in texts):
            return points, bounds, *self.encode(points, bounds)
        parts = [self.cut.split(t) for t in texts]
        flat = [p for own in parts for p in own]
        part_bounds = np.concatenate(([0], np.cumsum([len(p) for p in flat])))
        added = np.array([self.added.get(p, -1) for p in flat], np.int64)
        ids, firsts, starts, edges = self.encode(points, part_bounds, added)
        heads = np.concatenate(([0], np.cumsum([len(own) for own in parts])))
        return points, bounds, ids, firsts[heads], starts, edges

    def encode(
        self, points: np.ndarray, bounds: np.ndarray, added: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end, piece starts, first id of each piece and the end).

        A text with `added` of 0 or more is an added token of that id, on its first piece.
        """
        starts = piece_starts(points, bounds)
        if len(starts) == 0:
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64), starts, np.zeros(1, np.int64)
        ends = np.append(starts[1:], len(points))
        keys, firsts, inverse = np.unique(
            segment_hash_of(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends), return_index=True, return_inverse=True
        )
        if len(self.keys) > KNOWN_PIECES:
            self.forget()
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        new = order[(at == len(self.keys)) | (np.append(self.keys, np.uint64(0))[at] != keys[order])] if len(self.keys) else order
        if len(new):
            text = points.tobytes().decode("utf-32-le", "surrogatepass")
            first = firsts[new]
            self._learn(keys[new], [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        places = np.searchsorted(self.keys, keys)
        at = places[inverse]
        lengths = self.size[at]
        if added is not None:
            text = np.searchsorted(bounds, starts, side="right") - 1
            whole = added[text] >= 0
            head = whole & np.append(True, text[1:] != text[:-1])
            lengths = np.where(head, 1, np.where(whole, 0, lengths))
        edges = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        ids = self.ids[np.arange(edges[-1]) + np.repeat(self.begin[at] - edges[:-1], lengths)]
        if added is not None:
            ids[edges[:-1][head]] = added[text[head]]
        return ids, edges[np.searchsorted(starts, bounds)], starts, edges


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the starts of the texts and the end."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds
