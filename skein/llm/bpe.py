"""Byte-pair merges of many words side by side, in numpy."""

from __future__ import annotations

import json

import numpy as np

#: The rank of a pair that no merge joins.
NONE = np.int32(1 << 30)
#: Bytes of a word that is merged here; longer ones are left to the library.
LONGEST = 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level vocabulary: in each word the pair of least rank is joined, the leftmost first, until none is left."""

    def __init__(self, model: dict) -> None:
        vocabulary, letters = model["vocab"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.size = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] for a, _ in pairs], np.int64) * self.size + np.array([vocabulary[b] for _, b in pairs], np.int64)
        # Open addressing: a pair stands in the first free slot from its hash on.
        self.bits = max(8, int(8 * len(keys)).bit_length())
        self.key, self.rank = np.full((1 << self.bits) + 1, -1, np.int64), np.full((1 << self.bits) + 1, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[at] < 0
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            self.key[at[mine]], self.rank[at[mine]] = keys[todo[mine]], todo[mine]
            todo, at = todo[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """The merges of a tokenizer file, or None where its model has other steps than plain merges of bytes."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "fuse_unk")
        return None if model.get("type") != "BPE" or any(model.get(x) for x in odd) else cls(model)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; a missing right one is negative."""
        keys = a.astype(np.int64) * self.size + b
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((b >= 0) & (a >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            key = self.key[at]
            hit = key == keys[todo]
            out[todo[hit]] = self.rank[at[hit]]
            more = ~hit & (key >= 0)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words that begin there in data, and how many each has. Words have 1 to LONGEST bytes; those of like lengths are merged together."""
        out, size = np.full((len(begin), LONGEST), -1, np.int32), np.zeros(len(begin), np.int64)
        with np.errstate(over="ignore"):
            for lo, hi in ((0, 6), (6, 10), (10, 16), (16, 24), (24, LONGEST)):
                some = np.flatnonzero((length > lo) & (length <= hi))
                if len(some):
                    self._merge(data, begin[some], length[some], some, out)
        size[:] = (out >= 0).sum(1)
        return out[out >= 0], size

    def _merge(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
        wide = int(length.max())
        column = np.arange(wide)
        inside = column < length[:, None]
        symbol = np.where(inside, self.inner[data[np.minimum(begin[:, None] + column, len(data) - 1)]], np.int32(-1))
        symbol[np.arange(len(begin)), length - 1] = self.last[data[begin + length - 1]]
        right = np.concatenate([symbol[:, 1:], np.full((len(symbol), 1), -1, np.int32)], 1)
        rank = self.ranks(symbol.ravel(), right.ravel()).reshape(symbol.shape)
        while len(place):
            at = rank.argmin(1)
            least = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            more = least < NONE
            if not more.all():
                out[place[~more], : symbol.shape[1]] = symbol[~more]
                symbol, rank, place, at, least = symbol[more], rank[more], place[more], at[more], least[more]
                if not len(place):
                    break
            # Every word left loses one symbol.
            behind = column[: symbol.shape[1] - 1] > at[:, None]
            symbol, rank = np.where(behind, symbol[:, 1:], symbol[:, :-1]), np.where(behind, rank[:, 1:], rank[:, :-1])
            row, new = np.arange(len(place)), self.joined[least]
            symbol[row, at] = new
            next_ = np.where(at + 1 < symbol.shape[1], symbol[row, np.minimum(at + 1, symbol.shape[1] - 1)], np.int32(-1))
            rank[row, at] = self.ranks(new, next_)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.ranks(symbol[has, at[has] - 1], new[has])
