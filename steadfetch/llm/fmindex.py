"""FM-index of a shard of documents over word ids: suffix order, wavelet matrix, sampled positions; numpy."""

from __future__ import annotations

import numpy as np

# Every document's first word and every so many-th one after it have their position kept.
SAMPLE = 16
# Occurrences are located in lots of this many.
LOCATED = 1 << 18


def _order(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of `key` in ascending order, and the keys in it; no key is above `most`.

    Where key and place fit one number, sorting the numbers is four times as fast as sorting places.
    """
    bits = max(len(key) - 1, 1).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


def _first(key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of `codes` in their order; the last code must occur once.

    Suffixes are sorted by their first codes, as many as fit a number with the place, then those that
    still agree by twice as many each round. A rank is the first place of a suffix's group, so a
    round moves tied suffixes only.
    """
    n = len(codes)
    bits = max(int(codes.max(initial=0)).bit_length(), 1)
    depth = max((63 - n.bit_length()) // bits, 1)
    key = codes.copy()
    for k in range(1, depth):
        key <<= bits
        key[: max(n - k, 0)] |= codes[k:]
    order, key = _order(key, (1 << bits * depth) - 1)
    first = _first(key)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        start = order[tied]
        by, key = _order(rank[start] * n + rank[np.minimum(start + depth, n - 1)], n * n)
        start = start[by]
        order[tied] = start
        first = _first(key)
        rank[start] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.append(first[1:], True))]
        depth *= 2
    return order


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        # One word more than needed, so that the place behind the last bit has one as well.
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        return cls(np.packbits(padded, bitorder="little").view(np.uint64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Index:
    """Searches and locates runs of word ids in a shard; ids count from 1, 0 stands between documents."""

    def __init__(self, counts: np.ndarray, levels: list[Bits], zeros: list[int], marks: Bits, samples: np.ndarray):
        self.counts, self.levels, self.zeros, self.marks, self.samples = counts, levels, zeros, marks, samples
        self.starts = np.cumsum(counts) - counts
        # Where a symbol's run begins below the last level: symbols lie there by their reversed bits.
        reverse = np.zeros(len(counts), np.int64)
        for k in range(len(levels)):
            reverse |= ((np.arange(len(counts)) >> k) & 1) << (len(levels) - 1 - k)
        by = np.argsort(reverse, kind="stable")
        self.base = np.empty(len(counts), np.int64)
        self.base[by] = np.cumsum(counts[by]) - counts[by]

    @classmethod
    def build(cls, words: np.ndarray, lengths: np.ndarray, most: int) -> Index:
        """Of documents with `lengths` words each that lie one after the other in `words`, ids from 1 to `most`."""
        docs = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.zeros(len(words) + docs, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = words
        # For the order each document's end is a symbol of its own, so that no comparison passes it.
        codes = symbols + (docs - 1)
        codes[ends] = np.arange(docs)
        order = suffix_order(codes)
        last = symbols[order - 1]
        begins = np.repeat(ends - lengths, lengths + 1)
        sampled = ((np.arange(len(symbols)) - begins) % SAMPLE == 0)[order]
        counts = np.bincount(symbols, minlength=most + 1)
        levels, zeros = [], []
        for k in reversed(range(max(int(most).bit_length(), 1))):
            one = (last >> k) & 1 != 0
            levels.append(Bits.of(one))
            zero = last[~one]
            zeros.append(len(zero))
            last = np.concatenate([zero, last[one]])
        return cls(counts, levels, zeros, Bits.of(sampled), order[sampled].astype(np.int32))

    def columns(self) -> list[bytes]:
        """What `load` needs, as bytes."""
        levels = np.concatenate([level.words for level in self.levels])
        return [
            self.counts.astype("<i4").tobytes(), levels.astype("<u8").tobytes(), np.array(self.zeros, "<i4").tobytes(),
            self.marks.words.astype("<u8").tobytes(), self.samples.astype("<i4").tobytes(),
        ]

    @classmethod
    def load(cls, columns: list[bytes]) -> Index:
        counts, levels, zeros, marks, samples = columns
        zeros = np.frombuffer(zeros, "<i4").tolist()
        levels = [Bits(words) for words in np.frombuffer(levels, "<u8").reshape(len(zeros), -1)]
        marks = Bits(np.frombuffer(marks, "<u8"))
        return cls(np.frombuffer(counts, "<i4").astype(np.int64), levels, zeros, marks, np.frombuffer(samples, "<i4"))

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` precedes a suffix among the first `at` ones."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (len(self.levels) - 1 - k)) & 1, zeros + ones, at - ones)
        return at - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes [low, high) that begin with each phrase, by backward search.

        A phrase's ids stand at the right end of its row; an id that is not positive does not occur here.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), int(self.counts.sum()))
        high[lengths == 0] = 0
        open_ = np.flatnonzero(lengths > 0)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            open_ = open_[(lengths[open_] > step) & (low[open_] < high[open_])]
            if not len(open_):
                break
            symbol = phrases[open_, phrases.shape[1] - 1 - step]
            known = symbol > 0
            high[open_[~known]] = low[open_[~known]]
            open_, symbol = open_[known], symbol[known]
            both = self._rank(np.tile(symbol, 2), np.concatenate([low[open_], high[open_]]))
            low[open_] = self.starts[symbol] + both[: len(open_)]
            high[open_] = self.starts[symbol] + both[len(open_) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes at places `rows` of the order begin; walks back to the nearest sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marks.get(at))
        while len(walking):
            place, symbol = at[walking], np.zeros(len(walking), np.int64)
            for bits, zeros in zip(self.levels, self.zeros):
                one, ones = bits.get(place), bits.rank(place)
                symbol = symbol << 1 | one
                place = np.where(one, zeros + ones, place - ones)
            at[walking] = self.starts[symbol] + place - self.base[symbol]
            steps[walking] += 1
            walking = walking[~self.marks.get(at[walking])]
        return self.samples[self.marks.rank(at)] + steps

    def occurrences(self, low: np.ndarray, high: np.ndarray):
        """(phrase, position) of everything in the ranges, in lots of a bounded size."""
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, LOCATED):
            number = np.arange(begin, min(begin + LOCATED, total))
            phrase = np.searchsorted(ends, number, "right")
            yield phrase, self.locate(low[phrase] + number - (ends[phrase] - counts[phrase]))
