"""Weighted word shingles, ProbMinHash signatures of them, and exact similarities; numpy on batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
REGISTERS = 160
BANDS, ROWS = 64, 7
# Bits of a register that the short signature keeps.
SHORT_BITS = 2

_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(8)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of a common public generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places() -> np.ndarray:
    """Which registers each band reads: shuffled registers cut in runs, shuffled anew when used up, so all are read as often."""
    runs = REGISTERS // ROWS
    with np.errstate(over="ignore"):
        draws = _mix(np.arange(1, -(-BANDS // runs) * REGISTERS + 1, dtype=np.uint64) * _ODD[6]).reshape(-1, REGISTERS)
    shuffled = np.argsort(draws, axis=1, kind="stable")
    return shuffled[:, : runs * ROWS].reshape(-1, ROWS)[:BANDS]


PLACES = _places()


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, times) of every distinct shingle, sorted by document and hash.

    Words lie between white space; a shingle is 5 words in a row, or all words of a shorter text. A
    text without words has none.
    """
    trimmed = pc.utf8_trim(pc.fill_null(texts, ""), characters=" \t\n\x0b\x0c\r")
    split = pc.ascii_split_whitespace(trimmed)
    lengths = np.where(pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
    flat = pc.filter(split.flatten(), pc.not_equal(split.flatten(), ""))
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes = known[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(hashes))
    last = ends[doc] - 1 if len(doc) else doc
    size = np.minimum(lengths, SHINGLE)[doc] if len(doc) else doc
    begins = at + size - 1 <= last
    # A short text has one shingle, at its first word.
    begins &= (size == SHINGLE) | (at == last - size + 1)
    start = at[begins]
    value = size[begins].astype(np.uint64)
    for k in range(SHINGLE):
        place = np.minimum(start + k, max(len(hashes) - 1, 0))
        value += np.where(k < size[begins], hashes[place] * _ODD[k], np.uint64(0))
    doc, value = doc[begins], _mix(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if not len(doc):
        return doc, value, np.zeros(0, np.int64)
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    where = np.flatnonzero(first)
    return doc[where], value[where], np.diff(np.append(where, len(doc)))


def weights(times: np.ndarray) -> np.ndarray:
    """A repeated shingle counts more, but not in proportion."""
    return 1.0 + np.log(times)


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: per document and register the shingle that arrives first.

    Each shingle sends arrivals to random registers, as a Poisson process whose rate is its weight and
    whose randomness depends on the shingle alone. Two documents agree in a register with the
    probability Jaccard similarity of their weights. Arrivals come in rounds, one per shingle that is
    still early enough to win any register of its document; when all are late the document is done.
    """
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    latest = np.full(docs, np.inf)
    clock = np.zeros(len(doc))
    step = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(doc):
            step += np.uint64(0x9E3779B97F4A7C15)
            draw = _mix(value + step)
            wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            clock = clock + wait / weight
            early = clock < latest[doc]
            doc, value, weight, clock, draw = doc[early], value[early], weight[early], clock[early], draw[early]
            register = (_mix(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
            place = doc * registers + register
            np.minimum.at(first, place, clock)
            won = first[place] == clock
            winner[place[won]] = value[won]
            seen = np.flatnonzero(np.bincount(doc, minlength=docs)) if len(doc) else doc
            latest[seen] = first.reshape(docs, registers)[seen].max(axis=1)
            still = clock < latest[doc]
            doc, value, weight, clock = doc[still], value[still], weight[still], clock[still]
    return winner.reshape(docs, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of registers; equal in two documents that agree in all of the band."""
    with np.errstate(over="ignore"):
        mixed = np.zeros((len(signature), BANDS), np.uint64)
        for k in range(ROWS):
            mixed += _mix(signature[:, PLACES[:, k]] + np.uint64(k + 1)) * _ODD[k]
        return _mix(mixed + np.arange(BANDS, dtype=np.uint64) * _ODD[7]).view(np.int64)


def short_signature(signature: np.ndarray) -> np.ndarray:
    """Two bits per register, 32 registers to a 64-bit number."""
    bits = (_mix(signature) & np.uint64((1 << SHORT_BITS) - 1)).reshape(len(signature), -1, 64 // SHORT_BITS)
    return (bits << np.arange(0, 64, SHORT_BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def differing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many registers of short signatures differ."""
    differ = one ^ other
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def estimate(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity by short signatures; the chance that bits agree by accident is taken off."""
    agree = 1 - differing(one, other) / REGISTERS
    by_chance = 0.5**SHORT_BITS
    return (agree - by_chance) / (1 - by_chance)


def likely(one: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of (weighted, plain) short signatures allow a similarity of `least`.

    Five standard errors of slack: a pair at the bound is lost once in millions.
    """
    share = least + (1 - least) * 0.5**SHORT_BITS
    slack = 5 * np.sqrt(share * (1 - share) / REGISTERS) / (1 - 0.5**SHORT_BITS)
    half = one.shape[1] // 2
    return np.maximum(estimate(one[:, :half], other[:, :half]), estimate(one[:, half:], other[:, half:])) >= least - slack


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(Jaccard of the shingle sets, probability Jaccard of their weights), exact."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(ia)
    if not len(ia):
        return 0.0, 0.0
    x, y = a[1][ia], b[1][ib]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # For shingle d all shingles with a larger ratio x/y count by x, the others by y.
    from_here = np.cumsum(x[::-1])[::-1] + only_x
    up_to = np.cumsum(y) - y + only_y
    return len(ia) / union, float((1.0 / (from_here / x + up_to / y)).sum())
