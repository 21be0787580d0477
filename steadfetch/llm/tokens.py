"""Token ids of whole texts, many texts at once.

The tokenizers of this kind split at white space, so a text's ids are those of its chunks one after
the other, and a slice of texts needs each different chunk once. Chunks of plain letters, digits and
punctuation are cut into words and marks by the tokenizer's own pattern; words seen before come from
a bounded cache, new ones are encoded together. Arrow and numpy put the ids back in the texts' order.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The split pattern of the tokenizer (a fixed value), narrowed to letters with one code point in
# Latin-1, ASCII digits and ASCII punctuation, and to lines; other chunks go to the tokenizer whole.
_PLAIN = "\\A[A-Za-z0-9À-ÖØ-öø-ÿ!-/:-@\\[-`{-~]+\\z"
_MARKS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
# Cached words, half of them in the older part; the words of one slice come on top.
MOST_CACHED = 1 << 18
# New words that are encoded as one text.
TOGETHER = 256
# Texts are encoded in slices of at most this many, and about as many bytes.
SLICE_DOCS, SLICE_BYTES = 8192, 1 << 21


def slices(texts: pa.Array, docs: int = SLICE_DOCS, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Where slices begin and end; a text longer than a slice is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = min(begin + docs, max(begin + 1, int(np.searchsorted(sizes, base + size, "right"))))
        yield begin, end
        begin = end


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` that `codes` name, one after the other, and where each of them ends."""
    length = counts[codes]
    ends = np.cumsum(length)
    shift = np.repeat(starts[codes] - (ends - length), length)
    return flat[shift + np.arange(len(shift))], ends


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), np.uint32), np.cumsum(counts) - counts, counts


def _strings(found: pa.Array) -> list[str]:
    """The values of an array without nulls; `to_pylist` makes a scalar of each first, which takes several times as long."""
    return found.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts by a tokenizer file."""

    def __init__(self, path: str):
        # Spark has a worker per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        # Which ids end a word; without such a mark words cannot be encoded as one text.
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self._last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        # Words of plain chunks are in normal form already: the same model and pattern without the normalizer.
        self._word_tokenizer = Tokenizer(self._tokenizer.model)
        self._word_tokenizer.pre_tokenizer = self._tokenizer.pre_tokenizer
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _encode(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self._tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        lots = [words[begin : begin + TOGETHER] for begin in range(0, len(words), TOGETHER)]
        for some, data in zip(lots, self._encode([" ".join(some) for some in lots], self._word_tokenizer)):
            ends = 4 * (np.flatnonzero(self._last[np.frombuffer(data, np.uint32)]) + 1)
            if len(ends) != len(some) or ends[-1] != len(data):
                out += self._encode(some)
                continue
            cuts = [0, *ends.tolist()]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        # Words that were not seen since the parts last changed go; the frequent ones stay.
        if len(self._words) > MOST_CACHED // 2:
            self._older, self._words = self._words, {}
        parts = [self._words.get(w) or self._older.get(w) for w in words]
        new = [k for k, part in enumerate(parts) if part is None]
        for k, part in zip(new, self._encode_words([words[k] for k in new])):
            parts[k] = part
        self._words.update(zip(words, parts))
        return parts

    def _of_chunks(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different chunks: all ids, and where each chunk's begin and how many they are."""
        chunks = _strings(found)
        plain = pc.match_substring_regex(found, _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        # Every plain chunk is followed by a line end, which has no ids.
        lines = "\n".join(chunks) + "\n"
        if any(s in lines for s in self._special):
            plain &= np.fromiter((not any(s in c for s in self._special) for c in chunks), bool, len(chunks))
        rest = []
        if not plain.all():
            rest = [chunks[k] for k in np.flatnonzero(~plain).tolist()]
            lines = "".join([chunks[k] + "\n" for k in np.flatnonzero(plain).tolist()])
        flat, starts, counts = _joined(self._encode(rest) if rest else [])
        all_starts, all_counts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        all_starts[~plain], all_counts[~plain] = starts, counts
        if not plain.any():
            return flat, all_starts, all_counts
        coded = pa.array(_MARKS.findall(lines.lower()), pa.string()).dictionary_encode()
        words, codes = _strings(coded.dictionary), coded.indices.to_numpy()
        line_end = words.index("\n")
        parts = self._of_words([*words[:line_end], *words[line_end + 1 :]])
        parts.insert(line_end, b"")
        ids, ends = _gather(*_joined(parts), codes)
        ends = ends[codes == line_end]
        begins = np.concatenate([[0], ends[:-1]])
        all_starts[plain], all_counts[plain] = begins + len(flat), ends - begins
        return np.concatenate([flat, ids]), all_starts, all_counts

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their bounds: text k has those from bounds[k] to bounds[k + 1].

        A null text has no ids.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        found = self._of_chunks(coded.dictionary)
        ids, ends = _gather(*found, coded.indices.to_numpy())
        at = split.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate([[0], ends])[at - at[0]]

    def ids(self, text: str) -> bytes:
        """One text's ids as bytes, four per id, little endian."""
        return self.batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)
