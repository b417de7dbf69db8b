"""Vectorised words, shingles and 64-bit hashes over Arrow string arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
MULTIPLIER = _U(0x9E3779B97F4A7C15)


def times(k: int) -> np.uint64:
    """k * MULTIPLIER modulo 2^64."""
    return _U(k * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the public SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string; equal strings are hashed once."""
    coded = values.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(v, seed) for v in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the texts, and where each text's words begin and end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    ends = parts.offsets.to_numpy().astype(np.int64)
    words = parts.values.slice(ends[0], ends[-1] - ends[0]) if len(ends) else parts.values
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        words = words.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    return words, ends


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    words, ends = split_words(texts, lower)
    return hash_values(words), ends


def gram_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows; a text of 1 to k - 1 words gives its whole sequence as one."""
    n = np.diff(ends)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(ends[:-1] - starts[:-1], count) + np.arange(starts[-1])
    span = np.repeat(np.minimum(n, k), count)
    out = span.astype(np.uint64)
    for i in range(k):
        at = first + i
        inside = i < span
        step = mix((out * MULTIPLIER) ^ words[np.where(inside, at, 0)]) if len(words) else out
        out = np.where(inside, step, out)
    return out, starts


def distinct_per_text(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted."""
    own = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        x = np.sort(values[a:b])
        own.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return (np.concatenate(own) if own else values[:0]), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]).astype(np.int64)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, ends = word_hashes(texts)
    return distinct_per_text(*gram_hashes(words, ends, k))
