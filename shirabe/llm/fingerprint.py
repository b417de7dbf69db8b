"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's lines are cut into paragraphs after words whose hash says so, at every line's end and where a paragraph grows
too long, so an edit changes only the paragraphs it touches. Each paragraph's digest, numbered if it repeats, goes into
three cells of a sketch (count, XOR of digests; a digest holds its own check bits). A fingerprint is the sketch of all
paragraphs, with as many cells as listing them takes: peeling cells that hold one digest recovers every digest.

Two fingerprints are compared by themselves: the larger sketch is folded to the size of the smaller, cells are
subtracted, and peeling recovers the digests that only one text has. Where that fails, because too much differs, both
are listed and sketched again, larger, until peeling comes out whole. The likeness is the shared part of both texts'
paragraphs. Sketches of a whole batch are built, subtracted and peeled together.

A document's edited text takes from the next document in descending doc_id order, the first after the last. One
range-dealt shuffle puts neighbours side by side; each range's head is sent to the range before it as well.

Defined results: null text is empty; empty texts have no paragraphs, and two texts without any are alike (1.0); rows
that repeat a doc_id follow each other ordered by a hash of their text; rows with null doc_id come after all others, in
the order of that hash, in ranges of it; a lone document is its own next; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MULTIPLIER, hash_values, mix, split_words, times

#: A third of a sketch has 2^LEAST_THIRD cells at least; a sketch is made with at least ROOM cells a digest.
LEAST_THIRD, ROOM = 2, 1.5
#: A paragraph ends after one word in so many on average, and after so many at last.
PARAGRAPH_WORDS, MOST_WORDS = 12, 32
#: Ranges of the hash that rows without doc_id are dealt by.
NULL_RANGES = 64
_U = np.uint64
_CELL = np.dtype([("n", "i1"), ("key", "<u8")])


def paragraph_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' paragraphs (48 bits, then 16 check bits), repeats numbered, and where each text's begin and end."""
    # a visible mark keeps line ends apart from blanks
    words, ends = split_words(pc.replace_substring(texts, "\n", " \x1f "), lower=False)
    hashes = hash_values(words)
    n = len(ends) - 1
    if not len(hashes):
        return hashes, np.zeros(n + 1, np.int64)
    line_end = hashes == hash_values(pa.array(["\x1f"]))[0]
    cut_after = (mix(hashes) % _U(PARAGRAPH_WORDS) == 0) | line_end
    cut_after[:-1] &= ~line_end[1:]  # a line's end belongs to its last words
    cut_after |= line_end
    last = ends[1:][np.diff(ends) > 0] - 1
    cut_after[last] = True
    for _ in range(2):  # the second time with the cuts that only the length asks for
        begins = np.concatenate([[0], np.flatnonzero(cut_after)[:-1] + 1])
        place = np.arange(len(hashes)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(hashes)]])))
        cut_after |= place % MOST_WORDS == MOST_WORDS - 1
    digests = np.add.reduceat(mix(hashes + (place + 1).astype(np.uint64) * MULTIPLIER), begins)
    starts = np.searchsorted(begins, ends)
    text = np.repeat(np.arange(n), np.diff(starts))
    order = np.lexsort((digests, text))
    d, t = digests[order], text[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    out = _checked(mix(d + (np.arange(len(d)) - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    order = np.lexsort((out, t))
    out, t = out[order], t[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (t[1:] != t[:-1])])  # of two that agree in 48 bits one counts
    return out[new], np.searchsorted(t[new], np.arange(n + 1))


def _checked(values: np.ndarray) -> np.ndarray:
    """The upper 48 bits with their check bits behind them."""
    upper = values >> _U(16) << _U(16)
    return upper | mix(upper ^ _U(0xA5A5A5A5DEADBEEF)) >> _U(48)


def _at(digests: np.ndarray, turn: int, third: np.ndarray) -> np.ndarray:
    """The cell that a digest takes in one third of 2^third cells; a smaller sketch takes its lower bits."""
    return (mix(digests + times(turn + 1)) & ((_U(1) << third.astype(np.uint64)) - _U(1))).astype(np.int64) + (turn << third)


@dataclass
class Sketches:
    """Sketches laid end to end: 3 * 2^third[i] cells from base[i]."""

    third: np.ndarray
    base: np.ndarray
    count: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, digests: np.ndarray, owner: np.ndarray, third: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        out = cls.empty(third)
        if len(digests):
            out.add(digests, owner, np.broadcast_to(np.asarray(sign, np.int32), len(digests)))
        return out

    @classmethod
    def empty(cls, third: np.ndarray) -> Sketches:
        third = np.asarray(third, np.int64)
        base = np.concatenate([[0], np.cumsum(3 << third)]).astype(np.int64)
        return cls(third, base, np.zeros(base[-1], np.int32), np.zeros(base[-1], np.uint64))

    def add(self, digests: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Put digests in (sign 1) or take them out (-1); the cells touched."""
        touched = np.concatenate([_at(digests, k, self.third[owner]) + self.base[owner] for k in range(3)])
        np.add.at(self.count, touched, np.tile(sign, 3))
        np.bitwise_xor.at(self.key, touched, np.tile(digests, 3))
        return touched

    def take(self, which: np.ndarray) -> Sketches:
        out = Sketches.empty(self.third[which])
        at = np.arange(out.base[-1]) + np.repeat(self.base[which] - out.base[:-1], 3 << out.third)
        out.count[:], out.key[:] = self.count[at], self.key[at]
        return out

    def fold(self, third: np.ndarray) -> Sketches:
        """The same sets in sketches of 2^third cells a third, which is at most their own."""
        out = Sketches.empty(third)
        size = 3 << self.third
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(self.base[-1]) - self.base[:-1][owner]
        turn, place = at >> self.third[owner], at & ((1 << self.third[owner]) - 1)
        to = out.base[owner] + (turn << out.third[owner]) + (place & ((1 << out.third[owner]) - 1))
        np.add.at(out.count, to, self.count)
        np.bitwise_xor.at(out.key, to, self.key)
        return out

    def minus(self, other: Sketches) -> Sketches:
        """Of sketches of equal sizes: what each holds and the other does not, and (count -1) the other way round."""
        return Sketches(self.third, self.base, self.count - other.count, self.key ^ other.key)

    def guess(self) -> np.ndarray:
        """About how many digests each sketch holds, from its empty cells; infinite where none is empty."""
        empty = np.add.reduceat((self.count == 0) & (self.key == 0), self.base[:-1]) if len(self.third) else np.zeros(0)
        with np.errstate(divide="ignore"):
            return -np.log(empty / (3 << self.third)) * (1 << self.third)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owners, digests and signs recovered (the sketches are emptied), and which of them came out whole."""
        own = np.repeat(np.arange(len(self.third)), 3 << self.third)
        found, look = [], np.flatnonzero(self.count)
        for _ in range(1000):
            look = look[np.abs(self.count[look]) == 1]
            digest, who = self.key[look], own[look]
            turn = (look - self.base[who]) >> self.third[who]
            right = digest == _checked(digest)
            for k in range(3):  # a digest stands where it belongs
                right &= (turn != k) | (_at(digest, k, self.third[who]) + self.base[who] == look)
            if not right.any():
                break
            who, digest, sign = who[right], digest[right], self.count[look[right]]
            order = np.lexsort((digest, who))
            new = np.concatenate([[True], (np.diff(who[order]) != 0) | (digest[order][1:] != digest[order][:-1])])
            order = order[new]
            found.append((who[order], digest[order], sign[order]))
            look = np.sort(self.add(digest[order], who[order], -sign[order]))
            look = look[np.concatenate([[True], np.diff(look) != 0])]
        whole = np.ones(len(self.third), bool)
        whole[own[(self.count != 0) | (self.key != 0)]] = False
        who, digest, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return who, digest, sign, whole


def third_for(digests: np.ndarray | float) -> np.ndarray:
    """The size (as a power of two a third) of sketches made for so many digests."""
    return np.maximum(LEAST_THIRD, np.ceil(np.log2(np.maximum(1, np.asarray(digests) * ROOM + 4) / 3))).astype(np.int64)


@dataclass
class Prints:
    """Fingerprints of many texts: sketches that can be listed, and how many paragraphs each holds."""

    sketches: Sketches
    size: np.ndarray
    digests: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, digests: np.ndarray, starts: np.ndarray) -> Prints:
        size = np.diff(starts)
        owner, third = np.repeat(np.arange(len(size)), size), third_for(size)
        while True:
            made = Sketches.of(digests, owner, third)
            whole = made.take(np.arange(len(size))).peel()[3]
            if whole.all():
                return cls(made, size, digests, starts)
            third = third + ~whole  # twice the cells where listing fails

    @classmethod
    def parse(cls, strings: list[str]) -> Prints:
        """Fingerprints from their strings alone."""
        parts = [s.split("-") for s in strings]
        size, third = (np.array([int(p[k]) for p in parts], np.int64) for k in (1, 2))
        made = Sketches.empty(third)
        cells = np.frombuffer(b"".join(base64.b64decode(p[3]) for p in parts), _CELL)
        made.count[:], made.key[:] = cells["n"], cells["key"]
        who, digest, _, whole = made.take(np.arange(len(size))).peel()
        order = np.argsort(who, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(size)))])
        if not whole.all() or (np.diff(starts) != size).any():
            raise ValueError("not a fingerprint")
        return cls(made, size, digest[order], starts)

    def strings(self, texts: list[str]) -> list[str]:
        """Each sketch behind 64 bits of the whole text, its number of paragraphs and its size."""
        cells = np.zeros(len(self.sketches.key), _CELL)
        cells["n"], cells["key"] = self.sketches.count.astype(np.int8), self.sketches.key
        base = self.sketches.base
        return [f"{hashlib.blake2b(t.encode(), digest_size=8).hexdigest()}-{self.size[i]}-{self.sketches.third[i]}-{base64.b64encode(cells[base[i] : base[i + 1]].tobytes()).decode()}" for i, t in enumerate(texts)]

    def listed(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of some of the sketches, and the place in `which` that each belongs to."""
        size = self.size[which]
        return self.digests[np.arange(size.sum()) + np.repeat(self.starts[which] - np.cumsum(size) + size, size)], np.repeat(np.arange(len(which)), size)


def differences(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of every paragraph that only one of a[i] (sign 1) and b[j] (-1) holds."""
    third = np.minimum(a.sketches.third[i], b.sketches.third[j])
    gap = a.sketches.take(i).fold(third).minus(b.sketches.take(j).fold(third))
    guess = gap.guess()
    todo = np.arange(len(i))
    tried = guess * 1.25 <= 3 << third
    who, digest, sign, whole = gap.take(np.flatnonzero(tried)).peel()
    place = np.flatnonzero(tried)
    good = whole[who]
    found = [(place[who[good]], digest[good], sign[good])]
    todo = np.setdiff1d(todo, place[whole])
    third = np.maximum(third[todo] + 1, third_for(np.minimum(guess[todo], a.size[i[todo]] + b.size[j[todo]])))
    while len(todo):
        (da, oa), (db, ob) = a.listed(i[todo]), b.listed(j[todo])
        gap = Sketches.of(np.concatenate([da, db]), np.concatenate([oa, ob]), third, np.repeat(np.array([1, -1], np.int32), [len(da), len(db)]))
        who, digest, sign, whole = gap.peel()
        good = whole[who]
        found.append((todo[who[good]], digest[good], sign[good]))
        todo, third = todo[~whole], third[~whole] + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def likeness(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> np.ndarray:
    """Shared part of the paragraphs of a[i] and b[j], from the difference of their sketches."""
    both = a.size[i] + b.size[j]
    pair, _, _ = differences(a, i, b, j)
    return np.where(both > 0, 1 - np.bincount(pair, minlength=len(i)) / np.maximum(both, 1), 1.0)


def compare(one: str, other: str) -> tuple[float, list[int], list[int]]:
    """The likeness of two fingerprints, and the digests of the paragraphs that only the one, only the other text has."""
    a, b, first = Prints.parse([one]), Prints.parse([other]), np.zeros(1, np.int64)
    _, digest, sign = differences(a, first, b, first)
    return float(likeness(a, first, b, first)[0]), sorted(digest[sign > 0].tolist()), sorted(digest[sign < 0].tolist())


SCHEMA = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Results for (doc_id, text, next text); a next text that is the following row's own is sketched once."""
    own = [r[1] for r in rows]
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for _, t, x in rows]
    n, texts, after = len(rows), [*own, *edited], []
    for i, (_, _, following) in enumerate(rows):
        if i + 1 < n and own[i + 1] is following:
            after.append(i + 1)
        else:
            after.append(len(texts))
            texts.append(following)
    prints = Prints.of(*paragraph_digests(pa.array(texts, pa.string())))
    at = np.arange(n)
    near = likeness(prints, np.concatenate([at, at]), prints, np.concatenate([at + n, np.array(after, np.int64)]))
    strings = prints.strings(texts[: 2 * n])
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(edited, pa.string()), pa.array(strings[:n], pa.string()), pa.array(strings[n:], pa.string()), pa.array(near[:n]), pa.array(near[n:])],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def with_next(docs: DataFrame, ranges: int | None = None, chars: int = 2 << 20) -> DataFrame:
    """Every document's fingerprint, its edited text and that text's fingerprint, and how like they are."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    known = rows.where("doc_id is not null").select("doc_id")
    cuts = known.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # ascending; range 0 has the largest ids

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, doc_id.to_numpy(np.int64), side="left"), dtype=np.int32)

    h = F.xxhash64("text")
    nulls = F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * NULL_RANGES).cast("int"), F.lit(NULL_RANGES - 1)) + len(cuts) + 1
    ranged = rows.withColumn("at", F.when(F.col("doc_id").isNull(), nulls).otherwise(range_of(F.coalesce("doc_id", F.lit(0)))))
    # each range's first row, as (range, doc_id, text): ranges' number of rows, known by its id and its text's hash
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit(0)).alias("k"), h.alias("h"))
    heads = sorted(ranged.groupBy("at").agg(F.min(order).alias("o")).select("at", "o.k", "o.h").collect())
    before = {at: heads[i - 1][0] for i, (at, _, _) in enumerate(heads)}
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    keys = spark.createDataFrame([(at, k, h, before[at]) for at, k, h in heads], "at int, k long, h long, to int")
    keyed = ranged.select("at", order["k"].alias("k"), order["h"].alias("h"), "doc_id", "text")
    copies = keyed.join(F.broadcast(keys), ["at", "k", "h"]).dropDuplicates(["at", "k", "h"]).select(F.col("to").alias("at"), F.lit(1).alias("copy"), "k", "h", "doc_id", "text")
    dealt = keyed.select("at", F.lit(0).alias("copy"), "k", "h", "doc_id", "text").unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size = [], None, 0
        stream = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("at", "copy", "doc_id", "text")), strict=True) for b in batches)
        for at, copy, doc_id, text in stream:
            if held is not None and held[0] == at:
                done.append((held[1], held[2], text))
                size += len(text)
            held = None if copy else (at, doc_id, text)
            if size > chars or len(done) >= 4000:
                yield _compare(done)
                done, size = [], 0
        if done:
            yield _compare(done)

    return dealt.repartition("at").sortWithinPartitions("at", "copy", "k", "h").mapInArrow(run, SCHEMA)
