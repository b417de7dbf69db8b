"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, as a 128-bit digest. The
index holds three tables in the shared folder: postings (which document holds which key), reference counts (how
many documents hold a key, and the smallest), and cuckoo filters of the shared keys, one a shard of bounded size.
Dedup asks the filters first, so that only lines that may be shared reach the exact table. Insertions and deletions
of documents give a new index, which shares the tables of the one before and adds a small version of each: the new
postings or the ids deleted, the counts of the keys concerned, and the filters of shards whose keys begin or cease to
be shared. The last version of a key or shard counts, so deleting what was inserted gives the former result again, and
the former index stays usable. `compact` writes all versions into one.

Keys held by at least a `hot_part`-th (a thousandth) of all postings number that many at most; they are looked up by
broadcast, and so no key left for the shuffles has more than that share of the rows.

Defined results: null or empty text is one empty line; keys of less than `min_chars` code points never count;
rows that repeat a doc_id are one document; rows with null doc_id hold no keys and stay as they are; an empty table
gives no rows; other columns pass `rewrite` unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scratch, text_slices, texts_of

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
#: Shared keys that a shard's filter is made for.
SHARD_KEYS = 8192
#: Postings that one task holds against one filter; a shard with more of them has copies of its filter.
TASK_POSTINGS = 32768
#: A key is hot from this part (one in so many) of all postings on, so 1000 keys are hot at most.
HOT_PART = 1000
SLOTS = 4


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return blake2b(key.lower(), digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 128-bit keys in buckets of four; inserts, deletes and asks in constant time, never a false no."""

    def __init__(self, keys: int) -> None:
        self.buckets = 1 << max(2, (int(keys / (SLOTS * 0.85)) + 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        mark = ((k1 >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = k2 & mask
        return mark, one.astype(np.int64), (one ^ self._turn(mark.astype(np.uint64))).astype(np.int64)

    def _turn(self, mark: np.ndarray) -> np.ndarray:
        return (mark * np.uint64(0x5BD1E995) >> np.uint64(3)) & np.uint64(self.buckets - 1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """All keys that find room in one of their buckets at once, the others by moving what is in their way."""
        turn = self._turn(np.arange(65536, dtype=np.uint64)).astype(np.int64)
        mark, one, two = self._places(k1, k2)
        left = np.arange(len(mark))
        for place in (one, two):
            order = left[np.argsort(place[left], kind="stable")]
            at = place[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            slots = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # empty slots first
            fits = rank < (self.table[at] == 0).sum(1)
            self.table[at[fits], slots[fits, rank[fits]]] = mark[order[fits]]
            left = order[~fits]
        for m, j in zip(mark[left].tolist(), two[left].tolist(), strict=True):
            for kick in range(200):
                slot = (m + kick) % SLOTS
                m, self.table[j, slot] = int(self.table[j, slot]), m
                j ^= int(turn[m])
                empty = np.flatnonzero(self.table[j] == 0)
                if len(empty):
                    self.table[j, empty[0]] = m
                    break
            else:
                self.stash.append((m, j))

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only keys that were inserted."""
        for mark, i, j in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in (i, j):
                if (mark, at) in self.stash:
                    self.stash.remove((mark, at))
                    break
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def may_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, i, j = self._places(k1, k2)
        out = (self.table[i] == mark[:, None]).any(1) | (self.table[j] == mark[:, None]).any(1)
        for m, at in self.stash:
            out |= (mark == m) & ((i == at) | (j == at))
        return out

    def entries(self) -> list[tuple[int, int]]:
        """What the filter holds, wherever it was moved to: each mark with the smaller of its two buckets."""
        at, slot = np.nonzero(self.table)
        held = [*zip(self.table[at, slot].tolist(), at.tolist(), strict=True), *self.stash]
        return sorted((m, min(i, i ^ int(self._turn(np.array([m], np.uint64))[0]))) for m, i in held)

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.array([self.buckets, len(stash)], np.int64).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.buckets, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        out.stash = [tuple(x) for x in np.frombuffer(raw, np.int64, 2 * n, 16).reshape(-1, 2).tolist()]
        out.table = np.frombuffer(raw, np.uint16, offset=16 + 16 * n).reshape(out.buckets, SLOTS).copy()
        return out


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            owner, keys = [], []
            for i, text in enumerate(texts_of(part).cast(pa.binary()).to_pylist()):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                owner += [i] * len(own)
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.record_batch([part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "k1", "k2"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long").distinct()


def _last(tables: tuple[DataFrame, ...], keys: list[str]) -> DataFrame:
    """The last version of each key of tables with a column `version`."""
    if len(tables) == 1:
        return tables[0].drop("version")
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    values = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v")).select(*keys, "v.*")


@dataclass(frozen=True)
class LineIndex:
    """An immutable index; insert and delete give new ones that write what changes and share the rest."""

    spark: SparkSession
    added: tuple[DataFrame, ...]  # doc_id, k1, k2, version
    gone: tuple[DataFrame, ...]  # doc_id, version
    counts: tuple[DataFrame, ...]  # k1, k2, n, low, version; n = 0 where no document holds the key any more
    cells: tuple[DataFrame, ...]  # shard, cells, version
    shards: int
    shared: int
    version: int = 0
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS

    @property
    def postings(self) -> DataFrame:
        """doc_id, k1, k2 of the documents that the index holds."""
        rows = self.added[0]
        for t in self.added[1:]:
            rows = rows.unionByName(t)
        if not self.gone:
            return rows.drop("version")
        gone = self.gone[0]
        for t in self.gone[1:]:
            gone = gone.unionByName(t)
        last = gone.groupBy("doc_id").agg(F.max("version").alias("end"))
        return rows.join(last, "doc_id", "left").where("end is null or end < version").select("doc_id", "k1", "k2")

    @property
    def refs(self) -> DataFrame:
        """k1, k2, the number of documents that hold the key and the smallest of them."""
        return _last(self.counts, ["k1", "k2"]).where("n > 0")

    @property
    def filters(self) -> DataFrame:
        """shard, cells."""
        return _last(self.cells, ["shard"])

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        postings = cut(_postings(docs, min_chars))
        refs = cut(postings.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
        return cls._whole(docs.sparkSession, postings, refs, min_chars, shard_keys)

    @classmethod
    def _whole(cls, spark: SparkSession, postings: DataFrame, refs: DataFrame, min_chars: int, shard_keys: int) -> LineIndex:
        """An index of one version, its filters made anew."""
        shared = refs.where("n >= 2")
        n_shared = shared.count()
        shards = max(1, -(-n_shared // shard_keys))

        def make(pdf: pd.DataFrame) -> pd.DataFrame:
            held = CuckooFilter(max(len(pdf), shard_keys))
            held.insert(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "cells": [held.to_bytes()]})

        filters = cut(shared.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2").groupBy("shard").applyInPandas(make, "shard int, cells binary"))
        first = lambda df: (df.withColumn("version", F.lit(0)),)
        return cls(spark, first(postings), (), first(refs), first(filters), shards, n_shared, 0, min_chars, shard_keys)

    def compact(self) -> LineIndex:
        """The same index with one version of everything."""
        return self._whole(self.spark, cut(self.postings), cut(self.refs), self.min_chars, self.shard_keys)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents' lines too; what the index holds already counts once. Only new postings, the counts of their
        keys and the filters of shards that get a shared key are written."""
        own = cut(_postings(docs, self.min_chars))
        held = self.postings.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
        new = cut(own.join(held, ["doc_id", "k1", "k2"], "left_anti"))
        delta = new.groupBy("k1", "k2").agg(F.count("*").alias("dn"), F.min("doc_id").alias("dlow"))
        changed = cut(delta.join(self.refs, ["k1", "k2"], "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("dn")).alias("n"), F.least("low", "dlow").alias("low"), F.coalesce("n", F.lit(0)).alias("was")))
        return self._changed(changed, added=new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents named in doc_ids.doc_id."""
        ids = cut(doc_ids.select("doc_id").where("doc_id is not null").distinct())
        gone = cut(self.postings.join(ids, "doc_id", "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("dn"), F.min("doc_id").alias("dlow")))
        left = cut(self.refs.join(gone, ["k1", "k2"]).select("k1", "k2", (F.col("n") - F.col("dn")).alias("n"), "low", F.col("n").alias("was"), (F.col("low") == F.col("dlow")).alias("lost")))
        # the counts follow from the reference counts; only keys that lose their smallest document look for the next one
        seek = left.where("lost and n > 0").select("k1", "k2")
        lows = self.postings.join(seek, ["k1", "k2"], "left_semi").join(ids, "doc_id", "left_anti").groupBy("k1", "k2").agg(F.min("doc_id").alias("next"))
        changed = cut(left.join(lows, ["k1", "k2"], "left").select("k1", "k2", "n", F.when(F.col("lost"), F.col("next")).otherwise(F.col("low")).alias("low"), "was"))
        return self._changed(changed, gone=ids)

    def _changed(self, changed: DataFrame, added: DataFrame | None = None, gone: DataFrame | None = None) -> LineIndex:
        """Insert the keys that became shared into their shards' filters and delete those that ceased to be."""
        version = self.version + 1
        mark = lambda df: () if df is None else (df.withColumn("version", F.lit(version)),)
        moved = changed.where("(n >= 2) <> (was >= 2)").select(F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard"), "k1", "k2", (F.col("n") >= 2).alias("up"))
        up, down = moved.agg(F.count_if("up"), F.count_if(~F.col("up"))).first()
        shard_keys = self.shard_keys

        def change(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(held["cells"].iloc[0]) if len(held) else CuckooFilter(max(len(keys), shard_keys))
            for is_up, use in ((False, f.delete), (True, f.insert)):
                own = keys[keys["up"] == is_up]
                use(own["k1"].to_numpy(), own["k2"].to_numpy())
            return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "cells": [f.to_bytes()]})

        touched = self.filters.join(moved.select("shard").distinct(), "shard", "left_semi")
        cells = cut(touched.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, cells binary"))
        out = LineIndex(self.spark, self.added + mark(added), self.gone + mark(gone), self.counts + mark(changed.drop("was")), self.cells + mark(cells), self.shards, self.shared + up - down, version, self.min_chars, shard_keys)
        return out.compact() if out.shared > 2 * shard_keys * self.shards else out

    def may_be_shared(self, postings: DataFrame, total: int | None = None, task_postings: int = TASK_POSTINGS) -> DataFrame:
        """The rows (doc_id, k1, k2) whose shard's filter may hold the key; rows stream past one filter at a time.

        A shard is split by its keys into as many parts as its postings need, each with a copy of the filter, so that
        the work is dealt by the number of postings and not by that of shared keys."""
        total = postings.count() if total is None else total
        parts = max(1, -(-total // (task_postings * self.shards)))
        shard = F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")
        part = F.pmod("k2", F.lit(parts)).cast("int").alias("part")
        rows = postings.select(shard, part, F.lit(1).alias("kind"), "doc_id", "k1", "k2", F.lit(None).cast("binary").alias("cells"))
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "k1", "k2")), "cells")
        asked = copies.unionByName(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for batch in batches:
                kind = batch.column("kind").to_numpy()
                shards = (batch.column("shard").to_numpy().astype(np.int64) << 32) | batch.column("part").to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], (np.diff(shards) != 0) | (kind[1:] == 0), [True]]))
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if kind[a] == 0:
                        now, held = shards[a], CuckooFilter.from_bytes(batch.column("cells")[a].as_py())
                        a += 1
                    if a < z and held is not None and shards[a] == now:
                        part = batch.slice(a, z - a).select(["doc_id", "k1", "k2"])
                        yield part.filter(pa.array(held.may_hold(part.column("k1").to_numpy(), part.column("k2").to_numpy())))

        return asked.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(run, "doc_id long, k1 long, k2 long")

    def drops(self, hot_part: int = HOT_PART) -> DataFrame:
        """(doc_id, k1, k2): the keys whose lines each indexed document loses."""
        total = self.postings.count()
        shared = self.refs.where("n >= 2").select("k1", "k2", "n", "low")
        # at most hot_part keys can hold a hot_part-th of the postings each; with 0 no key counts as hot
        hot = self.spark.createDataFrame(shared.where(F.col("n") * hot_part >= max(total, 1)).collect(), shared.schema).drop("n")
        rest = self.postings.join(F.broadcast(hot), ["k1", "k2"], "left_anti")
        few = self.may_be_shared(rest, total).join(shared.drop("n").join(F.broadcast(hot), ["k1", "k2"], "left_anti"), ["k1", "k2"])
        many = self.postings.join(F.broadcast(hot), ["k1", "k2"])
        return few.unionByName(many).where("doc_id <> low").select("doc_id", "k1", "k2")

    def lost(self, hot_part: int = HOT_PART) -> DataFrame:
        """__doc and the keys __lost of the documents that lose any."""
        return self.drops(hot_part).groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("__lost")).withColumnRenamed("doc_id", "__doc")

    def rewrite(self, docs: DataFrame, hot_part: int = HOT_PART) -> DataFrame:
        """The indexed documents, all columns, text without the lines they lose, then __n_lines and __n_dropped."""
        return without_lines(docs, self.lost(hot_part), self.min_chars)


def without_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all columns, text without the lines whose keys are lost (__doc, __lost), then __n_lines and __n_dropped."""
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")  # rows without id lose nothing and need no shuffle
    both = known.join(lost.hint("shuffle_hash"), known["doc_id"] == lost["__doc"], "left").drop("__doc").unionByName(unknown.withColumn("__lost", F.lit(None).cast(lost.schema["__lost"].dataType)))
    out = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    out["text"].nullable = True
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, lost_keys in zip(texts_of(part).cast(pa.binary()).to_pylist(), part.column("__lost").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if lost_keys:
                    gone = {np.array([x["k1"], x["k2"]], "<i8").tobytes() for x in lost_keys}
                    lines = [x for x in lines if line_key(x, min_chars) not in gone]
                kept.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            own = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "__n_lines": pa.array(n_lines, pa.int64()), "__n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.record_batch([own[c] if c in own else part.column(c) for c in names], names=names)

    return both.mapInArrow(run, out)


def dedup_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all columns, without the lines that a smaller doc_id holds, then __n_lines and __n_dropped; the index is dropped."""
    with scratch() as keep:
        lost = keep(LineIndex.build(docs.select("doc_id", "text"), min_chars).lost())
    return without_lines(docs, lost, min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text of the lines that stay, of all documents against each other."""
    out = dedup_table(docs.select("doc_id", "text"), min_chars)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")
