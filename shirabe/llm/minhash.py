"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Each document's distinct 5-word shingles get a SuperMinHash signature: at level j every element puts the j-th entry
of its own random permutation of the slots at a value in [j, j + 1). Levels are worked off for all elements of many
documents at once and stop as soon as every slot of a document holds a value, because later ones are larger.

Documents with equal sets are one class, known by its smallest doc_id. Classes that share a band are candidates. The
smallest of a band's bucket is compared to the others first (a star, not all pairs); links found are grouped; then
only classes of a bucket that are still in different groups are compared, in blocks of bounded size, and a class
needs no more than one link to each group. What is compared are sets of shingles of candidates, never texts, and only
where their sizes allow a link; a block is bounded in members and in shingles. What shares a band thus ends up linked exactly if a chain of verified
links exists there, whatever the bucket's size. A pair at the threshold shares no band with probability
(1 - t^rows)^bands; there are as many bands as keep that below `MISS` for the percent asked for.

Defined results: null text, empty text and text without words have no shingles and are linked with nothing; rows
that repeat a doc_id are one document, linked by any of its texts; rows with null doc_id take no part and stay, with
component null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, scratch, text_slices, texts_of
from .graph import UnionFind, connected_components
from .words import MULTIPLIER, mix, shingle_sets, times

WORDS, PERCENT = 5, 80
ROWS, MISS = 6, 1e-6
#: Members of a bucket that one block of the second comparison takes on its two sides, and their shingles on either side;
#: a larger set is a block of its own.
FEW, MANY, SHINGLES = 256, 1024, 1 << 20
#: Candidates' ids go by broadcast up to this number (8 bytes each), beyond it by a shuffle.
BROADCAST_IDS = 1_000_000

_GOLD = MULTIPLIER


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The fewest bands that miss a pair exactly at the threshold with a probability below `MISS`."""
    hit = (percent / 100) ** rows
    return math.floor(math.log(MISS) / math.log1p(-hit)) + 1 if 0 < hit < 1 else 1


def super_minhash(elements: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of sets of distinct 64-bit elements; rows of empty sets are infinite."""
    n_docs = len(starts) - 1
    sig = np.full(n_docs * slots, np.inf)
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    x = elements.astype(np.uint64)
    swaps: list[np.ndarray] = []
    open_docs = np.diff(starts) > 0
    for level in range(slots):
        if not len(x):
            break
        draw = mix(x + times(2 * level + 1))
        value = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + level
        k = (level + mix(x + times(2 * level + 2)) % np.uint64(slots - level)).astype(np.int64)
        place = k.copy()
        for i in range(level - 1, -1, -1):  # where earlier transpositions brought this entry from
            place = np.where(place == i, swaps[i], np.where(place == swaps[i], i, place))
        swaps.append(k)
        np.minimum.at(sig, doc * slots + place, value)
        full = np.isfinite(sig.reshape(n_docs, slots)).all(1)
        if (open_docs & full).any():
            open_docs &= ~full
            stay = open_docs[doc]
            x, doc = x[stay], doc[stay]
            swaps = [s[stay] for s in swaps]
    return sig.reshape(n_docs, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = mix((out * _GOLD) ^ bits[:, :, r])
    return out


def set_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each whole set."""
    out = []
    for salt in (np.uint64(0x51), np.uint64(0xA7)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ mix(np.array([salt]))), dtype=np.uint64)])
        out.append(mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, words: int = WORDS, bands: int = bands_for(PERCENT), rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit key (s1, s2) and its band keys (none without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values, starts = shingle_sets(texts_of(part), words)
            keys = band_keys(super_minhash(values, starts, bands * rows), bands, rows).view(np.int64)
            n = np.diff(starts)
            s1, s2 = set_keys(values, starts)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[n > 0].ravel()))
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), lists], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def shingle_arrays(docs: DataFrame, words: int) -> DataFrame:
    """node and its sorted distinct shingles, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values, starts = shingle_sets(texts_of(part), words)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.record_batch([part.column("node"), lists], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column, in the order of unsigned values."""
    out = []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        values, ends = x.values.to_numpy().view(np.uint64), x.offsets.to_numpy()
        out += [values[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(x, y, percent) for x, y in zip(_lists(batch.column("set_u")), _lists(batch.column("set_v")), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _compare_block(percent: int):
    """Links between members of one bucket that are in different groups; at most one from a class to a group."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, few = table["node"].to_numpy(), table["component"].to_numpy(), table["few"].to_numpy()
        sets = _lists(table["shingles"])
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum(size)])
        vocabulary, local = np.unique(flat, return_inverse=True)
        groups = UnionFind()
        mark = np.zeros(len(vocabulary), bool)
        u, v = [], []
        for i in np.flatnonzero(few & (size > 0)):
            own = local[starts[i] : starts[i + 1]]
            mark[own] = True
            # members whose size and group allow a link
            may = np.flatnonzero((comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            if len(may):
                begin = np.cumsum(size[may]) - size[may]
                common = np.add.reduceat(mark[local[np.arange(size[may].sum()) + np.repeat(starts[may] - begin, size[may])]], begin, dtype=np.int64)
                for j in may[100 * common >= percent * (size[may] + size[i] - common)].tolist():
                    if groups.union(int(comp[i]), int(comp[j])):
                        u.append(int(ids[i]))
                        v.append(int(ids[j]))
            mark[own] = False
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; a link is 100 * intersection >= percent * union."""
    with scratch() as keep:
        return keep(_near_duplicates(docs.select("doc_id", "text"), words, percent, bands or bands_for(percent, rows), rows))


def _near_duplicates(own: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    signed = cut(signatures(own, words, bands, rows))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # one class for equal sets, and for rows of one doc_id
    classes = cut(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"), F.count("*").alias("n")))
    entries = cut(classes.select("node", "size", F.explode("bands").alias("key")))
    buckets = cut(entries.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low.node < high").select("key", "low", "n"))
    joined = cut(join_counted(entries, buckets, ["key"], "n"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  sizes of sets that can be linked
    stars = cut(joined.where((F.col("node") != F.col("low.node")) & fits(F.col("size"), F.col("low.size"))).select(F.col("low.node").alias("u"), F.col("node").alias("v")).distinct())
    # sets of candidates only: members of buckets; a document of several texts gives each of them
    members = cut(joined.select("node").distinct())
    hint = F.broadcast if members.count() <= BROADCAST_IDS else lambda df: df.hint("shuffle_hash")
    candidates = own.join(hint(members), own["doc_id"] == members["node"]).select("node", "text")
    sets = cut(shingle_arrays(candidates, words))
    # rows of one doc_id give equal sets each time; only theirs are shuffled to leave one
    repeated = cut(sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if times := repeated.count():
        repeated = F.broadcast(repeated) if times <= BROADCAST_IDS else repeated.hint("shuffle_hash")
        sets = cut(sets.join(repeated, "node", "left_anti").unionByName(sets.join(repeated, "node", "left_semi").distinct()))

    def with_sets(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
        right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v")

    linked = cut(with_sets(stars).mapInArrow(_verify(percent), "u long, v long"))
    first = cut(connected_components(linked))
    # second comparison: buckets of three or more that still hold several groups
    grouped = joined.where("n > 2").join(first, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = grouped.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n")).where("c1 < c2").select("key", "n")
    sizes = grouped.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = cut(sizes.join(mixed, "key").groupBy("key", "n").agg(F.max(F.struct("m", "component")).alias("top")).select("key", "n", F.col("top.component").alias("main")))
    rest = cut(join_counted(grouped, main, ["key"], "n"))
    # outsiders of the bucket's largest group meet every member, blocks of few x many; equal sets of members meet once
    outside = F.col("component") != F.col("main")
    shape = rest.groupBy("key").agg(
        F.count(F.when(outside, 1)).alias("out"),
        F.sum(F.when(outside, F.col("size")).otherwise(0)).alias("out_size"),
        F.sum("size").alias("all_size"),
        F.bit_xor(F.xxhash64("node")).alias("x1"),
        F.sum(F.hash("node").cast("long")).alias("x2"),
        F.first("n").alias("n"),
    )
    blocks_of = lambda n, most, size: F.greatest(F.ceil(n / most), F.ceil(size / SHINGLES)).cast("int")
    once = shape.groupBy("x1", "x2", "n").agg(F.min(F.struct("key", "out", "out_size", "all_size")).alias("k")).select("k.key", blocks_of(F.col("k.out"), FEW, F.col("k.out_size")).alias("rows"), blocks_of(F.col("n"), MANY, F.col("k.all_size")).alias("cols"))
    shaped = rest.join(once, "key")
    spread = lambda n, count: F.pmod(F.xxhash64(F.col("node"), F.lit(n)), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    out = shaped.where(outside).select("key", "node", "component", spread(1, "rows").alias("row"), each("cols").alias("col"), F.lit(True).alias("few"))
    inn = shaped.select("key", "node", "component", each("rows").alias("row"), spread(2, "cols").alias("col"), F.lit(False).alias("few"))
    blocks = out.unionByName(inn).join(sets, "node")
    more = blocks.groupBy("key", "row", "col").applyInArrow(_compare_block(percent), "u long, v long")
    second = cut(more.select("u", "v").distinct())
    chain = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second)
    # rows of one doc_id with several sets: those sets' classes are one document
    same = join_counted(full.select("doc_id", "s1", "s2"), classes.select("s1", "s2", "node", "n"), ["s1", "s2"], "n").where("doc_id <> node")
    member = same.select("doc_id", "node").distinct()
    final = connected_components(chain.unionByName(member.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    known, unknown = signed.where("doc_id is not null").select("doc_id", "n_shingles"), signed.where("doc_id is null").select("doc_id", "n_shingles")
    placed = known.join(final, known["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return placed.unionByName(unknown.withColumn("component_id", F.lit(None).cast("long"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
