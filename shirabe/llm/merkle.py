"""Merkle dataset manifests over an external-memory node store.

Rows become leaves: the SHA-256 of their fields, each `-` if null, else its UTF-8 byte count, `:` and the value. The leaves
of a group are sorted, then every `FAN` consecutive nodes become their hash until one is left, the group's root; the roots
of the groups, in order, give the dataset's root in the same way.

Sorted runs: leaves are dealt by ranges and sorted, so that a node's place in its group follows from its run's beginning,
and no group is ever numbered in one task. The node store is a Parquet table with a folder a level; a node's coordinate
is (group, level, place). Building reads one stored level in blocks of FAN ** HEIGHT neighbours, a block at a time, and
appends the next HEIGHT levels, so that a task holds one block and the number of passes is the tree's height over HEIGHT.
Proofs come back down in the same blocks: the stored levels of a block and the proof of the block's root, brought together
and sorted by coordinate, are scanned in step. Nodes that a row's proof needs are never looked up one by one.

Defined results: null ids and null groups come first; rows that repeat an id are ordered by their leaf; any field may be
null; an empty table has no root and no rows; other columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, folder, scratch

FAN, HEIGHT = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups and runs up to this number go by broadcast (some 100 bytes each), more by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows that a task gathers before it hands them on.
BATCH = 20_000
_DIGEST = 64
_LEVELS = 40


def leaf(fields: list[Column]) -> Column:
    """The hash of a row's fields."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def node(children: list[str]) -> str:
    """The hash of a node over its children's."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a group of n."""
    out = 0
    while n > FAN**out:
        out += 1
    return out


def fold(digest: str, proof: str, places: list[tuple[int, int]]) -> str:
    """The root above a leaf, from its proof (the other nodes of its run, level by level) and its (place, number of nodes) in
    its group's tree and in the tree of groups."""
    at = 0
    for place, n in places:
        while n > 1:
            own = place % FAN
            others = min(FAN, n - place + own) - 1
            siblings = [proof[at + _DIGEST * i : at + _DIGEST * (i + 1)] for i in range(others)]
            at += _DIGEST * others
            digest = node([*siblings[:own], digest, *siblings[own:]])
            place, n = place // FAN, -(-n // FAN)
    return digest


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with a group `g`, sorted in runs and written, with `at` numbering them; and each group's runs: g, part, the first
    `at`, the place in the group where the run begins, and the group's n. rows should be a written table."""
    # the last key sets apart rows that are equal in all others, however many they are
    keys = ["g", *order, "__row"]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    run = cut(ranged.withColumn("at", F.monotonically_increasing_id()))
    runs = run.groupBy("g", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run, cut(runs.select("g", "part", "first", before.alias("begins"), F.sum("rows").over(Window.partitionBy("g")).alias("n")))


def _placed(run: DataFrame, runs: DataFrame) -> DataFrame:
    """The sorted rows with all that `runs` says of theirs, and their place in their group."""
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    rows = run.withColumn("part", F.shiftright("at", 33)).join(runs, ["g", "part"])
    return rows.withColumn("place", F.col("at") - F.col("first") + F.col("begins"))


_NODE = "grp long, n long, level int, place long, digest string"


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("grp", "block", *columns)), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, [r[2:] for r in own]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


_NODES = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])


@dataclass(frozen=True)
class Store:
    """Trees of groups 0, 1, ... in a table with a folder a level; `most` is the largest group's number of leaves."""

    path: str
    nodes: DataFrame
    most: int

    @classmethod
    def build(cls, leaves: DataFrame) -> Store:
        """From leaves(grp, n, place, digest): a pass over a stored level gives the next HEIGHT levels."""
        spark = leaves.sparkSession
        path = folder(spark)
        nodes = spark.read.schema(_NODE)
        write = lambda df: df.write.mode("append").partitionBy("level").parquet(path)
        write(leaves.select("grp", "n", F.lit(0).alias("level"), "place", "digest"))
        read = lambda: nodes.parquet(path)
        most = read().where("level = 0").agg(F.max("n")).first()[0] or 0
        for base in range(0, height(most), HEIGHT):
            own = read().where((F.col("level") == base) & (F.col("n") > FAN**base))
            rows = own.select("grp", F.floor(F.col("place") / FAN**HEIGHT).alias("block"), "place", "n", "digest")
            write(_in_blocks(rows, ["place"]).mapInArrow(_ascent(base), _NODE))
        return cls(path, read(), most)

    def roots(self) -> DataFrame:
        """grp and the digest of its root."""
        levels = sum((F.col("n") > FAN**i).cast("int") for i in range(_LEVELS))
        return self.nodes.where((F.col("place") == 0) & (F.col("level") == levels)).select("grp", "digest")

    def proofs(self, above: DataFrame) -> DataFrame:
        """grp, place, proof and root of every leaf; above(grp, n, proof, root): each group's root's own proof."""
        out = None
        passes = range(0, max(1, height(self.most)), HEIGHT)
        for base in reversed(passes):
            # group roots that this pass begins at, and the nodes where the pass above ended
            ends = (F.col("n") <= FAN ** (base + HEIGHT)) & (F.col("n") > FAN**base if base else F.lit(True))
            tops = above.where(ends).select("grp", F.lit(0).cast("long").alias("place"), "proof", "root")
            tops = tops if out is None else tops.unionByName(out)
            none = lambda kind, name: F.lit(None).cast(kind).alias(name)
            heads = tops.select("grp", F.col("place").alias("block"), F.lit(-1).alias("level"), none("long", "place"), none("long", "n"), none("string", "digest"), "proof", "root")
            own = self.nodes.where(F.col("level").between(base, base + HEIGHT - 1) & (F.col("n") > FAN**base if base else F.lit(True)))
            width = F.element_at(F.array(*(F.lit(FAN ** (HEIGHT - i)) for i in range(HEIGHT))), F.col("level") - base + 1)
            rows = own.select("grp", F.floor(F.col("place") / width).alias("block"), "level", "place", "n", "digest", none("string", "proof"), none("string", "root"))
            out = _in_blocks(heads.unionByName(rows), ["level", "place"]).mapInArrow(_descent(base), "grp long, place long, proof string, root string")
        return out


def _ascent(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (grp, block), own in _blocks(batches, ["n", "digest"]):
            n, digests = own[0][0], [d for _, d in own]
            for level in range(base + 1, min(base + HEIGHT, height(n)) + 1):
                digests = [node(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
                first = block * FAN ** (base + HEIGHT - level)
                yield from ((grp, n, level, first + i, d) for i, d in enumerate(digests))

    return lambda batches: _batches(up(batches), _NODES)


def _descent(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("grp", pa.int64()), ("place", pa.int64()), ("proof", pa.string()), ("root", pa.string())])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (grp, block), own in _blocks(batches, ["level", "n", "digest", "proof", "root"]):
            _, _, _, above, root = own[0]  # the block's root, which sorts first
            n = own[1][1]
            levels = [[d for _, _, d, _, _ in rows] for _, rows in groupby(own[1:], key=lambda r: r[0])][: height(n) - base]
            first = block * FAN**HEIGHT
            for i in range(len(own[1:]) if not levels else len(levels[0])):
                parts, p = [], i
                for row in levels:
                    a = p - p % FAN
                    parts += row[a:p] + row[p + 1 : a + FAN]
                    p //= FAN
                yield grp, first + i, "".join(parts) + above, root

    return lambda batches: _batches(down(batches), schema)


@dataclass(frozen=True)
class Manifest:
    """leaves: the rows' carried columns, digest, grp, place, n; groups: grp, g (`=` and the name, or empty), n; the trees."""

    leaves: DataFrame
    groups: DataFrame
    trees: Store
    top: Store
    root: str | None

    @classmethod
    def build(cls, docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carried: dict[str, Column] | None = None) -> Manifest:
        """Of docs, which is read once. carried: further columns that stay beside the leaves."""
        own = leaf([F.col(c) for c in fields])
        name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
        rows = cut(docs.select(name.alias("g"), F.col(order).alias("id"), own.alias("digest"), *(c.alias(k) for k, c in (carried or {}).items())))
        run, runs = _numbered(rows, ["id", "digest"])
        # groups are numbered as leaves of one tree are
        names, of_names = _numbered(cut(runs.where("begins = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), "n")), ["name"])
        groups = cut(_placed(names.withColumnRenamed("n", "rows"), of_names).select(F.col("place").alias("grp"), F.col("name").alias("g"), F.col("rows").alias("n"), F.col("n").alias("groups")))
        few = groups.count() <= BROADCAST_ROWS
        leaves = cut(_placed(run, runs.join(F.broadcast(groups.select("g", "grp")) if few else groups.select("g", "grp"), "g")).drop("g", "part", "at", "first", "begins"))
        trees = Store.build(leaves)
        top = trees.roots().join(groups, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("groups").alias("n"), F.col("grp").alias("place"), "digest")
        top = Store.build(cut(top))
        first = top.roots().first()
        return cls(leaves, groups, trees, top, first and first["digest"])

    def proofs(self) -> DataFrame:
        """All columns of leaves, and subroot, proof, and the number of groups."""
        spark = self.leaves.sparkSession
        ends = spark.createDataFrame([(0, self.top.most, "", self.root or "")], "grp long, n long, proof string, root string")
        ways = self.top.proofs(ends).select(F.col("place").alias("grp"), "proof").join(self.trees.roots().withColumnRenamed("digest", "root"), "grp")
        ways = cut(ways.join(self.groups.select("grp", "n", "groups"), "grp"))
        proofs = self.trees.proofs(ways.select("grp", "n", "proof", "root")).withColumnRenamed("root", "subroot")
        count = self.top.most
        return self.leaves.join(proofs, ["grp", "place"]).withColumn("groups", F.lit(count).cast("long"))


def verify(rows: DataFrame, root: str | None, digest: str = "digest") -> DataFrame:
    """rows of Manifest.proofs() with the column `folded`, the root recomputed from a digest and its proof, and `verified`."""

    @F.pandas_udf("string")
    def folded(d, proof, place, n, grp, groups):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([fold(a, b, [(int(p), int(k)), (int(g), int(m))]) for a, b, p, k, g, m in zip(d, proof, place, n, grp, groups, strict=True)], dtype=object)

    out = rows.withColumn("folded", folded(digest, "proof", "place", "n", "grp", "groups"))
    return out.withColumn("verified", F.col("folded") == F.lit(root))


def manifest_of(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its group's root, the root, the digest of its proof, and whether the row still verifies after its text
    has lost its line ends where its id's CRC-32 is even."""
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    fields = [lines if c == "text" else F.col(c) for c in FIELDS]
    with scratch() as keep:
        m = Manifest.build(docs.select(*FIELDS), carried={"tampered": F.when(even, leaf(fields))})
        rows = m.proofs().withColumn("now", F.coalesce("tampered", "digest"))
        out = verify(rows, m.root, "now")
        return keep(out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified"))
