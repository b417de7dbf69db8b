"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one in double precision; cosine >= c means a chord of at most sqrt(2 - 2c). A cover tree
has nested levels whose radii halve: the centers of a level lie more than its radius apart, every member lies within
the radius of its center, and each node keeps the covering radius that its members really have. Two trees are
traversed together: a pair of nodes whose centers lie further apart than both radii and the chord is pruned, a pair
that lies within the chord with all its members is counted without looking at them, other pairs are split further.

At scale the levels are found in two steps. A tree of a bounded sample gives leaves, nodes with enough members; every
vector goes to the smallest leaf that reaches it, else to the leaf of all that lie apart, and the covering radius of
each leaf is measured over its members, so bounds hold whatever the sample. A vector also visits the leaves of smaller
radius that may hold a partner of it, by the same bound. Each cell, a bounded part of a leaf with a bounded
share of its visitors, builds its trees and traverses them. Only counts and a spanning forest leave a cell, never pairs.

Equal unit vectors are one class with a count, so groups of copies cost one vector.

Defined results: a vector that is null, empty, zero, or that holds null or non-finite components has no links and is
its own component; vectors of different lengths link with nothing of another length; repeated vec_ids are separate
vectors that share a component; null vec_ids take no part and stay, with component null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, scratch
from .graph import connected_components
from .words import mix

THRESHOLD = 0.9
#: Vectors that the top tree is built of, leaves it may have, vectors of a cell's part and visitors of a cell at most.
SAMPLE, LEAVES, PART = 8192, 1024, 32768
#: Parts of a leaf that holds everything, so that a small table is worked off by several tasks; a part's least size.
PARTS, LEAST = 6, 512
#: Sample members that a node of the top tree needs to be a leaf of its own.
POPULOUS = 16
LEAF_POINTS = 32
#: Slack of every bound, far above rounding and far below any distance that matters.
SLACK = 1e-7
_BLOCK = 1024


def _chord(cosine: float | np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * np.asarray(cosine)))


@dataclass
class Node:
    """Members are points[order[first:last]] of the tree; reach is the radius of its level, radius the measured one."""

    center: int
    reach: float
    radius: float
    first: int
    last: int
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Nested levels over unit vectors with halving radii; `order` lists the points so that every node is a range.

    Nodes of at most leaf_points points are not split further once they lie within `tight`; looser ones, which would
    prune nothing, stand in their parent's list as the tight nodes they hold."""

    def __init__(self, points: np.ndarray, leaf_points: int = LEAF_POINTS, tight: float = 0.25, least_reach: float = 1e-3) -> None:
        self.points, self.leaf_points, self.tight, self.least_reach = points, leaf_points, tight, least_reach
        self.order = np.arange(len(points))
        self.root = self._node(0, 2.0, _chord(points @ points[0]), 0, len(points)) if len(points) else None
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.last - node.first > leaf_points or node is self.root:
                node.children = self._split(node)
                todo += node.children

    def _node(self, center: int, reach: float, far: np.ndarray, first: int, last: int) -> Node:
        return Node(center, reach, float(far.max()) + SLACK if last - first > 1 else 0.0, first, last)

    def _split(self, node: Node) -> list[Node]:
        """The next level whose radius parts the node."""
        reach = node.reach / 2
        while reach > self.least_reach and node.radius:
            parts = self._part(node, reach) if reach < node.radius else []
            if len(parts) > 1:
                loose = lambda n: n.last - n.first <= self.leaf_points and n.radius > self.tight
                return [x for n in parts for x in (self._part(n, self.tight) if loose(n) else [n])]
            reach /= 2
        return []

    def _part(self, node: Node, reach: float) -> list[Node]:
        """A net of the node's points, as ranges of `order`."""
        own = self.order[node.first : node.last]
        centers, nearest, far = self._net(own, reach)
        by = np.argsort(nearest, kind="stable")
        self.order[node.first : node.last] = own[by]
        far, ends = far[by], np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centers)))]).tolist()
        return [self._node(c, reach, far[a:z], node.first + a, node.first + z) for c, a, z in zip(centers.tolist(), ends[:-1], ends[1:], strict=True)]

    def _net(self, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centers more than reach apart that cover own, the nearest center of each point, and its distance."""
        close = 1 - reach * reach / 2  # cosine of two points reach apart
        best, nearest = np.full(len(own), -2.0), np.zeros(len(own), np.int64)
        chosen: list[int] = []
        for a in range(0, len(own), _BLOCK):
            block = np.flatnonzero(best[a : a + _BLOCK] < close) + a  # not covered by the centers so far
            if not len(block):
                continue
            near = self.points[own[block]] @ self.points[own[block]].T
            fresh: list[int] = []
            free = np.ones(len(block), bool)
            for i in range(len(block)):
                if free[i]:
                    fresh.append(i)
                    free &= near[i] < close
            new = block[fresh]
            for i in range(a, len(own), 4 * _BLOCK):  # of the points from this block on
                z = min(len(own), i + 4 * _BLOCK)
                got = self.points[own[i:z]] @ self.points[own[new]].T
                top = got.argmax(1)
                value = got[np.arange(len(top)), top]
                better = value > best[i:z]
                best[i:z][better], nearest[i:z][better] = value[better], top[better] + len(chosen)
            chosen += new.tolist()
        # points of earlier blocks may have a nearer center among later ones; any center within reach will do
        centers = own[chosen]
        far = _chord(np.einsum("ij,ij->i", self.points[own], self.points[centers[nearest]]))
        return centers, nearest, far


@dataclass
class Traversal:
    """What a traversal did: pairs of nodes looked at and pruned, pairs of points multiplied, and counted unseen."""

    seen: int = 0
    pruned: int = 0
    multiplied: int = 0
    counted: int = 0


class Links:
    """Weighted counts of links and a spanning forest of them, without keeping pairs."""

    MOST_EDGES = 1 << 20

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.count = weight, np.zeros(len(weight), np.int64)
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.held = 0

    def _edges(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > self.MOST_EDGES + len(self.weight):
            root = self.roots()
            self.u, self.v, self.held = [np.arange(len(root))], [root], len(root)

    def block(self, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> None:
        """Links of a boolean matrix."""
        self.count[rows] += near @ self.weight[cols]
        self.count[cols] += near.T @ self.weight[rows]
        r, c = np.nonzero(near)
        if len(r) > 4 * (len(rows) + len(cols)):  # dense: the smallest label spreads over rows and columns in turn
            of_r, of_c, most = np.arange(len(rows)), np.arange(len(cols)) + len(rows), len(rows) + len(cols)
            while True:
                new_r = np.minimum(of_r, np.where(near, of_c[None, :], most).min(1))
                new_c = np.minimum(of_c, np.where(near, new_r[:, None], most).min(0))
                if (new_r == of_r).all() and (new_c == of_c).all():
                    break
                of_r, of_c = new_r, new_c
            both, label = np.concatenate([rows, cols]), np.concatenate([of_r, of_c])
            self._edges(both, both[label])
        else:
            self._edges(rows[r], cols[c])

    def pairs(self, u: np.ndarray, v: np.ndarray) -> None:
        """Linked pairs."""
        np.add.at(self.count, u, self.weight[v])
        np.add.at(self.count, v, self.weight[u])
        self._edges(u, v)

    def everything(self, rows: np.ndarray, cols: np.ndarray | None = None) -> None:
        """Each of rows is linked to each of cols, or, without cols, to all others of rows."""
        if cols is None:
            self.count[rows] += self.weight[rows].sum() - self.weight[rows]
            self._edges(rows, np.full(len(rows), rows[0]))
        else:
            self.count[rows] += self.weight[cols].sum()
            self.count[cols] += self.weight[rows].sum()
            self._edges(np.concatenate([rows, cols]), np.full(len(rows) + len(cols), rows[0]))

    def roots(self) -> np.ndarray:
        """The smallest position that each position reaches."""
        label = np.arange(len(self.weight))
        if not self.u:
            return label
        u, v = np.concatenate(self.u), np.concatenate(self.v)
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                return label
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]


def dual_traversal(a: CoverTree, b: CoverTree, cosine: float, links: Links, at: int = 0) -> Traversal:
    """Give links every link between the points of a and of b, whose positions begin at `at`, or (a is b) of a with itself."""
    work = Traversal()
    if a.root is None or b.root is None:
        return work
    chord, same = float(_chord(cosine)), a is b
    stack = [([a.root], [b.root])]

    def multiply(p: Node, q: Node) -> None:
        rows, cols = a.order[p.first : p.last], b.order[q.first : q.last]
        itself = same and p is q
        for i in range(0, len(rows), _BLOCK):
            for j in range(i if itself else 0, len(cols), _BLOCK):
                r, c = rows[i : i + _BLOCK], cols[j : j + _BLOCK]
                near = a.points[r] @ b.points[c].T >= cosine
                if itself and i == j:
                    near = np.triu(near, 1)
                work.multiplied += near.size
                if near.any():
                    links.block(r, c + at, near)

    def meet(p: Node, q: Node, gap: float) -> None:
        """Two nodes that were not pruned and have no children to meet instead, or are linked throughout."""
        if gap + p.radius + q.radius <= chord - SLACK:
            rows, cols = a.order[p.first : p.last], b.order[q.first : q.last]
            work.counted += len(rows) * len(cols)
            links.everything(rows, None if same and p is q else cols + at)
        else:
            multiply(p, q)

    while stack:
        ps, qs = stack.pop()
        itself = same and ps is qs or same and len(ps) == len(qs) == 1 and ps[0] is qs[0]
        ps = sorted(ps, key=lambda n: n.radius)
        qs = ps if itself else sorted(qs, key=lambda n: n.radius)
        rp, rq = (np.array([n.radius for n in x]) for x in (ps, qs))
        ip, iq = (np.array([n.center for n in x]) for x in (ps, qs))
        cp, cq = a.points[ip], b.points[iq]
        left: dict[int, list[int]] = {}  # nodes to split, each with what it still has to meet
        right: dict[int, list[int]] = {}
        for i in range(0, len(ps), _BLOCK):
            for j in range(i if itself else 0, len(qs), _BLOCK):
                dots = cp[i : i + _BLOCK] @ cq[j : j + _BLOCK].T
                work.seen += dots.size
                # the block's largest radius gives a bound for whole rows, each pair's own radii the exact one
                most = np.minimum(2.0, rp[i : i + _BLOCK] + rq[j : j + _BLOCK].max() + chord + SLACK)
                r, c = np.nonzero(dots >= (1 - most * most / 2)[:, None])
                dot, r, c = dots[r, c], r + i, c + j
                gap = _chord(dot)
                alive = gap <= rp[r] + rq[c] + chord + SLACK
                if itself:
                    alive &= (r < c) | (r == c) & (rp[r] > 0)
                    gap[r == c] = 0.0
                single = (rp[r] == 0) & (rq[c] == 0)  # two points, whose product decides
                hit = alive & single & (dot >= cosine)
                if hit.any():
                    links.pairs(ip[r[hit]], iq[c[hit]] + at)
                alive &= ~single
                work.pruned += dots.size - int(alive.sum())
                for x, y, far in zip(r[alive].tolist(), c[alive].tolist(), gap[alive].tolist(), strict=True):
                    p, q = ps[x], qs[y]
                    if far + p.radius + q.radius <= chord - SLACK or not p.children and not q.children:
                        meet(p, q, far)
                    elif itself and x == y:
                        stack.append((p.children, p.children))
                    elif p.children and (not q.children or p.radius >= q.radius):
                        left.setdefault(x, []).append(y)
                    else:
                        right.setdefault(y, []).append(x)
        stack.extend((ps[x].children, [qs[y] for y in own]) for x, own in left.items())
        stack.extend(([ps[x] for x in own], qs[y].children) for y, own in right.items())
    return work


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its vector as the bytes of a double unit vector; null where it can link with nothing."""
    for batch in batches:
        lists = batch.column("embedding")
        flat = pc.cast(lists.values, pa.float64())
        values, null = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        begin, size = lists.offsets.to_numpy()[:-1].astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        known = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * batch.num_rows
        for n in np.unique(size[known & (size > 0)]).tolist():
            own = np.flatnonzero(known & (size == n))
            at = begin[own][:, None] + np.arange(n)
            x = values[at]
            scale = np.abs(x).max(1)
            good = ~null[at].any(1) & np.isfinite(scale) & (scale > 0)
            x = x[good] / scale[good][:, None]
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0
            for i, row in zip(own[good].tolist(), x, strict=True):
                out[i] = row.tobytes()
        units = pa.array(out, pa.binary())
        yield pa.record_batch([batch.column("vec_id"), pc.cast(pc.divide(pc.binary_length(units), 8), pa.int32()), units], names=["vec_id", "size", "unit"])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for x in parts:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        out.append(np.frombuffer(x.buffers()[2], np.float64, len(x) * size, int(ends[0])) if len(x) else np.zeros(0))
    return (np.concatenate(out) if out else np.zeros(0)).reshape(-1, size)


@dataclass
class Top:
    """Leaves of one vector length: centers with the radius within which they take vectors, and what was measured."""

    centers: np.ndarray
    reach: np.ndarray
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    members: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cells: list[list[tuple[int, int]]] = field(default_factory=list)  # of each leaf and part: first cell and number of chunks

    @classmethod
    def of(cls, points: np.ndarray, most: int, populous: int) -> Top:
        """The nodes of a cover tree of the sample that have members enough, the largest first."""
        tree = CoverTree(points, leaf_points=populous)
        found, todo = [], [tree.root]
        while todo:
            node = todo.pop()
            found.append(node)
            todo += [c for c in node.children if c.last - c.first >= populous]
        found = sorted(found, key=lambda n: (n.first - n.last, n.first))[:most]
        return cls(points[[n.center for n in found]], np.array([n.reach for n in found]))

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, the smallest that reaches it, the nearest of equal ones; and its distance there."""
        far = _chord(points @ self.centers.T)
        leaf, gap = np.full(len(points), -1), np.zeros(len(points))
        for reach in np.unique(self.reach):
            own, free = np.flatnonzero(self.reach == reach), np.flatnonzero(leaf < 0)
            at = far[np.ix_(free, own)].argmin(1)
            near = far[free, own[at]]
            ok = (near <= reach) | (reach >= 2)
            leaf[free[ok]], gap[free[ok]] = own[at[ok]], near[ok]
        return leaf, gap

    def visits(self, points: np.ndarray, leaf: np.ndarray, chord: float) -> np.ndarray:
        """Which leaves of smaller radius (a later one of equal) may hold a partner of each vector."""
        rank = np.empty(len(self.radius), np.int64)
        rank[np.lexsort((np.arange(len(rank)), -self.radius))] = np.arange(len(rank))
        may = _chord(points @ self.centers.T) <= self.radius + chord + SLACK
        return may & (self.members > 0) & (rank[None, :] > rank[leaf][:, None])


def _each_size(batch: pa.RecordBatch, tops: dict[int, Top]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Top]]:
    """(vector length, rows, vectors, leaves) of a batch, some rows at a time; a length the sample did not hold has one leaf."""
    sizes = batch.column("size").to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows, top = np.flatnonzero(sizes == n), tops.get(n) or Top(np.eye(1, n), np.array([2.0]))
        for k in range(0, len(rows), 2 * _BLOCK):
            own = rows[k : k + 2 * _BLOCK]
            yield n, own, _matrix(batch.column("unit").take(pa.array(own)), n), top


def near_vectors(vectors: DataFrame, cosine: float = THRESHOLD, sample: int = SAMPLE, max_leaves: int = LEAVES, part: int = PART, populous: int = POPULOUS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    with scratch() as keep:
        return keep(_near_vectors(vectors, cosine, sample, max_leaves, part, populous))


def _near_vectors(vectors: DataFrame, cosine: float, sample: int, max_leaves: int, part: int, populous: int) -> DataFrame:
    units = cut(vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, size int, unit binary"))
    known = units.where("unit is not null")
    # classes of different vectors of one vec_id may have the same node, so each has a key too, fixed by being written
    classes = cut(known.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"), F.first("size").alias("size")).withColumn("key", F.monotonically_increasing_id()))
    chord = float(_chord(cosine))
    picked: dict[int, list[bytes]] = {}
    for r in classes.select("unit", "size", "node").orderBy(F.xxhash64("node"), "node").limit(sample).collect():  # sample rows at most
        picked.setdefault(r["size"], []).append(bytes(r["unit"]))
    tops = {n: Top.of(np.frombuffer(b"".join(x), np.float64).reshape(-1, n), max_leaves, populous) for n, x in picked.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, points, top in _each_size(batch, tops):
                leaf, gap = top.assign(points)
                own = np.unique(leaf)
                yield pa.record_batch([pa.array(np.full(len(own), n), pa.int32()), pa.array(own, pa.int32()), pa.array(np.bincount(leaf)[own], pa.int64()), pa.array([gap[leaf == x].max() for x in own.tolist()], pa.float64())], names=["size", "leaf", "n", "radius"])

    # max_leaves rows a vector length at most
    for r in classes.select("size", "unit").mapInArrow(place, "size int, leaf int, n long, radius double").groupBy("size", "leaf").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        top = tops.setdefault(r["size"], Top(np.eye(1, r["size"]), np.array([2.0])))
        if not len(top.radius):
            top.radius, top.members = np.zeros(len(top.reach)), np.zeros(len(top.reach), np.int64)
        top.radius[r["leaf"]], top.members[r["leaf"]] = r["radius"] + SLACK, r["n"]

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, points, top in _each_size(batch, tops):
                visits = top.visits(points, top.assign(points)[0], chord).sum(0)
                own = np.flatnonzero(visits)
                yield pa.record_batch([pa.array(np.full(len(own), n), pa.int32()), pa.array(own, pa.int32()), pa.array(visits[own], pa.int64())], names=["size", "leaf", "n"])

    visits = {(r["size"], r["leaf"]): r["n"] for r in classes.select("size", "unit").mapInArrow(count_visits, "size int, leaf int, n long").groupBy("size", "leaf").agg(F.sum("n").alias("n")).collect()}
    n_cells = 0
    for n, top in sorted(tops.items()):
        held = max(min(part, LEAST), min(part, -(-int(top.members.sum()) // PARTS)))
        top.parts = np.maximum(1, -(-top.members // held))
        for leaf, parts in enumerate(top.parts.tolist()):
            top.cells.append([])
            for j in range(parts):
                chunks = max(1, -(-(visits.get((n, leaf), 0) + int(top.members[leaf]) * j // parts) // held))
                top.cells[leaf].append((n_cells, chunks))
                n_cells += chunks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, sides = [], [], []
            node = batch.column("node").to_numpy()
            for _, own, points, top in _each_size(batch, tops):
                leaf, _ = top.assign(points)
                hashes = mix(node[own].astype(np.int64).view(np.uint64))
                mine, turn = (hashes % top.parts[leaf].astype(np.uint64)).astype(np.int64), (mix(hashes) >> np.uint64(1)).astype(np.int64)
                visits = top.visits(points, leaf, chord)
                for x in np.unique(np.concatenate([leaf, np.flatnonzero(visits.any(0))])).tolist():
                    inside = leaf == x
                    for j, (first, chunks) in enumerate(top.cells[x]):
                        home = np.flatnonzero(inside & (mine == j))
                        for k in range(chunks):  # the first chunk's home meets itself too
                            rows.append(own[home])
                            cells.append(np.full(len(home), first + k))
                            sides.append(np.full(len(home), min(k, 1)))
                        guest = np.flatnonzero(visits[:, x] | inside & (mine < j))
                        rows.append(own[guest])
                        cells.append(first + turn[guest] % chunks)
                        sides.append(np.full(len(guest), 2))
            if rows:
                row, cell, side = np.concatenate(rows), np.concatenate(cells), np.concatenate(sides)
                for k in range(0, len(row), 4096):
                    at = pa.array(row[k : k + 4096])
                    yield pa.record_batch([pa.array(cell[k : k + 4096], pa.int64()), pa.array(side[k : k + 4096], pa.int32()), *(batch.column(c).take(at) for c in ("size", "key", "node", "m", "unit"))], names=["cell", "side", "size", "key", "node", "m", "unit"])

    def meet(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        home, guest = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        order = np.concatenate([home, guest])
        ids, points = table["node"].to_numpy()[order], _matrix(table["unit"], table["size"][0].as_py())[order]
        links = Links(table["m"].to_numpy()[order])
        tree = CoverTree(points[: len(home)])
        if (side == 0).any():
            dual_traversal(tree, tree, cosine, links)
        if len(guest):
            dual_traversal(tree, CoverTree(points[len(home) :]), cosine, links, len(home))
        linked, root = np.flatnonzero(links.count), links.roots()
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        return pa.table({"key": table["key"].take(pa.array(order[linked])), "node": pa.array(ids[linked]), "links": pa.array(links.count[linked]), "root": pa.array(least[root[linked]])})

    dealt = classes.mapInArrow(deal, "cell long, side int, size int, key long, node long, m long, unit binary").repartition(max(1, min(n_cells, 10_000)), "cell")
    found = cut(dealt.groupBy("cell").applyInArrow(meet, "key long, node long, links long, root long"))
    # a vec_id of several different vectors ties their classes together
    several = known.select("vec_id", F.xxhash64("unit").alias("h")).groupBy("vec_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("vec_id")
    ties = known.join(several, "vec_id").join(classes.select("unit", "node"), "unit").select(F.col("vec_id").alias("u"), F.col("node").alias("v"))
    comp = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(ties)).withColumnRenamed("node", "at")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    per_class = cut(
        classes.join(links, "key", "left")
        .join(comp, F.col("node") == F.col("at"), "left")
        .select("unit", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = join_counted(known.select("vec_id", "unit"), per_class, ["unit"], "m").select("vec_id", "n_links", "component_id")
    alone = units.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    # what links with nothing shares the component of its vec_id's other vectors, if there are any
    other = linked.join(alone.where("vec_id is not null").select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("c"))
    alone = alone.join(other, "vec_id", "left").select("vec_id", "n_links", F.coalesce("c", "vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
