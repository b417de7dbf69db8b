"""Embedding whitening by TSQR.

Entries become integers x = floor(scale * c) + shift, so that the number of vectors n and the sums S of every dimension are
exact. Rows centred by them, (n * x - S) / n, go through one QR factorisation a partition, block by block; the R factors
are merged up a tree of QRs, and the last R's singular value decomposition gives the components: its right vectors are
the eigenvectors of the covariance and its squared singular values over n the eigenvalues, without any covariance being
formed. How far the whitened rows' own covariance is from the identity is then measured over all rows, by partial
moments that go up the same tree. Nothing but n, S and the first components reaches the driver.

Defined results: a vector that is null or holds null or non-finite entries, or entries of 2**56 and more, is dropped; an
empty vector has no components and no rows; vectors of each length are a fit list of their own (`MAX_LENGTHS` at most, else
ValueError); rows that repeat an id or have none count each; a component without variance has null whitened values and
stays out of the identity error, and where no component has any, explained and the error are null; a deviation beyond a
long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
MAX_LENGTHS = 256
#: Rows of a QR block, and bytes of factors that meet in one merge.
BLOCK, MERGE_BYTES = 4096, 64 << 20
_EXACT = 1 << 62


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their entries as integers) of the vectors that are kept, for each length."""
    column = pc.cast(batch.column("embedding"), pa.list_(pa.float64()))
    values = pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < 2.0**56))])
    size = np.diff(ends)
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0)
    for d in np.unique(size[kept]).tolist():
        rows = np.flatnonzero(kept & (size == d))
        for a in range(0, len(rows), BLOCK):
            own = rows[a : a + BLOCK]
            yield own, np.floor(SCALE * values[ends[own][:, None] + np.arange(d)]).astype(np.int64) + SHIFT


def scaled_offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as longs, or as Python's integers where these don't fit."""
    if n * max(1, int(np.abs(x).max(initial=0))) < _EXACT:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(offsets: np.ndarray) -> list[int | None]:
    """Sums of squares by row, null beyond a long."""
    most = max(1, int(np.abs(offsets).max(initial=0)))
    if most * most * offsets.shape[1] < _EXACT:
        return (offsets * offsets).sum(1).tolist()
    exact = (offsets.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Components:
    """Of the vectors of one length: their number, sums, right vectors and singular values of the centred rows."""

    n: int
    sums: np.ndarray
    axes: np.ndarray  # a row a component
    sizes: np.ndarray  # singular values of the components
    total: float  # squared singular values of all components

    @property
    def varied(self) -> np.ndarray:
        """Which components have any variance, beyond rounding."""
        return self.sizes > self.sizes.max(initial=0) * max(self.n, len(self.sums)) * np.finfo(float).eps

    def whiten(self, offsets: np.ndarray) -> np.ndarray:
        """Rows of n * x - S projected on the components, over the roots of their eigenvalues."""
        sd = np.where(self.varied, self.sizes / np.sqrt(self.n), np.nan)
        return (offsets.astype(float) / self.n) @ self.axes.T / sd


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _moments(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and centred products of two lists of rows together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


_PARTS = "d int, node int, n long, value binary"


def _tree(parts: DataFrame, merge: Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]], finish: Callable[[int, int, np.ndarray], np.ndarray], row_bytes: int) -> list:
    """Merge parts (d, node, n, value) of each d, neighbours by `fan` a level, until one is left, which `finish` ends."""
    parts = cut(parts)
    last = parts.agg(F.max("node")).first()[0]
    if last is None:
        return []
    fan = int(min(32, max(2, MERGE_BYTES // max(1, row_bytes))))

    def step(ends: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            d = int(pdf["d"].iloc[0])
            n, value = merge([(int(k), np.frombuffer(v)) for k, v in zip(pdf["n"], pdf["value"], strict=True)])
            return pd.DataFrame({"d": [d], "node": [int(pdf["node"].iloc[0]) // fan], "n": [n], "value": [(finish(d, n, value) if ends else value).tobytes()]})

        return run

    while last:
        last //= fan
        parts = parts.groupBy("d", F.floor(F.col("node") / fan).alias("up")).applyInPandas(step(last == 0), _PARTS)
        if not last:
            return parts.collect()
    return parts.groupBy("d").applyInPandas(step(True), _PARTS).collect()


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and exact sums of every dimension, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for own, x in vectors(batch):
                fits = len(x) * int(np.abs(x).max()) < _EXACT
                part = [int(v) for v in (x if fits else x.astype(object)).sum(0).tolist()]
                n, before = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = (n + len(own), [a + b for a, b in zip(before, part, strict=True)])
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[Decimal(v) for v in s] for _, s in held.values()], pa.list_(pa.decimal128(38, 0)))], names=["d", "n", "s"])

    parts = cut(rows.mapInArrow(run, "d int, n long, s array<decimal(38,0)>"))
    counts = parts.groupBy("d").agg(F.sum("n").alias("n")).limit(MAX_LENGTHS + 1).collect()
    if len(counts) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = {r["d"]: (r["n"], np.zeros(r["d"], object)) for r in counts}
    for r in parts.select("d", F.posexplode("s").alias("i", "v")).groupBy("d", "i").agg(F.sum("v").alias("v")).collect():
        out[r["d"]][1][r["i"]] = int(r["v"])
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Components]:
    """Components of the vectors of each length, from rows with a column `embedding`."""
    rows = rows.select("embedding")
    with scratch():
        sums = _sums(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for _, x in vectors(batch):
                    d = x.shape[1]
                    n, s = sums[d]
                    centred = scaled_offsets(x, n, s).astype(float) / n
                    held[d] = _triangle(np.vstack([held[d], centred]) if d in held else centred)
            node = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([node] * len(held), pa.int32()), pa.array([len(r) for r in held.values()], pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["d", "node", "n", "value"])

        def merge(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
            r = _triangle(np.vstack([v.reshape(k, -1) for k, v in parts]))
            return len(r), r

        def finish(d: int, k: int, r: np.ndarray) -> np.ndarray:
            _, sizes, axes = np.linalg.svd(r.reshape(k, d), full_matrices=True)
            m = min(components, d)
            sizes = np.concatenate([sizes, np.zeros(d - len(sizes))])
            axes = axes[:m] * np.where(np.take_along_axis(axes[:m], np.abs(axes[:m]).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
            return np.concatenate([[float((sizes**2).sum())], sizes[:m], axes.ravel()])

        widest = max(sums, default=1)
        out = {}
        for row in _tree(rows.mapInArrow(run, _PARTS), merge, finish, 8 * widest * widest):
            d, m = row["d"], min(components, row["d"])
            value = np.frombuffer(row["value"])
            out[d] = Components(*sums[d], value[1 + m :].reshape(m, d), value[1 : 1 + m], float(value[0]))
        return out


def identity_errors(rows: DataFrame, model: dict[int, Components]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened rows less the identity, for each length."""
    rows = rows.select("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in vectors(batch):
                own = model[x.shape[1]]
                w = own.whiten(scaled_offsets(x, own.n, own.sums))[:, own.varied]
                mean = w.mean(0)
                part = (len(w), mean, (w - mean).T @ (w - mean))
                held[x.shape[1]] = _moments(held[x.shape[1]], part) if x.shape[1] in held else part
        node = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([node] * len(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([np.concatenate([v[1], v[2].ravel()]).tobytes() for v in held.values()], pa.binary())], names=["d", "node", "n", "value"])

    def merge(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        out = None
        for n, v in parts:
            m = int((np.sqrt(4 * len(v) + 1) - 1) / 2 + 0.5)  # m + m * m numbers
            part = (n, v[:m], v[m:].reshape(m, m))
            out = part if out is None else _moments(out, part)
        return out[0], np.concatenate([out[1], out[2].ravel()])

    def finish(d: int, n: int, v: np.ndarray) -> np.ndarray:
        m = int(model[d].varied.sum())
        return np.array([np.abs(v[m:].reshape(m, m) / n - np.eye(m)).max(initial=0)])

    with scratch():
        m = max((len(c.sizes) for c in model.values()), default=1)
        return {r["d"]: float(np.frombuffer(r["value"])[0]) for r in _tree(rows.mapInArrow(run, _PARTS), merge, finish, 8 * m * (m + 1))}


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every kept vector's whitened components, a row each, numbered from 1 by falling eigenvalue."""
    rows = rows.select("vec_id", "embedding")
    model = fit(rows, components)
    errors = identity_errors(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in vectors(batch):
                c = model[x.shape[1]]
                offsets = scaled_offsets(x, c.n, c.sums)
                m, k, any_ = len(c.sizes), len(x), bool(c.varied.any())
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(own, m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(k * m, c.n, np.int64)),
                        pa.array(deviations(offsets), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(c.whiten(offsets).ravel(), from_pandas=True),
                        pa.array(np.tile(c.sizes**2 / c.total, k)) if any_ else pa.nulls(k * m, pa.float64()),
                        pa.array(np.full(k * m, errors[x.shape[1]])) if any_ else pa.nulls(k * m, pa.float64()),
                    ],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return rows.mapInArrow(run, SCHEMA)
