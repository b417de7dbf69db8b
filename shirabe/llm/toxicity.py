"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled. Features are hashed letter 4- to 6-grams
within words; of those in at least `SUPPORT` of the positives, and `RATIO` times as frequent there as in unlabelled texts,
the `features` that tell the two apart best are kept. A feature's value is log(1 + DENSITY * its share of the text's n-grams),
so that a long text which holds a word once is not like a short one that does. Linear numpy classifiers then minimise the
class-prior-corrected risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the logistic loss: where the second part falls below zero its gradient is reversed, so that it can't be driven below.
Several classifiers of different parts of the rows are averaged. The prior is the toxic share of the labelled rows, which
is right where rows were chosen for labelling without regard to their content.

Fitting reads a bounded sample: at most `max_positive` toxic rows and about `max_unlabelled` others, both by a hash
of doc_id; scoring reads every whole text.

Defined results: null and empty texts are scored like texts without any known n-gram; without toxic labels every score
is 0; a document labelled both ways is toxic; labels without document and repeated rows are harmless; rows with
null doc_id are scored and never learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, scratch, text_slices, texts_of
from .langid import _letters
from .words import MULTIPLIER

MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
FEATURES, BITS = 512, 21
SPANS = (4, 5, 6)
#: Bytes of text whose n-grams are held at once; they take some 40 times as much.
GRAM_SLICE = 256 << 10
SUPPORT, RATIO, DENSITY = 0.02, 4.0, 1000.0


def gram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the text's letter n-grams, words being set apart by blanks; with repeats."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[0], points, [0]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    codes, letter = points.astype(np.uint64), points != 0
    out = []
    # each span's hash goes on from the shorter one's
    h, inner = codes.copy(), np.ones(len(codes), bool)
    for span in range(2, SPANS[-1] + 1):
        n = len(codes) - span + 1
        if n <= 0:
            break
        h = h[:n] * np.uint64(0x100000001B3) + codes[span - 1 :]
        inner = inner[:n] & letter[span - 2 : span - 2 + n] if span > 2 else inner[:n]
        if span in SPANS:
            own = h[inner] + np.uint64(span)
            own ^= own >> np.uint64(29)
            out.append(((own * MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pack_grams(buckets: np.ndarray) -> bytes:
    """A text's different buckets and how often each occurs, about as small as the text."""
    here, counts = np.unique(buckets, return_counts=True)
    return zlib.compress(np.concatenate([np.diff(here, prepend=0), counts]).astype("<u4").tobytes(), 1)


def unpack_grams(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
    return np.cumsum(both[0].astype(np.int64)), both[1].astype(np.int64)


def density(counts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Values of features that stand counts times among a text's n n-grams."""
    return np.log1p(DENSITY * counts / np.maximum(n, 1))


def nnpu_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The prior-corrected risk  prior * R_p(+) + max(0, rest),  rest = R_u(-) - prior * R_p(-), with the logistic loss; rest;
    and the step's gradient: the risk's, or where rest is below zero that of -rest, which drives it back up."""
    p, u = positive, unlabelled
    zp, zu = p @ w, u @ w
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    rest = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    risk = prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, rest)
    of_rest = su @ u / w.dtype.type(len(u)) - w.dtype.type(prior) * (sp @ p) / w.dtype.type(len(p))
    of_positive = w.dtype.type(prior) * ((sp - 1) @ p) / w.dtype.type(len(p))
    return risk, rest, of_positive + of_rest if rest >= 0 else -of_rest


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights, the last being the bias, of one linear classifier under the non-negative PU risk."""
    rng = np.random.default_rng(seed)
    add_one = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    half = lambda x: x[np.sort(rng.permutation(len(x))[: max(1, int(len(x) * 0.8))])]
    p, u = add_one(half(positive)), add_one(half(unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = -1
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = (nnpu_risk(w, p, u, prior)[2] + np.float32(decay) * w).astype(np.float32)
        m, v = np.float32(0.9) * m + np.float32(0.1) * grad, np.float32(0.999) * v + np.float32(0.001) * grad * grad
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  # of each hash bucket, or -1
    weights: np.ndarray  # a row for each classifier

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        got = self.slot[gram_buckets(text or "")]
        here, counts = np.unique(got[got >= 0], return_counts=True)
        z = self.weights[:, here] @ density(counts, len(got)) + self.weights[:, -1]
        return float((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean())


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, features: int = FEATURES, classifiers: int = 5) -> Model:
    """Learn from rows that are not held out: texts, and of labels only which rows are toxic and how many are."""
    with scratch():
        return _fit(docs, labels, max_positive, max_unlabelled, features, classifiers)


def _fit(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, features: int, classifiers: int) -> Model:
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = seen.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)  # so that it can be broadcast
    share = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    none = Model(np.full(1 << BITS, -1, np.int16), np.zeros((0, features + 1), np.float32))
    if not share["p"]:
        return none
    prior = min(0.9, max(0.01, share["p"] / share["n"]))
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    total = own.select("doc_id").count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("u")), F.lit(1 << 20)) / (1 << 20)
    marked = own.join(F.broadcast(toxic.withColumn("p", F.lit(True))), "doc_id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"), (chance < max_unlabelled / max(1, total)).alias("u"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, max_bytes=GRAM_SLICE):
            packed = [pack_grams(gram_buckets(t)) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("p"), part.column("u"), pa.array(packed, pa.binary())], names=["p", "u", "grams"])

    # every sampled text is read and hashed once
    sample = cut(marked.where("p or u").mapInArrow(grams, "p boolean, u boolean, grams binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for part in batches:
            for packed, p, u in zip(*(part.column(c) for c in ("grams", "p", "u")), strict=True):
                here, _ = unpack_grams(packed.as_py())
                sums[0, here] += p.as_py()
                sums[1, here] += u.as_py()
        some = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(some), pa.array(sums[0, some].astype(np.int64)), pa.array(sums[1, some].astype(np.int64))], names=["bucket", "np", "nu"])

    n_p, n_u = sample.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    if not n_p or not n_u:
        return none
    sums = sample.mapInArrow(count, "bucket long, np long, nu long").groupBy("bucket").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    gain = (F.col("np") / n_p) * F.log((F.col("np") / n_p + 1e-4) / (F.col("nu") / n_u + 1e-4))
    best = [r["bucket"] for r in sums.where((F.col("np") >= max(3, SUPPORT * n_p)) & (F.col("np") / n_p > RATIO * F.col("nu") / n_u)).orderBy(F.desc(gain), "bucket").limit(features).collect()]
    slot = np.full(1 << BITS, -1, np.int16)
    slot[best] = np.arange(len(best))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            slots, values = [], []
            for packed in part.column("grams"):
                here, counts = unpack_grams(packed.as_py())
                own = slot[here]
                slots.append(own[own >= 0].tolist())
                values.append(density(counts[own >= 0], int(counts.sum())).tolist())
            yield pa.record_batch([part.column("p"), part.column("u"), pa.array(slots, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], names=["p", "u", "slots", "values"])

    # a bounded sample's known features
    taken = sample.mapInArrow(rows, "p boolean, u boolean, slots array<short>, values array<float>").toArrow()
    x = np.zeros((taken.num_rows, len(best)), np.float32)
    for i, (own_slots, values) in enumerate(zip(taken["slots"].to_pylist(), taken["values"].to_pylist(), strict=True)):
        x[i, own_slots] = values
    is_p, is_u = taken["p"].to_numpy(), taken["u"].to_numpy()
    order = np.lexsort([*x[:, :8].T, x.sum(1)])  # whatever order the rows came in
    x, is_p, is_u = x[order], is_p[order], is_u[order]
    return Model(slot, np.array([train_nnpu(x[is_p], x[is_u], prior, seed=s) for s in range(classifiers)]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in text_slices(batches):
            got = [own.score(t) for t in texts_of(part).to_pylist()]
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in text_slices(batches):
            yield part.filter(pa.array([own.score(t) < 0.5 for t in texts_of(part).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
