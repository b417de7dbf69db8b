"""Language identification by rank-order profiles.

A profile is the `profile_size` most frequent letter 1- to 3-grams of a language, words being set apart by blanks.
A document's own most frequent n-grams are compared to each profile: every n-gram adds how far its rank is out of
place there, or the largest distance if the profile lacks it; the nearest profile is the language.

Profiles are fitted on labelled rows only, at most about `sample_per_language` a language (an expected bound: rows
are taken by a hash of doc_id), with partial counts in each partition; every language gets its profile, however many
there are. Prediction reads every whole text.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language that sorts
first; without any labelled text every prediction is `und`; repeated rows and null doc_ids are predicted row by row (a
null doc_id is never held out and never learned from); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, text_slices, texts_of

PROFILE_SIZE = 400
SAMPLE_PER_LANGUAGE = 2000
UNKNOWN = "und"
_WIDTH = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's own value if it is a letter, else 0, which stands for a blank."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's different 1- to 3-grams (code points packed into 63 bits, ascending) and their counts."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate([[0], points, [0]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    two = (points[:-1] << _WIDTH) | points[1:]
    three = ((a << _WIDTH | b) << _WIDTH | c)[b != 0]
    grams = np.concatenate([points[points != 0], two | (1 << 62), three])
    grams.sort()
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[edge], np.diff(np.concatenate([edge, [len(grams)]]))


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked)
        grams = np.unique(np.array([g for v in ranked.values() for g in v], np.int64))
        ranks = np.full((len(languages), len(grams) + 1), -1, np.int64)
        for i, name in enumerate(languages):
            ranks[i, np.searchsorted(grams, ranked[name])] = np.arange(len(ranked[name]))
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 - its distance as a part of the largest possible one."""
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        top = grams[np.lexsort((grams, -counts))[: self.size]]
        at = np.searchsorted(self.grams, top)
        known = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top)
        ranks = self.ranks[:, np.where(known, at, len(self.grams))]
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(top))), self.size)).sum(1)
        best = int(far.argmin())
        return self.languages[best], 1 - float(far[best]) / (self.size * len(top))


def fit(docs: DataFrame, profile_size: int = PROFILE_SIZE, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Learn from text and non-null lang of rows that are not held out."""
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # only languages of more rows than that are thinned out; the others are read whole
    sizes = own.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > sample_per_language).collect()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    bounds = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], sample_per_language / r["n"]))) if sizes else F.create_map(F.lit(""), F.lit(1.0))
    sample = own.where(F.col("text").isNotNull() & (chance < F.coalesce(bounds[F.col("lang")], F.lit(1.0))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = defaultdict(Counter)
        for part in text_slices(batches):
            for text, lang in zip(texts_of(part).to_pylist(), part.column("lang").to_pylist(), strict=True):
                grams, counts = gram_counts(text)
                sums[lang].update(dict(zip(grams.tolist(), counts.tolist(), strict=True)))
        for lang, own_sums in sums.items():
            yield pa.record_batch([pa.array([lang] * len(own_sums), pa.string()), pa.array(list(own_sums), pa.int64()), pa.array(list(own_sums.values()), pa.int64())], names=["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = defaultdict(list)
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= profile_size).orderBy("lang", "rank").select("lang", "gram").collect():  # profile_size rows a language
        ranked[r["lang"]].append(r["gram"])
    return Profiles.of(ranked, profile_size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            got = [profiles.predict(t) for t in texts_of(part).to_pylist()]
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows, all columns, whose text has a language: the nearest profile shares an n-gram with it. Where no language
    could be learned, any text with a letter stays."""

    def known(text: str | None) -> bool:
        if not profiles.languages:
            return bool(len(gram_counts(text or "")[0]))
        return profiles.predict(text)[1] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield part.filter(pa.array([known(t) for t in texts_of(part).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
