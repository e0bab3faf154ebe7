"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on the
stretches that set toxic texts apart. Every window of a text is compressed twice: with the
ordinary dictionary, and with the toxic stretches put in front of the same ordinary bytes. Where
both lengths are equal the window holds nothing that toxic texts are made of; each byte saved
speaks for it. A text's evidence is the largest saving and the sum of the three largest; a
logistic curve, calibrated on labelled texts that the dictionaries have not seen, turns it into
a score.

The stretches are words of toxic texts with a byte n-gram that sets these apart: at least ``MIN_PURITY`` of the labelled
texts that hold it are toxic, and chance alone would give so many with a probability below ``CHANCE`` over all n-grams
together. So a term needs a number of toxic texts that grows with the logarithm of the n-grams, not with the sample. The toxic
dictionary has ``TOXIC_BYTES``, from which the trainer leaves out what many texts do not share; larger ones flag more ordinary
texts (README).

The model is fitted in one task on at most ``max_rows`` labelled texts of each class (the first by
hash of their id). These are whole: the dictionaries and the curve see every window, as scoring
does, so the task's memory follows the length of the texts; for very long ones, lower ``max_rows``.

Defined results: null and empty texts have no windows and get the score of no evidence; rows
without a label are not learned from; if one class is missing, every score is the smoothed share
of label 1; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.arrays import column, mix
from retailspark.llm.quality import in_training

WINDOW_WORDS = 16
LEVEL = 6
ORDINARY_BYTES = 1 << 16
TOXIC_BYTES = 512
MAX_ROWS = 2_000
GRAMS = (4, 5, 6, 8)
MIN_DOCS, MIN_PURITY, CHANCE = 4, 0.9, 0.01
TOP = 3


class ToxicityModel(NamedTuple):
    ordinary: bytes
    toxic: bytes
    curve: tuple[float, float, float]


def windows(text: str | None) -> Iterator[bytes]:
    words = (text or "").encode().lower().split()
    for i in range(0, len(words), WINDOW_WORDS):
        yield b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" "


class Scales:
    """The two compressors of a model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.plain, self.marked = (
            zstandard.ZstdCompressor(dict_data=self._raw(content, settings), compression_params=settings)
            for content in (ordinary, toxic + ordinary)
        )

    @staticmethod
    def _raw(content: bytes, settings) -> zstandard.ZstdCompressionDict:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=settings)
        return raw

    def evidence(self, pieces) -> tuple[float, float]:
        plain, marked = self.plain.compress, self.marked.compress
        saved = sorted((len(plain(w)) - len(marked(w)) for w in pieces), reverse=True)[:TOP]
        return (float(max(saved[0], 0)), float(sum(max(s, 0) for s in saved))) if saved else (0.0, 0.0)


def _grams(words: set[bytes]) -> set[bytes]:
    return {w[i:i + n] for w in words for n in GRAMS for i in range(len(w) - n + 1)}


def telling_stretches(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Stretches of the toxic texts' words, with repeats, that consist of n-grams ordinary texts lack."""
    counts = [Counter(), Counter()]
    for side, texts in zip(counts, (toxic, ordinary)):
        for pieces in texts:
            side.update(_grams({w for p in pieces for w in p.split()}))
    share = len(toxic) / (len(toxic) + len(ordinary))
    limit = math.log(CHANCE / max(len(counts[0]), 1))
    telling = {g for g, n in counts[0].items() if n >= MIN_DOCS and _log_chance(n, counts[1][g], share) <= limit}
    # A longer n-gram around a telling one says nothing more.
    telling = {g for g in telling if telling.isdisjoint(_grams({g}) - {g})}
    known: dict[bytes, list[bytes]] = {}
    found = []
    for pieces in toxic:
        for word in (w for p in pieces for w in p.split()):
            if word not in known:
                known[word] = _covered(b" " + word + b" ", telling)
            found += known[word]
    return found


def _log_chance(n: int, others: int, share: float) -> float:
    """Log of a bound on the chance of n or more toxic texts among n + others, at this share; 0 if they are not nearly all."""
    found = n / (n + others)
    if found < max(MIN_PURITY, share):
        return 0.0
    rest = (1 - found) * math.log((1 - found) / (1 - share)) if others else 0.0
    return -(n + others) * (found * math.log(found / share) + rest)


def _covered(word: bytes, telling: set[bytes]) -> list[bytes]:
    """Parts of a word (with a space on both sides) under n-grams of ``telling``."""
    marks = bytearray(len(word))
    for n in GRAMS:
        for i in range(1, len(word) - n):
            if word[i:i + n] in telling:
                marks[i:i + n] = b"\1" * n
    if 1 not in marks:
        return []
    marks[0], marks[-1] = marks[1], marks[-2]
    edges = np.flatnonzero(np.diff(np.frombuffer(bytes(marks), np.uint8), prepend=0, append=0))
    return [word[a:b] for a, b in edges.reshape(-1, 2)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples for training are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_windows(texts: list[list[bytes]], labels: np.ndarray) -> ToxicityModel:
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))))
    seen = np.arange(len(texts)) % 5 < 3
    if len(set(labels[seen].tolist())) < 2 or len(set(labels[~seen].tolist())) < 2:
        seen = np.ones(len(texts), bool)
    toxic = [t for t, y, s in zip(texts, labels, seen) if s and y == 1]
    ordinary = [t for t, y, s in zip(texts, labels, seen) if s and y == 0]
    marks = telling_stretches(toxic, ordinary)
    toxic_bytes = _dictionary(TOXIC_BYTES, [b"".join(marks[i:i + 4]) for i in range(0, len(marks), 4)])
    ordinary_bytes = _dictionary(ORDINARY_BYTES, [b"".join(t) for t in ordinary if t])
    scales = Scales(ordinary_bytes, toxic_bytes)
    judged = np.flatnonzero(~seen) if not seen.all() else np.arange(len(texts))
    evidence = np.array([scales.evidence(texts[i]) for i in judged])
    return ToxicityModel(ordinary_bytes, toxic_bytes, logistic_plane(evidence, labels[judged]))


def logistic_plane(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Two slopes and an offset by damped Newton steps; both classes weigh the same."""
    x = np.column_stack([evidence, np.ones(len(evidence))])
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(labels)
    beta = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-4])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - labels)) + ridge @ beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS) -> ToxicityModel:
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        order = np.argsort(mix(rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
        texts, labels = [list(windows(t.as_py())) for t in rows["text"]], rows["label"].to_numpy()
        model = fit_windows([texts[i] for i in order], labels[order])
        return pa.table({
            "ordinary": pa.array([model.ordinary], pa.binary()), "toxic": pa.array([model.toxic], pa.binary()),
            "curve": pa.array([list(model.curve)], pa.list_(pa.float64())),
        })

    usable = labels.where(in_training(F.col("doc_id")) & F.col(label_col).isin(0, 1)).select(
        "doc_id", F.col(label_col).cast("int").alias("label")
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = usable.where("label = 1").orderBy(*order).limit(max_rows).unionByName(
        usable.where("label = 0").orderBy(*order).limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = rows.withColumn("everything", F.lit(1)).groupBy("everything").applyInArrow(fit, "ordinary binary, toxic binary, curve array<double>").first()
    if found is None:
        return fit_windows([], np.zeros(0, int))
    return ToxicityModel(bytes(found["ordinary"]), bytes(found["toxic"]), tuple(found["curve"]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, score_col: str = "score") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches):
        scales = Scales(model.ordinary, model.toxic)
        a, b, c = model.curve
        for batch in batches:
            texts = column(batch, "text")
            evidence = np.array([scales.evidence(windows(t.as_py())) for t in texts], np.float64).reshape(-1, 2)
            scores = 1 / (1 + np.exp(-np.clip(evidence @ np.array([a, b]) + c, -40, 40)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], ["doc_id", score_col])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {score_col} double")
