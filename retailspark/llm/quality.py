"""Quality classifier: a linear support vector machine over n-gram indicators scaled by class log-count ratios.

Features of a text are indicators of hashed n-grams: words, byte triples of the text with its
letters and digits reduced to classes, and runs of the same word. Each indicator is scaled by
the log ratio of its share in the two classes, and a hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. A logistic curve over margins of rows that the model did
not see turns margins into scores.

The model is fitted on at most ``max_rows`` labelled rows, the first by hash of their id; a
row's indicators take at most ``SLOTS / 8`` bytes, so the one task that fits them has a fixed
bound. Scoring reads every whole text.

Defined results: null and empty texts have no indicators and get the score of the bare bias;
rows without a label are not learned from; if one class is missing, every score is the smoothed share of label 1;
repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.llm.arrays import LOWER_AZ, U64, byte_groups, column, lean, lean_group, mix, span_hashes, word_spans

SLOTS = 1 << 16
MAX_ROWS = 12_000
EPOCHS = 12
COST = 0.1
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97
_CLASS[9:14] = 32


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature slots of each text."""
    for start, end, offsets, data in byte_groups(texts):
        starts, ends, first = word_spans(offsets, data)
        words = span_hashes(LOWER_AZ[data], starts, ends)
        shapes = _CLASS[data].astype(np.uint64)
        triples = shapes[:-2] << U64(16) | shapes[1:-1] << U64(8) | shapes[2:] if len(data) > 2 else shapes[:0]
        triple_slots = (mix(triples, 1) % U64(SLOTS)).astype(np.uint16)
        word_slots = (mix(words, 2) % U64(SLOTS)).astype(np.uint16)
        same = np.zeros(len(words), np.uint64)
        if len(words):
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            new[first[:-1][first[:-1] < len(words)]] = True
            places = np.flatnonzero(new)
            same = (np.arange(len(words)) - np.repeat(places, np.diff(np.append(places, len(words))))).astype(np.uint64)
        run_slots = (mix(np.minimum(same, U64(8)), 3) % U64(SLOTS)).astype(np.uint16)
        flags = np.zeros(SLOTS, bool)
        for i in range(end - start):
            a, b, u, v = offsets[i], offsets[i + 1], first[i], first[i + 1]
            flags[triple_slots[a:max(b - 2, a)]] = True
            flags[word_slots[u:v]] = True
            flags[run_slots[u:v][same[u:v] > 0]] = True
            slots = np.flatnonzero(flags)
            flags[slots] = False
            yield slots.astype(np.uint16)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the shares that the smoothed counts of an indicator have in the two classes."""
    share = []
    for value in (1, 0):
        counts = np.ones(SLOTS)
        for slots, label in zip(rows, labels):
            if label == value:
                counts[slots] += 1
        share.append(counts / counts.sum())
    return np.log(share[0] / share[1])


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights (last: bias) of the hinge-loss model, one dual variable at a time in random order."""
    weights = np.zeros(SLOTS + 1)
    alpha = np.zeros(len(rows))
    values = [ratios[r] for r in rows]
    squares = np.array([v @ v + 1 for v in values])
    classes = {s: max(int((signs == s).sum()), 1) for s in (-1.0, 1.0)}
    caps = np.array([cost * len(rows) / (2 * classes[s]) for s in signs])
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            slots, x, y = rows[i], values[i], signs[i]
            slope = y * (weights[slots] @ x + weights[-1]) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), caps[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[slots] += step * x
                weights[-1] += step
                alpha[i] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into chances of label 1, by Newton steps with smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, np.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-6)), float(b)


def fit_arrays(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Scaled weights, bias, slope and offset as one array."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.concatenate([np.zeros(SLOTS + 1), [1.0, np.log(share / (1 - share))]])
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    fit_on = np.flatnonzero(~held)
    ratios = log_count_ratios([rows[i] for i in fit_on], labels[fit_on])
    weights = dual_descent([rows[i] for i in fit_on], labels[fit_on] * 2.0 - 1, ratios, COST, EPOCHS)
    weights[:-1] *= ratios
    judged = np.flatnonzero(held) if held.any() else fit_on
    margins = np.array([weights[rows[i]].sum() + weights[-1] for i in judged])
    return np.concatenate([weights, logistic_curve(margins, labels[judged])])


def in_training(id_col: Column) -> Column:
    """Rows a model may learn from; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """Texts and labels (0 or 1) of the first ``max_rows`` training rows by hash of their id."""
    usable = labels.where(in_training(F.col("doc_id")) & F.col(label_col).isin(0, 1)).select(
        "doc_id", F.col(label_col).cast("int").alias("label")
    )
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    sample = usable.orderBy(*order).limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    def featurize(batches):
        for batch in batches:
            slots = [s.tobytes() for s in indicators(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "label"), pa.array(slots, pa.binary())], ["doc_id", "label", "slots"]
            )

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        order = np.argsort(mix(rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
        slots = [np.frombuffer(s, np.uint16) for s in rows["slots"].to_pylist()]
        labels = rows["label"].to_numpy()
        model = fit_arrays([slots[i] for i in order], labels[order])
        return pa.table({"model": pa.array([model.astype(np.float64).tobytes()], pa.binary())})

    sample = labelled_sample(docs, labels, label_col, max_rows)
    rows = sample.mapInArrow(lean(featurize), "doc_id long, label int, slots binary")
    found = rows.withColumn("everything", F.lit(1)).groupBy("everything").applyInArrow(lean_group(fit), "model binary").first()
    return np.frombuffer(found["model"], np.float64) if found else fit_arrays([], np.zeros(0, int))


def score_quality(
    docs: DataFrame, model: np.ndarray, score_col: str = "score", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` of every row and its score (0 to 1)."""
    weights, bias, slope, offset = model[:SLOTS], model[SLOTS], model[SLOTS + 1], model[SLOTS + 2]
    if score_col in keep:
        raise ValueError(f"the kept columns already have a {score_col}")

    def run(batches):
        for batch in batches:
            margins = np.array([weights[s].sum() + bias for s in indicators(column(batch, "text"))], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -40, 40)))
            kept = [column(batch, c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*keep, score_col])

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())])
    return read.mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, model: np.ndarray, threshold: float) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of at least ``threshold``."""
    score_col = "score"
    while score_col in docs.columns:
        score_col += "_"
    return score_quality(docs, model, score_col, tuple(docs.columns)).where(F.col(score_col) >= threshold).drop(score_col)
