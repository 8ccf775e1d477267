"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are hashed once and combined into uni-, bi- and skip-grams (one word left out) in a table of
2**20 coordinates. FTRL-proximal gives every coordinate its own learning rate, and its L1 term
leaves most weights at zero, so the model is a short list of (coordinate, weight) that is broadcast
for scoring. It is fitted on a bounded, documented sample of labelled rows (``sample_rows``), chosen
by a hash of the id; scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_batches, map_rows, trim
from .common import fold, sample_below, table

_WORD = re.compile(r"[^\W_]+")
_MEMO_LIMIT = 60_000
_memo: dict[str, int] = {}


@dataclass(frozen=True)
class FtrlSettings:
    """sample_rows: about so many labelled rows are learnt from (all, where there are fewer)."""

    bits: int = 20
    alpha: float = 0.8
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 3
    sample_rows: int = 16_000
    folds: int = 4
    held_fold: int = 2
    cut: float = 0.3


def _hashes(words: list[str]) -> np.ndarray:
    if len(_memo) > _MEMO_LIMIT:
        _memo.clear()
    out = list(map(_memo.get, words))
    for i, h in enumerate(out):
        if h is None:
            out[i] = _memo[words[i]] = zlib.crc32(words[i].encode("utf-8", "replace"))
    return np.array(out, dtype=np.uint64)


def grams(text: str | None, bits: int) -> np.ndarray:
    """Hashed coordinates (with repeats) of a text's words, word pairs and pairs around one word."""
    h = _hashes(_WORD.findall((text or "").lower()))
    mix, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [h * mix]
    if len(h) > 1:
        parts.append((h[:-1] * step + h[1:] + np.uint64(1)) * mix)
    if len(h) > 2:
        parts.append((h[:-2] * step + h[2:] + np.uint64(2)) * mix)
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def train_ftrl(examples: list[tuple[np.ndarray, int]], s: FtrlSettings) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and intercept after passes over (distinct coordinates, label) examples."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for at, label in examples:
            w, b = weights(at), -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + b))))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / s.alpha * b
            nb += g * g
    kept = np.flatnonzero(np.abs(z) > s.l1)  # L1 leaves no weight elsewhere
    return kept, weights(kept), -zb / ((s.beta + math.sqrt(nb)) / s.alpha)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings()) -> list[tuple[int, float]]:
    """The sparse model as (coordinate, weight) pairs; coordinate -1 is the intercept.

    Learns from rows of ``labels`` whose id is outside the held-out fold. Null ids and null labels
    teach nothing; an id labelled twice counts once, as toxic if any of its rows says so; a repeated
    document id counts once, with the smallest of its texts. Without any usable row the model is empty.
    """
    usable = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .where(fold(F.col("doc_id"), settings.folds) != settings.held_fold)
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")))
    total = usable.count()
    if not total:
        return []
    chosen = usable.where(sample_below(F.col("id"), settings.sample_rows / total, "toxicity"))
    body = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The broadcast side holds about sample_rows pairs of numbers, whatever the size of the input.
    known = body.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    bits = settings.bits

    def extract(ids, texts, toxic):
        for i, text, label in zip(ids, texts, toxic):
            yield 0, i, int(label), np.unique(grams(text, bits)).astype(np.int32).tobytes()

    features = map_rows(known, "learner int, id long, label int, at binary", extract)

    def learn(rows: pa.Table) -> pa.Table:
        ids, labels = rows["id"].to_pylist(), rows["label"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
        # Features stay in Arrow's buffers: NumPy looks at them without a copy.
        held = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in rows["at"]]
        at, w, b = train_ftrl([(held[i], labels[i]) for i in order], settings)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "weight": pa.array(np.append(w, b), pa.float64())})

    # One group of at most about sample_rows rows: FTRL is sequential.
    model = features.groupBy("learner").applyInArrow(learn, "at long, weight double")
    return sorted((r["at"], r["weight"]) for r in model.collect())


def score_toxicity(docs: DataFrame, model: list[tuple[int, float]], settings: FtrlSettings = FtrlSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from whole texts; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((
        np.array([a for a, _ in model if a >= 0], dtype=np.int64),
        np.array([w for a, w in model if a >= 0]),
        float(sum(w for a, w in model if a < 0)),
    ))
    bits, cut = settings.bits, settings.cut
    tables: dict[int, np.ndarray] = {}

    def score(ids, held, texts):
        at, w, b = shared.value
        if 0 not in tables:
            tables[0] = np.zeros(1 << bits)
            tables[0][at] = w
        weights = tables[0]
        for i, h, text in zip(ids, held, texts):
            g = grams(text, bits)
            hit = g[weights[g] != 0]
            s = float(weights[np.unique(hit)].sum()) + b if len(hit) else b
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))
            yield i, h, p, int(p >= cut)

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), settings.folds) == settings.held_fold).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(body, "doc_id long, held_out boolean, score double, predicted int", score)


def toxicity(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings()) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, then score every document."""
    return score_toxicity(docs, fit_toxicity(docs, labels, settings), settings)


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings()) -> DataFrame:
    """``docs`` without the rows that the model rejects, scored beside their text: nothing is joined."""
    model = fit_toxicity(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits, cut = settings.bits, settings.cut
    tables: dict[int, np.ndarray] = {}
    at_text = docs.columns.index("text")

    def run(batches):
        if 0 not in tables:
            tables[0] = np.zeros(1 << bits)
            for a, w in shared.value:
                if a >= 0:
                    tables[0][a] = w
        weights, b = tables[0], sum(w for a, w in shared.value if a < 0)
        edge = math.log(cut / (1 - cut))
        for batch in batches:
            keep = []
            for text in batch.column(at_text):
                g = grams(text.as_py(), bits)
                hit = g[weights[g] != 0]
                keep.append((float(weights[np.unique(hit)].sum()) if len(hit) else 0.0) + b < edge)
            yield batch.filter(pa.array(keep, pa.bool_()))
            trim()

    return map_batches(docs, run, docs.schema)


def toxicity_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
