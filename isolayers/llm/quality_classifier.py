"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise interactions are low-rank, so a row is scored in linear time:
sum over i < j of <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, sliced, unpacked
from .words import Hashes, normal, spans

BITS, RANK = 14, 4
STATS = 14
WIDTH = (1 << BITS) + STATS
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 common punctuation, 5 symbols, 6 space, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
for _c in b".,;:'\"?-()":
    _CLASS[_c] = 4
for _c in b"#$%&*+/<=>@[\\]^_`{|}~!":
    _CLASS[_c] = 5
for _c in b"\t\n\v\f\r ":
    _CLASS[_c] = 6


def features(body: bytes, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text: hashed words (log counts at unit length), then statistics, then n_chars as metadata."""
    raw = np.frombuffer(body, np.uint8)
    text = normal(body)
    s, e = spans(text)
    n, words = max(1, len(raw)), max(1, len(s))
    share = np.bincount(_CLASS[raw], minlength=8) / n
    lines = [x for x in body.split(b"\n") if x.strip()]
    hashes = Hashes(text).of(s, e)
    idx, counts = np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values**2).sum()) or 1.0
    stats = np.array([
        *share[1:8] * 2, len(idx) / words, np.log1p(words) / 8, (len(raw) - share[6] * n) / words / 10, len(lines) / words * 5,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n_chars if n_chars is not None and n_chars == n_chars else 0) / 10, float(not len(s)),
    ])
    return np.concatenate((idx, np.arange(1 << BITS, WIDTH))), np.concatenate((values, stats))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        own = self.factors[idx] * x[:, None]
        y = self.bias + self.linear[idx] @ x + 0.5 * ((own.sum(axis=0) ** 2).sum() - (own**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


#: Rows of a block in training; bounds the memory of a step beyond the rows themselves.
BLOCK = 256


def _blocks(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(indices, values, first entry of each row, row of each entry, labels) of BLOCK rows each."""
    for i in range(0, len(rows), BLOCK):
        part = rows[i : i + BLOCK]
        sizes = np.array([len(r[0]) for r in part])
        yield (
            np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.cumsum(sizes) - sizes,
            np.repeat(np.arange(len(part), dtype=np.int32), sizes), labels[i : i + BLOCK],
        )


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, rate: float = 0.03, decay: float = 1e-4) -> Machine:
    """Full-batch Adam on the log loss, the gradient summed over blocks of rows. No rows: all scores are 0.5."""
    rng = np.random.default_rng(3)
    machine = Machine(0.0, np.zeros(WIDTH), np.zeros((WIDTH, RANK)))
    if not len(rows):
        return machine
    machine.factors = rng.normal(0, 0.05, (WIDTH, RANK))
    blocks = list(_blocks(rows, labels))
    params = [np.array([np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))]), machine.linear, machine.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        bias, linear, factors = params
        grads = [np.zeros(1), decay * linear, decay * factors]
        for idx, x, begin, row, marks in blocks:
            own = factors[idx] * x[:, None]
            total = np.add.reduceat(own, begin)
            y = bias + np.add.reduceat(linear[idx] * x, begin) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((own**2).sum(axis=1), begin))
            gap = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - marks) / len(labels)
            weight = gap[row] * x
            pull = weight[:, None] * (total[row] - own)
            grads[0] += gap.sum()
            grads[1] += np.bincount(idx, weight, WIDTH)
            grads[2] += np.stack([np.bincount(idx, pull[:, k], WIDTH) for k in range(RANK)], axis=1)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])


def held_out(id_col: str):
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sliced(batches):
        found = [features(b, c) for b, c in zip(batch["body"], batch["n_chars"])]
        idx, x = [f[0].astype(np.int32).tobytes() for f in found], [f[1].tobytes() for f in found]
        yield pd.DataFrame({"idx": idx, "x": x, "label": batch["label"]})


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> Machine:
    """Fits on at most `sample_rows` labelled ids, those with the least hash; held-out rows and null labels give none.

    Of repeated labels of an id the least counts, of repeated rows the least text, so the fit doesn't depend on the run. The driver gets the features
    of these rows, at most 200 KB each.
    """
    rows = labels.where(F.col("quality").isNotNull() & quoted(id_col).isNotNull() & ~held_out(id_col)).select(quoted(id_col).alias("_label_id"), "quality")
    chosen = rows.groupBy("_label_id").agg(F.min("quality").cast("int").alias("label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample_rows)
    sample = _inputs(docs, id_col, text_col).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # sample_rows rows
    sample = sample.groupBy("_id", "label").agg(F.min(F.struct("body", "n_chars")).alias("least")).select("_id", "label", "least.*")
    got = sample.orderBy(F.xxhash64("_id"), "_id").mapInPandas(_rows_of, "idx binary, x binary, label int").collect()
    return fit([(np.frombuffer(r[0], np.int32), np.frombuffer(r[1])) for r in got], np.array([r[2] for r in got], float))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("body"), meta.alias("n_chars"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts are scored like others, from their statistics. Without labelled rows every score is 0.5. Repeated
    rows get equal scores. Labels, language, source and id are no inputs. A column of docs called like a new one comes back as <name>_input.
    """
    machine = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_col, text_col, sample_rows))  # fixed size

    @F.pandas_udf("double")
    def score(body: pd.Series, n_chars: pd.Series) -> pd.Series:
        m = machine.value
        return pd.Series([m.score(*features(b, c)) for b, c in zip(body, n_chars)], dtype="float64")

    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    out = packed(docs, held_out(id_col).alias("held"), score(F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")), meta).alias("s"))
    return out.select(*unpacked(docs.columns, {"held_out": F.col("held"), "score": F.col("s"), "predicted": (F.col("s") >= 0.5).cast("int")}))
