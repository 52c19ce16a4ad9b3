"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), in time linear in the features.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, tidied
from strandmix.llm.sampling import crc_mod, hashed_share

#: Hash buckets of words; buckets of each statistic; labelled rows of each class that a fit takes.
WORDS, BINS, PER_LABEL = 1 << 16, 16, 4000
STATISTICS = ("letters", "upper", "digits", "signs", "bars", "marks", "blanks", "wide", "distinct", "doubled", "top_word", "word_length", "words", "lines", "chars")
FEATURES = WORDS + len(STATISTICS) * BINS
CACHE = 60_000

_SETS = {"upper": range(65, 91), "digits": range(48, 58), "signs": map(ord, "#*$%&<>"), "bars": map(ord, "|"), "marks": map(ord, "!?.,;:"), "blanks": (9, 10, 13, 32), "wide": range(128, 256)}
_SETS = {k: np.isin(np.arange(256), list(v)).astype(np.int64) for k, v in _SETS.items()}
_SETS["letters"] = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]).astype(np.int64)
_MATRIX = np.stack([_SETS[k] for k in ("letters", "upper", "digits", "signs", "bars", "marks", "blanks", "wide")])

_seen: dict[str, int] = {}


class Rows(NamedTuple):
    """Sparse rows: features and values one row after another, and where rows begin; the last entry is the total."""

    index: np.ndarray
    value: np.ndarray
    starts: np.ndarray


def _bucket(word: str) -> int:
    at = zlib.crc32(word.encode()) % WORDS
    if len(_seen) >= CACHE:
        _seen.clear()
    _seen[word] = at
    return at


def featurise(texts: list[str | None], n_chars: list[int | None]) -> Rows:
    """Features of each text: words of unit length together, and one bucket of each statistic. Null texts count as empty."""
    index, value, starts = [], [], [0]
    for text, chars in zip(texts, n_chars):
        raw = (text or "").encode()
        words = (text or "").lower().split()
        n = len(words)
        got = _seen.get
        at = np.fromiter((got(w) if w in _seen else _bucket(w) for w in words), dtype=np.int64, count=n)
        unique, counts = np.unique(at, return_counts=True)
        shares = _MATRIX @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / max(1, len(raw))
        log = lambda x: np.log2(1 + max(0, x)) / BINS
        stats = [*shares, len(unique) / max(1, n), (at[1:] == at[:-1]).mean() if n > 1 else 0.0, counts.max() / n if n else 0.0, min(1.0, len(raw) / max(1, n) / 32), log(n), log(raw.count(b"\n")), log(chars if chars is not None else -1)]
        # Shares near 0 get narrow buckets.
        bins = np.minimum(np.sqrt(np.clip(stats, 0, 1)) * BINS, BINS - 1).astype(np.int64)
        index += [unique, WORDS + np.arange(len(STATISTICS)) * BINS + bins]
        weight = np.sqrt(counts)
        value += [weight / max(1e-9, float(np.sqrt((weight * weight).sum()))), np.ones(len(STATISTICS))]
        starts.append(starts[-1] + len(unique) + len(STATISTICS))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
    return Rows(join(index, np.int32), join(value, np.float32), np.array(starts, dtype=np.int64))


@dataclass
class FactorisationMachine:
    """Bias, weights and factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: Rows) -> np.ndarray:
        """Scores before the sigmoid."""
        if len(rows.starts) < 2:
            return np.zeros(0)
        x, starts = rows.value, rows.starts[:-1]
        vx = self.factors[rows.index] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[rows.index] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, rows: Rows) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(rows: Rows, labels: np.ndarray, rank: int = 4, epochs: int = 6, batch: int = 32, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Minimise the logistic loss by AdaGrad over mini-batches in a seeded order."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    model = FactorisationMachine(float(np.log(mean / (1 - mean))), np.zeros(FEATURES, dtype=np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32))
    gw, gv, gb = np.full(FEATURES, 1e-2, dtype=np.float32), np.full((FEATURES, rank), 1e-2, dtype=np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            sizes = rows.starts[chosen + 1] - rows.starts[chosen]
            ends = np.cumsum(sizes)
            at = np.repeat(rows.starts[chosen] - (ends - sizes), sizes) + np.arange(ends[-1])
            part = Rows(rows.index[at], rows.value[at], np.concatenate([[0], ends]))
            error = model.score(part) - labels[chosen]
            row, x = np.repeat(np.arange(len(chosen)), sizes), part.value[:, None]
            vx = model.factors[part.index] * x
            sums = np.add.reduceat(vx, part.starts[:-1], axis=0)
            each = error[row][:, None] / len(chosen)
            unique, inverse = np.unique(part.index, return_inverse=True)
            dw = np.bincount(inverse, weights=(each * x)[:, 0], minlength=len(unique))
            grad = each * x * (sums[row] - vx)
            dv = np.stack([np.bincount(inverse, weights=grad[:, f], minlength=len(unique)) for f in range(rank)], axis=1)
            dw += decay * model.weights[unique]
            dv += decay * model.factors[unique]
            gw[unique] += dw * dw
            gv[unique] += dv * dv
            model.weights[unique] -= rate * dw / np.sqrt(gw[unique])
            model.factors[unique] -= rate * dv / np.sqrt(gv[unique])
            db = float(error.mean())
            gb += db * db
            model.bias -= rate * db / gb**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars", per_label: int = PER_LABEL) -> FactorisationMachine:
    """Fit on about ``per_label`` labelled documents of each class, chosen by a hash among those with crc32(id) mod 5 other than 0.

    The sample's features, not its texts, come to the driver: at most some tens of MB whatever the input. Class shares of the whole
    labelled table are restored by shifting the bias. Null ids or labels teach nothing; of several labels of a document the larger counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_mod("id", 5) != 0))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen, counts = hashed_share(known, "id", "label", per_label)
    texts = _kept(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), "id")

    def run(batches):
        for part in chunks(batches):
            rows = featurise(part.column(1).to_pylist(), part.column(2).to_pylist())
            index, value = np.split(rows.index, rows.starts[1:-1]), np.split(rows.value, rows.starts[1:-1])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([x.astype("<i4").tobytes() for x in index]), pa.array([x.astype("<f4").tobytes() for x in value])], names=["id", "label", "features", "weights"])

    got = texts.select("id", "text", "chars", "label").mapInArrow(tidied(run), "id long, label int, features binary, weights binary").collect()
    got = sorted(got, key=lambda r: (r.id, r.features))
    index, value = [np.frombuffer(r.features, dtype="<i4") for r in got], [np.frombuffer(r.weights, dtype="<f4") for r in got]
    if not got:
        return fit(featurise([], []), np.zeros(0))
    target = np.array([float(r.label) for r in got])
    model = fit(Rows(np.concatenate(index), np.concatenate(value), np.concatenate([[0], np.cumsum([len(x) for x in index])])), target)
    odds = lambda a, b: float(np.log(max(a, 1) / max(b, 1)))
    model.bias += odds(counts.get(1, 0), counts.get(0, 0)) - odds(target.sum(), (1 - target).sum())
    return model


def _kept(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), chars.alias("chars"))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """One row per document: held_out, score and predicted (1 from ``threshold`` on).

    Null texts are scored as empty ones; held_out is null for a null id. The whole text counts. Nothing is shuffled; the model,
    of a fixed size of about 1.5 MB, goes to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in chunks(batches):
            found = sent.value.score(featurise(part.column(1).to_pylist(), part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(float))], names=["id", "score"])

    scored = _kept(docs, id_col, text_col, chars_col).mapInArrow(tidied(run), "id long, score double")
    return scored.select(F.col("id").alias(id_col), (crc_mod("id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """The documents with a score from ``threshold`` on, with all their columns."""
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in chunks(batches, at):
            n_chars = part.column(chars).to_pylist() if chars is not None else [None] * part.num_rows
            yield part.filter(pa.array(sent.value.score(featurise(part.column(at).to_pylist(), n_chars)) >= threshold))

    return bounded(docs).mapInArrow(tidied(run), docs.schema)
