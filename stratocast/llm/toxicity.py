"""Toxicity: linear classifiers learned from confirmed positives and unlabelled text by non-negative PU risk."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import append_column, bounded, fold_of, sample_labels, sampled_texts, text_bytes, unused_name

BITS = 20
EDGE = b".,!?;:\"'()[]{}<>#*$%&|-_/"


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a bare lower-case word: itself and its first 3 to 6 letters."""
    letters = word.decode("utf-8", "replace")
    mask = (1 << BITS) - 1
    parts = {b"=" + word}
    parts |= {b"^%d" % n + letters[:n].encode("utf-8", "replace") for n in range(3, 7) if len(letters) >= n}
    return tuple(sorted({zlib.crc32(p) & mask for p in parts}))


def bare_words(text: bytes | None) -> set[bytes]:
    """The distinct words of a whole text, ASCII lower-cased, without punctuation at their edges."""
    return {w.strip(EDGE) for w in set(text.lower().split())} - {b""} if text else set()


@dataclass
class ToxicModel:
    """Weights of hashed word features; a text's log odds are the bias plus those of its distinct words.

    A word counts if its weights sum to over `floor` times the bias's size: many faint words are no evidence.
    """

    weights: np.ndarray
    bias: float
    floor: float = 0.5
    seen: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        live = np.flatnonzero(self.weights)
        return {"live": live, "values": self.weights[live], "bias": self.bias, "floor": self.floor}

    def __setstate__(self, state):
        self.weights = np.zeros(1 << BITS)
        self.weights[state["live"]] = state["values"]
        self.bias, self.floor, self.seen = state["bias"], state["floor"], {}

    def margin(self, text: bytes | None) -> float:
        total, seen = self.bias, self.seen
        if len(seen) > 200_000:
            seen.clear()
        for word in sorted(bare_words(text)):
            value = seen.get(word)
            if value is None:
                value = float(self.weights[list(word_features(word))].sum())
                value = seen[word] = value if value > self.floor * abs(self.bias) else 0.0
            total += value
        return total

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.array([self.margin(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Words:
    """A text for the fit: four least word hashes (of words over 5 letters), its words' features and how many each word has."""

    least: np.ndarray
    features: np.ndarray
    each: np.ndarray

    @classmethod
    def of(cls, text: bytes | None) -> Words:
        words = sorted(bare_words(text))
        hashed = [word_features(w) for w in words]
        least = [min((zlib.crc32(w, salt) for w in words if len(w) > 5), default=-1) for salt in (1, 2, 3, 4)]
        return cls(np.array(least, np.int64), np.array([f for h in hashed for f in h], np.int32), np.array([len(h) for h in hashed], np.uint8))

    def margin(self, model: ToxicModel) -> float:
        """The model's log odds of the text."""
        if not len(self.each):
            return model.bias
        sums = np.add.reduceat(model.weights[self.features], np.cumsum(self.each, dtype=np.int64) - self.each)
        return model.bias + sums[sums > model.floor * abs(model.bias)].sum()


def _unlike(texts: list[Words]) -> list[Words]:
    """The texts without near copies of earlier ones: those that share two of their four least word hashes."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        least = list(enumerate(text.least.tolist()))
        if sum(x in seen for x in least) < 2 or least[0][1] == -1:
            out.append(text)
        seen.update(least)
    return out


def pu_risk(z: np.ndarray, is_positive: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R+(positive), R-(unlabelled) - prior * R-(positive)) of margins z under the sigmoid loss."""
    p = 1 / (1 + np.exp(-z))  # loss of calling a row negative; 1 - p: of calling it positive
    return float(prior * (1 - p[is_positive]).mean()), float(p[~is_positive].mean() - prior * p[is_positive].mean())


def pu_slopes(z: np.ndarray, is_positive: np.ndarray, prior: float) -> np.ndarray:
    """What a step follows at each margin: the risk's derivative, or where its negative part fell below zero that part's, reversed."""
    p = 1 / (1 + np.exp(-z))
    n_pos, slope = is_positive.sum(), p * (1 - p)
    corrected = np.where(is_positive, -prior * slope / n_pos, slope / (len(z) - n_pos))
    if pu_risk(z, is_positive, prior)[1] < 0:
        return -corrected
    return corrected + np.where(is_positive, -prior * slope / n_pos, 0)


def fit_pu(positive: list[Words], unlabelled: list[Words], prior: float, least: int = 6, ratio: float = 2.0, rounds: int = 300, rate: float = 0.05, shrink: float = 5e-4) -> ToxicModel:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the sigmoid loss.

    Near copies count once. Features in under least positives, or whose share there (less two standard errors) is not
    ratio times that in unlabelled text, are left out, so no weight rests on chance words. Adam steps, each followed by
    soft thresholding at zero, leave positive weights only where the positives stand out: clean words never outvote a
    toxic one, however long the text. When the corrected negative part falls below zero its gradient is reversed, which
    keeps the estimator from over-fitting.
    """
    positive, unlabelled = _unlike(positive), _unlike(unlabelled)
    if not positive or not unlabelled:
        return ToxicModel(np.zeros(1 << BITS), -20.0)
    n_pos, n = len(positive), len(positive) + len(unlabelled)

    def occurrences(texts):
        total = np.zeros(1 << BITS, np.int64)
        for at in range(0, len(texts), 256):  # a few texts at a time: the driver never holds all features twice
            total += np.bincount(np.concatenate([t.features for t in texts[at : at + 256]]), minlength=1 << BITS)
        return total

    in_pos, in_rest = occurrences(positive), occurrences(unlabelled)
    sure_pos = (in_pos - 2 * np.sqrt(in_pos)) / n_pos
    kept = np.flatnonzero((in_pos >= least) & (sure_pos > ratio * in_rest / (n - n_pos)))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    held = [(own := place[t.features])[own >= 0] for texts in (positive, unlabelled) for t in texts]
    rows, columns = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)
    w, bias = np.zeros(len(kept)), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    is_pos = np.arange(n) < n_pos
    for t in range(1, rounds + 1):
        g = pu_slopes(np.clip(np.bincount(rows, weights=w[columns], minlength=n) + bias, -30, 30), is_pos, prior)
        gw, gb = np.bincount(columns, weights=g[rows], minlength=len(kept)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
        w = np.maximum(w - shrink, 0)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    return ToxicModel(weights, float(bias))


def choose_floor(model: ToxicModel, positive: list[Words], unlabelled: list[Words], prior: float, floors: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> ToxicModel:
    """The model with the floor of least non-negative zero-one risk on texts it was not fitted to; of equal ones the middle."""
    if not positive or not unlabelled:
        return model
    risks = []
    for floor in floors:
        tried = ToxicModel(model.weights, model.bias, floor)
        missed, flagged = (np.mean([t.margin(tried) >= 0 for t in texts]) for texts in (positive, unlabelled))
        missed = 1 - missed
        risks.append(prior * missed + max(0.0, flagged - prior * (1 - missed)))
    best = [f for f, r in zip(floors, risks, strict=True) if r <= min(risks) + 1e-12]
    return ToxicModel(model.weights, model.bias, best[len(best) // 2])


def _words(rows: DataFrame) -> list[tuple[int, Words]]:
    """(doc_id, words) of a bounded number of rows (doc_id, text), by id; features are taken on the executors."""

    def run(batches):
        for batch in bounded(batches, "text"):
            found = [Words.of(t) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([getattr(w, c).tobytes() for w in found], pa.binary()) for c in ("least", "features", "each")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "least", "features", "each"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, least binary, features binary, each binary")
    texts = [(r.doc_id, Words(np.frombuffer(r.least, np.int64), np.frombuffer(r.features, np.int32), np.frombuffer(r.each, np.uint8))) for r in found.toLocalIterator()]
    return sorted(texts, key=lambda x: (x[0], x[1].features.tobytes()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit_per_class: int = 6000, unlabelled_texts: int = 8000) -> ToxicModel:
    """The model for toxic = 1 from confirmed toxic rows and unlabelled documents, both outside the held-out fold.

    At most limit_per_class confirmed rows and about unlabelled_texts documents (twice that at most) are read, chosen by
    hashes, so reruns agree; the documents' labels are not looked at, so they hold toxic ones as the corpus does. The
    class prior is the share of toxic rows among the labelled ones outside the held-out fold. Of the training folds,
    remainder 1 is set aside to choose the floor; the weights come from the others. Nothing to learn from gives a model
    that finds nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id").cast("long")) != 0)
    prior = known.agg(F.avg((F.col("toxic") >= 1).cast("double"))).first()[0]
    sample = sample_labels(labels, "toxic", limit_per_class, classes=(1,))
    if not sample or not prior:
        return fit_pu([], [], 0.1)
    confirmed = _words(sampled_texts(docs, sample))
    some = text_bytes(docs).where((fold_of(F.col("doc_id")) != 0) & F.col("text").isNotNull())
    every = max(1, some.count() // unlabelled_texts)
    drawn = some.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(every)) == 0)
    unlabelled = _words(drawn.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", F.xxhash64("text")).limit(2 * unlabelled_texts))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    fit, aside = ([[t for i, t in rows if (fold(i) == 1) == own] for rows in (confirmed, unlabelled)] for own in (False, True))
    return choose_floor(fit_pu(*fit, float(prior)), *aside, float(prior))


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Whole texts are read. Null and empty texts score by the bias alone (not toxic). Null ids count as held out.
    Repeated rows are each scored alike. An empty table gives no rows. Other columns are not read.
    """

    def run(batches):
        for batch in bounded(batches, "text"):
            score = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = text_bytes(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under threshold, with all their columns, whatever their ids; equal rows go or stay together.

    Null and empty texts score by the bias alone and stay. An empty table gives an empty one.
    """
    name = unused_name(docs, "toxic_score")
    return append_column(docs, "text", name, "double", lambda: model.scores).where(F.col(name) < threshold).drop(name)
