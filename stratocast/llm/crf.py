"""Quality classifier: a linear-chain conditional random field over lines, aggregated to documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import bounded, fold_of, sample_labels, sampled_texts, text_bytes
from stratocast.llm.rules import DIGITS, MARKS, SPACES, SYMBOLS, UPPER

OWN = 12  # features of a line by itself
WIDTH = 3 * OWN + 3


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, lengths in bytes) of the lines that hold a word; one empty line if none does.

    Each line carries its own features, those of the lines before and after, and marks for the ends of the text.
    """
    rows, sizes, earlier = [], [], set()
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        solid = line.translate(None, SPACES)
        letters = max(len(solid), 1)
        rows.append(
            (
                np.log1p(size), np.log1p(n), (size - len(line.translate(None, SYMBOLS))) / letters, (size - len(line.translate(None, UPPER))) / letters,
                (size - len(line.translate(None, DIGITS))) / letters, (size - len(line.translate(None, MARKS))) / letters, sum(map(bytes.__eq__, words, words[1:])) / n,
                len(set(words)) / n, letters / n / 10, float(solid in earlier), float(n < 4), float(solid[-1:] in b".:;!?"),
            )
        )
        sizes.append(size)
        earlier.add(solid)
    if not rows:
        rows, sizes = [(0.0,) * OWN], [1]
    own = np.array(rows)
    pad = np.zeros((1, OWN))
    n = len(own)
    ends = np.zeros((n, 3))
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = n == 1
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), ends]), np.array(sizes, dtype=np.float64)


class Chains:
    """Line sequences of many texts laid out position by position, longest text first, so a step takes all texts at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.starts = np.cumsum(self.active) - self.active
        text = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.starts[position] + rank[text]  # of each line, text by text
        self.text, self.rank = text, rank

    def marginals(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(line good) text by text, expected moves (2 x 2 for each text, by rank) and log partition by rank."""
        u = np.empty_like(unary)
        u[self.place] = unary
        n = len(self.lengths)
        forward = np.zeros((len(u), 2))
        log_z = np.zeros(n)
        for t, (k, s) in enumerate(zip(self.active, self.starts, strict=True)):
            if t == 0:
                a = np.zeros((k, 2))
            else:
                before = forward[self.starts[t - 1] : self.starts[t - 1] + k]
                a = np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
            a = a.copy()
            a[:, 1] += u[s : s + k]
            forward[s : s + k] = a
            log_z[:k] = np.logaddexp(a[:, 0], a[:, 1])
        backward = np.zeros((len(u), 2))
        moves = np.zeros((n, 2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            k, s, p = self.active[t], self.starts[t], self.starts[t - 1]
            nxt = backward[s : s + k].copy()
            nxt[:, 1] += u[s : s + k]
            for i in (0, 1):
                backward[p : p + k, i] = np.logaddexp(move[i, 0] + nxt[:, 0], move[i, 1] + nxt[:, 1])
                moves[:k, i] += np.exp(forward[p : p + k, i, None] + move[i] + nxt - log_z[:k, None])
        good = np.exp(np.clip(forward[:, 1] + backward[:, 1], None, None)[self.place] - log_z[self.rank[self.text]])
        return good, moves, log_z


@dataclass
class LineModel:
    """Weights of standardised line features, the moves between bad (0) and good (1), and the map to a document's odds."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def good_share(self, features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of being good, for each text."""
        chains = Chains(lengths)
        good, _, _ = chains.marginals((features - self.mean) / self.spread @ self.weights + self.bias, self.move)
        total = np.bincount(chains.text, weights=sizes, minlength=len(lengths))
        return np.bincount(chains.text, weights=sizes * good, minlength=len(lengths)) / total

    def probability(self, share: np.ndarray) -> np.ndarray:
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -60, 60)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        parts = [line_features(t) for t in texts]
        if not parts:
            return np.zeros(0)
        lengths = np.array([len(f) for f, _ in parts])
        return self.probability(self.good_share(np.vstack([f for f, _ in parts]), lengths, np.concatenate([s for _, s in parts])))


def fit_lines(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood with each line of a text labelled as the text is; every text weighs alike.

    Adam on exact forward-backward gradients. Then a logistic map from the weighted share of good lines to the odds of
    label 1 is fitted on the same texts.
    """
    if not len(y) or not (0 < y.mean() < 1):
        flat = float(y.mean()) if len(y) else 0.5
        return LineModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)), 0.0, np.log((flat + 1e-3) / (1 - flat + 1e-3)))
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - mean) / spread
    chains = Chains(lengths)
    weight = 1.0 / lengths[chains.text] / len(lengths)
    target = y[chains.text].astype(np.float64)
    by_rank = np.empty(len(y), dtype=np.int64)
    by_rank[chains.rank] = np.arange(len(y))
    per_text = 1.0 / lengths[by_rank] / len(lengths)
    stays = np.zeros((len(y), 2, 2))
    stays[np.arange(len(y)), y[by_rank], y[by_rank]] = lengths[by_rank] - 1
    theta = np.zeros(WIDTH + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        move = theta[-4:].reshape(2, 2)
        good, moves, _ = chains.marginals(x @ theta[:WIDTH] + theta[WIDTH], move)
        miss = weight * (good - target)
        g = np.r_[x.T @ miss, miss.sum(), ((moves - stays) * per_text[:, None, None]).sum(axis=0).ravel()]
        g += ridge * np.r_[theta[:WIDTH], 0, theta[-4:]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = LineModel(mean, spread, theta[:WIDTH], float(theta[WIDTH]), theta[-4:].reshape(2, 2))
    share = model.good_share(features, lengths, sizes)
    odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the two numbers, with a weak pull to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -60, 60)))
        g = np.array([((p - y) * odds).sum() + (a - 1), (p - y).sum() + b])
        h = p * (1 - p)
        hess = np.array([[(h * odds**2).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
    model.slope, model.offset = float(max(a, 0.0)), float(b)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, limit_per_class: int = 1500) -> LineModel:
    """The model for quality = 1 from at most limit_per_class labelled documents of each class outside the held-out fold."""
    sample = sample_labels(labels, "quality", limit_per_class)
    parts, y = [], []
    if sample:
        for r in sorted((r.doc_id, r.y, bytes(r.text or b"")) for r in sampled_texts(docs, sample).toLocalIterator()):
            parts.append(line_features(r[2]))
            y.append(r[1])
    if not parts:
        return fit_lines(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0), np.zeros(0, int))
    return fit_lines(np.vstack([f for f, _ in parts]), np.array([len(f) for f, _ in parts]), np.concatenate([s for _, s in parts]), np.array(y))


def score_quality(docs: DataFrame, model: LineModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Whole texts are read, line by line. Null, empty and blank texts count as one empty line. Null ids count as held
    out. Repeated rows are each scored alike. An empty table gives no rows. Other columns are not read.
    """

    def run(batches):
        for batch in bounded(batches, "text"):
            score = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = text_bytes(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
