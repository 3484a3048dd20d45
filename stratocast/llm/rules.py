"""Quality rules: exact document statistics, then gradient-boosted trees held to monotonic directions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import append_column, bounded, sample_labels, sampled_texts, text_bytes, unused_name

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?;:\"()[]{}/\\_=+~^@"
#: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then what only the trees read.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_twins", "n_distinct", "n_stops")
#: Shares by which the trees judge, and the way each may move the verdict: -1 only towards rejection, 0 free.
FEATURES = {
    "symbol_share": -1, "upper_share": -1, "digit_share": -1, "mark_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "twin_share": -1, "distinct_share": 0, "word_length": 0, "words_per_line": 0, "log_words": 0, "stop_share": 0,
}


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one whole text. Words are runs of other than ASCII white space; null has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    solid = text.translate(None, SPACES)
    word_chars = len(solid.decode("utf-8", "replace"))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip(SPACES)]
    n, repeated = len(words), 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) < len(windows):
            until = 0  # words before this position are counted
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    size = len(text)
    return (
        n, word_chars, size - len(text.translate(None, SYMBOLS)), len(full) - len(set(full)), repeated, len(full), size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, DIGITS)), size - len(text.translate(None, MARKS)), sum(map(bytes.__eq__, words, words[1:])), len(set(words)),
        sum(x in b".," for x in (w[-1:] for w in words)),
    )


def features_of(counts: np.ndarray) -> np.ndarray:
    """rows x FEATURES from rows x COUNTS."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_twins"] / words, c["n_distinct"] / words, c["word_chars"] / words, c["n_words"] / lines, np.log1p(c["n_words"]), c["n_stops"] / words,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """All trees of a model in flat node arrays; a leaf has feature -1. Node numbers run over all trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: every row walks all trees at once, a level a step."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            f = np.where(inner, self.feature[at], 0)
            step = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, step, at)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, directions: list[int], trees=60, depth=3, rate=0.2, bins=48, ridge=2.0, least_rows=8) -> Trees:
    """Gradient boosting on the logistic loss with histogram splits.

    A split on a feature with direction d is allowed only if the right value exceeds the left in that direction, and
    its children's values are held on their side of the midpoint, so the whole model is monotone in the feature.
    """
    y = y.astype(np.float64)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    if not len(x):
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.array([0]), 0.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), base)

    def weight(g, h, lo, hi):
        return np.clip(-g / (h + ridge), lo, hi)

    def grow(rows, g, h, lo, hi, left_depth) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, 0, rate * float(weight(gs, hs, lo, hi))])
        best = (1e-6, None)
        for f in range(x.shape[1]) if left_depth and len(rows) >= 2 * least_rows else ():
            n = len(edges[f]) + 1
            if n < 2:
                continue
            b = binned[rows, f]
            gl, hl, cl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            wl, wr = weight(gl, hl, lo, hi), weight(gs - gl, hs - hl, lo, hi)
            gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + ridge) * wr**2)
            gain -= -(gs * weight(gs, hs, lo, hi) + 0.5 * (hs + ridge) * weight(gs, hs, lo, hi) ** 2)
            ok = (cl >= least_rows) & (len(rows) - cl >= least_rows) & (directions[f] * (wr - wl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1]:
            f, k, wl, wr = best[1]
            goes_left, middle = binned[rows, f] <= k, (wl + wr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[directions[f]]
            a = grow(rows[goes_left], g, h, *bounds[0], left_depth - 1)
            b = grow(rows[~goes_left], g, h, *bounds[1], left_depth - 1)
            nodes[me][:4] = [f, float(edges[f][k]), a, b]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        start = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), -4.0, 4.0, depth))
        own = np.array(nodes[start:])
        one = Trees(own[:, 0].astype(int), own[:, 1], own[:, 2].astype(int) - start, own[:, 3].astype(int) - start, own[:, 4], np.array([0]), 0.0)
        margin += one.margin(x)
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), base)


def fit_rules(docs: DataFrame, labels: DataFrame, limit_per_class: int = 5000) -> Trees:
    """Trees for quality = 1, from at most limit_per_class labelled documents of each class outside the held-out fold."""
    sample = sample_labels(labels, "quality", limit_per_class)
    if not sample:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))

    def run(batches):
        for batch in bounded(batches, "text"):
            counts = [pa.array(c, pa.int64()) for c in zip(*map(counts_of, batch.column(1).to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *counts], names=["doc_id", "y", *COUNTS])

    rows = sampled_texts(docs, sample).mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{c} long" for c in COUNTS)).toPandas()
    rows = rows.sort_values(["doc_id", *COUNTS])
    return boost(features_of(rows[list(COUNTS)].to_numpy()), rows["y"].to_numpy(), list(FEATURES.values()))


def _verdicts(model: Trees, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    score = model.probability(features_of(counts))
    return failed, score, ~failed & (score >= threshold)


def apply_rules(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every row.

    n_repeat_words counts positions covered by a 3-word window that the text holds twice or more. base_failed: fewer
    than 50 words, or over half of them repeated. kept: not base_failed, and the trees give at least threshold.
    Null, empty and blank texts have no words and fail. Null ids stay null; repeated rows are each judged alike. An
    empty table gives no rows. Other columns are not read.
    """

    def run(batches):
        for batch in bounded(batches, "text"):
            counts = np.array([counts_of(t) for t in batch.column(1).to_pylist()], dtype=np.int64)
            failed, score, kept = _verdicts(model, counts, threshold)
            arrays = [batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS[:5], "base_failed", "kept", "score"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their ids; equal rows go or stay together.

    Null, empty and blank texts fail. An empty table gives an empty one.
    """
    name = unused_name(docs, "rules_kept")

    def make():
        def judge(texts):
            return _verdicts(model, np.array([counts_of(t) for t in texts], dtype=np.int64), threshold)[2]

        return judge

    return append_column(docs, "text", name, "boolean", make).where(F.col(name)).drop(name)
