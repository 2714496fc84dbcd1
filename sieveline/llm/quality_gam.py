"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in turn; they add up to one lookup table per feature and one per chosen
pair of features. A score is a sum of table entries, found by bin numbers for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample
from .shingles import windows, word_hashes

FEATURES = (
    "log_chars", "log_words", "mean_word", "symbols", "upper", "digits", "stops", "shouts", "bars", "repeated_lines",
    "distinct_words", "repeated_words", "top_word", "mean_line", "non_ascii", "longest_word", "spread",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper case, 2 digit, 3 stop or comma, 4 ! or ?, 5 bar or tab, 6 symbol, 7 byte of a non-ASCII letter, 8 space."""
    out = np.zeros(256, np.uint8)
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    for chars, k in ((b".,;:", 3), (b"!?", 4), (b"|", 5), (b"#*$%&<>@^~=_+{}[]\\/", 6), (b" \t\n\r\x0b\x0c", 8)):
        out[list(chars)] = k
    out[128:] = 7
    return out


_CLASS = _classes()


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all zero for a text without words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
    hashes = word_hashes(text)
    distinct, counts = np.unique(hashes, return_counts=True)
    grams = windows(hashes, 5)
    repeated = 1 - len(np.unique(grams)) / len(grams)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    solid = size - kinds[8]
    return [
        log(size), log(n), solid / n, kinds[6] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, 1 - len(set(lines)) / len(lines),
        len(distinct) / n ** 0.85, repeated, counts.max() / n, log(n / len(lines)), kinds[7] / solid, log(lengths.max()), float(lengths.std()),
    ]


@dataclass(frozen=True)
class Additive:
    """Bin edges of each feature, its table of scores, and tables of pairs over coarse bins."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles; none for a constant."""
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
    return cuts[cuts > x.min()] if len(x) else cuts


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Scores per bin of a tree with few leaves over ordered bins with gradient sums g and curvature sums h."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
            gain = _gain(lg, lh, ridge) + _gain(rg, rh, ridge) - _gain(cg[-1], ch[-1], ridge)
            gain[(lh < least) | (rh < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (k, a, a + i + 1, b))
        if best[1] is None:
            break
        k, a, m, b = best[1]
        parts[k : k + 1] = [(a, m), (m, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: its gain and the score of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            sums = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            q = [a * a / (b + ridge) for a, b in zip(*sums, strict=True)]
            gain = sum(q) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
            if gain > best:
                best = gain
                leaf = [a / (b + ridge) for a, b in zip(*sums, strict=True)]
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return best, out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.15, bins: int = 48, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> Additive:
    """Fit the additive model to rows x and labels y (0 or 1)."""
    rate_y = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    b0, d = log(rate_y / (1 - rate_y)), len(FEATURES)
    if not len(y) or y.min() == y.max():
        none = tuple(np.empty(0) for _ in range(d))
        return Additive(b0, none, tuple(np.zeros(1) for _ in range(d)), none, (), ())
    edges = tuple(_edges(x[:, j], bins) for j in range(d))
    coarse = tuple(_edges(x[:, j], 8) for j in range(d))
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), b0)
    least = 1.0
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(at[j], y - p, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j]))
            step = rate * _tree(g, h, 3, ridge, least)
            tables[j] += step
            z += step[at[j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = wide[i] * shape[1] + wide[j]
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    ranked = sorted(((_quadrants(*grid(i, j)[:2], ridge)[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:pairs]
    chosen = tuple((i, j) for gain, i, j in ranked if gain > 0)
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(chosen):
            g, h, cell = grid(i, j)
            step = rate * _quadrants(g, h, ridge)[1]
            pair_tables[k] += step
            z += step.ravel()[cell]
    return Additive(b0, edges, tuple(tables), coarse, chosen, tuple(pair_tables))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 24_000) -> Additive:
    """Learn from at most max_labelled labelled rows outside the held-out quarter; features are made in Spark tasks."""
    sample = labelled_sample(docs, labels, "quality", max_labelled)

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"f": [features(t) for t in b["text"]], "label": b["label"]})

    rows = sample.mapInPandas(measure, "f array<double>, label int").collect()  # at most max_labelled short rows
    x = np.array([r["f"] for r in rows], float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the fit does not depend on the order in which rows arrive
    return boost(x[order], np.array([min(1, max(0, r["label"])) for r in rows], float)[order])


def score(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text (null: empty).

    Only the text is read. A text without words has all features zero and the score of those bins. Repeated rows are
    scored alike, each in its own row; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.scores(x)})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
