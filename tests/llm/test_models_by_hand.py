"""The quality classifier's fit and scores, and toxicity scores, against plain Python from their definitions."""

from __future__ import annotations

import random
import re
from itertools import product
from math import exp, log

import numpy as np
import pytest
from test_llm_operators import swap_distance

from sieveline.llm import quality_gam as Q
from sieveline.llm import toxicity as X


def leaf(rows, ridge):
    return sum(g for g, _ in rows) / (sum(h for _, h in rows) + ridge)


def worth(rows, ridge):
    return sum(g for g, _ in rows) ** 2 / (sum(h for _, h in rows) + ridge)


def plain_tree(bins, rows, n, leaves, ridge, least):
    """Cut after cut, the one that gains most over all leaves (the first of equal ones); rows: (g, h) of each row."""
    parts = [(0, n)]
    inside = lambda a, b: [r for k, r in zip(bins, rows, strict=True) if a <= k < b]
    while len(parts) < leaves:
        found = []
        for k, (a, b) in enumerate(parts):
            for m in range(a + 1, b):
                left, right = inside(a, m), inside(m, b)
                if sum(h for _, h in left) >= least and sum(h for _, h in right) >= least:
                    found.append((worth(left, ridge) + worth(right, ridge) - worth(inside(a, b), ridge), k, m))
        best = max(found, key=lambda f: f[0], default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, m = best
        parts[k : k + 1] = [(parts[k][0], m), (m, parts[k][1])]
    return [leaf(inside(a, b), ridge) for a, b in parts for _ in range(a, b)]


def plain_quadrants(cells, rows, shape, ridge):
    best, out = 0.0, {c: 0.0 for c in product(range(shape[0]), range(shape[1]))}
    for i, j in product(range(1, shape[0]), range(1, shape[1])):
        sides = {}
        for c, r in zip(cells, rows, strict=True):
            sides.setdefault((c[0] < i, c[1] < j), []).append(r)
        gain = sum(worth(r, ridge) for r in sides.values()) - worth(rows, ridge)
        if gain > best + 1e-12:
            best, out = gain, {c: leaf(sides.get((c[0] < i, c[1] < j), []), ridge) for c in out}
    return best, out


def plain_fit(x, y, rounds, rate, bins, pairs, pair_rounds, ridge):
    """Scores (log-odds) of the rows after cyclic boosting, step by step over rows."""
    n, d = len(x), len(x[0])
    share = (sum(y) + 0.5) / (n + 1)
    z = [log(share / (1 - share))] * n

    def cut(j, bins):
        values = sorted(r[j] for r in x)
        edges = sorted({values[int(np.ceil(round(q * (n - 1), 9)))] for q in np.linspace(0, 1, bins + 1)[1:-1]})
        edges = [e for e in edges if e > values[0]]
        return [sum(e <= r[j] for e in edges) for r in x], len(edges) + 1

    fine, coarse = [cut(j, bins) for j in range(d)], [cut(j, 8) for j in range(d)]

    def gradients():
        p = [1 / (1 + exp(-v)) for v in z]
        return [(t - q, q * (1 - q)) for t, q in zip(y, p, strict=True)]

    for _ in range(rounds):
        for j in range(d):
            table = plain_tree(fine[j][0], gradients(), fine[j][1], 3, ridge, 1.0)
            z = [v + rate * table[k] for v, k in zip(z, fine[j][0], strict=True)]
    grid = lambda i, j: (list(zip(coarse[i][0], coarse[j][0], strict=True)), (coarse[i][1], coarse[j][1]))
    ranked = sorted(((plain_quadrants(grid(i, j)[0], gradients(), grid(i, j)[1], ridge)[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j) for gain, i, j in ranked if gain > 0]
    for _ in range(pair_rounds):
        for i, j in chosen:
            cells, shape = grid(i, j)
            table = plain_quadrants(cells, gradients(), shape, ridge)[1]
            z = [v + rate * table[c] for v, c in zip(z, cells, strict=True)]
    return z, chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_boosting_equals_plain_python(seed):
    rng = random.Random(seed)
    d = len(Q.FEATURES)
    x = [[rng.choice([0.0, 1.0, rng.random() * 5]) for _ in range(d)] for _ in range(90)]
    y = [float((r[0] > 1) ^ (r[1] > 1) or rng.random() < 0.1) for r in x]
    settings = {"rounds": 3, "rate": 0.3, "bins": 6, "pairs": 2, "pair_rounds": 3, "ridge": 2.0}
    model = Q.boost(np.array(x), np.array(y), **settings)
    z, chosen = plain_fit(x, y, **settings)
    assert list(model.pairs) == chosen
    assert np.abs(model.scores(np.array(x)) - 1 / (1 + np.exp(-np.array(z)))).max() < 1e-9


def plain_features(terms, text):
    """Evidence of a text: every word is compared with every term, and its window is counted word by word."""

    def hit(chunk):
        best = (0.0, -1, False)
        whole = re.sub(r"^[\W_]+|[\W_]+$", "", chunk)
        spelled = re.findall(r"[^\W_]+", chunk)
        forms = [(w, False) for w in spelled] + ([(whole, False)] if whole and (len(spelled) > 1 or "_" in whole) else [])
        forms += [(re.sub(r"([^\W\d_])\1{2,}", r"\1", w), True) for w, _ in forms if re.search(r"([^\W\d_])\1{2,}", w)]
        for w, changed in forms:
            for i, t in enumerate(terms):
                near = min(swap_distance(t.text, w[:k]) for k in range(len(w) + 1)) if t.stem else swap_distance(t.text, w)
                enough = {1: X.STEM_FUZZY_FROM} if t.stem else {1: X.FUZZY_FROM, 2: X.TWICE_FROM}
                fuzzy = len(t.text) >= enough.get(near, 99) and (t.stem or len(w) >= X.FUZZY_FROM - 1)
                weight = (t.fuzzy_weight if changed else t.weight) if near == 0 else t.fuzzy_weight if fuzzy else 0.0
                best = max(best, (weight, i, changed or near > 0))
        return best if best[0] > 0 else None

    words = text.lower().split()
    hits = {i: h for i, w in enumerate(words) if (h := hit(w))}
    evidence = []
    for i, (weight, term, _) in hits.items():
        earlier, later = sorted(k for k in hits if k < i)[-4:], sorted(k for k in hits if k > i)[:4]
        around = min(3, sum(abs(k - i) <= X.WINDOW for k in earlier + later))
        before = words[max(0, i - X.WINDOW) : i]
        opened = sum(c in X.QUOTES for w in before for c in w) + (words[i][0] in X.QUOTES)
        closed = any(c in X.QUOTES for w in words[i : i + 1 + X.WINDOW] for c in w)
        quoted = opened % 2 == 1 and closed or any(w.strip(",:;.") in X.REPORTING for w in before[-3:])
        evidence.append((weight, weight * (X.QUOTED_WEIGHT if quoted else 1) * (1 + X.NEIGHBOUR_BONUS * around), term))
    total = sum(e for _, e, _ in evidence)
    if not evidence:
        return [0.0] * 5 + [log(len(words) + 1)]
    return [log(1 + total), total / (len(words) + 20) ** 0.5, max(e for _, e, _ in evidence), log(1 + len({t for *_, t in evidence})), log(1 + sum(w for w, *_ in evidence)), log(len(words) + 1)]


def test_toxicity_scores_equal_plain_python():
    rng = random.Random(6)
    terms = (X.Term("stupid", 3.0, False, 2.0), X.Term("scum", 2.5), X.Term("worthless", 4.0, False, 3.25), X.Term("moronic", 3.5, True, 2.25), X.Term("trash", 1.5, True))
    model = X.Model(terms, (1.0, 0.5, 2.0, 0.5, 1.0, 3.0), (1.0, 0.4, 2.0, 0.5, 1.0, 1.0), (1.5, 0.5, 0.7, 0.2, -0.3, 0.1, -1.0))
    plain = ["the", "said", "you", '"and', 'end"', "«so»", "worth", "studio", "quote:", "e-mail", "...", "more"]
    bad = ["stupid", "st*pid!", "stpuid", "scum,", "scam", "w0rthl3ss", "moronically", "mornic", '"trashy"', "stuuupid", "(scum)"]
    texts = ["", "  ", "stupid"] + [" ".join(rng.choice(bad) if rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    matcher = X.Matcher(X.Automaton(terms))
    made = np.array([X.features(matcher, t) for t in texts])
    wanted = np.array([plain_features(terms, t) for t in texts])
    assert np.abs(made - wanted).max() < 1e-12
    z = ((wanted - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.coef[:-1]) + model.coef[-1]
    assert np.abs(model.scores(made) - 1 / (1 + np.exp(-z))).max() < 1e-12
    assert len({round(v, 6) for v in model.scores(made)}) > 50
