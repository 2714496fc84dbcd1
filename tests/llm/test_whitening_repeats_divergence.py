"""Whitening, substring dedup and the source divergence audit against brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveline.llm import divergence, substring_dedup, whitening

# 11 Embedding whitening

VECTORS = "vec_id long, embedding array<double>, label string, n long"


def brute_whitening(vectors, components):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[(n * e - s) / n for e, s in zip(r, sums, strict=True)] for r in fit], float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    rows = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x], float)
    return n, deviation, rows @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize(("dimensions", "rows", "components", "spread"), [(5, 40, 16, 0.3), (40, 300, 16, 0.0), (24, 200, 4, 1.5)])
def test_whitening_equals_an_eigendecomposition(spark, dimensions, rows, components, spread):
    rng = np.random.default_rng(dimensions)
    made = rng.standard_normal((rows, dimensions)) * np.exp(-spread * np.arange(dimensions)) * 50
    made = np.vstack([made, made[:7], made[:7]])  # repeated vectors count once in the fit list
    odd = [(901, None, "x", 1), (902, [float("nan")] * dimensions, "x", 1), (903, [None] + [0.0] * (dimensions - 1), "x", 1), (904, [float("inf")] * dimensions, "x", 1), (905, [1.0], "x", 1), (906, [], "x", 1)]
    table = spark.createDataFrame([(i, [float(c) for c in v], "x", 1) for i, v in enumerate(made)] + odd, VECTORS).repartition(3)
    usable = whitening.usable(table)
    got = whitening.transform(usable, whitening.fit(usable, components)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = brute_whitening(made.tolist(), components)
    m = white.shape[1]
    assert len(got) == len(made) * m
    assert set(got["n"]) == {n} == {rows}
    assert got["deviation"].tolist() == [d for d in deviation for _ in range(m)]
    ours = got["whitened"].to_numpy().reshape(-1, m)
    signs = np.sign((ours * white).sum(axis=0))
    assert np.abs(ours * signs - white).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:m], explained, rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_dependent_equal_and_no_vectors(spark):
    rng = np.random.default_rng(1)
    low = rng.integers(-9, 9, (60, 3)) @ rng.integers(-3, 3, (3, 20)) / 64  # three directions in twenty dimensions
    usable = whitening.usable(spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(low.tolist())], VECTORS))
    model = whitening.fit(usable, 16)
    assert model.components.shape == (20, 3)
    assert model.identity_error < 1e-8
    assert abs(model.eigenvalues.sum() / model.trace - 1) < 1e-12
    same = whitening.usable(spark.createDataFrame([(i, [0.5, 1e9], "", 0) for i in range(5)] + [(None, [0.5, 1e9], "", 0)], VECTORS))
    model = whitening.fit(same, 16)
    assert (model.n, model.components.shape, whitening.transform(same, model).count()) == (1, (2, 0), 0)
    none = whitening.usable(spark.createDataFrame([], VECTORS))
    assert whitening.transform(none, whitening.fit(none)).count() == 0


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(1, [2.0**40, 0.25]), (2, [-(2.0**22), 0.5]), (3, [0.0, 0.75]), (None, [0.0, 0.75])]
    with pytest.raises(Exception, match="(?i)overflow|too large|int"):
        usable = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        whitening.transform(usable, whitening.fit(usable)).collect()
    rows[0] = (1, [2.0**22 + 1 / 64, 2.0**21])
    usable = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = whitening.transform(usable, whitening.fit(usable)).collect()
    _, deviation, _, _ = brute_whitening([r[1] for r in rows], 2)
    assert sorted(r["deviation"] for r in got) == sorted(d for d in deviation for _ in range(2))


# 12 Substring dedup


def brute_repeats(rows, window):
    first, out = {}, []
    cut = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x or "")
    for d, x in rows:
        w = cut(x)
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    for d, x in rows:
        w = cut(x)
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(a for i, a in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def repeated_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 130, 300)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += text(rng.randrange(40))
            if rng.random() < 0.7:
                passage = list(rng.choice(passages))
                if rng.random() < 0.3:
                    passage[rng.randrange(len(passage))] = "other"
                parts += passage
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    hot = " ".join(passages[3])
    rows += [(200 + i, f"{hot} tail {i}") for i in range(60)]  # one passage in many documents
    rows += [(300 + i, rows[40][1]) for i in range(5)] + [(310, None), (311, ""), (312, " \n"), (None, hot), (None, rows[40][1])]
    rows += [(320, "spam " * 700), (321, "spam " * 400), (322, "a b " * 300), (5, hot), (5, rows[5][1]), (320, "spam " * 700)]
    rows += [(330, " ".join(text(60_000))), (331, "é ß " + hot + "  x")]
    return rows


@pytest.mark.parametrize(("window", "group"), [(50, 4096), (50, 30), (7, 200), (3, 4096)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, window, group):
    """With a small bound of a group, most prefixes are lengthened to whole windows."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = repeated_rows()
    docs = spark.createDataFrame([(d, x, 0, "s") for d, x in rows], "doc_id long, text string, start int, key string").repartition(5)
    got = [tuple(r) for r in substring_dedup.without_repeats(docs, window).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, window)


def test_substring_dedup_joins_texts_by_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_DOCS", 0)
    rows = repeated_rows()[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.without_repeats(docs).collect()), key=str) == brute_repeats(rows, 50)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_names_of_sequences():
    words = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1])
    names = substring_dedup.named(words, 3)
    same = lambda i, j: (words[i : i + 3] == words[j : j + 3]).all()
    assert all((names[i] == names[j]) == same(i, j) for i in range(8) for j in range(8))


# 13 Source divergence audit


def brute_audit(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for x, lang, source in rows:
        x, lang, source = x or "", lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = [s for x, s in groups if x == lang]

        def shares(of, kept=kept, lang=lang):
            n = {t: sum(counts[lang, s][t] for s in of) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares([source]), shares(sources)
        pairs = [(s, sum(gap(p[t], x[t]) for t in kept)) for s in sources if s != source for x in [shares([s])]]
        terms = [(t, gap(p[t], q[t])) for t in kept if counts[lang, source][t] > 0 and p[t] > q[t]]
        for part, found, bound in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:bound], 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    vocabulary = [rng.choice(["a", "Be", "straße", "été", "日本語", "internationalisation", "donaudampfschifffahrtsgesellschaft", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq"]) + rng.choice(["", "", "x", "yy"]) for _ in range(60)]
    rows = []
    for _ in range(400):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", "s3", "S4", "é", None])
        rows.append(("".join(rng.choice(vocabulary) + rng.choice([" ", "-", "1", "\n", "_", "[", " "]) for _ in range(rng.randrange(30))), lang, source))
    rows += [(None, "en", "hot"), ("", "fr", "one"), ("123 !", "fr", "two"), ("rare words only", "es", "s1"), ("rare", "es", "s2"), ("x " * 20_000 + "internationalisation", "de", "s1"), ("a" * 100_000, "en", "s2")]
    return rows


@pytest.mark.parametrize(("chunk", "held", "tile"), [(4 << 20, 1_000_000, (4096, 64)), (200, 60, (7, 2))])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, held, tile):
    """With small bounds, counts are sent in many parts, and terms and sources are cut into many tiles."""
    for name, value in (("CHUNK_BYTES", chunk), ("HELD_ROWS", held), ("TILE_TERMS", tile[0]), ("TILE_SOURCES", tile[1])):
        monkeypatch.setattr(divergence, name, value)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=10, top=3).collect()) == brute_audit(rows, 10, 3)


def test_audit_without_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(40), rng.integers(0, 2**63, 1000).astype(np.uint64) % np.uint64(70_000)
    assert divergence.radix_order(high, low).tolist() == sorted(range(1000), key=lambda i: (high[i], low[i], i))


def test_shares_in_tasks_equal_those_of_the_plan(spark):
    rng = random.Random(1)
    made = [(n := rng.randrange(10**rng.randrange(1, 14)), n + rng.randrange(10**rng.randrange(1, 14)), rng.randrange(1, 10**6)) for _ in range(300)]
    table = spark.createDataFrame(made, "n long, total long, terms long")
    got = [r[0] for r in table.select(divergence.share(table.n, table.total, table.terms)).collect()]
    exact = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in made]
    n, t, v = (np.array(c, np.int64) for c in zip(*made, strict=True))
    assert got == exact == divergence._shares(n, t + 2 * v).tolist()
