"""Toxicity: a lexicon learned from labels, matched by a Levenshtein automaton run over its trie, scored in context.

Terms are whole words and stems (found at the start of a word), also found one edit away if long enough, and long words two
edits away; a swap of neighbours is one edit. Words are met as they stand between signs, and between white space with the
signs inside, so that a sign in a letter's place is an edit like others; letters drawn out count once. Each hit
counts by its term's log-odds and by the window of words around it: hits close together weigh more, hits inside
quotation marks or after a reporting word weigh less. A logistic model over the summed evidence gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, held_out, labelled_sample, released

#: Words that report somebody's speech (fixed values).
REPORTING = frozenset("said says say quote quoted quotes called wrote dit disait cité citation sagte sagt schrieb zitat dijo dice cita escribió".split())
QUOTES = frozenset("\"“”„«»‹›‟")
#: Window of words on each side of a hit; weight of a quoted hit; bonus for each other hit in the window, up to three.
WINDOW, QUOTED_WEIGHT, NEIGHBOUR_BONUS = 8, 0.35, 0.25
FUZZY_FROM, STEM_FROM, STEM_TO = 5, 4, 8
#: Least letters of a stem for one edit and of a word for two.
STEM_FUZZY_FROM, TWICE_FROM = 6, 9
_TOKEN = re.compile(r"[^\W_]+")
_OUTER, _DRAWN_OUT = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"([^\W\d_])\1{2,}")
_SIGNS = ".,;:!?\"'()[]«»“”„…-–—"


def spellings_of(chunk: str) -> list[tuple[str, bool]]:
    """What a chunk between white space may spell, and whether something was changed to read it so."""
    plain = chunk.strip(_SIGNS)
    if plain.isalnum():  # most chunks: one word with signs around it
        out = [(plain, False)]
    else:
        out = [(token, False) for token in _TOKEN.findall(chunk)]
        whole = _OUTER.sub("", chunk)
        if whole and (len(out) > 1 or "_" in whole):
            out.append((whole, False))  # its signs are edits of the automaton
    if _DRAWN_OUT.search(chunk):
        out += [(short, True) for word, _ in tuple(out) if (short := _DRAWN_OUT.sub(r"\1", word)) != word]
    return out


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool = False
    fuzzy_weight: float = 0.0


class Automaton:
    """Deterministic automaton of all words that are, or start with, a term or a variant of it.

    Variants are one edit away (a letter more, less or another, or two neighbours swapped), of words of TWICE_FROM letters
    or more also two edits. A state is a set of (trie node, edits, letter): the letter is one that must come next, as the
    one after it came first. States and moves are made when first met. Words leave the trie after a few letters, so a scan
    seldom reads a whole word.
    """

    MAX_STATES, MAX_MOVES = 50_000, 400_000

    def __init__(self, terms: tuple[Term, ...]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.edits_below = [1]
        for i, t in enumerate(terms):
            node, edits = 0, 2 if not t.stem and len(t.text) >= TWICE_FROM else 1
            self.edits_below[0] = max(self.edits_below[0], edits)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word_at.append(-1)
                    self.stem_at.append(-1)
                    self.edits_below.append(1)
                node = self.children[node][c]
                self.edits_below[node] = max(self.edits_below[node], edits)
            (self.stem_at if t.stem else self.word_at)[node] = i
        self.reset()

    def reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.n_moves = 0
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.stems: list[tuple[float, int, bool]] = []
        self.ends: list[tuple] = []  # of each state, the best word that ends there: for short words, and for others
        self.start = self._state({(0, 0, "")})

    def _state(self, pairs: set[tuple[int, int, str]]) -> int:
        """The state of these pairs, those reached by leaving out letters of a term, and none that needs more edits than another."""
        least: dict[tuple[int, str], int] = {}
        todo = list(pairs)
        while todo:
            node, edits, due = todo.pop()
            if least.get((node, due), 9) <= edits:
                continue
            least[node, due] = edits
            if not due and edits < self.edits_below[node]:
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
        if not least:
            return -1
        found = frozenset((node, edits, due) for (node, due), edits in least.items())
        if found not in self.ids:
            self.ids[found] = len(self.states)
            self.states.append(found)
            self.moves.append({})
            self.stems.append(max((self._worth(self.stem_at[n], e) for n, e, due in found if not due), default=(0.0, -1, False)))
            words = [(e, self._worth(self.word_at[n], e)) for n, e, due in found if not due]
            self.ends.append(tuple(max((w for e, w in words if not e or fuzzy), default=(0.0, -1, False)) for fuzzy in (False, True)))
        return self.ids[found]

    def _worth(self, term: int, edits: int) -> tuple[float, int, bool]:
        """Weight of a term met with so many edits, the term, and whether it is a variant; weight 0 if it does not count."""
        if term < 0:
            return 0.0, -1, False
        t = self.terms[term]
        if not edits:
            return t.weight, term, False
        enough = len(t.text) >= ((STEM_FUZZY_FROM if t.stem else FUZZY_FROM) if edits == 1 else TWICE_FROM)
        return (t.fuzzy_weight if enough and (edits == 1 or not t.stem) else 0.0), term, True

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, due in self.states[state]:
            if due:
                if c == due:
                    out.add((node, edits, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits, ""))
            if edits < self.edits_below[node]:
                out.add((node, edits + 1, ""))  # a letter too many
                for other, below in self.children[node].items():
                    out.add((below, edits + 1, ""))  # another letter
                    swapped = self.children[below].get(c)
                    if swapped is not None and other != c:
                        out.add((swapped, edits + 1, other))
        self.n_moves += 1
        found = self.moves[state][c] = self._state(out)
        return found

    def match(self, word: str) -> tuple[int, bool] | None:
        """The best term that the word matches and whether as a variant."""
        if len(self.states) > self.MAX_STATES or self.n_moves > self.MAX_MOVES:
            self.reset()
        state, best, moves, stems = self.start, (0.0, -1, False), self.moves, self.stems
        for c in word:
            after = moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state < 0:
                break
            if stems[state][0] > best[0]:
                best = stems[state]
        if state >= 0 and word:
            best = max(best, self.ends[state][len(word) >= FUZZY_FROM - 1])
        return best[1:] if best[0] > 0 else None


@dataclass
class Matcher:
    """Evidence of whole texts; words known to match nothing are remembered up to a bound."""

    automaton: Automaton
    bound: int = 100_000
    most_letters: int = 4_000_000
    clean: set = field(default_factory=set)
    hits: dict = field(default_factory=dict)
    letters: int = 0

    def _known(self, chunk: str) -> None:
        best = None
        for word, changed in spellings_of(chunk):
            m = self.automaton.match(word)
            if m:
                t, variant = self.automaton.terms[m[0]], m[1] or changed
                w = t.fuzzy_weight if variant else t.weight
                if w > 0 and (best is None or w > best[1]):
                    best = (m[0], w, variant)
        self.letters += len(chunk)
        if best:
            self.hits[chunk] = best
        else:
            self.clean.add(chunk)

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float, bool, bool, int]]]:
        """Number of words; hits as (position, term, weight, fuzzy, quoted, other hits in the window)."""
        words = text.lower().split()
        if len(self.clean) + len(self.hits) > self.bound or self.letters > self.most_letters:
            self.clean.clear()
            self.hits.clear()
            self.letters = 0
        new = set(words) - self.clean
        for w in new:
            if w not in self.hits:
                self._known(w)
        if not (new & self.hits.keys()):
            return len(words), []
        at = [i for i, w in enumerate(words) if w in self.hits]
        out = []
        for j, i in enumerate(at):
            around = sum(1 for k in at[max(0, j - 4) : j + 5] if k != i and abs(k - i) <= WINDOW)
            before = words[max(0, i - WINDOW) : i]
            here = words[i]
            marks = sum(c in QUOTES for w in before for c in w) + (here[0] in QUOTES)
            after = any(c in QUOTES for w in (here, *words[i + 1 : i + 1 + WINDOW]) for c in w)
            quoted = marks % 2 == 1 and after or any(w.strip(",:;.") in REPORTING for w in before[-3:])
            term, weight, fuzzy = self.hits[here]
            out.append((i, term, weight, fuzzy, quoted, min(around, 3)))
        return len(words), out


FEATURES = ("evidence", "per_word", "strongest", "distinct", "plain", "words")


def features(matcher: Matcher, text: str) -> list[float]:
    n, hits = matcher.found(text)
    if not hits:
        return [0.0, 0.0, 0.0, 0.0, 0.0, log(n + 1)]
    in_context = [w * (QUOTED_WEIGHT if q else 1.0) * (1 + NEIGHBOUR_BONUS * k) for _, _, w, _, q, k in hits]
    total = sum(in_context)
    return [log(1 + total), total / (n + 20) ** 0.5, max(in_context), log(1 + len({t for _, t, *_ in hits})), log(1 + sum(w for _, _, w, *_ in hits)), log(n + 1)]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]  # the last is the intercept

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.coef[:-1]) + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _rates(sample: DataFrame, of: str, schema: str, count) -> dict[str, tuple[int, int]]:
    """Positive and negative documents of each counted key, summed by Spark."""
    rows = sample.mapInPandas(released(count), schema).groupBy(of).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return rows


def learn_terms(sample: DataFrame, max_terms: int | None = 400, max_candidates: int | None = 40_000, min_docs: int = 3, min_odds: float = 6.0) -> tuple[Term, ...]:
    """Words and stems that are far likelier in toxic than in other documents of the (bounded) sample.

    The model's size is bounded by parameters: the max_candidates words and stems met in most toxic texts are weighed, and
    the max_terms best of them become the lexicon; None lifts either bound. Words of more than 40 letters are not learned.
    """
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return ()

    def keys(text: str) -> set[str]:
        out = set()
        for w in set(_TOKEN.findall(text.lower())):
            if 2 < len(w) <= 40 and not w.isdigit():
                out.add(w)
                out.update(f"{w[:i]}*" for i in range(STEM_FROM, min(len(w), STEM_TO + 1)))
        return out

    def in_toxic(batches):
        for b in batches:
            seen: dict[str, int] = {}
            for text in b.loc[b["label"] == 1, "text"]:
                for key in keys(text):
                    seen[key] = seen.get(key, 0) + 1
            if seen:
                yield pd.DataFrame({"term": list(seen), "pos": list(seen.values()), "neg": 0})

    least = max(min_docs, pos // 200)
    found = _rates(sample, "term", "term string, pos long, neg long", in_toxic).where(F.col("pos") >= least)
    if max_candidates is not None:
        found = found.orderBy(F.desc("pos"), "term").limit(max_candidates)
    hits = {r["term"]: r["pos"] for r in found.collect()}  # at most max_candidates, or the words of the bounded sample

    def in_others(batches):
        for b in batches:
            seen: dict[str, int] = {}
            for text in b.loc[b["label"] == 0, "text"]:
                for key in keys(text):
                    if key in hits:
                        seen[key] = seen.get(key, 0) + 1
            if seen:
                yield pd.DataFrame({"term": list(seen), "pos": 0, "neg": list(seen.values())})

    misses = {r["term"]: r["neg"] for r in _rates(sample, "term", "term string, pos long, neg long", in_others).collect()}
    odds = {k: log((p + 0.5) / (pos + 1)) - log((misses.get(k, 0) + 0.5) / (neg + 1)) for k, p in hits.items()}
    kept = {k for k, o in odds.items() if o >= log(min_odds)}
    # Of a stem and a longer one found in nearly the same documents, the longer stays.
    for k in sorted(kept, key=len, reverse=True):
        short = k[:-2] + "*" if k.endswith("*") else None
        if k in kept and short in kept and hits[k] >= 0.95 * hits[short] and odds[k] >= odds[short] - 0.05:
            kept.discard(short)
    best = sorted(kept, key=lambda k: (-odds[k] * hits[k] ** 0.5, k))[:max_terms]
    return tuple(Term(k.rstrip("*"), odds[k], k.endswith("*"), 0.0) for k in best)


def with_misspellings(sample: DataFrame, terms: tuple[Term, ...]) -> tuple[Term, ...]:
    """Weights of variants: the term's own, pulled towards what variants show in the sample."""
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not terms or not pos or not neg:
        return terms
    trial = tuple(Term(t.text, t.weight, t.stem, t.weight if len(t.text) >= (STEM_FUZZY_FROM if t.stem else FUZZY_FROM) else 0.0) for t in terms)

    def count(batches):
        matcher = Matcher(Automaton(trial))
        for b in batches:
            seen: dict[tuple[int, int], int] = {}
            for text, label in zip(b["text"], b["label"], strict=True):
                for term in {h[1] for h in matcher.found(text)[1] if h[3]}:
                    seen[term, label] = seen.get((term, label), 0) + 1
            if seen:
                yield pd.DataFrame({"term": [k[0] for k in seen], "pos": [v if k[1] else 0 for k, v in seen.items()], "neg": [0 if k[1] else v for k, v in seen.items()]})

    seen = {r["term"]: (r["pos"], r["neg"]) for r in _rates(sample, "term", "term int, pos long, neg long", count).collect()}
    out = []
    for i, t in enumerate(trial):
        p, n = seen.get(i, (0, 0))
        expected = 2 * neg / pos * np.exp(-t.weight)
        fuzzy = 0.8 * (log((p + 2) / pos) - log((n + expected) / neg)) if t.fuzzy_weight else 0.0
        out.append(Term(t.text, t.weight, t.stem, max(0.0, float(fuzzy))))
    return tuple(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton's method; the last coefficient is the unpenalised intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (p - y) + pen @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 24_000) -> Model:
    """Learn lexicon and weights from at most max_labelled labelled rows outside the held-out quarter."""
    sample = labelled_sample(docs, labels, "toxic", max_labelled)
    terms = with_misspellings(sample, learn_terms(sample))

    def measure(batches):
        matcher = Matcher(Automaton(terms))
        for b in batches:
            yield pd.DataFrame({"f": [features(matcher, t) for t in b["text"]], "label": b["label"]})

    rows = sample.mapInPandas(released(measure), "f array<double>, label int").collect()  # at most max_labelled short rows
    k = len(FEATURES)
    x, y = np.array([r["f"] for r in rows], float).reshape(-1, k), np.array([min(1, max(0, r["label"])) for r in rows], float)
    if not terms or not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model((), (0.0,) * k, (1.0,) * k, (0.0,) * k + (log(rate / (1 - rate)),))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Model(terms, tuple(mean), tuple(scale), tuple(_logistic((x - mean) / scale, y)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every whole text (null: empty). An empty text has the score of no evidence.

    Labels, language and source are not read. Bytes that are not UTF-8 are read as replacement characters. Repeated rows are scored alike, each in its own row; extra columns are
    ignored; an empty table gives no rows.
    """

    scored = _with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score").drop("text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with their columns, that score() does not call toxic.

    Null and empty texts have the score of no evidence; bytes that are not UTF-8 are read as replacement characters and stay; repeated rows go or stay together; columns of any name stay; an
    empty table gives no rows.
    """
    name = fresh(docs, "score")
    return _with_score(docs, model, name).where(F.col(name) < threshold).select(*docs.columns)


def _with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    def run(batches):
        matcher = Matcher(Automaton(model.terms))
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            texts = columns["text"].cast(pa.binary()).to_pylist()
            x = np.array([features(matcher, (t or b"").decode("utf-8", "replace")) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], [*b.schema.names, name])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))
