"""Substring dedup: words that stand in a long passage which an earlier document has too are removed.

A passage repeats if its first 50 words do, so each suffix matters to a depth of 50 words. The suffixes are partitioned by
prefixes: each window of 50 words goes to the group of its smallest shingle (PREFIX words), which equal windows have in
common, so neighbours that share it travel together as one stretch of text. A shingle that only one document has starts
no repeat, and nothing of it is sent. Groups are put together until they are as large as a task should hold; there the
suffixes are named level by level (1, 2, 4, ... 32, 50 words), which sorts them and gives the tree's nodes of that depth.
An inner node at depth 50 is a repeat; consecutive ones make a maximal repeat. A prefix with more stretches than a task
should hold is lengthened to the whole 50 words: its node is then a group of its own, of which only the smallest document
is needed, so Spark adds it up before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import scramble, windows

#: Words of a prefix, windows of a stretch, stretches of a group (and of a prefix before it is lengthened).
PREFIX, STRETCH, GROUP = 10, 64, 4096
#: Documents and spans that a broadcast may hold; beyond them the texts are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_SPANS = 500_000, 4_000_000
#: Rows of a group of copies or of equal windows whose first is broadcast, and such groups at most (some 50 bytes each).
HOT, HOT_GROUPS = 1000, 200_000

_MARKS = "doc_id long, row_hash long, n_words long, digest binary, keys array<long>, starts array<int>, counts array<int>"
_STRETCHES = "key long, heavy boolean, doc_id long, row_hash long, start int, count int, words binary"
_SPANS = "doc_id long, row_hash long, start int, stop int"
_WINDOWS = "high long, low long, doc_id long, row_hash long, start int"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; only ASCII white space separates them."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, from minima that run forwards and backwards inside blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and numbers of windows of the stretches of a text: neighbours whose smallest shingle is alike."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    prefix = min(PREFIX, window)
    low = sliding_minima(windows(hashes, prefix), window - prefix + 1)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    first = np.nonzero(new)[0]
    inside = np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))
    first = np.nonzero(inside % STRETCH == 0)[0]
    return low[first], first.astype(np.int32), np.diff(np.append(first, len(low))).astype(np.int32)


def _marks(window: int):
    import hashlib

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                keys, starts, counts = stretches(_hashes(words), window)
                rows.append((len(words), hashlib.sha256(b" ".join(words)).digest(), keys.view(np.int64), starts, counts))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "row_hash", "n_words", "digest", "keys", "starts", "counts"],
            )

    return of


def _cut(window: int):
    """The words of the wanted stretches of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, row_hash, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "text", "wanted")), strict=True):
                words = words_of(text)
                out += [(w["key"], w["heavy"], doc_id, row_hash, w["start"], w["count"], b" ".join(words[w["start"] : w["start"] + w["count"] + window - 1])) for w in wanted]
            for s in range(0, len(out), 10_000):
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[s : s + 10_000], strict=True), kinds, strict=True)], names=["key", "heavy", "doc_id", "row_hash", "start", "count", "words"])

    return of


def named(words: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the `depth` words from each place on among all such sequences: equal ranks, equal words.

    Levels of 1, 2, 4, ... words are ranked by pairs of the level before; the last pair overlaps where depth is no power
    of two. Places with fewer words after them get ranks that mean nothing.
    """
    names, have = words.astype(np.int64) + 1, 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros_like(names)
        after[:-step] = names[step:]
        _, names = np.unique(names * (names.max(initial=0) + 1) + after, return_inverse=True)
        names, have = names.astype(np.int64) + 1, have + step
    return names


def _subtrees(window: int):
    """Spans of the stretches of one group whose windows also stand in an earlier document."""

    def of(table: pa.Table) -> pa.Table:
        doc, start, count = (table.column(c).to_numpy() for c in ("doc_id", "start", "count"))
        row_hash = table.column("row_hash").to_numpy()
        lengths = count.astype(np.int64) + window - 1
        flat = b" ".join(table.column("words").to_pylist()).split()
        node = named(pd.factorize(np.array(flat, dtype=object))[0], window)
        begin = np.cumsum(lengths) - lengths
        of_stretch = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(of_stretch)) - np.repeat(np.cumsum(count) - count, count)
        node = node[begin[of_stretch] + place]  # one leaf for each suffix that has all its words
        order = np.argsort(node, kind="stable")
        edge = np.nonzero(np.diff(node[order], prepend=-1))[0]
        least = np.minimum.reduceat(doc[of_stretch][order], edge)
        earliest = np.empty(len(node), np.int64)
        earliest[order] = np.repeat(least, np.diff(np.append(edge, len(node))))
        again = earliest < doc[of_stretch]
        # Consecutive repeats of a stretch are one span.
        before = np.zeros(len(again), bool)
        before[1:] = again[:-1] & (of_stretch[1:] == of_stretch[:-1])
        after = np.zeros(len(again), bool)
        after[:-1] = again[1:] & (of_stretch[1:] == of_stretch[:-1])
        first, last = np.nonzero(again & ~before)[0], np.nonzero(again & ~after)[0]
        at = of_stretch[first]
        return pa.table({"doc_id": doc[at], "row_hash": row_hash[at], "start": (start[at] + place[first]).astype(np.int32), "stop": (start[at] + place[last] + window).astype(np.int32)})

    return of


def _whole_windows(window: int):
    """128-bit hashes of the windows of stretches whose prefix is lengthened to the whole window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("count").to_numpy()
            rows = [_hashes(x.split()) for x in batch.column("words").to_pylist()]
            both = [np.concatenate([windows(h if i == 0 else scramble(h ^ np.uint64(0x5851F42D4C957F2D)), window) for h in rows] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1)]
            at = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, both), *(pa.array(batch.column(c).to_numpy()[at]) for c in ("doc_id", "row_hash")), pa.array((batch.column("start").to_numpy()[at] + place).astype(np.int32))],
                names=["high", "low", "doc_id", "row_hash", "start"],
            )

    return of


def text_hash(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _with(texts: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """texts joined with one list for each document; the lists are broadcast only while they are few and short."""
    docs, spans = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    small = docs <= BROADCAST_DOCS and spans <= BROADCAST_SPANS
    return texts.join(F.broadcast(lists) if small else lists, ["doc_id", "row_hash"], how)


def _first_of(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with `first` of their group (keys, first, n rows).

    A group that holds a third of all rows would fill one task of a join by a shuffle. Of groups of HOT rows or more, and
    of so many that there are HOT_GROUPS of them at most, the firsts are broadcast; all others have fewer rows.
    """
    hot_from = max(HOT, (groups.agg(F.sum("n")).first()[0] or 0) // HOT_GROUPS + 1)
    hot, cold = (groups.where(c).drop("n") for c in (F.col("n") >= hot_from, F.col("n") < hot_from))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, row_hash (of the text), spans (array of start, stop in words) of what earlier documents have too.

    A span covers every window of `window` words whose words also start in a document with a smaller doc_id. Spans may
    overlap. Documents without repeats, with fewer words, without text or without id have no row; the latter also count
    as earlier than none. Rows that share a doc_id are not earlier than one another. Copies of a whole text are told by
    its digest: they are one span, and only the first takes part in the rest.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("row_hash"))
    marks = written(texts.where("doc_id is not null").mapInArrow(_marks(window), _MARKS).where(F.col("n_words") >= window), "marks")
    firsts = written(marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "firsts")
    copied = written(_first_of(marks.select("doc_id", "row_hash", "n_words", "digest"), firsts, ["digest"]).where("doc_id > first").select("doc_id", "row_hash", "n_words").distinct(), "copies")
    marked = written(marks.drop("digest").join(copied.drop("n_words"), ["doc_id", "row_hash"], "left_anti"), "marked")
    listed = marked.select("doc_id", "row_hash", F.explode(F.arrays_zip("keys", "starts", "counts")).alias("s")).select("doc_id", "row_hash", F.col("s.keys").alias("key"), F.col("s.starts").alias("start"), F.col("s.counts").alias("count"))
    shared = written(listed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("key", (F.col("n") > GROUP).alias("heavy"), "n"), "shared")
    light = shared.where("not heavy").agg(F.sum("n")).first()[0] or 0
    wanted = written(listed.join(shared.drop("n"), "key").groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("key", "heavy", "start", "count")).alias("wanted")), "wanted")
    cut = written(_with(texts, wanted, "wanted", "inner").mapInArrow(_cut(window), _STRETCHES), "stretches")
    groups = max(1, ceil(light / GROUP))
    spans = cut.where("not heavy").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("bucket").applyInArrow(_subtrees(window), _SPANS)
    whole = cut.where("heavy").mapInArrow(_whole_windows(window), _WINDOWS)
    earliest = whole.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    earliest = written(earliest.select("high", "low", "first", "n"), "earliest")
    more = _first_of(whole, earliest, ["high", "low"]).where("doc_id > first").select("doc_id", "row_hash", "start", (F.col("start") + window).alias("stop"))
    found = spans.unionByName(more).groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    copies = copied.select("doc_id", "row_hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))).alias("spans"))
    return written(found.unionByName(copies), "spans")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = words_of(text)
            n = len(words)
            if spans:
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["stop"] for s in spans], -1)
                words = [words[i] for i in np.nonzero(np.cumsum(gone[:n]) == 0)[0]]
            rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) for every row.

    Words are what ASCII white space separates. Null and empty texts have no words, keep '' and lose nothing; rows
    without id neither lose words nor take them from others; repeated rows get the same result. Other columns play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("row_hash"))
    return _with(texts, repeated_spans(docs, window), "spans", "left").mapInArrow(_strip, _KEPT)
