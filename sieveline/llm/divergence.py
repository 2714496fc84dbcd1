"""Source divergence audit: which sources of a language use its words otherwise than their neighbours do.

Tasks cut texts into terms in numpy and pack them by length: a term of up to 8 bytes is one 64-bit word, one of up to 16
bytes is two, and longer ones stand in a bucket of their own as bytes. Packed words are radix-sorted by 16-bit digits,
long terms as bytes, and equal neighbours are counted as runs, so that a task sends one row for each term of a source.
Packed big-endian words sort as their bytes do, and no term holds a zero byte, so packing loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes of text that a task packs and counts at once, counted rows that it holds before it sends them, and kept terms
#: and sources that meet in one call of `_tile` (about).
CHUNK_BYTES, HELD_ROWS, TILE_TERMS, TILE_SOURCES = 4 << 20, 1_000_000, 4096, 64
SCALE = 1_000_000_000

_COUNTED = "lang string, source string, high long, low long, rest binary, n long, docs long"
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True


def radix_order(*words: np.ndarray) -> np.ndarray:
    """A stable order by the 64-bit words, the first counting most: sorts by 16-bit digits from the least one, skipping digits that are all alike."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and texts' numbers of the terms in UTF-8 bytes; text i stands at offsets[i] to offsets[i + 1]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_TERM[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]  # a term does not run on from one text to the next
    begins[borders] |= inside[1:-1][borders]
    ends[borders - 1] |= inside[1:-1][borders - 1]
    starts, stops = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return starts, stops - starts, np.searchsorted(offsets, starts, side="right") - 1


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """The first 8 * words bytes of each term as big-endian 64-bit words, filled up with zeros."""
    out = []
    for w in range(words):
        value = np.zeros(len(starts), np.uint64)
        for i in range(8 * w, 8 * w + 8):
            there = i < lengths
            value = (value << np.uint64(8)) | np.where(there, data[np.where(there, starts + i, 0)], 0).astype(np.uint64)
        out.append(value)
    return out


def _runs(keys: list[np.ndarray], n: np.ndarray, docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal neighbours of sorted keys as one row with summed counts."""
    new = np.zeros(len(n), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    if len(n):
        new[0] = True
    first = np.nonzero(new)[0]
    if not len(first):
        return keys, n, docs
    return [k[first] for k in keys], np.add.reduceat(n, first), np.add.reduceat(docs, first)


class _Bucket:
    """Counted terms of one length class: keys (group, then the packed words or the bytes), occurrences and documents."""

    def __init__(self, words: int) -> None:
        self.words, self.parts, self.rows = words, [], 0

    def add(self, keys: list[np.ndarray], doc: np.ndarray) -> None:
        """Terms in order of documents; a document is counted once for each of its terms."""
        keys = self._sorted([*keys, doc])
        if not len(keys[0]):
            return
        ones = np.ones(len(keys[0]), np.int64)
        keys, n, _ = _runs(keys, ones, ones)
        self._keep(*_runs(keys[:-1], n, np.ones(len(n), np.int64)))

    def _sorted(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        if self.words:
            order = radix_order(keys[0], *keys[1 : 1 + self.words])  # stable, so documents stay in order
        else:
            order = np.array(sorted(range(len(keys[0])), key=lambda i: (keys[0][i], keys[1][i])), np.int64)
        return [k[order] for k in keys]

    def _keep(self, keys: list[np.ndarray], n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((keys, n, docs))
        self.rows += len(n)

    def merged(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
        """All parts as one, with each key once; they stay held as that one part."""
        if len(self.parts) > 1:
            columns = [np.concatenate(c) for c in zip(*([*k, n, d] for k, n, d in self.parts), strict=True)]
            columns = self._sorted(columns)
            self.parts, self.rows = [], 0
            self._keep(*_runs(columns[:-2], columns[-2], columns[-1]))
        return self.parts[0] if self.parts else None

    def clear(self) -> None:
        self.parts, self.rows = [], 0


class Counter:
    """Counts the terms of a task's texts for each (lang, source); `rows` yields what is held and forgets it."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.buckets = [_Bucket(1), _Bucket(2), _Bucket(0)]
        self.merged_rows = 0

    def add(self, texts: list[str], langs: list[str], sources: list[str]) -> None:
        coded = [x.encode("utf-8", "surrogatepass") for x in texts]
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.uint64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded], dtype=np.int64)])
        starts, lengths, doc = term_spans(data, offsets)
        upper = (data >= 0x41) & (data <= 0x5A)
        data = np.where(upper, data + 0x20, data).astype(np.uint8)
        for bucket, low, high in zip(self.buckets, (0, 8, 16), (8, 16, None), strict=True):
            at = np.nonzero((lengths > low) & (lengths <= high if high else True))[0]
            if bucket.words:
                words = packed(data, starts[at], lengths[at], bucket.words)
            else:
                raw = data.tobytes()
                words = [np.array([raw[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)], object)]
            bucket.add([group[doc[at]], *words], doc[at])
        if sum(b.rows for b in self.buckets) > self.merged_rows + HELD_ROWS // 3:
            for b in self.buckets:
                b.merged()
            self.merged_rows = sum(b.rows for b in self.buckets)

    @property
    def full(self) -> bool:
        return self.merged_rows > HELD_ROWS

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        langs, sources = (np.array([g[i] for g in names], object) for i in (0, 1))
        for bucket in self.buckets:
            found = bucket.merged()
            if found is None:
                continue
            keys, n, docs = found
            group = keys[0].astype(np.int64)
            for s in range(0, len(n), 20_000):
                at = slice(s, s + 20_000)
                if bucket.words:
                    high, low, rest = keys[1][at], keys[2][at] if bucket.words == 2 else np.zeros(len(n[at]), np.uint64), [b""] * len(n[at])
                else:
                    high, low = _ends(keys[1][at])
                    rest = [x[16:] for x in keys[1][at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[group[at]], pa.string()), pa.array(sources[group[at]], pa.string()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(rest, pa.binary()), pa.array(n[at]), pa.array(docs[at])],
                    names=["lang", "source", "high", "low", "rest", "n", "docs"],
                )
            bucket.clear()
        self.groups, self.merged_rows = {}, 0


def _ends(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of long terms as two words."""
    both = np.frombuffer(b"".join(x[:16] for x in terms), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        texts, langs, sources = (batch.column(i) for i in range(3))
        ends = np.cumsum([len(x) for x in texts.to_pylist()])
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            counter.add(*(c.slice(start, stop - start).to_pylist() for c in (texts, langs, sources)))
            start = stop
            if counter.full:
                yield from counter.rows()
    yield from counter.rows()


def _term() -> Column:
    """The term that high, low and rest hold."""
    digits = F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))
    return F.decode(F.concat(F.unhex(F.regexp_replace(digits, "(00)+$", "")), F.col("rest")), "UTF-8")


def term_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, source, term, n (occurrences there), total (in the language) for the kept terms: those in at least least_docs documents of their language.

    A term is a run of letters A-Z, a-z and characters beyond ASCII; A-Z are lower-cased. Null texts, languages and
    sources are ''. Rows that share a doc_id are documents of their own.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    key = ["lang", "high", "low", "rest"]
    # First a sum for each source: a frequent term then brings one row a source, not one a source and task, to its language's sum.
    counted = rows.mapInArrow(_count, _COUNTED).groupBy("source", *key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy(*key)
    both = counted.select("*", F.sum("docs").over(of_lang).alias("all_docs"), F.sum("n").over(of_lang).alias("total"))
    return both.where(F.col("all_docs") >= least_docs).select("lang", "source", _term().alias("term"), "n", "total")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly; null without terms."""
    return F.lit(1).cast("long") + F.call_function(
        "div", ((count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)"), F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(38,0)")
    )


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """`share` in numpy: long division by three decimal digits at a time, exact for totals below 9 * 10^15."""
    out, left = np.zeros(np.broadcast(n, total).shape, np.int64), (n + 2) * np.ones_like(total)
    whole, left = left // total, left % total
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + SCALE * whole + out


_TILE = "lang string, a string, b string, value long"


def _tile(terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Gaps between the sources of two chunks, summed over the terms of a block; a pair once, a before b.

    Terms of the block that none of these sources has are not among `terms`; `block_terms` counts them all.
    """
    if sources.empty:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
    sources = sources.sort_values("source", ignore_index=True)
    row = {s: i for i, s in enumerate(sources["source"])}
    codes, distinct = pd.factorize(terms["term"])
    counts = np.zeros((len(row), len(distinct) + 1), np.int64)  # the last column: a term that none has
    counts[terms["source"].map(row).to_numpy(np.int64), codes] = terms["n"].to_numpy(np.int64)
    times = np.ones(len(distinct) + 1, np.int64)
    times[-1] = sources["block_terms"].iloc[0] - len(distinct)
    p = _shares(counts, sources["of"].to_numpy(np.int64)[:, None])
    chunk, a, b, value = sources["chunk"].to_numpy(), [], [], []
    low, high = sources["ca"].iloc[0], sources["cb"].iloc[0]
    for i in range(len(row)):
        others = i + 1 + np.nonzero((np.minimum(chunk[i], chunk[i + 1 :]) == low) & (np.maximum(chunk[i], chunk[i + 1 :]) == high))[0]
        a += [i] * len(others)
        b += others.tolist()
        value += ((p[others] - p[i]) ** 2 // (p[others] + p[i]) @ times).tolist()
    names = sources["source"].to_numpy()
    return pd.DataFrame({"lang": sources["lang"].iloc[0], "a": names[np.array(a, int)], "b": names[np.array(b, int)], "value": np.array(value, np.int64)})


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Part `pair` has every other source of the language with the sum over all kept terms of the gap between both shares
    (0 where no term is kept); part `term` the `top` kept terms that the source uses more than its language does. Ranks
    go from the largest value, ties to the smaller item by its UTF-8 bytes. The pairs are the result itself, so they
    grow with the square of a language's sources; terms and sources are cut into blocks for them, so no task holds more
    than TILE_TERMS x 2 * TILE_SOURCES counts (about). No documents give no rows; other columns play no part.
    """
    kept = written(term_counts(docs, least_docs), "kept_terms")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = kept.groupBy("lang", "term").agg(F.max("total").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = written(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
        .select("lang", "source", "sources", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("source_n", "lang_n", "terms")))
        .withColumn("chunks", F.ceil(F.col("sources") / TILE_SOURCES))
        .withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks"))
        .withColumn("blocks", F.ceil(F.col("terms") / TILE_TERMS)),
        "groups",
    )
    counted = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("source_n"), F.col("terms")), share(F.col("total"), F.col("lang_n"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        counted.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    tile = ["lang", "block", "ca", "cb"]
    of_block = kept.select("lang", "term").distinct().join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block")).agg(F.count(F.lit(1)).alias("block_terms"))
    partners = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    ends = [F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb")]
    cells = counted.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "chunk", partners).select("lang", "block", *ends, "source", "term", "n")
    needed = (
        groups.join(of_block, "lang").select("lang", "block", "block_terms", "source", "chunk", (F.col("source_n") + 2 * F.col("terms")).alias("of"), partners)
        .select("lang", "block", *ends, "block_terms", "source", "chunk", "of")
    )
    halves = cells.groupBy(*tile).cogroup(needed.groupBy(*tile)).applyInPandas(_tile, _TILE).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums_of_pairs = halves.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(halves.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    # Where a language keeps no term, its sources' pairs have no cells, but rows with the value 0.
    bare = groups.where("terms = 0").select("lang", "source")
    sums_of_pairs = sums_of_pairs.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    pairs = sums_of_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
