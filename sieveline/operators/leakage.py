"""Contamination control: exact, near and contained matches between texts, and provenance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from .prefix import stored

#: Ids are broadcast up to this number (8 bytes each), beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts whose windows a task holds at once.
WINDOW_ROWS = 500
#: Bytes of a block of sketches (a row counts ROW_BYTES besides), and classes of size for each step in which similar sizes may differ.
BLOCK_BYTES, ROW_BYTES, CLASSES = 12_000_000, 64, 8
#: Rows and columns of a tile of their comparison, pairs sent at once, and texts of a side of a block of pairs, about.
SKETCH_ROWS, SKETCH_COLUMNS, SENT_PAIRS, PAIR_ROWS = 32, 1024, 100_000, 500


def exact_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """Rows of left whose key equals one of right's, each with right's first row of that key. Empty keys match nothing.

    Keys travel as SHA-256 digests.
    """
    return _equal_digests(*(_keyed(df, row_id, text).where("text <> ''") for df, row_id in ((left, left_id), (right, right_id))))


def _keyed(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, text (the key, empty or null ones too: Spark computes an expression again for a filter on it), key (its hash) and digest."""
    rows = df.select(F.col(row_id).alias("id"), match_key(text).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _equal_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    first = b.groupBy("digest").agg(F.min("id").alias("right_id"))
    return a.select(F.col("id").alias("left_id"), "digest").join(first, "digest").select("left_id", "right_id", F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"))


def gram_hashes(key: str, n: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of n characters; a shorter key is one run."""
    c = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        c = np.concatenate([c, np.full(n - len(c), 0x110000, np.uint64)])  # no character has this number
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h = (h + c[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h.sort()  # np.unique takes several times as long
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def parity_sketch(grams: np.ndarray) -> bytes:
    """For each class of hashes whether it holds an odd number of grams; at least a bit a gram, and a power of two of bits.

    Sketches of two sets differ in no more bits than the sets in grams. A longer sketch is folded to a shorter one by xor of its halves.
    """
    n_bits = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: pd.Series, words: int) -> np.ndarray:
    """Sketches as rows of so many words each."""
    out, lengths = np.empty((len(sketches), words), np.uint64), sketches.str.len().to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(sketches.iloc[at]), np.uint64).reshape(len(at), -1)
        while rows.shape[1] > words:
            rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        out[at] = rows
    return out


def _differing(rows: np.ndarray, columns: np.ndarray, first: int, buffers: tuple[np.ndarray, ...]) -> np.ndarray:
    """Bits in which each row differs from each column in their first words."""
    word, count, three, differ = (x[: len(rows), : columns.shape[1]] for x in buffers)
    differ.fill(0)
    for k in range(0, first, 3):  # three words have 192 bits at most, which a byte holds
        np.bitwise_count(np.bitwise_xor(rows[:, k, None], columns[None, k], out=word), out=three)
        for i in range(k + 1, min(k + 3, first)):
            np.add(three, np.bitwise_count(np.bitwise_xor(rows[:, i, None], columns[None, i], out=word), out=count), out=three)
        np.add(differ, three, out=differ)
    return differ


def alike_tiles(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs whose sizes and sketches (columns size, sketch) allow a similarity of `threshold`, a tile at a time; no such pair is missed."""
    words = min(left["sketch"].str.len().min(), right["sketch"].str.len().min()) // 8
    left_order, right_order = np.argsort(left["size"].to_numpy(), kind="stable"), np.argsort(right["size"].to_numpy(), kind="stable")
    left_size, right_size = left["size"].to_numpy()[left_order].astype(float), right["size"].to_numpy()[right_order].astype(float)
    a, b = _folded(left["sketch"].iloc[left_order], words), np.ascontiguousarray(_folded(right["sketch"].iloc[right_order], words).T)
    share, first = (1 - threshold) / (1 + threshold), (words + 1) // 2
    buffers = tuple(np.empty((SKETCH_ROWS, SKETCH_COLUMNS), t) for t in (np.uint64, np.uint8, np.uint8, np.uint16 if words < 1000 else np.uint32))
    for i in range(0, len(a), SKETCH_ROWS):
        rows, sizes = a[i : i + SKETCH_ROWS], left_size[i : i + SKETCH_ROWS]
        start, end = np.searchsorted(right_size, sizes[0] * threshold - 1e-6), np.searchsorted(right_size, sizes[-1] / threshold + 1e-6, "right")
        for at in range(start, end, SKETCH_COLUMNS):
            stop = min(end, at + SKETCH_COLUMNS)
            differ = _differing(rows, b[:, at:stop], first, buffers)
            most = (sizes + right_size[stop - 1]) * share + 1e-6  # grams in which a similar pair may differ, of the largest column
            x, y = np.divmod(np.flatnonzero(differ <= np.minimum(most, np.iinfo(differ.dtype).max).astype(differ.dtype)[:, None]), stop - at)
            kept = differ[x, y] + np.bitwise_count(rows[x, first:] ^ b[first:, at + y].T).sum(axis=1) <= (sizes[x] + right_size[at + y]) * share + 1e-6
            # the fewest words that rule out nearly all pairs are compared first
            if len(x) - kept.sum() > differ.size / 100:
                first = min(words, first + 1)
            elif len(x) - kept.sum() < differ.size / 1000:
                first = max(1, first - 1)
            if kept.any():
                yield left_order[i + x[kept]], right_order[at + y[kept]]


def alike_sketches(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of alike_tiles() at once."""
    found = list(alike_tiles(left, right, threshold)) or [(np.empty(0, np.int64),) * 2]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def blocks_of(weights: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(first class, last class, part, parts) of blocks of BLOCK_BYTES at most, but for chance: runs of CLASSES classes at most, or parts of one."""
    blocks: list[list[int]] = []
    weight = 0
    for c in sorted(weights):
        if blocks and blocks[-1][3] == 1 and c - blocks[-1][0] < CLASSES and weight + weights[c] <= BLOCK_BYTES:
            blocks[-1][1] = c
            weight += weights[c]
        else:
            parts = max(1, -(-weights[c] // BLOCK_BYTES))
            blocks += [[c, c, part, parts] for part in range(parts)]
            weight = weights[c]
    return [tuple(b) for b in blocks]


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key) of all rows (key, size, sketch) that alike_tiles() finds.

    Sizes are cut into classes and these put together to blocks; each pair of blocks that may hold similar sizes is a cell,
    compared by itself. A row is sent to the cells of its block, so rows are sent more often only as blocks are filled. A task
    holds the left block of a cell; right rows and found pairs pass through it.
    """
    width = max(-math.log(threshold), 0.05) * (1 + 1e-9) / CLASSES
    size_class = F.floor(F.log(F.col("size").cast("double")) / width).cast("int")

    def weights(df: DataFrame) -> dict[int, int]:  # one entry a class; sketches have two bits a gram at most, and are not read for it
        return {r["class"]: r["bytes"] for r in df.groupBy(size_class.alias("class")).agg(F.sum(F.greatest(F.lit(8), F.floor(F.col("size") / 4)) + ROW_BYTES).alias("bytes")).collect()}

    spark, a, b = left.sparkSession, blocks_of(weights(left)), blocks_of(weights(right))
    cells = [(x, y) for x in a for y in b if y[0] - x[1] <= CLASSES and x[0] - y[1] <= CLASSES]
    pairs = "left_key long, right_key long"
    if not cells:
        return spark.createDataFrame([], pairs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * len(cells), 1000))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        numbered = [(i, c, *cell[side][2:]) for i, cell in enumerate(cells) for c in range(cell[side][0], cell[side][1] + 1)]
        mine = (F.col("class") == size_class) & (F.col("part") == F.pmod("key", "parts"))
        return df.join(F.broadcast(spark.createDataFrame(numbered, "cell int, class int, part int, parts int")), mine).select("cell", F.lit(side).alias("side"), "key", "size", "sketch")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, found, n = None, [], [], 0

        def sent() -> pd.DataFrame:
            out = pd.DataFrame({"left_key": np.concatenate([x for x, _ in found]), "right_key": np.concatenate([y for _, y in found])})
            return out[out["left_key"] != out["right_key"]]

        for batch in batches:
            for (at, side), rows in batch.groupby(["cell", "side"]):  # in order
                if at != cell:
                    cell, held = at, []
                if side == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                held = [pd.concat(held)] if len(held) > 1 else held
                sizes = held[0]["size"]
                near = held[0][(sizes >= rows["size"].min() * threshold - 1e-6) & (sizes <= rows["size"].max() / threshold + 1e-6)]
                if near.empty:
                    continue
                left_key, right_key = near["key"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
                for i, j in alike_tiles(near, rows, threshold):
                    found.append((left_key[i], right_key[j]))
                    n += len(i)
                    if n >= SENT_PAIRS:
                        yield sent()
                        found, n = [], 0
        if found:
            yield sent()

    both = dealt(left, 0).unionByName(dealt(right, 1)).repartition(parts, "cell").sortWithinPartitions("cell", "side", "size")
    return both.mapInPandas(compared, pairs)


def _measured(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """The (stored) pairs that are similar, with their exact similarity; texts (key, text) are sent once to each block of pairs they are in.

    Blocks are told by labels, which the keys of a group of alike texts mostly share: a left key's is its smallest right key,
    a right key's the smallest label of its left keys. Large groups are cut.
    """
    n_keys = pairs.select(F.col("left_key").alias("key")).union(pairs.select("right_key")).distinct().count()
    side = max(1, -(-n_keys // PAIR_ROWS))
    left_label = stored(pairs.groupBy("left_key").agg(F.min("right_key").alias("label")))
    right_label = stored(pairs.join(left_label, "left_key").groupBy("right_key").agg(F.min("label").alias("label")))

    def blocks(labels: DataFrame, key: str) -> DataFrame:
        n = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).alias("cuts"))
        return labels.join(n, "label").select(key, F.struct(F.pmod("label", F.lit(side)), F.pmod(key, "cuts")).alias(f"{key}_block"))

    cell = F.xxhash64("left_key_block", "right_key_block")
    celled = stored(pairs.join(blocks(left_label, "left_key"), "left_key").join(blocks(right_label, "right_key"), "right_key").select(cell.alias("cell"), "left_key", "right_key"))
    needed = celled.select(F.col("cell").alias("at"), F.col("left_key").alias("key")).union(celled.select("cell", "right_key")).distinct()
    one = texts.groupBy("key").agg(F.first("text").alias("text"))

    def measured(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        grams = {k: gram_hashes(t, n) for k, t in zip(y["key"], y["text"], strict=True)}
        similarity = np.zeros(len(x))
        for i, (j, k) in enumerate(zip(x["left_key"], x["right_key"], strict=True)):
            few, many = sorted((grams[j], grams[k]), key=len)
            both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
            similarity[i] = both / (len(few) + len(many) - both)
        return x[["left_key", "right_key"]].assign(similarity=similarity)[similarity >= threshold]

    return celled.groupBy("cell").cogroup(needed.join(one, "key").groupBy("at")).applyInPandas(measured, "left_key long, right_key long, similarity double")


def near_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", threshold: float = 0.8, n: int = 5) -> DataFrame:
    """All pairs whose sets of character n-grams have a Jaccard similarity of `threshold` or more, other than equal keys.

    No grams are shuffled: each text sends the size of its set and a parity sketch of about a bit a gram, in blocks of like
    sizes. Pairs whose sketches differ in more bits than similar sets can differ in grams are left out (none is lost), the
    others are measured on their texts. Equal keys are compared once. The number of sketches compared grows with the square
    of the rows; each is sent three times or so, and more often only where the similar sizes of the other side fill several
    blocks. Grams and keys are told by 64-bit hashes; rows without an id are left out.
    """

    return _near(left, right, left_id, right_id, text, threshold, n, _sketches(left, left_id, text, n), _sketches(right, right_id, text, n))


def _sketches(df: DataFrame, row_id: str, text: str, n: int) -> DataFrame:
    """id, key and digest of the rows that have a key, with the size and sketch of their sets; stored."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].fillna("") != ""]
            size, sketch = [], []
            for t in b["text"]:
                grams = gram_hashes(t, n)
                size.append(len(grams))
                sketch.append(parity_sketch(grams))
            yield b[["id", "key", "digest"]].assign(size=np.array(size, np.int32), sketch=sketch)

    return stored(_keyed(df, row_id, text).mapInPandas(sketched, f"id {df.schema[row_id].dataType.simpleString()}, key long, digest binary, size int, sketch binary"))


def _near(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, threshold: float, n: int, a: DataFrame, b: DataFrame) -> DataFrame:
    """near_matches() of the rows whose sketches are a and b."""
    a, b = a.where("id is not null"), b.where("id is not null")
    different = [df.select("key", "size", "sketch").dropDuplicates(["key"]) for df in (a, b)]
    pairs = stored(_candidates(*different, threshold))

    def ids(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key")).distinct()

    def texts(df: DataFrame, row_id: str, rows: DataFrame, side: str) -> DataFrame:
        """(key, text) of the keys in pairs: only rows that are the first of theirs are read into keys again."""
        first = stored(rows.join(pairs.select(F.col(f"{side}_key").alias("key")).distinct(), "key").groupBy("key").agg(F.min("id").alias("_first")).select("_first").distinct())
        few = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
        return _keyed(df.join(few, F.col(row_id) == F.col("_first"), "left_semi"), row_id, text).select("key", "text")

    met = texts(left, left_id, a, "left").unionByName(texts(right, right_id, b, "right"))
    found = _measured(pairs, met, threshold, n).join(ids(a, "left"), "left_key").join(ids(b, "right"), "right_key")
    return found.select("left_id", "right_id", "similarity", F.lit("near").alias("kind"))


def matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Exact matches, and near matches of the rows of left that have no exact one."""
    a, b = _sketches(left, left_id, text, n), _sketches(right, right_id, text, n)
    exact = stored(_equal_digests(a, b))
    ids = exact.select(F.col("left_id").alias("id")).distinct()
    rest = a.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_anti")
    return exact.unionByName(_near(left, right, left_id, right_id, text, threshold, n, rest, b))


def substantive(*texts: Column | str, least: int = 5) -> Column:
    """Each text has at least `least` words."""
    sizes = [F.size(F.split(F.trim(F.col(t) if isinstance(t, str) else t), r"\s+")) for t in texts]
    return F.least(*sizes) >= least if len(sizes) > 1 else sizes[0] >= least


def without_reachable(found: DataFrame, test: DataFrame, test_id: str, allowed: DataFrame, allowed_id: str, text: str = "text") -> DataFrame:
    """Matches whose matched text is not itself (nearly) in the allowed texts, each with `explained` false; others true."""
    hit = test.join(found.select(F.col("right_id").alias(test_id)).distinct(), test_id, "left_semi")
    reached = matches(hit, allowed, test_id, allowed_id, text).select(F.col("left_id").alias("right_id")).distinct().withColumn("explained", F.lit(True))
    return found.join(reached, "right_id", "left").withColumn("explained", F.coalesce("explained", F.lit(False)))


def report(found: DataFrame, by: str) -> DataFrame:
    """Per test file: real (substantive and unexplained), short and explained matches."""
    real, short = F.col("substantive") & ~F.col("explained"), ~F.col("substantive")
    return found.groupBy(by).agg(F.count_if(real).alias("real"), F.count_if(short & ~F.col("explained")).alias("short"), F.count_if(F.col("explained")).alias("explained"))


def require_no_leakage(reported: DataFrame, by: str) -> None:
    """Raise if any test file of a report() has real matches; the error names files and numbers. Reports are short."""
    bad = reported.where(F.col("real") > 0).orderBy(F.desc("real"), by).select(by, "real").limit(20).collect()
    if bad:
        raise ValueError(f"leakage: {', '.join(f'{r[by]} ({r['real']} matches)' for r in bad)}")


def without_leaked_sources(rows: DataFrame, source: str, leaked: DataFrame, text: str) -> DataFrame:
    """rows whose source is none of the leaked texts, compared by their keys, before anything is drawn from them.

    Null sources and those without a key stay.
    """
    keys = leaked.select(match_key(text).alias("_key")).where("_key <> ''").distinct()
    return rows.withColumn("_key", match_key(source)).join(keys, "_key", "left_anti").select(*rows.columns)


def window_hashes(key: str, words: int, first_only: bool = False) -> np.ndarray:
    """A hash of each distinct window of so many words of a text's key, or of the first window alone; none for shorter texts."""
    listed = [w for w in key.split(" ") if w]
    if len(listed) < words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(listed[:words] if first_only else listed, dtype=object), categorize=False)
    n, out = len(h) - words + 1, np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(out)


def contained(long_texts: DataFrame, short_texts: DataFrame, long_id: str, short_id: str, text: str = "text", words: int = 8) -> DataFrame:
    """(long_id, short_id) where the normalised short text stands within the long one. Short texts have `words` words or more.

    The short texts' first `words` words are an equi-join key against every window of that many words of the long texts;
    only such pairs are searched for the whole text. The pairs are stored, so only long texts that are in one are read into
    words again and sent. Rows without an id are left out.
    """

    def toks(c: str) -> Column:
        return F.filter(F.split(match_key(F.lower(c)), " "), lambda w: F.length(w) > 0)

    def windows_of(first_only: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start in range(0, len(b), WINDOW_ROWS):
                    part = b.iloc[start : start + WINDOW_ROWS]
                    found = [window_hashes(key, words, first_only) for key in part["key"]]
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), [len(f) for f in found]), "key": np.concatenate(found).view(np.int64)})

        return run

    def windows(df: DataFrame, row_id: str, first_only: bool) -> DataFrame:
        keyed = df.select(F.col(row_id).alias("id"), match_key(F.lower(text)).alias("key")).where("id is not null and key <> ''")
        return keyed.mapInPandas(windows_of(first_only), f"id {df.schema[row_id].dataType.simpleString()}, key long")

    firsts = windows(short_texts, short_id, True).withColumnRenamed("id", "short_id").distinct()
    needles = short_texts.select(F.col(short_id).alias("short_id"), toks(text).alias("w")).where(F.size("w") >= words).select("short_id", F.array_join("w", " ").alias("needle"))
    met_keys = windows(long_texts, long_id, False).withColumnRenamed("id", "long_id").join(firsts, "key").select("long_id", "short_id").distinct()
    pairs = stored(met_keys.join(needles, "short_id").distinct())
    ids = pairs.select("long_id").distinct()
    met = long_texts.select(F.col(long_id).alias("long_id"), F.col(text).alias("text")).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "long_id", "left_semi")
    hay = met.select("long_id", F.concat(F.lit(" "), F.array_join(toks("text"), " "), F.lit(" ")).alias("hay"))
    return pairs.join(hay, "long_id").where(F.contains("hay", F.concat(F.lit(" "), F.col("needle"), F.lit(" ")))).select("long_id", "short_id")


def provenance(rows: DataFrame, corpus: DataFrame, row_id: str, text: str, split: str = "split") -> DataFrame:
    """rows with split, match_method (id, text or none) and in_several_splits, looked up by id, else by normalised text.

    corpus: row_id, text, split. Of an id in several splits, the order train, dev, test decides; of a text, the alphabet.
    """
    rank = F.when(F.col(split) == "train", 0).when(F.col(split) == "dev", 1).otherwise(2)
    by_id = corpus.groupBy(row_id).agg(F.min_by(split, rank).alias("id_split"), F.min_by(match_key(text), rank).alias("id_key"))
    by_text = corpus.groupBy(match_key(text).alias("key")).agg(F.min(split).alias("text_split"), F.count_distinct(split).alias("splits"))
    found = rows.join(by_id, row_id, "left").withColumn("key", F.coalesce("id_key", match_key(text))).join(by_text, "key", "left")
    method = F.when(F.col("id_split").isNotNull(), "id").when(F.col("text_split").isNotNull(), "text").otherwise("none")
    return found.select(*rows.columns, F.coalesce("id_split", "text_split").alias("found_split"), method.alias("match_method"), (F.coalesce("splits", F.lit(0)) > 1).alias("in_several_splits"))


def allowed_rows(annotated: DataFrame, include: tuple[str, ...] = ("train",), drop_conflicts: bool = True) -> DataFrame:
    kept = annotated.where(F.col("found_split").isin(*include))
    return kept.where(~F.col("in_several_splits")) if drop_conflicts else kept
