"""N-gram Jaccard join: a size-aware heavy-light self join of the documents' shingle sets.

Small (light) sets are joined by enumerating their fixed-size subsets: two sets are linked exactly when they share a
subset of the size that the threshold asks for. Large (heavy) sets are joined by scanning inverted lists. A list holds
the sets that agree in one part, which is a fixed share of all possible shingles, and not the sets that hold one shingle:
lists of frequent shingles grow with the corpus, lists of parts only with the number of alike sets. Sets that differ in
few shingles must agree in a known number of parts, so the join is exact. The boundary between light and heavy is the
size at which enumeration becomes dearer than lists and checks, by the size histogram of the corpus.
"""

from __future__ import annotations

import hashlib
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, released, without, written
from .components import connected
from .shingles import scramble, shingle_set

#: Sizes for which subsets can be enumerated at all: their number must stay below MAX_SUBSETS.
MAX_LIGHT, MAX_SUBSETS = 48, 2000
#: Ids are broadcast up to this number (8 bytes each), beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Longs of a set's parity sketch: bit i is the parity of the number of its shingles that hash to i.
PARITY_LONGS = 16
#: Hubs of a list, besides its smallest set.
EXTRA_HUBS = 3
#: Groups of equal sets with so many members are joined by a broadcast of the groups; BROADCAST_IDS bounds their number too.
HOT_MEMBERS = 1000
#: Members of a list that one task compares with all others of the list.
LIST_BLOCK = 1000
#: Cost of checking a candidate, per shingle, in key rows.
CHECK_COST = 0.25


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shingles that a set of n shares with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def most_apart(n: int, m: int, num: int, den: int) -> int:
    """The most shingles that only one of two linked sets of n and m holds."""
    return (den - num) * (n + m) // (den + num)


def subsets_of(n: int, num: int, den: int) -> int:
    return sum(comb(n, c) for c in range(least_overlap(n, num, den), n + 1))


class Parts:
    """Size classes and their numbers of parts. Class j holds sizes starts[j] to starts[j + 1] - 1.

    A linked pair is found in the class of its smaller set; the larger set, where it can reach into the class below,
    is listed there too. Sets of a class are cut into `apart` + spare parts, where `apart` bounds the differences.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.growth = 1 + 1.4 * ((den - num) / num) ** 0.5

    def starts(self, n: int) -> tuple[int, int, int]:
        """Class of size n, its first size and the first size of the next class."""
        j, low = 0, 1
        while True:
            high = max(low + 1, ceil(low * self.growth))
            if n < high:
                return j, low, high
            j, low = j + 1, high

    def count(self, high: int) -> int:
        top = high - 1
        apart = most_apart(top, top * self.den // self.num, self.num, self.den)
        return apart + 2 + ceil(0.04 * apart)

    def listings(self, n: int) -> list[tuple[int, int, int]]:
        """(class, parts, most differences) of each class that a set of n is listed in."""
        j, low, high = self.starts(n)
        out = [(j, self.count(high), most_apart(n, n * self.den // self.num, self.num, self.den))]
        if j and least_overlap(n, self.num, self.den) < low:
            out.append((j - 1, self.count(low), most_apart(n, low - 1, self.num, self.den)))
        return out


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest light size, by cost: subsets enumerated against parts listed and candidates checked.

    sizes: number of sets of each size up to MAX_LIGHT. Light sets that a heavy set can reach are listed too.
    """
    parts, last = Parts(num, den), 0
    while last < MAX_LIGHT and subsets_of(last + 1, num, den) <= MAX_SUBSETS:
        last += 1
    listed = {n: sum(m for _, m, _ in parts.listings(n)) + CHECK_COST * n for n in range(1, MAX_LIGHT + 1)}

    def cost(x: int) -> float:
        return sum(k * ((subsets_of(n, num, den) if n <= x else 0) + (listed[n] if n >= least_overlap(x + 1, num, den) else 0)) for n, k in sizes.items() if 1 <= n <= MAX_LIGHT)

    return min(range(last + 1), key=lambda x: (cost(x), x))


def subset_keys(toks: np.ndarray, num: int, den: int) -> np.ndarray:
    """A key of each subset that is large enough to prove a link; the low six bits hold the subset's size."""
    n = len(toks)
    mixed = scramble(toks)
    sums, last, out = np.array([mixed.sum(dtype=np.uint64)], np.uint64), np.array([-1]), []
    for size in range(n, least_overlap(n, num, den) - 1, -1):
        out.append(scramble(sums + np.array([size], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(63) | np.uint64(size))
        row, col = np.nonzero(np.arange(n)[None, :] > last[:, None])  # the next shingle left out comes after the last one
        sums, last = sums[row] - mixed[col], col
    return np.concatenate(out)


def part_keys(toks: np.ndarray, j: int, m: int, apart: int) -> tuple[np.ndarray, int]:
    """Keys of the parts of a set in class j, and how many of them any partner shares at least.

    Parts without shingles are left out, unless they are so many that a partner might share no others.
    """
    mixed = scramble(toks ^ np.uint64(0xD6E8FEB86659FD93))
    part = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, first = np.unique(part[order], return_index=True)
    sums = np.zeros(m, np.uint64)
    sums[at] = np.add.reduceat(scramble(mixed[order]), first)
    keys = scramble(sums + scramble(np.arange(m, dtype=np.uint64) + np.uint64(j << 32) + np.uint64(1)))
    empty, shared = m - len(at), m - apart
    return (keys[at], shared - empty) if empty < shared else (keys, 1)


def _keyed(docs: DataFrame, k: int, num: int, den: int, light: int) -> DataFrame:
    """Rows of (doc_id, set_hash, n, class, need, keys): class -1 holds subsets, others the parts of a listing."""
    parts = Parts(num, den)
    listed_from = least_overlap(light + 1, num, den)

    def keys(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                toks = shingle_set(text, k)
                n = len(toks)
                if not n:
                    continue
                digest = _digest(toks)
                with np.errstate(over="ignore"):
                    if n <= light:
                        rows.append((doc, digest, n, -1, 0, subset_keys(toks, num, den).view(np.int64)))
                    if n >= listed_from:
                        for j, m, apart in parts.listings(n):
                            found, need = part_keys(toks, j, m, apart)
                            rows.append((doc, digest, n, j, need, found.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "set_hash", "n", "class", "need", "keys"])

    return docs.where("doc_id is not null").mapInPandas(released(keys), "doc_id long, set_hash binary, n long, class int, need int, keys array<long>")


def _digest(toks: np.ndarray) -> bytes:
    return hashlib.blake2b(toks.tobytes(), digest_size=16).digest()


def _sized(docs: DataFrame, k: int) -> DataFrame:
    def sizes(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "set_hash": [_digest(s) for s in sets]})

    return docs.mapInPandas(released(sizes), "doc_id long, n long, set_hash binary")


def _shared_lists(rows: DataFrame) -> DataFrame:
    """The rows (key, ...) whose key some other row has too: one shuffle, then a scan of sorted runs in bounded memory."""

    def runs(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            same = np.concatenate([[False], key[1:] == key[:-1]])
            if held is not None:
                same[0] = met
            keep = same.copy()
            keep[:-1] |= same[1:]
            held, met = batch.iloc[[-1]], bool(same[-1])
            yield batch[keep & (np.arange(len(batch)) < len(batch) - 1)]
        if held is not None and met:
            yield held

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(released(runs), rows.schema)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def parity(toks: np.ndarray) -> np.ndarray:
    """Sketches of two sets differ in at most as many bits as the sets differ in shingles."""
    bits = np.bincount((scramble(toks) >> np.uint64(20)).astype(np.int64) % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(p, q, n, m, num: int, den: int):
    """False only for pairs whose sketches differ in more bits than linked sets may differ in shingles."""
    differing = sum((F.bit_count(F.get(p, i).bitwiseXOR(F.get(q, i))) for i in range(1, PARITY_LONGS)), F.bit_count(F.get(p, 0).bitwiseXOR(F.get(q, 0))))
    return differing * (den + num) <= (den - num) * (n + m)


def _token_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    def sets(batches):
        for batch in batches:
            toks = [shingle_set(t, k) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["doc_id"], "toks": [t.tobytes() for t in toks], "size": [len(t) for t in toks], "sketch": [parity(t) for t in toks]})

    schema = "id long, toks binary, size int, sketch array<long>"
    return written(docs.join(_few(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi").mapInPandas(released(sets), schema), "sets")


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, as edges."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]].rename(columns={"a": "src", "b": "dst"})

    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("toks").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("toks").alias("y")), "b")
        .mapInPandas(released(check), "src long, dst long")
    )


def _apart(pairs: DataFrame, clusters: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose ends are not in one cluster yet and whose sketches let them be linked."""
    known = sets.select(F.col("id").alias("node"), "size", "sketch").join(clusters, "node", "left").withColumn("component", F.coalesce("component", "node"))
    a, b = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where((F.col("ca") != F.col("cb")) & _may_link("sa", "sb", F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _selective(lists: DataFrame) -> DataFrame:
    """Of each listing, the lists that its partners cannot all avoid, shortest first.

    A partner shares `need` lists or more. A listing with fewer shared lists has no partner; of k shared lists, the
    need - 1 longest can go, as the shortest list of a linked pair stays on both sides.
    """
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    own = Window.partitionBy("id", "class")  # at most as many rows as the set has parts
    ranked = lists.join(sizes, "key").withColumns({"k": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("members", "key"))})
    return ranked.where((F.col("k") >= F.col("need")) & (F.col("rank") <= F.col("k") - F.col("need") + 1)).select("key", "id", "n")


def _across(lists: DataFrame, clusters: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a list that are in different clusters and whose sketches let them be linked.

    Lists within one cluster make none, and in others the members of the largest cluster are compared with the rest only.
    The join's condition holds the sketches, so candidates that are not alike leave no rows.
    """
    own = lists.select("key", "id", "n").join(clusters.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("members", "component")).alias("most"), F.count(F.lit(1)).alias("clusters"), F.sum("members").alias("size")).where("clusters > 1")
    blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks")
    rows = written(own.join(mixed.select("key", F.col("most.component").alias("major"), blocks), "key").join(sets.select("id", "sketch"), "id"), "mixed")
    # A long list is cut into blocks of members; the rows that look for partners go to each block, so no task holds a whole list twice.
    left = rows.where("component <> major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.select(
        "key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"),
        F.col("sketch").alias("other_sketch"), (F.col("component") == F.col("major")).alias("of_major"),
    )
    met = left.join(
        right,
        (left["key"] == right["key"]) & (left["block"] == right["block"]) & (left["component"] != right["other"]) & (right["of_major"] | (left["id"] < right["b"]))
        & _may_link(left["sketch"], right["other_sketch"], left["n"], right["m"], num, den),
    )
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def linked_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text; other columns are ignored).

    A text's set holds its distinct k-word shingles (A-Z lower-cased, words parted by ASCII white space); a text of
    fewer words is one shingle, one without words has none and is linked with nothing. Sets are linked when
    den * |A and B| >= num * |A or B|. component_id is the smallest doc_id that links reach. Rows with a null doc_id
    keep their n_shingles, get a null component_id and link nothing; rows that share a doc_id stand for one document,
    whose links they share. Texts are compared by their bytes, which need not be UTF-8. Empty tables give empty results.

    Equal sets are merged first, so a group of copies is one set. In each list, sets are compared with a few hubs of the
    list before any others; pairs whose ends are in one component by then need no check, so a group of near copies makes
    a multiple of its size in pairs and not its square. All remaining pairs that share a list are checked exactly, after
    a lossless test of their sketches.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sized = written(_sized(docs, k), "sized")
    is_known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    known = sized.where(is_known)
    small = known.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()  # at most MAX_LIGHT rows
    light = boundary({r["n"]: r["sets"] for r in small}, num, den)
    reps = written(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "reps")
    hot_from = max(HOT_MEMBERS, -(-known.count() // BROADCAST_IDS))  # so there are at most BROADCAST_IDS hot groups
    copies = _with_groups(known, reps.where("members > 1"), hot_from, "inner").where("doc_id <> rep").select("doc_id", "set_hash").distinct()
    copies = written(copies, "copies")

    keyed = _keyed(docs, k, num, den, light).join(_few(copies), ["doc_id", "set_hash"], "left_anti")
    rows = keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "class", "need")
    lists = written(_shared_lists(rows), "lists")

    # Light sets: a shared subset of `size` shingles tells of a link; the smallest member is linked with all others that any member is.
    subsets = lists.where("class = -1").select("key", "id", "n")
    smallest = subsets.groupBy("key").agg(F.min(F.struct("n", "id")).alias("hub"))
    size = F.col("key").bitwiseAND(F.lit(63))
    light_pairs = written(
        subsets.join(smallest, "key")
        .where((F.col("id") != F.col("hub.id")) & (den * size >= num * (F.col("n") + F.col("hub.n") - size)))
        .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        .distinct(),
        "light",
    )

    # Heavy sets.
    chosen = written(_selective(lists.where("class >= 0")), "chosen")
    picked = [F.min(F.struct(F.xxhash64("id", "key", F.lit(i)).alias("order"), "n", "id")).alias(f"hub{i}") for i in range(EXTRA_HUBS)]
    hubs = chosen.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("n", "id")).alias("lo"), *picked).where("members > 1")
    near = lambda n, m: (num * F.greatest(n, m) <= den * F.least(n, m))
    heavy = written(chosen.join(hubs, "key").select("key", "id", "n", F.array("lo", *(F.struct(f"hub{i}.n", f"hub{i}.id") for i in range(EXTRA_HUBS))).alias("hubs")), "heavy")
    to_hubs = written(
        heavy.select("id", "n", F.explode(F.array_distinct("hubs")).alias("hub"))
        .where((F.col("id") != F.col("hub.id")) & near(F.col("n"), F.col("hub.n")))
        .groupBy("id", F.col("hub.id").alias("hub"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .withColumn("best", F.max(F.struct("shared", "hub")).over(Window.partitionBy("id")))  # as many rows as the set has hubs
        .select("id", "hub", (F.col("hub") == F.col("best.hub")).alias("first")),
        "to_hubs",
    )
    ends = heavy.select("id").unionByName(light_pairs.select(F.explode(F.array("a", "b")).alias("id")))
    sets = _token_sets(docs, ends.distinct(), k)
    as_pair = (F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    # Rows of one doc_id with different sets are one document: an edge leads to each set that another document represents.
    several = written(known.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id"), "several")
    shared = known.join(_few(several), "doc_id", "left_semi").join(reps, "set_hash").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).distinct()
    edges = written(_checked(to_hubs.where("first").select(*as_pair).unionByName(light_pairs).distinct(), sets, num, den).unionByName(shared), "edges")
    clusters = written(connected(edges), "clusters")
    # The pairs with a first hub are checked by now.
    for pairs in (lambda: _apart(to_hubs.where("not first").select(*as_pair).distinct(), clusters, sets, num, den), lambda: _across(heavy, clusters, sets, num, den)):
        open_pairs = written(pairs(), "pairs")
        if open_pairs.isEmpty():
            continue
        more = written(_checked(open_pairs, sets, num, den), "edges")
        if not more.isEmpty():
            clusters = written(connected(clusters.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more)), "clusters")

    of_rep = clusters.select(F.col("node").alias("rep"), "component")
    groups = written(reps.join(of_rep, "rep", "left").select("set_hash", "members", F.coalesce("component", "rep").alias("component_id")), "groups")
    grouped = _with_groups(known, groups, hot_from, "inner").select("doc_id", "n", "component_id")
    others = sized.where(~F.coalesce(is_known, F.lit(False))).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(others).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_groups(rows: DataFrame, groups: DataFrame, hot_from: int, how: str) -> DataFrame:
    """rows joined with groups (set_hash, members and others) on set_hash; groups of hot_from members or more by broadcast.

    A group of a third of all rows would otherwise be one task's. All other groups have fewer than hot_from rows.
    """
    hot = F.broadcast(groups.where(F.col("members") >= hot_from))
    cold = rows.join(hot.select("set_hash"), "set_hash", "left_anti").join(groups.where(F.col("members") < hot_from), "set_hash", how)
    return rows.join(hot, "set_hash").unionByName(cold)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with their columns, that remain when one document of each component of near duplicates stays.

    The document with the component's smallest doc_id stays. Rows that share a doc_id are documents of their own if their
    texts differ (known by a number made of both), and one if they do not. Rows with a null doc_id stay.
    """
    node, place = fresh(docs, "node"), fresh(docs, "place")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("x"), F.max(hashed).alias("y"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", (F.col("x") != F.col("y")).alias("differ"))
    several = written(several, "several")
    repeated, named = not several.isEmpty(), docs.withColumn(node, F.col("doc_id").cast("long"))
    if repeated:
        differ = fresh(named, "differ")
        named = docs.join(_few(several.withColumnRenamed("differ", differ)), "doc_id", "left").withColumn(node, F.when(F.col(differ), F.xxhash64("doc_id", hashed)).otherwise(F.col("doc_id").cast("long"))).drop(differ)
    found = linked_components(named.select(F.col(node).alias("doc_id"), "text"), k, num, den)
    removed = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(node)).distinct(), "removed")
    kept = without(named, removed)
    if repeated:  # of rows with one doc_id and text, one stays
        of_one = kept.join(_few(several.select("doc_id")), "doc_id", "left_semi").select(*kept.columns)
        order = F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
        of_one = of_one.withColumn(place, F.row_number().over(Window.partitionBy(node).orderBy(order))).where(F.col(place) == 1)
        kept = kept.join(_few(several.select("doc_id")), "doc_id", "left_anti").select(*kept.columns).unionByName(of_one.select(*kept.columns))
    return kept.select(*docs.columns)
