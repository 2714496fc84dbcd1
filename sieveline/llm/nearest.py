"""Approximate nearest neighbours: inverted lists whose candidates are abandoned early by partial distances.

Vectors are rotated at random, so that the first columns of a difference estimate its whole length. Within each probed
list, columns are read block by block, and after each block a hypothesis test drops the candidates whose partial distance
shows that they are farther than the k-th best. What survives is measured exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rows of a list, and queries, that one task call holds at most (about).
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2000
#: Strength of the test (larger: fewer false drops) and columns read between tests.
EPSILON, COLUMNS = 2.1, 16


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part.

    Left out: null ids, null vectors, vectors of zeros, with null or non-finite components, or of another length than most
    have (ties: the longer). Of rows that share an id, one stays: the one with the smallest vector.
    """
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    return fine.where(F.size("vector") == d).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def fit(vectors: DataFrame, sample_rows: int = 20_000, max_lists: int = 2048, recall: float = 0.97, k: int = 10, seed: int = 7) -> Index:
    """Centroids and number of probes, from a bounded sample: the sample_rows rows whose ids have the smallest hashes.

    There are about sqrt(rows) lists. Probes are the fewest, of the sample's lists, with which the sample's own queries
    find the asked share of their k nearest. Every row is indexed later, whatever the sample.
    """
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()  # at most sample_rows rows
    rng = np.random.default_rng(seed)
    if not rows:
        return Index(np.zeros((1, 1)), np.eye(1), 1)
    x = np.array([r["vector"] for r in rows])
    d = x.shape[1]
    rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
    c = _centroids(x, max(1, min(max_lists, round(n**0.5))), rng)
    near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
    asked = np.unique(x[rng.choice(len(x), min(300, len(x)), replace=False)], axis=0)
    # Rank of each true neighbour's list among the query's lists.
    ranks = []
    order = np.argsort(np.argsort(_distances(asked, c), axis=1), axis=1)
    for q, rank in zip(asked, order, strict=True):
        best = np.argsort(((x - q) ** 2).sum(1), kind="stable")[: k + 1]
        ranks.append(rank[near[best]])
    probes = int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1
    return Index(c, rotation, min(len(c), ceil(1.1 * probes)))


def _scan(query: np.ndarray, rotated: np.ndarray, columns: np.ndarray, originals: np.ndarray, ids: np.ndarray, own: int, k: int, limit: float) -> list[tuple[float, int]]:
    """The k best of a block for one query. columns: candidates by column; limit: a distance known to hold k others."""
    n, d = originals.shape
    alive = np.nonzero(ids != own)[0]
    exact = lambda at: np.sqrt(((originals[at] - query) ** 2).sum(axis=1))
    best: list[tuple[float, int]] = []
    bar = limit
    if not np.isfinite(bar) and len(alive) > 4 * k:
        head, alive = alive[: 4 * k], alive[4 * k :]
        best = sorted(zip(exact(head).tolist(), ids[head].tolist(), strict=True))[:k]
        bar = best[-1][0]
    if np.isfinite(bar):
        partial = np.zeros(len(alive))
        for start in range(0, d, COLUMNS):
            stop = min(d, start + COLUMNS)
            part = columns[start:stop, alive] if len(alive) < n else columns[start:stop]
            partial = partial + ((part - rotated[start:stop, None]) ** 2).sum(axis=0)
            if stop < d:
                keep = partial <= (1 + EPSILON / stop**0.5) ** 2 * stop / d * bar * bar + 1e-9
            else:
                keep = partial <= bar * bar * (1 + 1e-9) + 1e-9
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
    if len(alive):
        best += zip(exact(alive).tolist(), ids[alive].tolist(), strict=True)
    return sorted(best)[:k]


def _probe(blocks: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """Best candidates of each query in each of its blocks: query_id, vec_id, score."""

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            block = block.sort_values("vec_id")
            ids = block["vec_id"].to_numpy()
            originals = np.array(block["vector"].tolist())
            columns = np.ascontiguousarray((originals @ index.rotation).T)
            for q, vector, limit in zip(queries["query_id"], queries["vector"], queries["limit"], strict=True):
                vector = np.array(vector)
                out += [(q, i, s) for s, i in _scan(vector, vector @ index.rotation, columns, originals, ids, q, k, limit)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ("list", "block", "share")
    return blocks.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 10, index: Index | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found of each query.

    vectors: vec_id, embedding; is_query: a condition on vec_id. A query's own id is no candidate; ties go to the
    smaller vec_id; fewer candidates than k are all found, if the lists that hold them are probed. Rows that take part
    are those of valid_vectors(); an empty table gives no rows. Every row is in a list; a list of many rows (copies,
    say) is cut into blocks of bounded size, and so are the queries that probe it.
    """
    rows = written(valid_vectors(vectors), "vectors")
    index = index or fit(rows, k=k)
    lists = len(index.centroids)

    def assign(batches):
        for b in batches:
            x = np.array(b["vector"].tolist()).reshape(len(b), -1)
            near = _distances(x, index.centroids).argmin(1) if len(b) else []
            yield b.assign(list=near)

    def ranked(batches):
        for b in batches:
            x = np.array(b["vector"].tolist()).reshape(len(b), -1)
            if len(b):
                d = _distances(x, index.centroids)
                order = np.argsort(d, axis=1, kind="stable")[:, : index.probes]
                yield pd.DataFrame({"query_id": b["vec_id"], "vector": b["vector"], "lists": list(order.astype(np.int32))})

    placed = written(rows.mapInPandas(assign, "vec_id long, vector array<double>, list int"), "placed")
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a list
    queries = written(rows.where(is_query).mapInPandas(ranked, "query_id long, vector array<double>, lists array<int>"), "queries")
    shares = max(1, ceil(queries.count() * index.probes / lists / BLOCK_QUERIES))
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(i, max(1, ceil(n / BLOCK_ROWS))) for i, n in counts.items()] or [(0, 1)], "list int, blocks int")
    sized = F.broadcast(sizes)  # one row a list
    blocks = (
        placed.join(sized, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("list", "block", "share", "vec_id", "vector")
    )

    def asked(of: DataFrame, nearest: bool) -> DataFrame:
        probed = F.slice("lists", 1, 1) if nearest else F.slice("lists", 2, lists)
        return (
            of.select("query_id", "vector", "limit", F.explode(probed).alias("list")).join(sized, "list")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
        )

    infinite = F.lit(float("inf"))
    first = written(_top(_probe(blocks, asked(queries.withColumn("limit", infinite), True), index, k), k), "first")
    limits = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("limit"))
    rest = _probe(blocks, asked(queries.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", infinite)), False), index, k)
    return _top(first.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
