"""Exact top-k search by integer inner product, as products of tiles.

Queries and candidates are cut into blocks of bounded size. Each pair of blocks is one matrix product in one task, which keeps its k best
candidates a query; the short lists of a query are then merged as a tree, so no list ever grows with the number of tiles.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part, nor do rows with a null id. Only vectors
of equal length are compared. Rows that bear the query's id are its own and no candidates; repeated candidates are ranked one by one;
a query id with several rows has one list for each length of vector, the best over these rows. Ties go to the smaller id. Scores beyond a long are cut to its range after an exact comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates and queries in a tile, queries multiplied at once, and lists merged in one step of the tree.
TILE, QUERIES, ROWS, FAN_IN = 8192, 2048, 256, 16


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component x, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in doubles as far as these are exact, else in whole numbers of any size."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The place of each query with the ids and scores of its k best candidates; ids must be sorted."""
    behind = np.arange(len(ids))
    for start in range(0, len(queries), ROWS):
        scores = products(queries[start:start + ROWS], vectors)
        for i, row in enumerate(scores, start):
            others = behind[ids != query_ids[i]]
            row = row[others]
            if len(row) > k and row.dtype != object:
                # all that reach the k-th score, then by score and id
                bar = np.partition(row, len(row) - k)[len(row) - k]
                reach = np.flatnonzero(row >= bar)
                others, row = others[reach], row[reach]
            order = sorted(range(len(row)), key=lambda j: (-row[j], others[j]))[:k] if row.dtype == object else np.argsort(-row, kind="stable")[:k]
            for j in order:
                yield i, int(ids[others[j]]), min(max(int(row[j]), -2**63), 2**63 - 1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query, out of all other rows of vectors (vec_id, embedding)."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", whole_numbers(F.col("embedding")).alias("vec"))
    # under names of their own: the two sides come from the same rows
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).dropDuplicates()
    n, m = rows.count(), queries.count()
    tiles, blocks = max(1, math.ceil(n / TILE)), max(1, math.ceil(m / QUERIES))
    number = F.monotonically_increasing_id()
    by_query = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))
    by_row = rows.withColumn("tile", F.pmod(number, F.lit(tiles))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def tile(key: tuple[int, int], q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if q.empty or c.empty:
            return pd.DataFrame(found, columns=["query_id", "size", "vec_id", "score", "tile"])
        c = c.sort_values("vec_id", kind="stable")
        q_size, c_size = q["query"].map(len), c["vec"].map(len)
        for size in sorted(set(q_size) & set(c_size)):
            a, b = q[q_size == size], c[c_size == size]
            left, right = (np.stack([np.asarray(v, np.int64) for v in x]).reshape(len(x), size) for x in (a["query"], b["vec"]))
            ids = a["query_id"].to_numpy()
            found += [(int(ids[i]), size, vec_id, score, key[0]) for i, vec_id, score in best(ids, left, b["vec_id"].to_numpy(), right, k)]
        return pd.DataFrame(found, columns=["query_id", "size", "vec_id", "score", "tile"])

    schema = "query_id long, size int, vec_id long, score long, tile long"
    lists = by_query.groupBy("tile", "block").cogroup(by_row.groupBy("tile", "block")).applyInPandas(tile, schema)
    by = ["query_id", "size", "tile"]
    while True:
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN))
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        tiles = math.ceil(tiles / FAN_IN)
        if tiles <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
