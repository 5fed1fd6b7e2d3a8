"""Exact top-k inner products by elimination with a table of pivots.

Vectors become whole numbers, so scores are exact. For whole vectors 2 x.y = |x|^2 + |y|^2 - |x - y|^2, and the triangle
inequality bounds |x - y| from below by the difference of their distances to any pivot. The table of distances to PIVOTS
vectors is worked out once per row; the largest difference over all pivots is the best bound. Each query then takes its
candidates in the order of their bounds and stops as soon as no bound can reach its k-th score.

Work is a grid: blocks of queries against blocks of candidates, every row of one in every block of the other, so no group
is larger than two blocks whatever the vectors are. Pivots are a bounded sample, spread by farthest-first choice; they
only steer the work, never the result.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null id
as queries or candidates; vectors of another length than the most common one take no part; ties go to the smaller id;
repeated rows of one id are one candidate each, never of their own query; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.llm.work import settle

PIVOTS, SAMPLE = 32, 2048
CANDIDATES, QUERIES = 2048, 4096
SCALE = 256


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times `scale` rounded down; only rows that take part."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    good = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(F.forall(x, finite))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return good.select("vec_id", v.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    chosen = [int(np.argmax(np.linalg.norm(sample - sample.mean(0), axis=1)))]
    near = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def best(
    ids: np.ndarray, x: np.ndarray, table: np.ndarray, query_id: int, q: np.ndarray, to_pivots: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (id, score) of one query among candidates, eliminating by bounds; table: distances to the pivots."""
    apart = np.abs(table - to_pivots).max(1)
    # a little slack, as distances are rounded: a bound is never below the score
    bound = (table_norms(x) + float(q @ q) - apart**2) / 2
    bound += 1e-9 * (np.abs(bound) + table_norms(x)) + 1e-6
    bound[ids == query_id] = -np.inf
    alive = np.flatnonzero(bound > -np.inf)
    kept_id, kept_score = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(4 * k, 64)
    while len(alive):
        if len(alive) > step:
            cut = np.argpartition(-bound[alive], step)
            now, alive = alive[cut[:step]], alive[cut[step:]]
        else:
            now, alive = alive, alive[:0]
        kept_id = np.concatenate([kept_id, ids[now]])
        kept_score = np.concatenate([kept_score, x[now] @ q])
        order = np.lexsort((kept_id, -kept_score))[:k]
        kept_id, kept_score = kept_id[order], kept_score[order]
        if len(kept_id) == k:
            alive = alive[bound[alive] >= kept_score[-1]]  # equal scores may still win by a smaller id
        step *= 2
    return kept_id, kept_score


def table_norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x).astype(float)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query; `is_query` tells the rows that ask."""
    vectors = settle(whole_vectors(rows, scale), "vectors")
    sizes = vectors.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
    vectors = vectors.where(F.size("v") == common["size"])
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(np.array([r.v for r in drawn], float), PIVOTS)
    asked = vectors.where(is_query)
    parts = -(-common["n"] // CANDIDATES)
    query_parts = max(1, -(-asked.count() // QUERIES))

    def dealt(frame: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(own_parts)).cast("int").alias(own)
        return frame.select("vec_id", "v", place, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))).alias(other))

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            x, asks = np.stack(candidates["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            ids = candidates["vec_id"].to_numpy()
            far = lambda m: np.sqrt(np.maximum(0.0, [((m - p) ** 2).sum(1) for p in pivots])).T
            table, query_table = far(x), far(asks)
            for n, query_id in enumerate(queries["vec_id"]):
                found, score = best(ids, x, table, query_id, asks[n], query_table[n], k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    grid = ["part", "query_part"]
    found = (
        dealt(asked, "query_part", query_parts, "part", parts).groupBy(*grid)
        .cogroup(dealt(vectors, "part", parts, "query_part", query_parts).groupBy(*grid))
        .applyInPandas(search, "query_id BIGINT, vec_id BIGINT, score BIGINT")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
