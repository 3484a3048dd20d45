"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESULT = "query_id long, key long, n long, vec_id long, score long"


def _quantised(lists: pa.Array, scale: float) -> np.ndarray:
    """rows x dims of floor(scale * x); shorter vectors count as zero beyond their end.

    float64 holds the integers exactly while products stay under 2**53; beyond that the entries are Python ints.
    """
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def _best(qi, score, ids, k):
    """Indices of the k best (score descending, id ascending) of each query."""
    order = np.lexsort((ids, -score, qi))
    q = qi[order]
    starts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def branch_and_bound(cand_ids, cand, query_ids, query, k=20, dim_block=16, query_tile=256, cand_tile=4096, gather_below=0.1, cand_keys=None, query_keys=None):
    """(query index, candidate id, score) of each query's k best among the candidates with another key (default: the id).

    Candidates lie in vertical layout (dims x rows), the dimensions with the most mass first. After each block of dimensions a candidate stays only if its
    partial score plus the product of the remaining norms (Cauchy-Schwarz) can still reach the query's k-th best.
    While many pairs survive, blocks are dense products; once few do, survivors are compacted to pairs and gathered.
    """
    cand_keys, query_keys = (ids if keys is None else keys for ids, keys in ((cand_ids, cand_keys), (query_ids, query_keys)))
    dims = cand.shape[1]
    by_mass = np.argsort(-(cand**2).sum(axis=0) * (query**2).sum(axis=0), kind="stable")
    columns, query = np.ascontiguousarray(cand.T[by_mass]), query[:, by_mass]
    edges = [*range(0, dims, dim_block), dims] if dims else [0, 0]
    rest_c = np.stack([np.sqrt((columns[e:] ** 2).sum(axis=0)) for e in edges])
    rest_q = np.stack([np.sqrt((query[:, e:] ** 2).sum(axis=1)) for e in edges], axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q0 in range(0, len(query), query_tile):
        rows = query[q0 : q0 + query_tile]
        row_keys, row_rest = query_keys[q0 : q0 + query_tile], rest_q[q0 : q0 + query_tile]
        held_q, held_s, held_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        least = np.full(len(rows), -np.inf)
        c0, width = 0, max(4 * k, 256)
        while c0 < len(cand_ids):
            c1 = min(c0 + width, len(cand_ids))
            tile, keep = columns[:, c0:c1], np.arange(c0, c1)
            score, pairs = np.zeros((len(rows), c1 - c0)), None
            for b in range(len(edges) - 1):
                lo, hi, left = edges[b], edges[b + 1], b + 1
                if pairs is None:
                    score += rows[:, lo:hi] @ tile[lo:hi]
                    bound = score + row_rest[:, left, None] * rest_c[left, keep] * (1 + 1e-9) + 1e-6
                    alive = bound >= least[:, None]
                    share = alive.mean() if alive.size else 0.0
                    if share < gather_below or left == len(edges) - 1:
                        qi, ci = np.nonzero(alive)
                        pairs = (qi, ci, score[qi, ci])
                    elif not (seen := alive.any(axis=0)).all():
                        tile, keep, score = tile[:, seen], keep[seen], score[:, seen]
                else:
                    qi, ci, s = pairs
                    s = s + np.einsum("ij,ji->i", rows[qi, lo:hi], tile[lo:hi, ci])
                    alive = s + row_rest[qi, left] * rest_c[left, keep[ci]] * (1 + 1e-9) + 1e-6 >= least[qi]
                    pairs = (qi[alive], ci[alive], s[alive])
            qi, ci, s = pairs if pairs is not None else (*np.nonzero(score == 0), np.zeros(score.size))
            ids = cand_ids[keep[ci]]
            other = cand_keys[keep[ci]] != row_keys[qi]
            qi, s, ids = np.r_[held_q, qi[other]], np.r_[held_s, s[other]], np.r_[held_id, ids[other]]
            chosen = _best(qi, s, ids, k)
            held_q, held_s, held_id = qi[chosen], s[chosen], ids[chosen]
            full = np.bincount(held_q, minlength=len(rows)) >= k
            worst = np.full(len(rows), np.inf)
            np.minimum.at(worst, held_q, held_s)
            least = np.where(full, worst, -np.inf)
            c0, width = c1, min(width * 4, cand_tile)
        out.append((held_q + q0, held_id, held_s))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _exact_large(cand_ids, cand, query, k, cand_keys, query_keys):
    """The same for entries whose products pass 2**53: Python integers, held to the range of a long."""
    columns, found = [[int(x) for x in row] for row in cand], []
    for i, row in enumerate(query):
        row = [int(x) for x in row]
        held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        best = sorted((-held(sum(a * b for a, b in zip(row, c, strict=True))), int(j)) for c, j, key in zip(columns, cand_ids, cand_keys, strict=True) if key != query_keys[i])[:k]
        found += [(i, j, -s) for s, j in best]
    return tuple(np.array([f[n] for f in found], dtype=np.int64) for n in range(3))


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_block: int = 4096,
    cand_block: int = 8192,
    dim_block: int = 16,
    most_partitions: int = 20_000,
) -> DataFrame:
    """The k rows of vectors with the highest integer inner product with each row of queries.

    Returns query_id, rank (from 1), vec_id, score. Components become floor(scale * x). Ties go to the smaller id.
    Rows whose id or vector is null, or whose vector holds a null, NaN or infinity, take no part. Vectors of other
    lengths count as zero beyond their end. Rows that repeat an id are candidates each, and queries each: a query leaves
    out its own row only, so another row with its id stays. Scores beyond the range of a long are held to it; entries
    whose products pass 2**52 are multiplied as whole numbers of Python instead of in blocks. An empty table gives no
    rows. Other columns are not read.

    Equal rows (id and vector) meet in one with their number. Both sides are dealt into hashed blocks of bounded size; a
    task holds one block of queries and one of candidates at a time, so memory does not grow with the input and a common
    vector does not gather in one task. The blocks' k best merge in a ranked window that Spark prunes before its shuffle.
    """

    def valid(df):
        bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return picked.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad).select("id", F.col("vec").cast("array<float>") if dict(df.dtypes)[vec_col] == "array<float>" else "vec")

    def counted(df):
        """Distinct rows with how often they stand; key tells rows apart, those of one id too."""
        rows = valid(df).groupBy("id", "vec").agg(F.count("*").alias("n"))
        return rows.withColumn("key", F.xxhash64("id", "vec"))

    # of equal rows no more than k can be among a query's best, and one more is left out by the query that is one of them
    copies = F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(k)).cast("int")))
    cand = counted(vectors).select("id", "vec", "key", copies.alias("copy")).withColumn("key", F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy")))
    query = counted(queries)
    n_cand, n_query = vectors.count(), queries.count()
    cand_blocks, query_blocks = max(1, -(-n_cand // cand_block)), max(1, -(-n_query // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cand.select("id", "vec", "key", F.pmod(F.xxhash64("key"), F.lit(cand_blocks)).cast("int").alias("cb"), each(query_blocks).alias("qb"))
    right = query.select("id", "vec", "key", "n", each(cand_blocks).alias("cb"), F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(query_blocks)).cast("int").alias("qb"))

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        c_ids, c, c_keys = one["id"].to_numpy(), _quantised(one["vec"].combine_chunks(), scale), one["key"].to_numpy()
        q_ids, q, q_keys = two["id"].to_numpy(), _quantised(two["vec"].combine_chunks(), scale), two["key"].to_numpy()
        if not len(c_ids) or not len(q_ids):
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            dims = max(c.shape[1], q.shape[1])
            c, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (c, q))
            small = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * max(dims, 1) < 2**52
            found = branch_and_bound(c_ids, c, q_ids, q, k, dim_block, cand_keys=c_keys, query_keys=q_keys) if small else _exact_large(c_ids, c, q, k, c_keys, q_keys)
        at = found[0].astype(np.int64)
        return pa.table({"query_id": pa.array(q_ids[at], pa.int64()), "key": pa.array(q_keys[at], pa.int64()), "n": pa.array(two["n"].to_numpy()[at], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2].astype(np.int64))})

    n = min(cand_blocks * query_blocks, most_partitions)
    dealt = lambda df: df.repartition(n, "qb", "cb").groupBy("qb", "cb")
    found = dealt(left).cogroup(dealt(right)).applyInArrow(search, RESULT)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
