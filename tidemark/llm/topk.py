"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are rotated into the basis of the corpus's own SVD, which puts most of their length into the first few
coordinates, and dealt into blocks of descending length. For a query, a block is left out once |query| * |longest of the
block| is below its k-th best score so far. Within a block, the inner product over the first coordinates plus
|rest of query| * |rest of vector| bounds the score; only vectors whose bound reaches the k-th best are scored, in
integers. Bounds are computed in floating point with a margin above its error, so the result is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096  # vectors of one block
QUERY_BLOCK = 512  # queries that meet a block at once
LEADING = 0.25  # share of the coordinates in the first partial sum


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector is there and wholly finite, with components floor(256 * x) as whole numbers."""
    v = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and id is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return good.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("z")).withColumn("norm", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of z zT: each task sends width * width numbers, and Spark adds those up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = matrix(batch.column(0), width)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.select("z").mapInArrow(add, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((width, width))
    for i, j, x in rows:
        out[i, j] = x
    return out


def matrix(lists, width: int) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros."""
    out = np.zeros((len(lists), width))
    rows = lists.to_pylist() if hasattr(lists, "to_pylist") else lists
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, floor_of: np.ndarray, z: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For each query the k best (query, vector, score) of a block that reach floor_of, ties to the smaller vector id."""
    lead = max(1, int(np.ceil(rotation.shape[1] * LEADING)))
    rq, rz = queries @ rotation, z @ rotation
    rest_q, rest_z = np.linalg.norm(rq[:, lead:], axis=1), np.linalg.norm(rz[:, lead:], axis=1)
    length_q, length_z = np.linalg.norm(queries, axis=1), np.linalg.norm(z, axis=1)
    slack = 1e-9 * length_q * (length_z.max() if len(length_z) else 0) + 1e-6
    bound = rq[:, :lead] @ rz[:, :lead].T + rest_q[:, None] * rest_z[None, :] + slack[:, None]
    whole_q, whole_z = queries.astype(np.int64), z.astype(np.int64)
    out = []
    for i in range(len(queries)):
        if length_q[i] * length_z.max(initial=0.0) + slack[i] < floor_of[i]:
            continue  # the longest vector of the block cannot reach
        left = np.flatnonzero((bound[i] >= floor_of[i]) & (ids != query_ids[i]))
        if not len(left):
            continue
        left = left[np.argsort(-bound[i, left], kind="stable")]
        found_score, found_id, least = np.zeros(0, np.int64), np.zeros(0, np.int64), floor_of[i]
        for start in range(0, len(left), 256):
            some = left[start : start + 256]
            if bound[i, some[0]] < least:
                break  # bounds fall from here on
            found_score = np.concatenate((found_score, whole_z[some] @ whole_q[i]))
            found_id = np.concatenate((found_id, ids[some]))
            order = np.lexsort((found_id, -found_score))[:k]
            found_score, found_id = found_score[order], found_id[order]
            if len(order) == k:
                least = max(least, float(found_score[-1]))
        out += [(int(query_ids[i]), int(v), int(s)) for v, s in zip(found_id, found_score, strict=True) if s >= floor_of[i]]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best inner products of every query row against all other rows: query_id, rank, vec_id, score.

    is_query: a Column over id_col. Queries and vectors meet block by block; each query takes its bound from the block
    of the longest vectors first, then meets the others with it. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; shorter vectors count as padded with zeros; an id's own rows are no candidates; repeated
    rows of another id are candidates each, and a query id asks once, with the first of its vectors in order. Components from
    2**53 or lengths from 2**31 on, whose inner products may not fit a long, are refused. Fewer than k candidates give fewer rows. Other columns do not matter."""
    everything = written(usable(vectors, id_col, vec_col).withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    about = everything.agg(F.max(F.size("z")).alias("width"), F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("queries"), F.max("norm").alias("longest")).first()
    if (about["longest"] or 0.0) ** 2 >= 2.0**62:
        raise OverflowError("inner products of these vectors do not fit a long")
    width = max(about["width"] or 0, 1)
    _, turn = np.linalg.eigh(gram(everything, width))
    rotation = np.ascontiguousarray(turn[:, ::-1])
    blocks, query_blocks = -(-about["n"] // BLOCK) or 1, -(-(about["queries"] or 0) // QUERY_BLOCK) or 1
    edges = everything.approxQuantile("norm", [i / blocks for i in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    # rows of equal length are dealt over neighbouring blocks, so that one length with many rows stays in blocks of bounded size
    level = F.lit(len(edges)) - F.size(F.filter(F.array(*[F.lit(e) for e in sorted(edges)]) if edges else F.array().cast("array<double>"), lambda e: e < F.col("norm")))
    dealt = everything.withColumn("level", level)
    sizes = dict(dealt.groupBy("level").count().collect())
    parts = F.lit(1)
    for lv, n in sorted(sizes.items()):
        if n > 2 * BLOCK:
            parts = F.when(F.col("level") == lv, F.lit(-(-n // BLOCK))).otherwise(parts)
    dealt = dealt.withColumn("block", F.struct("level", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts).alias("part")))
    dealt = written(dealt.select("id", "z", "q", F.col("block.level").alias("level"), F.col("block.part").alias("part")), "blocks")
    asked = dealt.where("q").select(F.col("id").alias("query_id"), "z", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("long").alias("query_block"))
    asked = asked.groupBy("query_id", "query_block").agg(F.min("z").alias("z"))
    asked = written(asked, "queries")

    def meet(with_floor: DataFrame, candidates: DataFrame) -> DataFrame:
        places = [(int(lv), int(p)) for lv, p in candidates.select("level", "part").distinct().collect()]  # blocks, not rows
        if not places:
            return candidates.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
        spread = with_floor.withColumn("place", F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(p).cast("long").alias("part")) for lv, p in places])))
        left = spread.select("query_id", "z", "least", "query_block", F.col("place.level").alias("level"), F.col("place.part").alias("part"))
        right = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))).select("id", "z", "query_block", "level", "part")

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(b):
                found = top_of_block(matrix(list(a["z"]), width), a["query_id"].to_numpy(), a["least"].to_numpy(), matrix(list(b["z"]), width), b["id"].to_numpy(), rotation, k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        keys = ["query_block", "level", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")

    first = min(sizes, default=0)
    top = written(meet(asked.withColumn("least", F.lit(float("-inf"))), dealt.where(F.col("level") == first)), "longest")
    ranked = lambda df: df.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    floors = ranked(top).where(F.size("best") == k).select("query_id", (-F.element_at("best", -1)["s"]).cast("double").alias("least"))
    known = asked.join(floors, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = meet(known, dealt.where(F.col("level") != first))
    best = ranked(top.unionByName(rest)).select("query_id", F.posexplode("best").alias("rank", "b"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
