"""Helpers shared by the corpus operators: words and shingles as arrays, the shared folder, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import importable, scratch

U64 = np.uint64
_P1, _P2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query at its end, not only when the driver collects its plan.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing. The shuffle files go at once."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def split_coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+ of a batch, the words of all texts end to end as places among them, and the n + 1 offsets of the texts.

    Null and empty texts have no words. An empty word may be among the distinct ones, but no text has it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy()
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends = ends.astype(np.int64) - int(ends[0])
    index = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # the split leaves an empty word before or after white space at a text's ends
        keep = index != empty
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        index = index[keep]
    return coded.dictionary, index, ends


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """split_coded with the distinct words as a list."""
    names, index, ends = split_coded(texts)
    return names.to_pylist(), index, ends


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and the n + 1 offsets of the texts; each distinct word is hashed once.

    lower: with A-Z as a-z."""
    names, index, ends = split_words(texts)
    data = (n.encode().lower() for n in names) if lower else names
    return np.fromiter(map(xxhash.xxh3_64_intdigest, data), U64, len(names))[index] if names else np.zeros(0, U64), ends


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of k words that start at each place with k words from there on, across texts as they lie."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor = (_P1 if not salt else _P2) | U64(1)
    total = np.zeros(n, U64)
    for j in range(k):
        total = total * factor + words[j : j + n]
    return mix(total ^ U64(salt))


def inside(ends: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first n places start a run of k words that stays in one text."""
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):
        at = ends[1:] - j  # too near the end of a text
        ok[at[(at >= ends[:-1]) & (at < n)]] = False
    return ok


def rows_of(ends: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: columns node and component, the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes; minima are combined before the shuffle, so a
    node with a large share of all edges costs one row for each task. Each round is written to the shared folder."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.where("u > v").distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    found = now.groupBy("u").agg(F.min("v").alias("v"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(found.select(F.col("v"), F.col("v")).distinct())


def bounded_sample(rows: DataFrame, by: str, most: int, id_col: str) -> DataFrame:
    """At most `most` rows of each value of `by`, those with the smallest hash of their id: the same rows whatever the partitions.

    Only about twice as many rows as asked for are sorted. The values of `by` are classes or languages, few by nature."""
    counts = {v: n for v, n in rows.groupBy(by).count().collect() if v is not None}
    place = F.xxhash64(F.col(id_col).cast("string"))
    share = F.lit(None).cast("long")
    for v, n in counts.items():
        share = F.when(F.col(by) == F.lit(v), F.lit(min(1 << 30, (most * 2 + 64 << 30) // max(n, 1)))).otherwise(share)
    some = rows.where(F.pmod(place, F.lit(1 << 30)) < share)
    order = Window.partitionBy(by).orderBy(place, F.col(id_col), *[c for c in rows.columns if c not in (by, id_col)])
    return some.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)


def bucket_members(placed: DataFrame) -> DataFrame:
    """Of rows (band, id) those that share their band, with the band's first id, the id before, and the place."""
    bucket = Window.partitionBy("band").orderBy("id")
    seen = placed.select("band", "id").withColumns({"first": F.min("id").over(bucket), "before": F.lag("id").over(bucket), "after": F.lead("id").over(bucket), "place": F.row_number().over(bucket)})
    return seen.where("before is not null or after is not null").select("band", "id", "first", "before", "place")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the first one and with the one before it: a number of pairs in proportion to the members."""
    return shared.where("before is not null").select(F.explode(F.array_distinct(F.array("first", "before"))).alias("a"), F.col("id").alias("b")).distinct()


def mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, id) of the buckets that hold several components, with the member's component. Up to three members have all been paired."""
    split = shared.join(found.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = split.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 3").select("band")
    return split.join(mixed, "band").select("band", "id", "component")


def slices(batch: pa.RecordBatch, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and bytes, or of one row."""
    weights = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            weights += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(weights)))
    start = 0
    while start < batch.num_rows:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(before, before[start] + size, side="right")) - 1))
        yield batch.slice(start, stop - start)
        start = stop
