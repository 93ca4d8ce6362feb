"""Near-duplicate documents by SetSketch registers.

A register holds floor(1 - log_b(min)) of exponentially distributed values, one for each shingle of a document, cut to
its range. Registers of a union are the larger ones of each, so sketches merge; two documents agree in a register about
as often as their shingle sets overlap. Bands of registers give candidate pairs, the joint likelihood of larger, smaller
and equal registers (with the known set sizes) estimates their overlap, and pairs that may reach the threshold are
confirmed on their full shingle sets. Documents linked by a chain of confirmed pairs form a component.

A document is known by its id and a hash of its text, key, so that an id with several texts loses none of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bucket_members, components, inside, mix, mixed_buckets, rows_of, signed, slices, star_pairs, window_hashes, word_hashes, written

REGISTERS, ROWS = 128, 4  # 32 bands of 4: a pair of overlap 0.8 shares none with probability 5e-8
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2  # b, a and q of the sketch: registers fit 16 bits, and chance agreement is rare
KEY = "struct<id:bigint,v:int>"
MARGIN = 0.23  # pairs below threshold - MARGIN are not compared; at 0.8 the estimate is that low with a probability of 1e-9
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1, REGISTERS + 1, dtype=U64) + U64(1 << 32))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as hashes in ascending order, end to end, and the n + 1 offsets.

    A text with fewer words has one shingle, all of them; a text without words has none."""
    words, ends = word_hashes(texts, lower=True)
    runs = window_hashes(words, k)
    ok = inside(ends, k, len(runs))
    at = rows_of(ends)
    short = np.flatnonzero((np.diff(ends) > 0) & (np.diff(ends) < k))
    few = [int(mix(U64([hash_few(words[ends[i] : ends[i + 1]])]))[0]) for i in short]
    values = np.concatenate((runs[ok], np.array(few, U64)))
    rows = np.concatenate((at[: len(runs)][ok], short))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(ends)))


def hash_few(words: np.ndarray) -> int:
    """Of fewer words than a shingle has; their number counts."""
    total = len(words)
    for w in words.tolist():
        total = (total * 0x9E3779B97F4A7C15 + w) % 2**64
    return total


def registers(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers of each set, one row each; zeros for an empty set."""
    out = np.zeros((len(ends) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return out
    starts = ends[:-1][full]
    spread = values ^ (values >> U64(29))
    for i in range(REGISTERS):
        least = np.minimum.reduceat((spread * _ODD[i] + _ADD[i]), starts)
        exp = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE  # the smallest of the exponential values
        out[full, i] = np.clip(np.floor(1 - np.log(exp) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def sketches(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_shingles, digest (of the whole set) and registers of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2000):
                values, ends = shingle_sets(part.column(1), k)
                made = registers(values, ends)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.binary()), pa.array([r.astype(">u2").tobytes() for r in made], pa.binary())], names=["key", "n_shingles", "digest", "registers"])

    return keyed(docs, id_col, text_col).mapInArrow(sketch, f"key {KEY}, n_shingles long, digest binary, registers binary")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("v")).alias("key"), text.alias("text"))


def likely_overlap(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of pairs, from their registers and set sizes."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.clip(x, 1e-300, 1))
        return larger * log(up) + smaller * log(down) + (REGISTERS - larger - smaller) * log(1 - up - down)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _likely(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs a, b whose sizes allow the threshold (in hundredths) and whose estimate may reach it; with the estimate."""
    one = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r_a, r_b = (np.frombuffer(b"".join(c.to_pylist()), ">u2").reshape(-1, REGISTERS) for c in (batch.column(4), batch.column(5)))
                guess = likely_overlap(r_a, r_b, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                keep = pa.array(guess >= threshold / 100 - MARGIN)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess)], names=["a", "b", "guess"]).filter(keep)

    joined = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, f"a {KEY}, b {KEY}, guess double")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold (in hundredths)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                (x, i), (y, j) = (shingle_sets(part.column(c), k) for c in (2, 3))
                keep = []
                for r in range(part.num_rows):
                    s, t = x[i[r] : i[r + 1]], y[j[r] : j[r + 1]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= threshold * (len(s) + len(t) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return with_a.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {KEY}, b {KEY}")


def apart_pairs(members: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """All pairs a, b of members (id, component) in different components that may reach the threshold, by the prefix filter of exact set joins.

    With a document's shingles in the order of how many members hold them, a pair of overlap t shares one of the first
    n - ceil(t * n) + 1 of each, and what lies behind the first that they share bounds the intersection. A document that
    has too many shingles of its own has none to join on, so a crowded bucket gives pairs only where they can be near."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1000):
                values, ends = shingle_sets(part.column(2), k)
                at = pa.array(rows_of(ends))
                sizes = pa.array(np.repeat(np.diff(ends), np.diff(ends)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), sizes, pa.array(signed(values))], names=["id", "component", "n", "shingle"])

    sets = texts.join(members.groupBy("id").agg(F.first("component").alias("component")), "id").select("id", "component", "text")
    sets = written(sets.mapInArrow(explode, f"id {KEY}, component {KEY}, n long, shingle long"), "sets")
    # only what members of other components hold too can link them
    held = sets.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle", "held")
    own = Window.partitionBy("id")
    ranked = sets.join(held, "shingle").withColumns({"of": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("held", "shingle"))})
    first = ranked.withColumn("left", F.col("of") - F.col("rank") + 1).where(F.col("left") * 100 >= threshold * F.col("n"))  # shingles from this one on
    first = written(first.select("id", "component", "n", "shingle", "left"), "prefixes")
    # of each shingle the component with most members is on one side alone: its members never meet each other
    counts = first.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    sides = counts.groupBy("shingle").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    one, two = (first.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "left")]) for x in "ab")
    one = one.join(sides.select("shingle", "largest"), "shingle").where("component_a <> largest").drop("largest")
    fits = (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    enough = (100 + threshold) * F.least("left_a", "left_b") >= threshold * (F.col("n_a") + F.col("n_b"))
    met = one.join(two, (one["shingle"] == two["shingle"]) & fits & enough)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= threshold * union of their k-word shingle sets.

    One row for each input row: id_col, n_shingles, component_id (the smallest id reachable) and kept (whether that is
    its own id). Equal sets are one class, told by a 128-bit digest, and only their smallest member is sketched further.
    In a bucket every member is paired with the smallest and with its neighbour; once those links are known, members of
    buckets that still hold several components are compared by an exact set join, so no bucket is expanded into all of
    its pairs and none loses a link. Documents without words are linked with nothing. Equal rows of an id count as one
    document; of an id with several texts each text has its links, and the id joins them all. A null id is linked with
    nothing and kept. Other columns do not matter."""
    rows = written(sketches(docs, k, id_col, text_col), "sketches")
    sets = rows.where("n_shingles > 0 and key.id is not null")
    classes = written(sets.groupBy("digest", "n_shingles").agg(F.min("key").alias("rep"), F.first("registers").alias("registers")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n_shingles", "registers")
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    shared = written(bucket_members(reps.select("id", bands.alias("i", "band"))), "buckets")
    likely = written(_likely(star_pairs(shared), reps, threshold), "likely")
    texts = keyed(docs, id_col, text_col).withColumnRenamed("key", "id").join(shared.select("id").distinct(), "id", "left_semi")
    texts = written(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")

    def links_of(candidates: DataFrame, before: DataFrame | None, best_only: bool) -> DataFrame:
        """Confirm candidates, or for each document only the likeliest one; candidates already in one component are not looked at."""
        if before is not None:
            of = before.select(F.col("node"), "component")
            candidates = candidates.join(of.withColumnsRenamed({"node": "a", "component": "c_a"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "component": "c_b"}), "b", "left")
            candidates = candidates.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
        if best_only:
            candidates = candidates.groupBy("b").agg(F.max_by("a", F.struct("guess", -F.col("a.id"))).alias("a"))
        return _confirmed(candidates, texts, k, threshold)

    # an id with several texts joins their classes
    several = sets.groupBy("key.id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    of_id = sets.join(several, F.col("key.id") == several["id"]).select("id", "digest", "n_shingles").join(classes.select("digest", "n_shingles", "rep"), ["digest", "n_shingles"])
    same = of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("least")), "id").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b")

    links = written(links_of(likely, None, True).unionByName(same), "links")
    found = written(components(links), "components")
    more = written(links_of(likely, found, False), "links")
    links = links.unionByName(more)
    if not more.isEmpty():
        found = written(components(links), "components")
    last = written(_confirmed(apart_pairs(mixed_buckets(shared, found), texts, k, threshold), texts, k, threshold), "links")
    if not last.isEmpty():
        found = written(components(links.unionByName(last)), "components")
    # a class reaches what its representative reaches
    of_class = classes.select("digest", F.col("n_shingles").alias("_n"), "rep").join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select("digest", "_n", F.coalesce("component", "rep")["id"].alias("_component"))
    out = rows.join(of_class, (rows["digest"] == of_class["digest"]) & (rows["n_shingles"] == of_class["_n"]), "left").select(F.col("key.id").alias("id"), "n_shingles", F.when(F.col("key.id").isNotNull(), F.coalesce("_component", "key.id")).alias("component_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
