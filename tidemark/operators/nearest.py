"""The nearest known code of each unknown one, by edit distance, without comparing all with all.

Known codes are their own nearest. Two codes within two edits share a key among what up to two deletions leave of each, so
they meet in an equi-join and the distance is verified. Codes that have nothing that near are dealt out in blocks: each
block meets each block of the known codes in a task, where the beginnings that codes share are compared once for the whole
block, and are left as soon as nothing that begins so can be nearer than what is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import importable, stored

EDITS = 2
FAR, KNOWN = 4096, 65536  # codes of a block, at most and about


def _without(code: Column, at: Column) -> Column:
    """code without the character at a place, from 1."""
    return F.concat(F.substring(code, F.lit(1), at - 1), F.substring(code, at + 1, F.length(code)))


def deletions(code: Column) -> Column:
    """What is left of a code after up to two deletions, each once."""
    places = lambda c: F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    once = lambda c: F.transform(places(c), lambda i: _without(c, i))
    one = F.array_distinct(once(code))
    return F.array_distinct(F.concat(F.array(code), one, F.flatten(F.transform(one, once))))


def _better(pairs: DataFrame) -> DataFrame:
    """The nearest code of each, of equally near ones the first in order."""
    best = F.min(F.struct("distance", "code"))
    return pairs.groupBy("unknown").agg(best.alias("m")).select("unknown", F.col("m.code").alias("code"), F.col("m.distance").alias("distance"))


def _beginnings(codes: list[str]) -> Iterator[tuple[int, str, int]]:
    """Each beginning of sorted distinct codes once, before those that go on from it: its length, its last character and the place of the code that it is, or -1."""
    before = ""
    for at, code in enumerate(codes):
        same = next((i for i, (x, y) in enumerate(zip(before, code)) if x != y), min(len(before), len(code)))
        for i in range(same, len(code)):
            yield i + 1, code[i], at if i + 1 == len(code) else -1
        before = code


def nearest_in(unknown: list[str], codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest of sorted distinct codes for each unknown one, of equally near ones the first, and the distance.

    A row of the edit distance table is kept for each length of the beginning at hand, for all unknown codes at once."""
    lengths = np.array([len(u) for u in unknown], np.int32)
    width = int(lengths.max(initial=0))
    letters = np.zeros((width, len(unknown)), np.int32)
    for j, u in enumerate(unknown):
        letters[: len(u), j] = np.frombuffer(u.encode("utf-32-le"), np.int32)
    kind = np.int16 if max(width, max(map(len, codes))) < 1 << 14 else np.int32
    steps = np.arange(width + 1, dtype=kind)[:, None]
    other = {}  # where a character is not that of the unknown code
    best, place = np.full(len(unknown), np.iinfo(kind).max, kind), np.zeros(len(unknown), np.int64)
    everyone = np.arange(len(unknown))
    # for each length of the beginning: the unknown codes for which it can still lead to something nearer, and their rows
    rows = [(everyone, np.broadcast_to(steps, (width + 1, len(unknown))))]
    if codes[0] == "":
        best[:] = lengths
    for depth, letter, at in _beginnings(codes):
        del rows[depth:]
        who, row = rows[-1]
        # what was found since then may leave fewer of them
        alive = row.min(0) < best[who]
        if np.count_nonzero(alive) * 4 < 3 * len(who):
            who, row = who[alive], row[:, alive]
        if not len(who):
            rows.append((who, row))
            continue
        if letter not in other:
            other[letter] = (letters != ord(letter)).astype(kind)
        differs = other[letter] if len(who) == len(unknown) else other[letter][:, who]
        new = row + kind(1)
        np.minimum(new[1:], row[:-1] + differs, out=new[1:])
        new -= steps
        for i in range(1, width + 1):
            np.minimum(new[i], new[i - 1], out=new[i])
        new += steps
        rows.append((who, new))
        if at >= 0:
            found = new[lengths[who], np.arange(len(who))]
            nearer = found < best[who]
            best[who[nearer]], place[who[nearer]] = found[nearer], at
    return place, best.astype(np.int32)


def _far(unknown: DataFrame, codes: DataFrame) -> DataFrame:
    """The nearest code of each unknown one; blocks of both meet, each two in a task of their own."""
    parts = int(unknown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = unknown.count(), codes.count()
    right = -(-m // KNOWN)
    left = max(-(-n // FAR), min(-(-n // 64), -(-parts // max(right, 1))))
    if not n or not m:
        return unknown.select("unknown", F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("distance")).limit(0)
    # codes with the same beginning are in one block
    ranged = stored(codes.repartitionByRange(right, "code").select("code", F.spark_partition_id().alias("_k")), "blocks")
    dealt = unknown.select("unknown", F.pmod(F.xxhash64("unknown"), F.lit(left)).cast("int").alias("_u"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    pair = (F.col("_u") * right + F.col("_k")).alias("_pair")
    # numbered pairs of blocks, so that each can have a partition
    cut = lambda df: df.repartition(min(left * right, max(parts, 2000)), "_pair").groupBy("_pair")
    one = cut(dealt.withColumn("_k", every(right)).select(pair, "unknown"))
    two = cut(ranged.withColumn("_u", every(left)).select(pair, "code"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        u, c = a["unknown"].to_pylist(), sorted(b["code"].to_pylist())
        if not u or not c:
            u, place, distance = [], np.zeros(0, np.int64), np.zeros(0, np.int32)
        else:
            place, distance = nearest_in(u, c)
        return pa.table({"unknown": pa.array(u, pa.string()), "code": pa.array([c[i] for i in place], pa.string()), "distance": pa.array(distance, pa.int32())})

    return _better(one.cogroup(two).applyInArrow(nearest, "unknown string, code string, distance int"))


def nearest_codes(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """unknown, code and distance: for each distinct unknown code the nearest known one (column code), of equally near ones the first.

    Null codes have none and are nobody's; without known codes nothing comes out."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    importable(known.sparkSession)
    codes = stored(known.select("code").where("code is not null").distinct(), "known")
    wanted = stored(unknown.select("unknown").where("unknown is not null").distinct(), "unknown")
    same = wanted.join(codes, F.col("unknown") == F.col("code")).select("unknown", "code", F.lit(0).alias("distance"))
    rest = wanted.join(codes, F.col("unknown") == F.col("code"), "left_anti")
    # few bytes of codes have many keys and pairs, so small parts must not be merged; a chance match of keys is told by the distance
    keyed = lambda df, c: df.repartition(parts, c).select(c, F.explode(F.transform(deletions(F.col(c)), lambda k: F.xxhash64(k))).alias("_key")).repartition(parts, "_key")
    met = keyed(rest, "unknown").join(keyed(codes, "code").hint("merge"), "_key").select("unknown", "code").distinct()
    close = met.withColumn("distance", F.call_function("levenshtein", "unknown", "code", F.lit(EDITS))).where("distance >= 0")
    best = stored(same.unionByName(_better(close)), "near")
    far = stored(wanted.join(best, "unknown", "left_anti"), "far")
    return best.unionByName(_far(far, codes))
