"""SimHash near-duplicates, found at the anchor points of a covering code.

The anchors are the words of a code over all 64 bits of a fingerprint, the direct sum of four perfect codes on bits of
their own: two Golay codes [23, 12] of covering radius 3, a Hamming code [15, 11] and a repetition code [3, 1] of
covering radius 1. So every one of the 2**64 points has an anchor within 3, 3, 1 and 1 bits of its parts.

Two fingerprints that differ in at most t bits have a point midway, within ceil(t / 2) bits of both, and that point has an
anchor. So a fingerprint goes to every anchor within the covering radius plus its half of the threshold, where what a
part is over its own radius may add up to that half: some 165 anchors of 2**36 for 4 bits, against some thousands if one
side took the whole threshold. Every pair within the threshold meets at an anchor, and is compared there exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, signed, slices, written

#: Length, generator polynomial and covering radius of each perfect code, from the lowest bits on.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))
SEED = 42  # of XXH64
SMALL = 16  # fingerprints at an anchor, up to which all pairs are compared at once
CROWDED = 1 << 16  # and from which they are dealt out to several tasks


def fingerprint(text: bytes, k: int) -> int:
    """SimHash of the k-word shingles of a text, repeats included: each bit is 1 if it is in over half of their XXH64.

    A-Z count as a-z; of fewer than k words all are one shingle; without words the fingerprint is 0."""
    words = text.lower().split()  # of bytes: A-Z alone are lowered, and \x20 \x09-\x0D alone part words
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(k, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)), U64, len(last))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a long) of every row; a null text has no words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2000):
                texts = pc.fill_null(part.column(1), b"").to_pylist()
                made = np.array([fingerprint(t, k) for t in texts], U64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(made))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(make, f"id {kind}, fp long")


class Part:
    """One perfect cyclic code on some bits: for each syndrome, the error patterns that lead to a code word, by how far they are over the covering radius."""

    def __init__(self, length: int, generator: int, radius: int, reach: int) -> None:
        self.length, self.check = length, generator.bit_length() - 1
        single = []
        for bit in range(length):
            rest = 1 << bit
            while rest.bit_length() > self.check:
                rest ^= generator << (rest.bit_length() - generator.bit_length())
            single.append(rest)
        self.syndrome_of = np.zeros((3, 256), np.int64)  # by byte, as syndromes are linear
        for byte in range(3):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1 and 8 * byte + bit < length:
                        self.syndrome_of[byte, value] ^= single[8 * byte + bit]
        found = []  # syndrome, excess, pattern
        for weight in range(min(radius + reach, length) + 1):
            for bits in combinations(range(length), weight):
                pattern, syndrome = 0, 0
                for b in bits:
                    pattern |= 1 << b
                    syndrome ^= single[b]
                found.append((syndrome, max(0, weight - radius), pattern))
        rows = np.array(sorted(found), np.int64)
        self.patterns = rows[:, 2]
        keys = rows[:, 0] * (reach + 1) + rows[:, 1]
        self.starts = np.searchsorted(keys, np.arange((reach + 1 << self.check) + 1))
        self.levels = reach + 1

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        return self.syndrome_of[0, x & 255] ^ self.syndrome_of[1, x >> 8 & 255] ^ self.syndrome_of[2, x >> 16 & 255]

    def near(self, x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the code words whose distance from x is that much over the radius (0: within it), and to which x each belongs."""
        at = self.syndromes(x) * self.levels + excess
        start, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        of = np.repeat(np.arange(len(x)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
        return (x[of] ^ self.patterns[place]) >> self.check, of  # the upper bits of a word of a cyclic code tell it


@lru_cache(maxsize=4)
def parts(reach: int) -> list[Part]:
    return [Part(*code, reach) for code in CODES]


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within the covering radius plus reach of each fingerprint: their numbers (36 bits), and the place of the fingerprint."""
    key = np.zeros(len(fps), np.int64)
    of, used = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    shift = at = 0
    for part in parts(reach):
        bits = (fps >> U64(at) & U64((1 << part.length) - 1)).astype(np.int64)
        grown = []
        for excess in range(reach + 1):
            some = np.flatnonzero(used + excess <= reach)
            number, back = part.near(bits[of[some]], excess)
            rows = some[back]
            grown.append((key[rows] | number << shift, of[rows], used[rows] + excess))
        key, of, used = (np.concatenate(x) for x in zip(*grown, strict=True))
        shift += part.length - part.check
        at += part.length
    return key, of


def spanning(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within `most` bits that connect what all such pairs connect: each fingerprint is reached once, from one that was reached before."""
    left, right = [], []
    rest = fps
    while len(rest):
        ahead, rest = rest[:1], rest[1:]
        while len(ahead) and len(rest):
            me, ahead = ahead[0], ahead[1:]
            close = np.bitwise_count(rest ^ me) <= most
            new = rest[close]
            if len(new):
                left.append(np.full(len(new), me, U64))
                right.append(new)
                rest = rest[~close]
                ahead = np.concatenate((ahead, new))
    none = np.zeros(0, U64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def close_pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs of each run of equal keys: all pairs within `most` bits of a short run, spanning ones of a longer run."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(new, len(keys)))
    left, right = [], []
    place = np.arange(len(keys)) - np.repeat(new, sizes)
    after = np.repeat(sizes, sizes) - place - 1  # members behind this one
    after[np.repeat(sizes, sizes) > SMALL] = 0
    for step in range(1, SMALL):
        at = np.flatnonzero(after >= step)
        if not len(at):
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= most]
        left.append(fps[at])
        right.append(fps[at + step])
    for start, size in zip(new[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = spanning(fps[start : start + size], most)
        left.append(a)
        right.append(b)
    none = np.zeros(0, U64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def anchored(fps: DataFrame, most: int) -> DataFrame:
    """anchor and fp: each fingerprint at every anchor that it may meet a close one at."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048).column(0).to_numpy().view(U64)
                key, of = anchors(some, (most + 1) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed(some[of]))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(deal, "anchor long, fp long")


def met(placed: DataFrame, most: int, crowded: int) -> DataFrame:
    """a, b: linking pairs at each anchor. An anchor of more than `crowded` fingerprints gives one row instead, with its anchor and their number n.

    A task goes through its anchors in order and holds the fingerprints of one at a time, no more than `crowded`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), U64)
            none = pa.nulls(len(pairs), pa.int64())
            columns = [pa.array(signed(np.ascontiguousarray(pairs[:, i]))) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, none, none], names=["a", "b", "anchor", "n"])

        def over(anchor: int, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": [None], "b": [None], "anchor": [int(anchor)], "n": [int(n)]}, schema)

        keys, fps, seen = np.zeros(0, np.int64), np.zeros(0, U64), 0  # of the last anchor; seen counts those let go
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(U64)))
            if not len(keys):
                continue
            if seen and keys[0] != keys[-1]:  # the rest of a crowded anchor ends here
                n = int(np.searchsorted(keys, keys[0], side="right"))
                yield over(keys[0], seen + n)
                keys, fps, seen = keys[n:], fps[n:], 0
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield out(*close_pairs(keys[:whole], fps[:whole], most))
                keys, fps = keys[whole:], fps[whole:]
            if seen + len(keys) > crowded:
                seen += len(keys) - 1
                keys, fps = keys[-1:], fps[-1:]
        if seen:
            yield over(keys[0], seen + len(keys))
        elif len(keys):
            yield out(*close_pairs(keys, fps, most))

    schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "anchor", "n")])
    dealt = placed.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long, anchor long, n long")


def met_in_blocks(placed: DataFrame, full: DataFrame, most: int, crowded: int) -> DataFrame:
    """a, b of crowded anchors (anchor, n): their fingerprints are cut into blocks, and each two blocks meet in a task of their own."""
    cut = placed.join(full, "anchor").withColumn("_of", F.ceil(2 * F.col("n") / crowded).cast("int") + 1)
    cut = cut.withColumn("_mine", F.pmod(F.xxhash64("fp"), F.col("_of")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_of") - 1))
    pairs = cut.select("anchor", "fp", "_mine", other.alias("_other"))
    key = F.xxhash64("anchor", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    # distinct values fall evenly into blocks, so two blocks hold about `crowded` rows; keys that meet by chance only add comparisons
    return met(pairs.select(key.alias("anchor"), "fp"), most, 1 << 62).select("a", "b")


def near_duplicates(
    docs: DataFrame, k: int = 5, most: int = 4, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED
) -> DataFrame:
    """Components of documents whose fingerprints differ in at most `most` bits.

    One row for each input row: id_col, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links
    lead to, itself included. Equal fingerprints are one class, and only classes are dealt to anchors. Null and empty
    texts have the fingerprint 0 and are linked like any other. Equal rows of an id count as one; an id with several
    texts has the links of each and joins them. A null id has a fingerprint, no links and no component. Ids can be of any
    type that has an order; other columns of docs do not matter."""
    if most < 0:
        raise ValueError("the number of bits cannot be negative")
    rows = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    known = rows.where("id is not null")
    classes = written(known.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    placed = anchored(classes, most)
    found = written(met(placed, most, crowded), "met")
    pairs = found.where("a is not null").select("a", "b")
    full = found.where("a is null").select("anchor", "n")
    if not full.isEmpty():
        pairs = pairs.union(met_in_blocks(placed, full, most, crowded))
    pairs = pairs.distinct()
    rep = lambda x: classes.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"))
    links = pairs.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # an id with several texts joins their classes
    several = known.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
    of_id = known.join(several, "id").select("id", "fp").distinct().join(classes, "fp")
    links = links.unionByName(of_id.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    found = written(components(written(links, "links")), "components")
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("fp", F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, "fp", "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    component = F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")
    return out.select(F.col("id").alias(id_col), digits, component)
