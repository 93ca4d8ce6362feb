"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (runs of min_match tokens). For each pair whose seeds could
cover enough of the item, the longest matches of unmarked tokens are marked again and again, found by running
Karp-Rabin, until none of min_match tokens is left. The share of the item's tokens under tiles decides, so a passage
is caught whatever the order of its parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, inside, rows_of, slices, split_words, window_hashes, written

BLOCK_CHARS = 16 << 20  # benchmark text that is sent to the executors at once; a larger benchmark is gone through in blocks
MOD, FACTOR = (1 << 61) - 1, 1_000_003  # of the running hash


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts as hashes, end to end, and the n + 1 offsets: words in lower case, letters and digits only."""
    names, index, ends = split_words(texts)
    plain = [w.lower() if w.isalnum() else "".join(filter(str.isalnum, w)).lower() for w in names]
    values = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in plain], U64)[index] if names else np.zeros(0, U64)
    keep = values != 0
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of the tiles, longest first.

    In each round a running hash finds the runs of `size` unmarked tokens that both have; matches are extended, the
    longest are marked (the earliest first where they overlap), and size follows the longest that was found."""
    marked_i, marked_t = [False] * len(item), [False] * len(text)
    tiles, size = [], max(least, min(len(item), 64))

    def running(seq: list[int], marked: list[bool]) -> Iterator[tuple[int, int]]:
        high, value, run = pow(FACTOR, size - 1, MOD), 0, 0
        for i, x in enumerate(seq):
            if marked[i]:
                value = run = 0
                continue
            if run == size:
                value, run = (value - seq[i - size] % MOD * high) % MOD, run - 1
            value, run = (value * FACTOR + x) % MOD, run + 1
            if run == size:
                yield i - size + 1, value

    while size >= least:
        table: dict[int, list[int]] = {}
        for i, value in running(item, marked_i):
            table.setdefault(value, []).append(i)
        found, longest = [], 0
        for t, value in running(text, marked_t):
            for i in table.get(value, ()):
                if i and t and not marked_i[i - 1] and not marked_t[t - 1] and item[i - 1] == text[t - 1] and longest > size:
                    continue  # part of a longer match that began before
                n = 0
                while i + n < len(item) and t + n < len(text) and not marked_i[i + n] and not marked_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= max(size, longest):
                    found.append((n, i, t))
                    longest = n
        if longest:
            size = longest
            for n, i, t in sorted((f for f in found if f[0] == longest), key=lambda f: (f[2], f[1])):
                if not any(marked_i[i : i + n]) and not any(marked_t[t : t + n]):
                    tiles.append((i, t, n))
                    marked_i[i : i + n] = marked_t[t : t + n] = [True] * n
        elif size == least:
            break
        else:
            size = max(least, size // 2)
    return tiles


class Items:
    """Benchmark items of one block, with their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int) -> None:
        values, ends = tokens(pa.array(texts, pa.string()))
        self.ids, self.least = list(ids), least
        self.tokens = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.sizes = np.diff(ends)
        hashes = window_hashes(values, least)
        ok = np.flatnonzero(inside(ends, least, len(hashes)))
        order = ok[np.argsort(hashes[ok], kind="stable")]
        self.seeds, self.starts = np.unique(hashes[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        self.item = rows_of(ends)[order]
        self.place = order - ends[:-1][self.item] if len(order) else order

    def match(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item, tokens under tiles, tiles, longest tile) of the texts that cover enough of an item."""
        if not len(self.seeds):
            return []
        values, ends = tokens(texts)
        hashes = window_hashes(values, self.least)
        if not len(hashes):
            return []
        near = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        at = np.flatnonzero((self.seeds[near] == hashes) & inside(ends, self.least, len(hashes)))
        if not len(at):
            return []
        rows = rows_of(ends)[at]
        key, first = np.unique(np.stack((rows, near[at])), axis=1, return_index=True)
        rows, seeds = rows[first], near[at][first]
        counts = self.starts[seeds + 1] - self.starts[seeds]
        flat = np.arange(counts.sum()) + np.repeat(self.starts[seeds] - np.cumsum(counts) + counts, counts)
        rows, items, places = np.repeat(rows, counts), self.item[flat], self.place[flat]
        order = np.lexsort((places, items, rows))
        rows, items, places = rows[order], items[order], places[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
        step = np.full(len(rows), self.least)
        step[:-1] = np.where(new[1:], self.least, np.minimum(self.least, places[1:] - places[:-1]))
        starts = np.flatnonzero(new)
        most = np.add.reduceat(step, starts)  # item tokens that lie under any seed
        out = []
        for row, item in zip(rows[starts][most >= threshold * self.sizes[items[starts]]].tolist(), items[starts][most >= threshold * self.sizes[items[starts]]].tolist(), strict=True):
            whole = values[ends[row] : ends[row + 1]]
            own = np.isin(window_hashes(whole, self.least), window_hashes(self.tokens[item], self.least))
            under = np.zeros(len(whole) + 1, np.int64)
            np.add.at(under, np.flatnonzero(own), 1)
            np.add.at(under, np.flatnonzero(own) + self.least, -1)
            under = np.cumsum(under[:-1]) > 0
            seam = under & ~np.append(False, under[:-1])  # tokens under no seed lie in no tile; each gap is one token that matches nothing
            text: list[int] = []
            for x, s in zip(whole[under].tolist(), seam[under].tolist(), strict=True):
                text += [-1, x] if s else [x]
            tiles = tile(self.tokens[item].tolist(), text, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered and covered >= threshold * self.sizes[item]:
                out.append((row, item, covered, len(tiles), max(n for _, _, n in tiles)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of whose tokens at least `threshold` lie under tiles of the document.

    One row for each pair and input row: id_col, item_id, item_tokens, matched_tokens, coverage, n_tiles and
    longest_tile. Null or empty texts, and items with fewer than min_match tokens, match nothing; null ids are carried
    along; repeated rows give repeated pairs. Other columns do not matter. The documents are not shuffled: they pass
    the benchmark by, in blocks of items of bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS) or 1
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, item_tokens long, matched_tokens long, coverage double, n_tiles long, longest_tile long"
    names = [id_col, "item_id", "item_tokens", "matched_tokens", "coverage", "n_tiles", "longest_tile"]
    parts = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Items(*sent.value, min_match)
            for batch in batches:
                for part in slices(batch, 4000, 32 << 20):
                    found = block.match(part.column(1), threshold)
                    row, item, covered, tiles, longest = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 5))
                    sizes = block.sizes[item]
                    numbers = [pa.array([block.ids[i] for i in item.tolist()], pa.int64()), pa.array(sizes, pa.int64()), pa.array(covered), pa.array(covered / np.maximum(sizes, 1)), pa.array(tiles), pa.array(longest)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *numbers], names=names)

        found = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(find, schema)
        parts.append(found if n == 1 else written(found, "contaminated"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
