"""Alignment of the tokens of two tokenizers, with corpus-wide counts of the pairs that they form.

Byte offsets where tokens of both end cut a text into groups, and the two tokens that end at such an offset are a link.
The bytes of one token of a link end the other's, so the pairs that any corpus can hold follow from the two
vocabularies: no more than the bytes of all their entries. These distinct pairs get a minimal perfect hash, by which each
task keeps a dense vector of counts; vectors are added up in a tree, and a second pass aligns every document again and
looks its links up. The key that is kept in each place verifies that a pair is the one that the hash led to."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, slices, written
from .token_counts import PIECES, byte_letters

SPACE_MARK = "▁"
SLICE = 1 << 14  # counts in a row of the tree
FAN = 32  # vectors that a node of the tree adds up
#: Units of a text that begins with a space: each goes on to the next space that follows no white space.
CUT = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?| \s*\Z")
KEPT_UNITS, KEPT_BYTES = 400_000, 64 << 20  # of units that a worker knows about
_LEVEL = 0x9E3779B97F4A7C15


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    On each level a key has one bit; keys that share theirs go on to the next level. A key's number is the count of bits
    before its own, over all levels."""

    def __init__(self, keys: np.ndarray, load: float = 2.0) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits in words of 64, and the bits before each word
        before, rest = 0, keys.astype(U64)
        while len(rest):
            if len(self.levels) > 100:
                raise ValueError("keys must be distinct")
            words = int(len(rest) * load) // 64 + 1
            at = self._place(rest, len(self.levels), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            bits = np.packbits(alone, bitorder="little").view(U64)
            ranks = before + np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            self.levels.append((bits, ranks[:-1]))
            before, rest = int(ranks[-1]), rest[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        salt = U64((level + 1) * _LEVEL % 2**64)
        return (mix(keys + salt) % U64(64 * words)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """From 0 to the number of keys less 1 for known keys; others get any such number, or -1."""
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            at = self._place(keys[rest], level, len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit & U64(1)).astype(bool)
            under = word[hit] & ((U64(1) << bit[hit]) - U64(1))
            out[rest[hit]] = ranks[at[hit] >> 6] + np.bitwise_count(under)
            rest = rest[~hit]
            if not len(rest):
                break
        return out


class PairIndex:
    """Distinct pairs of ids by their perfect hash; a look-up is verified by the key in its place."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        keys = np.unique(a.astype(U64) << U64(32) | b.astype(U64))
        self.hash = PerfectHash(keys)
        self.keys = np.zeros(len(keys), U64)
        self.keys[self.hash.numbers(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs; a pair that is not among them is refused."""
        keys = a.astype(U64) << U64(32) | b.astype(U64)
        if not len(keys):
            return np.zeros(0, np.int64)
        at = self.hash.numbers(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise KeyError("a pair of tokens that no text can link")
        return at


class Aligner:
    """Both tokenizers: a byte-level vocabulary from a tokenizers .json file, and a sentencepiece model with byte fallback.

    The first is encoded by tiktoken, whose result is the same: merges of a byte-level vocabulary are in the order of ids.
    A text is cut before each space that follows something else than white space. No piece of either goes over such a
    place, so both end there, and every unit between is encoded and aligned by itself, once for all its occurrences."""

    def __init__(self, bytes_json: str, pieces_model: str) -> None:
        import sentencepiece
        import tiktoken

        with open(bytes_json, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._check(spec, ranks, letters)
        self.encode_a = tiktoken.Encoding(bytes_json, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        model = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
        self.encode_b = lambda texts: model.encode(texts, num_threads=1)
        self.space_b = [model.piece_to_id(SPACE_MARK)]
        self.bytes_b = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE_MARK, " ").encode()
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else plain)
            if re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", piece):
                raise ValueError("a piece of this model goes on over a space, so texts cannot be cut there")
        self.length_a, self.length_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # what stands for an id in the text of groups, by what follows it
        names = lambda n, last: [f"{i}{end}" for end in (",", last) for i in range(n)]
        self.names = pa.array([*names(len(self.bytes_a), "|"), *names(len(self.bytes_b), ";")], pa.large_binary())

    @staticmethod
    def _check(spec: dict, ranks: dict[bytes, int], letters: dict[str, int]) -> None:
        """Merges must make ids in rising order, or tiktoken would merge in another order."""
        made = -1
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = ranks[bytes(letters[c] for c in left + right)]
            if token <= made:
                raise ValueError("merges of this vocabulary are not in the order of its ids")
            made = token

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of ids whose tokens can end together: the bytes of one end the other's."""
        by_a, by_b = ({}, {})
        for names, out in ((self.bytes_a, by_a), (self.bytes_b, by_b)):
            for i, token in enumerate(names):
                if token:
                    out.setdefault(token, []).append(i)
        a, b = [], []
        for token, ids in by_a.items():
            for k in range(len(token)):
                for other in by_b.get(token[k:], ()):
                    a += ids
                    b += [other] * len(ids)
        for token, ids in by_b.items():
            for k in range(1, len(token)):
                for other in by_a.get(token[k:], ()):
                    a += [other] * len(ids)
                    b += ids
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, units: list[str]) -> Aligned:
        """Tokens of units, each of which begins with a space; one that either's tokens do not spell has none."""
        ids_a, ids_b = [*map(self.encode_a, units)], self.encode_b([u[1:] for u in units])  # the model adds the space
        ids_b = [b or self.space_b for b in ids_b]  # but not to nothing
        whole = [u.encode() for u in units]
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        spelt = self._all_spelt(whole, ids_a, ids_b)
        if not spelt.all():
            each = zip(whole, ids_a, ids_b, strict=True)
            spelt = np.array([b"".join(map(spell_a, a)) == w == b"".join(map(spell_b, b)) for w, a, b in each])
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, spelt, strict=True)] for ids in (ids_a, ids_b))
        sizes = np.array([[*map(len, ids)] for ids in (ids_a, ids_b)], np.int64).reshape(2, -1)
        a, b = (np.array([*chain.from_iterable(ids)], np.int64) for ids in (ids_a, ids_b))
        return Aligned(self, a, b, sizes, spelt)

    def _all_spelt(self, whole: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Whether all units are spelt, looked at at once: their bytes in a row, and where each ends."""
        ends, joined, ok = np.cumsum([*map(len, whole)], dtype=np.int64), b"".join(whole), True
        for ids, names, length in ((ids_a, self.bytes_a, self.length_a), (ids_b, self.bytes_b, self.length_b)):
            flat = [*chain.from_iterable(ids)]
            upto = np.concatenate(([0], np.cumsum(length[np.array(flat, np.int64)])))
            last = np.cumsum([*map(len, ids)], dtype=np.int64)
            ok = ok and b"".join(map(names.__getitem__, flat)) == joined and np.array_equal(upto[last], ends)
        return np.full(len(whole), ok)


class Aligned:
    """Tokens of some units end to end (ids a and b), the places where both end (at_a, at_b), how many a unit has of each, and whether both spell it."""

    def __init__(self, own: Aligner, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, spelt: np.ndarray) -> None:
        self.own, self.a, self.b, self.spelt = own, a, b, spelt
        self.n_a, self.n_b = sizes
        # both streams spell the same bytes, so offsets over all units do for each
        ends_a, ends_b = np.cumsum(own.length_a[a]), np.cumsum(own.length_b[b])
        _, self.at_a, self.at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        upto = np.concatenate(([0], np.cumsum(self.n_a)))
        self.n_links = np.diff(np.searchsorted(self.at_a, upto))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.at_a], self.b[self.at_b]

    def groups(self) -> list[bytes]:
        """Each unit's groups as `a1,a2|b1;a3|b2,b3`."""
        if not len(self.a):
            return [b""] * len(self.n_a)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.at_a] = last_b[self.at_b] = True
        n_a, n_b = len(self.own.bytes_a), len(self.own.bytes_b)
        group_a = np.cumsum(last_a) - last_a  # groups that end before a token
        group_b = np.cumsum(last_b) - last_b
        ends_a, ends_b = np.append(self.at_a + 1, 0), np.concatenate(([0], self.at_b + 1))
        code = np.zeros(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + ends_b[group_a]] = self.a + n_a * last_a
        code[np.arange(len(self.b)) + ends_a[group_b]] = 2 * n_a + self.b + n_b * last_b
        made = self.own.names.take(pa.array(code))
        data, offsets = made.buffers()[2], np.frombuffer(made.buffers()[1], np.int64, len(code) + 1)
        upto = offsets[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        view = memoryview(data)
        return [bytes(view[i : max(i, j - 1)]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


class Units:
    """What a worker knows of the units that it has met; it is all dropped at KEPT_UNITS or KEPT_BYTES, so memory is bounded."""

    def __init__(self, own: Aligner, index: PairIndex) -> None:
        self.own, self.index = own, index
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.groups, self.spelt = 0, [], np.zeros(0, bool)
        self.n_a = self.n_b = self.n_links = self.places = self.other = np.zeros(0, np.int64)
        self.upto = np.zeros(1, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, end to end, and the n + 1 offsets of the texts; null and empty ones have none."""
        if len(self.number) > KEPT_UNITS or self.size > KEPT_BYTES:
            self.clear()
        cut = [CUT.findall(f" {t}") if t else [] for t in texts]
        known = len(self.number)
        number = self.number
        out = np.array([number.setdefault(u, len(number)) for units in cut for u in units], np.int64)
        new = [*islice(number, known, None)]
        if new:
            self._learn(new)
        return out, np.concatenate(([0], np.cumsum([len(c) for c in cut], dtype=np.int64)))

    def _learn(self, new: list[str]) -> None:
        made = self.own.align(new)
        a, b = made.links()
        join = lambda name, more: setattr(self, name, np.concatenate((getattr(self, name), more)))
        for name, more in (("n_a", made.n_a), ("n_b", made.n_b), ("n_links", made.n_links), ("spelt", made.spelt), ("places", self.index.places(a, b)), ("other", b)):
            join(name, more)
        self.upto = np.concatenate(([0], np.cumsum(self.n_links)))
        self.groups += made.groups()
        self.size += sum(map(len, new)) + sum(map(len, self.groups[-len(new) :]))

    def by_unit(self, values: np.ndarray) -> np.ndarray:
        """Sum over the links of each unit."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.upto[1:]] - total[self.upto[:-1]]


def _by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


def _spelt(units: Units, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts both tokenizers spell, all of their units."""
    return _by_text(~units.spelt[at], ends) == 0


@lru_cache(maxsize=2)
def aligner(bytes_json: str, pieces_model: str) -> Aligner:
    """One for each pair of vocabularies in a worker."""
    return Aligner(bytes_json, pieces_model)


@lru_cache(maxsize=2)
def pair_index(bytes_json: str, pieces_model: str) -> PairIndex:
    """The same in every worker, as it follows from the vocabularies."""
    return PairIndex(*aligner(bytes_json, pieces_model).pairs())


def _vector_rows(counts: np.ndarray, node: int) -> pa.RecordBatch:
    """A vector in rows of SLICE counts; all zeros need no row."""
    starts = [i for i in range(0, len(counts), SLICE) if counts[i : i + SLICE].any()]
    columns = [pa.array([node] * len(starts), pa.int64()), pa.array([i // SLICE for i in starts], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([counts[i : i + SLICE].tobytes() for i in starts], pa.binary())], ["node", "slice", "counts"])


def _sum_of(vectors: pa.Table) -> pa.Table:
    """The sum of a node's vectors, in one slice: at most FAN of SLICE counts."""
    total = sum(np.frombuffer(v, np.int64) for v in vectors.column("counts").to_pylist())
    row = {"node": [vectors.column("parent")[0].as_py()], "slice": [vectors.column("slice")[0].as_py()], "counts": [total.tobytes()]}
    return pa.table(row, pa.schema([("node", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())]))


def pair_counts(docs: DataFrame, bytes_json: str, pieces_model: str, text_col: str = "text") -> np.ndarray:
    """How often each pair of the index is linked in the whole corpus, by its place.

    The vector has as many numbers as the vocabularies allow pairs, whatever the corpus; its sum comes to the driver."""
    schema = "node long, slice int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(aligner(bytes_json, pieces_model), pair_index(bytes_json, pieces_model))
        counts = np.zeros(len(units.index), np.int64)
        for batch in batches:
            for part in slices(batch, 1000, 2 << 20):
                at, ends = units.of(part.column(0).to_pylist())
                at = at[np.repeat(_spelt(units, at, ends), np.diff(ends))]
                times = np.bincount(at, minlength=len(units.n_links))
                np.add.at(counts, units.places, np.repeat(times, units.n_links))
        yield _vector_rows(counts, TaskContext.get().partitionId())

    level = written(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema), "counts")
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        parent = level.withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
        level = parent.groupBy("slice", "parent").applyInArrow(_sum_of, schema)
        nodes = -(-nodes // FAN)
    out = np.zeros(len(pair_index(bytes_json, pieces_model)), np.int64)
    for r in level.collect():  # one row for each slice
        part = np.frombuffer(bytes(r["counts"]), np.int64)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return out


def pair_table(docs: DataFrame, bytes_json: str, pieces_model: str, text_col: str = "text") -> DataFrame:
    """The alignment itself: columns a, b and n, how often tokens a and b end together in the corpus."""
    counts, keys = pair_counts(docs, bytes_json, pieces_model, text_col), pair_index(bytes_json, pieces_model).keys
    at = np.flatnonzero(counts)
    rows = pa.table({"a": (keys[at] >> U64(32)).astype(np.int64), "b": (keys[at] & U64(0xFFFFFFFF)).astype(np.int64), "n": counts[at]})
    return docs.sparkSession.createDataFrame(rows)


def align(docs: DataFrame, bytes_json: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, groups and links of every whole text, and how usual its links are in the corpus.

    One row for each input row, repeated and null ids included: id_col, n_a and n_b (tokens of space + text by the
    byte-level vocabulary, and of the text by the piece model, which adds the space), n_groups, n_links, n_best (links
    whose pair is the commonest of its b token, ties included), count_sum (of the corpus-wide counts of its links) and
    groups (`a1,a2|b1;a3|b2,b3`). Null and empty texts, and those that either tokenizer does not spell byte for byte, have
    no tokens: zeros and an empty string. Strings of special tokens are plain text. Paths of vocabularies are the same on
    every executor. Other columns of docs do not matter."""
    counts = pair_counts(docs, bytes_json, pieces_model, text_col)
    keys = pair_index(bytes_json, pieces_model).keys
    best = np.zeros(len(aligner(bytes_json, pieces_model).bytes_b), np.int64)
    np.maximum.at(best, (keys & U64(0xFFFFFFFF)).astype(np.int64), counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, best))  # bounded by the vocabularies: 8 bytes a pair or token

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(aligner(bytes_json, pieces_model), pair_index(bytes_json, pieces_model))
        counts, best = shared.value
        for batch in batches:
            for part in slices(batch, 1000, 2 << 20):
                at, ends = units.of(part.column(1).to_pylist())
                ok = _spelt(units, at, ends)
                n = counts[units.places]
                each = [units.n_a, units.n_b, units.n_links, units.n_links, units.by_unit(n == best[units.other]), units.by_unit(n)]
                longs = [_by_text(x[at], ends) * ok for x in each]
                name = units.groups.__getitem__
                texts = [b";".join(map(name, at[i:j].tolist())) if o else b"" for i, j, o in zip(ends[:-1], ends[1:], ok, strict=True)]
                groups = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, longs), groups], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(look_up, schema)
