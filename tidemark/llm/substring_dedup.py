"""Removal of passages that repeat across documents, with Aho-Corasick automata.

Candidates first: every run of `window` words holds a least anchor (a shorter run, by hash), and equal runs hold equal
anchors, so only anchors met in two documents can lie in a repeated run. The runs around those are then grouped by a
96-bit hash to confirm which recur, and in which document each is met first. Confirmed runs that follow each other are
joined into passages. Every task compiles the passages of its own share of the documents (a shard) into an automaton
and streams those documents through it to locate every occurrence; a document needs no other shard's automaton, as
all passages that lie in it were confirmed in it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import inside, rows_of, signed, window_hashes, word_hashes, written

NONE = np.iinfo(np.int64).min  # no id: no run starts here
SHARD_DOCS = 500  # documents whose passages share an automaton
SHARD_BYTES = 4 << 20  # and their text at most, or one document


def least_anchors(words: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of `window` words: its first word's place, its text, and the hash of its least anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = window_hashes(words, anchor) >> np.uint64(16)  # 48 bits: a chance match only adds a candidate
    least, width, want = hashes, 1, window - anchor + 1
    while 2 * width <= want:  # sliding minimum by doubling
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    ok = np.flatnonzero(inside(ends, window, n))
    return ok, rows_of(ends)[ok], least[ok]


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The distinct least anchors of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words, ends = word_hashes(batch.column(1))
            _, rows, least = least_anchors(words, ends, window, anchor)
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)  # runs side by side mostly share their anchor
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            rows, least = rows[new], least[new]
            order = np.lexsort((least, rows))
            rows, least = rows[order], least[order]
            new = np.ones(len(rows), bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[new]], pa.int64()), pa.array(signed(least[new]))], names=["id", "anchor"])

    return docs.mapInArrow(find, "id long, anchor long")


def _runs(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Runs of the documents that hold one of the document's own recurring anchors (column anchors, ascending longs), each once for a document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                words, ends = word_hashes(part.column(1))
                at, rows, least = least_anchors(words, ends, window, anchor)
                lists = part.column(2)
                if not lists.null_count < len(lists):
                    continue
                sizes = np.diff(lists.offsets.to_numpy())
                known = np.sort(_pair(np.repeat(np.arange(len(ids)), sizes), lists.flatten().to_numpy().view(np.uint64)))
                keep = _found(known, _pair(rows, least))
                at, rows = at[keep], rows[keep]
                if not len(at):
                    continue
                one, two = window_hashes(words, window)[at], (window_hashes(words, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((one, rows))
                one, two, rows = one[order], two[order], rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[new]], pa.int64()), pa.array(signed(one[new])), pa.array(two[new].view(np.int32))], names=["id", "one", "two"])

    return docs.mapInArrow(find, "id long, one long, two int")


def _pair(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One 64-bit value for a row of the batch and a hash; a chance match only adds a candidate."""
    return values ^ ((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _found(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def locate(texts: list[list[bytes]], ids: list[int], passages: dict[bytes, int]) -> list[np.ndarray]:
    """Of each document's words, which lie in an occurrence of a passage that is met first in a document with a smaller id.

    passages: words joined and enclosed by single spaces, and that first document's id."""
    if not passages:
        return [np.zeros(len(w), bool) for w in texts]
    machine = ahocorasick.Automaton()
    for p, first in passages.items():
        machine.add_word(p.decode("latin-1"), (p.count(b" ") - 1, first))
    machine.make_automaton()
    out = []
    for words, own in zip(texts, ids, strict=True):
        marks = np.zeros(len(words) + 1, np.int64)
        line = b" " + b" ".join(words) + b" "
        last = {i: k for k, i in enumerate(np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist())}  # the words before a space
        for end, (n, first) in machine.iter(line.decode("latin-1")):
            if first < own:
                k = last[end]
                marks[k - n] += 1
                marks[k] -= 1
        out.append(np.cumsum(marks[:-1]) > 0)
    return out


def passages_of(words: list[bytes], firsts: np.ndarray, window: int) -> Iterator[tuple[bytes, int]]:
    """Passages of one document: runs that follow each other and are met first in the same document. firsts: for each word's place the id of the document where the run from there is met first, or NONE."""
    places = np.flatnonzero(firsts != NONE)
    if len(places):
        cuts = np.flatnonzero((np.diff(places) > 1) | (np.diff(firsts[places]) != 0)) + 1
        for group in np.split(places, cuts):
            yield b" " + b" ".join(words[group[0] : group[-1] + window]) + b" ", int(firsts[group[0]])


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove each word that lies in a run of `window` words which also starts in a document with a smaller id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; runs are judged on the input. One row for each input row: id_col,
    n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) and, with texts, kept_text. A null text
    has no words; rows with a null id are left as they are and seen by no other; rows that repeat an id count as one
    document with the runs of them all. Other columns do not matter."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = base.where("id is not null")
    same = Window.partitionBy("anchor").orderBy("id")
    met = _anchors(known, window, anchor).withColumns({"before": F.lag("id").over(same), "after": F.lead("id").over(same)})
    met = met.where("before < id or after > id").groupBy("id").agg(F.array_distinct(F.collect_list("anchor")).alias("anchors"))
    keyed = base.repartition("id")
    candidates = keyed.join(met, "id", "left")  # as the join below, so that the texts are shuffled once for both
    same = Window.partitionBy("one", "two").orderBy("id")
    again = _runs(candidates.select("id", "text", "anchors"), window, anchor).withColumn("first", F.min("id").over(same)).where("first < id")
    again = again.groupBy("id").agg(F.collect_list(F.struct("one", "first")).alias("runs"))  # within one document 64 bits tell runs apart

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sizes = 0, batch.column(1).cast(pa.large_binary())
            lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
            while start < batch.num_rows:
                stop, total = start + 1, lengths[start]
                while stop < batch.num_rows and stop - start < SHARD_DOCS and total + lengths[stop] <= SHARD_BYTES:
                    total += lengths[stop]
                    stop += 1
                yield shard(batch.slice(start, stop - start))
                start = stop

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column(0).to_pylist()
        words = [(t or "").encode().split() for t in part.column(1).to_pylist()]
        lists = part.column(2)
        has = np.flatnonzero(np.array(lists.is_valid()))
        passages: dict[bytes, int] = {}
        if len(has):
            hashes, ends = word_hashes(part.column(1))
            one = window_hashes(hashes, window)
            ok = inside(ends, window, len(one))
            for r in has.tolist():
                runs = lists[r].values
                a, f = (runs.field(i).to_numpy() for i in range(2))
                order = np.argsort(a, kind="stable")
                a, f = a[order], f[order]
                here = slice(ends[r], min(ends[r + 1], len(one)))
                x = signed(one[here])
                at = np.minimum(np.searchsorted(a, x), len(a) - 1)
                firsts = np.full(len(words[r]), NONE, np.int64)
                hit = (a[at] == x) & ok[here]
                firsts[: len(x)][hit] = f[at[hit]]
                for p, first in passages_of(words[r], firsts, window):
                    passages[p] = min(first, passages.get(p, first))
        chosen = [i for i in has.tolist()]
        gone = dict(zip(chosen, locate([words[i] for i in chosen], [ids[i] for i in chosen], passages), strict=True))
        kept = [w if i not in gone else [x for x, g in zip(w, gone[i].tolist(), strict=True) if not g] for i, w in enumerate(words)]
        joined = [b" ".join(w) for w in kept]
        out = [part.column(0), pa.array(map(len, words), pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined])]
        return pa.RecordBatch.from_arrays(out + [pa.array([j.decode() for j in joined], pa.string())] * texts, names=names)

    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = keyed.join(again, "id", "left").select("id", "text", "runs").mapInArrow(shards, schema)
    return out.withColumnRenamed("id", id_col)
