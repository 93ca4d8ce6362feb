"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

A byte-level tokenizer cuts a text into pieces by its pattern, none of which runs on past white space, and merges
bytes within a piece only. Within a piece the last token of every prefix is fixed: it is the one vocabulary entry that
ends there and may follow the last token of the prefix before it. So count[i] = count[i - len(token)] + 1 gives the
exact count at each byte of the piece from those before it, and a running sum over the pieces gives it for the text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The white space of the tokenizer's pattern, and the pattern itself.
SPACE = r" \t-\r\x85\xa0  -     　"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose counts are kept in a worker; all are dropped when that many are there, so memory is bounded.
KEPT_CHUNKS = 500_000
#: Neighbouring tokens that a worker knows about, bounded in the same way.
KEPT_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes of texts, under the byte-level vocabulary in a tokenizers .json file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        as_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
        self.ids = {as_bytes[t]: i for t, i in spec["model"]["vocab"].items() if t in as_bytes}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.longest: dict[bytes, int] = {}  # length of the longest token that ends in these two bytes
        for b in self.ids:
            if len(b) > 1:
                self.longest[b[-2:]] = max(self.longest.get(b[-2:], 1), len(b))
        self.widest = max(map(len, [*self.ids, *special]), default=1)
        self.special = special
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.chunk = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.piece = regex.compile(PIECES)
        self.blank = re.compile(rf"[{SPACE}]+")
        self.follows: dict[int, bool] = {}
        self.totals: dict[str, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens of one piece, by merging the pair of lowest rank again and again."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            (rank, token), i = min((self.merges.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [token]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are merged to just these two; a piece's tokens are right if each neighbouring pair is."""
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        ok = self.follows[left << 20 | right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def piece_counts(self, data: bytes, before: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])) -> tuple[bytes, list[int], list[int]]:
        """The piece, the last token of each of its prefixes, and count[i] for i from 0 to its length: tokens of its first i bytes.

        before: what this gave for another piece, whose entries are taken over for the prefix that both share."""
        token_of, known, longest = self.ids.get, self.follows.get, self.longest.get
        other, last, count = before
        shared, most = 0, min(len(other), len(data))
        while shared < most and other[shared] == data[shared]:
            shared += 1
        last, count = last[: shared + 1], count[: shared + 1]
        for end in range(shared + 1, len(data) + 1):
            start = max(0, end - longest(data[end - 2 : end], 1)) if end > 1 else 0
            while True:
                token = token_of(data[start:end])
                if token is not None:
                    if not start:
                        break
                    ok = known(last[start] << 20 | token)
                    if ok if ok is not None else self.may_follow(last[start], token):
                        break
                start += 1
            last.append(token)
            count.append(count[start] + 1)
        return data, last, count

    def chunks(self, text: str) -> list[str]:
        """A text's chunks: special strings, and runs that end before white space."""
        if not any(t in text for t in self.special):
            return self.chunk.findall(text)
        marks = iter(self.cut.findall(text))
        return [c for part in self.cut.split(text) for c in (*self.chunk.findall(part), next(marks, "")) if c]

    def learn(self, chunks: set[str]) -> None:
        """Set totals of these chunks. Their pieces go through the table in sorted order, so that shared prefixes are worked out once."""
        if len(self.totals) > KEPT_CHUNKS:
            self.totals.clear()
        new = [c for c in chunks if c not in self.totals]
        pieces = {c: [p.encode() for p in self.piece.findall(c)] for c in new if c not in self.special}
        done, state = {}, (b"", [-1], [0])
        for data in sorted({p for own in pieces.values() for p in own}):
            state = self.piece_counts(data, state)
            done[data] = state[2][-1]
        for c in new:
            self.totals[c] = sum(map(done.__getitem__, pieces[c])) if c in pieces else 1

    def table(self, text: str) -> np.ndarray:
        """Exact token counts of all prefixes: entry n is that of text[:n].

        The cells of a piece follow from those before it, so each byte is looked at once. Where a prefix is not cut as the
        whole text is, its own piece is worked out: inside white space, which is one piece up to the prefix's end, inside a
        contraction, and inside a special string, which is plain text until it is complete."""
        out = np.zeros(len(text) + 1, np.int32)
        start = 0
        for m in [*self.cut.finditer(text), None]:
            end = m.start() if m else len(text)
            plain = text[start : m.end() - 1] if m else text[start:]
            self._fill(out, start, plain)
            if m:
                out[m.end()] = out[end] + 1
                start = m.end()
        return out

    def _fill(self, out: np.ndarray, start: int, plain: str) -> None:
        """Counts of the prefixes that end in a stretch of plain text, from the one that ends before it."""
        first, state = int(out[start]), (b"", [-1], [0])
        done = np.zeros(len(plain) + 1, np.int32)  # tokens of the pieces up to a place where a piece of the whole stretch ends
        for m in self.piece.finditer(plain):
            i, j = m.span()
            state = self.piece_counts(m[0].encode(), state)
            counts = np.array(state[2], np.int32)
            ends = np.cumsum([len(c.encode()) for c in m[0]])
            done[i + 1 : j + 1] = done[i] + counts[ends]
            if m[0][0] == "'" and j - i > 1 and m[0][1].isalpha():  # cut short, the mark and the letters are two pieces
                for n in range(i + 1, j):
                    done[n] = done[i] + len(self.merged(b"'")) + (len(self.merged(plain[i + 1 : n].encode())) if n > i + 1 else 0)
        cut_alike = np.ones(len(plain) + 1, bool)
        for m in self.blank.finditer(plain):  # white space, with the one that the next piece would begin with
            i, j = m.span()
            _, _, counts = self.piece_counts(m[0].encode())
            ends = np.cumsum([len(c.encode()) for c in m[0]])
            out[start + i + 1 : start + j + 1] = first + done[i] + np.array(counts, np.int32)[ends]
            cut_alike[i + 1 : j + 1] = False
        at = np.flatnonzero(cut_alike[1:]) + 1
        out[start + at] = first + done[at]

    def total(self, texts: list[str]) -> list[int]:
        """The last entry of each text's table."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut))
        total = self.totals.__getitem__
        return [sum(map(total, c)) for c in cut]

    @staticmethod
    def longest_prefix(table: np.ndarray, budget: int) -> int:
        """The most characters n with text[:n] within a budget of tokens, from the text's table; a shorter prefix may be over it."""
        return int(np.flatnonzero(np.asarray(table) <= budget)[-1]) if budget >= 0 else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One for each vocabulary in a worker."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, tables: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether they go over a limit; a null text counts as empty.

    One row for each input row, repeated or null ids included; no shuffle, and no more memory than one batch and the
    bounded caches. vocabulary: path of a tokenizers .json file, the same on every executor. tables: also return the
    prefix table as the array prefix_tokens, one entry more than the text has characters: element n is the exact count of
    its first n characters, so truncations and budgets are looked up and nothing is encoded again. The columns of the result are
    id_col, n_bytes, n_tokens and over_limit; other columns of docs do not matter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, 2000, 4 << 20 if tables else 32 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = [own.table(t) for t in texts] if tables else []
                totals = [int(m[-1]) for m in made] if tables else own.total(texts)
                out = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())]
                if tables:
                    out.append(pa.array(made, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", "over_limit", *["prefix_tokens"] * tables]
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_tokens array<int>" * tables
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, schema)
