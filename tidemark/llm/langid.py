"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, which knows every substring of it. A text is parsed from left
to right into the longest phrases that a language's automaton can follow; phrases times the bits that a place in that
language's text takes, for each character, estimate the cross-entropy. The language with the fewest bits wins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

SAMPLE_DOCS, SAMPLE_CHARS = 64, 60_000  # of each language: labelled documents at most, and whole documents until there are as many characters
LETTERS, SHARED = 62, 32  # letters with a code of their own, the commonest of the samples, and codes that all other letters share, by their number
CHUNK = 1024  # characters parsed as one lane; a phrase ends where a lane does, in every language alike


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of a sequence; state 0 is the start, which nothing leads to."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


class Languages:
    """Automata of all languages in one table: table[state + code] is the next state (states count in steps of a row), 0 where the phrase ends."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.names = sorted({lang for lang, _ in samples})
        texts = {lang: "\n".join(t.lower() for n, t in samples if n == lang) for lang in self.names}
        common = [c for c, _ in sorted(Counter("".join(texts.values())).items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:LETTERS]
        self.code_of = np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), 0, 1).astype(np.int32)
        rare = np.flatnonzero(self.code_of == 0)
        self.code_of[rare] = 2 + LETTERS + rare % SHARED
        self.code_of[[ord(c) for c in common]] = np.arange(2, len(common) + 2)
        self.width = 2 + LETTERS + SHARED
        rows, self.start, self.bits = [{}], [], []
        for lang in self.names:
            steps = suffix_automaton(self.codes(texts[lang]).tolist())
            base = len(rows)
            self.start.append(base * self.width)
            self.bits.append(np.log2(max(len(texts[lang]), 2)))
            rows += [{c: base + to for c, to in s.items() if c} for s in steps]
        self.table = np.zeros(len(rows) * self.width, np.int32)
        at = np.fromiter((i * self.width + c for i, s in enumerate(rows) for c in s), np.int64)
        self.table[at] = np.fromiter((to * self.width for s in rows for to in s.values()), np.int64, len(at))
        self.first = np.stack([self.table[s : s + self.width] for s in self.start]) if self.names else np.zeros((0, self.width), np.int32)
        self.first = np.where(self.first == 0, np.array(self.start, np.int32)[:, None], self.first)

    def codes(self, text: str) -> np.ndarray:
        """1 for a run of anything but letters, from 2 on for letters."""
        c = self.code_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.delete(c, np.flatnonzero((c[1:] == 1) & (c[:-1] == 1)) + 1)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and characters of each text; all lanes go one character ahead at a time."""
        codes = [self.codes(t.lower()) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        lanes = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(sizes) - sizes)[owner] + within * CHUNK
        length = np.minimum(CHUNK, sizes[owner] - within * CHUNK)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        grid = np.zeros((CHUNK, len(owner)), np.int32)
        flat = np.append(flat, np.zeros(CHUNK, np.int32))
        for i in range(0, len(owner), 256):
            grid[:, i : i + 256] = flat[begin[i : i + 256][None, :] + np.arange(CHUNK)[:, None]]
        count = np.zeros((len(self.names), len(owner)), np.int32)
        for k, (start, first) in enumerate(zip(self.start, self.first, strict=True)):
            state, found = np.full(len(owner), start, np.int32), count[k]
            live = len(owner) - np.searchsorted(length[::-1], np.arange(CHUNK), side="right")  # lanes longer than the step
            for step in range(int(length[0]) if len(length) else 0):
                n = live[step]
                c = grid[step, :n]
                to = self.table[state[:n] + c]
                ended = to == 0
                found[:n] += ended
                state[:n] = np.where(ended, first[c], to)
        total = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            total[:, k] = np.bincount(owner, count[k] + 1, len(texts))  # and the phrase that is open at a lane's end
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.names and lettered:
            made, _ = self.phrases([texts[i] for i in lettered])
            bits = made * np.array(self.bits)
            order = np.argsort(bits, axis=1, kind="stable")
            for i, row, o in zip(lettered, bits, order, strict=True):
                names[i] = self.names[o[0]]
                scores[i] = float(1 - row[o[0]] / row[o[1]]) if len(o) > 1 else 1.0
        return names, scores


@lru_cache(maxsize=2)
def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(samples)


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple[str, str], ...]:
    """Labelled text, whole documents of at most SAMPLE_CHARS characters each and together for each language (or the first alone)."""
    usable = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("lang is not null and length(text) > 0").where(F.length("text") <= SAMPLE_CHARS)
    out, used = [], Counter()
    for r in bounded_sample(usable, "lang", SAMPLE_DOCS, "id").select("lang", "text", "_rank").orderBy("lang", "_rank").collect():
        if not used[r[0]] or used[r[0]] + len(r[1]) <= SAMPLE_CHARS:
            out.append((r[0], r[1]))
            used[r[0]] += len(r[1])
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: id_col, lang_pred and score, the share of bits by which it beats the next.

    Texts that are null or without letters, and all texts if nothing was learned, are `und` with score 0. One row for
    each input row, null or repeated ids included; other columns do not matter. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by languages * SAMPLE_CHARS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = languages(sent.value)
        for batch in batches:
            start = 0
            texts = batch.column(1).to_pylist()
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= 4 << 20):
                    size += len(texts[stop] or "")
                    stop += 1
                names, scores = own.predict(texts[start:stop])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(names), pa.array(scores)], names=[id_col, "lang_pred", "score"])
                start = stop

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")
