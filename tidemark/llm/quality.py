"""Quality classifier: a convolutional network over bytes, trained and run in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole document. Each filter's largest response
in a chunk goes through a small hidden layer to a chunk score; the mean, largest and smallest chunk scores give one
probability. Filters are FILTER_WIDTH bytes wide and work on learned byte embeddings; for scoring, embedding and filter
are multiplied out into tables for pairs of bytes, so a response is the sum of two table rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

FILTERS, FILTER_WIDTH, EMBEDDING, HIDDEN = 16, 4, 8, 12
BLOCK, BLOCKS = 64, 4  # a chunk is BLOCKS blocks of BLOCK bytes; the next begins two blocks on
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 4 << 20  # labelled documents of each label at most, and their bytes
EPOCHS, BATCH, RATE = 12, 32, 0.01


def chunked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole blocks, with a block of zeros after it so that no filter reads the next text, and FILTER_WIDTH - 1 more at the very end; for each chunk its first block and its text."""
    counts = np.array([max(BLOCKS, -(-len(d) // BLOCK)) for d in data], np.int64)
    counts += counts % 2
    flat = np.zeros((counts.sum() + len(data)) * BLOCK + FILTER_WIDTH - 1, np.uint8)
    starts = (np.cumsum(counts + 1) - counts - 1) * BLOCK
    for d, s in zip(data, starts.tolist(), strict=True):
        flat[s : s + len(d)] = np.frombuffer(d, np.uint8)
    chunks = (counts - BLOCKS) // 2 + 1
    owner = np.repeat(np.arange(len(data)), chunks)
    first = starts[owner] // BLOCK + 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    return flat, first, owner


class ByteNetwork:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.pairs: list[np.ndarray] | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteNetwork:
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls({"embed": n(256, EMBEDDING, scale=0.5), "filter": n(FILTER_WIDTH, EMBEDDING, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32), "hidden": n(FILTERS, HIDDEN, scale=0.4), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN, scale=0.4), "out_bias": np.zeros(1, np.float32), "mixing": np.array([1, 0.3, 0.3, 0], np.float32)})

    def taps(self) -> np.ndarray:
        return np.einsum("be,jef->jbf", self.w["embed"], self.w["filter"])

    def block_peaks(self, flat: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each block; the last positions of a block reach into what follows."""
        if self.pairs is None:
            t = self.taps().astype(np.float32)
            self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, FILTER_WIDTH, 2)]
        two = flat[:-1].astype(np.int32) << 8 | flat[1:]
        n = (len(flat) - FILTER_WIDTH + 1) // BLOCK
        out = np.empty((n, FILTERS), np.float32)
        for s in range(0, n, 256):  # so much at a time stays in the processor's cache
            e = min(n, s + 256)
            r = self.pairs[0][two[s * BLOCK : e * BLOCK]]
            for j in range(1, len(self.pairs)):
                r += self.pairs[j][two[s * BLOCK + 2 * j : e * BLOCK + 2 * j]]
            out[s:e] = r.reshape(e - s, BLOCK, FILTERS).max(1)
        return out + self.w["bias"]

    def _head(self, pooled: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """pooled: peaks of each chunk. Hidden layer, chunk scores, and mean, largest and smallest for each text."""
        act = np.maximum(pooled, 0)
        hidden = np.maximum(act @ self.w["hidden"] + self.w["hidden_bias"], 0)
        score = hidden @ self.w["out"] + self.w["out_bias"]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(starts, len(owner)))
        mean, top, low = np.add.reduceat(score, starts) / counts, np.maximum.reduceat(score, starts), np.minimum.reduceat(score, starts)
        m = self.w["mixing"]
        return act, hidden, score, counts, mean, top, low, m[0] * mean + m[1] * top + m[2] * low + m[3]

    def score(self, data: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, from all of its bytes; an empty text is one chunk of zeros."""
        if not data:
            return np.zeros(0)
        flat, first, owner = chunked(data)
        peaks = self.block_peaks(flat)
        pooled = peaks[first]
        for i in range(1, BLOCKS):
            pooled = np.maximum(pooled, peaks[first + i])
        return 1 / (1 + np.exp(-np.clip(self._head(pooled, owner)[-1].astype(np.float64), -40, 40)))

    def train(self, data: list[bytes], labels: np.ndarray, seed: int = 7) -> ByteNetwork:
        """Adam on the log loss, both labels weighed alike; gradients reach a filter where its response was largest."""
        r, step = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        share = np.clip(labels.mean(), 0.01, 0.99)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        by_size = np.argsort([len(d) for d in data], kind="stable")
        for epoch in range(EPOCHS):
            order = by_size if epoch == 0 else r.permutation(len(data))
            for s in range(0, len(order), BATCH):
                own = order[s : s + BATCH]
                grads = self._gradients([data[i] for i in own], labels[own], weight[own])
                step += 1
                rate = RATE * min(1, step / 30) * (1 - epoch / EPOCHS * 0.8)
                for k, g in grads.items():
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.w[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self.pairs = None
        return self

    def _gradients(self, data: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        flat, first, owner = chunked(data)
        taps = self.taps()
        n = len(flat) - FILTER_WIDTH + 1
        response = taps[0][flat[:n]]
        for j in range(1, FILTER_WIDTH):
            response += taps[j][flat[j : j + n]]
        blocks = response.reshape(-1, BLOCK, FILTERS)
        where = blocks.argmax(1)
        peaks = np.take_along_axis(blocks, where[:, None, :], 1)[:, 0, :] + self.w["bias"]
        stack = np.stack([peaks[first + i] for i in range(BLOCKS)])
        which = stack.argmax(0)
        pooled = np.take_along_axis(stack, which[None], 0)[0]
        at = (first[:, None] + which) * BLOCK + np.take_along_axis(np.stack([where[first + i] for i in range(BLOCKS)]), which[None], 0)[0]
        act, hidden, score, counts, mean, top, low, logit = self._head(pooled, owner)
        d_logit = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        m, w = self.w["mixing"], self.w
        d_score = m[0] * (d_logit / counts)[owner] + m[1] * d_logit[owner] * (score == top[owner]) + m[2] * d_logit[owner] * (score == low[owner])
        g = {"mixing": np.array([(d_logit * x).sum() for x in (mean, top, low, np.ones_like(mean))]), "out": hidden.T @ d_score, "out_bias": np.array([d_score.sum()])}
        d_hidden = np.outer(d_score, w["out"]) * (hidden > 0)
        g |= {"hidden": act.T @ d_hidden + 1e-4 * w["hidden"], "hidden_bias": d_hidden.sum(0)}
        d_pooled = (d_hidden @ w["hidden"].T) * (act > 0)
        g["bias"] = d_pooled.sum(0)
        g["filter"], g["embed"] = np.zeros_like(w["filter"]), np.zeros_like(w["embed"])
        for j in range(FILTER_WIDTH):
            seen = flat[at + j]  # chunk, filter
            grid = np.zeros((256, FILTERS))
            np.add.at(grid, (seen, np.arange(FILTERS)[None, :].repeat(len(seen), 0)), d_pooled)
            g["filter"][j] = w["embed"].T @ grid
            g["embed"] += grid @ w["filter"][j].T
        return g


@lru_cache(maxsize=2)
def network(weights: tuple[tuple[str, tuple[int, ...], bytes], ...]) -> ByteNetwork:
    return ByteNetwork({k: np.frombuffer(b, np.float32).reshape(s).copy() for k, s, b in weights})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """Weights learned from a bounded sample of labelled rows: SAMPLE_DOCS of each label and SAMPLE_BYTES of their text at most, whole texts.

    Texts of more than SAMPLE_BYTES // 8 characters are not in the sample, as one would fill it, nor are rows of repeated ids
    beyond 4 * SAMPLE_DOCS rows in all. An id with both labels counts as 0. Null texts count as empty. Without labelled rows the network stays as it began."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    few = bounded_sample(known, "_label", SAMPLE_DOCS, "_id").select("_id", "_label", "_rank")
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where(F.length("_text") <= SAMPLE_BYTES // 8)
    marked = texts.join(F.broadcast(few), F.col(id_col) == F.col("_id")).withColumns({"_n": F.octet_length("_text"), "_hash": F.xxhash64("_text")})
    # numbers come first and say which texts are within the bound; no other text comes to the driver
    sizes = marked.orderBy("_rank", "_label", "_text").limit(4 * SAMPLE_DOCS).select("_label", "_rank", "_hash", "_n").collect()
    used, chosen = {0: 0, 1: 0}, []
    for label, rank, digest, n in sizes:
        if used[label] + n <= SAMPLE_BYTES:
            used[label] += n
            chosen.append((label, rank, digest))
    times, data, y = Counter(chosen), [], []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(times), "_label int, _rank int, _hash long"))
    sample = marked.join(wanted, ["_label", "_rank", "_hash"]).groupBy("_label", "_rank", "_hash").agg(F.first("_text").alias("_text"))
    for r in sample.orderBy("_rank", "_label", "_text").collect():
        n = times[r["_label"], r["_rank"], r["_hash"]]
        data += [r["_text"].encode()] * n
        y += [r["_label"]] * n
    net = ByteNetwork.fresh()
    if data:
        net.train(data, np.array(y))
    return tuple((k, v.shape, v.astype(np.float32).tobytes()) for k, v in sorted(net.w.items()))


def classify(docs: DataFrame, weights: tuple, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: id_col, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Null texts are scored as empty ones. One row for each input row, null or repeated ids included; columns named in
    keep are carried along, others do not matter. No shuffle; the weights are some 10 kB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network(weights)
        for batch in batches:
            data, start = pc.fill_null(batch.column(0).cast(pa.binary()), b"").to_pylist(), 0
            while start < len(data):
                stop, size = start, 0
                while stop < len(data) and (stop == start or size + len(data[stop]) <= 2 << 20):
                    size += len(data[stop])
                    stop += 1
                s = net.score(data[start:stop])
                own = [c.slice(start, stop - start) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*carried, "score", "predicted"])
                start = stop

    carried = [id_col, *(c for c in keep if c != id_col)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", score double, predicted int"
    return docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in carried]).mapInArrow(run, schema)
