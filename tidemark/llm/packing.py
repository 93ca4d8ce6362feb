"""Vector bin packing of examples into fixed-length training sequences.

An example makes demands on three limits of a sequence at once: tokens, segments and loss-bearing tokens. Sequences are
filled one at a time: of the examples that fit, the one whose demand has the largest dot product with the room that is
left goes in, each dimension weighed by how much the waiting examples ask of it. When none fits, one is cut so that the
sequence ends up full. Every task packs the rows of its own partition as they stream by, with a bounded pool."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_coded

POOL = 768  # examples that wait in a task; more of them pad less and take longer
KEPT_PARTS, KEPT_BYTES = 250_000, 32 << 20  # parts of words whose ids a worker keeps, and their bytes; all are dropped when there are more
TAIL = ".,!?;:|%&$*#"  # punctuation that follows a word's letters


class Packer:
    """Packs a stream of (key, tokens, loss tokens); the loss-bearing tokens of an example are its last ones.

    Pieces come out as (key, start, length, sequence, offset), sequences counted from first_sequence on. At the end of
    the stream the rest, less than one sequence, goes into sequences whose lengths are powers of two."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int = 0, pool: int = POOL) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limit, self.sequence, self.size = (tokens, segments, loss), first_sequence, pool
        self.keys: list = [None] * (pool + 1)
        self.at = np.zeros((3, pool + 1), np.int64)  # start, end and where loss begins of what is left of each example
        self.n = 0

    def add(self, key, tokens: int, loss: int) -> list[tuple]:
        """Take an example; give the pieces that are settled now."""
        out, start, learns = [], 0, tokens - min(max(loss, 0), tokens)
        most, _, most_loss = self.limit
        while tokens - start >= most:
            take = min(most, max(learns - start, 0) + most_loss)
            if take < most:  # the loss limit binds: let it share a sequence with others
                break
            out.append((key, start, take, self.sequence, 0))
            self.sequence, start = self.sequence + 1, start + take
        if start < tokens:
            self.keys[self.n] = key
            self.at[:, self.n] = start, tokens, learns
            self.n += 1
            while self.n > self.size:  # a sequence of cuts alone frees no place
                out += self._fill(self.limit[0])
        return out

    def finish(self) -> list[tuple]:
        out = []
        while self.n:
            rest = int((self.at[1, : self.n] - self.at[0, : self.n]).sum())
            out += self._fill(self.limit[0] if rest >= self.limit[0] else 1 << (rest.bit_length() - 1))
        return out

    def _drop(self, i: int) -> None:
        self.n -= 1
        self.keys[i], self.at[:, i] = self.keys[self.n], self.at[:, self.n]
        self.keys[self.n] = None

    def _fill(self, tokens: int) -> list[tuple]:
        out, offset, room, segments, loss_room = [], 0, tokens, self.limit[1], self.limit[2]
        start, end, learns = self.at[:, : self.n]
        weight_t, weight_l = (end - start).mean() / self.limit[0] ** 2, (end - np.maximum(start, learns)).mean() / self.limit[2] ** 2
        while self.n and room and segments:
            start, end, learns = self.at[:, : self.n]
            length, loss = end - start, end - np.maximum(start, learns)
            score = weight_t * room * length + weight_l * loss_room * loss  # the segment demand is 1 for each of them
            score[(length > room) | (loss > loss_room)] = -1
            i = int(score.argmax())
            if score[i] < 0:  # cut the longest
                i = int(length.argmax())
                take = min(room, int(length[i]), max(int(learns[i] - start[i]), 0) + loss_room)
                if not take:
                    before_loss = np.minimum(np.maximum(learns - start, 0), room)
                    i = int(before_loss.argmax())
                    take = int(before_loss[i])
                    if not take:
                        break
            else:
                take = int(length[i])
            out.append((self.keys[i], int(start[i]), take, self.sequence, offset))
            loss_room -= max(0, int(start[i]) + take - max(int(start[i]), int(learns[i])))
            offset, room, segments = offset + take, room - take, segments - 1
            self.at[0, i] += take
            if self.at[0, i] == self.at[1, i]:
                self._drop(i)
        self.sequence += 1
        return out


def one_piece(head: str) -> bool:
    """Whether the tokenizer certainly makes one piece of letters: of alphabets that have been settled for long, which stay letters when they are composed and lower-cased."""
    plain = unicodedata.normalize("NFC", head)
    return plain.isalpha() and max(plain) < "\u0590" and plain.lower().isalpha()


def segments(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of flat, end to end."""
    before = np.cumsum(sizes) - sizes
    return flat[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)]


class WordEncoder:
    """Token ids of texts under a word-level BPE file.

    Its tokens never cross ASCII white space, so each distinct word of a batch is encoded once; letters followed by
    ASCII punctuation are two pieces to the tokenizer, so the two parts are looked up apart. A file with other rules is refused."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.kept = 0
        probe = "Letters, caf\u00e9. \u0130!? 12%x \u0915\u093c! don't <|endoftext|>. \u039f\u0394\u039f\u03a3. a\u00a0b,c"
        ids, _ = self.encode(pa.array([probe]))
        if ids.tolist() != self.library.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not part words at white space, or letters from punctuation")

    def _together(self, heads: list[str]) -> list[bytes]:
        """Letters go through the library as a text of many words; each is one piece there."""
        out = []
        for i in range(0, len(heads), 4096):
            some = heads[i : i + 4096]
            made = self.library.encode(" ".join(some), add_special_tokens=False)
            ids, places = np.array(made.ids, "<u4"), np.array(made.word_ids, np.int64)
            cuts = np.flatnonzero(np.diff(places)) + 1
            if len(cuts) + 1 != len(some):
                raise ValueError("letters without white space are not one piece each")
            ends, data = [0, *(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
            out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def _one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.array(m.ids, "<u4").tobytes() for m in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids(self, parts: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts end to end, and the size of each."""
        missing = [p for p in parts if p not in self.parts]
        if missing:
            made = encode(missing)
            self.parts.update(zip(missing, made, strict=True))
            self.kept += sum(map(len, missing)) + sum(map(len, made))
        own = [self.parts[p] for p in parts]
        return np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts."""
        if len(self.parts) > KEPT_PARTS or self.kept > KEPT_BYTES:
            self.parts.clear()
            self.kept = 0
        names, index, ends = split_coded(texts)
        heads = pc.utf8_rtrim(names, characters=TAIL)
        plain = pc.string_is_ascii(heads)
        good = pc.and_(plain, pc.ascii_is_alpha(heads))
        other = pc.and_(pc.invert(plain), pc.utf8_is_alpha(heads))
        coded = heads.filter(other).dictionary_encode()
        fine = np.zeros(len(heads), bool)
        fine[np.flatnonzero(other.to_numpy(zero_copy_only=False))] = np.array([one_piece(h) for h in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
        whole = pc.invert(pc.or_(good, pa.array(fine)))
        heads = pc.if_else(whole, "", pc.if_else(plain, pc.ascii_lower(heads), heads)).dictionary_encode()
        tails = pc.struct_field(pc.extract_regex(names, pattern=f"(?P<tail>[{TAIL}]*)$"), "tail").cast(names.type)
        tails = pc.if_else(whole, names, pc.fill_null(tails, "")).dictionary_encode()
        self.parts.setdefault("", b"")
        (one, n_one), (two, n_two) = self._ids(heads.dictionary.to_pylist(), self._together), self._ids(tails.dictionary.to_pylist(), self._one_by_one)
        start_one, start_two = np.cumsum(n_one) - n_one, np.cumsum(n_two) - n_two + len(one)
        h, t = heads.indices.to_numpy(), tails.indices.to_numpy()
        starts, sizes = (np.stack(x, 1).ravel() for x in ((start_one[h], start_two[t]), (n_one[h], n_two[t])))
        words, lengths = segments(np.concatenate((one, two)), starts, sizes), sizes[::2] + sizes[1::2]
        begin, lengths = (np.cumsum(lengths) - lengths)[index], lengths[index]
        return segments(words, begin, lengths), np.concatenate(([0], np.cumsum(lengths)))[ends]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def pack(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, tokens: int = 2048, segments: int = 64, loss: int = 2048) -> DataFrame:
    """Pack examples of known sizes: one row for each piece, with id_col, start, length, sequence_id and offset.

    Examples without tokens (or with a null size) have no piece. Sequence ids are unique over all tasks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokens, segments, loss, _first_sequence())
        for batch in batches:
            sizes = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield of([p for key, n, m in sizes for p in packer.add(key, n or 0, m or 0)], batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if packer.n:
            yield of(packer.finish(), kind)

    def of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    names = [id_col, "start", "length", "sequence_id", "offset"]
    kind = examples.schema[id_col].dataType.simpleString()
    return examples.select(id_col, F.col(tokens_col).cast("long"), F.col(loss_col).cast("long")).mapInArrow(place, f"`{id_col}` {kind}, start long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, tokens: int = 2048, segments: int = 64, loss: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, end each with end_id, and pack them; every token bears loss.

    A null text counts as empty and is packed as its end_id alone; repeated rows are packed once for each row. Other
    columns do not matter. One row for each piece: id_col, start, length, ids_crc32 (of its ids, little-endian unsigned
    32-bit), doc_tokens, sequence_id and offset."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, waiting, row, kind = encoder(vocabulary), Packer(tokens, segments, loss, _first_sequence()), {}, 0, None
        end = np.array([end_id], "<u4").tobytes()

        def of(pieces: list[tuple]) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], [], [], []]
            for key, start, length, sequence, offset in pieces:
                doc, data, left = waiting[key]
                for c, v in zip(columns, (doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, sequence, offset), strict=True):
                    c.append(v)
                if left == length:
                    del waiting[key]
                else:
                    waiting[key] = doc, data, left - length
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, 2000, 2 << 20):
                ids, ends = own.encode(part.column(1))
                pieces = []
                for doc, a, b in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                    waiting[row] = doc, ids[a:b].tobytes() + end, b - a + 1
                    pieces += packer.add(row, b - a + 1, b - a + 1)
                    row += 1
                yield of(pieces)
                del ids, ends
                pa.default_memory_pool().release_unused()  # a worker is used again by other stages
        if waiting:
            yield of(packer.finish())

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(place, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
