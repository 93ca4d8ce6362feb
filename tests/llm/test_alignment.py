"""Alignment against a plain version that uses the other library for the byte-level vocabulary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import alignment as A
from tidemark.llm.llm_queries import op11_alignment, vocabulary
from tidemark.llm.token_counts import byte_letters

FILES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(FILES[0])
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain_groups(text, libraries):
    """[(a ids, b ids)] of a text, or none."""
    if not text:
        return []
    own, model = libraries
    letters = byte_letters()
    a = own.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    bytes_a = [bytes(letters[c] for c in own.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
    ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def plain(texts, libraries):
    groups = [plain_groups(t, libraries) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for own in groups:
        links = [(a[-1], b[-1]) for a, b in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        sizes = (sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links))
        out.append((*sizes, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text))
    return out, counts


AWKWARD = ["a▁b", "<|endoftext|>x<s></s><0x41>", "\x00 \x01", "tabs\t\tand\n\n\nlines  ", " ", "   lead", "汉字 カナ 한글 ไทย", "🙂🙃 é é", "ﬁ ① Å", "a" * 5000, "don't we'll IT'S", "\r\n\r\n", "1234567 8.9e10"]


def test_same_as_plain(docs, corpus, spark, libraries):
    """Nulls, empty texts, repeated rows and ids, clashing columns, and texts that one tokenizer does not spell."""
    rows = [(i, t) for i, t in corpus] + [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    df = docs.select("doc_id", "text", "lang", "id").union(spark.createDataFrame([(i, t, "n_a", 0) for i, t in rows[len(corpus) :]], "doc_id long, text string, lang string, id long"))
    got = A.align(df, *FILES).collect()
    want, counts = plain([t for _, t in rows], libraries)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert any(w[0] == 0 and t for w, (_, t) in zip(want, rows, strict=True))  # one that is not spelt byte for byte
    table = A.pair_table(df, *FILES).collect()
    assert {(r["a"], r["b"]): r["n"] for r in table} == counts


def test_query_over_the_whole_table(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r["text"] for r in docs], libraries)
    digest = lambda w: hashlib.sha256(w[6].encode()).hexdigest() if w[0] else ""
    got = op11_alignment(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *w[:6], digest(w)) for r, w in zip(docs, want, strict=True))


def test_units_are_encoded_as_the_whole_text(libraries):
    """Texts of odd white space, letters and marks: units join to the text, and their tokens to its tokens in both libraries."""
    own, model = libraries
    r = random.Random(4)
    signs = [" ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "a", "B", "the", "'s", "'ll", "12", ".", ",", "é", "e\u0301", "ß", "汉", "ไ", "🙂", "\u200b", "\x00", "_"]  # a text with the mark of spaces itself is not spelt, whatever its units
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 14)))
        units = A.CUT.findall(f" {text}")
        assert "".join(units) == f" {text}" and all(u[0] == " " for u in units)
        assert [i for u in units for i in own.encode(u, add_special_tokens=False).ids] == own.encode(f" {text}", add_special_tokens=False).ids
        assert [i for u in units for i in model.encode(u[1:]) or [model.piece_to_id("▁")]] == model.encode(text), units


def test_forgetting_units_changes_nothing(spark, libraries, docs, monkeypatch):
    own = A.aligner(*FILES)
    units = A.Units(own, A.pair_index(*FILES))
    monkeypatch.setattr(A, "KEPT_UNITS", 3)
    for text in ("a b c d e", "e d c b a", "a\n b"):
        at, ends = units.of([text, None, ""])
        assert b";".join(units.groups[i] for i in at) == plain([text], libraries)[0][0][6].encode() and ends.tolist() == [0, len(at), len(at), len(at)]


def test_no_rows(no_docs):
    assert A.align(no_docs, *FILES).collect() == []


def test_vectors_are_added_in_a_tree(spark, monkeypatch):
    """More tasks than a node takes: two levels, and the counts of all."""
    df = spark.createDataFrame([(i, "the cat sat") for i in range(90)], "doc_id long, text string").repartition(40)
    got = A.align(df, *FILES).collect()
    assert {r["count_sum"] for r in got} == {90 * got[0]["n_links"]} and got[0]["n_best"] == got[0]["n_links"] == 3


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**62, n)).astype(np.uint64)
        own = A.PerfectHash(keys)
        assert sorted(own.numbers(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        A.PerfectHash(np.array([5, 5], np.uint64))


def test_a_pair_that_cannot_be_is_refused():
    index = A.PairIndex(np.arange(100), np.arange(100))
    assert sorted(index.places(np.arange(100), np.arange(100)).tolist()) == list(range(100))
    with pytest.raises(KeyError):
        index.places(np.array([1]), np.array([2]))
