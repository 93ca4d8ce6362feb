import hashlib

import numpy as np

from tidemark.llm import substring_dedup as S


def brute(rows, window):
    """(id, n_words, n_removed, hash) of each row."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(docs, corpus):
    for window, anchor in ((13, 6), (5, 3)):
        got = S.remove_repeats(docs, window, anchor).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(corpus, window)


def test_texts_and_no_rows(docs, no_docs):
    for r in S.remove_repeats(docs, texts=True).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert S.remove_repeats(no_docs).collect() == []


def test_passages_follow_the_first_document():
    words = [b"a", b"b", b"c", b"d", b"e"]
    firsts = np.array([1, 1, 2, S.NONE, S.NONE])
    assert list(S.passages_of(words, firsts, 2)) == [(b" a b c ", 1), (b" c d ", 2)]


def test_every_occurrence_is_found_at_word_ends_only():
    found = S.locate([[b"xa", b"a", b"b", b"a", b"b"], [b"a", b"b"]], [5, 1], {b" a b ": 1})
    assert [f.tolist() for f in found] == [[False, True, True, True, True], [False, False]]


def test_least_anchors_agree_for_equal_runs():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 50, 300).astype(np.uint64)
    both = np.concatenate((words[100:140], words))
    at, _, least = S.least_anchors(both, np.array([0, 40, 340]), 13, 6)
    by = dict(zip(at.tolist(), least.tolist(), strict=True))
    assert all(by[k] == by[140 + k] for k in range(28))
