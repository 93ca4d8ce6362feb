import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, llm_queries, quality, topk


def brute_top(rows, k, divisor):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, z in {i: z for i, z in good if i % divisor == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(z, y, strict=False)), i) for i, y in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(12) * (1 + i % 7)]) for i in range(400)]
    rows += [(i, rows[10][1]) for i in range(400, 520)] + [(600, None), (601, [1.0, None]), (602, [float("nan")]), (603, [float("inf")]), (605, [1.0, 2.0]), (610, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label int, norm double").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("id") % 5 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(df, F.col("id") == 0, 5).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("false"), F.col("id") == 0, 5).collect() == []


ITEM = "The quick brown foxes jumped over twelve lazy dogs while nobody near the old river was looking at them, strange as that may seem today"


def plain_tiles(item, text, least):
    """Greedy string tiling by comparing every pair of places."""
    mi, mt, covered = set(), set(), 0
    while True:
        best = []
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in mi and t + n not in mt:
                    n += 1
                best.append((n, t, i))
        longest = max((b[0] for b in best), default=0)
        if longest < least:
            return covered
        for n, t, i in sorted(b for b in best if b[0] == longest):
            if not mi & set(range(i, i + n)) and not mt & set(range(t, t + n)):
                mi |= set(range(i, i + n))
                mt |= set(range(t, t + n))
                covered += n


def test_tiles_equal_the_plain_way():
    r = random.Random(2)
    for _ in range(150):
        item = [r.randint(1, 4) for _ in range(r.randint(0, 25))]
        text = [r.randint(1, 4) for _ in range(r.randint(0, 30))]
        tiles = decontam.tile(item, text, 3)
        assert all(item[i : i + n] == text[t : t + n] for i, t, n in tiles)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles)
        assert sum(n for *_, n in tiles) == plain_tiles(item, text, 3)


def test_contaminated_documents_are_found(spark, docs, corpus):
    w = ITEM.split()
    planted = {1000: ITEM, 1001: "x " * 50 + ITEM.upper().replace(",", " ;") + " y" * 50, 1002: " ".join(w[12:] + ["pause"] + w[:12]), 1003: " ".join(w[:8]), 1004: " ".join(sorted(w))}
    bench = spark.createDataFrame([(1, ITEM, "t"), (2, "too short", "t"), (3, None, "t"), (4, "", "t")], "item_id long, text string, doc_id string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in decontam.contaminated(more, bench).collect()}
    assert set(got) == {1000, 1001, 1002} and got[1000]["coverage"] == 1.0 and got[1002]["n_tiles"] == 2 and got[1000]["longest_tile"] == len(w)


def test_a_benchmark_in_blocks_gives_the_same(spark, docs, monkeypatch):
    bench = docs.where("doc_id in (60, 61, 75, 5, 6, 7)").select(F.col("doc_id").alias("item_id"), "text")
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["matched_tokens"]) for r in df.where("doc_id is not null").collect())
    whole = key(decontam.contaminated(docs, bench))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 700)
    assert key(decontam.contaminated(docs, bench)) == whole and whole


def test_nothing_to_compare(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).collect() == []
    assert decontam.contaminated(no_docs, none).collect() == []


def test_seed_bound_never_hides_a_match():
    items = decontam.Items([1], [ITEM], 5)
    assert items.match(pa.array([ITEM, None, "", ITEM[:60]], pa.string()), 0.9)[0][:3] == (0, 0, len(ITEM.split()))


def naive_phrases(own, lang, text):
    """Cross-parsing of one text by the automaton, character by character."""
    k = own.names.index(lang)
    codes, phrases = own.codes(text.lower()).tolist(), 0
    for s in range(0, len(codes), langid.CHUNK):
        state = own.start[k]
        for c in codes[s : s + langid.CHUNK]:
            to = int(own.table[state + c])
            if not to:
                phrases += 1
                to = int(own.first[k][c])
            state = to
        phrases += 1
    return phrases


def test_automaton_knows_all_substrings_and_no_others():
    r = random.Random(3)
    seq = [r.randint(1, 3) for _ in range(60)]
    steps = langid.suffix_automaton(seq)
    subs = {tuple(seq[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for _ in range(500):
        probe = [r.randint(1, 3) for _ in range(r.randint(1, 6))]
        state = 0
        for c in probe:
            state = steps[state].get(c, -1)
            if state < 0:
                break
        assert (state >= 0) == (tuple(probe) in subs)


def test_lanes_count_what_one_by_one_does():
    own = langid.Languages((("aa", "hello there my friends, hello again"), ("bb", "guten tag meine freunde")))
    texts = ["hello friends", "tag", "x", "zz 99 tag hello " * 200, "über"]
    made, _ = own.phrases(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(own.names):
            assert made[i, k] == naive_phrases(own, lang, t)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = llm_queries.op9_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_texts(spark, docs, no_docs):
    learned = langid.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, learned).collect()}
    assert got[90] == got[91] == got[92] == "und" and got[1] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs, ()).collect()} == {"und"}
    assert langid.learn(no_docs) == () and langid.identify(no_docs, learned).collect() == []


def test_held_out_rows_are_those_of_the_contract(spark, sf_dir):
    for r in llm_queries.op9_language_id(spark, sf_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_gradients():
    net = quality.ByteNetwork.fresh(3)
    data, y = [b"good words here. " * 20, b"### $$$ " * 60, b""], np.array([1.0, 0.0, 1.0])
    grads = net._gradients(data, y, np.ones(3))

    def loss():
        net.pairs = None
        p = net.score(data)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name in ("filter", "hidden", "out", "mixing", "embed"):
        w = net.w[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, eps = w[at], 3e-3
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(grads[name][at]), rel=0.25, abs=2e-3)


def test_chunks_cover_every_byte():
    data = [b"", b"a" * 63, b"b" * 1000, b"c" * 256]
    flat, first, owner = quality.chunked(data)
    for i, d in enumerate(data):
        blocks = sorted({int(f) + j for f, o in zip(first, owner, strict=True) if o == i for j in range(quality.BLOCKS)})
        own = np.concatenate([flat[b * quality.BLOCK : (b + 1) * quality.BLOCK] for b in blocks]).tobytes()
        assert own.rstrip(b"\0") == d and blocks == list(range(blocks[0], blocks[-1] + 1))


def test_a_text_scores_the_same_alone_and_in_a_batch():
    r = np.random.default_rng(4)
    own = quality.ByteNetwork.fresh()
    data = [b"", *(r.integers(1, 256, n, np.uint8).tobytes() for n in (0, 1, 63, 253, 256, 300, 382, 384, 1000)), b""]
    alone = [float(own.score([d])[0]) for d in data]
    assert own.score(data) == pytest.approx(alone, abs=1e-6)
    assert own.score(data[::-1]) == pytest.approx(alone[::-1], abs=1e-6)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = llm_queries.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_quality_of_awkward_texts(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights = quality.fit(docs, labels)
    assert weights == quality.fit(docs.repartition(5), labels)
    rows = quality.classify(docs, weights).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.classify(no_docs, quality.fit(no_docs, labels)).collect() == []


def test_null_ids_take_no_part_in_a_search(spark):
    from tidemark.llm import topk

    big = 2**53 + 1
    rows = [(None, [1.0, 1.0]), (big, [1.0, 0.0]), (big + 1, [0.5, 0.5]), (50, [1.0, 0.25]), (50, [1.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") == 50, k=5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, big, 256 * 256), (2, big + 1, 128 * 256 + 128 * 64)]


def test_letters_of_large_alphabets_tell_languages_apart():
    from tidemark.llm import langid

    r = random.Random(4)
    letters = {"x": range(0x4E00, 0x4E00 + 900), "y": range(0x4E00 + 900, 0x4E00 + 1800)}
    text = lambda n, size: "".join(chr(r.choice(letters[n])) for _ in range(size))
    phrases = {n: [text(n, 4) for _ in range(60)] for n in letters}
    made = lambda n, k: " ".join(r.choice(phrases[n]) for _ in range(k))
    own = langid.Languages((("x", made("x", 400)), ("y", made("y", 400))))
    assert own.predict([made("x", 30), made("y", 30)])[0] == ["x", "y"]


def test_an_item_without_id_is_reported(spark):
    from tidemark.llm import decontam

    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "so it goes " + item), (2, "nothing of it")], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(None, item), (3, "quite another item of some words")], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, None)]
