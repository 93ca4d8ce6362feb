"""Operators that SQL cannot express, whole, against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as plain_lines
from test_near_dedup import brute as plain_near
from test_search_and_models import ITEM, plain_tiles

from tidemark.llm import decontam, langid, line_dedup, llm_queries, near_dedup, packing, quality, topk


def plain_tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [t for w in words if (t := "".join(filter(str.isalnum, w)).lower())]


def plain_contaminated(rows, items, least=5, share=0.5):
    out = []
    for i, text in rows:
        own = plain_tokens(text)
        for k, item_text in items:
            item = plain_tokens(item_text)
            if len(item) >= least:
                covered = plain_tiles(item, own, least)
                if covered and covered >= share * len(item):
                    out.append((i, k, len(item), covered))
    return sorted(out, key=str)


def test_contaminated_like_all_pairs(spark, docs, corpus):
    """Items cut, moved, repeated, lowered and marked; a document's own text as an item; nulls and empty ones."""
    r, w = random.Random(12), ITEM.split()
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 2000]
    for i in range(2000, 2040):
        parts = [w[a : a + r.randint(3, 14)] for a in (r.randrange(len(w)) for _ in range(r.randint(1, 4)))]
        rows.append((i, " ; ".join(" ".join(p).upper() if r.random() < 0.3 else " ".join(p) for p in parts)))
    items = [(1, ITEM), (2, "too short"), (3, None), (4, ""), (5, " ".join(w[::-1])), (6, corpus[40][1]), (7, corpus[80][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench).select("doc_id", "item_id", "item_tokens", "matched_tokens").collect()
    want = plain_contaminated(rows, items)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 20


def plain_language(samples, text):
    """Bits of a text in each language: phrases found by searching the labelled text itself."""
    plain = lambda t: re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
    own, bits = plain(text), {}
    for lang in sorted({n for n, _ in samples}):
        sample = "\n".join(t.lower() for n, t in samples if n == lang)
        known, phrases = plain(sample), 0
        for s in range(0, len(own), langid.CHUNK):
            phrase = ""
            for c in own[s : s + langid.CHUNK]:
                if phrase + c in known:
                    phrase += c
                else:
                    phrases, phrase = phrases + 1, c if c in known else ""
            phrases += 1
        bits[lang] = phrases * math.log2(max(len(sample), 2))
    return bits


def test_languages_like_a_search_of_the_samples(spark):
    r = random.Random(13)
    letters = {"aa": "abcdefgh é", "bb": "efghijklm ü", "cc": "abcxyz  ñ"}
    made = lambda lang, n: "".join(r.choice(letters[lang]) for _ in range(n))
    learnable = [(i, made(lang, r.randint(50, 400)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 4)]
    texts = [made(lang, n) for lang in letters for n in (1, 20, 300, 2500)] + ["12 34", None, "", "ABC ÉÜ", "日本", "a" * 3000]
    df = spark.createDataFrame(learnable, "doc_id long, text string, lang string")
    samples = langid.learn(df)
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples).collect()}
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        bits = plain_language(samples, text)
        best, second = sorted(bits.values())[:2]
        assert bits[got[i]["lang_pred"]] == pytest.approx(best) and got[i]["score"] == pytest.approx(1 - best / second)


def plain_score(weights, data):
    """The network on one text by convolution at every byte."""
    w = {k: np.frombuffer(b, np.float32).reshape(s).astype(float) for k, s, b in weights}
    blocks = max(quality.BLOCKS, -(-len(data) // quality.BLOCK))
    blocks += blocks % 2
    padded = data + bytes(blocks * quality.BLOCK - len(data) + quality.FILTER_WIDTH)
    response = np.array([sum(w["embed"][padded[p + j]] @ w["filter"][j] for j in range(quality.FILTER_WIDTH)) for p in range(blocks * quality.BLOCK)])
    peaks = response.reshape(blocks, quality.BLOCK, -1).max(1) + w["bias"]
    scores = []
    for first in range(0, blocks - quality.BLOCKS + 1, 2):
        pooled = np.maximum(peaks[first : first + quality.BLOCKS].max(0), 0)
        scores.append(np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"][0])
    m = w["mixing"]
    return 1 / (1 + math.exp(-(m[0] * np.mean(scores) + m[1] * max(scores) + m[2] * min(scores) + m[3])))


def test_quality_like_a_convolution_at_every_byte(spark, docs, corpus):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    weights = quality.fit(docs, labels)
    want = sorted(((i, plain_score(weights, (t or "").encode())) for i, t in corpus if len(t or "") < 4000), key=str)
    got = {}
    for r in quality.classify(docs, weights).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    for i, p in want:
        assert min(abs(p - x) for x in got[i]) < 1e-5


def test_no_text_beyond_the_sample_comes_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    df = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(300)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality.ByteNetwork, "train", lambda self, data, y: seen.extend(data))
    quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    assert 0 < sum(map(len, seen)) <= 8000


# --- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_like_its_stages_in_plain_python(spark, words, tmp_path):
    """Junk, lines that differ a little, near copies and a benchmark passage, with a null text, an empty one and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(14)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, base = text(12), [text(9) for _ in range(6)]
    rows = [(i, "\n".join(text(10) for _ in range(3))) for i in range(20)]
    rows += [(i, f"{text(11)}\n{shared[:-3]}{i}\n{text(8)}") for i in range(20, 26)]
    rows += [(i, " ".join(base) + f" tail{i} " + text(1)) for i in range(26, 31)]
    rows += [(31, f"{text(6)}\n{ITEM}\n{text(6)}"), (32, "#$% @@ !! " * 30), (33, "<<>> {} == " * 25), (34, None), (35, ""), (36, f"{shared}"), (37, shared)]
    table = lambda data, schema, name: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    table([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    table([(i, int(i not in (32, 33))) for i in range(36)], "doc_id long, quality int", "labels")
    table([(1, ITEM)], "item_id long, text string", "benchmark")
    got = {(x["doc_id"], x["doc_tokens"]) for x in pipeline.run(spark, str(tmp_path)).select("doc_id", "doc_tokens").collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(i, t) for i, t in rows if plain_score(weights, (t or "").encode()) >= 0.5]
    left = [(i, t) for i, t, n in plain_lines(left) if not n or t.strip()]
    kept = plain_near(left, 5, 80)
    left = [(i, t) for i, t in left if kept[i][1] == i]
    leaky = {i for i, *_ in plain_contaminated(left, [(1, ITEM)])}
    tokenizers = pytest.importorskip("tokenizers").Tokenizer.from_file(llm_queries.vocabulary("word_bpe_49k.json"))
    want = {(i, len(tokenizers.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in left if i not in leaky}
    assert got == want and 31 in leaky and len(left) < len(rows)


def test_stages_of_awkward_rows(spark, docs, corpus, sf_dir):
    """Nulls, empty and long texts, repeated rows, ids with several texts and empty tables have defined results in every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    given = docs.select(pipeline.COLUMNS)
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)  # with its clashing columns
        assert out.columns == pipeline.COLUMNS
        assert stage(spark, given.where("false"), sf_dir).collect() == []
        rows = key(out)
        if name != "quality":
            assert rows == key(stage(spark, given.repartition(5), sf_dir))
            assert {t for i, t in rows if i is None} >= {None}
        if name == "near_dedup":
            of = plain_near(corpus, 5, 80)
            assert {i for i, _ in rows} == {i for i, _ in corpus if i is None or of[i][1] == i}
    packed = pipeline.packing_stage(spark, given, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in corpus}


# --- further cases -----------------------------------------------------------------------------------------------


def test_products_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(df, F.col("id") == 0, 5)
    fits = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, -3.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(fits, F.col("id") == 0, 5).first()["score"] == 2**56 - 3 * 2**16


def test_a_query_id_with_two_vectors_asks_with_the_first(spark):
    rows = [(0, [2.0]), (0, [-1.0]), (1, [1.0]), (2, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") == 0, 1).collect()]
    assert got == [(1, -(2**16))]


def test_an_outsider_of_a_large_component_keeps_its_links(spark, words):
    """Near copies of one component in a shingle's bucket with another component: links are those of all pairs."""
    r = random.Random(15)
    base = [r.choice(words) for _ in range(60)]
    vary = lambda w, n: [f"new{r.randrange(10**6)}" if i in n else x for i, x in enumerate(w)]
    rows = [(i, " ".join(vary(base, {r.randrange(60)}))) for i in range(80)]
    other = vary(base, set(range(0, 60, 9)))
    rows += [(100 + i, " ".join(vary(other, {r.randrange(60)}))) for i in range(5)] + [(200, " ".join(base[:45] + other[45:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = near_dedup.keyed(df, "doc_id", "text").withColumnRenamed("key", "id")
    component = F.struct(F.when(F.col("id.id") < 100, 0).otherwise(F.col("id.id")).cast("long").alias("id"), F.lit(0).alias("v"))
    pairs = near_dedup.apart_pairs(texts.select("id", component.alias("component")), texts, 4, 80).collect()
    from test_near_dedup import shingles

    sets = {i: shingles(t, 4) for i, t in rows}
    of = lambda i: 0 if i < 100 else i
    near = {(a, b) for a in sets for b in sets if a < b and of(a) != of(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near <= {tuple(sorted((p["a"]["id"], p["b"]["id"]))) for p in pairs}
    assert all(of(p["a"]["id"]) != of(p["b"]["id"]) for p in pairs)


def _typo(r, line, every):
    w = line.split()
    for i in range(every - 1, len(w), every):
        p = r.randrange(len(w[i]))
        w[i] = w[i][:p] + r.choice("bcdfgh") + w[i][p + 1 :]
    return " ".join(w)


def test_lines_with_typos_and_changed_words_are_linked(spark, words):
    """Shares of made pairs that are linked, by kind: those in the README hold at least."""
    r = random.Random(16)
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(10, 40)))

    def changed(x, share):
        w = x.split()
        for i in r.sample(range(len(w)), int(len(w) * share)):
            w[i] = "".join(r.choice("qwzxv") for _ in w[i])
        return " ".join(w)

    kinds = {"each": (lambda x: _typo(r, x, 1), 0.05), "second": (lambda x: _typo(r, x, 2), 0.6), "third": (lambda x: _typo(r, x, 3), 0.85), "fifth": (lambda x: _typo(r, x, 5), 0.9)}
    kinds |= {"tenth changed": (lambda x: changed(x, 0.1), 0.9), "more changed": (lambda x: changed(x, 0.17), 0.9)}
    kinds["added"] = (lambda x: x + " " + " ".join(x.split()[:2]), 0.9)
    rows, of = [], {}
    for name, (f, _) in kinds.items():
        for _ in range(40):
            a = line()
            of[len(rows) + 1] = name
            rows += [(len(rows), a), (len(rows) + 1, f(a))]
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for name, (_, least) in kinds.items():
        own = [got[i] for i, n in of.items() if n == name]
        assert sum(own) >= least * len(own), name
    assert not any(got[i] for i in got if i % 2 == 0)


def test_limits_on_segments_and_loss_bind(spark, sf_dir):
    """Turns of conversations, of which the assistant's alone bear loss: no sequence goes over any of three limits, and each of them is met."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    n = [len(t["text"] or "") % 290 + 1 for t in turns] * 5
    loss = [x if t["role"] == "assistant" else 0 for x, t in zip(n, turns * 5, strict=True)]
    packer = packing.Packer(600, 4, 300, pool=40)
    pieces = [p for i, (x, y) in enumerate(zip(n, loss, strict=True)) for p in packer.add(i, x, y)] + packer.finish()
    done, used = dict.fromkeys(range(len(n)), 0), {}
    for key, start, length, sequence, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == done[key] and length > 0
        done[key] += length
        used.setdefault(sequence, []).append((offset, length, max(0, start + length - max(start, n[key] - loss[key]))))
    assert done == dict(enumerate(n))
    totals = []
    for own in used.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(x for _, x, _ in own[:i]) for i in range(len(own))]
        totals.append((sum(x for _, x, _ in own), len(own), sum(y for *_, y in own)))
    assert all(t <= 600 and k <= 4 and y <= 300 for t, k, y in totals)
    assert any(t == 600 for t, *_ in totals) and any(k == 4 and t < 600 for t, k, _ in totals) and any(y == 300 and t < 600 for t, _, y in totals)
