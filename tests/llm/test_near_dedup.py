from math import comb

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, near_dedup


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, threshold):
    """id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_equals_brute_force(spark, docs, corpus):
    got = near_dedup.near_duplicates(docs, k=4).collect()
    want = brute(corpus, 4, 80)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_no_rows(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []


def test_a_large_group_of_near_copies_keeps_every_link(spark, words):
    rng = np.random.default_rng(1)
    base = [words[i] for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[j] = f"changed{i}x{j}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5, 80).items()}


def test_estimate_is_near_the_overlap():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (2 * share)) if share else 0
        a, b = (np.concatenate((both, rng.integers(0, 2**63, n, dtype=np.uint64))) for _ in "ab")
        ra, rb = (near_dedup.registers(x, np.array([0, len(x)])) for x in (a, b))
        guess = near_dedup.likely_overlap(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(guess - 2000 / (2000 + 2 * n)) < 0.15


def test_registers_merge():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    whole, left, right = (near_dedup.registers(v, np.array([0, len(v)])) for v in (x, x[:300], x[200:]))
    assert (np.maximum(left, right) == whole).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {tuple(r) for r in common.components(edges).collect()}
    assert got == {(i, 0) for i in range(201)}


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_estimate_drops_no_more_pairs_than_the_bands():
    """Registers of a pair of overlap 0.8 agree like draws of 0.8, and the others are larger on either side alike."""
    n, lost = near_dedup.REGISTERS, 0.0
    for equal in range(n + 1):
        a, b = np.full((1, n), 5, np.uint16), np.full((1, n), 5, np.uint16)
        a[0, equal : equal + (n - equal) // 2] = 6
        b[0, equal + (n - equal) // 2 :] = 6
        if near_dedup.likely_overlap(a, b, np.array([1000.0]), np.array([1000.0]))[0] < 0.8 - near_dedup.MARGIN:
            lost += comb(n, equal) * 0.8**equal * 0.2 ** (n - equal)
    print("lost", lost)
    assert lost < (1 - 0.8**near_dedup.ROWS) ** (n // near_dedup.ROWS)


def test_an_id_with_several_texts_keeps_the_links_of_each(spark, words):
    w, v = " ".join(words[:60]), " ".join(words[100:160])
    rows = [(1, w), (5, w), (5, v), (7, v + " x"), (8, "other words altogether here now")]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (7, 1), (8, 8)]


def test_the_prefix_filter_drops_no_near_pair(spark, words):
    """Copies around the threshold, each taken for a component of its own: all near pairs come out, and few others."""
    rng = np.random.default_rng(4)
    base = [words[i] for i in rng.integers(0, 400, 150)]
    rows = []
    for i in range(120):
        w = list(base)[: int(rng.integers(120, 151))]
        for j in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[j] = f"changed{i % 7}x{j}" if rng.random() < 0.3 else f"changed{i}x{j}"
        rows.append((i, " ".join(w)))
    df = near_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").withColumnRenamed("key", "id")
    got = {(r["a"]["id"], r["b"]["id"]) for r in near_dedup.apart_pairs(df.select("id", F.col("id").alias("component")), df, 5, 80).collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    pairs = lambda x: {tuple(sorted(p)) for p in x}
    assert near and pairs(near) <= pairs(got) and len(got) < 0.6 * 120 * 119 / 2
