"""SimHash near-duplicates against a plain version."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.common import U64


def plain_fingerprint(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, most):
    """(id, fingerprint) rows: the smallest id reachable of each id."""
    known = sorted({r for r in rows if r[0] is not None})
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in known:
        for j, y in known:
            if (x ^ y).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def check(df, rows, k, most, **more):
    got = S.near_duplicates(df, k, most, **more).collect()
    made = [(i, plain_fingerprint(t, k)) for i, t in rows]
    of = plain_components(made, most)
    want = [(i, f"{fp:016x}", of.get(i)) for i, fp in made]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("k", "most"), [(4, 4), (2, 7), (4, 0), (3, 1)])
def test_same_as_plain(docs, corpus, k, most):
    """Nulls, empty texts, repeated rows, ids with several texts, clashing columns."""
    check(docs, corpus, k, most)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 4, 4)


def test_no_rows(no_docs):
    assert S.near_duplicates(no_docs).collect() == []


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", "x y z w"), ("a", "x y z w"), ("c", "other words go here")], "name string, body string")
    got = {r["name"]: r["component_id"] for r in S.near_duplicates(df, 2, 4, "name", "body").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert S.fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def test_every_point_has_an_anchor_and_close_points_share_one():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 3000, np.int64).view(U64) * U64(2) + r.integers(0, 2, 3000).astype(U64)
    assert len(S.anchors(x, 0)[0]) == len(x)  # perfect codes: one within the covering radius
    for bits in range(6):
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(64, bits, replace=False):
                y[i] ^= U64(1) << U64(b)
        shared = set(zip(*map(list, S.anchors(x, (bits + 1) // 2)), strict=True)) & set(zip(*map(list, S.anchors(y, (bits + 1) // 2)), strict=True))
        assert {of for _, of in shared} == set(range(len(x)))


def _close_group(n, seed):
    """Fingerprints a few bits around one centre, all distinct."""
    r, out = random.Random(seed), set()
    while len(out) < n:
        x = 0x0123456789ABCDEF
        for b in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.fixture
def small_batches(spark):
    """Rows come in batches of 30, so that anchors of more than that go over several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "30")
    yield
    spark.conf.set(name, before)


def test_crowded_anchors_lose_no_link(spark, small_batches):
    """Anchors over the limit are compared in blocks, and give the components of all pairs."""
    fps = _close_group(600, 4) + [random.Random(5).getrandbits(64) for _ in range(100)]
    df = spark.createDataFrame([(int(np.array([x], U64).view(np.int64)[0]),) for x in fps], "fp long").repartition(5)
    placed = S.anchored(df, 4)
    found = S.met(placed, 4, 40).collect()
    full = [(r["anchor"], r["n"]) for r in found if r["a"] is None]
    counts = {r["anchor"]: r["count"] for r in placed.groupBy("anchor").count().collect()}
    assert len(full) > 5 and {k: n for k, n in counts.items() if n > 100}.items() <= dict(full).items()
    assert all(counts[k] == n > 40 for k, n in full)
    more = S.met_in_blocks(placed, spark.createDataFrame(full, "anchor long, n long"), 4, 40).collect()
    links = {(r["a"], r["b"]) for r in found if r["a"] is not None} | {(r["a"], r["b"]) for r in more}
    u = lambda x: x % 2**64
    assert all((u(a) ^ u(b)).bit_count() <= 4 for a, b in links)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(u(a))] = find(u(b))
    got = {}
    for x in fps:
        got.setdefault(find(x), set()).add(x)
    want = plain_components([(x, x) for x in fps], 4)
    groups = {}
    for x, c in want.items():
        groups.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_crowded_path_of_the_whole_operator(docs, corpus, small_batches):
    check(docs, corpus, 4, 6, crowded=3)


def test_pairs_of_a_dense_group_stay_in_proportion(spark):
    fps = np.array(_close_group(2000, 6), U64)
    a, b = S.close_pairs(np.zeros(len(fps), np.int64), fps, 4)
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) <= 4).all()
