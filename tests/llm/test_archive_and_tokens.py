import hashlib
import random

import pytest

from tidemark.llm import llm_queries, packing, token_counts, warc

BPE, WORDS = llm_queries.vocabulary("byte_bpe_50k.json"), llm_queries.vocabulary("word_bpe_49k.json")
ODD = ["", " ", "  a  b", "a <|endoftext|> b<|endoftext|>", "\n\n x\t\ty ", "it's we'll 'rea' I'M", "\x1c\x85  \x1cx \xa0 y", "日本語 123 ½ Ⅻ", "🙂🙂  é é", "aaaa" * 200, "=" * 300, "ΑΣ ΣΑΣ. İx!", "<|startoftext|>x 12.5% Ǆ ﬁ Å"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(BPE), tokenizers.Tokenizer.from_file(WORDS)


def test_counts_are_the_library_s(docs, corpus, library):
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, BPE, 50).collect()), key=str)
    n = [len(library[0].encode(t or "", add_special_tokens=False).ids) for _, t in corpus]
    assert got == sorted(((i, len((t or "").encode()), k, k > 50) for (i, t), k in zip(corpus, n, strict=True)), key=str)


def test_every_prefix_is_exact(library):
    own = token_counts.PrefixCounter(BPE)
    for t in ODD:
        want = [len(library[0].encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)]
        assert own.table(t).tolist() == want, t
        assert own.table(t)[-1] == own.total([t])[0]


def test_every_prefix_of_odd_texts(library):
    own, r = token_counts.PrefixCounter(BPE), random.Random(11)
    signs = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "the", "'s", "'ll", "'ve", "'", "''", "12", ".", "..<", "é", "汉", "🙂", "<|endoftext|>", "<|endo", "|>", "L"]
    for _ in range(400):
        t = "".join(r.choice(signs) for _ in range(r.randint(1, 12)))
        assert own.table(t).tolist() == [len(library[0].encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)], t


def test_budget_takes_the_longest_of_all_prefixes(library):
    own = token_counts.PrefixCounter(BPE)
    for t in [*ODD, " Wednesdayx", "on Wednesday, Wednesdays" * 30]:
        table = own.table(t)
        want = [len(library[0].encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)]
        for budget in range(max(want) + 2):
            assert own.longest_prefix(table, budget) == max(n for n, w in enumerate(want) if w <= budget)


def test_prefix_tables_come_with_the_rows(spark, docs):
    for r in token_counts.token_counts(docs, BPE, tables=True).collect():
        assert r["prefix_tokens"][0] == 0 and r["prefix_tokens"][-1] == r["n_tokens"]


def test_packed_ids_are_the_library_s(docs, corpus, library):
    import zlib

    import numpy as np

    rows = packing.pack_documents(docs, WORDS, tokens=256, segments=9, loss=256).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    want = {}
    for i, t in corpus:
        ids = np.array([*library[1].encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    assert by.keys() == want.keys()
    for key, pieces in by.items():
        pieces.sort()
        seen = [sum(p[0] == s for p in pieces) for s in {p[0] for p in pieces}]
        assert sum(n for _, n, _ in pieces) == sum(map(len, want[key])) and seen
        for start, length, crc in pieces:
            assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in want[key])
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 256, 9)


def check_sequences(pieces, tokens, segments):
    sequences = {}
    for s, offset, n in pieces:
        sequences.setdefault(s, []).append((offset, n))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= tokens and len(own) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_all_three_limits_hold():
    import random

    r = random.Random(9)
    packer, out, whole = packing.Packer(512, 5, 200, pool=50), [], {}
    for i in range(2000):
        n = r.choice((r.randint(1, 40), r.randint(1, 700), r.randint(600, 3000)))
        whole[i] = (n, r.randint(0, n))
        out += packer.add(i, *whole[i])
    out += packer.finish()
    check_sequences([(s, o, n) for _, _, n, s, o in out], 512, 5)
    loss, spans = {}, {}
    for key, start, n, s, _ in out:
        total, bearing = whole[key]
        loss[s] = loss.get(s, 0) + max(0, start + n - max(start, total - bearing))
        spans.setdefault(key, []).append((start, n))
    assert max(loss.values()) <= 200
    for key, pieces in spans.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == whole[key][0]


def test_packing_given_sizes(spark, no_docs):
    sizes = spark.createDataFrame([(i, 100 + i, 10) for i in range(50)] + [(99, None, None), (98, 0, 0)], "id long, n long, loss long")
    rows = packing.pack(sizes, "id", "n", "loss", 256, 8, 100).collect()
    assert sum(r["length"] for r in rows) == sum(100 + i for i in range(50))
    assert packing.pack_documents(no_docs, WORDS).collect() == [] and token_counts.token_counts(no_docs, BPE).collect() == []


def pages(spark):
    big, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b\r\nWARC-Type: x", big), (3, None, big), (4, "u", other), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", None), (8, "u", ""), (9, "u", "a\r\n\r\nb"), (9, "u", "a\r\n\r\nb"), (None, "u", "small"), (10, "u", "y" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_archives_give_back_what_was_written(spark):
    rows, df = pages(spark)
    got = {}
    for r in warc.round_trip(df).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = i in (1, 2)
        assert (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None) in got[i]
    assert sum(map(len, got.values())) == len(rows)


def test_files_with_a_dictionary_are_read(spark, tmp_path):
    records = [warc.build_record(i, f"http://x/{i}", (f"<html>page {i} of many</html>" * 20).encode(), hashlib.sha1((f"<html>page {i} of many</html>" * 20).encode()).hexdigest(), None) for i in range(300)]
    data = warc.build_archive(records)
    assert warc.load_dictionary(data)[0] is not None
    (tmp_path / "a.warc.zst").write_bytes(data)
    got = warc.read_warc_files(spark, str(tmp_path)).collect()
    assert len(got) == 300 and {bytes(r["payload"]) for r in got} == {(f"<html>page {i} of many</html>" * 20).encode() for i in range(300)}
    assert [r for _, r in warc.frames(data)] == records


@pytest.mark.parametrize("harm", ["cut", "length", "digest", "version", "dictionary"])
def test_broken_archives_are_refused(harm):
    import zstandard

    record = warc.build_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    press = zstandard.ZstdCompressor().compress
    with pytest.raises(warc.WarcError):
        if harm == "cut":
            list(warc.frames(press(record)[:-3]))
        elif harm == "length":
            warc.parse_record(record.replace(b"payload\r\n\r\n", b"payload!\r\n\r\n"))
        elif harm == "digest":
            fields, block = warc.parse_record(record.replace(b"WARC-Block-Digest", b"X-Old"))
            warc.parse_http(fields, block.replace(b"payload", b"pay1oad"))
        elif harm == "version":
            warc.parse_record(b"HTTP" + record)
        else:
            list(warc.frames(b"\x5d\x2a\x4d\x18" + (8).to_bytes(4, "little") + b"nonsense"))


def test_no_pages(spark):
    assert warc.round_trip(pages(spark)[1].where("false")).collect() == []


def test_packed_ids_are_the_librarys_for_odd_strings():
    """Letters that stop being letters when they are lower-cased or composed, marks, contractions and special strings, alone and before punctuation."""
    import random

    import pyarrow as pa

    from tidemark.llm import packing
    from tidemark.llm.llm_queries import vocabulary

    own, r = packing.encoder(vocabulary("word_bpe_49k.json")), random.Random(3)
    letters = "aAbZéÉİıßΣσςЖджאबक़ﬁ日本1²Ⅷ’'́̇.,!?;:|%&$*#-_ \t\n 　🙂ǅʰ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(20_000)] + ["RAKİ, su", "<|endoftext|>. x<|startoftext|>y", "we'll don't", "", None, "İ! İ? क़!"]
    ids, ends = own.encode(pa.array(texts))
    want = own.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert len(ends) == len(texts) + 1
    for t, a, b, w in zip(texts, ends, ends[1:], want, strict=False):
        assert ids[a:b].tolist() == w.ids, t


def test_a_file_with_other_rules_is_refused():
    import pytest

    from tidemark.llm import packing
    from tidemark.llm.llm_queries import vocabulary

    with pytest.raises(ValueError):
        packing.WordEncoder(vocabulary("byte_bpe_50k.json"))


def test_a_large_archive_is_read_in_linear_time():
    import time

    from tidemark.llm import warc

    def seconds(n):
        records = [warc.build_record(i, f"http://x/{i}", b"%d " % i * 40, "0", None) for i in range(n)]
        data = warc.build_archive(records)
        start = time.time()
        assert [r for _, r in warc.frames(data)] == records
        return time.time() - start

    seconds(2_000)
    assert seconds(40_000) < 40 * seconds(4_000) + 2
