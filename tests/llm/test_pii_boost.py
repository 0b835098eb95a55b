"""The learned half: named obfuscations are added, decoys stay; many matches are linear work."""

import time

from lynceus.llm import pii

HIDDEN = {
    "email": ["joe [at] site [dot] org", "ann.b (at) example (dot) com"],
    "ip": ["fe80:1:2:3:4:5:6:7", "2001:db8:85a3:8d3:1319:8a2e:370:7348"],
    "phone": ["(555) 010-9999", "(743) 555-3824"],
}
DECOYS = ["20240131", "12345678901", "9876543210987654", "1.2.300.4", "x = 10.5", "ratio 3/4", "chapter 12 of 30", "internationalisation_of_words"]


def documents():
    rows = []
    for i in range(120):
        rows.append(f"Write to user{i}@mail{i % 5}.example.com or ring +1 ({200 + i}) 555-{1000 + i} now; it runs on 10.0.{i}.7 these days.")
    for i in range(120):
        rows.append(f"An order {20240000 + 17 * i} of {12345678901 + 7919 * i} and {9876543210987654 + 15485863 * i} lies here.")
    for kind, texts in HIDDEN.items():
        rows += [f"One says {t} to friends." for t in texts]
    rows += [f"One says {t} to friends." for t in DECOYS]
    rows += [f'Set token = "{(i * 0x9E3779B97F4A7C15F39CC0605CEDC834) % 2**160:040x}" here.' for i in range(1, 40)]
    return rows


def test_obfuscated_spans_are_added_and_decoys_are_not(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, Spans string, k int")
    got = {r.doc_id: r for r in pii.find_private(df).collect()}
    told = lambda i: {(pii.ALL_KINDS[s.k], rows[i][s.s : s.e].strip()) for s in got[i].spans}
    at = 240
    for kind, texts in HIDDEN.items():
        for t in texts:
            assert (kind, t) in told(at) and not got[at].base, (rows[at], told(at))
            at += 1
    for _ in DECOYS:
        assert not got[at].spans, (rows[at], told(at))
        at += 1
    assert all({k for k, _ in told(i)} == {"secret"} or got[i].base for i in range(at, len(rows)))
    for i in range(120):
        assert len(got[i].base) == 3 and set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert not any(got[i].spans for i in range(120, 240) if not got[i].base)


def test_words_of_a_kind(spark):
    rows = [f"Our telephone: 0555 {100 + i} {4567 + i} is open." for i in range(40)] + [f"Paid by card no. {4000123412341234 + 10 * i}." for i in range(40)]
    got = {r.doc_id: r for r in pii.op4(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all("phone:" in got[i].spans for i in range(40)) and all("card:" in got[i].spans for i in range(40, 80))
    assert all(got[i].n_found >= 1 and got[i].n_phone == 0 for i in range(40))


def test_a_text_of_many_addresses(spark):
    text = " ".join(f"a{i}@b.org" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r.n_email for r in pii.op4(df).select("doc_id", "n_email").collect()}
    assert got == {1: 100_000, 2: 0} and time.monotonic() - began < 60
