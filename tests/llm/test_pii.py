"""Personal data against Python's own regular expressions."""

import hashlib
import re

from lynceus.llm import pii

ROWS = [
    "mail a.b+c@d-e.org, x@y.z@w.q and a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 +1 (555) 010-9999, +49..0-123456789)",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 12 34 56 78 90 12 34 56 78 9 0 1 2 3 4 5 6",
    "é😀 x@é.com a@b.co 日本 10.0.0.1 😀+123456789 ++12345678901234567 tel: 0555 123 45 67, mail joe [at] site [dot] org fe80:1:2:3:4:5:6:7",
    None, "", "@", "+", "....", "1.1.1.1", "a@b.c" * 50, "9" * 3000, "a" * 3000 + "@", "1." * 3000, "1 " * 3000, "+1" + "(" * 3000, "ab-" * 2000 + "@x.y",
    "4111111111111111" * 2, "+12345678 9", "+1234567", "x@-.-", "4111 1111  1111 1111", "00.00.00.00 1.2.3.4444444444444444444444",
]


def plain(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    spans = sorted((m.start(), k, m.end()) for k, (p, test) in enumerate(rules) for m in re.finditer(p, text) if test(m[0]))
    return [sum(s[1] == k for s in spans) for k in range(4)], ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(df, rows):
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        counts, told = plain(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (t, r)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (t, told, r)
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_rows(spark):
    rows = list(enumerate(ROWS))
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, Base string")
    check(pii.op4(df), rows)
    assert pii.find_private(df.limit(0)).collect() == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(pii.op4(df), [(r.doc_id, r.text) for r in df.collect()])


def test_boosting_adds_what_looks_alike(spark):
    """Local numbers after a telephone word are added where most such candidates are confirmed."""
    rows = [(i, f"telephone +49 555 0{i:05d} is here" if i % 50 else f"telephone 0049 555 0{i:05d} is here", "b") for i in range(2000)]
    got = pii.op4(spark.createDataFrame(rows, "doc_id long, text string, b string")).collect()
    assert sum(r.n_phone for r in got) == 1960 and all("phone:" in r.spans for r in got if r.doc_id % 50)
