"""URL filters, line and embedding deduplication against plain versions."""

import math
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash

from lynceus.llm import embedding_dedup, line_dedup, url_filter

URLS = [
    "http://Sub.Example.ORG/es/1?x=/en/", "https://example.org/en/12", "https://example.org", "https://example.org?a#b", "http://a.example.com/fr/x#y",
    "http://com/de/", "http://xcom/de/", "ftp://notexample.org/es/", None, "", "no scheme/de/", "://x.org/", "http://h.com:80/de/", "a://b://c.org/es/",
    "http://WWW.Cheap-Pills.example.com/zz", "http://cheap-pills.example.com", "http://cheap-pills.example.com/fr/1", "http://É.org/é\n/x", "http:///de/",
    "http://example.org/en/1", "http://example.org/en/1",
]


def plain_verdict(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    raw = cut(rest, "/?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = cut(rest[len(raw) :], "?#")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    blocked = any(host == b or host.endswith("." + b) for b in url_filter.BLOCKED_HOSTS)
    rule, verdict = max(fits)[2:] if fits else (None, "block" if blocked else "allow")
    return host, path, rule, verdict


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, Rule string")
    for r in url_filter.judge(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url), r
    assert url_filter.judge(df.limit(0)).collect() == []
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in url_filter.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url)


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "xxhash", SimpleNamespace(xxh64_intdigest=lambda s, seed: xxhash.xxh64_intdigest(s, seed) % 3))
    file, _ = url_filter.write_array([("allow", f"h{i}.x", "/") for i in range(20)], (), str(tmp_path))
    array = url_filter.DigestArray.mapped(file)
    at = array.find([f"h{i}.x/".encode() for i in range(30)])
    assert (at[:20] >= 0).all() and len(set(at[:20].tolist())) == 20 and (at[20:] == -1).all()
    file, _ = url_filter.write_array([], (), str(tmp_path))
    assert url_filter.DigestArray.mapped(file).find([b"x"]).tolist() == [-1]


@pytest.mark.parametrize("least", [1, 20])
def test_lines(spark, least):
    rows = [(i, f"own line number {i:05d} of it\nThis passage is on every site.\n short \n\nends {i}", f"s{i % 40}", "n") for i in range(120)]
    rows += [(500, None, "s1", "n"), (501, "", None, "n"), (502, "This passage is on every site. ", None, "n"), (503, "seen on nine sites or so\n" * 3, "s0", "n")]
    rows += [(600 + i, "seen on nine sites or so", f"s{i}", "n") for i in range(9)] + [(700 + i, "seen on ten sites or so", f"s{i}", "n") for i in range(10)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, N_Lines string")
    sites = defaultdict(set)
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if s is not None:
                sites[x.strip(" \t\n\x0b\x0c\r")].add(s)
    want = defaultdict(list)
    for i, t, _, _ in rows:
        ls = t.split("\n") if t is not None else []
        kept = [x for x in ls if len(x.strip()) < least or len(sites[x.strip()]) < 10]
        want[i].append((None if t is None else "\n".join(kept), len(ls), len(ls) - len(kept)))
    got = defaultdict(list)
    for r in line_dedup.line_dedup(df, min_chars=least).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert got == want
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def brute_vectors(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), n[i], str(least.get(find(i))), k is not None and k == least.get(find(i))) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize("cell,chunk,assign", [(4096, 2048, 65536), (16, 8, 40)])
def test_vectors(spark, monkeypatch, cell, chunk, assign):
    for k, v in (("CELL", cell), ("CHUNK", chunk), ("ASSIGN", assign)):
        monkeypatch.setattr(embedding_dedup, k, v)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * (0.05 + 0.3 * (i % 3))], i % 2) for i in range(220)]
    rows += [(900 + i, rows[0][1], 0) for i in range(30)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0), (1004, rows[0][1], None)]
    rows += [(1005, [None] + rows[0][1][1:], 0), (1006, rows[0][1][:7], 0), (None, rows[0][1], 0), (900, rows[0][1], 0), (1007, [float("inf")] + [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, label int, Kept string")
    got = embedding_dedup.vector_dedup(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute_vectors(rows)
    assert embedding_dedup.vector_dedup(df.limit(0)).collect() == []
