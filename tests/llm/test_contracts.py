"""Each dealt query against a plain, single-process version of its contract, and the awkward rows that every operator must survive."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lynceus.llm import exact_dedup, language_id, mixing, packing, simhash

SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Kept string, size string, component_id string, `_x y` array<int>"
LONG = "ab " * 40000 + "x" * 5000
ROWS = [
    (1, "The cat sat on the mat and looked at the moon.", "en", "a"),
    (2, "The  cat sat\ton the mat and looked at the moon.", "en", "b"),
    (2, "The cat sat on the mat and looked at the moon.", "en", "b"),
    (3, None, None, None),
    (None, "Der Hund liegt unter dem Tisch und schläft.", "de", "a"),
    (None, "Der Hund liegt unter dem Tisch und schläft.", "de", "a"),
    (4, "", "de", ""),
    (5, "  \n ", "de", "c"),
    (6, LONG, "en", "a"),
    (7, LONG, "en", "d"),
    (8, LONG + "y", "en", "d"),
    (9, "12345 !!! 678", None, "d"),
    (10, "日本語 のテキスト 😀 <|endoftext|> it's I'LL Ünḯcode \x1c\x85 z", "de", "a"),
    (11, "x", "en", "e"),
    (11, "x", "en", "e"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "s", "c", [1]) for r in rows], SCHEMA)


def normal(text):
    return re.sub(SPACES, " ", text or "")


def documents(spark, n=None):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df


@pytest.mark.parametrize("which", ["rows", "sf", "empty"])
def test_exact_dedup(spark, which):
    df = {"rows": lambda: table(spark), "sf": lambda: documents(spark), "empty": lambda: table(spark, [])}[which]()
    got = exact_dedup.exact_dedup(df).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[normal(r.text)].append(r.doc_id)
    assert len(got) == sum(map(len, groups.values()))
    kept = Counter()
    for r in got:
        ids = groups[normal(r.text)]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (least, len(ids))
        assert r.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
        if r.kept:
            assert r.doc_id == least
            kept[normal(r.text)] += 1
    assert kept == Counter(list(groups))


def test_exact_dedup_blocks(spark):
    """Texts that part only at the edges of blocks."""
    base = "q" * 70000
    rows = [(i, base[:n] + tail, "en", "a") for i, (n, tail) in enumerate((n, t) for n in (0, 63, 64, 65, 1023, 1024, 1088, 17471, 17472, 70000) for t in ("", "", "r", "s"))]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    sizes = Counter(r[1] for r in rows)
    assert all(r.group_size == sizes[r.text] for r in got) and sum(r.kept for r in got) == len(sizes)


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = list(fps)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(a)] = find(b)
    return {f: find(f) for f in u}


@pytest.mark.parametrize("which", ["rows", "sf", "empty"])
def test_simhash(spark, which):
    df = {"rows": lambda: table(spark), "sf": lambda: documents(spark), "empty": lambda: table(spark, [])}[which]()
    got = simhash.near_dedup(df).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    if not rows:
        return
    fp = {r.text: brute_fingerprint(r.text) for r in rows}
    comp = brute_components(set(fp.values()))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = comp[fp[r.text]]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    kept = Counter()
    for r in got:
        assert r.fingerprint == f"{fp[r.text]:016x}"
        c = comp[fp[r.text]]
        assert r.component_id == least.get(c)
        if r.kept:
            kept[c] += 1
            assert r.doc_id == least.get(c)
    assert kept == Counter(set(comp.values()))


def test_simhash_large_buckets(spark):
    """Dense fingerprints, buckets over the limit: the fine blocks find the same components."""
    from lynceus.llm.common import Scratch
    from lynceus.llm.components import components

    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(300):
        x = int(rng.choice(list(fps)))
        for b in rng.integers(0, 64, 2):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, f"`{simhash.FP}` long")
    for largest in (4096, 8):
        scratch = Scratch(spark, "test")
        found = {r.node: r.component for r in components(scratch, simhash.links(scratch, df, largest=largest)).collect()}
        comp = brute_components({f for f in fps})
        by = defaultdict(set)
        for f in fps:
            s = f - (1 << 64) if f >> 63 else f
            by[comp[f]].add(found.get(s, s))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_components_chain(spark):
    from lynceus.llm.common import Scratch
    from lynceus.llm.components import components

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(-5, 1000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    got = {r.node: r.component for r in components(Scratch(spark, "test"), df).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == -5 for i in range(1000, 1100))


@pytest.mark.parametrize("which", ["rows", "sf", "empty"])
def test_mixing(spark, which):
    df = {"rows": lambda: table(spark), "sf": lambda: documents(spark), "empty": lambda: table(spark, [])}[which]()
    got = mixing.mix(df).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in rows:
        size[r.source] += count(r.text)
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.size == count(r.text) and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = mixing.mix(df).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.op8(documents(spark)).groupBy().sum("taken", "size").first()
    assert got[0] == pytest.approx(1.5 * got[1], rel=0.05)
    test_mixing(spark, "sf")


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(1)
    p, s = np.array([0.2, 0.5, 0.7, 0.35, 0.9]), np.array([10, 300, 20, 5, 80])
    mean = np.zeros(5)
    for _ in range(4000):
        q, held = mixing.pivotal(p.copy(), s, rng)
        assert q @ s == pytest.approx(p @ s) and sum((q > 0) & (q < 1)) == (held >= 0)
        mean += q / 4000
    assert np.abs(mean - p).max() < 0.04


@pytest.mark.parametrize("which", ["rows", "sf", "empty"])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    df = {"rows": lambda: table(spark), "sf": lambda: documents(spark), "empty": lambda: table(spark, [])}[which]()
    got = packing.pack(df, with_ids=True).collect()
    tok = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for r in df.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            one = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[(r.doc_id, k // 2048, k, len(one) // 4, zlib.crc32(one), one)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048
    if got:
        counts = np.bincount([r.length for r in got], minlength=2049)
        assert len(by) <= packing.least_sequences(counts, 2048) + 1


def test_pack_histogram_optimal():
    rng = np.random.default_rng(3)
    for trial in range(20):
        counts = np.zeros(101, np.int64)
        for x in rng.integers(1, 101 if trial % 2 else 60, 60):
            counts[x] += 1
        plan = packing.pack_histogram(counts, 100)
        used = np.zeros_like(counts)
        for times, items in plan:
            assert sum(items) <= 100
            for x in items:
                used[x] += times
        assert (used == counts).all()
        assert sum(t for t, _ in plan) <= packing.least_sequences(counts, 100) + 1


def test_language(spark):
    df = documents(spark)
    got = {r.doc_id: r for r in language_id.op9(df).collect()}
    rows = df.collect()
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(got) == len(rows) and sum(right) / len(right) > 0.9
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_rows(spark):
    df = table(spark)
    got = language_id.identify(df, language_id.learn(df)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
        assert 0 <= r.score <= 1 and (r.rejected or r.lang_pred in ("en", "de"))
    assert language_id.identify(table(spark, []), {}).collect() == []
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}
