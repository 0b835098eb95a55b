"""Token files: an exact round trip, the layout of the files, and what a selective read reads."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lynceus.llm import packing
from lynceus.llm import token_files as T

SCHEMA = "doc_id long, text string, lang string"


def encoded(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def plain(rows):
    """Per document in ascending id: start, count, crc."""
    rows = sorted(rows)
    out, start = [], 0
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = T.op12(docs)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == plain([(r.doc_id, r.text or "") for r in docs.collect()])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip_and_layout(spark, tmp_path, encoding):
    texts = [None, "", " ", "One two three.", "x <|endoftext|> y", "naïve café 東京 🎉", "z " * 30_000] + [f"document {i} of many words about number {i * i}" for i in range(3000)]
    rows = [(i * 3, t, "en") for i, t in enumerate(texts)]
    folder = f"file://{tmp_path}/tokens"
    T.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4), folder, encoding=encoding, row_group=16 << 10, page=8 << 10, page_rows=100)
    got = {r.doc_id: (r.start, list(r.tokens), r.lang) for r in T.read_tokens(spark, folder).collect()}
    ids, start = encoded(texts), 0
    for (i, _, lang), one in zip(rows, ids, strict=True):
        assert got[i] == (start, one, lang)
        start += len(one)
    files = sorted(Path(tmp_path, "tokens/shards").glob("*.parquet"))
    before = -1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        if not meta.num_rows:
            continue
        first = pq.read_table(f, columns=["doc_id"]).column("doc_id").to_pylist()
        assert first == sorted(first) and first[0] > before  # shards are ranges in the order of ids
        before = first[-1]
        group = meta.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        said = set(columns["tokens.list.element"].encodings)
        assert ("DELTA_BINARY_PACKED" in said and not said & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}) if encoding == "delta" else said & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1


def test_selective_reads(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    rows = [(i, f"text of document {i}", "en") for i in range(20_000)]
    T.write_tokens(spark.createDataFrame(rows, SCHEMA), folder, page_rows=200)
    one = T.read_tokens(spark, folder).filter("doc_id = 777").select("tokens")
    assert [list(r.tokens) for r in one.collect()] == encoded([rows[777][1]])
    plan = T.read_tokens(spark, folder).select("doc_id", "n_tokens").filter("doc_id < 50")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "/shards" in x)
    assert "tokens:array" not in scan and "LessThan(doc_id,50)" in scan
    flat = np.concatenate(encoded([t for _, t, _ in rows]))
    for first, length in ((0, 5), (1234, 4000), (len(flat) - 3, 10), (0, len(flat)), (70_001, 1), (5, 0), (len(flat), 4)):
        parts = sorted(T.read_span(spark, folder, first, length).collect())
        assert [x for r in parts for x in r.tokens] == flat[first : first + length].tolist()
        assert not parts or parts[0].start == first


def test_odd_tables(spark, tmp_path):
    rows = [(None, "a b", "x"), (None, None, None), (5, "a b", "x"), (5, "a b", "x"), (5, "c", "x"), (-3, "", None)]
    got = T.op12(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 3]
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, -3, 5, 5, 5]
    assert [r.start for r in by_start] == np.concatenate(([0], np.cumsum([r.n_tokens for r in by_start])[:-1])).tolist()
    assert T.op12(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "a", 7, 8, "s")], "doc_id long, text string, Tokens int, start int, shard string")
    T.write_tokens(clash, f"file://{tmp_path}/clash")
    out = T.read_tokens(spark, f"file://{tmp_path}/clash").collect()
    assert len(out) == 1 and out[0].start == 0 and list(out[0].tokens) == encoded(["a"])[0]


def test_one_row_many_times(spark):
    """Copies of one row are dealt to several shards and stay gapless."""
    got = T.op12(spark.range(20_000).selectExpr("1L doc_id", "'same text' text")).collect()
    n = got[0].n_tokens
    assert sorted(r.start for r in got) == [i * n for i in range(20_000)] and len({r.ids_crc32 for r in got}) == 1


def test_plain_texts_are_looked_up_by_pre_token():
    """A word has one entry whatever its case and the signs around it, so few words are encoded anew; very long ones aren't kept."""
    memo = packing._Memo(packing.vocabulary())
    texts = ["Word word,\t(word) WORD.\u000bdon't 42", "Élan élan, ÉLAN!", "x" * 1000]
    assert [np.frombuffer(memo.pack(t), "<u4").tolist() for t in texts] == [ids[:-1] for ids in encoded(texts)]
    assert set(memo.words) == {"word", ",", "(", ")", ".", "don", "'t", "4", "2", "élan", "!"} and not memo


def test_ids_of_odd_texts():
    """Whole plain texts, strings that aren't plain and special tokens give the tokenizer's own ids."""
    rng = np.random.default_rng(5)
    plain = [*"aZé'ß.,|<>0 9\t\n\u000b\u000c\r", "'S", "'ll", "<|", "The ", "Über"]
    odd = [*"\u001c\u0085 ª²×İ́ 東’", "<|endoftext|>", "<|StartOfText|>"]
    for signs, n in ((plain, 3000), (plain * 4 + odd, 3000)):
        texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(n)]
        got = [np.frombuffer(packing.packed_ids(t, packing.vocabulary()), "<u4").tolist()[:-1] for t in texts]
        assert got == [ids[:-1] for ids in encoded(texts)]
