"""Extra columns with the names that an operator uses for its own results or might use within change nothing."""

import pytest
from pyspark.sql import functions as F
from test_contracts import table

from lynceus.llm import embedding_dedup, exact_dedup, language_id, line_dedup, mixing, packing, pii, simhash, similar, toxicity, url_filter

MORE = (
    "p", "l", "before", "keeper", "links", "top", "root", "least", "n", "m", "v", "cls", "dim", "node", "rid", "id", "site", "line", "pos", "k1", "k2", "a", "b", "key",
    "s", "e", "t", "k", "base", "hit", "fold", "i", "y", "r", "h", "g", "x", "f", "copies", "target", "level", "ids", "length", "piece", "Sequence_ID", "score", "margin", "rejected",
    "rule", "host", "path", "verdict", "fingerprint", "kept", "keep_id", "n_lines", "n_removed", "own", "size", "Predicted", "lang_pred",
)


def more(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(c for c in MORE if c.lower() not in have)])


OPERATORS = {
    "pack": packing.pack, "exact": exact_dedup.exact_dedup, "near": simhash.near_dedup, "similar": similar.similar_dedup, "pii": pii.find_private, "lines": line_dedup.line_dedup,
    "mix": mixing.mix, "language": lambda d: language_id.identify(d, language_id.learn(d)), "toxicity": lambda d: toxicity.score(d, toxicity.Model({b"cat": 1.0}, [0.0] * len(toxicity.PATTERNS), 0.0)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_documents(spark, name):
    plain = table(spark).select("doc_id", "text", "lang", "source")
    got, want = OPERATORS[name](more(plain)), OPERATORS[name](plain)
    own = [c for c in want.columns if c not in ("sequence_id", "offset", "spans", "base")]
    key = lambda rows: sorted(str([r[c] for c in own]) for r in rows)
    assert key(got.collect()) == key(want.collect())
    assert OPERATORS[name](more(plain).limit(0)).collect() == []


def test_vectors_and_pages(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.5], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    key = lambda df: sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())
    assert key(embedding_dedup.vector_dedup(more(v))) == key(embedding_dedup.vector_dedup(v))
    u = spark.createDataFrame([(i, f"http://a{i % 3}.example.org/en/{i}") for i in range(9)], "page_id long, url string")
    key = lambda df: sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())
    assert key(url_filter.judge(more(u))) == key(url_filter.judge(u))
