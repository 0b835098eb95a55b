"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and of word beginnings, and
patterns of writing.  A generative label model estimates how each voter votes on
either class (expectation maximisation, started from the labelled rows) and how voters
go together given the class; correlated voters share their weight.  Its posterior
labels train a linear classifier on words, word beginnings and patterns, which scores
every whole text.

Learning uses a bounded sample (``SAMPLE`` labelled rows, texts up to ``SAMPLE_CHARS``)
on the driver; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import held_out, without

#: Bounds of the sample: labelled rows, and characters of a sampled text.
SAMPLE, SAMPLE_CHARS = 12288, 20000
#: Lexicon entries occur in so many sampled documents at least; entries in all, and in one lexicon.
LEAST_DOCS, ENTRIES, LEXICON = 5, 384, 6
#: Features of the classifier besides the lexicons' entries.
FEATURES = 1536
EM_STEPS, FIT_STEPS, RATE, L2 = 40, 500, 0.1, 1e-3
BEGINNINGS = (4, 6)

_KEEP = bytes(i if i > 127 or 97 <= i <= 122 else 32 for i in range(256))


def terms(text: str) -> set[bytes]:
    """Lower-case words and, marked by a star, their beginnings."""
    words = set(text.lower().encode("utf-8", "replace").translate(_KEEP).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


#: The patterns of writing.
PATTERNS = ("shouting", "exclaiming", "digits", "signs", "repeating", "short", "long words")


_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SIGNS = b"#$%&*|"
_PLAIN = bytes(i for i in range(128) if not 65 <= i <= 90 and not 97 <= i <= 122)


def patterns(text: str) -> list[float]:
    """A number from 0 to 1 for each of ``PATTERNS``, over the whole text."""
    b = text.encode("utf-8", "replace")
    words = b.split()
    n, w = max(1, len(b)), max(1, len(words))
    count = lambda which: n - len(b.translate(None, which)) if b else 0
    return [
        count(_UPPER) / max(1, len(b.translate(None, _PLAIN))),
        min(1.0, 20 * b.count(b"!") / n),
        count(_DIGITS) / n,
        min(1.0, 5 * count(_SIGNS) / n),
        1.0 - len(set(words)) / w,
        1.0 / (1.0 + w / 20),
        min(1.0, n / w / 20),
    ]


@dataclass
class Model:
    """Weights of terms, of patterns, and the constant."""

    weights: dict[bytes, float]
    shapes: list[float]
    constant: float

    def score(self, text: str | None) -> float:
        text = text or ""
        get = self.weights.get
        z = self.constant + sum([get(t, 0.0) for t in terms(text)])
        if any(self.shapes):
            z += sum(a * b for a, b in zip(self.shapes, patterns(text), strict=True))
        return float(1.0 / (1.0 + np.exp(-min(40.0, max(-40.0, z)))))


@dataclass
class Sample:
    """Sampled texts as arrays of term numbers; terms of fewer than ``LEAST_DOCS`` texts are left out."""

    names: list[bytes]
    docs: list[np.ndarray]
    shapes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Sample:
        """Empties ``texts`` as it goes: a text and its terms are never all held at once."""
        number: dict[bytes, int] = {}
        docs, shapes = [], []
        texts.reverse()
        while texts:
            text = texts.pop()
            docs.append(np.array([number.setdefault(t, len(number)) for t in sorted(terms(text))], np.int32))
            shapes.append(patterns(text))
        count = np.bincount(np.concatenate(docs), minlength=len(number)) if docs else np.zeros(0, int)
        often = count >= LEAST_DOCS
        place = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        names = [t for t, i in number.items() if often[i]]
        return cls(names, [x[x >= 0] for x in (place[d] for d in docs)], np.array(shapes))


def mine(sample: Sample, toxic: np.ndarray) -> tuple[list[int], list[int]]:
    """Lexicon entries, the most precise first, and further features: those whose counts a class explains best (likelihood ratio)."""
    size = len(sample.names)
    count = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int32), *(d for d, y in zip(sample.docs, toxic, strict=True) if y == which)]), minlength=size)
    a, b = count(1), count(0)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    n = max(1, n0 + n1)
    g = np.zeros(size)
    for x, y, z in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b)):
        some = x > 0
        g[some] += 2 * x[some] * np.log(x[some] * n / (y * z[some]))
    precise = (a + 0.5) / (a + b + 1)
    order = sorted(range(size), key=lambda i: (-g[i], sample.names[i]))
    least = max(0.5, 2 * n1 / n)
    lexicon = [i for i in order if g[i] > 10 and precise[i] > least][:ENTRIES]
    known = set(lexicon)
    return sorted(lexicon, key=lambda i: (-precise[i], sample.names[i])), [i for i in order if i not in known][:FEATURES]


def vote(sample: Sample, lexicon: list[int], toxic: np.ndarray) -> np.ndarray:
    """Votes of each voter: 1 toxic, 0 not, -1 none.

    A lexicon votes toxic where one of its entries occurs.  One voter says not toxic
    where no lexicon has an entry.  A pattern votes for the class that is more frequent
    than overall in its upper or lower tenth.
    """
    group = np.full(len(sample.names), -1)
    for k, i in enumerate(lexicon):
        group[i] = k // LEXICON
    hits = np.zeros((len(sample.docs), -(-len(lexicon) // LEXICON)), bool)
    for i, d in enumerate(sample.docs):
        own = group[d]
        hits[i, own[own >= 0]] = True
    votes = [np.where(hits, 1, -1), np.where(hits.any(axis=1), -1, 0)[:, None]]
    share = toxic.mean()
    for x in sample.shapes.T:
        low, high = np.quantile(x, 0.1), np.quantile(x, 0.9)
        v = np.full(len(x), -1)
        for at in (x < low, x > high):
            if at.sum() >= LEAST_DOCS:
                v[at] = int(toxic[at].mean() > share)
        votes.append(v[:, None])
    return np.hstack(votes)


def posterior(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The label model: chances that rows are toxic, from how the voters vote.

    ``toxic`` starts the estimate and stays in it as a prior on each voter's accuracy.
    """
    n, m = votes.shape
    one = np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).astype(float)
    q = toxic.astype(float)
    anchor = np.stack([np.einsum("ijv,i->jv", one, 1 - q), np.einsum("ijv,i->jv", one, q)])
    share = np.ones(m)
    for step in range(EM_STEPS):
        counts = np.stack([np.einsum("ijv,i->jv", one, 1 - q), np.einsum("ijv,i->jv", one, q)]) + anchor + 0.5
        theta = np.log(counts / counts.sum(axis=2, keepdims=True))
        prior = np.log((q.sum() + 1) / (n - q.sum() + 1))
        if step % 10 == 0:  # correlations of what the classes leave unexplained, first by the labels
            expected = np.einsum("i,j->ij", q, np.exp(theta[1, :, 2])) + np.einsum("i,j->ij", 1 - q, np.exp(theta[0, :, 2]))
            left = one[:, :, 2] - expected
            sd = np.sqrt((left**2).mean(axis=0)) + 1e-9
            r = np.clip((left.T @ left) / n / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(r, 0)
            share = np.minimum(share, 1 / (1 + np.where(r > 0.1, r, 0).sum(axis=1)))
        z = prior + np.einsum("ijv,jv->i", one, (theta[1] - theta[0]) * share[:, None])
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - q).max() < 1e-5:
            break
        q = new
    return q


def fit(sample: Sample, features: list[int], q: np.ndarray) -> Model:
    """Logistic regression on posterior labels, by Adam over the whole sample."""
    place = np.full(len(sample.names), -1)
    place[features] = np.arange(len(features))
    found = [place[d][place[d] >= 0] for d in sample.docs]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    col = np.concatenate([np.zeros(0, int), *found])
    shapes, k, n = sample.shapes, len(features), len(found)
    w = np.zeros(k + shapes.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log((q.sum() + 1) / (n - q.sum() + 1))
    for t in range(1, FIT_STEPS + 1):
        z = np.bincount(row, w[col], n) + shapes @ w[k:-1] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - q) / n
        g = np.concatenate((np.bincount(col, e[row], k), e @ shapes, [e.sum()]))
        g[:-1] += L2 / n * 10 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Model({sample.names[i]: float(w[j]) for j, i in enumerate(features) if w[j]}, [float(x) for x in w[k:-1]], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from ``sample`` labelled rows at most outside the held-out fifth, chosen by hash of the id.

    Rows with a null label or id, and texts over ``SAMPLE_CHARS``, are left out before the
    sample is drawn; repeated rows count once.  Without any row, every text scores 0.5.
    """
    ids = labels.select(F.col(doc_id).alias("i"), F.col(toxic).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out("i"))
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).filter(F.length("t") <= SAMPLE_CHARS)
    texts = texts.withColumn("h", F.xxhash64("t"))
    # Ids and hashes are ranked, without the texts; repeated rows are one.
    keys = texts.select("i", "h").join(ids, "i").distinct().orderBy(F.xxhash64("i"), "i", "h", "y").limit(sample)
    keys = docs.sparkSession.createDataFrame(keys.collect(), keys.schema)
    got = texts.join(F.broadcast(keys), ["i", "h"]).groupBy("i", "h", "y").agg(F.min("t").alias("t")).collect()  # ``sample`` rows at most
    got = sorted(got, key=lambda r: (str(r.i), r.t, r.y))
    if not got:
        return Model({}, [0.0] * len(PATTERNS), 0.0)
    y = np.array([int(r.y > 0) for r in got])
    texts = [r.t for r in got]
    del got
    drawn = Sample.of(texts)
    lexicon, rest = mine(drawn, y)
    q = posterior(vote(drawn, lexicon, y), y)
    return fit(drawn, lexicon + rest, q)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` from 0 to 1 and ``predicted``, 1 from 0.5 on.

    Null text counts as empty, which is scored like any other.  Repeated rows get the
    same score; an empty table gives an empty table; input columns named like an output
    are replaced.
    """
    rows = without(docs, "score", "predicted")
    names, at = rows.columns, rows.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column(at)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
