"""Personal data by candidate boosting, in DataFrame and SQL expressions only.

Base rules find email addresses, IP addresses, payment cards and phone numbers; their
spans always stay.  High-recall generators propose more spans, which may overlap
(obfuscated addresses, IPv6, any long group of digits as card and as phone, long mixed
strings as secrets).  Boosted trees score the candidates by format and context.

Nobody has labelled the candidates, so they are learned from positive and unlabelled
rows.  What labels a candidate is held back from the trees: a base rule of its kind finds
it, or two generators agree, a word of its kind stands before it and it has a form of
its kind (a card's issuer and grouping, a telephone's beginning, letters and digits of
a secret).  All others are unlabelled, not negative.  The trees see neither the words nor
those forms nor what a base rule tests (the sign ``@``, the plus, Luhn's digit, the range
of an IP address), but how long a candidate is, how its digits are grouped, how it ends
and what stands around it; so what merely lacks a label scores like its labelled
neighbours, and a word alone makes nothing a finding.  On the half of the candidates that
the trees were not grown on, a threshold for each kind is calibrated: going down from the
highest scores, each block of candidates must have ``PRECISION`` of the best block's
share of positives, and that ``LEAST_SHARE``.  A card passes Luhn's check, so digits that
fail it are proposed as one only where both generators say so.

The text is scanned once.  Each match becomes a row with the length of the gap before
it; places are running sums of a document's rows, and whether a base span overlaps is a
running maximum, so a text with many matches is linear work.  Features are discrete, so
the learning set is a table of feature combinations with counts over all documents; the
trees become a SQL expression again.

Patterns are written so that no search is quadratic and no repetition recurses: a
candidate may start only at the start of its run or right behind the match before
(``\\G``), which is where a leftmost match starts anyway, and groups repeat
possessively, which changes nothing where nothing follows them.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.llm.common import PREFIX, RID, Scratch, text_or_empty, with_row_id, without

#: Kinds of base spans, in the order in which spans of one start are told; secrets are only found by the method.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# The patterns of the base rules.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# The generators.
HIDDEN_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
DIGITS = r"[+]?[0-9(](?:[\x20()./-]{0,2}[0-9]){7,}+"
SECRET = r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]{20,}+={0,2}+"
#: Words that speak for a kind, right before it.
CONTEXT = (
    r"(?i)(?:e?-?mail|contact|write to|reach)[^A-Za-z0-9]{0,4}(?:(?:is|at|me|us)[^A-Za-z0-9]{1,3})?$",
    r"(?i)(?<![a-z])(?:ip|addr|address|host|server|from)[^A-Za-z0-9]{0,4}$",
    r"(?i)(?:card|visa|mastercard|amex|credit|debit|iban|account)(?:[^A-Za-z0-9]{1,2}(?:no|nr|number))?[^A-Za-z0-9]{0,4}$",
    r"(?i)(?<![a-z])(?:tel|phone|telephone|call|fax|mobile|cell)(?:[^A-Za-z0-9]{1,2}(?:no|nr|number|me at))?[^A-Za-z0-9]{0,4}$",
    r"(?i)(?:token|key|secret|password|passwd|pwd|credential)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?$",
)
#: Characters between a candidate and the match before it that are its context.
WINDOW = 32
#: Boosting rounds, depth, learning rate, least weight of a leaf.
ROUNDS, DEPTH, RATE, LEAF = 32, 4, 0.3, 4.0
#: Share of the best block's share of positives that each block over the threshold has, candidates of a block at least (but for a kind with one score), and the positives that a kind needs on either half.
PRECISION = 0.8
BLOCK = 3
LEAST_POSITIVE = 4
#: The least share of positives in a kind's best block: below it the unlabelled ones say more than the positives.
LEAST_SHARE = 0.4

#: The features: kind; length; signs between the digits; lengths of the last groups, or the end; the characters around it.
FEATURES = ("k", "nd", "grouped", "form", "before", "behind")
#: Forms of cards and telephones by which a word before them is believed; dates are neither.
CARD_FORM = r"^[3-6](?:[0-9]{11,18}|[0-9]{3}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?|[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5})$"
PHONE_FORM = r"^[+(0]|[0-9][\x20()./-]{1,2}[0-9]"
DATE_FORM = r"^(?:(?:19|20)[0-9]{2}[\x20./-]?[01][0-9][\x20./-]?[0-3][0-9]\x20?){1,2}$|^[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}$"

_M, _TEXT, _SPANS, _BASE = (PREFIX + x for x in ("matches", "text", "spans", "base"))
#: Patterns with the guard that lets most texts skip the search; those of the base rules come first, IP serves both.
_PATTERNS = ((EMAIL, "contains({t}, '@')"), (IP, "contains({t}, '.')"), (CARD, "true"), (PHONE, "contains({t}, '+')"),
    (HIDDEN_EMAIL, "(contains({t}, '@') or contains({t}, '(at)') or contains({t}, '[at]'))"), (IPV6, "contains({t}, ':')"), (DIGITS, "true"), (SECRET, "true"))


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27").replace('"', "\\x22") + "'"


def _matches(text: str, number: int, pattern: str, guard: str) -> str:
    """SQL for the matches of a pattern, each with what is needed of the gap before it; a last element has the gap behind."""
    made = f"struct({number} as p, cast(0 as int) as pos, 0 as g, '' as l, '' as f, cast(null as string) as t)"
    each = f"struct({number} as p, i as pos, length(z.`0`) as g, right(z.`0`, {WINDOW}) as l, left(z.`0`, 1) as f, z.`1` as t)"
    found = f"transform(arrays_zip(split({text}, {_q(pattern)}, -1), regexp_extract_all({text}, {_q(pattern)}, 0)), (z, i) -> {each})"
    return f"if({guard.format(t=text)} and rlike({text}, {_q(pattern)}), {found}, filter(array({made}), x -> false))"


def _luhn(t: str) -> str:
    """SQL: 12 to 19 digits pass Luhn's check.  Counted from the right, every second digit counts as its doubled digit sum."""
    d = f"reverse(regexp_replace({t}, '[^0-9]', ''))"
    total = f"aggregate(sequence(1, least(19, greatest(1, length({d})))), 0, (a, i) -> a + coalesce(try_cast(if(i % 2 = 1, substr({d}, i, 1), translate(substr({d}, i, 1), '0123456789', '0246813579')) as int), 0))"
    return f"if(length({d}) between 12 and 19, {total} % 10 = 0, false)"


def placed(narrow: DataFrame) -> DataFrame:
    """``(RID, p, t, s, e, l, before, behind)``: every match of every pattern with its place in code points; one exchange by row."""
    each = narrow.filter(F.size(_M) > 0).select(RID, F.explode(_M).alias("x")).select(RID, "x.*").repartition(RID)
    by = Window.partitionBy(RID, "p").orderBy("pos")
    end = F.sum(F.col("g") + F.coalesce(F.length("t"), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("e", end.cast("int")).withColumn("behind", F.coalesce(F.lead("f").over(by), F.lit("")))
    # What stands before a match may reach into the one before it.
    found = found.withColumn("l", F.right(F.concat(F.coalesce(F.right(F.lag("t").over(by), F.lit(WINDOW)), F.lit("")), "l"), F.lit(WINDOW)))
    found = found.filter(F.col("t").isNotNull())
    return found.select(RID, "p", "t", (F.col("e") - F.length("t")).alias("s"), "e", "l", F.right("l", F.lit(1)).alias("before"), "behind")


def base_of(found: DataFrame) -> DataFrame:
    """The base spans ``(RID, k, s, e)`` among the matches."""
    n = F.length(F.regexp_replace("t", "[^0-9]", ""))
    p = F.col("p")
    ok = F.when(p == 0, True).when(p == 1, F.col("t").rlike(OCTETS)).when(p == 2, F.expr(_luhn("t"))).when(p == 3, n.between(9, 15)).otherwise(False)
    return found.filter(ok).select(RID, p.alias("k"), "s", "e")


def candidates_of(found: DataFrame) -> DataFrame:
    """The proposed spans ``(RID, s, e, fold, <FEATURES>, said)``; a group of digits may be proposed as card and as phone, numbers over 255 are no address.  ``said`` is whether a word of the kind and the form agree."""
    n = F.length(F.regexp_replace("t", "[^0-9]", ""))
    both = F.when(n.between(12, 15), F.array(F.lit(2), F.lit(3))).when(n.between(12, 19), F.array(F.lit(2))).when(n.between(8, 15), F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))
    mixed = F.col("t").rlike("[0-9]") & F.col("t").rlike("[A-Za-z]")
    kinds = (
        F.when(F.col("p") == 4, F.array(F.lit(0))).when((F.col("p") == 5) | ((F.col("p") == 1) & F.col("t").rlike(OCTETS)), F.array(F.lit(1))).when(F.col("p") == 6, both).when((F.col("p") == 7) & mixed, F.array(F.lit(4)))
    )
    rows = found.withColumn("n", n).withColumn("k", F.explode(kinds))
    k, t = F.col("k"), F.col("t")
    near = lambda c: F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}_]$"), 1).otherwise(2)
    # Of an IP address only the characters around it are told: its form is what the base rule tests.
    nd = (
        F.when(k.isin(0, 1), 0).when(k == 4, F.least(F.floor(F.length("t") / 8), F.lit(8)).cast("int")).when(k == 3, F.when(F.col("n") < 9, 1).otherwise(2))
        .when(F.col("n") < 14, 3).when(F.col("n") < 16, 4).when(F.col("n") == 16, 5).otherwise(6)
    )
    inner = F.regexp_replace("t", r"^[+(]+", "")
    grouped = F.when(k == 4, (t.rlike("[a-z]") & t.rlike("[A-Z]")).cast("int")).when(~k.isin(2, 3), 0).when(~inner.rlike("[^0-9]"), 0).when((k == 2) | t.rlike(r"\("), 1).when(inner.rlike(r"[./]"), 3).otherwise(4)
    name = F.regexp_extract("t", r"([A-Za-z0-9-]+)$", 1)
    # The last group of digits and the one before it without a leading nought: local and international forms of a number share them.
    last, group = F.length(F.regexp_extract("t", r"([0-9]+)$", 1)), F.length(F.regexp_extract("t", r"(?:^|[^0-9])0?([0-9]+)[^0-9]+[0-9]+$", 1))
    tail = F.when(last < 4, 1).when(last == 4, 2).when(last < 7, 3).when(last < 9, 4).otherwise(5) * 3 + F.when(group == 0, 0).when(group < 5, 1).otherwise(2)
    form = (
        F.when(k == 0, F.when(name.rlike("(?i)^(?:com|org|net|edu|gov|info|io|co|[a-z]{2})$"), 1).when(name.rlike("^[A-Za-z]{3,6}$"), 2).otherwise(3))
        .when(k.isin(2, 3), tail)
        .when(k == 4, F.when(t.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1).when(t.rlike("^[A-Za-z0-9]+$"), 2).otherwise(3))
        .otherwise(0)
    )
    word = F.lit(False)
    for i, pattern in enumerate(CONTEXT):
        word = F.when(k == i, F.col("l").rlike(pattern)).otherwise(word)
    agrees = F.when(k == 2, t.rlike(CARD_FORM)).when(k == 3, t.rlike(PHONE_FORM)).otherwise(True) & (~k.isin(2, 3) | ~t.rlike(DATE_FORM))
    # Digits within a longer word or number are no card or telephone.
    rows = rows.filter(~k.isin(2, 3) | ~F.concat("before", "behind").rlike("[A-Za-z0-9_]"))
    row = rows.select(
        RID, "s", "e", F.pmod(F.xxhash64("t"), F.lit(2)).alias("fold"), "k", nd.alias("nd"), grouped.alias("grouped"), form.alias("form"),
        near(F.col("before")).alias("before"), near(F.col("behind")).alias("behind"), (word & agrees).alias("said"), "t",
    )
    return row.filter((F.col("k") != 2) | F.col("said") | F.expr(_luhn("t"))).drop("t").distinct()


def with_hits(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """The candidates with ``hit``, whether a base span of their kind overlaps, and ``taken``, whether any does; running maxima of a row's spans."""
    both = candidates.withColumn("base", F.lit(False)).unionByName(base.withColumn("base", F.lit(True)), allowMissingColumns=True)
    left = Window.partitionBy(RID).orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(RID).orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)
    over = []
    for i in range(len(KINDS)):
        own = F.col("base") & (F.col("k") == i)
        over.append((F.max(F.when(own, F.col("e"))).over(left), F.min(F.when(own, F.col("s"))).over(right)))
    marked = both.select("*", *[x.alias(f"{side}{i}") for i, pair in enumerate(over) for side, x in zip("lr", pair, strict=True)]).filter(~F.col("base"))
    meets = [F.coalesce((F.col(f"l{i}") > F.col("s")) | (F.col(f"r{i}") < F.col("e")), F.lit(False)) for i in range(len(KINDS))]
    hit = F.lit(False)
    for i, m in enumerate(meets):
        hit = F.when(F.col("k") == i, m).otherwise(hit)
    taken = meets[0]
    for m in meets[1:]:
        taken = taken | m
    return marked.select(RID, "s", "e", "fold", *FEATURES, "said", hit.alias("hit"), taken.alias("taken"))


class Tree:
    """A regression tree over discrete features: ``feature = value`` or not."""

    def __init__(self, rows: list, depth: int):
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.value, self.test = -g / (h + 1.0), None
        best = 1e-9
        for name in FEATURES if depth else ():
            sums: dict = {}
            for f, a, b, w in rows:
                x = sums.setdefault(f[name], [0.0, 0.0, 0.0])
                x[0], x[1], x[2] = x[0] + a, x[1] + b, x[2] + w
            weight = sum(x[2] for x in sums.values())
            for value in sorted(sums):
                a, b, w = sums[value]
                if min(w, weight - w) < LEAF:
                    continue
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best:
                    best, self.test = gain, (name, value)
        if self.test:
            name, value = self.test
            self.yes = Tree([r for r in rows if r[0][name] == value], depth - 1)
            self.no = Tree([r for r in rows if r[0][name] != value], depth - 1)

    def __call__(self, f: dict) -> float:
        return self.value if not self.test else (self.yes if f[self.test[0]] == self.test[1] else self.no)(f)

    def sql(self, row: str) -> str:
        if not self.test:
            return f"{self.value!r}D"
        return f"if({row}.{self.test[0]} = {self.test[1]}, {self.yes.sql(row)}, {self.no.sql(row)})"


def boost(table: Iterable[tuple[dict, int, float, float]]) -> tuple[list[Tree], dict[int, float]]:
    """Trees for the log-odds of a positive, grown on fold 0 of ``(features, fold, positives, all)``, and each kind's threshold, calibrated on fold 1."""
    rows = sorted(table, key=lambda r: (r[1], sorted(r[0].items())))
    grow = [r for r in rows if r[1] == 0]
    score, trees = [0.0] * len(grow), []
    for _ in range(ROUNDS):
        work = []
        for (f, _fold, hit, n), s in zip(grow, score, strict=True):
            p = 1 / (1 + exp(-s))
            work.append((f, n * p - hit, n * p * (1 - p), float(n)))
        if not work:
            break
        trees.append(Tree(work, DEPTH))
        score = [s + RATE * trees[-1](f) for (f, *_), s in zip(grow, score, strict=True)]
    thresholds = {}
    for k in range(len(ALL_KINDS)):
        grown = sum(hit for f, fold, hit, _ in rows if fold == 0 and f["k"] == k)
        levels: dict[float, list[float]] = {}
        for f, fold, hit, n in rows:
            if fold == 1 and f["k"] == k:
                x = levels.setdefault(round(RATE * sum(t(f) for t in trees), 9), [0.0, 0.0])
                x[0], x[1] = x[0] + hit, x[1] + n
        if grown < LEAST_POSITIVE or sum(x[0] for x in levels.values()) < LEAST_POSITIVE:
            continue
        best = hits = total = 0.0
        for s in sorted(levels, reverse=True):
            hits, total = hits + levels[s][0], total + levels[s][1]
            if total < BLOCK and len(levels) > 1:
                continue
            best = max(best, hits / total)
            if hits < PRECISION * best * total or best < LEAST_SHARE:
                break
            thresholds[k], hits, total = s - 1e-6, 0.0, 0.0
    return trees, thresholds


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``base`` and ``spans``, sorted ``array<struct<s, k, e>>``.

    Places are code points, the end exclusive; ``k`` counts in ``ALL_KINDS``.  ``spans``
    holds all of ``base`` and the added candidates, which overlap no base span.  Null
    text counts as empty and has no spans.  Repeated rows get the same spans.  Of a kind
    with fewer than ``LEAST_POSITIVE`` positives on either half of the rows nothing is
    added; an empty table gives an empty table; input columns named like an output are
    replaced.
    """
    scratch = Scratch(docs.sparkSession, "private")
    rows = without(docs, "base", "spans")
    names = [f"`{c}`" for c in rows.columns if c != text]
    arrays = F.expr("concat(" + ", ".join(_matches(_TEXT, i, p, g) for i, (p, g) in enumerate(_PATTERNS)) + ")")
    narrow = with_row_id(scratch, rows.withColumn(_TEXT, text_or_empty(text)).select(*names, arrays.alias(_M)), "matches")
    found = scratch.save(placed(narrow), "places")
    base = base_of(found)
    hits = scratch.save(with_hits(candidates_of(found), base), "candidates")
    # Positives: a base rule of the kind, or a word and the form agree.  The half of a candidate goes by its text, so its copies are of one half.
    positive = F.col("hit") | F.col("said")
    counts = hits.groupBy(*FEATURES, "fold").agg(F.count_if(positive).alias("hits"), F.count(F.lit(1)).alias("n"))
    # Two folds of the product of the features' values at most.
    trees, thresholds = boost([({f: r[f] for f in FEATURES}, r.fold, float(r.hits), float(r.n)) for r in counts.collect()])
    spans = base.select(RID, "s", "k", "e", F.lit(True).alias("base"))
    if trees and thresholds:
        score = f"{RATE}D * (" + " + ".join(t.sql("x") for t in trees) + ")"
        least = "case k " + " ".join(f"when {k} then {v!r}D" for k, v in thresholds.items()) + " end"
        added = hits.filter(~F.col("taken")).withColumn("x", F.struct(*FEATURES)).filter(F.expr(f"coalesce({score} >= {least}, false)"))
        spans = spans.unionAll(added.select(RID, "s", "k", "e", F.lit(False)).distinct())
    one = F.struct("s", "k", "e")
    per = spans.groupBy(F.col(RID).alias(RID + "_")).agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias(_BASE), F.array_sort(F.collect_list(one)).alias(_SPANS))
    joined = narrow.drop(_M).join(scratch.save(per, "spans"), F.col(RID) == F.col(RID + "_"), "left")
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    return joined.select(*names, F.coalesce(_BASE, none).alias("base"), F.coalesce(_SPANS, none).alias("spans"))


def told(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = "element_at(array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + "), x.k + 1)"
    return F.expr(f"array_join(transform({spans}, x -> concat({kind}, ':', x.s, ':', x.e)), ',')")


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns, ``n_found`` (all spans, secrets too) and ``secrets``; ``spans`` has the kinds of the contract."""
    found = find_private(docs.select("doc_id", "text"))
    found = found.withColumn("listed", F.expr(f"filter(spans, x -> x.k < {len(KINDS)})")).withColumn("hidden", F.expr(f"filter(spans, x -> x.k >= {len(KINDS)})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    sha = F.sha2(told("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, sha, told("listed").alias("spans"), F.size("spans").cast("long").alias("n_found"), told("hidden").alias("secrets"))
