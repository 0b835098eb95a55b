"""What labels a candidate is no feature: words alone find nothing, shapes like confirmed ones are found without a word."""

import random

from lynceus.llm import pii


def found(spark, rows):
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    return [{(pii.ALL_KINDS[x.k], t[x.s : x.e].strip()) for x in got[i]} for i, t in enumerate(rows)]


def key(rng, n=32):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))


def test_no_feature_is_the_label():
    assert not {"ctx", "said", "hit", "l"} & set(pii.FEATURES)


def test_key_and_value(spark):
    rng = random.Random(1)
    keys = [key(rng) for _ in range(160)]
    forms = ["api_key={}", "token: {}", 'a_rather_long_setting_name_2_secret = "{}" ends', "export PASSWORD={}; run"]
    rows = [forms[i % 4].format(k) for i, k in enumerate(keys)]
    assert all(("secret", k) in f for k, f in zip(keys, found(spark, rows), strict=True))


def test_long_words_behind_a_key_are_none(spark):
    rows = [f"the key: internationalisation_of_words_{'abc'[i % 3]} is long" for i in range(40)]
    assert not any(found(spark, rows))


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_dates_behind_a_word_are_no_cards_or_telephones(spark):
    rng = random.Random(2)
    day = lambda: f"20{rng.randint(10, 29)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    pairs = [p for p in ((day(), day()) for _ in range(80)) if not luhn("".join(p))]
    rows = [f"bank account: {a} {b}" for a, b in pairs] + [f"call {a} then" for a, _ in pairs] + [f"mobile no: {a[:4]}-{a[4:6]}-{a[6:]}" for a, _ in pairs]
    assert not any(found(spark, rows))


def test_shapes_of_confirmed_ones_are_found_without_a_word(spark):
    rng = random.Random(3)
    local = [f"0555 {rng.randint(1_000_000, 9_999_999)}" for _ in range(40)]
    rows = [f"nummer {n}" for n in local] + [f"ring +49 555 {rng.randint(1_000_000, 9_999_999)}" for _ in range(40)] + [f"order {20_000_000 + 17 * i} of goods" for i in range(60)]
    got = found(spark, rows)
    assert all(("phone", n) in f for n, f in zip(local, got, strict=False))
    assert not any(got[80:])


def test_cards_with_other_signs_are_found_by_shape(spark):
    rng = random.Random(4)

    def card():
        d = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    plain = [card() for _ in range(60)]
    group = lambda d, s: s.join(d[i : i + 4] for i in range(0, 16, 4))
    rows = [f"paid with {group(d, '-')} at noon" for d in plain[:40]] + [f"paid with {group(d, '.')} at noon" for d in plain[40:]]
    got = found(spark, rows)
    assert all(("card", group(d, ".")) in f for d, f in zip(plain[40:], got[40:], strict=True))
