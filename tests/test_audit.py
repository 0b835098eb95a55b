"""Label audit with known duplicates, views and dates."""

from lynceus.operators.audit import flags


def test_flags_with_duplicates_views_and_dates(spark):
    photos = spark.createDataFrame(
        [(1, 1, "left", "d1", True), (2, 2, "left", "d1", True), (3, 1, "left", "d2", True), (4, 3, "left", "d1", True), (5, 3, "left", "d1", True), (6, 1, "front", "d1", False), (7, 1, "front", "d2", False), (8, 1, "left", "d1", True)],
        "id long, cls int, view string, date string, side boolean",
    )
    truth = photos.selectExpr("id AS q", "cls AS true_cls")
    best = spark.createDataFrame(
        [(1, 2, 2, 0.99), (1, 1, 3, 0.5), (2, 1, 1, 0.99), (3, 1, 1, 0.5), (4, 3, 5, 0.05), (6, 1, 7, 0.05), (8, 1, 3, 0.05), (8, 2, 2, 0.2)],
        "q long, cls int, ref long, score double",
    )
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    got = {r.q: (r.flag, r.duplicate, r.own_ref, r.other_ref) for r in flags(best, truth, 0.35, 0.1, pairs, photos).collect()}
    # 1 and 2 are one picture: its copy in another class doesn't make it misfiled.
    assert got[1] == ("", True, 3, None) and got[2] == ("", True, None, None)
    # 4 has the view on its own date only, 6 isn't a side view, 8 has one to compare with.
    assert [got[i][0] for i in (3, 4, 6, 8)] == ["", "", "", "no match"] and not got[8][1]
    plain = {r.q: r.flag for r in flags(best, truth, 0.35, 0.1).collect()}
    assert [plain[i] for i in (1, 2, 3, 4, 6, 8)] == ["misfiled", "misfiled", "", "no match", "no match", "no match"]
