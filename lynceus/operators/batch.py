"""A folder of pictures run through a service: what is done stays done, copies are skipped, the rest is asked and counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators.greedy import DISTANCE, first_kept, near_old
from lynceus.operators.manifest import not_done
from lynceus.sources.scratch import cut

STATES = ("done", "duplicate", "failed", "skipped", "matched")


def sift(files: DataFrame, done: DataFrame, earlier: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(name, state, twin)`` for ``files(id, name, h)`` in the order of their ids: ``done`` by name, else ``duplicate`` of the first picture before within the distance, else ``todo``.

    ``earlier(id, name, h)`` are pictures of earlier runs in their order, all of which
    count; of this run's only those that are no copies do.  A null hash (a picture that
    can't be read) is nobody's copy.
    """
    left = cut(not_done(files, done, "name"))
    sound = left.filter("h is not null").select("id", "h")
    old = near_old(sound, earlier.filter("h is not null").select(F.col("id").alias("order"), "h"), distance)
    old = cut(old.join(earlier.select(F.col("id").alias("order"), F.col("name").alias("twin")), "order").select("id", "twin"))
    own = first_kept(sound.join(old, "id", "left_anti"), distance).filter("twin is not null")
    own = own.join(left.select(F.col("id").alias("twin"), F.col("name").alias("n")), "twin").select("id", F.col("n").alias("twin"))
    twins = old.unionByName(own)
    todo = left.select("id", "name").join(twins, "id", "left").select("name", F.when(F.col("twin").isNull(), "todo").otherwise("duplicate").alias("state"), "twin")
    finished = files.join(done.select("name").distinct(), "name", "left_semi").select("name", F.lit("done").alias("state"), F.lit(None).cast("string").alias("twin"))
    return todo.unionByName(finished)


def run(sifted: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(name, state, twin)`` after asking: ``ask`` takes the names that are left and gives ``(name, ok, found)``; not ok is ``failed``, ok without a find ``skipped``.  A name without an answer has failed."""
    answers = ask(sifted.filter("state = 'todo'").select("name"))
    said = answers.select("name", F.when(~F.coalesce("ok", F.lit(False)), "failed").when(F.coalesce("found", F.lit(False)), "matched").otherwise("skipped").alias("said"))
    state = F.when(F.col("state") == "todo", F.coalesce("said", F.lit("failed"))).otherwise(F.col("state"))
    return sifted.join(said, "name", "left").select("name", state.alias("state"), "twin")


def counts(rows: DataFrame) -> DataFrame:
    """One row: how many of each state."""
    return rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("n"))


#: Fixed value: how a name that is taken is told from the one that has it.
MOVED = " (moved"


def move_plan(report: DataFrame, existing: DataFrame, order: str = "name") -> DataFrame:
    """``(name, folder, <order>, target)`` for the rows of ``report(name, folder)``: a name that is free in the folder, no two the same.

    ``existing(folder, name)`` are there already.  A taken name gets `` (moved)`` before
    its ending, then `` (moved 2)`` and so on; of several files for one name the first in
    the order of the column ``order`` keeps it if it is free.
    """
    cutter = r"^(.*?)(?: \(moved(?: ([0-9]{1,9}))?\))?(\.[^.]*)?$"
    part = lambda i: F.regexp_extract("name", cutter, i)
    number = F.when(part(2) != "", part(2).cast("int")).when(F.col("name").contains(MOVED + ")"), 1).otherwise(0)
    parsed = lambda df: df.withColumns({"stem": part(1), "suffix": part(3), "number": number})
    of = ["folder", "stem", "suffix"]
    have = parsed(existing.select("folder", "name").distinct())
    more = [order] if order != "name" else []
    rows = parsed(report.select("folder", "name", *more).withColumn("row", F.struct(order, F.monotonically_increasing_id())))
    top = have.select(*of, "number").unionAll(rows.select(*of, "number")).groupBy(*of).agg(F.max("number").alias("top"))
    free = rows.join(have.select(*of, "number", F.lit(True).alias("taken")), [*of, "number"], "left").withColumn("first", F.row_number().over(Window.partitionBy(*of, "number").orderBy("row")) == 1)
    stays = F.col("taken").isNull() & F.col("first")
    place = F.row_number().over(Window.partitionBy(*of, "stays").orderBy("number", "row"))
    dealt = free.withColumn("stays", stays).withColumn("place", place).join(top, of)
    given = F.when(F.col("stays"), F.col("number")).otherwise(F.col("top") + F.col("place"))
    tail = F.when(given == 0, "").when(given == 1, MOVED + ")").otherwise(F.concat(F.lit(MOVED + " "), given.cast("string"), F.lit(")")))
    target = F.when(F.col("stays"), F.col("name")).otherwise(F.concat("stem", tail, "suffix"))
    return dealt.select("name", "folder", *more, target.alias("target"))
