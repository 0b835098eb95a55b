"""Readers and writers of manifests, vectors, logs and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.vectors import unpack_floats
from lynceus.operators.manifest import insert_or_replace, not_done, upsert


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header, by name, blanks as null; a missing file is an empty table.

    Every value arrives as text and is cast without failing: what can't be read is null.
    """
    if not exists(spark, path):
        return empty(spark, schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(raw.columns)
    flag = lambda c: F.when(c.isin("1", "true", "True"), True).when(c.isin("0", "false", "False"), False)

    def column(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit(""))
        return (flag(text) if isinstance(f.dataType, T.BooleanType) else text.try_cast(f.dataType)).alias(f.name)

    return raw.select([column(f) for f in schema.fields])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else empty(spark, schema)


def read_vectors(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "capture_id", blob: str | None = None) -> DataFrame:
    """A Parquet vector table, optionally only the keys of ``keys``; ``blob`` names a column of packed floats to decode."""
    v = spark.read.parquet(path)
    if blob:
        v = v.withColumn("embedding", unpack_floats(F.col(blob))).drop(blob)
    return v if keys is None else v.join(keys.select(key), key, "left_semi")


def import_vectors(spark: SparkSession, url: str, table: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A vector table of another database, by JDBC if its driver is there; packed floats are decoded."""
    v = spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver).load()
    return v.withColumn("embedding", unpack_floats(F.col("embedding")))


def list_pictures(spark: SparkSession, root: str) -> DataFrame:
    """``(capture_id, cls, path, length, modificationTime)`` of ``root/<class>/<id>.jpg``; names that aren't numbers are skipped, bytes aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(f"{root}/*")
    files = files.select("path", "length", "modificationTime")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("cls"), F.regexp_extract("path", r"([^/]+)\.jpg$", 1).try_cast("long").alias("capture_id"), "path", "length", "modificationTime")
    return named.filter("capture_id is not null")


def list_folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "heic")) -> DataFrame:
    """Files of one folder with one of the extensions in any case; subfolders aren't entered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root).select("path", "length", "modificationTime")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def digest_pictures(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(f"{root}/*")
    return files.select("path", F.sha1("content").alias("sha1"))


def flatten_captures(answers: DataFrame, body: str = "body") -> DataFrame:
    """Nested answers of a service (an individual with captures and encounters) as one row a capture, with the encounter's date."""
    schema = "id long, captures array<struct<id:long,view:string,date:string,original_filename:string,encounter_id:long>>, encounters array<struct<id:long,date:string>>"
    a = answers.select(F.from_json(F.col(body), schema).alias("a")).select("a.*")
    dates = F.map_from_entries(F.transform(F.coalesce("encounters", F.expr("array()").cast("array<struct<id:bigint,date:string>>")), lambda e: F.struct(e.id, e.date)))
    c = a.select(F.col("id").alias("app_turtle_id"), dates.alias("dates"), F.explode("captures").alias("c"))
    day = F.coalesce(F.nullif("c.date", F.lit("")), F.nullif(F.regexp_extract("c.original_filename", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    return c.select(
        F.col("c.id").alias("capture_id"), "app_turtle_id", "c.view", day.try_cast("date").alias("captured_date"), "c.original_filename", "c.encounter_id",
        F.when(F.col("c.encounter_id").isNotNull(), F.try_element_at("dates", F.col("c.encounter_id"))).try_cast("date").alias("encounter_date"),
    )


def _writer(df: DataFrame, form: str, mode: str):
    w = df.write.mode(mode)
    if form == "csv":  # as read_csv reads it: quotes doubled, white space kept
        w = w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return w.format(form)


def overwrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a table as a whole, after the new rows are complete: they are written beside it first, so a failed write leaves the old ones."""
    spark, target = df.sparkSession, f"{path.rstrip('/')}.next"
    _writer(df, form, "overwrite").save(target)
    _swap(spark, target, path)


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    _writer(df, form, "append").save(path)


def append_new(df: DataFrame, path: str, *key: str) -> None:
    """Resume: append the rows whose key the table doesn't hold yet."""
    recover(df.sparkSession, path)
    done = df.sparkSession.read.parquet(path) if exists(df.sparkSession, path) else df.limit(0)
    append(not_done(df, done, *key), path)


def upsert_table(new: DataFrame, path: str, key: str, version: str, stale: tuple[str, ...] = ()) -> str:
    """Merge into a Parquet table, which a failed merge leaves as it was."""
    spark = new.sparkSession
    recover(spark, path)
    overwrite(upsert(spark.read.parquet(path), new, key, version, stale) if exists(spark, path) else new, path)
    return path


def replace_rows(new: DataFrame, path: str, key: str) -> str:
    """Rows of ``new`` replace those of its keys in a Parquet table, which a failure leaves as it was."""
    spark = new.sparkSession
    recover(spark, path)
    overwrite(insert_or_replace(spark.read.parquet(path), new, key) if exists(spark, path) else new, path)
    return path


def check_keys(rows: DataFrame, *key: str, unique: bool = True) -> DataFrame:
    """The rows; an action on them fails where a key column is null, or, checked at once, where a key occurs twice."""
    whole = rows
    for c in key:
        whole = whole.filter(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.lit(True)).cast("boolean"))
    if unique and not rows.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} occurs more than once")
    return whole


def recover(spark: SparkSession, path: str) -> None:
    """Put back what a swap set aside, if it was broken off between its two renames."""
    fs, here = _file_system(spark, path)
    old = _path(spark, f"{path.rstrip('/')}.old")
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _swap(spark: SparkSession, source: str, target: str) -> None:
    """Set the old table aside, rename the new one into its place, delete the old one; a failed rename puts the old one back."""
    fs, a = _file_system(spark, source)
    b, old = _path(spark, target), _path(spark, f"{target.rstrip('/')}.old")
    fs.delete(old, True)
    aside = fs.exists(b) and fs.rename(b, old)
    moved = False
    try:
        moved = fs.exists(a) and fs.rename(a, b)
    finally:
        if not moved and aside:
            fs.rename(old, b)
    if not moved:
        raise OSError(f"{source} could not take the place of {target}")
    fs.delete(old, True)
