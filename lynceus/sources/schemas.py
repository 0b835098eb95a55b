"""Schemas of the tables as they are read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "binary": T.BinaryType(), "floats": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


CLASSIFICATIONS = _schema("capture_id long, turtle_name string, file_path string, category string, media_type string, confidence string")
SPLITS = T.StructType([*CLASSIFICATIONS.fields, T.StructField("split", T.StringType())])
CAPTURES = _schema("capture_id long, app_turtle_id long, view string, captured_date date, original_filename string, encounter_id long, encounter_date date")
CROPS = _schema("capture_id long, turtle_name string, found boolean, ymin int, xmin int, ymax int, xmax int, crop_model string")
DUPLICATES = _schema("capture_id_a long, capture_id_b long, pixel_diff double, turtle_a string, turtle_b string, filename_a string, filename_b string")
HELD_OUT = _schema("capture_id long, turtle_name string, reason string, original_filename string, encounter_date date, added date")
PREDICTIONS = _schema("capture_id long, file_path string, true string, pred_top1 string, correct_top1 int, correct_top5 int, top5 string")
SESSION_LOG = _schema("time timestamp, upload_id string, event string, method string, filename string, box string, top1 string, top1_sim double, top5 string, likely_new boolean, verdict string, true_name string, notes string")
VECTORS = _schema("capture_id long, turtle_name string, file_path string, sha1 string, model string, dim int, embedding floats")
PHOTO_META = _schema("upload_id string, filename string, taken timestamp")
SKIPPED = _schema("time timestamp, upload_id string, filename string, reason string")
SORT_REPORT = _schema("filename string, folder string, reason string")
VIEW_ANSWERS = _schema("id long, turtle string, found boolean, photo string, head string, view string, error string").add("box_2d", T.ArrayType(T.IntegerType()))
