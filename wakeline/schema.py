"""Types of trajectory data. Parts that are dynamic in the source are VARIANT."""

from __future__ import annotations

from pyspark.sql import types as T

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.VariantType()), T.StructField("id", T.StringType())])
STEP = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tool_calls", T.ArrayType(CALL)),
    T.StructField("tool_call_id", T.StringType()), T.StructField("name", T.StringType()),
])
TRAJECTORY = T.StructType([
    T.StructField("trajectory_id", T.StringType()), T.StructField("task", T.StringType()), T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("continuation", T.ArrayType(STEP)), T.StructField("summary", T.StringType()), T.StructField("metadata", T.VariantType()),
])
HISTORY = T.StructType([
    T.StructField("instance_id", T.StringType()), T.StructField("problem_statement", T.StringType()),
    T.StructField("history", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
])
MESSAGE = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.VariantType())]))]))),
    T.StructField("tool_call_id", T.StringType()), T.StructField("extra", T.VariantType()),
])
RUN_RECORD = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("instance_id", T.StringType()), T.StructField("exit_status", T.StringType()),
    T.StructField("is_correct", T.DoubleType()), T.StructField("evaluation", T.VariantType()), T.StructField("num_calls", T.IntegerType()),
    T.StructField("submission", T.StringType()), T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("exception_str", T.StringType()),
])
