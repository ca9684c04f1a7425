"""Record schemas. Nothing is inferred from data; optional fields are nullable."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

FILE_INFO = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("api_name", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("api_calls", STRINGS),
        T.StructField("changelog_lines", STRINGS),
        T.StructField("procedure_function_names", STRINGS),
    ]
)
RANKED = T.StructType([*FILE_INFO.fields, T.StructField("pagerank_score", T.DoubleType()), T.StructField("pagerank_rank", T.IntegerType())])
FILE_METADATA = T.StructType([T.StructField("rank", T.IntegerType()), *FILE_INFO.fields])
PROCESSING_RESULT = T.StructType(
    [
        T.StructField("file_metadata", FILE_METADATA),
        T.StructField("success", T.BooleanType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("bm25_text", T.StringType()),
        T.StructField("content_excerpt", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("tokens_used", T.IntegerType()),
        T.StructField("has_ai_summary", T.BooleanType()),
    ]
)
CHECKPOINT = T.StructType([*PROCESSING_RESULT.fields, T.StructField("timestamp", T.TimestampType())])
ANALYSIS = T.StructType(
    [
        T.StructField(
            "analysis_metadata",
            T.StructType(
                [
                    T.StructField("work_directory", T.StringType()),
                    T.StructField("max_context_tokens", T.IntegerType()),
                    T.StructField("analysis_timestamp", T.StringType()),
                    T.StructField("processing_stats", T.StructType([T.StructField("total_files_found", T.LongType()), T.StructField("total_files_processed", T.LongType()), T.StructField("total_api_calls_found", T.LongType())])),
                ]
            ),
        ),
        T.StructField("file_info", T.ArrayType(FILE_INFO)),
        T.StructField("reference_graph", T.MapType(T.StringType(), STRINGS)),
    ]
)
#: Search hits while they are ranked.
HITS = ["path", "file_name", "api_name", "rank", "score", "source", "match_type", "title", "snippet", "explanation"]
