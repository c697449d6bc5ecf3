"""Record shapes shared by the operators."""

from pyspark.sql import types as T

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("mapc", T.StringType()),
    T.StructField("ten", T.StringType()),
    T.StructField("noidung", T.StringType()),
    T.StructField("tenchuong", T.StringType()),
    T.StructField("tendemuc", T.StringType()),
    T.StructField("tenchude", T.StringType()),
    T.StructField("passage", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_label", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("trust_score", T.DoubleType()),
    T.StructField("trust_level", T.StringType()),
])

MEMORY_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("mem_id", T.LongType()),
    T.StructField("fact", T.StringType()),
    T.StructField("mem_type", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("deleted_at", T.TimestampType()),
])

HISTORY = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("root", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("mem_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("fact", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("reason", T.StringType()),
    T.StructField("negated_by", T.StringType()),
])

REPORT = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("fact", T.StringType()),
    T.StructField("action", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tts_url", T.StringType()),
    T.StructField("feedback", T.StringType()),
])

CHAT_SCHEMA = T.StructType([
    T.StructField("chat_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("pinned", T.BooleanType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

EVAL_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("gold_docs", T.ArrayType(T.LongType())),
    T.StructField("gold_response", T.StringType()),
])

FACT_ARRAY = "array<struct<fact:string,type:string>>"
SITUATION = ("struct<is_complex:boolean,tom_tat:string,cac_vi_pham:array<struct<id:int,"
             "chu_the:string,hanh_vi:string,nhom_luat:string,muc_do:string,"
             "queries:array<string>>>>")
