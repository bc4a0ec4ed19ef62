"""Row shapes shared by sources, sinks and jobs."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

CORRUPT = "_corrupt_record"

CLASSIFIED = StructType([
    StructField("url", StringType()),
    StructField("score", DoubleType()),
    StructField("classification", StringType()),
    StructField("time_added", TimestampType()),
])

CLASSIFIED_DDL = "url string, score double, classification string, time_added timestamp"

LABELLED = StructType([
    StructField("url", StringType()),
    StructField("label", IntegerType()),
])

CERT_MESSAGE = StructType([
    StructField("message_type", StringType()),
    StructField("data", StructType([
        StructField("leaf_cert", StructType([
            StructField("all_domains", ArrayType(StringType())),
        ])),
    ])),
    StructField(CORRUPT, StringType()),
])

CERT_RECORDS = ArrayType(StructType([
    StructField("id", LongType()),
    StructField("name_value", StringType()),
    StructField("common_name", StringType()),
]))

URL_BATCH = StructType([
    StructField("urls", ArrayType(StringType())),
    StructField(CORRUPT, StringType()),
])
