"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("follower_pubkey", T.StringType()),
        T.StructField("followed_pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)
DISTANCES = T.StructType([T.StructField("pubkey", T.StringType()), T.StructField("distance", T.IntegerType())])
MUTES = T.StructType(
    [
        T.StructField("muter_pubkey", T.StringType()),
        T.StructField("muted_pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)
