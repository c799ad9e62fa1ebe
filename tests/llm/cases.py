"""Documents with the cases that every operator has to define, and a table with none."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # Names that operators use themselves.
                       *[T.StructField(c, T.StringType()) for c in ("id", "key", "row", "digest", "shard", "slot", "token_ids", "held_out", "fp")]])

LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 20_000

TEXTS = [
    (1, "Hello world, this is a text about the weather in the north."), (2, "Hello  world,\nthis is a text about the weather in the north."),
    (3, "hello world, this is a text about the weather in the north."), (4, None), (5, ""), (6, "   \t\n "), (7, "Bonjour le monde, il fait beau dans les Alpes."), (7, "Bonjour le monde, il fait beau dans les Alpes."),
    (8, LONG), (9, "12345 !!! 67890"), (None, "A row without an id."), (None, None), (10, "▁é😀 日本 <|endoftext|> don't stop"), (11, "word"), (2, "the same id with another text"),
]


def documents(spark):
    return spark.createDataFrame([(i, t, "en" if t and "the" in t else None, None, len(t or ""), *["x"] * 9) for i, t in TEXTS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
