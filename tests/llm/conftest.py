import pytest
from pyspark.sql import types as T

#: Names that operators use inside; tables may have columns of these names too.
CLASHES = ["fp", "k1", "k2", "k", "root", "words", "uid", "h", "n", "chunk", "start", "end", "block", "row", "spans", "word", "size", "slot", "a", "b", "score", "held_out", "piece", "vec", "gid", "ids", "tbl", "at"]
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def messy_rows():
    twin = "The quick brown fox jumps over the lazy dog near the river bank today. It was a fine day for foxes and for dogs alike."
    return [
        (1, twin, "en"),
        (2, twin, "en"),
        (3, twin + " Indeed.", "en"),
        (3, twin + " Indeed.", "en"),
        (4, None, "en"),
        (5, "", None),
        (6, "   \n\t ", "de"),
        (7, "12345 !!! ---", "de"),
        (None, "Der schnelle braune Fuchs springt ueber den faulen Hund am Ufer.", "de"),
        (None, "Der schnelle braune Fuchs springt ueber den faulen Hund am Ufer.", "de"),
        (8, LONG, None),
        (9, "x" * 50_000, "de"),
        (10, "Écrivez à jean.dupont@example.com ou appelez le +33 1 23 45 67 89 😀 vite", "fr"),
        (11, "one\x00two three four �", "fr"),
        (12, "<|endoftext|> a <|startoftext|>b", "en"),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHES] + [T.StructField("n_chars", T.LongType())]
    rows = [(*r, *[None if i % 2 else f"c{i}" for i in range(len(CLASHES))], len(r[1] or "")) for r in messy_rows]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").repartition(5).cache()
