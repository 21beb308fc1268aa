import pytest

#: Rows that every operator must live with.
AWKWARD = [
    (7, None, None, None),
    (None, "a row without an id, yet with a text of some words", "en", "src1"),
    (3, "", "en", None),
    (1, "one", "en", "src0"),
    (2, "  two  spaces\tand\ttabs \n\n new lines \r\n end ", "en", "src0"),
    (9, "Ünïcödé ﬁ 漢字かな 😀 <|endoftext|> <s>x</s> ▁mark▁ a b \x1c \x00 don't 12,5 (x).", "de", "src0"),
    (4, "same text twice, of more than four words", "en", "src0"),
    (5, "same text twice, of more than four words", "en", "src0"),
    (5, "same text twice, of more than four words", "en", "src0"),
    (6, "long words " * 20000, "fr", "src0"),
    (-8, "?!?! 123", "en", "src2"),
]
#: Names that the operators use for columns of their own.
CLASHING = (
    "score", "_text", "text_tie", "kept_id", "kept_tie", "times", "digest", "component", "component_id", "kept", "cls", "value", "vertex", "n", "n_shingles",
    "_domain", "_lang", "_source", "_tokens", "_epoch", "_last", "domain", "key", "digits", "whole", "rest", "cut", "end", "before", "tokens", "epoch", "id", "c0",
    "place", "within", "part", "copy", "to", "ahead", "group", "bundle", "size", "text_crc32", "chunk", "slot", "own", "pooled", "block", "path", "sub", "codes",
    "_at", "unit", "quality", "item_id", "distance", "a name with blanks",
)
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows, with an extra column whose name clashes with names that operators use."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("tie", F.lit("x")).withColumn("n_tokens", F.lit("y")).withColumn("shard", F.lit("z"))
    return docs.withColumns({name: F.lit(f"{name} of the user") for name in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
