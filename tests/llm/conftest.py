import pytest

SF = "/root/testdata/sf0.001"

PROSE = "The river ran past the old mill, and nobody in the village knew why it was there. "


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """NULLs, empty and blank texts, a very long one, repeated rows, and columns of clashing names."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(60_000))
    rows = [
        (1, PROSE * 3, "en", "a", 5, 7),
        (2, PROSE * 3 + "\n", "en", "a", 5, 7),
        (2, PROSE * 3 + "\n", "en", "a", 5, 7),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 0, 7),
        (5, " \n\t\n", "en", "a", 0, 7),
        (None, PROSE * 3 + " and one more", "en", "a", 1, 7),
        (None, None, "en", None, 1, 7),
        (6, long, "fr", "a", 1, 7),
        (7, "été 北京 𝒳 " * 30, "fr", "a", 1, 7),
        (8, "x", "de", "a", 1, 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")
    clash = {c: "fp" for c in ("id", "bucket", "word", "n", "count", "root", "rank", "label", "key", "ranges", "items", "removed", "batch")}
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in clash.items())).repartition(3)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
