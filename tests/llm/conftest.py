import pytest

#: Documents with nulls in every column, an empty and a long text, ties and a repeated row, and columns that clash with the operators' own names.
LONG = " ".join(f"w{i % 97} and the word" for i in range(4000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran to the house of the man", "en", "a", 1),
    (2, "the cat sat on the mat and the dog ran to the house of the man", "en", "b", 1),
    (2, "the cat sat on the mat and the dog ran to the house of the man", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (None, "le chat est sur la table et le chien est dans la maison avec nous", "fr", "c", 2),
    (5, LONG, "en", "a", 3),
    (6, "12345 67890 !!", "de", "b", 4),
    (7, "der hund ist in dem haus und die katze ist auf dem tisch mit uns", "de", None, 5),
    (8, " \t\n\x0b lead and trail \r\n", "en", "a", 6),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0, 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, fp string, label int, rid int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
