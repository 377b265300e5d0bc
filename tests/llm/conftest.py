import pytest
from pyspark.sql import functions as F

#: Texts that every operator has to take: null, empty, blanks, one word, marks and emoji, repeats, long runs.
ODD = [None, "", " \n\t ", "one", "two words", "é ü 𝒳 नमस्ते", "a b c d e f g h i j", "a b c d e f g h i j", "x" * 5000, "word " * 3000, "line one\nline two\nline one"]


@pytest.fixture()
def folder(spark, tmp_path):
    """Writes tables (with an extra column that clashes with names used inside) and gives their folder."""

    def write(documents=None, **others):
        if documents is not None:
            df = spark.createDataFrame(documents, "doc_id long, text string")
            df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "words": F.lit("clash"), "fp": F.lit(7), "id": F.lit("x"), "key": F.lit(1)})
            df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
        for name, (rows, schema) in others.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture()
def odd():
    """Odd texts, a repeated row, and a null id."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    return rows + [(6, ODD[6]), (None, "no id here"), (None, None)]
