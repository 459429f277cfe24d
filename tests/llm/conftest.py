import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, ids string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    base = "the quick brown fox jumps over the lazy dog and runs to the river in the morning "
    rows = [
        (1, base * 20, "en", "a", 10, 0.5, "x", "y"),
        (2, base * 20, "en", "a", None, None, None, None),
        (2, base * 20, "en", "a", None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 1.0, "", ""),
        (None, base + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', None, "b", 1, 1.0, "", ""),
        (5, "le chat est dans la maison et la souris est partie pour la ville avec les enfants de la rue " * 400, "fr", "c", 1, 1.0, "", ""),
        (6, " \n\t ", "fr", "c", 1, 1.0, "", ""),
        (7, "Released under the MIT License. mit license; GNU General Public License, version 3", "en", "c", 1, 1.0, "", ""),
        (8, "aaaa" * 500, "en", "c", 1, 1.0, "", ""),
        (9, "éß中文 \U0001f600 ▁x", "fr", None, 1, 1.0, "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
