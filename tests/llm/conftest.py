import pytest

SCHEMA = "doc_id long, text string, lang string, source string, key string, h long, score string, _id long, _gone string, _mix_key long, n int"
WORDS = [f"w{i}" for i in range(400)]


def line(*numbers):
    return " ".join(WORDS[i] for i in numbers)


LONG = "\n".join(line(*range(k, k + 30)) for k in range(0, 300, 30))
ROWS = [
    (1, LONG, "en", "a"),
    (2, LONG, "en", "a"),
    (3, LONG.replace("w7 ", "z7 "), "en", "b"),
    (4, line(*range(300, 360)) + " " + line(*range(0, 60)), "en", "b"),
    (5, None, "en", None),
    (6, "", None, "c"),
    (7, " \t\n ", "de", "c"),
    (8, "12 34 !!", "de", "a"),
    (9, "un deux", "fr", "é"),
    (9, "un deux", "fr", "é"),
    (9, "autre texte du même identifiant", "fr", "é"),
    (None, "sans identifiant", "fr", None),
    (10, LONG + "\n" + "x " * 30_000, "en", "a"),
    (11, "tiny", "en", "b"),
    (12, "Tiny", None, "b"),
    (13, "line one\n\nline two\r\nReleased under the MIT License.", "en", "b"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(*r, "k", 5, "s", 1, "g", 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
