import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, _t string, _d long, score string, label string, n long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, clashing extra columns."""
    r = random.Random(5)
    words = ["amber", "brick", "cloud", "delta", "ember", "flint", "grove", "haven", "idiot", "jolly", "kayak", "lemon", "mit", "license", "under", "the"]
    rows = []

    def add(i, text, lang="en", source="src0"):
        rows.append((i, text, lang, source, len(text or ""), 7, "x", "y", 3, "z", "l", 9))

    base = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(120))
    for i in range(40):
        add(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + "\nshared line\n" + r.choice(words), r.choice(["en", "fr", None]), r.choice(["src0", "src1", "src2", None]))
    for i in range(40, 60):
        add(i, base)
    for i in range(60, 70):
        x = base.split()
        x[r.randrange(len(x))] = f"new{i}"
        add(i, " ".join(x), source="src1")
    add(70, None)
    add(71, "")
    add(72, " \t\n ")
    add(73, "one")
    add(74, "a b c")
    add(75, "A B c")
    add(76, "long " * 60_000 + "tail")
    add(77, "Licensed under the Apache License, Version 2.0. GNU General Public License\nmit license mit license", None, None)
    add(78, "éçà Ünïcode 文字 　 text\x00x", "de", "source b")
    add(79, "shared line\n\n  SHARED LINE \n\x0bshared line\r\nother")
    add(None, "no id here", "en", "src0")
    add(None, None, None, None)
    add(5, rows[5][1], rows[5][2], rows[5][3])
    add(5, rows[5][1], rows[5][2], rows[5][3])
    add(6, "another text under an old id")
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
