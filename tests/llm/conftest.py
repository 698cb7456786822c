import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Small documents with every awkward case: nulls, empty, white space, copies, near copies, long
    texts, shared passages, repeated rows, ties, characters outside ASCII."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(line(r.randint(2, 14)) for _ in range(r.randint(1, 8)))
    base = text() + "\n" + text()
    passage = line(90)
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, base), (5, base), (6, base + " extra"), (7, base.replace(" ", "  ", 1)), (8, base.upper()), (9, "one"), (10, "One"), (11, "a b c d"), (12, passage), (13, text() + "\n" + passage), (14, passage + " " + text()), (15, "x" * 3000), (16, "ab " * 1500), (17, line(3000)), (17, "other text of the same id"), (18, "under the MIT license. Apache License, Version 2.0; CC-BY-NC 4.0"), (19, "mit " * 30 + "under the mit license under the mit license"), (20, "日本語 текст\U00020000 ▁ \\ <| end"), (None, "no id here at all, is it"), (21, "dup row"), (21, "dup row")]
    for i in range(n):
        t = text()
        rows.append((100 + 2 * i, t))
        if i % 3 == 0:
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            rows.append((101 + 2 * i, " ".join(w)))
    return [(d, t, [None, "en", "de"][k % 3], [None, "b", "a", "a", "é"][k % 5], None if t is None else len(t)) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """df with more columns, named as an operator's own."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})
