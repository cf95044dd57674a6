import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, spans string, bucket long"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, copies and near copies; extra columns with names that operators use."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(rng.choices(words, k=110))
    texts += [texts[0]] * 5 + [texts[1] + " more"] * 2 + [f"{a} {passage} {b}" for a, b in zip("pqrs", "wxyz", strict=True)]
    texts += ["", None, " \t\n", "é ü 漢字 🙂 mixed", "x" * 3000, "one", " ".join(rng.choices(words, k=6000)), "MiXeD Case MiXeD Case", "▁odd  spaces \n\n lines "]
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4] if i % 9 else "hot", None if t is None else len(t), 1, "s", 2) for i, t in enumerate(texts)]
    return out + [out[0], out[45]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """A row of nulls beside an ordinary one."""
    return spark.createDataFrame([(None, None, None, None, None, None, None, None), (7, "some words here", "en", "a", 15, 0, "", 0)], SCHEMA)
