import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, __id string, kept string"


def sentence(rng, n):
    syllables = ["ta", "lo", "mi", "ren", "su", "kor", "el", "and", "the", "of"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Odd and plain texts: nulls, empties, copies, near copies, ties, shared lines, a very long one."""
    rng = random.Random(5)
    shared = sentence(rng, 14)
    body = sentence(rng, 80)
    out = [None, "", " \t\n ", "one", "Two words", "x" * 5000, "<|endoftext|> a<|startoftext|>b </s>[INST]", "é ö ß ሰላም 漢字 \U0001f600 ①"]
    for i in range(60):
        lines = [sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), shared if i % 8 else "  " + shared.upper() + "\t")
        out.append("\n".join(lines))
    out += [body] * 5 + [body.replace(".", " end."), body + "\n" + shared, "\n".join([shared, shared, body])]
    out += [out[20], "\n".join(sentence(rng, 40) for _ in range(1500))]
    return out


def frame(spark, texts, start=0):
    rows = [(start + i, t, ("en", "fr", None)[i % 3], "src0", len(t or ""), 0.5, "a", "b") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12]]  # repeated rows
    rows += [(None, "a row without an id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
