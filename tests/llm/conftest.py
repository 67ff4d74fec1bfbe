import random

import pytest

# Names that the operators use themselves: the documents may have them too.
CLASHES = ("bundle", "rec", "id", "part", "score", "kept", "key", "none", "uid", "rid", "held_out")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '', ',', '.'])}" for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    passage, own = sentence(rng, 70), [sentence(rng, rng.randrange(20, 160)) for _ in range(30)]
    rows = list(enumerate(own))
    rows += [(100 + i, own[i]) for i in range(5)]
    rows += [(110 + i, own[0].replace(" ", "\n\t ")) for i in range(4)]
    for i in range(8):
        w = own[i + 6].split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((120 + i, " ".join(w)))
    for i in range(10):
        rows.append((140 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 12)}"))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "one  two"), (205, "x" * 3000), (206, "é ü 漢字 😀 " * 60)]
    rows += [(207, sentence(rng, 6000, 10 ** 6)), (208, "und " * 500), (None, own[3]), (None, passage), (20, own[20]), (20, own[20]), (21, "other text")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", None if i == 3 else "src0", None, *["x"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
