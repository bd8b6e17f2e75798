import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, simhash string, toxicity string, ids string, w int, c int, token string"
LABELS = "doc_id long, quality int, toxic int, text string"
TABLES = {
    "documents": DOCS,
    "labels": LABELS,
    "benchmark": "item_id long, text string, doc_id long",
    "embeddings": "vec_id long, embedding array<float>, label int, v int",
}


def write(spark, folder, **rows):
    """A folder of the given tables, empty where no rows are given."""
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def words(rng, n, stem="abcdefgh"):
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Tables with NULLs, empty and long texts, repeated rows, ties and clashing names."""
    rng = random.Random(4)
    texts = [words(rng, 60) for _ in range(60)]
    texts += [None, "", "   \n ", "!!! 123", "é", "one two", "\n".join(["same line here again today"] * 50), words(rng, 120_000), "x" * 300_000, " ".join(["again"] * 5000), texts[0], texts[0] + " more"]
    docs = [(i, t, ["de", "en", None][i % 3], "s", None, "a", "b", "c", 1, 2, "t") for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (None, texts[5], "en", None, 1, *[None] * 6), (None, None, None, None, None, *[None] * 6)]
    labels = [(i, i % 2, (i // 2) % 2, "clash") for i in range(50)] + [(3, None, None, None), (None, 1, 1, None), (4, 1, 1, None), (999, 0, 0, None)]
    bench = [(1, texts[7], 5), (2, None, None), (3, "", 1), (4, "???", 1), (None, "some text of an item", 1), (5, texts[7], 9), (6, "tiny", 0)]
    vec = [(i, [float(rng.gauss(0, 1)) for _ in range(6)], 1, 1) for i in range(100)]
    vec += [(200 + i, [1.0] * 6, 1, 1) for i in range(50)]
    vec += [(300, None, 1, 1), (320, [0.0] * 6, 1, 1), (340, [None] + [1.0] * 5, 1, 1), (360, [float("nan")] * 6, 1, 1), (380, [float("inf")] * 6, 1, 1), (None, [1.0] * 6, 1, 1), (20, vec[20][1], 1, 1), (400, [1.0] * 5, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), documents=docs, labels=labels, benchmark=bench, embeddings=vec)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The tables without rows."""
    return write(spark, tmp_path_factory.mktemp("empty"))
