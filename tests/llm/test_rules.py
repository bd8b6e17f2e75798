import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words from their definitions."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def test_statistics_by_definition():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "é ü ß  x\x1cy", "a\x0bb\x0cc\r\nd", "#|<>&%$* a\n\n #|<>&%$* a\n #|<>&%$* a", "\n\n"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "é", " ", " ", "\n", "|", "漢", "\t", " "]) for _ in range(rng.randint(0, 60))))
    for t in texts:
        assert rules.statistics(t)[:5] == slow(t), repr(t)


def test_blocks_join_to_the_same_words():
    data = ("one two\nthree " * 50).encode()
    assert sum(rules.word_blocks(data, 16), []) == data.split()


def test_paths_are_depths():
    """A tree over few points gives each the depth of its leaf and the expected rest."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    tree = rules.grow(x, rng)
    got = rules.path_lengths(tree, x)
    for row, length in zip(x, got, strict=True):
        at, depth = 0, 0
        while tree.column[at] >= 0:
            at = tree.left[at] if row[tree.column[at]] < tree.cut[at] else tree.right[at]
            depth += 1
        inside = sum(1 for y in x if _leaf(tree, y) == at)
        assert length == pytest.approx(depth + float(rules.expected_path(inside)))


def _leaf(tree, row):
    at = 0
    while tree.column[at] >= 0:
        at = tree.left[at] if row[tree.column[at]] < tree.cut[at] else tree.right[at]
    return at


def test_far_points_have_higher_scores():
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=500), "b": rng.normal(size=500)}
    x["a"][:3] = 30
    m = np.stack([x["a"], x["b"]], 1)
    forest = rules.Forest(["a", "b"], [rules.grow(m[rng.choice(500, 64, replace=False)], rng) for _ in range(100)], 64)
    scores = forest.scores(x)
    assert scores[:3].min() > scores[3:].max() and 0 < scores.min() and scores.max() < 1


def _documents(spark, n=600):
    rng = random.Random(5)

    def clean():
        return ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(6, 14))) for _ in range(12))

    rows = []
    for i in range(n):
        text, kind = clean(), "clean"
        if i % 10 == 0:
            text, kind = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split()), "symbols"
        elif i % 10 == 1:
            text, kind = "\n".join(w + " | " + v for w, v in zip(text.split(), text.split()[1:], strict=False)), "menu"
        elif i % 10 == 2:
            text, kind = "short text", "short"
        rows.append((i, text, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_held_out_kinds(spark):
    """Junk whose labels weren't seen goes, clean documents stay."""
    docs = _documents(spark)
    labels = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("kind") == "clean").cast("int").alias("quality"))
    found = rules.apply_rules(docs, labels).join(docs.select("doc_id", "kind"), "doc_id").where("doc_id % 3 = 0").toPandas()
    clean, junk = found[found.kind == "clean"], found[found.kind != "clean"]
    assert clean.kept.mean() >= 0.98 and junk.kept.mean() <= 0.02
    assert found[found.kind == "short"].base_failed.all() and not clean.base_failed.any()


def test_without_labels_only_basic_rules(spark):
    docs = _documents(spark, 60)
    found = rules.apply_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).toPandas()
    assert (found.kept == ~found.base_failed).all() and found.kept.sum() == 54


def test_basic_rules(spark, odd):
    got = {r["doc_id"]: r for r in rules.op12_rules(spark, odd).where("doc_id IS NOT NULL").collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] and got[i]["n_words"] == 0 for i in (60, 61, 62))
    assert got[66]["base_failed"] and got[66]["n_repeat_words"] == got[66]["n_words"] == 250 and got[66]["n_dup_lines"] == 49
    assert got[67]["n_words"] == 120_000 and not got[67]["base_failed"]


def test_equal_texts_have_equal_verdicts(spark):
    docs = _documents(spark, 100)
    labels = docs.select("doc_id", (F.col("kind") == "clean").cast("int").alias("quality"))
    found = rules.apply_rules(docs.union(docs), labels)
    assert found.count() == 200 and found.groupBy("doc_id").agg(F.countDistinct("kept").alias("k")).where("k > 1").isEmpty()


def _counted(spark, n):
    """Numbers of ``n`` documents, one in 20 with many symbols, and labels of quality for most."""
    rng = np.random.default_rng(8)
    words = rng.integers(50, 400, n)
    junk = np.arange(n) % 20 == 0
    x = np.stack([words, 5 * words, np.where(junk, 5 * words, words * (0.3 + rng.exponential(0.2, n))).astype(int), rng.integers(0, 3, n), rng.integers(0, 9, n), rng.integers(3, 9, n), rng.integers(0, 5, n)], 1)
    counted = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], ["doc_id", *rules.COUNTS])
    labels = counted.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 20 == 0, 0).otherwise(1).alias("quality"))
    return x, counted, labels, (np.arange(n) % 7 != 0) & ~junk


def test_thresholds_come_from_all_labelled_rows(spark):
    x, counted, labels, good = _counted(spark, 12_000)
    s = rules.Settings(trees=32)
    model = rules.fit(counted, labels, s)
    scores = np.sort(model.forests["symbols"].scores(rules.shares(x[good])))[::-1]
    assert good.sum() > 9000 and model.thresholds["symbols"] == scores[int(s.good_loss * len(scores))]


def test_forests_are_grown_over_all_documents(spark):
    """Trees grown by passes are those grown over the whole matrix, whatever the partitions; the one far document counts."""
    x, counted, _, _ = _counted(spark, 10_000)
    x[1234, 2] = 10**9
    counted = counted.withColumn("n_symbols", F.when(F.col("doc_id") == 1234, 10**9).otherwise(F.col("n_symbols")))
    s = rules.Settings(trees=3)
    got = [rules.grow_forests(counted.repartition(k), s) for k in (1, 6)]
    for i, (family, columns) in enumerate(rules.FAMILIES.items()):
        matrix = np.stack([rules.shares(x)[c] for c in columns], 1)
        for k in range(s.trees):
            growing = rules.Growing(np.random.default_rng([s.seed, i * s.trees + k]), s.points)
            while growing.open:
                growing.advance(rules.ranges(growing.tree, matrix, np.ones(len(matrix))))
            want = growing.tree
            for forests in got:
                tree = forests[family].trees[k]
                assert all(np.array_equal(getattr(tree, a), getattr(want, a)) for a in ("column", "cut", "left", "right", "path"))
    far = got[0]["symbols"].scores(rules.shares(x))
    assert far[1234] > np.delete(far, 1234).max()
