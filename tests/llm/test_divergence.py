import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from weftline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow(docs, least, top, smooth=5, scale=10**9):
    """The whole audit by loops over sources and terms."""
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        everyone = Counter()
        for x in sources:
            everyone.update({t: counts[lang, x][t] for t in kept})

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + scale * (count[t] + smooth) // (total + smooth * len(kept)) for t in kept}

        share, q = {x: p(counts[lang, x]) for x in sources}, p(everyone)
        for x in sources:
            rows = {"pair": [(y, sum(abs(share[x][t] - share[y][t]) for t in kept)) for y in sources - {x}], "term": [(t, share[x][t] - q[t]) for t in kept if counts[lang, x][t] > 0 and share[x][t] > q[t]]}
            for part, found in rows.items():
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, x, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def documents(n=400, sources=9):
    rng = random.Random(8)
    words = [f"W{chr(97 + i)}{chr(97 + j)}é" if i % 3 else f"w{chr(97 + i)}-{chr(97 + j)}" for i in range(12) for j in range(12)]
    docs = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "x"])
        source = f"s{int(rng.random() ** 2 * sources)}" if lang != "x" else "only"
        docs.append((" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30))), lang, source))
    return [*docs, (None, "en", "silent"), ("", "de", None), ("unheard", "rare", "a"), ("of", "rare", "b"), *docs[:5]]


@pytest.mark.parametrize("shape", [(32, 1024), (2, 5), (1, 1), (3, 64)])
def test_by_definition(spark, shape):
    docs = documents()
    s = divergence.Settings(least_docs=8, top_terms=7, rows=shape[0], columns=shape[1], entries=50)
    got = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(3), s)
    assert sorted(map(tuple, got.collect())) == slow(docs, 8, 7)


def test_distances_of_trees():
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows, others, width = rng.integers(1, 20, 3)
        a, b = (rng.integers(1, 50, (n, width)) * (rng.random((n, width)) < 0.2) for n in (rows, others))
        za, zb = rng.integers(1, 9, rows), rng.integers(1, 9, others)
        full = lambda x, z: np.where(x > 0, x, z[:, None])
        want = np.abs(full(a, za)[:, None] - full(b, zb)[None]).sum(2)
        assert (divergence.distances(a, b, za, zb, False) == want).all()
        assert (divergence.distances(a, a, za, za, True) == np.triu(np.abs(full(a, za)[:, None] - full(a, za)[None]).sum(2), 1)).all()
    assert divergence.distances(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64), np.ones(2, np.int64), np.ones(3, np.int64), False).sum() == 0


def test_terms_in_blocks(monkeypatch):
    text = "Ab c\x00d-É漢 _e9f " * 30
    want = [x.encode() for x in TERM.findall(text.translate(LOWER))]
    monkeypatch.setattr(divergence, "BLOCK", 7)
    assert sum(divergence.terms_of(text), []) == want and list(divergence.terms_of(None)) == []


def test_against_sql(spark, odd):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    got = [tuple(map(str, r)) for r in divergence.op11_divergence(spark, odd).collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in c.sql(divergence.ORACLE).fetchall())


def test_large_counts_stay_exact(spark):
    """Shares of counts far over 2^53 / 10^9."""
    rows = [("en", "a", "t", 9_007_199_254_740_993, 40), ("en", "a", "u", 3, 40), ("en", "a", None, 0, 0)]
    d = spark.createDataFrame(rows, "lang string, source string, term string, n long, docs long").where("term IS NOT NULL")
    from pyspark.sql import functions as F

    total = sum(r[3] for r in rows)
    got = {r["term"]: r["p"] for r in d.select("term", divergence.share(F.col("n"), F.lit(total), F.lit(2), divergence.Settings()).alias("p")).collect()}
    assert got == {t: 1 + 10**9 * (n + 5) // (total + 10) for _, _, t, n, _ in rows if t}
