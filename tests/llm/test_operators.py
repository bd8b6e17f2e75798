"""Operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer, models

from weftline.llm import ann, bpe, decontaminate, language, licenses, lm, quality, simhash, tokencount, toxicity

from .conftest import words, write

FILLER = ["the", "of", "and", "rain", "stone", "river", "cloud", "walk", "green", "house"]


def prose(rng, n):
    return " ".join(rng.choice(FILLER) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n)) + "."


# --- toxicity


def toxic_rows(rng, n, roots):
    rows = []
    for i in range(n):
        text = prose(rng, 80).split()
        if i % 2:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(roots) + rng.choice(["", "x", "zz", "oq", "ik"]))
        rows.append((" ".join(text), i % 2))
    return rows


def test_toxicity_reaches_unseen_spellings():
    rng = random.Random(1)
    data = toxic_rows(rng, 400, ["grumbolf", "snarvick"])
    model = toxicity.train([t for t, _ in data], [y for _, y in data])
    unseen = toxic_rows(rng, 200, ["grumbolv", "snarvicc", "grumbolffy"])
    scores = toxicity.Scorer(model)([t for t, _ in unseen])
    right = [(s >= 0.7) == bool(y) for s, (_, y) in zip(scores, unseen, strict=True)]
    assert np.mean(right) > 0.95
    assert abs(toxicity.Scorer(model)([None, ""])[0] - toxicity.Scorer(model)(["..."])[0]) < 1e-12


def test_a_short_insult_in_a_long_text_is_not_averaged_away():
    rng = random.Random(3)
    data = toxic_rows(rng, 400, ["grumbolf", "snarvick"])
    scorer = toxicity.Scorer(toxicity.train([t for t, _ in data], [y for _, y in data]))
    clean = [prose(rng, 4000) for _ in range(20)]
    assert (scorer(clean) < 0.7).all()
    assert (scorer([f"{t} grumbolf {prose(rng, 1000)} snarvickzz {t}" for t in clean]) >= 0.7).all()


def test_scores_against_brute_force():
    rng = np.random.default_rng(17)
    model = toxicity.Model(rng.normal(size=1 << 10), 3 * rng.normal(size=1 << 10), -0.3, 6)
    text_rng = random.Random(18)
    texts = [words(text_rng, n) for n in (1, 2, 3, 4, 7, 50)] + ["Ünï cödé!", None, "...", "same same same other"]
    for text, got in zip(texts, toxicity.Scorer(model)(texts), strict=True):
        above = below = 0.0
        parts = re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (text or "").lower()).split()
        for w in parts:
            ids, _ = toxicity.subwords([w.encode()], 1 << 10)
            weight = math.exp(max(1, math.log(1 + len(parts)) / math.log(7)) * model.bucket_weight[ids].mean())
            above, below = above + weight * model.bucket_score[ids].mean(), below + weight
        average = above / below if below else 0.0
        assert abs(got - 1 / (1 + math.exp(-(average - 0.3)))) < 1e-12


def test_subwords_of_a_word_do_not_depend_on_the_others():
    alone = set(toxicity.subwords([b"stone"], 1 << 16)[0].tolist())
    ids, owner = toxicity.subwords([b"a", b"stone", "é".encode()], 1 << 16)
    assert set(ids[owner == 1].tolist()) == alone


# --- quality


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    p = quality.Packed(sizes)
    score, pair = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, pairs, total = quality.marginals(score[p.line], pair, p)
    want, want_pairs, want_total, at = np.empty(8), np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        z, marg, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += w
            marg += w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        want[at : at + n], want_total, at = marg / z, want_total + math.log(z), at + n
        want_pairs += joint / z
    got = np.empty(8)
    got[p.line] = good
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and abs(total - want_total) < 1e-9


def test_quality_of_held_out_documents():
    rng = random.Random(3)

    def doc(bad):
        lines = [prose(rng, rng.randint(8, 20)) for _ in range(rng.randint(1, 8))]
        return "\n".join(x.upper().replace(" ", "!! ") if bad == 1 else re.sub(" ", "%%% ", x) if bad == 2 else x for x in lines)

    data = [(doc(i % 3), int(i % 3 == 0)) for i in range(600)]
    model = quality.train([t for t, _ in data[:400]], [y for _, y in data[:400]])
    got = quality.quality([t for t, _ in data[400:]], model)
    assert np.mean((got >= 0.3) == np.array([y for _, y in data[400:]])) > 0.97
    assert quality.quality([None, "", " \n"], model).tolist() == [model.prior] * 3


def test_a_bad_block_inside_a_good_document_is_bad():
    rng = random.Random(31)
    bad_line = lambda: "!! ".join(w.upper() for w in prose(rng, 10).split())
    good_line = lambda: prose(rng, rng.randint(8, 20))
    data = []
    for i in range(400):  # good documents have a bad line at times, bad ones a good line
        n = rng.randint(4, 10)
        data.append(("\n".join(bad_line() if (i % 2) != (rng.random() < 0.08) else good_line() for _ in range(n)), 1 - i % 2))
    model = quality.train([t for t, _ in data], [y for _, y in data])
    hit = []
    for _ in range(60):
        at = rng.randrange(4, 10)
        lines = [bad_line() if at <= k < at + 4 else good_line() for k in range(16)]
        features, _ = quality.line_features("\n".join(lines))
        p = quality.Packed(np.array([16]))
        good, _, _ = quality.marginals(model.weight[features[p.line]].sum(1), model.pair, p)
        hit.append([(good[k] < 0.5) == (at <= k < at + 4) for k in np.argsort(p.line)])
    assert np.mean(hit) > 0.9


# --- language models


def test_base_score_and_normalisation(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, prose(rng, 40) if i % 9 else None, *[None] * 9) for i in range(120)]
    got = {r["doc_id"]: r for r in lm.op3_lm(spark, write(spark, tmp_path, documents=docs)).collect()}
    split = {d[0]: [w for w in re.split(r"[\x20\x09-\x0D]+", (d[1] or "").lower()) if w] + [" "] for d in docs}
    train = {i for i in split if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in split[i])
    total, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert r["held_out"] == (i not in train) and r["n_tokens"] == len(split[i]) and r["train_tokens"] == total
        assert r["n_known"] == sum(w in c for w in split[i])
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (total + v + 1)) for w in split[i])) < 1e-8


def test_model_learns_which_words_follow_each_other(spark, tmp_path):
    rng = random.Random(51)
    follow = {w: rng.sample(FILLER, 2) for w in FILLER}
    docs = []
    for i in range(200):
        text = [rng.choice(FILLER)]
        while len(text) < 40:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.9 else f"w{rng.randrange(500)}" if rng.random() < 0.3 else rng.choice(FILLER))
            if text[-1] not in follow:
                text.append(rng.choice(FILLER))
        docs.append((i, " ".join(text), *[None] * 9))
    got = [r for r in lm.op3_lm(spark, write(spark, tmp_path, documents=docs)).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] - r["base_score"] for r in got) / n > 0.2


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(60)], "doc_id long, text string")
    s = lm.Settings(classes=6, leaves=6, shared_leaves=3, least_buckets=256, per_bucket=100, head=20)
    vocabulary = lm.count_words(docs)
    model = lm.fit(docs, vocabulary, s)
    known = {r["token"]: r["c"] for r in vocabulary.collect()}
    scorer = lm.Scorer(model, s)

    def log10_p(word):  # of a word after "the": what it adds to the text, without the end
        w = lm.words_of([f"the {word}"], lm.Powers(), s)
        found, leaf, _ = lm.looked_up(w, model.head)
        rows, target, _, _ = lm.events(w, leaf, model.buckets, s.classes)
        log_p = lm.picked_log_probs(model.table, rows, target, 8) / math.log(10)
        return log_p[1] + log_p[4] - model.offset[w.cls[1], leaf[1]], int(w.cls[1])

    total = sum(10 ** log10_p(w)[0] * (c + 1) for w, c in known.items() if w != lm.END)
    unknown = {k: p for p, k in (log10_p(f"xq{i}") for i in range(400))}
    assert set(unknown) == set(range(1, s.classes))
    total += sum(10**p for p in unknown.values())
    rows, target, _, _ = lm.events(lm.words_of(["the"], lm.Powers(), s), np.zeros(1, np.int64), model.buckets, s.classes)
    total += math.exp(lm.picked_log_probs(model.table, rows, target, 8)[1])
    assert abs(total - 1) < 1e-4
    # a text's score is the sum over its tokens, whichever words the head has
    text = "the river walks stones"
    n, seen, counts, value, rest = scorer([text, None, ""])
    assert n.tolist() == [5, 1, 1] and value[1] == value[2] and all(w in text for w, _ in rest[0])


def test_only_words_are_joined_with_the_vocabulary(spark):
    """The end's count is known in the tasks even if no head is broadcast; unknown words add nothing."""
    rng = random.Random(63)
    docs = spark.createDataFrame([(i, prose(rng, 20)) for i in range(40)] + [(40, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the river zzq zzq"), (2, None), (3, "zzq")], "doc_id long, text string")
    vocabulary = lm.count_words(docs)
    c = {r["token"]: r["c"] for r in vocabulary.collect()}
    total, v = sum(c.values()), len(c)
    s = lm.Settings(least_buckets=256, head=0)
    model = lm.fit(docs, vocabulary, s)
    assert not len(model.head.hash) and model.head.end == 41
    assert [[w for w, _ in x] for x in lm.Scorer(model, s)([None, "zzq"])[4]] == [[], ["zzq"]]
    for r in lm.score(asked, vocabulary, model, s).collect():
        split = (r["text"] or "").split() + [lm.END]
        assert r["n_known"] == sum(w in c for w in split)
        assert abs(r["base_score"] - sum(math.log10((c.get(w, 0) + 1) / (total + v + 1)) for w in split)) < 1e-8


def test_word_hashes_do_not_depend_on_place_and_blocks():
    rng = random.Random(61)
    s, texts = lm.Settings(), [words(rng, 200), None, "", "A\tb\x0b\u00e9 ", "x" * 5000, words(rng, 50)]
    whole, cut = lm.words_of(texts, lm.Powers(), s), lm.words_of(texts, lm.Powers(), s, block=64)
    assert (whole.hash == cut.hash).all() and whole.sizes.tolist() == [200, 0, 0, 3, 1, 50]
    want = [w for t in texts for w in lm.tokens(t)]
    assert [whole.data[a:b] for a, b in zip(whole.start, whole.end)] == want
    by = {}
    for w, h in zip(want, whole.hash.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_class_of_a_word_in_tasks_and_in_columns(spark):
    s, names = lm.Settings(), ["a", "ab", "stone", "naïve", "日本", "x9"]
    rows = spark.createDataFrame([(w,) for w in names], "w string").select(lm.class_column("w", s)).collect()
    assert [r[0] for r in rows] == lm.hash_of(names, lm.Powers(), s)[1].tolist()


def test_changes_are_averaged_in_a_tree(spark):
    rng = np.random.default_rng(62)
    s = lm.Settings(slices=3, fan_in=4)
    change, met = rng.normal(size=(20, 10, 2)).astype(np.float16), rng.integers(0, 5, (20, 10)).astype(np.float32)
    rows = [(k, t, change[t, 4 * k : 4 * k + 4].tobytes(), met[t, 4 * k : 4 * k + 4].tobytes()) for t in range(20) for k in range(3)]
    got = lm.averaged(spark.createDataFrame(rows, "slice int, task int, change binary, met binary"), np.zeros((10, 2), np.float32), 20, s)
    want = (change.astype(np.float64) * met[..., None]).sum(0) / np.maximum(met.sum(0), 1)[:, None]
    assert np.abs(got - want).max() < 5e-3


def test_head_words_by_count(spark):
    v = spark.createDataFrame([(f"w{i}", i) for i in range(1, 101)], "token string, c long")
    got = lm.head_words(v, 20)
    assert 0 < len(got) <= 20 and min(got.values()) > 100 - 1 - 20
    assert lm.head_words(v, 1000) == {f"w{i}": i for i in range(1, 101)}


# --- decontamination


def plain_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_of_best_stretch():
    rng = random.Random(7)
    for _ in range(40):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in "ab")
        got = decontaminate.edit_distance_within(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8))
        assert got == plain_distance(a, b)


def test_edited_items_are_found_and_others_are_not():
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(15, 50), "abcdefghijklmnop")) for i in range(40)]
    index = decontaminate.Index(items, decontaminate.Settings())
    docs, want = [], []
    for i in range(160):
        text = list(rng.choice(items)[1] if i % 2 else words(rng, 30, "abcdefghijklmnop"))
        item = next((k for k, t in items if t == "".join(text)), None)
        for _ in range(int(0.08 * len(text)) if i % 4 == 1 else 0):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [rng.choice("abcdefghijklmnop ")]
        docs.append(words(rng, 40, "abcdefghijklmnop") + " " + "".join(text).upper() + ". " + words(rng, 40, "abcdefghijklmnop"))
        want.append(item)
    got = index.search(docs)
    exact = [i for i in range(160) if i % 4 == 3]
    assert all((want[i], 0) in got[i] for i in exact)
    near = [i for i in range(160) if i % 4 == 1]
    assert np.mean([want[i] in [k for k, _ in got[i]] for i in near]) >= 0.95
    assert not any(got[i] for i in range(0, 160, 2))


def test_copies_with_spaces_removed_or_inserted_and_unspaced_texts_are_found():
    rng = random.Random(81)
    items = [(i, words(rng, 40, "abcdefghijklmnop")) for i in range(40)]
    items += [(100 + i, "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60))) for i in range(40)]
    index = decontaminate.Index(items, decontaminate.Settings())
    docs, full = [], []
    for k, (_, text) in enumerate(items):
        for share in (0.7, 1):
            x, edits = list(text), int(share * index.items[k].edits)
            for n in range(edits // 6 if k >= 40 else edits):  # a letter of three bytes removed and one inserted
                gaps = [i for i, c in enumerate(x) if c == " "]
                if k >= 40:
                    x.pop(rng.randrange(len(x)))
                    x.insert(rng.randrange(len(x)), chr(0x5E00 + n))
                elif k % 3 == 0 and gaps:
                    x.pop(rng.choice(gaps))
                elif k % 3 == 1 and gaps:
                    x[rng.choice(gaps)] = "q"
                else:
                    x.insert(rng.choice([i for i in range(1, len(x)) if x[i] != " " and x[i - 1] != " "]), " ")
            (docs if share < 1 else full).append(words(rng, 40, "abcdefghijklmnop") + " " + "".join(x) + " " + words(rng, 40, "abcdefghijklmnop"))
    got = index.search(docs)
    for kind in (range(0, 40, 3), range(1, 40, 3), range(2, 40, 3), range(40, 80)):
        assert np.mean([items[k][0] in [i for i, _ in got[k]] for k in kind]) >= 0.9
    # with all edits allowed, no copy is passed over before it is embedded
    normal = [b" ".join(decontaminate.plain_words(x)) for x in full]
    windows = index.windows(*index.found(normal))
    assert {k for _, k, _ in windows.tolist()} == set(range(80))


@pytest.mark.parametrize("kind", ["substitute", "delete", "insert", "join words", "split words", "long words"])
def test_recall_at_exactly_the_allowed_edits(kind):
    rng = random.Random(82)
    letters = "abcdefghijklmnop"
    n = 3 if kind == "long words" else 40
    items = [(i, " ".join("".join(rng.choice(letters) for _ in range(40 if n == 3 else rng.randint(2, 6))) for _ in range(n))) for i in range(40)]
    index = decontaminate.Index(items, decontaminate.Settings())
    docs = []
    for item in index.items:
        x, done = list(item.text.decode()), set()
        for _ in range(item.edits):
            gaps = [i for i in range(1, len(x) - 1) if x[i] == " "]
            inner = [i for i in range(1, len(x) - 1) if " " not in x[i - 1 : i + 2]]
            if kind == "join words" and gaps:
                x.pop(rng.choice(gaps))
            elif kind == "split words" or kind == "join words":
                x.insert(rng.choice(inner), " ")
            elif kind == "delete":
                x.pop(rng.choice(inner))
            elif kind == "insert":
                x.insert(rng.choice(inner), rng.choice(letters))
            else:
                x[rng.choice(inner)] = rng.choice(letters)
        docs.append(words(rng, 40, letters) + " " + "".join(x) + " " + words(rng, 40, letters))
    near = [decontaminate.edit_distance_within(np.frombuffer(a.text, np.uint8), np.frombuffer(d.encode(), np.uint8)) <= a.edits for a, d in zip(index.items, docs)]
    assert sum(near) >= 30
    got = index.search(docs)
    assert np.mean([k in [i for i, _ in got[k]] for k in range(40) if near[k]]) >= 0.9


def test_pieces_are_enough_for_every_size():
    for size in range(1, 1200):
        q, need = decontaminate._piece(size, size // 10, 6)
        assert need >= 1 and size // q - size // 10 >= need


# --- licenses


def test_licenses_in_docs(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rng = random.Random(9)
    docs = spark.createDataFrame([(1, f"{words(rng, 70)}\n{notice}\n{words(rng, 70)}"), (2, "Released under the MIT License."), (3, words(rng, 80)), (4, None), (5, "Released under the MIT"), (6, notice.replace("version", "edition"))], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): round(r["containment"], 3) for r in licenses.scan(docs).collect()}
    assert got[1, "GPL-3.0"] == 1.0 and got[2, "MIT"] == 1.0
    assert not {d for d, _ in got} & {3, 4, 5}
    assert licenses.op5_licenses.__doc__


def test_every_stretch_of_a_template_lies_in_a_window():
    for most, length, step in licenses.CLASSES:
        assert step <= length - most + 1
    for (most, _, _), (_, length, _) in zip(licenses.CLASSES, licenses.CLASSES[1:]):
        assert (most + 1) / length >= 3 / 8


def test_whole_license_texts_are_templates(spark):
    rng = random.Random(91)
    long = {f"L{n}": words(rng, n, "abcdefghijklmnop") for n in (100, 101, 260, 1500)}
    templates = spark.createDataFrame(list(long.items()), "license string, notice string")
    docs = [(n, f"{words(rng, 300)} {text} {words(rng, 200)}") for n, text in enumerate(long.values())]
    docs.append((10, " ".join(long["L1500"].split()[:1350])))
    docs.append((11, " ".join(long["L1500"].split()[:1000])))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert set(got) == {(0, "L100"), (1, "L101"), (2, "L260"), (3, "L1500"), (10, "L1500")}
    assert all(got[n, x] == 1.0 for n, x in enumerate(long)) and abs(got[10, "L1500"] - 1346 / 1496) < 1e-9
    for most, length, step in licenses.LONG_CLASSES:
        assert step <= length - most + 1


# --- nearest neighbours


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:760] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i in range(0, 1500, 20)]
    got = ann.neighbours(v, v.where("vec_id % 20 = 0"), ann.Settings(growth=1, least_rows=400, part=30)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in asked:
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert len(by[q]) == 20 and len({i for i, _ in by[q]}) == 20 and all(abs(s[i] - z) < 1e-9 for i, z in by[q])
        hits += len({i for i, _ in by[q]} & set(order))
    assert hits / (20 * len(asked)) >= 0.9


def brute_neighbours(rows, k=20):
    length = Counter(len(v) for _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)).most_common(1)[0][0]
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            score = sorted(((-float(good[q] @ good[i]), i) for i in good if i != q))
            out[q] = [(i, -x) for x, i in score[:k]]
    return out


def test_odd_vectors_against_brute_force(spark, odd):
    table = spark.read.parquet(f"{odd}/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {}
    for r in ann.op6_ann(spark, odd).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and not {300, 320, 340, 360, 380, 400} & set(got)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([x for _, x in got[q]], [x for _, x in want[q]])


def test_shards_grow_with_the_root_of_the_rows():
    s = ann.Settings()
    assert [ann.shard_rows(n, s) for n in (0, 10_000, 1_000_000, 10**12)] == [1024, 6400, 64_000, 1 << 19]


def test_wide_vectors_have_shards_of_bounded_bytes(spark):
    """768 components: no column of a shard comes near what a value can hold, and small shards find the same."""
    s = ann.Settings()
    for length in (64, 768, 4096):
        assert ann.shard_rows(10**12, s, length) * length * 8 <= s.most_bytes
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 768)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    small = ann.Settings(most_bytes=40 * 768 * 8)
    index, shards = ann.build_index(ann.distinct_points(ann.usable(v)[0], small), small)
    assert shards == 8 and max(len(r["vectors"]) for r in index.collect()) < 2 * small.most_bytes
    want = brute_neighbours([(i, r.tolist()) for i, r in enumerate(x)])
    got = {}
    for r in ann.neighbours(v, v.where("vec_id % 20 = 0"), small).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_fewer_candidates_than_neighbours(spark):
    v = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(v, v.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 0.0)]


def test_long_items_with_many_copies():
    """A 12 kB item with sixty near copies in one document: windows of a copy are verified together."""
    import time

    rng = random.Random(60)
    item = words(rng, 2600)
    copies = []
    for k in range(60):
        some = list(item)
        for at in rng.sample(range(len(some)), 300 + 10 * k):
            some[at] = rng.choice("xyzw")
        copies.append("".join(some))
    other = words(rng, 20_000)
    index = decontaminate.Index([(1, item), (2, words(rng, 2000))], decontaminate.Settings())
    began = time.process_time()
    found = index.search(["\n".join(copies), other, copies[-1], None])
    assert time.process_time() - began < 150
    want = decontaminate.edit_distance_within(index.items[0].text, " ".join(copies[0].split()).encode())
    assert [[i for i, _ in x] for x in found] == [[1], [], [1], []] and found[0][0][1] <= want


def test_bit_columns_against_tables():
    """Distances by bits of whole columns are those of the table of all prefixes, for sizes around a word's."""
    rng = random.Random(61)
    for size in (1, 2, 7, 63, 64, 65, 200):
        for _ in range(8):
            item = bytes(rng.choice(b"abc ") for _ in range(size))
            stretch = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 150))) + item[: rng.randint(0, size)]
            row = [0] * (len(stretch) + 1)
            for i, c in enumerate(item, 1):
                new = [i]
                for j, x in enumerate(stretch, 1):
                    new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
                row = new
            assert decontaminate.edit_distance_within(item, stretch) == min(row)


def test_merged_windows():
    assert list(decontaminate.merged([1, 3, 4, 20, 21, 50], 5)) == [(1, 4), (20, 21), (50, 50)]


def test_templates_in_parts(spark):
    """Two thousand templates, looked for in parts: the same as one by one."""
    rng = random.Random(14)
    notices = [("L%d" % (i % 7), words(rng, rng.randint(3, 12))) for i in range(2000)]
    docs = [(i, words(rng, 20) + " " + notices[i * 13 % 2000][1] + " " + words(rng, 20)) for i in range(60)] + [(60, None), (None, notices[0][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(notices, "license string, notice string")
    table = licenses.template_table(t, licenses.Settings())
    parts = licenses.template_parts(table, licenses.Settings(part_shingles=4000))
    assert len(parts) > 1 and sum(map(len, parts)) == table.count() and all(sum(len(r["hashes"]) for r in p) <= 4000 for p in parts)
    got = [sorted(map(str, licenses.scan(d, t, licenses.Settings(part_shingles=n)).collect())) for n in (4000, 10**6)]
    assert got[0] == got[1] and got[0]
    held = {r["doc_id"] for r in licenses.scan(d, t).collect()}
    assert held == {i for i, x in docs if x and len(notices[i * 13 % 2000 if i is not None else 0][1].split()) >= 5}


def test_licenses_of_odd_tables(spark, odd):
    assert licenses.op5_licenses(spark, odd).count() == 0


# --- language


def test_language_of_held_out_and_mixed_texts(spark):
    rng = random.Random(11)
    stems = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    docs = spark.createDataFrame([(i, words(rng, 60, stems[k]), k) for i, k in enumerate(list(stems) * 40)], "doc_id long, text string, lang string")
    infer = language.Inference(language.fit(docs), language.Settings())
    names, shares = infer([words(rng, 30, stems["bb"]), words(rng, 70, stems["aa"]) + " " + words(rng, 30, stems["cc"]), "12 !!", None])
    assert names == ["bb", "aa", "und", "und"]
    assert shares[0] == 1.0 and 0.6 < shares[1] < 0.8 and shares[2:] == [0.0, 0.0]


def test_trigram_counts_against_brute_force(spark):
    rng = random.Random(111)
    rows = [(i, words(rng, 30, "abcé"), ["a", "b", None][i % 3]) for i in range(60)]
    s = language.Settings(buckets=64)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), s)
    want = {k: np.full(64, s.smooth) for k in "ab"}
    for _, text, lang in rows:
        data = (" " + text + " ").encode()
        for i in range(len(data) - 2 if lang else 0):
            want[lang][language.trigrams(np.frombuffer(data[i : i + 3], np.uint8), 64)[0]] += 1
    assert model.langs == ["a", "b"]
    assert np.allclose(np.exp(model.log_prob), [x / x.sum() for x in want.values()], atol=1e-6)
    few = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Settings(buckets=1024, max_cells=600))
    assert few.langs == ["a", "b"] and few.log_prob.shape[1] == 256


def test_many_languages_share_fewer_buckets(spark):
    """Beyond ``max_cells`` buckets are halved, for predictions as for fitting."""
    rng = random.Random(12)
    stems = {f"l{k:02d}": "".join(chr(97 + (k + 5 * i) % 26) for i in range(4)) + chr(0x100 + k) for k in range(40)}
    docs = spark.createDataFrame([(i, words(rng, 80, stems[k]), k) for i, k in enumerate(list(stems) * 6)], "doc_id long, text string, lang string")
    s = language.Settings(max_cells=40 * 2048)
    model = language.fit(docs.where("doc_id < 200"), s)
    assert model.log_prob.shape == (40, 2048)
    found = language.predict(docs.where("doc_id >= 200"), model, s).toPandas()
    assert (found.lang_pred == found.lang).mean() >= 0.95


def test_predictions_against_brute_force_mixtures():
    rng = np.random.default_rng(112)
    infer = language.Inference(language.Model(["a", "b", "c"], np.zeros((3, 4), np.float32)), language.Settings(rounds=200))
    for _ in range(60):
        like = rng.normal(size=(int(rng.integers(2, 40)), 3)) * rng.uniform(0.5, 4)
        name, share = infer.one(like)
        # greedy penalised likelihood, with mixtures fitted on a grid
        best, chosen = max(((like[:, k].sum(), (k,)) for k in range(3)), key=lambda x: x[0])
        grid = np.linspace(0, 1, 201)
        while len(chosen) < 3:
            tries = []
            for k in set(range(3)) - set(chosen):
                e = np.exp(like[:, [*chosen, k]])
                shares = [(1 - g, g) for g in grid] if len(chosen) == 1 else [(x, y, 1 - x - y) for x in grid[::4] for y in grid[::4] if x + y <= 1]
                tries.append((max(np.log(np.maximum(e @ np.array(w), 1e-300)).sum() for w in shares), k))
            value, k = max(tries)
            cost = np.log(len(like) + 1)
            if abs(value - best - cost) < 0.05:
                break  # too near to tell on a grid
            if value - best <= cost:
                e = np.exp(like[:, list(chosen)])
                assert "abc".index(name) in chosen and (len(chosen) > 1 or share == 1.0)
                break
            best, chosen = value, (*chosen, k)


def test_em_does_not_lower_the_likelihood():
    rng = np.random.default_rng(12)
    like = rng.normal(size=(50, 3)) * 3
    few = language.Inference(language.Model(["a", "b", "c"], np.zeros((3, 4), np.float32)), language.Settings(rounds=1))._proportions(like, [0, 1, 2])
    more = language.Inference(language.Model(["a", "b", "c"], np.zeros((3, 4), np.float32)), language.Settings(rounds=30))._proportions(like, [0, 1, 2])
    assert more[1] >= few[1] and abs(more[0].sum() - 1) < 1e-9


# --- near-duplicates


def slow_fingerprint(text):
    tokens = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_components_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    base = [words(rng, 300) for _ in range(12)]
    texts = base + [t + " tail" for t in base] + [t.replace(" ", "  ", 3) for t in base[:5]] + [None, "", "A b", "a B", words(rng, 2), "x y z"]
    docs = [(1000 - i, t, *[None] * 9) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, write(spark, tmp_path, documents=docs)).collect()}
    prints = {d[0]: slow_fingerprint(d[1]) for d in docs}
    reach = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            reach[i] = min(reach[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", reach[i]) for i in prints}


def test_links_at_two_bits_and_long_chains(spark):
    prints = [0, 3, 15, 63, (1 << 63) | 63, 1 << 40 | 0xFFF00, 0xFFF00]
    prints += [sum(3 << (2 * j) for j in range(i)) for i in range(4, 20)]
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(dict.fromkeys(prints))], "id long, simhash long")
    found = {r["id"]: r["component"] for r in simhash.components(simhash.ball_links(nodes, 2)).collect()}
    assert {k for k, v in found.items() if v == 0} == set(range(5)) | set(range(7, 23))
    assert found[5] == found[6] == 5


def test_a_fingerprint_without_id_links_its_neighbours(spark):
    rows = spark.createDataFrame([(5, 0), (None, 3), (9, 15), (7, 0xFF << 40)], "doc_id long, simhash long")
    got = {(r["doc_id"], r["simhash"]): r["component_id"] for r in simhash._with_components(rows, 2).collect()}
    assert got == {(5, 0): 5, (None, 3): 5, (9, 15): 5, (7, 0xFF << 40): 7}


def test_hot_fingerprints_without_broadcast(spark, monkeypatch):
    """A third of all rows share a fingerprint, a component has many: the same result where key tables are too large to broadcast."""
    from weftline.llm import common

    rng = random.Random(77)
    base = words(rng, 300).split()
    texts = ["the same text again and again"] * 150 + [None] * 30
    for i in range(120):
        some = base.copy()
        some[i * 2] = "changed"
        texts.append(" ".join(some))
    texts += [words(rng, 40) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in simhash.near_duplicates(docs, keep=["doc_id"]).collect())
    kept = sorted(r[0] for r in simhash.first_of_each(docs).select("doc_id").collect())
    monkeypatch.setattr(common, "MOST_KEYS", 3)
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs, keep=["doc_id"]).collect()) == want
    assert sorted(r[0] for r in simhash.first_of_each(docs).select("doc_id").collect()) == kept == sorted({c for _, _, c in want})
    from pyspark.sql import functions as F

    plan = common.keyed_join(docs.withColumn("k", F.coalesce(F.length("text") % 7, F.lit(0))).select("doc_id", "k"), spark.range(7).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("x")), "k", "left")
    assert plan.count() == docs.count() and plan.where("x IS NULL").isEmpty()


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(131)
    a, b, c = (words(rng, 200) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, c, "u"), (3, c, "v"), (4, c + " ", "w"), (None, a, "n"), (None, a, "n"), (6, None, "e"), (7, "", "e")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (3, c): 1, (None, a): 2, (6, None): 1})


# --- token counts and encoding


def test_token_counts_against_a_lattice_library():
    table, by_bytes = tokencount.pieces("piece_bpe_32k.model")
    assert by_bytes and abs(sum(math.exp(x) for x in table.values()) - 1) < 1e-9
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *table.items()], 0, False))
    rng = random.Random(14)
    pool = [words(rng, 1, "abcdefghijklmnopqrstuvwxyz") for _ in range(800)] + ["日本語", "naïve", "zzzzzzzzzz", "a", "ẞß", "understanding"]
    counter = tokencount.TrieCounter(table, 10.0, 1000, by_bytes)
    got = counter([" ".join(pool), None, "", "  \n"])
    one = [counter([w])[0][0] for w in pool]
    assert got[0][0] == sum(one) and got[0][1:] == [0, 0, 0] and got[1][0] == len(pool)
    known = [w for w in pool if all(ch in table for ch in w)]
    assert [counter([w])[0][0] for w in known] == [len(unigram.encode("▁" + w).ids) for w in known]
    assert counter(["\U00012345"])[0][0] == 5  # the space mark and four bytes


def test_token_counts_are_near_those_of_the_vocabularys_own_encoder():
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = tokencount.TrieCounter(tokencount.pieces("piece_bpe_32k.model")[0], 10.0, 1000, True)
    text = "hello world this is text about understanding information and other common words of the language"
    assert counter(["understanding", "information", "hello world this is text"])[0] == [1, 1, 6]
    assert abs(counter([text])[0][0] / len(own.encode(text)) - 1) < 0.05


@pytest.mark.parametrize("mask", [7, 1023])
def test_encoding_equals_the_library(mask):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(15)
    bits = ["a", "foo", "  ", " ", "\n", "\n\n", " \n", "'s", "é", " ", "　", "<|endoftext|>", "1", "?!", "\t", "x<|endo", "🙂", "ß", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["a" * 20_000, " " * 20_000, ""]
    encoder, decoder = bpe.Encoder(bpe.Settings(mask=mask, longest=64)), bpe.Decoder()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder(t).tolist() == e.ids
        assert decoder(e.ids) == library.decode(e.ids, skip_special_tokens=False) == t


def test_chunks_are_reused_in_every_script_and_the_cache_is_bounded():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(151)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(6000))
    marks = "".join(rng.choice("。，、！ 　") if rng.random() < 0.1 else c for c in cjk)
    texts = [marks, "一" + marks, marks[5:] + "二", " ".join(prose(rng, 400) for _ in range(3)), "x " + prose(rng, 900)]
    encoder = bpe.Encoder(bpe.Settings(mask=127))
    for t in texts:
        assert encoder(t).tolist() == library.encode(t, add_special_tokens=False).ids
    before = len(encoder.chunks)
    assert encoder("三" + marks).tolist() == library.encode("三" + marks, add_special_tokens=False).ids
    assert len(encoder.chunks) <= before + 2  # the same chunks again
    small = bpe.Encoder(bpe.Settings(mask=127, keep_bytes=20_000))
    for t in texts:
        assert small(t).tolist() == encoder(t).tolist() and small.held <= 20_000


def test_every_character_at_a_join():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(152)
    pool = [chr(c) for c in range(32, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(" \n'srtveldm1a!　") for _ in range(200)) for _ in range(300)]
    encoder = bpe.Encoder(bpe.Settings(mask=3, longest=12))
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder(t).tolist() == e.ids


def test_ids_that_are_no_text_decode_as_the_library_does():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(16)
    for _ in range(100):
        ids = [rng.randrange(50_257) for _ in range(12)]
        assert bpe.Decoder()(ids) == library.decode(ids, skip_special_tokens=False)
