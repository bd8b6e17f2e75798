import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from weftline.llm import align

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def slow(docs):
    """The whole result by the libraries over whole texts and loops over tokens."""
    ta = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = sorted(ByteLevel.alphabet())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    assert sorted(code) == letters
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b, ends = [], [], None
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            bytes_a = [bytes(code[c] for c in ta.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = [], []
        groups, links = [], []
        if a:
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                links.append((a[x - 1], b[y - 1]))
                i, j = x, y
        counts.update(links)
        found.append((doc_id, len(a), len(b), links, groups))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, a, b, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, ls, g in found], counts


def odd_texts():
    rng = random.Random(9)
    texts = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "\n", "x\n\n  y\tz ", "don't we'll", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "über straße", "漢字かな混じり文。漢字", "🙂🙃 é \x00 \x1c \xa0  z", "　x", "x" * 3000, "#### $$$$ %%% ||", "1 22 333 4444", "a\xa0 b", "a\x85 b", "a\x1c b", "end.\r\nnext", "tail\n", "tail   x"]
    alphabet = ["a", "the", " ", " ", " ", "\n", "é", ".", ",", "'s", "1", "\t", "ing", "漢", "\xa0", "-", "|", "T"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_against_the_libraries(spark, small):
    """Whole texts by the libraries, with chunks and caches of any size."""
    texts = odd_texts()
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[40]), (None, texts[41])]
    s = align.Settings(keep_bytes=2000, chunk_bytes=300, chunk_rows=7) if small else align.Settings()
    found, pairs = align.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), s)
    want, counts = slow(docs)
    key = lambda r: tuple("-" if x is None else str(x) for x in r)
    assert sorted(map(key, found.select(*COLUMNS).collect())) == sorted(map(key, want))
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["links"] for r in pairs.collect()} == dict(counts)


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    want = sorted(map(tuple, align.align(docs)[0].collect()), key=str)
    monkeypatch.setattr(align, "sized_broadcast", lambda df: df)
    assert sorted(map(tuple, align.align(docs)[0].collect()), key=str) == want


def test_document_counts(spark):
    docs = spark.createDataFrame([(i, "the the the cat" if i % 3 else "the dog") for i in range(300)], "doc_id long, text string").repartition(2)
    pairs = align.align(docs)[1].toPandas()
    both = align.Aligner(align.Settings())
    the, cat = (int(both.links(both.numbers([w]))[0]) for w in ("the", "cat"))
    by = pairs.set_index("pair")
    assert by.loc[the, "docs"] == 300 and by.loc[the, "links"] == 700
    assert by.loc[cat, "docs"] == by.loc[cat, "links"] == 200


def test_containers():
    rng = np.random.default_rng(2)
    for n in (1, 64, 65, 5000, 60_000):
        x = np.sort(rng.choice(1 << 16, n, replace=False)).astype(np.uint16)
        assert align.members(align.container(x.tobytes())).tolist() == x.tolist()
    assert len(align.container(np.arange(60_000, dtype=np.uint16).tobytes())) == 7501


def test_long_texts_in_blocks(spark, monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta,"], k=3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = [tuple(r) for r in align.align(docs)[0].collect()]
    chunk, aligner = align.Chunk(), align.Aligner(align.Settings())
    monkeypatch.setattr(align, "BLOCK", 100)
    assert align.document(aligner, chunk, text) == (want[0][1], want[0][2], want[0][3], want[0][7])
