"""BPE and token counts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyspark.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        source = file.read()
    return bpe.WordBpe(source, bpe.newer_signs(source))


def ids_of(own, texts):
    split = [own.pretokens(t) for t in texts]
    words = list({w for s in split for w in s} - set(own.added))
    flat, counts = own.encode_words(words)
    known, at = {t: [i] for t, i in own.added.items()}, 0
    for w, n in zip(words, counts.tolist()):
        known[w] = flat[at : at + n].tolist()
        at += n
    return [[i for w in s for i in known[w]] for s in split]


def test_every_character(own, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in points]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(own, texts) == want


def test_random_strings(own, library):
    rng = random.Random(1)
    signs = "aaaaabcdtheinΣσςÀéİßſK'<|>endoftext 12 \n\t́가"
    tails = ["", "<|endoftext|>", "<|startoftext|>x", "aaaaaaaaaaaa", "'re's"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) + rng.choice(tails) for _ in range(3000)]
    assert ids_of(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_and_edge_rows(spark, frame, edge_rows, clash, library):
    docs = clash(frame(edge_rows))
    tiny = spark.read.parquet(f"{TINY}/documents.parquet")
    for source in (docs, tiny):
        rows = source.select("doc_id", "text").collect()
        want = []
        for i, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
        got = [(r[0], list(r[1]), r[2]) for r in bpe.encode(source, PATH).collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(got, key=order) == sorted(want, key=order)
        counts = [tuple(r) for r in token_counts.count_tokens(source, PATH).collect()]
        sizes = [(i, len((t or "").encode()), len(w[1])) for (i, t), w in zip(rows, want)]
        assert sorted(counts, key=str) == sorted(sizes, key=str)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_query_digests(spark, library):
    got = {r["doc_id"]: r for r in bpe.op3_bpe(spark, TINY).collect()}
    for i, text in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").limit(20).collect():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_memory_of_a_task_starts_afresh(frame, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    rows = [(k, f"word{chr(97 + k % 26)} again {chr(97 + k % 7)}x") for k in range(60)]
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r[0], len(r[1])) for r in bpe.encode(frame(rows), PATH).collect()) == want
    assert sorted((r[0], r[2]) for r in token_counts.count_tokens(frame(rows), PATH).collect()) == want
