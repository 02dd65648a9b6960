"""The pipeline against its stages done by brute force."""

import hashlib

import public_tokenizers
from test_dedup import brute_components
from test_text_operators import brute_pairs
from tokenizers import Tokenizer

import corpus_pipeline
from surveyspark.llm import bpe, toxicity

TINY = "/root/testdata/sf0.001"


def test_rows_match_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit_on_sample(docs, labels)
    toxic = {r["doc_id"] for r in toxicity.scores(docs, model).collect() if r["score"] >= 0.5}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    keep = {t: max(i for i, x in rows if x == t) for _, t in rows}
    rows = [(i, t) for i, t in rows if keep[t] == i]
    near = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    leaks = {i for i, _ in brute_pairs(rows, [(r["item_id"], r["text"]) for r in items.collect()])}
    rows = [(i, t) for i, t in rows if i not in leaks]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, TINY).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
    assert bpe.op3_bpe(spark, TINY, docs.limit(0)).count() == 0
