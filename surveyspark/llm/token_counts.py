"""Token counts of whole texts without making their ids.

Each task counts the pieces of every distinct pre-token once, joins these counts to
each document's pre-token frequencies and sums the products.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MEMORY, WordBpe, newer_signs, slices
from .common import documents


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row's whole text.

    As the tokenizers library counts without added special tokens, truncation or
    padding; special strings inside a text count as one token. A null text is empty
    and has none. Repeated rows give repeated rows, an empty table gives none, other
    columns are ignored. Memory is bounded by one slice, or by the longest text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    newer = newer_signs(source)

    def run(batches):
        bpe = WordBpe(source, newer)
        fixed = dict.fromkeys(bpe.added, 1)
        pieces = dict(fixed)
        for ids, texts in slices(batches):
            frequencies = [Counter(bpe.pretokens(t)) for t in texts]
            met = set().union(*frequencies)
            fresh = list(met.difference(pieces))
            if len(pieces) + len(fresh) > MEMORY:
                pieces = dict(fixed)
                fresh = list(met.difference(pieces))
            pieces.update(zip(fresh, bpe.encode_words(fresh)[1].tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([sum([n * pieces[w] for w, n in f.items()]) for f in frequencies], pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
