"""The corpus pipeline: from raw documents to packed sequences.

Each stage works on all that its predecessor kept and takes (spark, docs, sf_dir). Its result
is written as Parquet and read again as the next stage's docs; all but the last return the
columns of documents."""

from __future__ import annotations

import public_tokenizers

from ledgerlake.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerlake.llm.common import discard, documents, materialize


#: Fewer pieces and bytes of text than the packing query holds, as executors have been through the other stages.
CACHE_ENTRIES, TEXT_BYTES = 100_000, 1 << 19


def drop_toxic(spark, docs, sf_dir):
    """Rejects documents that the classifier, trained on the labelled ones outside the held-out fold, scores 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.training_sample(spark, docs, sf_dir)))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.sample_documents(docs)


def pack(spark, docs, sf_dir):
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "leading", 0, cache_entries=CACHE_ENTRIES, text_bytes=TEXT_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizing, hashing and classifying are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # a stage's input, once its result is written; the table that was read stays
    return STAGES[-1][1](spark, docs, sf_dir)
