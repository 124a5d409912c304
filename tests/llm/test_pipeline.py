"""The pipeline's stages, each on the input that the one before leaves."""

import collections
import hashlib
import struct

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tapeworks.llm import bpe
from tapeworks.llm.common import staged, table
from tapeworks.llm.mixing import mix

from .test_operators import brute_components, messy, repeated_runs


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "byte_bpe"]
    kept = staged(C.quality(spark, docs, sf))
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    wrong = [i for i in labels if (i in gone) == (labels[i] == 1)]
    assert len(wrong) <= 0.05 * len(labels)

    texts = {r.doc_id: r.text for r in kept.collect()}
    single = staged(C.near_duplicates(spark, kept, sf))
    assert {r.doc_id for r in single.collect()} == {c for _, c in brute_components(texts).values()}

    cut = staged(C.repeats(spark, single, sf))
    before, after = ({r.doc_id: r for r in d.collect()} for d in (single, cut))
    assert set(before) == set(after) and all(len(after[i].text) <= len(before[i].text) and after[i].n_chars == len(after[i].text) for i in after)

    # no run of 50 words that a document before has is left, and what is new repeats nothing is whole
    runs = repeated_runs({i: (r.text or "").encode().decode().lower() for i, r in before.items()}, 50)
    for i, places in runs.items():
        words, left = before[i].text.split(), collections.Counter(after[i].text.split())
        assert left <= collections.Counter(words) and sum(left.values()) <= len(words) - len(places)
        if not repeated_runs({0: " ".join(w for j in runs if j < i for w in before[j].text.lower().split()), 1: before[i].text.lower()}, 6)[1]:
            assert after[i].text == before[i].text

    mixed = staged(C.mixing(spark, cut, sf))
    assert mixed.columns == C.COLUMNS and {r.text for r in mixed.collect()} <= {r.text for r in after.values()}
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    assert taken == {r.doc_id: r.copies for r in mix(cut).collect() if r.copies}

    coded = C.byte_bpe(spark, mixed, sf).collect()
    assert len(coded) == mixed.count()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in coded:
        ids = own.encode_ordinary(after[r.doc_id].text)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest()


def test_stages_on_messy_rows(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows and extra columns go through
    all stages; an empty table gives an empty one."""
    extra = [(None, "no id at all here", None, None, None), (50, None, None, None, None), (51, "twice the same row", "en", "a", 18), (51, "twice the same row", "en", "a", 18)]
    docs = messy(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    for rows in (docs, docs.where("false")):
        many = rows.count()
        for name, stage in C.STAGES:
            rows = staged(stage(spark, rows, sf))
            assert name == "byte_bpe" or rows.columns == C.COLUMNS
            assert name == "mixing" or rows.count() <= max(many, 0) or name == "byte_bpe"
        assert bool(rows.count()) == bool(many)
