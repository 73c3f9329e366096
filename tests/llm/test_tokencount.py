from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmill.llm import queries, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expect(library, texts):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdefSTM 'relvd\n\t 0123é漢😀  .,!<|endoftext|>\x00")), max_size=60), min_size=1, max_size=8))
def test_equals_the_library_on_mixed_texts(library, texts):
    assert tokencount.counter(PATH).count(texts).tolist() == expect(library, texts)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=80), min_size=1, max_size=8))
def test_equals_the_library_on_any_text(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tokencount.counter(PATH).count(texts).tolist() == expect(library, texts)


def test_query_equals_the_library(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        n = expect(library, [docs[r["doc_id"]]])[0]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 512)


def test_nulls_long_texts_specials_and_clashes(spark, library):
    texts = [None, "", "a" * 30_000, "ab" * 20_000 + "<|endoftext|>x", "<|endoftext|><|endoftext|>", " " * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in tokencount.count_tokens(frame, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == expect(library, [t or "" for t in texts])
    assert tokencount.count_tokens(frame.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(frame.selectExpr("*", "1 AS n_bytes"), PATH)


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    run, want = np.arange(8), []
    for m in maps:
        run = m[run]
        want.append(run)
    assert np.array_equal(tokencount.scan(maps), np.array(want))
