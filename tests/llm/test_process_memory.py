"""Memory of Python processes, which live on from stage to stage."""

import tracemalloc

import numpy as np
import pytest

from quietgrove.llm import common, jaccard_join, language_id

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
word_bpe = pytest.importorskip("quietgrove.llm.word_bpe")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_processes_keep_tables_of_one_operator():
    """A pipeline's Python processes live on from stage to stage, and into the next run."""
    jaccard_join.shingle_set("some words that are kept by their hashes")
    word_bpe.vocabulary(WORD_BPE)
    common.begin_task("word_bpe")
    assert not jaccard_join._hashes and word_bpe.vocabulary.cache_info().currsize
    common.begin_task("language_id")
    assert not word_bpe.vocabulary.cache_info().currsize


def test_language_scores_take_little_memory():
    model = language_id.LanguageModel(list("abcdefgh"), np.log(np.random.default_rng(0).dirichlet(
        np.ones(language_id.BUCKETS), 8).T).astype(np.float32))
    tracemalloc.start()
    model.judge(["words of a language " * 150] * 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
