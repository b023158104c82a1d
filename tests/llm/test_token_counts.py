"""Token counts against the sentencepiece library, huge texts by small chunks."""

import numpy as np
import pytest
import sentencepiece

from catloom.llm.token_counts import cuts, default_path, huge_counts, token_counts

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "   a   b  ", "\ttabs\n\n lines \r\n", "<s> </s> <unk> [INST] <0x41>", "▁▁a▁ b", "naïve 漢字かな \U0001f600\U0001f468‍\U0001f469 \x00\x01",
    "a" * 5000, " " * 3000, "ab" * 2500 + "c", "=-" * 2000, "漢字" * 2000, "\U0001f600" * 1500, "é" * 999, "x " * 3000, ("word " * 7 + "\n") * 300,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


def texts():
    rng = np.random.default_rng(3)
    words = ["the", "quick", "brown", "fox", "tokenization", "überall", "12,345.6", "http://a.b/c?d=e", "İ", "x²", " ", "  "]
    made = ["".join(map(chr, rng.integers(97, 100, int(n)))) for n in rng.integers(60, 4000, 20)]
    made += [" ".join(rng.choice(words, 900)), "".join(rng.choice(words, 900)), "".join(map(chr, rng.integers(0x20, 0x2FF, 5000)))]
    return TEXTS + made


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 8), (512, 64), (100, 8), (37, 3)])
def test_counts_are_those_of_the_library(spark, library, chunk, overlap):
    made = texts()
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts(frame, chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(made)
    for i, t in enumerate(made):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(library.encode(t)), len(t.encode())), (chunk, t[:30])
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_whole_tables(docs, odd, none, library):
    for frame in (docs, odd, none):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in frame.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(frame, chunk=3000).collect()) == want


def test_seams_are_found_in_the_first_round(spark, library, monkeypatch):
    """Prose needs no second round: 256 characters always hold a shared token."""
    from catloom.llm import token_counts as module

    rounds = []
    real = module.stash
    monkeypatch.setattr(module, "stash", lambda df, name="stash": rounds.append(name) or real(df, name))
    text = " ".join(np.random.default_rng(1).choice(["alpha", "beta", "gamma.", "delta,"], 40_000))
    frame = spark.createDataFrame([(0, text)], "row long, text string")
    assert huge_counts(frame, default_path()).first().n_tokens == len(library.encode(text))
    assert rounds == ["spliced"]


def test_cuts_overlap():
    assert cuts(10, 4, 2) == [(0, 6, 0, 4), (4, 10, 6, 10)]
    assert cuts(5, 8, 2) == [(0, 5, 0, 5)]
