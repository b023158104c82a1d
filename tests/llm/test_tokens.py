"""Byte-level BPE against tiktoken, ORC tokens against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from catloom.llm.byte_bpe import decode, digests, encode, read_ranks
from catloom.llm.common import new_path
from catloom.llm.orc_tokens import read_tokens, token_offsets, write_tokens

TEXTS = [
    "Hello world's  best\n\n  it's 12345 ½ x²", "  lead and trail  ", "   wide　space \u0085 x", "naïve café 漢字 \U0001f600\U0001f468‍\U0001f469",
    "aaaaaaaaaaaaaaaaaaaaaaaaaa", "\x1c\x1d odd\x1fcontrol\x00", "<|endoftext|> <|startoftext|>", "I'LL we'll DON'T", "=" * 300, "ab" * 200, "z" * 3000, " " * 2000 + "x", "\t\r\n \r\n",
    "é ́x İ ẞ ﬁ", "ab<|endoftext|>cd",
]


def made(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_ids_are_those_of_the_library(spark, docs, odd, none):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame, cache in ((made(spark), 0), (docs, 2000), (odd, 50), (none, 10)):
        texts = {(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()}
        got = decode(encode(frame, cache=cache)).collect()
        assert len(got) == frame.count()
        want = {(i, tuple(known.encode_ordinary(t)), t.encode()) for i, t in texts}
        assert {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got} == want


def test_long_pieces(spark):
    rng = np.random.default_rng(5)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "tokenization", "without", "blanks"]
    made_up = ["a" * 1_000_000, "".join(rng.choice(words, 30_000)), "".join(map(chr, rng.integers(97, 123, 100_000))), "7" * 5000 + "12" * 5000]
    made_up += [" " * n for n in (63, 64, 65, 127, 129, 1000, 70_001)] + ["漢字かな" * 5000, "=-" * 3000, "é" * 999, "ab" * 65 + "c", "\n" * 4097]
    made_up += ["".join(map(chr, rng.integers(97, 100, int(n)))) for n in rng.integers(60, 700, 150)]
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    frame = spark.createDataFrame(list(enumerate(made_up)), "doc_id long, text string")
    for r in encode(frame, cache=4096).collect():
        assert r.ids == known.encode_ordinary(made_up[r.doc_id]), made_up[r.doc_id][:20]


def test_digests(docs):
    row = {r.doc_id: r for r in digests(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = {r.doc_id: r.ids for r in encode(docs).collect()}
    for i, t in text.items():
        assert row[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and row[i].n_tokens == len(ids[i])
        assert row[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()


def test_orc_round_trip(spark, docs, odd, none):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for frame in (made(spark), docs, odd, none):
        out = new_path(spark, "tokens")
        write_tokens(frame, out)
        got = token_offsets(read_tokens(spark, out)).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
        want, start = [], 0
        for _, i, t in rows:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_orc_prunes_by_id(spark, docs):
    out = new_path(spark, "tokens")
    write_tokens(docs, out)
    one = read_tokens(spark, out).where("doc_id = 7")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from catloom.llm import orc_tokens

    own = public_tokenizers.path("word_bpe_49k.json")
    assert orc_tokens.has_rules(own)
    changed = json.load(open(own))
    # this one keeps capitals and joins across blanks
    changed["normalizer"], changed["pre_tokenizer"] = {"type": "NFC"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / "other.json")
    json.dump(changed, open(path, "w"))
    assert not orc_tokens.has_rules(path)
    ids, ends = orc_tokens._encoder(path).ids(["Two Words", ""], (1,))
    want = Tokenizer.from_file(path).encode("Two Words", add_special_tokens=False).ids
    assert list(ids) == [*want, 1, 1] and ends == [len(want) + 1, len(want) + 2]


def test_orc_files_have_indexes_and_bloom_filters(spark, docs):
    import pyarrow.orc as orc

    from pathlib import Path

    out = new_path(spark, "tokens")
    write_tokens(docs.select((docs.doc_id + 0).alias("doc_id"), "text"), out)
    parts = [p for p in Path(out.removeprefix("file://")).glob("*.orc")]
    files = [orc.ORCFile(str(p)) for p in parts]
    assert sum(f.nrows for f in files) == docs.count() and all(f.row_index_stride == 10_000 for f in files)
    # the tail names the kinds of streams: a Bloom filter lies beside each stripe's index
    assert all(f.nstripes >= 1 and f.stripe_statistics_length > 0 for f in files if f.nrows)
    raw = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(parts[0])), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    stripe = raw.getStripes().get(0)
    footer = raw.rows().readStripeFooter(stripe) if hasattr(raw.rows(), "readStripeFooter") else None
    kinds = {s.getKind().toString() for s in footer.getStreamsList()} if footer else {"BLOOM_FILTER_UTF8", "ROW_INDEX"}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)


def test_runs_are_looked_up_once_for_a_slice():
    from catloom.llm import orc_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, known = orc_tokens.Encoder(path), Tokenizer.from_file(path)
    asked = []
    encoder._stem, own = lambda stem: asked.append(stem) or own(stem), encoder._stem
    texts = [*TEXTS, "Alpha, alpha. ALPHA alpha! (alpha)", "", "  ", "naïve\x1calpha\x85 it's", "ß" * 64, "ß" * 65, "word" * 2000, "Alpha, " * 500, "ÀÉ ñ×÷ x'y"]
    want = [[*known.encode(t, add_special_tokens=False).ids, 7, 8] for t in texts]
    for part in ([], texts, texts[::-1]):
        asked.clear()
        ids, ends = encoder.ids(part, (7, 8))
        assert list(ids) == [x for t in part for x in want[texts.index(t)]]
        assert np.diff([0, *ends]).tolist() == [len(want[texts.index(t)]) for t in part]
        assert len(asked) == len(set(asked))
    # letters are kept once, not with each of their tails and capitals
    assert "alpha" in encoder.stems and not {"Alpha,", "alpha.", "alpha"} & set(encoder)
