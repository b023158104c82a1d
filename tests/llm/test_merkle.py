"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest

from catloom.llm.merkle import OP13_SQL, tamper_checked


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = (r.doc_id, r.source, r.lang, r.n_chars if r.n_chars is None else r.n_chars + more, r.text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of nodes, and each one's siblings with their side (None without one)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k in range(len(nodes)):
            beside = at[k] ^ 1
            paths[k].append((at[k] % 2, level[beside]) if beside < len(level) else None)
            at[k] //= 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in langs:
        own = sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), more in zip(trees, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            fold = leaf(r, 1) if hit else leaf(r)
            for s in path + more:
                fold = h(fold) if s is None else h(s[1], fold) if s[0] else h(fold, s[1])
            out.append((r.doc_id, leaf(r), subroot, root, h(*(s[1] for s in path + more if s)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("step", [2, 12])
def test_manifest_of_the_table(docs, odd, step):
    for frame in (docs, odd):
        assert rows_of(tamper_checked(frame, step)) == expected(frame.select("doc_id", "text", "lang", "source", "n_chars").collect())


@pytest.mark.parametrize("n", [1, 5, 17])
def test_sizes_of_a_group(spark, n):
    rows = [(i * 3, f"text {i}", "en", None, None if i % 5 == 0 else i) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert rows_of(tamper_checked(frame, 2)) == expected(frame.collect())


def test_equal_rows_and_one_hot_key(spark):
    rows = [(7, "same", "en", "a", 1)] * 300 + [(None, "x", None, None, None)] * 50 + [(i, "y", "fr", "a", 2) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert rows_of(tamper_checked(frame, 3)) == expected(frame.collect())


def test_offsets_beyond_their_bound_are_joined(spark, docs, monkeypatch):
    from catloom.llm import merkle

    monkeypatch.setattr(merkle, "OFFSETS", 1)
    assert rows_of(tamper_checked(docs, 4)) == expected(docs.collect())


def test_empty(none):
    assert tamper_checked(none).count() == 0


def test_sql_says_the_same(docs):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({OP13_SQL})").fetchall()
    assert sorted(map(tuple, got), key=str) == expected(docs.collect())
