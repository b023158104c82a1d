"""Language ID and quality: held-out accuracy, folds and odd rows."""

import zlib

from catloom.llm import langid, quality

MID = "/root/testdata/sf0.01"


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_languages(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_score_is_the_brute_force_posterior(spark):
    import numpy as np

    docs = spark.createDataFrame([(i, t, lg) for i, (t, lg) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 6)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    text = "The dog, et le chat!"
    buckets, _ = langid.ngrams([text])
    total = model.prior + np.array([sum(row[b] for b in buckets) for row in model.logp])
    p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    pred, score = model.scored([text])
    assert pred == [model.langs[p.argmax()]] and abs(score[0] - p.max()) < 1e-4


def test_language_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 8}
    assert langid.identify(none).count() == 0
    kept = langid.keep_identified(odd, least=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.85


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, quality.fit(odd, labels)).count() == odd.count()
    assert quality.score_quality(none, quality.fit(none, labels)).count() == 0
    assert quality.score_quality(odd, quality.fit(odd, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the common words of a large language {i % 7}", "aa") for i in range(6000)]
    rows += [(6000 + i, f"zyx qwv kjh vvx wqz {'x' * (i % 5)}", "zz") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, fit_rows=100)
    assert model.langs == ["aa", "zz"]
    pred = {r.doc_id: r.lang_pred for r in langid.identify(frame, fit_rows=100).collect()}
    assert all(pred[i] == lang for i, _, lang in rows)
    assert langid.even_quota([5, 1000, 1000], 105) == 50 and langid.even_quota([5, 6], 105) == 6


def test_sizes_and_calibration_by_brute_force(spark):
    import random

    import numpy as np
    import zstandard

    draw = random.Random(2)
    good, bad = ["river", "stone", "meadow", "lantern", "harbour", "winter"], ["buy", "cheap", "click", "now", "free", "$$$"]
    rows = [(i, " ".join(draw.choices(good if i % 2 else bad, k=draw.randint(5, 900))), i % 2) for i in range(240)] + [(1000, "meadow stone " * 30_000, 1), (1001, "", 0), (1002, None, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))

    def compressed(raw, dictionary):
        known = zstandard.ZstdCompressionDict(dictionary)
        made = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(made.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048))

    def by_hand(text):
        raw = (text or "").encode()
        if not raw:
            return 0.0
        a, b = compressed(raw, model.good), compressed(raw, model.bad)
        return (a - b) / (a + b)

    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, t, _ in rows:
        assert abs(scores[i] - 1 / (1 + np.exp(-(model.base + model.slope * by_hand(t))))) < 1e-9
    x, y = np.array([by_hand(t) for _, t, _ in rows]), np.array([q for *_, q in rows])
    slope, base = quality.calibrated(x, y)
    n = y.sum()
    target = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))

    def loss(s, b):
        p = 1 / (1 + np.exp(-np.clip(s * x + b, -50, 50)))
        w = np.array([s * x.std(), b])
        return -(target * np.log(p + 1e-300) + (1 - target) * np.log(1 - p + 1e-300)).sum() + 0.5e-3 * (w @ w)

    best = loss(slope, base)
    assert all(loss(slope * f, base + d) >= best - 1e-6 for f in (0.9, 0.99, 1.01, 1.1) for d in (-0.1, -0.01, 0, 0.01, 0.1))


def test_long_texts_are_learned_from(spark):
    """Blocks come from whole texts: a text's only telling passage is learnt wherever it stands in it."""
    import random

    draw = random.Random(3)
    noise = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    rows = [(i, noise(3000) + (" lantern meadow harbour winter" if i % 2 else " click cheap buy free now") * 300 + noise(3000), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    assert b"lantern meadow" in model.good and b"click cheap" in model.bad and b"lantern" not in model.bad
    asked = spark.createDataFrame([(1, "lantern meadow harbour winter " * 20), (2, "click cheap buy free now " * 20)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.score_quality(asked, model).collect()}
    assert scores[1] > 0.5 > scores[2]
    assert quality.blocks("é" * 3000)[0] == ("é" * 1024).encode() and quality.blocks("") == []
