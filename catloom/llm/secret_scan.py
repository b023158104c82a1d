r"""Secret scans: three fixed patterns and a randomness test battery. Native: no Python on the rows.

Base kinds ``assign``, ``access`` and ``hex`` are leftmost non-overlapping
matches of their patterns, of a least length. The battery adds spans:

1. Candidates are the maximal runs of ``[A-Za-z0-9+/_-]`` of ``MIN_LEN`` or more,
   with the ``=`` that end them; an inner ``=`` cuts. A run that fits no encoding
   is cut into the maximal runs of each alphabet.
2. Each is given the smallest alphabet that holds all its characters (hex,
   base32, base62, base64, base64url), and its characters become codes in it.
3. The battery is three tests: chi-squared of the alphabet counts, runs, and
   serial correlation. Each holds the codes against two hypotheses.
   Against uniform independent codes (chi-squared; runs above and below the
   alphabet's middle; lag-1 correlation) the Bonferroni combination must not
   reject at ``ALPHA``: what rejects is text, a path or a pattern, and gets p = 1.
4. Against text, each gives a p-value. Chi-squared: text has at least
   ``TEXT_RATE / alphabet`` of its pairs of codes equal, a random string
   ``1 / alphabet``; the chance of so small a statistic (square-root transform of a
   Poisson count). Runs: text changes its character class (lower, upper, digit,
   sign) at ``TEXT_CHANGES`` of its steps at most; the chance of so many runs.
   Serial: text follows the steps between classes and letters of a text model
   (fixed values); its likelihood ratio to independent codes bounds the chance
   of such a ratio in text. The p-value that is controlled is their Bonferroni
   combination, three times the least.
5. Length-aware false-discovery control: Benjamini-Hochberg at ``RATE`` within
   each stratum of encoding and length class (power of two), over all
   distinct candidates of the table. The p-values are rounded up to a fixed grid, so a
   stratum's threshold comes from a histogram of bounded size and never from
   collected p-values.

Offsets are code points, end exclusive. Defined cases: a null or empty text has
no span; texts of any length are searched whole; spans that tie in a place go
by kind; equal candidates count once in the control; repeated rows and rows
without id are searched each; an empty table gives an empty result; columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.llm.common import stash

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of the class holds a long enough match if and only if its first possible start does.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
MIN_LEN = 12
#: Signs after a run are part of it only where they end it: inner ones join names and values.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % MIN_LEN
ALPHA = 0.001
RATE = 0.05
TEXT_RATE = 2.0
TEXT_CHANGES = 0.35
#: Grid steps for each power of ten of p, and the smallest power kept apart.
STEPS, DEEPEST = 20, 60

#: Characters of the text model, and its chances from class to class (rows: lower, upper, digit, sign, start).
MODEL_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CLASS_STEPS = ((0.9, 0.04, 0.02, 0.04), (0.5, 0.42, 0.03, 0.05), (0.1, 0.08, 0.7, 0.12), (0.55, 0.2, 0.2, 0.05), (0.5, 0.3, 0.15, 0.05))
#: -ln of the chance of a letter after the start and after each letter, in quarters from 'a'; counted over words of program texts.
LETTER_STEPS = (
    "lnkmmmpplusnmnnmuljloqnuuvwnlmvtpwnwqimkwnwikiqqtsqwjsnrivvulnvhtvlrvmmsjvwvmujwpuivvknwmlsvguwnrinvvwtw"
    "lttnetuvhvvouskuwqmrmtuvrwmuljoorvswvnnjtoshjlvqsmswkvsskktwgwwmutitwlpokwvwqwnutufuqljwwmrlnswlkqlsuwvt"
    "gwvufvwviwvsrthvwosmqwwwsvppmoooowvwtlmfkpvoljwpwswqlwruewwvpvpvvvgrwsptgwvwuwnvrresruiwumtmrsuqjrpulwtw"
    "jutogruviwvjvtkswtmnnuuwlvhnusfvwvkwusotjiwuosnwwwtwlulkjqiumwrrurlswvkhpqvwswspnlsqswqwrnlgpmwhnmlpnuwv"
    "ivtshuvtmwvjvujlvipkovuwowuuvtuvwvvvwsvtvvsotubvwvwwjtqpfsovjwrsoojswmllpttwowovotgttnjvsqssmmvtkglvswpw"
    "kvqsgsvjhwvqtumrwklnovsvovonoqlqpwnwwjlislwjjjwwwvwwguvwduuwiwwwtunuwuuvvwuwvvhttriuwihwwqvmkvwkntvvrtww"
    "lrirjqvsjwwrrwriwuqgvvunqusqpslruulwwonlmgwpiivrowsslurvcuvujwwrptmuwtsuuwvvrt"
)

BASE_KINDS = ("assign", "access", "hex")
#: Encoding, pattern of the whole candidate, alphabet in code order (fixed values).
ENCODINGS = (
    ("rand_hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("rand_base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("rand_base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("rand_base64", r"^[A-Za-z0-9+/]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("rand_base64url", r"^[A-Za-z0-9_-]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FITS = "|".join(f"(?:{pattern})" for _, pattern, _ in ENCODINGS)
#: Maximal runs of each alphabet, for candidates that fit no encoding.
PARTS = tuple(
    f"(?<![{own}])[{own}]{{{MIN_LEN},}}{pad}"
    for own, pad in (("0-9a-f", ""), ("0-9A-F", ""), ("A-Z2-7", "(?:=+$)?"), ("A-Za-z0-9", ""), ("A-Za-z0-9+/", "(?:={1,2}$)?"), ("A-Za-z0-9_-", "(?:={1,2}$)?"))
)
KINDS = (*BASE_KINDS, *(name for name, _, _ in ENCODINGS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, pattern: str) -> Column:
    """``array<struct<start, hit>>`` of the non-empty matches of ``pattern``, in order.

    A start is the sum of the gaps and hits before it. It is added up by blocks
    of about the square root of their number, so no array grows in a fold.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def summed(xs: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(xs, first + 1, count), F.lit(0), lambda acc, x: acc + x)

    def placed(s: Column) -> Column:
        n, wide = F.size(s["hits"]), F.ceil(F.sqrt(F.size(s["hits"]))).cast("int")
        whole = F.transform(F.sequence(F.lit(0), wide - 1), lambda b: summed(s["steps"], b * wide, wide))
        before = F.transform(F.sequence(F.lit(0), wide - 1), lambda b: summed(whole, F.lit(0), b))
        return let(before, lambda at: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(s, wide, at, i)))

    def one(s: Column, wide: Column, before: Column, i: Column) -> Column:
        block = F.floor(i / wide).cast("int")
        start = F.get(before, block) + summed(s["steps"], block * wide, i - block * wide) + F.length(F.get(s["gaps"], i))
        return F.struct(start.alias("start"), F.get(s["hits"], i).alias("hit"))

    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    found = let(F.struct(gaps.alias("gaps"), hits.alias("hits"), steps.alias("steps")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def _span(hit: Column, kind: str) -> Column:
    return F.struct(
        hit["start"].cast("int").alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        (hit["start"] + F.length(hit["hit"])).cast("int").alias("end"),
        F.lit(kind).alias("kind"),
    )


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds."""
    assign = F.filter(occurrences(text, ASSIGN), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 2)) >= MIN_VALUE)
    return {
        "assign": F.transform(assign, lambda h: _span(h, "assign")),
        "access": F.transform(occurrences(text, ACCESS), lambda h: _span(h, "access")),
        "hex": F.transform(occurrences(text, HEX), lambda h: _span(h, "hex")),
    }


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a normal variable; Abramowitz and Stegun 26.2.17, error below 1e-7, tail form beyond 5."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) * 0.3989422804014327
    tail = F.when(a < 5, density * poly).otherwise(density / a * (1 - 1 / (a * a)))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def text_steps() -> list[float]:
    """-ln of the text model's chance of each character (column) after each character and at the start (row)."""
    sizes = (26, 26, 10, 4)

    def kind(c: str) -> int:
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3

    out = []
    for a in (*MODEL_CHARS, ""):
        row = ord(a.lower()) - ord("a") + 1 if a.isalpha() else 0
        for c in MODEL_CHARS:
            within = (ord(LETTER_STEPS[row * 26 + ord(c.lower()) - ord("a")]) - ord("a")) / 4 if c.isalpha() else math.log(sizes[kind(c)])
            out.append(within - math.log(CLASS_STEPS[kind(a) if a else 4][kind(c)]))
    return out


def text_model(bare: Column) -> Column:
    """``struct<surprise, changes>``: -ln of the chance of the string under the text model, and its changes of class."""
    width = len(MODEL_CHARS)
    steps = F.split(F.lit(",".join(f"{x:.4f}" for x in text_steps())), ",").cast("array<double>")

    def kind(c: Column) -> Column:
        return F.when(c < 26, 0).when(c < 52, 1).when(c < 62, 2).otherwise(3)

    def summed(codes: Column) -> Column:
        before = F.concat(F.array(F.lit(width)), F.slice(codes, 1, F.size(codes) - 1))
        chances = F.zip_with(before, codes, lambda a, b: F.get(steps, a * width + b))
        changes = F.zip_with(before, codes, lambda a, b: F.when((a < width) & (kind(a) != kind(b)), 1.0).otherwise(0.0))
        return F.struct(F.aggregate(chances, F.lit(0.0), lambda acc, x: acc + x).alias("surprise"), F.aggregate(changes, F.lit(0.0), lambda acc, x: acc + x).alias("changes"))

    return let(F.transform(F.split(bare, ""), lambda c: F.instr(F.lit(MODEL_CHARS), c) - 1), summed)


def battery(codes: Column, size: int, text: Column) -> Column:
    """p-value that the codes are text and not random, 1 if a randomness test rejects; ``text`` is their ``text_model``."""

    half = size // 2

    def counted(x: Column) -> Column:
        squares = F.aggregate(
            F.sequence(F.lit(0), F.lit(size - 1)),
            F.lit(0.0),
            lambda acc, s: acc + F.pow(F.size(F.filter(x, lambda c: c == s)).cast("double"), F.lit(2.0)),
        )
        return F.struct(
            x.alias("x"),
            F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b")).alias("pairs"),
            F.size(x).cast("double").alias("n"),
            squares.alias("squares"),
            F.size(F.filter(x, lambda c: c >= half)).cast("double").alias("high"),
            (F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c) / F.size(x)).alias("mean"),
        )

    def spread_out(s: Column) -> Column:
        changes = F.filter(s["pairs"], lambda p: (p["a"] >= half) != (p["b"] >= half))
        return F.struct(
            s["n"].alias("n"),
            s["squares"].alias("squares"),
            s["high"].alias("high"),
            (F.size(changes) + 1.0).alias("runs"),
            (2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1).alias("expected"),
            F.aggregate(s["x"], F.lit(0.0), lambda acc, c: acc + (c - s["mean"]) * (c - s["mean"])).alias("spread"),
            F.aggregate(s["pairs"], F.lit(0.0), lambda acc, p: acc + (p["a"] - s["mean"]) * (p["b"] - s["mean"])).alias("lagged"),
        )

    def scores(s: Column) -> Column:
        n, flat = s["n"], (s["high"] == 0) | (s["high"] == s["n"])
        runs_sd = F.sqrt((s["expected"] - 1) * (s["expected"] - 2) / (n - 1))
        return F.struct(
            n.alias("n"),
            ((s["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)).alias("chi"),
            F.when(flat, F.lit(99.0)).otherwise(F.abs((s["runs"] - s["expected"]) / runs_sd)).alias("runs"),
            F.when(s["spread"] == 0, F.lit(99.0)).otherwise(F.abs((s["lagged"] / s["spread"] + 1 / n) * F.sqrt(n))).alias("serial"),
            (2 * (F.sqrt(n * (n - 1) / 2 * (TEXT_RATE / size) + 0.375) - F.sqrt((s["squares"] - n) / 2 + 0.375))).alias("few"),
        )

    def decided(z: Column) -> Column:
        uniform = F.least(let(z["chi"], upper_tail), 2 * let(z["runs"], upper_tail), 2 * let(z["serial"], upper_tail)) * 3
        steps = z["n"] - 1
        runs = (text["changes"] - 0.5 - steps * TEXT_CHANGES) / F.sqrt(steps * (TEXT_CHANGES * (1 - TEXT_CHANGES)))
        serial = F.exp(F.least(F.lit(math.log(size)) * z["n"] - text["surprise"], F.lit(0.0)))
        against_text = 3 * F.least(let(z["few"], upper_tail), let(runs, upper_tail), serial)
        return F.when(uniform < ALPHA, F.lit(1.0)).otherwise(F.least(against_text, F.lit(1.0)))

    def tests(x: Column) -> Column:
        return let(let(let(counted(x), spread_out), scores), decided)

    return let(codes, tests)


def runs(text: Column) -> Column:
    """``array<struct<start, hit>>`` of the strings that the battery tests."""

    def parts(h: Column) -> Column:
        cut = [F.transform(occurrences(h["hit"], p), lambda o: F.struct((h["start"] + o["start"]).alias("start"), o["hit"].alias("hit"))) for p in PARTS]
        return F.array_distinct(F.concat(*cut))

    whole = F.transform(occurrences(text, CANDIDATE), lambda h: F.when(h["hit"].rlike(FITS), F.array(h)).otherwise(parts(h)))
    return F.flatten(whole)


def candidates(text: Column) -> Column:
    """Battery candidates: ``array<struct<start, end, kind, rank, length, step, key>>``; ``step`` is p on the grid."""

    def judged(h: Column) -> Column:
        def one(name: str, alphabet: str) -> Column:
            bare = F.rtrim(h["hit"], F.lit("="))
            bare = F.lower(bare) if name == "rand_hex" else bare
            codes = F.transform(F.split(bare, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
            p = F.when(F.length(bare) < MIN_LEN, F.lit(1.0)).otherwise(let(text_model(F.rtrim(h["hit"], F.lit("="))), lambda t: battery(codes, len(alphabet), t)))
            step = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(DEEPEST * STEPS))
            return F.struct(
                h["start"].cast("int").alias("start"),
                (h["start"] + F.length(h["hit"])).cast("int").alias("end"),
                F.lit(name).alias("kind"),
                F.lit(KINDS.index(name)).alias("rank"),
                F.floor(F.log2(F.length(h["hit"]).cast("double"))).cast("int").alias("length"),
                F.greatest(step, F.lit(0)).cast("int").alias("step"),
                F.xxhash64(h["hit"]).alias("key"),
            )

        return reduce(
            lambda out, e: F.when(h["hit"].rlike(e[1]), one(e[0], e[2])).otherwise(out),
            reversed(ENCODINGS),
            F.lit(None).cast("struct<start:int,end:int,kind:string,rank:int,length:int,step:int,key:bigint>"),
        )

    return F.filter(F.transform(runs(text), judged), lambda c: c.isNotNull())


def thresholds(found: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg on the grid: by stratum, the smallest step that is discovered.

    ``found`` has ``cands``. What comes to the driver is a row for each stratum
    with discoveries, at most 5 encodings by 31 length classes.
    """
    once = found.select(F.explode("cands").alias("c")).select("c.kind", "c.length", "c.step", "c.key").distinct()
    bins = once.groupBy("kind", "length", "step").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("kind", "length")
    better = own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("kind", "length", "step", F.sum("n").over(better).alias("k"), F.sum("n").over(own).alias("m"))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("m") <= F.lit(rate) * F.col("k"))
    rows = passing.groupBy("kind", "length").agg(F.min("step").alias("step")).collect()
    return {(r["kind"], r["length"]): r["step"] for r in rows}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Id, ``base`` and ``spans``: arrays of ``(start, rank, end, kind)`` by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    by_kind = base_spans(F.col("t"))
    found = stash(
        slim.select("doc_id", F.array_sort(F.concat(*by_kind.values())).alias("base"), candidates(F.col("t")).alias("cands")), "secrets"
    )
    kept = F.lit(False)
    passing = thresholds(found, rate)

    def discovered(c: Column) -> Column:
        hit = kept
        for (kind, length), step in sorted(passing.items()):
            hit = hit | ((c["kind"] == kind) & (c["length"] == length) & (c["step"] >= step))
        return hit

    added = F.transform(
        F.filter("cands", discovered),
        lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] >= len(BASE_KINDS))).cast("long").alias("n_random"),
    )
