"""Ranked lexical search over inverted treaps.

Documents are dealt into segments of bounded size. A segment holds one treap
for each of its terms: the postings are in search order of the document and in
heap order of the impact, the term's share of a score before its weight, so a
node's impact is the largest of its subtree. Equal impacts are ordered by a
hash, so that copies don't make a treap a list.

A search walks the treaps of a query's terms together. It starts from the
roots, with all documents of the segment as interval; at each step the sum of
weight times impact of the nodes is a bound for every document of the interval.
If the bound can't enter the top k the interval ends with all its subtrees.
Else the document of the heaviest node is scored by searching it in the other
treaps, and these searches also give each treap's node for the interval to the
left and to the right. Steps of many intervals and queries are taken at once in
numpy; a stack of slices keeps their number bounded. A task keeps its top k
from segment to segment, so later segments are pruned by what earlier ones gave.

Scores are 64-bit integers. Impacts need the number of documents and terms of
all documents, which one scan counts in advance; weights need the documents of
each term, which are summed over the segments. Segments are rows of a table in
the shared folder, so a search is a map over them without a shuffle; only the
top k of each task and query are shuffled. Queries are asked ``ITEMS`` at a
time, as many as one broadcast holds, each time over all segments.

Defined cases: a null or empty text, and one without a term, is no document
and no query; rows that repeat a document are ranked each; equal scores go by
ascending id, null ids first; a query's repeated words count once; rows that
repeat an item are answered each; texts of any length count whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catloom.llm.common import rank_within, stash
from catloom.shipping import ship_package

#: Terms, as a pattern over characters and over UTF-8 bytes (fixed values).
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Whether a byte is in a term, by its value; and the texts that are counted at once.
IN_TERM = np.array([bool(TERM.match(bytes([b]))) for b in range(256)])
COUNTED = 512
#: Bytes of text in a segment (one document may have more), and of a text that are cut into terms at once.
SEGMENT = 8 << 20
WINDOW = 1 << 20
#: Queries of one broadcast, and intervals of one step.
ITEMS = 1000
SLICE = 4096
K = 10
NO_ID = np.iinfo(np.int64).min
SEGMENTS = "segment long, ids array<long>, terms array<string>, sizes array<int>, docs array<int>, impacts array<int>, lefts array<int>, rights array<int>"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch of texts: a term starts at a byte of one that follows none in its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(0), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        documents, terms = 0, 0
        for first in range(0, len(texts), COUNTED):
            own = offsets[first : first + COUNTED + 1]
            inside = IN_TERM[data[own[0] : own[-1]]]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            # a text starts anew, whatever stands before it
            heads = own[:-1][own[:-1] < own[1:]] - own[0]
            starts[heads] = inside[heads]
            at = np.searchsorted(np.flatnonzero(starts), own - own[0])
            documents, terms = documents + np.count_nonzero(np.diff(at)), terms + at[-1]
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    ship_package(docs.sparkSession)
    n = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_counted, "documents long, terms long")
    row = n.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return row[0], row[1]


def nearest_greater(key: np.ndarray, places: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each of ``places`` the next one in direction ``step`` with a greater (or ``equal``) key; fences with a greater key bound them."""
    at, active = np.arange(len(key)) + step, places
    while len(active):
        beside = key[at[active]]
        active = active[beside < key[active] if equal else beside <= key[active]]
        # all between a place and its pointer is smaller, so the pointer's pointer is safe too
        at[active] = at[at[active]]
    return at[places]


def treaps(sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right child of each posting (-1: none), by its place; lists of ``sizes`` postings stand one after another."""
    n = len(docs)
    left, right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    if not n:
        return left, right
    lists = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) + lists + 1
    # a fence before, between and after the lists
    key = np.full(n + len(sizes) + 1, np.iinfo(np.int64).max)
    spread = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    key[place] = (impacts.astype(np.int64) << 31) | spread.astype(np.int64)
    inner = np.full(len(key), -1, dtype=np.int64)
    inner[place] = np.arange(n)
    before, after = nearest_greater(key, place, -1, True), nearest_greater(key, place, 1, False)
    own = np.arange(n, dtype=np.int32)
    under_before = (inner[before] >= 0) & ((inner[after] < 0) | (key[before] < key[after]))
    under_after = (inner[after] >= 0) & ~under_before
    right[inner[before[under_before]]] = own[under_before]
    left[inner[after[under_after]]] = own[under_after]
    return left, right


class _Segment:
    """Documents gathered for one segment."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.words, self.ends, self.ids, self.bytes = array("i"), [], [], 0

    def add(self, doc_id: int, data: bytes) -> None:
        known, at = self.vocabulary.__getitem__, 0
        while at < len(data):
            end = min(at + WINDOW, len(data))
            if end < len(data):
                cut = BREAK.search(data, end)
                end = cut.start() if cut else len(data)
            self.words.extend(map(known, TERM.findall(data[at:end].lower())))
            at = end
        self.bytes += len(data)
        if len(self.words) > (self.ends[-1] if self.ends else 0):
            self.ends.append(len(self.words))
            self.ids.append(doc_id)

    def rows(self, number: int, documents: int, terms: int) -> pa.RecordBatch:
        ends = np.array(self.ends, dtype=np.int64)
        lengths = np.diff(ends, prepend=0)
        ids = np.array(self.ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        norms = np.empty(len(ids), dtype=np.int64)
        norms[rank] = [10 + 90 * int(n) * documents // terms for n in lengths]
        words = np.frombuffer(self.words, dtype=np.int32).astype(np.int64)
        keys, tf = np.unique(words * len(ids) + np.repeat(rank, lengths), return_counts=True)
        term, doc = keys // len(ids), keys % len(ids)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * norms[doc])
        sizes = np.bincount(term, minlength=len(self.vocabulary))
        left, right = treaps(sizes, doc, impacts)

        def one(values, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        columns = [
            pa.array([number], pa.int64()),
            one(ids[order], pa.int64()),
            one([t.decode("utf-8", "replace") for t in self.vocabulary], pa.string()),
            *[one(np.asarray(x, dtype=np.int32), pa.int32()) for x in (sizes, doc, impacts, left, right)],
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "ids", "terms", "sizes", "docs", "impacts", "lefts", "rights"])


def _segments(size: int, documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, own = TaskContext.get().partitionId() << 32, 0, _Segment()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_pylist()
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                own.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if own.bytes >= size and own.ids:
                    yield own.rows(part + made, documents, terms)
                    made, own = made + 1, _Segment()
        if own.ids:
            yield own.rows(part + made, documents, terms)

    return run


def build_index(docs: DataFrame, documents: int, terms: int, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """The segments of all documents, in the shared folder."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    made = rows.mapInArrow(_segments(size, documents, terms), SEGMENTS)
    return stash(made, "treaps", "zstd", {"parquet.block.size": str(16 << 20)})


class Search:
    """Top ``k`` of a block of queries; segments are searched one after another."""

    def __init__(self, terms: list[str], lists: list[list[tuple[int, int]]], k: int):
        """``lists``: the numbers in ``terms`` and the weights of each query's terms."""
        width = max((len(x) for x in lists), default=1) or 1
        self.terms, self.k = terms, k
        self.columns = np.full((len(lists), width), len(terms), dtype=np.int64)
        self.weights = np.zeros((len(lists), width), dtype=np.int64)
        for q, own in enumerate(lists):
            for j, (t, w) in enumerate(own):
                self.columns[q, j], self.weights[q, j] = t, w
        self.scores = np.zeros((len(lists), k), dtype=np.int64)
        self.ids = np.full((len(lists), k), np.iinfo(np.int64).max)

    def segment(self, ids, terms, sizes, docs, impacts, lefts, rights) -> None:
        place = dict(zip(terms, range(len(terms)), strict=True))
        ends = np.cumsum(sizes)
        # the last posting stands for none
        docs, impacts = np.append(docs, -1), np.append(impacts, 0).astype(np.int64)
        lefts, rights, none = np.append(lefts, -1), np.append(rights, -1), len(docs) - 1
        lefts[lefts < 0] = rights[rights < 0] = none
        child = np.ones(len(docs), dtype=bool)
        child[lefts] = child[rights] = False
        child[none] = False
        # what is nobody's child is a root: one for each term
        roots = np.flatnonzero(child)
        root_of = np.full(len(sizes), none)
        root_of[np.searchsorted(ends, roots, side="right")] = roots
        start = np.array([root_of[place[t]] if t in place else none for t in self.terms] + [none], dtype=np.int64)
        nodes = start[self.columns]
        q = np.arange(len(nodes))
        stack = [(q, np.zeros(len(q), dtype=np.int64), np.full(len(q), len(ids) - 1), nodes, (self.weights * impacts[nodes]).sum(1))]
        while stack:
            q, lo, hi, nodes, bound = stack.pop()
            if len(q) > SLICE:
                stack.append(tuple(x[:-SLICE] for x in (q, lo, hi, nodes, bound)))
                q, lo, hi, nodes, bound = (x[-SLICE:] for x in (q, lo, hi, nodes, bound))
            keep = self.may_enter(q, bound, ids[lo])
            if not keep.any():
                continue
            q, lo, hi, nodes = q[keep], lo[keep], hi[keep], nodes[keep]
            weights = self.weights[q]
            heavy = (weights * impacts[nodes]).argmax(1)
            pivot = docs[nodes[np.arange(len(q)), heavy]].astype(np.int64)
            found, left, right = self.split(nodes, lo, hi, pivot, docs, lefts, rights, none)
            self.enter(q, (weights * impacts[found]).sum(1), ids[pivot])
            q2, lo2, hi2 = np.concatenate([q, q]), np.concatenate([lo, pivot + 1]), np.concatenate([pivot - 1, hi])
            nodes2 = np.concatenate([left, right])
            bound2 = (self.weights[q2] * impacts[nodes2]).sum(1)
            keep = (lo2 <= hi2) & (bound2 > 0)
            q2, lo2, hi2, nodes2, bound2 = (x[keep] for x in (q2, lo2, hi2, nodes2, bound2))
            keep = self.may_enter(q2, bound2, ids[lo2])
            order = np.argsort(bound2[keep], kind="stable")
            if len(order):
                stack.append(tuple(x[keep][order] for x in (q2, lo2, hi2, nodes2, bound2)))

    def may_enter(self, q: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a document of an interval can be among the best: by the bound, or on a tie by the least id."""
        least = self.scores[q, -1]
        return (bound > least) | ((bound == least) & (least > 0) & (first_id < self.ids[q, -1]))

    @staticmethod
    def split(nodes, lo, hi, pivot, docs, lefts, rights, none):
        """Search ``pivot`` from each node: its posting or none, and the heaviest nodes of the interval to its left and right."""
        shape = nodes.shape
        found, left, right = (np.full(nodes.size, none, dtype=np.int64) for _ in range(3))
        at = nodes.ravel().copy()
        width = shape[1]
        active = np.flatnonzero(at != none)
        row = active // width
        lo, hi, pivot = lo[row], hi[row], pivot[row]
        at = at[active]
        while len(active):
            d = docs[at]
            hit, less = d == pivot, d < pivot
            below, over = less & (d >= lo), ~less & ~hit & (d <= hi)
            spot = active[below]
            left[spot] = np.where(left[spot] == none, at[below], left[spot])
            spot = active[over]
            right[spot] = np.where(right[spot] == none, at[over], right[spot])
            if hit.any():
                own = active[hit]
                found[own] = at[hit]
                for out, children, first, last in ((left, lefts, lo[hit], pivot[hit] - 1), (right, rights, pivot[hit] + 1, hi[hit])):
                    open_ = out[own] == none
                    spot, node, a, b = own[open_], children[at[hit]][open_], first[open_], last[open_]
                    while len(spot):
                        d2 = docs[node]
                        good = (node != none) & (d2 >= a) & (d2 <= b)
                        out[spot[good]] = node[good]
                        more = (node != none) & ~good
                        spot, a, b = spot[more], a[more], b[more]
                        node = np.where(d2[more] < a, rights[node[more]], lefts[node[more]])
            at = np.where(less, rights[at], lefts[at])
            go = ~hit & (at != none)
            active, at, lo, hi, pivot = active[go], at[go], lo[go], hi[go], pivot[go]
        return found.reshape(shape), left.reshape(shape), right.reshape(shape)

    def enter(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[q, -1]
        good = (score > least) | ((score == least) & (score > 0) & (ids < self.ids[q, -1]))
        if not good.any():
            return
        q, score, ids = q[good], score[good], ids[good]
        own = np.unique(q)
        all_q = np.concatenate([np.repeat(own, self.k), q])
        all_s, all_i = np.concatenate([self.scores[own].ravel(), score]), np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        best = rank < self.k
        self.scores[all_q[best], rank[best]], self.ids[all_q[best], rank[best]] = all_s[best], all_i[best]


def _search(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms, lists = asked.value
        search = Search(terms, lists, k)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, names, *arrays = (batch.column(i)[r].values for i in range(1, 8))
                search.segment(ids.to_numpy(), names.to_pylist(), *(x.to_numpy() for x in arrays))
        q, j = np.nonzero(search.scores)
        found = search.ids[q, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(numbers, dtype=np.int64)[q]), pa.array(found, mask=found == NO_ID), pa.array(search.scores[q, j])], names=["q", "doc_id", "score"]
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", ask_col: str = "text", size: int = SEGMENT, block: int = ITEMS) -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` best documents for each row of ``items``."""
    spark = docs.sparkSession
    documents, words = corpus_size(docs, text_col)
    index = build_index(docs, documents, max(words, 1), id_col, text_col, size)
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(ask_col), F.lit(""))), F.lit(PATTERN), F.lit(0)))
    rows = items.select(F.col(item_col).alias("item"), F.col(ask_col).alias("ask"), terms.alias("terms")).where(F.size("terms") > 0)
    queries = stash(rank_within(rows, [], ["item", "ask"], "q").drop("ask"), "queries")
    vocabulary = queries.select(F.explode("terms").alias("term")).distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).select("p.terms", "p.sizes").withColumnRenamed("terms", "term")
    df = held.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("sizes").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = stash(queries.select("q", F.explode("terms").alias("term")).join(df.select("term", weight.alias("w")), "term").where("w > 0"), "weights")
    count, found = queries.count(), []
    for low in range(0, count, block):
        asked: dict[int, list] = {}
        names: dict[str, int] = {}
        for r in weighted.where((F.col("q") >= low) & (F.col("q") < low + block)).collect():
            asked.setdefault(r.q, []).append((names.setdefault(r.term, len(names)), r.w))
        sent = spark.sparkContext.broadcast((list(asked), list(names), list(asked.values())))
        best = index.mapInArrow(_search(sent, k), "q long, doc_id long, score long")
        found.append(stash(best, "found"))
        sent.destroy()
    if not found:
        return queries.select(F.col("item").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.join(queries.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


OP12_SQL = """
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents
), size AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM words WHERE len(ws) > 0),
asked AS (
    SELECT q, item_id, unnest(list_distinct(ws)) AS term FROM (
        SELECT row_number() OVER () AS q, item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
        FROM benchmark)
), vocabulary AS (SELECT DISTINCT term FROM asked),
tf AS MATERIALIZED (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM words)
    WHERE term IN (SELECT term FROM vocabulary) GROUP BY r, doc_id, n, term
), weight AS (
    SELECT term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN size GROUP BY term
), scored AS (
    SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weight USING (term) CROSS JOIN size GROUP BY q, item_id, r, doc_id
), best AS (
    SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM best WHERE rank <= 10
"""


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
