"""Ranked lexical search by the Best Position Algorithm.

The documents of a task, taken in blocks, are an index of their own: for each term of the items a list of the block's
documents by falling impact. All lists of an item are read in step. Each document met is scored in full by direct
accesses to the other lists, and each access marks a position as seen. The best position of a list ends its unbroken
stretch of seen positions, often far below the last one read; a document not met yet stands below it in every list, so
its score is at most the sum of the impacts at the first positions not seen. Reading stops once this sum is strictly
below the score of the k-th best document (an equal sum could hide an equal score with a smaller id). Documents that a
task has found in earlier blocks count for that score too.

The k best of the whole table are among the k best of the tasks, so Spark merges only those. Numbers of the whole table
(documents, terms, documents of a term) come from one pass over the texts, which leaves for each document its number of
terms and the items' terms in it; the second pass reads those. Items go out in blocks of ``ITEM_BYTES``, a pass for each.

Edge cases: a null or empty text, or one without terms, is no document; an item without terms has no rows; rows of
``items`` that are equal in id and text are one item, an id with two texts has a ranking for each; repeated rows of
documents are ranked one by one; equal scores go by id, null ids last; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
#: Bytes of item terms that go out at a time, places of a block's table of positions, and positions that are read first.
ITEM_BYTES, PLACES, FIRST_READ = 1 << 22, 1 << 23, 32
#: Groups that the tasks' results are merged in before those of an item meet.
MERGES = 64
#: Each byte of a term, A-Z in lower case; other ASCII characters part terms.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.encode().translate(_BYTES).split() if text else []


def with_terms(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, terms, bytes): distinct rows of items and their terms."""
    ddl = f"`{key}` {rows.schema[key].dataType.simpleString()}, terms array<binary>, bytes long"
    target = common.arrow_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [terms_of(t) for t in b.column(1).to_pylist()]
            yield common.record_batch({key: b.column(0), "terms": terms, "bytes": [sum(map(len, t)) + 16 * len(t) for t in terms]}, target)

    return rows.select(key, text).distinct().mapInArrow(run, ddl).filter("bytes > 0")


def item_blocks(items: DataFrame, key: str, bound: int) -> Iterator[list[tuple[Any, Counter[bytes]]]]:
    """Items in blocks of at most ``bound`` bytes of terms; a larger item is a block of its own."""
    items = common.cut(items.withColumn("h", F.xxhash64(key, "terms")))
    total = items.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-2 * total // bound)) if total > bound else 1
    part = lambda n: F.pmod("h", F.lit(n))
    while items.groupBy(part(blocks)).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > bound) & (F.col("n") > 1)).limit(1).count():
        blocks *= 2
    for i in range(blocks if total else 0):
        found = [(r[0], Counter(map(bytes, r[1]))) for r in items.filter(part(blocks) == i).orderBy("h").select(key, "terms").collect()]
        if found:
            yield found


def counted(docs: DataFrame, words: dict[bytes, int], text: str, key: str) -> DataFrame:
    """(key, n, ids, tfs) of each document with a term: its number of terms, and which of ``words`` it holds how often."""
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, ids array<int>, tfs array<long>"
    target, shared = common.arrow_schema(docs.sparkSession, ddl), docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            terms = [terms_of(t) for t in b.column(1).to_pylist()]
            held = [Counter(map(number, t)) for t in terms]
            for h in held:
                h.pop(None, None)
            out = {key: b.column(0), "n": list(map(len, terms)), "ids": [list(h) for h in held], "tfs": [list(h.values()) for h in held]}
            yield common.record_batch(out, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl).filter("n > 0")


@dataclass
class Query:
    """An item with its term numbers and how often it has each."""

    item: int
    terms: np.ndarray
    times: np.ndarray


class Lists:
    """Impact lists of one block of documents: each term's documents by falling impact, and where a document stands in each."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        used = impact > 0
        doc, term, impact = doc[used], term[used], impact[used]
        order = np.lexsort((doc, -impact, term))
        self.doc, term, self.impact = doc[order], term[order], impact[order]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        self.place = np.full((terms, docs), -1, np.int32)
        self.place[term, self.doc] = np.arange(len(term)) - self.start[term]
        self.docs = docs

    def best(self, q: Query, top: Top) -> int:
        """Offer to ``top`` every document of the block that can be among the best; returns how many were scored."""
        begin, size = self.start[q.terms], self.start[q.terms + 1] - self.start[q.terms]
        there = size > 0
        terms, times, begin, size = q.terms[there], q.times[there], begin[there], size[there]
        known, seen = np.zeros(self.docs, bool), np.zeros(len(self.doc), bool)
        free = np.zeros(len(terms), np.int64)  # the first position of each list that is not seen
        read, step, scored = 0, FIRST_READ, 0
        while True:
            open_ = free < size
            most = int((times[open_] * self.impact[begin[open_] + free[open_]]).sum())
            if most < top.least:
                return scored
            at = begin[:, None] + np.arange(read, read + step)
            met = np.zeros(self.docs, bool)
            met[self.doc[at[at < (begin + size)[:, None]]]] = True
            new = np.nonzero(met & ~known)[0]
            known[new] = True
            place = self.place[np.ix_(terms, new)]
            hit, flat = place >= 0, begin[:, None] + place
            seen[flat[hit]] = True
            top.offer(new, (times[:, None] * np.where(hit, self.impact[flat], 0)).sum(axis=0))
            scored += len(new)
            for j in np.nonzero(open_)[0].tolist():
                rest = seen[begin[j] + free[j] : begin[j] + size[j]]
                k = int(rest.argmin())
                free[j] += len(rest) if rest[k] else k
            read, step = read + step, 2 * step


class Top:
    """The best documents of an item that a task has found: score falling, then id rising, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.names, self.least = k, [], [], 1

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        docs, scores = docs[good], scores[good]
        if len(scores) > self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            docs, scores = docs[good], scores[good]
        new = [(-s, self.names[d] is None, self.names[d] if self.names[d] is not None else 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        self.rows = heapq.nsmallest(self.k, [*self.rows, *new])
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) of postings, in 64-bit integers; ``n`` is the number of terms of each posting's document."""
    sizes, at = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * x * docs // terms for x in sizes.tolist()], np.int64)[at]
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_bytes: int = ITEM_BYTES, places: int = PLACES) -> DataFrame:
    """(item_key, rank, key, score): the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    common.prepare(spark)
    name, item_name = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    found = None
    for block in item_blocks(with_terms(items, text, item_key), item_key, item_bytes):
        best = common.cut(_search_block(docs, block, k, text, key, name, places))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, `{item_key}` {item_name}")
        # As many names as the block has items.
        own = best.join(F.broadcast(names), "item").select(item_key, "rank", F.col("doc").alias(key), "score")
        found = own if found is None else found.union(own)
    return found if found is not None else spark.createDataFrame([], f"`{item_key}` {item_name}, rank int, `{key}` {name}, score long")


def _search_block(docs: DataFrame, block: list[tuple[Any, Counter[bytes]]], k: int, text: str, key: str, name: str, places: int) -> DataFrame:
    """(item, rank, doc, score) of a block of items, which are numbered."""
    sc = docs.sparkSession.sparkContext
    words = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    rows = common.cut(counted(docs, words, text, key))
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    # At most as many rows as the block has terms.
    held = dict(rows.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*")).collect())
    weight = np.zeros(len(words), np.int64)
    for t, df in held.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    queries = [Query(i, np.array([words[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for i, (_, own) in enumerate(block)]
    shared, width = sc.broadcast((weight, queries)), max(1, places // len(words))
    ddl = f"item int, doc {name}, score long"
    target = common.arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = shared.value
        tops = [Top(k) for _ in queries]
        for names, n, sizes, ids, tfs in _blocks(batches, width):
            doc = np.repeat(np.arange(len(names)), sizes)
            lists = Lists(len(names), doc, ids, impacts(n[doc], tfs, weight[ids], n_docs, n_terms), len(weight))
            for q, top in zip(queries, tops, strict=True):
                top.names = names
                lists.best(q, top)
        out = [(q.item, None if null else d, -s) for q, top in zip(queries, tops, strict=True) for s, null, d in top.rows]
        for i in range(0, len(out), 4096):
            yield common.record_batch(dict(zip(target.names, map(list, zip(*out[i : i + 4096], strict=True)), strict=True)), target)

    made = rows.mapInArrow(run, ddl).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(MERGES)))
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for by in (["item", "part"], ["item"]):
        made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return made.select("item", "rank", "doc", "score")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of terms, numbers of postings, terms, frequencies) of at most ``width`` documents at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def together() -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [t.column(i).combine_chunks() for i in (2, 3)]
        ids, tfs = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        return t.column(0).to_pylist(), t.column(1).to_numpy(), lists[0].value_lengths().to_numpy(zero_copy_only=False), ids, tfs

    for b in batches:
        while b.num_rows:
            part = b.slice(0, width - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == width:
                yield together()
                held, rows = [], 0
    if rows:
        yield together()


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {
    "op12_ranked_search": f"""
WITH t AS (SELECT doc_id, {_SQL_TERMS} FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SQL_TERMS} FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS impact FROM p JOIN w USING (term) JOIN n USING (doc_id), g),
s AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
""",
}
