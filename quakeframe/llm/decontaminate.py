"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles. A document leaks an item if it contains at least ``THRESHOLD`` of
the item's distinct shingles. Documents are far longer than items, so their Jaccard similarity is tiny and banded
signatures would miss leaks. The search keeps to the short side instead: items are partitioned by their number of
shingles, in classes of powers of two, and each class has parameters of its own: the MinHash sketch of an item is its
``lacking + rows`` shingles with the least hashes, where a leaking document may lack ``lacking`` shingles of the item,
so that it holds at least ``rows`` of the sketch, a number that the class fixes. Documents with fewer shingles than the
least item of a class needs skip the class. So no leak is missed, and every candidate is verified by the exact number of
shared shingles.

Items are the query set and taken to be small: they are sent out in blocks of about ``BLOCK_SHINGLES`` shingles, some 50 MB
in a worker, each of which is held against all documents in one pass. What a task holds is bounded at any size of the
benchmark; the passes grow with it, one for about 10,000 items.

Edge cases: an item of fewer than five words is one shingle of all its words and leaks where they stand consecutively;
an item without words (null or empty) never leaks; equal item rows count once, equal ids with other texts each count;
a null or empty document leaks nothing; repeated documents each give their rows; empty tables give empty results; other
columns are not read (``clean`` keeps them); if both keys have one name, the item's gets the prefix ``item_``.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash_dedup import shingles, words_of

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_SHINGLES = 500_000
#: Sketch shingles that a document must hold, by the class of an item: items of 2 ** c to 2 ** (c + 1) - 1 shingles are of class c.
ROWS = (1, 1, 1, 2, 3, 4, 6, 8)
_FILTER_BITS = 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int) -> int:
    """Shared shingles that make a leak of an item with n of them."""
    return math.ceil(n * THRESHOLD - 1e-9)


def size_class(n: int) -> int:
    """The partition of an item with n shingles."""
    return min(n.bit_length(), len(ROWS)) - 1


def sketch_size(n: int) -> int:
    """Shingles in the sketch of an item with n of them."""
    return n - needed(n) + ROWS[size_class(n)]


@dataclass
class Item:
    """A benchmark item: its id, distinct shingles, and the sketch among them."""

    item_id: Any
    width: int
    grams: frozenset[bytes]
    sketch: list[bytes]


def item(item_id: Any, text: str | None) -> Item | None:
    from xxhash import xxh64_intdigest

    words = words_of(text or "")
    if not words:
        return None
    grams = frozenset(shingles(words, SHINGLE))
    order = sorted(grams, key=lambda g: (xxh64_intdigest(g, 1), g))
    return Item(item_id, min(SHINGLE, len(words)), grams, order[: sketch_size(len(grams))])


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all n-grams from the hashes of the words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, width):
        h *= _FACTOR
        h ^= h >> np.uint64(29)
        h += words[i : i + n]
    return h * _FACTOR


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, good within one Python process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


@dataclass
class Part:
    """The sketches of one shingle width and one class of sizes."""

    #: Shingles a document needs for the least of the items, and sketch shingles it must hold.
    least: int
    rows: int
    #: Sorted sketch hashes and the items they belong to.
    hashes: np.ndarray
    owners: np.ndarray


@dataclass
class Index:
    """The partitions of a block of items, by shingle width, each width with a bit filter over all its sketches."""

    items: list[Item]
    parts: dict[int, list[Part]] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        groups = defaultdict(list)
        for i, x in enumerate(self.items):
            groups[x.width, size_class(len(x.grams))].append(i)
        for (width, c), own in sorted(groups.items()):
            pairs = [(int(gram_hashes(word_hashes(g.split(b" ")), width)[0]), i) for i in own for g in self.items[i].sketch]
            hashes, owners = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])
            order = np.argsort(hashes, kind="stable")
            self.parts.setdefault(width, []).append(Part(min(needed(len(self.items[i].grams)) for i in own), ROWS[c], hashes[order], owners[order]))
            bits = self.filters.setdefault(width, np.zeros(1 << _FILTER_BITS, bool))
            bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, words: list[bytes]) -> set[int]:
        """Items of whose sketch a document holds enough and for which it is long enough."""
        found: set[int] = set()
        if not words:
            return found
        w = word_hashes(words)
        for width, parts in self.parts.items():
            h = gram_hashes(w, width)
            n = len(h)
            h = h[self.filters[width][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
            if not len(h):
                continue
            h = np.unique(h)
            for part in parts:
                if n < part.least:
                    continue
                lo, hi = np.searchsorted(part.hashes, h, "left"), np.searchsorted(part.hashes, h, "right")
                hits = [part.owners[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]
                if len(hits) >= part.rows:
                    owners, times = np.unique(np.concatenate(hits), return_counts=True)
                    found.update(i for i in owners[times >= part.rows].tolist() if needed(len(self.items[i].grams)) <= n)
        return found

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item position, shared shingles) of every leak, verified exactly."""
        words = words_of(text) if text else []
        out: list[tuple[int, int]] = []
        sets: dict[int, set[bytes]] = {}
        for i in sorted(self.candidates(words)):
            x = self.items[i]
            if x.width not in sets:
                sets[x.width] = set(shingles(words, x.width))
            shared = len(x.grams & sets[x.width])
            if shared >= needed(len(x.grams)):
                out.append((i, shared))
        return out


def blocks(items: DataFrame, text: str = "text", key: str = "item_id", size: int = BLOCK_SHINGLES) -> Iterator[list[Item]]:
    """The benchmark in blocks of about ``size`` shingles, dealt by the hash of an item's text."""
    rows = items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for i in range(n):
        found = [x for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect() if (x := item(r["item_id"], r["text"]))]
        if found:
            yield sorted(found, key=lambda x: (x.item_id is None, str(x.item_id), min(x.grams)))


_indexes: dict[str, Index] = {}


def _index(token: str, shared: object) -> Index:
    """The index of a broadcast block, built once per Python worker since word hashes are the worker's own."""
    if token not in _indexes:
        if len(_indexes) > 3:
            _indexes.clear()
        _indexes[token] = Index(shared.value)
    return _indexes[token]


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item key, n_shared, n_item, containment): one row for every leak."""
    spark = docs.sparkSession
    common.prepare(spark)
    named = f"item_{item_key}" if item_key == key else item_key
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{named}` {items.schema[item_key].dataType.simpleString()}, n_shared long, n_item long, containment double"
    target = common.arrow_schema(spark, ddl)
    found = spark.createDataFrame([], ddl)
    for block in blocks(items, item_text, item_key):
        shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared, token: str = token) -> Iterator[pa.RecordBatch]:
            index = _index(token, shared)
            for b in batches:
                hits = [(d, *h) for d, t in enumerate(b.column(1).to_pylist()) for h in index.leaks(t)]
                sizes = [len(index.items[i].grams) for _, i, _ in hits]
                yield common.record_batch({key: b.column(0).take(pa.array([d for d, *_ in hits], pa.int64())), named: [index.items[i].item_id for _, i, _ in hits], "n_shared": [s for *_, s in hits], "n_item": sizes, "containment": [s / n for (*_, s), n in zip(hits, sizes, strict=True)]}, target)

        found = found.unionByName(docs.select(key, text).mapInArrow(run, ddl))
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    spark = docs.sparkSession
    common.prepare(spark)
    at = docs.columns.index(text)
    for block in blocks(items, item_text, item_key):
        shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared, token: str = token) -> Iterator[pa.RecordBatch]:
            index = _index(token, shared)
            for b in batches:
                yield b.filter(pa.array([not index.leaks(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_GRAMS = "list_transform(range(1, greatest(2, len(w) - {n} + 2)), lambda i: array_to_string(w[i : i + {n} - 1], ' '))"
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT row_number() OVER () AS b, item_id, w, least({SHINGLE}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(w) > 0),
g AS (SELECT b, item_id, n, unnest(list_distinct({_GRAMS.format(n="n")})) AS s FROM i),
z AS (SELECT b, count(*) AS n_item FROM g GROUP BY b),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
m AS (SELECT r, doc_id, n, unnest(list_distinct({_GRAMS.format(n="n")})) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
hits AS (SELECT r, doc_id, b, item_id, count(*) AS n_shared FROM m JOIN g USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, n_shared / n_item AS containment FROM hits JOIN z USING (b) WHERE n_shared >= ceil(n_item * {THRESHOLD} - 1e-9)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": ORACLE}
