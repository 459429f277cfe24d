"""Product-quantised vector codes, with nearest entries found in a GNAT.

Vectors of integers are cut into parts, and each part has a codebook of entries that four rounds of k-means settle, all in
integers. The entries of a codebook are put into a geometric near-neighbour access tree: a node has a few split points,
the other entries hang below the nearest of them, and for each pair of split point and child the node stores the
smallest and largest distance to the child's entries. A search compares a query with the split points and leaves out
each child whose range the query's ball cannot reach. It leaves out only what is strictly out of reach, after rounding
distances against itself, and compares squared distances as integers, so that ties go to the lower index.

Each round is one pass over the vectors: a task adds up the parts of each entry, and only these sums, at most one row for
each entry and task, are shuffled. The driver sees the entries alone (256 a part).

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; the first entries are the
vectors with the smallest keys, null keys last, equal keys by their vectors; with fewer vectors than entries a codebook
has as many entries as there are vectors; equal entries stay, the first of them is used; repeated rows are coded one by
one; null labels are one group; an empty table gives an empty result; other columns are not read. Vectors of different
lengths, of a length that the parts do not divide, or of components beyond 2^26 are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, rows that are searched at a time, and the largest component.
DEGREE, ROWS, LIMIT = 8, 4096, 1 << 26
#: By how much distances are rounded against the search, relatively.
SLACK = 1e-12
#: Labels whose sums are broadcast; more of them are joined by a shuffle.
LABELS = 100_000


@dataclass
class Node:
    """Split points (indexes of entries, rising), ranges of distances from each of them to each child, and the children."""

    splits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs of integer vectors."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)), 1)
    if 4 * top * top * a.shape[1] < 1 << 52:  # products and sums are exact in floating point
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j, e in enumerate(b):
        d = a - e
        out[:, j] = (d * d).sum(axis=1)
    return out


class Gnat:
    """A tree over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE) -> None:
        self.entries, self.degree, self.compared = entries, max(2, degree), 0
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> Node:
        if len(own) <= self.degree:
            return Node(own)
        # Split points far from each other: each is the entry farthest from those before.
        picked = [0]
        gap = squared(self.entries[own], self.entries[own[:1]])[:, 0]
        while len(picked) < self.degree:
            gap[picked] = -1
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(self.entries[own], self.entries[own[picked[-1:]]])[:, 0])
        splits = np.sort(own[picked])
        rest = np.setdiff1d(own, splits)
        apart = squared(self.entries[rest], self.entries[splits])
        near, far = apart.argmin(axis=1), np.sqrt(apart)
        node = Node(splits, np.zeros((self.degree, self.degree)), np.zeros((self.degree, self.degree)))
        for c in range(self.degree):
            mine = near == c
            if mine.any():
                node.low[:, c], node.high[:, c] = far[mine].min(axis=0) * (1 - SLACK), far[mine].max(axis=0) * (1 + SLACK)
                node.children.append(self._build(rest[mine]))
            else:
                node.children.append(None)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each query, the lower index on ties."""
        at = np.full(len(queries), len(self.entries))
        found = np.full(len(queries), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), at, found)
        return at, found

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
        d = squared(queries[rows], self.entries[node.splits])
        self.compared += d.size
        near = d.argmin(axis=1)
        least, index = d[np.arange(len(rows)), near], node.splits[near]
        better = (least < found[rows]) | ((least == found[rows]) & (index < at[rows]))
        at[rows[better]], found[rows[better]] = index[better], least[better]
        if not node.children:
            return
        away = np.sqrt(d)
        for own_first in (True, False):  # a query's own child comes first and shrinks its ball
            for c, child in enumerate(node.children):
                if child is None:
                    continue
                pick = np.nonzero((near == c) == own_first)[0]
                ball = np.sqrt(found[rows[pick]])[:, None] * (1 + SLACK)
                out = (away[pick] * (1 - SLACK) - ball > node.high[:, c]) | (away[pick] * (1 + SLACK) + ball < node.low[:, c])
                pick = pick[~out.any(axis=1)]
                if len(pick):
                    self._visit(child, queries, rows[pick], at, found)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and finite in all components."""
    return vectors.filter(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))


def integers(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """(rows, dim) integers floor(scale * x)."""
    if not (column.value_lengths().to_numpy(zero_copy_only=False) == dim).all() or dim % parts:
        raise ValueError(f"all vectors must have the same length, a multiple of {parts}")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if (np.abs(x) > LIMIT).any():
        raise ValueError(f"components beyond {LIMIT} after scaling")
    return x.astype(np.int64).reshape(-1, dim)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to at least so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def first_books(vectors: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width) integers: the parts of the vectors with the smallest keys."""
    rows = vectors.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    x = integers(pa.array([r[1] for r in rows]), len(rows[0][1]), parts, scale)
    return x.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def refine(vectors: DataFrame, vector: str, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of the mean of the parts nearest to it."""
    parts, size, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    ddl = "part int, entry int, n long, total array<long>"
    target = common.arrow_schema(vectors.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in shared.value]
        n, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for t in _tables(batches, ROWS):
            x = integers(t.column(0).combine_chunks(), parts * width, parts, scale).reshape(-1, parts, width)
            for p, tree in enumerate(trees):
                at, _ = tree.nearest(x[:, p])
                n[p] += np.bincount(at, minlength=size)
                np.add.at(total[p], at, x[:, p])
        part, entry = np.nonzero(n)
        yield common.record_batch({"part": part, "entry": entry, "n": n[part, entry], "total": total[part, entry].tolist()}, target)

    sums = vectors.select(vector).mapInArrow(run, ddl).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)])
    out = books.copy()
    for r in sums.collect():  # at most one row an entry
        out[r[0], r[1]] = np.array([t // r[2] for t in r[3:]], np.int64)
    return out


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The codebooks of ``vectors``, which are read once for the first entries and once a round."""
    common.prepare(vectors.sparkSession)
    rows = usable(vectors, vector)
    books = first_books(rows, vector, key, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = refine(rows, vector, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", key: str = "vec_id", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(key, label, code, error) of every usable row: the indexes of its entries as hex digits, and its squared distance to them."""
    common.prepare(vectors.sparkSession)
    parts, size, width = books.shape
    digits = max(2, len(f"{max(size - 1, 0):x}"))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    ddl = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error long"
    target = common.arrow_schema(vectors.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in shared.value]
        for t in _tables(batches, ROWS):
            x = integers(t.column(2).combine_chunks(), parts * width, parts, scale).reshape(-1, parts, width)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            code = ["".join(f"{i:0{digits}x}" for i in own) for own in zip(*(at.tolist() for at, _ in found), strict=True)]
            columns = {key: t.column(0).combine_chunks(), label: t.column(1).combine_chunks(), "code": code, "error": sum(e for _, e in found)}
            yield common.record_batch(columns, target)

    return usable(vectors, vector).select(key, label, vector).mapInArrow(run, ddl)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals with commas between them, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row."""
    books = train(vectors, vector, key)
    rows = common.cut(encode(vectors, books, vector, key, label))
    sums = common.cut(rows.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, rows[label].eqNullSafe(sums["__label"])).select(key, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES: dict[str, str] = {}
