"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table with the token lengths of frequent pre-tokens, packed into one string and two arrays, from
which each Python worker builds its hash table; tier two is a cache in the worker that encodes the rest once with the
tokenizer library. No pre-token is shuffled. The table is counted from ``SAMPLE_ROWS`` whole rows in one task; the token
counts of texts do not depend on what it holds, it only saves work.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pretokens

#: Entries of the broadcast table, the rows it is counted from, and the distinct pre-tokens counted at a time.
TABLE_SIZE = 1 << 16
SAMPLE_ROWS = 1024
COUNTED = 1 << 19
#: Bytes that a worker's cache may hold before it falls back to the broadcast table, bytes of an entry besides its
#: characters, and the longest pre-token that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHE_PART = 1 << 25, 120, 256
TOKEN_LIMIT = 4096



def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(4)
def processor(model_path: str) -> Any:
    """The library's encoder, loaded once per Python process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(4)
def safe_processor(model_path: str) -> Any:
    """The encoder of a model whose pieces never cross the borders of pre-tokens."""
    sp = processor(model_path)
    if not pretokens.safe_model(sp.id_to_piece(i) for i in range(sp.get_piece_size())):
        raise ValueError(f"{model_path} has pieces that cross spaces or line feeds")
    return sp


def part_lengths(model_path: str, parts: list[str]) -> list[int]:
    """Token lengths of pre-tokens. The line feed put in front keeps the library from adding a second marker; it and the dummy prefix are two tokens."""
    return [len(x) - 2 for x in safe_processor(model_path).encode(["\n" + p for p in parts], num_threads=1)]


def frequent_parts(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens in a hash-chosen sample of rows, at most ``size``. The rows are counted where they are, whatever their lengths."""
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key")).filter(F.length("text") > 0)
    target = common.arrow_schema(docs.sparkSession, "part string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(p for p in pretokens.split(t) if len(p) <= CACHE_PART)
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(size)))
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
        yield common.record_batch({"part": [p for p, _ in top], "n": [n for _, n in top]}, target)

    found = common.row_count_sample(rows, F.col("key"), sample_rows).select("text").mapInArrow(run, "part string, n long")
    parts = [r["part"] for r in found.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(size).collect()]
    return dict(zip(parts, part_lengths(model_path, parts), strict=True)) if parts else {}


def packed(table: dict[str, int]) -> tuple[str, np.ndarray, np.ndarray]:
    """A table as its pre-tokens in one string, their sizes and their token lengths."""
    return "".join(table), np.fromiter(map(len, table), np.uint16, len(table)), np.fromiter(table.values(), np.uint16, len(table))


class Lengths:
    """A worker's token lengths by pre-token: the broadcast table and what was encoded since."""

    def __init__(self, model_path: str, table: tuple[str, np.ndarray, np.ndarray]) -> None:
        self.path, self.table = model_path, table
        self.reset()

    def reset(self) -> None:
        joined, sizes, lengths = self.table
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        self.known = {joined[a:b]: n for a, b, n in zip([0, *ends], ends, lengths.tolist(), strict=False)}
        self.held = 0

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        if self.held > CACHE_BYTES:
            self.reset()
        parts = [pretokens.split(t) if t else [] for t in texts]
        missing: set[str] = set()
        for p in parts:
            missing.update(p)
        missing.difference_update(self.known)
        new = list(missing)
        self.known.update(zip(new, part_lengths(self.path, new), strict=True))
        out = [sum(map(self.known.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > CACHE_PART:
                del self.known[p]
            else:
                self.held += ENTRY_BYTES + len(p)
        return out


_lengths: dict[str, Lengths] = {}


def _worker(token: str, model_path: str, shared: Broadcast) -> Lengths:
    """The lengths of a broadcast table, one for each Python worker."""
    if token not in _lengths:
        _lengths.clear()
        _lengths[token] = Lengths(model_path, shared.value)
    return _lengths[token]


def count_tokens(docs: DataFrame, model_path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = TOKEN_LIMIT, table: dict[str, int] | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    model_path = model_path or default_model()
    spark = docs.sparkSession
    common.prepare(spark)
    shared, token = spark.sparkContext.broadcast(packed(frequent_parts(docs, model_path, text, key) if table is None else table)), uuid.uuid4().hex
    kind = docs.schema[key].dataType.simpleString()
    target = common.arrow_schema(spark, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = _worker(token, model_path, shared).count(texts)
            yield common.record_batch({key: b.column(0), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
