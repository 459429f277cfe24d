"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at most two
bits, the pigeonhole leaves one segment without an error and another with at most one. For that second segment each
fingerprint gives the indices of all Golay codewords within four bits: of two words one bit apart, the codeword within
three bits of the first lies within four of the second, so they share an index. A key is the exact segment together
with one such index; fingerprints that share a key are compared.

Equal fingerprints are one node, so a group of copies costs one row. A key with two fingerprints gives one comparison,
one with up to ``CROWD`` a join. In larger ones each member is put under the 65 fingerprints within one bit of it and
linked to the smallest member found there. Two fingerprints within two bits share such a midpoint and all that share
one are within two bits, so this is exact as well and linear in the members.

Edge cases: a null or empty text has the fingerprint zero and is linked like any other; fewer than three words make one
shingle; repeated rows share a class; a null id never names a class, which is null if it has no other; ties do not
arise (the smallest id names a class); an empty table gives an empty result; other columns are not read
(``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, golay
from .components import connected

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: (shift, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
RADIUS = 4
CROWD = 16


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.encode().lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Word n-grams in order, repeats included; a shorter text is one shingle."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def bit_majority(hashes: np.ndarray) -> int:
    """The signed 64-bit integer whose bits are those that over half the hashes have; 0 for none."""
    h = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    parts = shingles(words_of(text), size) if text else []
    return bit_majority(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, with ``fp``."""
    common.prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp long"])
    target, at = common.arrow_schema(docs.sparkSession, ddl), docs.columns.index(text)
    places = [docs.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, size) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(b.column(i) for i in places), fp], target, strict=True)], schema=target)

    return docs.mapInArrow(run, ddl)


def key_arrays(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of all fuzzy keys of distinct fingerprints."""
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    codes = [golay.nearby(p, RADIUS) for p in parts]
    keys, owners = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                place, code = codes[j]
                keys.append(((i * 3 + j) << 34) | (parts[i][place] << 12) | code)
                owners.append(fp[place])
    return np.concatenate(keys), np.concatenate(owners)


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(key, fp) rows of distinct fingerprints."""
    target = common.arrow_schema(prints.sparkSession, "key long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps = key_arrays(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield common.record_batch({"key": keys, "fp": fps}, target)

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within two bits that connect all such fingerprints."""
    keys = fuzzy_keys(prints)
    shared = common.cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = shared.filter("n = 2").select("a", "b")
    members = common.cut(keys.join(shared.filter("n > 2").select("key", "n"), "key"))
    few = members.filter(F.col("n") <= CROWD)
    joined = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b")
    many = members.filter(F.col("n") > CROWD).select("fp").distinct()
    near = F.concat(F.array("fp"), *[F.array(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)))) for i in range(64)])
    # At most 65 distinct fingerprints lie within one bit of another, so these lists are short.
    around = many.select(F.explode(near).alias("mid"), "fp").groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(joined).filter(close).union(stars).distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, fp, component_id) of every row; a class is named by its smallest key."""
    marked = common.cut(fingerprints(docs.select(key, *keep, text), text, size))
    prints = common.cut(marked.groupBy("fp").agg(F.min(key).alias("doc")))
    linked = connected(links(prints))
    own = linked.join(prints, linked["node"] == prints["fp"]).select("root", "fp", "doc")
    named = own.join(own.groupBy("root").agg(F.min("doc").alias("least")), "root").select("fp", "least")
    # Written first, so that the join can split a fingerprint that many rows have.
    names = common.cut(prints.join(named, "fp", "left").select("fp", F.coalesce("least", "doc").alias("component_id")))
    return marked.join(names, "fp").select(key, *keep, "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """One row of each class, the one with the smallest key, with all columns; of rows with that key the one whose text has the smallest hash. Rows without a key stay, since no class can name them."""
    rows = classes(with_hash(docs.filter(F.col(key).isNotNull()).select(key, text), text), text, key, size, (TEXT_HASH,))
    first = rows.groupBy("component_id").agg(F.min(F.struct(key, TEXT_HASH)).alias("x"))
    return keep_named(docs, common.cut(first.select("x.*")), key, text)


#: Column by which rows of one id are told apart.
TEXT_HASH = "__text_hash"


def with_hash(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn(TEXT_HASH, F.xxhash64(text))


def keep_named(docs: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each (key, hash of the text) in ``named``, and the rows without a key.

    Which of several equal rows stays makes no difference to key and text. Equal rows go inside each task before rows
    are dealt, so a row that is repeated very often does not meet in one task, nor do different texts under one key.
    """
    rows = with_hash(docs.filter(F.col(key).isNotNull()), text)
    at = [rows.columns.index(c) for c in (key, TEXT_HASH)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            fresh = [not (k in seen or seen.add(k)) for k in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield b.filter(pa.array(fresh, pa.bool_()))

    # Texts are never sorted; equal rows of different tasks meet in one partition, where the first one stays.
    dealt = rows.mapInArrow(first, rows.schema).repartition(key, TEXT_HASH).join(named.hint("shuffle_hash"), [key, TEXT_HASH], "left_semi").select(rows.columns)
    return dealt.mapInArrow(first, rows.schema).select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def hexadecimal(fp: str = "fp") -> object:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLES: dict[str, str] = {}
