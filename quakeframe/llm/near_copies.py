"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline.

Candidates come from two sides. SimHash fingerprints over five-word shingles with their Golay-code keys
(``simhash_dedup.links``) give the texts whose fingerprints lie within two bits, which most changed copies do not: at
similarity 0.8 two fingerprints differ in about ten of 64 bits. So each set of shingles has ``BANDS`` MinHash keys of
``ROWS`` minima as well; two sets of similarity 0.8 share none of them with probability (1 - 0.8 ** ROWS) ** BANDS, 5 in a
million, and more similar ones less often.

Each candidate is verified on its whole sets. In every key all members are first compared with the one that shares most
keys with others, which links the copies of one text to it. Keys whose members are then linked are done. In those with
up to ``CROWD`` members all that no link connects are compared with each other. In larger ones, where that would be a
square, ``TURNS`` rounds compare all members with one more of them, drawn anew for every key. What is in several classes then
goes through an exact join: of two sets of similarity 0.8, each has one of the other's shingles among its rarest fifth
(prefix filter; any order of the shingles gives all pairs, the rarest first gives few others). A shingle that many sets have
there is dealt in blocks of ``BLOCK`` members, and pairs whose sets must differ in more shingles than similarity 0.8 allows,
by the parities of ``BITS`` cells, are not looked at.

Edge cases: texts with equal sets are one node; fewer than five words make one shingle; null and empty texts are one
class; rows without a key stay and link nothing; the smallest key of a class stays, once; an empty table gives an empty
result; all columns are kept. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected
from .simhash_dedup import SEED, TEXT_HASH, bit_majority, keep_named, links, shingles, with_hash, words_of

SHINGLE = 5
BANDS, ROWS = 40, 6
CROWD, TURNS = 32, 3
BLOCK, BITS = 256, 512
#: Cells in which shingles are counted for their order.
CELLS = 1 << 20
#: Shingles that go through the hash functions together.
CHUNK = 4096
_FACTORS, _SHIFTS = (np.random.default_rng(s).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(s) for s in (1, 0))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    parts = shingles(words_of(text), SHINGLE) if text else []
    return np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))


def name_of(found: np.ndarray) -> int:
    """The 64-bit name of a sorted set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """MinHash keys of a set of hashes, one for each band; the empty set has keys of its own."""
    low = (found ^ found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), CHUNK):
        np.minimum(least, (low[i : i + CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, hash of the text, name, fp, n, bands) of each row: name and size of its set, its fingerprint and its MinHash keys."""
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, {TEXT_HASH} long, name long, fp long, n int, bands array<long>"
    target = common.arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t) for t in b.column(1).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            yield common.record_batch({key: b.column(0), TEXT_HASH: b.column(2), "name": [name_of(s) for s in sets], "fp": [bit_majority(h) for h in hashes], "n": [len(s) for s in sets], "bands": [band_keys(s) for s in sets]}, target)

    return with_hash(docs.select(key, text), text).mapInArrow(run, ddl)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of names whose sets have similarity 0.8 or more. ``held`` has the texts by name."""
    both = pairs.join(held.select(F.col("name").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("name").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    target = common.arrow_schema(pairs.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def of(text: str | None) -> tuple[int, np.ndarray]:
            found = np.unique(shingle_hashes(text))
            return name_of(found), found

        for batch in batches:
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (n, s), (m, t) = of(x), of(y)
                # A key that stands for several texts brings the others along; their names differ.
                good.append((n, m) == (a, b) and 9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()).filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], schema=target)

    return both.mapInArrow(run, "a long, b long").distinct()


def _sizes_fit(n: str, m: str) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _stars(members: DataFrame, order: Column) -> DataFrame:
    """Pairs of each member with the one of its key that is first in the order."""
    middle = members.groupBy("key").agg(F.min(F.struct(order.alias("h"), "name", "n", "root")).alias("m"))
    return _ordered(members.join(middle, "key").filter((F.col("root") != F.col("m.root")) & _sizes_fit("n", "m.n")), "name", "m.name")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of members that no link connects."""
    one, two = (members.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("name", "n", "root")]) for side in "ab")
    return _ordered(one.join(two, "key").filter((F.col("name_a") < F.col("name_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit("n_a", "n_b")), "name_a", "name_b")


def _prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that a set of similarity 0.8 or more has one of them."""
    order = np.lexsort((found, counts[found % np.uint64(CELLS)]))
    return found[order[: len(found) - (4 * len(found) + 4) // 5 + 1]]


def _parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of ``BITS`` cells. Two sets differ in as many shingles as cells at least."""
    cells = (found >> np.uint64(32)) % np.uint64(BITS)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=BITS) & 1).view(np.int64)


def _counted(asked: DataFrame) -> np.ndarray:
    """Number of sets by cell of their shingles. At most one row a cell reaches the driver."""
    target = common.arrow_schema(asked.sparkSession, "cell long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                cells, n = np.unique(np.unique(shingle_hashes(t)) % np.uint64(CELLS), return_counts=True)
                total[cells.astype(np.int64)] += n
        at = np.nonzero(total)[0]
        yield common.record_batch({"cell": at, "n": total[at]}, target)

    found = np.zeros(CELLS, np.int64)
    for b in asked.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        found[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return np.minimum(found, np.iinfo(np.int32).max).astype(np.int32)


def _exact_pairs(members: DataFrame, held: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Pairs of members that no link connects, with all those of similarity 0.8 or more, whatever keys they have."""
    spark = members.sparkSession
    asked = scratch.keep(held.join(members.select("name", "root").distinct(), "name").select("name", "root", "text"), "asked")
    shared = spark.sparkContext.broadcast(_counted(asked))
    ddl = "key long, name long, n int, root long, bits array<long>"
    target = common.arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, root, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = np.unique(shingle_hashes(text))
                # A key that stands for several texts brings the others along; their names differ.
                if len(found) and name_of(found) == name:
                    keys, bits = _prefix(found, shared.value).view(np.int64), _parities(found).tolist()
                    n = len(keys)
                    yield common.record_batch({"key": keys, "name": [name] * n, "n": [len(found)] * n, "root": [root] * n, "bits": [bits] * n}, target)

    rows = scratch.keep(asked.mapInArrow(run, ddl).distinct(), "prefixes")
    # Shingles of one class have nothing to compare. The others are dealt in blocks, each pair of blocks by itself.
    several = rows.groupBy("key").agg(F.count("*").alias("size"), (F.min("root") < F.max("root")).alias("open")).filter("open")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.join(several.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    one, two = (dealt.select("key", "i", "j", *[F.col(c).alias(f"{c}_{side}") for c in ("name", "n", "root", "own", "bits")]) for side in "ab")
    both = one.join(two, ["key", "i", "j"]).filter((F.col("name_a") < F.col("name_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit("n_a", "n_b") & ((F.col("i") == F.col("j")) | (F.col("own_a") != F.col("own_b"))))
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITS // 64)), F.lit(0))
    return _ordered(both.filter(9 * apart <= F.col("n_a") + F.col("n_b")), "name_a", "name_b").distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of names whose fingerprints are equal or lie within two bits: the least name of each fingerprint stands for it."""
    first = common.cut(nodes.groupBy("fp").agg(F.min("name").alias("first")))
    near = links(first.select("fp"))
    of = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    linked = _ordered(near.join(of("a"), "a").join(of("b"), "b"), "first_a", "first_b")
    return linked.union(_ordered(nodes.join(first, "fp").filter("name <> first"), "name", "first"))


def similar(docs: DataFrame, text: str, key: str, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the distinct sets with their smallest keys, and links (a, b) of similarity 0.8 or more that connect all such sets."""
    nodes = scratch.keep(signatures(docs, text, key).groupBy("name").agg(F.min(F.struct(key, TEXT_HASH)).alias("x"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("name", F.col("x").getField(key).alias("doc"), f"x.{TEXT_HASH}", "fp", "n", "bands"), "nodes")
    keys = nodes.select("name", "n", F.explode("bands").alias("key"))
    shared = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = scratch.keep(keys.join(shared, "key").withColumn("root", F.col("name")), "members")
    weights = members.groupBy("name").agg(F.sum("size").alias("weight"))
    pairs = scratch.keep(_fingerprint_pairs(nodes).union(_stars(members.join(weights, "name"), -F.col("weight"))).distinct(), "pairs")
    wanted = members.select("name").union(pairs.select("a")).union(pairs.select("b")).distinct()
    asked = nodes.join(wanted, "name").select(F.col("doc").alias(key), TEXT_HASH, "name")
    held = scratch.keep(with_hash(docs.select(key, F.col(text).alias("text")), "text").join(asked.hint("shuffle_hash"), [key, TEXT_HASH]).select("name", "text"), "held")
    found = common.cut(verified(pairs, held))
    members = _still_open(members, found, scratch, "open")
    few = members.filter(F.col("size") <= CROWD)
    found = common.cut(found.union(verified(scratch.keep(_pairs(few).distinct(), "few"), held)))
    crowd, turn, links_before = members.filter(F.col("size") > CROWD), 0, -1
    while turn < TURNS and not crowd.isEmpty() and (linked := found.count()) > links_before:
        crowd = _still_open(crowd, found, scratch, f"crowd-{turn}")
        pairs = scratch.keep(_stars(crowd, F.xxhash64("name", "key", F.lit(turn))).distinct(), f"stars-{turn}")
        found = common.cut(found.union(verified(pairs, held)))
        turn, links_before = turn + 1, linked
    crowd = _still_open(crowd, found, scratch, "rest")
    if not crowd.isEmpty():
        found = common.cut(found.union(verified(scratch.keep(_exact_pairs(crowd, held, scratch), "exact"), held)))
    return nodes, found


def _still_open(members: DataFrame, found: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """The members of keys that hold more than one class, with their classes."""
    roots = connected(found).withColumnRenamed("root", "top")
    now = members.drop("root").join(roots, F.col("name") == F.col("node"), "left").select("key", "name", "n", "size", F.coalesce("top", "name").alias("root"))
    open_keys = now.groupBy("key").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("key")
    return scratch.keep(now.join(open_keys, "key", "left_semi"), name)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each class of near copies, with all columns; among rows with that key one of the set with the smallest name. An id with unrelated texts keeps one row for each."""
    common.prepare(docs.sparkSession)
    with common.Scratch(docs.sparkSession) as scratch:
        nodes, edges = similar(docs.filter(F.col(key).isNotNull()), text, key, scratch)
        own = connected(edges).join(nodes.select("name", "doc"), F.col("node") == F.col("name")).select("root", F.struct("doc", "name").alias("x"))
        lost = own.join(own.groupBy("root").agg(F.min("x").alias("least")), "root").filter("x > least").select("x.name")
        named = common.cut(nodes.join(lost, "name", "left_anti").select(F.col("doc").alias(key), TEXT_HASH))
    return keep_named(docs, named, key, text)
