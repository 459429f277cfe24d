"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else in the corpus. As in prefix-free
parsing, a rolling hash alone decides where texts are cut: the trigger of a place is the least hash among its next
``WINDOW`` places, so equal strings have their triggers at equal offsets, whatever stands around them. Each start of a
string belongs to its trigger; the starts of one trigger are a phrase.

1. Each trigger gives the hash of its next ``PROBE`` bytes. Every string of ``PASSAGE`` bytes holds the probe of its
   trigger, so a phrase whose probe occurs once is done.
2. A phrase that is left gives the digest of its stretch, the bytes that its strings cover together. Where that occurs
   twice, all its strings are repeated. This is the dictionary: copies of a passage count as one entry from here on.
3. Of the other phrases, strings are put into bins of ``STEP`` starts; those of a bin share a core of
   ``LENGTH - STEP`` bytes. Only bins whose core occurs twice can hold a repeat.
4. The strings of these bins, and those of one phrase of each repeated stretch with such a core, give their own digests,
   which are counted.

No suffix array of dictionary and parse is written down: corpus order would be one row a byte through a shuffle, while
these steps send one row a trigger and one a string at the edges of repeats alone. What is declared equal rests on 128
bits of SHA-256; the probe's 64-bit hash only sorts out what cannot repeat.

Equal texts are one text, kept in a bucketed table in the warehouse so that later steps join with it without moving
texts again. A text of ``LENGTH`` bytes or more that occurs twice is removed whole.

Edge cases: a null or empty text has no bytes and the digest of nothing; texts shorter than ``LENGTH`` bytes lose
nothing; matches never cross texts and may overlap within one; repeated rows are copies of each other; an empty table
gives an empty result; other columns are not read. A text's list of phrases holds a number for every 80 of its bytes or
so; a run of one byte has a trigger at each place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes that a trigger's rolling hash covers, places of which it has the least one, bytes of its probe.
TRIGGER, WINDOW, PROBE = 8, 160, 140
#: Any repeated string this long holds the probe of a trigger of its own.
PASSAGE = WINDOW + PROBE
#: Starts of a bin.
STEP = 40
BINS = WINDOW // STEP
#: Starts that are looked at together; their places fit into the low bits of a hash.
BLOCK, PLACE_BITS = 1 << 20, 24
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Minima of all windows of n values."""
    size = 1
    while 2 * size <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if size < n else v


def triggers(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start) of each trigger: the starts whose trigger it is, of strings of ``PASSAGE`` bytes."""
    m = len(raw) - PASSAGE + 1
    parts = []
    for at in range(0, max(m, 0), BLOCK):
        starts = min(BLOCK, m - at)
        n = starts + WINDOW - 1
        h = np.ndarray((n,), np.dtype("<u8"), raw, at, (1,)) * _MIX[0]
        h ^= h >> np.uint64(32)
        h *= _MIX[1]
        place = (_least((h & ~_LOW) | np.arange(n, dtype=np.uint64), WINDOW) & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        parts.append((place[first] + at, first + at, np.append(first[1:], starts) + (at - 1)))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    place, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate([[True], np.diff(place) > 0])
    return place[new], lo[new], np.append(lo[new][1:], m) - 1


def digest(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()[:16]


def covered(begins: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of bytes covered by strings that begin at the given sorted places."""
    if not len(begins):
        return np.empty((0, 2), np.int64)
    gap = np.nonzero(begins[1:] > begins[:-1] + LENGTH)[0]
    return np.stack([begins[np.concatenate([[0], gap + 1])], begins[np.concatenate([gap, [len(begins) - 1]])] + LENGTH], axis=1)


def bin_starts(place: int, lo: int, hi: int, j: int) -> tuple[int, int]:
    """First and last start of bin ``j`` of a phrase; empty if the first is larger."""
    return max(lo, place - STEP * j - STEP + 1), min(hi, place - STEP * j)


def stretch(raw: bytes, place: int, lo: int, hi: int) -> bytes:
    """Digest of the bytes that the strings of a phrase cover, and of where its trigger lies among them."""
    return digest(b"%d:" % (place - lo) + raw[lo : hi + LENGTH])


def core(raw: bytes, place: int, j: int) -> bytes:
    """Digest of the bytes that all strings of a bin cover, with the bin's number."""
    return digest(b"%d:" % j + raw[place - STEP * j : place - STEP * (j + 1) + LENGTH])


def _map(df: DataFrame, fn: Any, ddl: str) -> DataFrame:
    """``fn`` gets an iterator over batches of column lists and yields dicts of columns of ``ddl``."""
    target = common.arrow_schema(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.record_batch(fn(*(c.to_pylist() for c in b.columns)), target)

    return df.mapInArrow(run, ddl)


def text_sha(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def name_of(sha: str = "sha") -> Column:
    """16 bytes of a text's SHA-256 in hex: the name of the text."""
    return F.unhex(F.substring(sha, 1, 32))


def distinct_texts(docs: DataFrame, text: str, name: str, path: str) -> DataFrame:
    """Texts of ``PASSAGE`` bytes or more as (k, raw), one row each, in a table bucketed by ``k`` whose files lie in ``path``. Copies go inside each task before texts move."""
    spark = docs.sparkSession
    ddl = "k binary, raw binary"
    target = common.arrow_schema(spark, ddl)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = [not (k in seen or seen.add(k)) for k in b.column(0).to_pylist()]
            yield b.filter(pa.array(new, pa.bool_())).cast(target)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.filter(F.octet_length(text) >= PASSAGE).select(text_sha(text).alias("sha"), F.col(text).cast("binary").alias("raw")).select(name_of().alias("k"), "raw")
    rows.mapInArrow(first, ddl).repartition(n, "k").mapInArrow(first, ddl).write.option("compression", "zstd").option("path", path).bucketBy(n, "k").saveAsTable(name)
    return spark.table(name)


def packed(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A phrase as one number."""
    return place << 16 | (place - lo) << 8 | (hi - lo)


def unpacked(p: int) -> tuple[int, int, int]:
    """(place, first start, last start) of a phrase."""
    place = p >> 16
    lo = place - (p >> 8 & 255)
    return place, lo, lo + (p & 255)


def _probes(keys: list[bytes], raws: list[bytes]) -> dict[str, Any]:
    """A row for each trigger. ``own`` stands for the text where texts are counted."""
    from xxhash import xxh3_64_intdigest

    found = [triggers(raw) for raw in raws]
    at = np.repeat(np.arange(len(keys)), [len(f[0]) for f in found])
    probes = [xxh3_64_intdigest(raw[p : p + PROBE]) for raw, f in zip(raws, found, strict=True) for p in f[0].tolist()]
    phrases = np.concatenate([packed(*f) for f in found]) if found else np.empty(0, np.int64)
    heads = np.array([int.from_bytes(k[:4], "little") for k in keys], np.int64)
    return {"k": pa.array(keys, pa.binary()).take(pa.array(at)), "own": heads[at], "p": phrases, "probe": np.array(probes, np.uint64).view(np.int64)}


def _stretches(keys: list[bytes], raws: list[bytes], phrases: list[list[int]]) -> dict[str, Any]:
    """Stretches of the phrases that are left, with their starts cut off where no whole string fits."""
    out: dict[str, list] = {x: [] for x in ("k", "p", "stretch")}
    for k, raw, own in zip(keys, raws, phrases, strict=True):
        for place, lo, hi in map(unpacked, own):
            hi = min(hi, len(raw) - LENGTH)
            if lo <= hi:
                for x, v in zip(out, (k, int(packed(place, lo, hi)), stretch(raw, place, lo, hi)), strict=True):
                    out[x].append(v)
    return out


def _cores(keys: list[bytes], raws: list[bytes], phrases: list[list]) -> dict[str, Any]:
    """Bins of phrases with their cores."""
    out: dict[str, list] = {x: [] for x in ("k", "p", "opened", "j", "core")}
    for k, raw, own in zip(keys, raws, phrases, strict=True):
        for x in own:
            place, lo, hi = unpacked(x["p"])
            for j in range(BINS):
                a, b = bin_starts(place, lo, hi, j)
                if a <= b:
                    for c, v in zip(out, (k, x["p"], x["opened"], j, core(raw, place, j)), strict=True):
                        out[c].append(v)
    return out


def _strings(keys: list[bytes], raws: list[bytes], work: list[list]) -> dict[str, Any]:
    """Digests of the strings of open bins, and of bins that stand for a repeated stretch (``opened`` false)."""
    out: dict[str, list] = {x: [] for x in ("k", "first", "opened", "digests")}
    for k, raw, own in zip(keys, raws, work, strict=True):
        for p in own:
            a, b = bin_starts(*unpacked(p["p"]), p["j"])
            for x, v in zip(out, (k, a, p["opened"], [digest(raw[s : s + LENGTH]) for s in range(a, b + 1)]), strict=True):
                out[x].append(v)
    return out


def _cuts(keys: list[bytes], raws: list[bytes], found: list[list]) -> dict[str, Any]:
    """What is left of texts that lose bytes. ``mask`` has a bit for each repeated start from ``first`` on; null stands for ``size`` of them."""
    out: dict[str, list] = {x: [] for x in ("k", "n_removed", "n_spans", "kept_sha256", "runs")}
    for k, raw, own in zip(keys, raws, found, strict=True):
        begins = np.zeros(len(raw) - LENGTH + 1, bool)
        for p in own:
            if p["mask"] is None:
                begins[p["first"] : p["first"] + p["size"]] = True
            else:
                begins[[p["first"] + i for i in range(STEP) if p["mask"] >> i & 1]] = True
        runs = covered(np.nonzero(begins)[0])
        ends = [0, *runs[:, 1].tolist()]
        kept = b"".join(raw[a:b] for a, b in zip(ends, [*runs[:, 0].tolist(), len(raw)], strict=True))
        for x, v in zip(out, (k, len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs.tolist()), strict=True):
            out[x].append(v)
    return out


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k, n_removed, n_spans, kept_sha256, runs, passage) of each distinct text that loses bytes or shares a passage; of one that is removed whole only ``copied`` is set."""
    spark = docs.sparkSession
    common.prepare(spark)
    name = f"phrase_repeats_{uuid.uuid4().hex}"
    try:
        with common.Scratch(spark) as scratch:
            return _removed(docs, text, distinct_texts(docs, text, name, f"{scratch.path}/texts"), scratch)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _removed(docs: DataFrame, text: str, texts: DataFrame, scratch: common.Scratch) -> DataFrame:
    copies = docs.filter(F.octet_length(text) >= PASSAGE).select(text_sha(text).alias("sha")).groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select(name_of().alias("k"), F.lit(True).alias("copied"))

    parsed = _map(texts.select("k", "raw"), _probes, "k binary, own long, p long, probe long")
    # What is counted is written first, so that a join can split a probe that many texts hold.
    shared = scratch.keep(parsed.groupBy("probe").agg(F.count("*").alias("n"), (F.min("own") < F.max("own")).alias("across")).filter("n > 1").drop("n"), "shared")
    left = parsed.join(shared, "probe").groupBy("k").agg(F.collect_list("p").alias("phrases"), F.max("across").alias("across"))
    phrases = scratch.keep(left, "phrases")
    scratch.drop("shared")

    marks = scratch.keep(_map(texts.join(phrases.drop("across"), "k"), _stretches, "k binary, p long, stretch binary"), "marks")
    entry = F.xxhash64("k", "p")
    twice = scratch.keep(marks.groupBy("stretch").agg(F.count("*").alias("n"), F.min(entry).alias("entry")).filter("n > 1").drop("n"), "twice")
    # A phrase is settled if its stretch is repeated; one of those with equal stretches is the model of them all.
    known = scratch.keep(marks.join(twice, "stretch", "left").select("k", "p", F.col("entry").isNotNull().alias("settled"), F.coalesce(F.col("entry") == entry, F.lit(False)).alias("model")), "known")
    scratch.drop("marks")

    active = known.filter("model OR NOT settled").groupBy("k").agg(F.collect_list(F.struct("p", (~F.col("settled")).alias("opened"))).alias("phrases"))
    bins = scratch.keep(_map(texts.join(active, "k"), _cores, "k binary, p long, opened boolean, j int, core binary"), "bins")
    live = scratch.keep(bins.groupBy("core").agg(F.count("*").alias("n"), F.max("opened").alias("any")).filter("n > 1 AND any").select("core"), "live")
    work = scratch.keep(bins.join(live, "core").groupBy("k").agg(F.collect_list(F.struct("p", "j", "opened")).alias("work")), "work")
    scratch.drop("bins")

    strings = _map(texts.join(work, "k"), _strings, "k binary, first int, opened boolean, digests array<binary>")
    repeated = scratch.keep(strings.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"), "repeated")
    hits = strings.filter("opened").select("k", "first", F.posexplode("digests").alias("i", "d")).join(repeated, "d").groupBy("k", "first").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    lo = F.shiftright("p", 16) - F.shiftright("p", 8).bitwiseAND(F.lit(255))
    runs = known.filter("settled").select("k", F.struct(lo.cast("int").alias("first"), (F.col("p").bitwiseAND(F.lit(255)) + 1).cast("int").alias("size"), F.lit(None).cast("long").alias("mask")).alias("x"))
    found = hits.select("k", F.struct("first", F.lit(0).alias("size"), "mask").alias("x")).union(runs)
    lists = scratch.keep(found.groupBy("k").agg(F.collect_list("x").alias("found")), "lists")
    scratch.drop("repeated")
    cuts = _map(texts.join(lists, "k"), _cuts, "k binary, n_removed long, n_spans long, kept_sha256 string, runs array<array<long>>")
    return common.cut(cuts.join(phrases.filter("across").select("k", F.lit(True).alias("passage")), "k", "full").join(copies, "k", "full"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, passage, runs) of every row.

    ``runs`` are the removed byte ranges. ``passage`` is true if the text shares a passage with another row: all of
    ``PASSAGE`` bytes or more count, none below ``PROBE`` bytes does.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key), text_sha(text).alias("sha"), F.octet_length(t).cast("long").alias("n_bytes")).withColumn("k", name_of())
    gone = F.coalesce(F.col("copied") & (F.col("n_bytes") >= LENGTH), F.lit(False))
    either = lambda whole_text, other: F.when(gone, whole_text).otherwise(other)
    return whole.join(removed(docs, text), "k", "left").select(
        key,
        "n_bytes",
        either(F.col("n_bytes"), F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        either(F.lit(1), F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        either(F.sha2(F.lit(""), 256), F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.coalesce(F.col("passage") | F.col("copied"), F.col("copied"), F.col("passage"), F.lit(False)).alias("passage"),
        either(F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes"))), F.col("runs")).alias("runs"),
    )


def op9_phrase_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("runs")


QUERIES = {"op9_phrase_repeats": op9_phrase_repeats}
ORACLES: dict[str, str] = {}
