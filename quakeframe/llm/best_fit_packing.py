"""Packing token sequences by minimum bin slack.

Each bin starts with the longest piece left, and a subset-sum over bitsets of the lengths still available finds the
fullest combination that fits beside it. Which pieces have a length does not matter to that search, so it runs on the
counts of lengths, at most ``capacity`` numbers at any table size: the combination found is taken as often as the counts
last, which is what bin after bin would have found, and then the search goes on. All pieces of all documents share this
one plan, so sequences are as full as the whole table allows.

Spark does the rest. Each task numbers its pieces of each length as it writes them, running sums of the counts by task
and length make that a number in the whole table, and a sorted list of the plan's ranges turns it into a sequence and a
place. No group of equal lengths ever meets in one task.

Edge cases: a null or empty text is the end id alone; a text that fills sequences exactly is not cut further; repeated
rows are packed one by one; pieces of equal length may take each other's places, which changes no count; an empty table
gives an empty result; ``pieces`` reads only key and text, ``pack`` keeps all columns and replaces those it makes.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 2048, 0
#: Bytes that a worker's cache of words may hold, bytes of an entry besides its own, and the longest word that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHE_WORD = 1 << 27, 160, 256
#: Texts of each worker whose ids are compared with those of the library for the whole text, and bytes of ids sent at a time.
PROBES, SENT_BYTES = 4, 1 << 22
#: Controls that Python splits at although the tokenizer does not take them as white space.
ODD = "\x1c\x1d\x1e\x1f"
#: Letters below U+0250 whose lower case is one letter, then marks: such a word is two pre-tokens, in any normal form.
PLAIN = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")
#: What the tokenizer must be for its words to be encoded one by one (fixed values of the file).
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of stretches without white space, as bytes; what is not there yet is encoded and kept."""

    def __init__(self, tokenizer: Any) -> None:
        super().__init__()
        self.tokenizer, self.model, self.held = tokenizer, tokenizer.model, 0
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = dict(zip([*visible, *hidden], [*map(chr, visible), *(chr(256 + i) for i in range(len(hidden)))], strict=True))

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            run, marks = plain.groups()
            out = self.run(run.lower()) + (self.run(marks) if marks else b"")
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self.keep(word, out)

    def run(self, run: str) -> bytes:
        """Ids of one pre-token, by the model alone."""
        found = self.get(run)
        if found is None:
            spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            found = self.keep(run, np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes())
        return found

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHE_WORD and word not in self:
            self[word] = ids
            self.held += ENTRY_BYTES + len(word) + len(ids)
        return ids

    def trim(self) -> None:
        """Keep the older half of a full cache, since frequent words came early."""
        if self.held > CACHE_BYTES:
            for w in list(islice(self, len(self) // 2, None)):
                del self[w]
            self.held = sum(ENTRY_BYTES + len(w) + len(x) for w, x in self.items())


class Encoder:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizer drops white space and looks at no character beyond it, so the ids of a text are those of its stretches
    without white space, which repeat. Other tokenizers than of this kind get whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        self.by_word = all(made[k] == v for k, v in STEPS.items())
        self.words, self.unchecked = Words(self.tokenizer), PROBES

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            return self.library(texts)
        self.words.trim()
        known = self.words.__getitem__
        out = [b"".join(map(known, t.split())) if not any(c in t for c in ODD) else self.library([t])[0] for t in texts]
        if own := [i for i, t in enumerate(texts) if t][: self.unchecked]:
            self.unchecked -= len(own)
            if [out[i] for i in own] != self.library([texts[i] for i in own]):
                raise ValueError("ids of words differ from those of whole texts")
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids) of every row: its ids and the end id, cut after each ``capacity`` of them. ``ids`` holds little-endian 32-bit numbers."""
    path = path or default_tokenizer()
    common.prepare(docs.sparkSession)
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"
    target, end = common.arrow_schema(docs.sparkSession, ddl), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for k, ids in zip(b.column(0).to_pylist(), encoder(path).encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((k, i, at // 4, len(part) // 4, part))
                    held += len(part)
                    if held > SENT_BYTES:
                        yield _rows(out, target)
                        out, held = [], 0
            if out:
                yield _rows(out, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl)


def _rows(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return common.record_batch(dict(zip(target.names, map(list, zip(*rows, strict=True)), strict=True)), target)


def fullest(counts: dict[int, int], room: int) -> Counter[int]:
    """The multiset of lengths, each at most as often as it is there, whose sum comes nearest to ``room`` from below.

    Bit s of a bitset says that the sum s can be reached. Longer lengths come first and are preferred, which keeps short
    ones for later; the search ends once ``room`` itself is reached.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, 2 * take
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found[length] += take
            total -= length * take
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter[int], int]]:
    """(lengths of a sequence with their numbers, how many such sequences), until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        taken = fullest({k: n for k, n in left.items() if n}, capacity - seed)
        left[seed] += 1
        taken[seed] += 1
        times = min(left[k] // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((taken, times))
    return out


def ranges(plan_: list[tuple[Counter[int], int]]) -> np.ndarray:
    """(length, first number, number in a sequence, first sequence, place of the first) rows: where pieces of a length go, by their number; sorted."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for taken, times in plan_:
        place = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used[length], n, sequence, place))
            used[length] += n * times
            place += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(rows: DataFrame, length: str) -> DataFrame:
    """``rows`` with ``__part``, their task, and ``__own``, their number among the task's rows of that length."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "__part int, __own long"])
    target, at = common.arrow_schema(rows.sparkSession, ddl), rows.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            own = []
            for x in b.column(at).to_pylist():
                own.append(seen[x])
                seen[x] += 1
            given = [c.cast(f.type) for c, f in zip(b.columns, target, strict=False)]
            yield pa.RecordBatch.from_arrays([*given, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], schema=target)

    return rows.mapInArrow(run, ddl)


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``rows``, pieces of 1 to ``capacity`` tokens, with ``sequence_id`` and ``offset``, their place in it."""
    spark = rows.sparkSession
    common.prepare(spark)
    rows = rows.drop("sequence_id", "offset")
    own = common.cut(numbered(rows, length))
    counts = common.cut(own.groupBy("__part", F.col(length).cast("long").alias("__length")).agg(F.count("*").alias("n")))
    total = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("n")).filter(F.col("__length").between(1, capacity)).collect()}
    if counts.filter(F.col("__length").isNull() | ~F.col("__length").between(1, capacity)).limit(1).count():
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    found = ranges(plan(total, capacity))
    shared = spark.sparkContext.broadcast(found)
    before = F.sum("n").over(Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", "__length", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = own.withColumn("__length", F.col(length).cast("long")).join(starts, ["__part", "__length"]).withColumn("__n", F.col("__before") + F.col("__own")).select(*rows.columns, "__length", "__n")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "sequence_id long, offset long"])
    target = common.arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            size, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (-2, -1))
            at = _last_not_above(table, size, n)
            number = n - table[at, 1]
            sequence, slot = table[at, 3] + number // table[at, 2], number % table[at, 2]
            given = [c.cast(f.type) for c, f in zip(b.columns, target, strict=False)][: len(target) - 2]
            yield pa.RecordBatch.from_arrays([*given, pa.array(sequence, pa.int64()), pa.array(table[at, 4] + slot * size, pa.int64())], schema=target)

    return placed.mapInArrow(run, ddl)


def _last_not_above(table: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each (length, number) the last row of the table with that length and no larger first number."""
    at = np.empty(len(size), np.int64)
    for x in np.unique(size):
        lo, hi = np.searchsorted(table[:, 0], [x, x + 1])
        own = size == x
        at[own] = lo + np.searchsorted(table[lo:hi, 1], n[own], "right") - 1
    return at


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the ids of each sequence in order and where its pieces start. A group is bounded by the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("x")).select("sequence_id", F.aggregate("x.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"), F.col("x.offset").alias("starts"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(common.table(spark, sf_dir, "documents"))
    return pack(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


QUERIES: dict[str, Any] = {"op11_best_fit_packing": op11_best_fit_packing}
ORACLES: dict[str, str] = {}
