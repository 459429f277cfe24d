"""Language-model scores of whole texts.

Two models learn from the training rows. The base is an additive unigram model over words, with exact counts from all
training rows. The second is a causal self-attention network over subword ids (``attention_model``):

* every training text is cut into windows of ids from its beginning to its end, so that each id of each text is what one
  window has to predict, and none is left out;
* the classes of ids come from the neighbours in all windows, summed in each task and then by cell;
* the counts that the softmax starts from come from the counts of all training words;
* the weights are fitted by trainers, one for each ``TRAINER`` windows: each takes Adam steps on windows of its own, and the
  changes are averaged row by row, ``ROUNDS`` times over. A text's windows take turns in the rounds, and a round uses all
  of its windows; trainers with few windows use them up to ``EPOCHS`` times a round, ``STEPS`` steps at most.

Texts are read twice, for the counts and for the ids, which are written down; windows and the network's scores come from these.
The base model is summed over the words with the highest counts, ``HOT_WORDS`` at most, which are broadcast, while the ids are
made; the other words of each text go through a join with the full counts.

Edge cases: a null or empty text is one end token; without training rows all counts are zero, the base gives every
token log10(0.1 / 0.1) = 0 and the network stays as it starts; a null key counts as training; rows of any length are
scored whole; repeated rows each have their own score; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_model as am
from . import common
from .pretokens import MARK
from .token_counts import default_model, processor

FOLDS, HELD_OUT = 10, 0
ADD = 0.1
#: The end of a text as a word; no word holds a space.
END = b" "
END_ID = 2
HOT_WORDS = 1 << 18
#: Windows of a trainer, of a step, the rounds of averaging, and what a trainer with few windows does.
TRAINER, BATCH, ROUNDS, EPOCHS, STEPS = 400_000, 1024, 2, 10, 150
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Arrow batches that are summed by cell together.
HELD = 64


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(common.doc_crc(key) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, then one end."""
    return [*text.encode().lower().split(), END] if text else [END]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all rows, combined in each task before the shuffle."""
    target = common.arrow_schema(docs.sparkSession, "word binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_of(t))
            if len(counts) > FLUSH:
                yield common.record_batch({"word": list(counts), "n": list(counts.values())}, target)
                counts = Counter()
        yield common.record_batch({"word": list(counts), "n": list(counts.values())}, target)

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(counts: DataFrame, size: int = HOT_WORDS) -> dict[bytes, int]:
    """The most frequent words, at most ``size``: all those above a count that a coarse histogram gives."""
    step = F.floor(F.log2("n") * 8)
    bins = sorted(((r["s"], r["w"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("w")).collect()), reverse=True)
    total, low = 0, None
    for s, w in bins:
        if total + w > size:
            break
        total, low = total + w, s
    return {bytes(r["word"]): r["n"] for r in counts.filter(step >= low).toLocalIterator()} if low is not None else {}


def word_ids(model_path: str, words: list[bytes]) -> list[list[int]]:
    """Subword ids of words."""
    ids = processor(model_path).encode([w.decode() for w in words], num_threads=1)
    return [[END_ID] if w == END else x for w, x in zip(words, ids, strict=True)]


class Lexicon:
    """Words with their base log probabilities and subword ids, kept as a few arrays and used through a hash table."""

    def __init__(self, hot: dict[bytes, int], total: int, distinct: int, model_path: str) -> None:
        scale = math.log10(total + ADD * (distinct + 1))
        words = [*hot, *([] if END in hot else [END])]
        ids = word_ids(model_path, words)
        self.path, self.hot = model_path, len(hot)
        self.blob, self.sizes = b"".join(words), np.fromiter(map(len, words), np.int32, len(words))
        self.base = np.array([math.log10(hot[w] + ADD) - scale if w in hot else 0.0 for w in words])
        self.ids, self.ends = np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])

    def index(self) -> dict[bytes, int]:
        ends = np.cumsum(self.sizes).tolist()
        return {self.blob[a:b]: i for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))}


class Reader:
    """A worker's lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, lexicon.index()

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word in the lexicon, -1 for others; ids of all words; number of ids of each word)."""
        x = self.lexicon
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        rare = np.nonzero(at < 0)[0]
        new = {w: len(x.sizes) + i for i, w in enumerate(dict.fromkeys(flat[i] for i in rare.tolist()))}
        found = word_ids(x.path, list(new))
        table = np.concatenate([x.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        ends = np.concatenate([x.ends, x.ends[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)])
        place = at.copy()
        place[rare] = [new[flat[i]] for i in rare.tolist()]
        sizes = ends[place + 1] - ends[place]
        ids = table[np.repeat(ends[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        return np.where(at < x.hot, at, -1), ids, sizes


_readers: dict[str, Reader] = {}


def _reader(token: str, shared: Any) -> Reader:
    """The reader of a broadcast lexicon, one for each Python worker."""
    if token not in _readers:
        _readers.clear()
        _readers[token] = Reader(shared.value)
    return _readers[token]


def windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of ``WINDOW + 1`` ids, number of windows of each sequence) of sequences one after another.

    The start id stands before each sequence and -1 fills its last window up. A window begins with the id that ends the
    one before, so each id is once behind the first place.
    """
    size = am.WINDOW
    number = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), number)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * size
    starts = np.cumsum(lengths) - lengths
    place = begin[:, None] + np.arange(size + 1) - 1
    out = np.append(ids, -1).astype(np.int32)[np.minimum(starts[owner, None] + np.maximum(place, 0), len(ids))]
    out[place >= lengths[owner, None]] = -1
    out[begin == 0, 0] = am.START
    return out, number


def _cut(texts: DataFrame) -> DataFrame:
    """(u, part, ids): all windows of texts (u, ids) given as bytes of their ids. A row has those of a text that take part in one round."""
    target = common.arrow_schema(texts.sparkSession, "u long, part int, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            raw = b.column(1).to_pylist()
            found, number = windows(np.frombuffer(b"".join(raw), np.int32), np.array([len(x) // 4 for x in raw], np.int64))
            rows = []
            for u, own in zip(b.column(0).to_pylist(), np.split(found, np.cumsum(number)[:-1]) if raw else [], strict=True):
                rows += [(u, (turn + i) % ROUNDS, own[i::ROUNDS].tobytes()) for i in range(min(ROUNDS, len(own)))]
                turn += len(own)
            yield common.record_batch({n: [r[i] for r in rows] for i, n in enumerate(target.names)}, target)

    return texts.select("u", "ids").mapInArrow(run, "u long, part int, ids binary")


def windows_of(docs: DataFrame, token: str, shared: Any, text: str = "text") -> DataFrame:
    """(u, part, ids): all windows of every text, see ``_cut``."""
    target = common.arrow_schema(docs.sparkSession, "u long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, seen = _reader(token, shared), TaskContext.get().partitionId(), 0
        for b in batches:
            lists = [words_of(t) for t in b.column(0).to_pylist()]
            if lists:
                _, ids, sizes = reader.read(lists)
                yield common.record_batch({"u": part << 40 | seen + np.arange(len(lists)), "ids": _by_text(ids, sizes, lists)[0]}, target)
            seen += len(lists)

    return _cut(docs.select(text).mapInArrow(run, "u long, ids binary"))


def _by_text(ids: np.ndarray, sizes: np.ndarray, lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(bytes of each text's ids, first word of each text)."""
    n = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(n) - n
    ends = np.cumsum(np.add.reduceat(sizes, starts)).tolist()
    raw = ids.astype(np.int32).tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], starts


def _windows(b: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.int32).reshape(-1, am.WINDOW + 1)


def _cells(df: DataFrame, columns: list[str], size: int, add: Any) -> np.ndarray:
    """Sums by cell over all batches; ``add`` adds a few batches as one to an array of ``size`` cells. At most one row a cell reaches the driver."""
    target = common.arrow_schema(df.sparkSession, "cell long, n double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(size), []
        for b in chain(batches, [None]):
            if held and (b is None or sum(x.nbytes for x in held) > common.BATCH_BYTES or len(held) >= HELD):
                add(pa.concat_batches(held), total)
                held = []
            if b is not None and len(b):
                held.append(b)
        at = np.nonzero(total)[0]
        yield common.record_batch({"cell": at, "n": total[at]}, target)

    found = np.zeros(size)
    for b in df.select(columns).mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        found[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return found


def profiles(windows: DataFrame, size: int) -> np.ndarray:
    """(id, bucket) counts of the ids after and before each id in all windows."""
    k = am.BUCKETS

    def add(b: pa.RecordBatch, total: np.ndarray) -> None:
        w = _windows(b, 0)
        two = w[:, 1:].ravel()
        live = np.nonzero(two >= 0)[0]
        one, two = w[:, :-1].ravel().take(live), two.take(live)
        for cells in (one * (2 * k) + two % k, two * (2 * k) + (k + one % k)):
            np.add.at(total, cells, 1.0)

    return _cells(windows, ["ids"], size * 2 * k, add).reshape(size, 2 * k)


def pair_counts(counts: DataFrame, model_path: str, classes: np.ndarray) -> np.ndarray:
    """Counts (class of the id before in the word, id) in all training rows, from the word counts; a word's first id counts under class 0."""
    size = len(classes)

    def add(b: pa.RecordBatch, total: np.ndarray) -> None:
        ids = word_ids(model_path, b.column(0).to_pylist())
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
        if len(flat):
            before = np.concatenate([[0], classes[flat[:-1]]])
            before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
            np.add.at(total, before * size + flat, np.repeat(b.column(1).to_numpy(), lengths))

    return _cells(counts.select("word", F.col("n").cast("double").alias("n")), ["word", "n"], am.FAN * size, add).reshape(am.FAN, size)


def averaged(windows: DataFrame, model: am.Model, trainers: int, turn: int) -> np.ndarray:
    """The weights after each trainer's steps on the windows of one round, averaged row by row."""
    spark = windows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [f"d{i}" for i in range(am.WIDTH)]
    ddl = ", ".join(["row int, weight float", *(f"{n} float" for n in names)])
    target = common.arrow_schema(spark, ddl)

    def trained(own: list[np.ndarray]) -> pa.RecordBatch:
        w = np.concatenate(own)
        steps = max(-(-len(w) // BATCH), min(EPOCHS * len(w) // BATCH, STEPS))
        change, weight = am.train(shared.value, w, steps, BATCH, seed=turn)
        at = np.nonzero(weight)[0]
        return common.record_batch({"row": at.astype(np.int32), "weight": weight[at].astype(np.float32), **{n: (change[at, i] * weight[at]).astype(np.float32) for i, n in enumerate(names)}}, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0
        for b in batches:
            # A task that was dealt more than it can hold goes on as another trainer.
            if held > 2 * TRAINER // ROUNDS:
                yield trained(own)
                own, held = [], 0
            if len(b):
                own.append(_windows(b, 0))
                held += len(own[-1])
        if held:
            yield trained(own)

    dealt = windows.filter(F.col("part") == turn).repartition(trainers, F.xxhash64("u")).select("ids")
    sums = dealt.mapInArrow(run, ddl).groupBy("row").agg(*[(F.sum(n) / F.sum("weight")).alias(n) for n in names]).toArrow()
    out = model.matrix.copy()
    if len(sums):
        out[sums.column("row").to_numpy()] += np.stack([sums.column(n).to_numpy() for n in names], axis=1).astype(np.float32)
    return out


def fit(windows: DataFrame, counts: DataFrame, model_path: str) -> am.Model:
    """The attention model from the windows and the word counts of all training rows."""
    sp = processor(model_path)
    size = sp.get_piece_size()
    first = np.array([i == END_ID or sp.id_to_piece(i).startswith(MARK) for i in range(size)])
    near = profiles(windows, size)
    classes = am.id_classes(near, first)
    tree = am.build_tree(classes, first, pair_counts(counts, model_path, classes))
    model = am.Model(tree, am.Network.start(size).matrix)
    # Each id is counted before and behind another.
    trainers = max(1, round(near.sum() / 2 / am.WINDOW / TRAINER))
    for turn in range(ROUNDS):
        model = am.Model(tree, averaged(windows, model, trainers, turn))
    return model


def score(docs: DataFrame, model_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    common.prepare(docs.sparkSession)
    with common.Scratch(docs.sparkSession) as scratch:
        return _score(docs, model_path or default_model(), text, key, scratch)


def _score(docs: DataFrame, path: str, text: str, key: str, scratch: common.Scratch) -> DataFrame:
    spark = docs.sparkSession
    training = docs.filter(~held_out(key))
    counts = scratch.keep(word_counts(training, text), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    scale = math.log10(total + ADD * (distinct + 1))
    shared, token = spark.sparkContext.broadcast(Lexicon(hot_words(counts), total, distinct, path)), uuid.uuid4().hex
    own = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, u long, n_tokens long, hot_known long, hot_score double"
    ddl = f"{own}, rare array<struct<word:binary,m:int>>, ids binary"
    target = common.arrow_schema(spark, ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, seen = _reader(token, shared), TaskContext.get().partitionId(), 0
        for b in batches:
            lists = [words_of(t) for t in b.column(2).to_pylist()]
            if not lists:
                continue
            at, ids, sizes = reader.read(lists)
            raw, starts = _by_text(ids, sizes, lists)
            n = np.array([len(x) for x in lists], np.int64)
            hot = at >= 0
            rare = [Counter([x[i] for i in np.nonzero(~hot[s : s + len(x)])[0].tolist()]) for x, s in zip(lists, starts.tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, rare)])
            pairs = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([m for r in rare for m in r.values()], pa.int32())], ["word", "m"])
            yield common.record_batch(
                {key: b.column(0), "held_out": b.column(1), "u": part << 40 | seen + np.arange(len(n)), "n_tokens": n, "hot_known": np.add.reduceat(hot.astype(np.int64), starts), "hot_score": np.add.reduceat(np.where(hot, reader.lexicon.base[at], 0.0), starts), "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(target.field("rare").type), "ids": raw},
                target,
            )
            seen += len(n)

    texts = scratch.keep(docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text)).mapInArrow(read, ddl), "texts")
    model = spark.sparkContext.broadcast(fit(_cut(texts.filter("NOT held_out")), counts, path))
    scored_target = common.arrow_schema(spark, f"{own}, score double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(6).to_pylist()
            score = am.score(model.value, np.frombuffer(b"".join(raw), np.int32).astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(score)], schema=scored_target)

    scored = texts.drop("rare").mapInArrow(judge, f"{own}, score double")
    n = F.coalesce("n", F.lit(0))
    rare = texts.select("u", F.explode("rare").alias("x")).select("u", "x.word", "x.m").join(counts, "word", "left").groupBy("u").agg(F.sum(F.col("m") * (F.log10(n + F.lit(ADD)) - F.lit(scale))).alias("rare_score"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    whole = scored.join(rare, "u", "left").select(
        key,
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
    return common.cut(whole)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
