"""Packing against the library's own ids, a bin-after-bin search, and invariants of the result."""

import itertools
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from quakeframe.llm import best_fit_packing as packing

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    "it's 'S don't ''ll x'd <|endoftext|>foo<|startoftext|>  bar\x1cbaz c\x85d e\xa0f",
    "ΑΣ ΣΑΣ İstanbul İx Å é 가 5٣x! ...'s a.b --- ​ ﻿z ǅ Ⱥ ×÷ a×b ſ ß ẞ 中文 \U0001f600",
    "Wort, WORT. wort;;; (wort) wort-wort 'tis rock'n'roll 12,000.50 a_b",
]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def docs(spark, edge_docs):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*ODD_TEXTS, "word " * 2047, "word " * 2048, "lorem ipsum, dolor " * 60_000])], "doc_id long, text string")
    return edge_docs.select("doc_id", "text").unionByName(real.withColumn("doc_id", real["doc_id"] + 100)).unionByName(own)


def test_ids_are_those_of_the_library():
    made = packing.Encoder(packing.default_tokenizer())
    assert made.by_word
    for t in ODD_TEXTS:
        assert np.frombuffer(made.encode([t])[0], "<u4").tolist() == ids_of(t)[:-1]
        for w in t.split(" "):
            assert np.frombuffer(made.encode([w])[0], "<u4").tolist() == ids_of(w)[:-1]


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 5000)
    made = packing.Encoder(packing.default_tokenizer())
    texts = [" ".join(f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(k, k + 40)) for k in range(0, 600, 20)]
    for t in texts:
        assert np.frombuffer(made.encode([t])[0], "<u4").tolist() == ids_of(t)[:-1]
        assert made.words.held < 30_000


def test_pieces_and_places(docs):
    rows = packing.pack(packing.pieces(docs)).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = Counter()
    for (k, t), n in texts.items():
        ids = ids_of(t)
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[k, i, at, len(part), np.array(part, "<u4").tobytes()] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][: len(own)]
        assert sum(n for _, n in own) <= 2048
    # No packing has fewer sequences than all tokens need.
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= len(by) <= least + 1


def test_fullest_is_the_best_multiset():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(0, 60))
        flat = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for r in range(len(flat) + 1) for s in {sum(c) for c in itertools.combinations(flat, r)} if s <= room)
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == best
        assert all(n <= counts[k] for k, n in found.items())


def test_plan_equals_bin_after_bin():
    rng = np.random.default_rng(4)
    for _ in range(10):
        counts = Counter(rng.integers(1, 101, 300).tolist())
        made = packing.plan(counts, 100)
        used = Counter()
        for taken, times in made:
            assert sum(k * n for k, n in taken.items()) <= 100
            used.update({k: n * times for k, n in taken.items()})
        assert used == counts
        left, bins = Counter(counts), 0
        while left:
            seed = max(left)
            left = left - Counter({seed: 1})
            left -= packing.fullest(dict(left), 100 - seed)
            bins += 1
        assert abs(sum(times for _, times in made) - bins) <= 1


def test_one_length_holds_most_rows(spark):
    rows = spark.range(30_000).selectExpr("id", "CAST(IF(id % 3 = 0, 1 + id % 700, 700) AS INT) AS length", "id AS offset", "'x' AS __n2")
    got = packing.pack(rows.repartition(7)).toPandas()
    assert list(got.columns) == ["id", "length", "__n2", "sequence_id", "offset"]
    assert sorted(got["id"]) == list(range(30_000))
    own = got.sort_values(["sequence_id", "offset"])
    ends = own["offset"] + own["length"]
    assert ((own["offset"] == 0) | (own["offset"] == ends.shift())).all() and ends.max() <= 2048
    with pytest.raises(ValueError, match="1 to 2048"):
        packing.pack(rows.selectExpr("id", "IF(id = 5, 0, 3) AS length"))


def test_sequences_put_ids_together(docs):
    packed = packing.pack(packing.pieces(docs.filter("doc_id > 100")))
    rows = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = rows[r["sequence_id"]]
        assert bytes(own["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert r["offset"] in own["starts"]


def test_query(spark, no_docs):
    assert packing.pack(packing.pieces(no_docs)).count() == 0
    got = packing.op11_best_fit_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids_of(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
