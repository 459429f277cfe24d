"""Ranked search against a plain score of all documents for all items."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quakeframe.llm import ranked_search as search

SF = "/root/testdata/sf0.001"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    """{(item id, text): [(rank, id, score)]} by scoring every document."""
    bags = [(key, Counter(terms(t))) for key, t in docs]
    bags = [(key, b, sum(b.values())) for key, b in bags if b]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    for item in set(items):
        scored = []
        for key, b, size in bags:
            m = 100 - 75 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(item[1]) if b[t])
            if s > 0:
                scored.append((-s, key is None, key or 0))
        if scored:
            out[item] = [(i + 1, None if null else key, -s) for i, (s, null, key) in enumerate(sorted(scored)[:k])]
    return out


def ranked(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append((r[1], r[2], r[3]))
    return {k: sorted(v) for k, v in out.items()}


ITEMS = [(1, "the quick brown fox and the lazy dog"), (1, "the quick brown fox and the lazy dog"), (2, "MIT License, mit license"), (3, None), (4, "!!! ..."), (5, "zzzunknown"), (6, "der le the éß中文 river"), (None, "fox river morning"), (7, "aaaa " * 30 + "fox")]


@pytest.mark.parametrize("places", [1 << 23, 60])
def test_against_all_scores(spark, edge_docs, places):
    real = [(r[0] + 100, r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + real + [(5000 + i, "fox river fox") for i in range(40)] + [(9000, "fox river lazy " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'x' AS item", "1 AS score", "2 AS rank")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    got = search.search(docs, items, places=places)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got) == {k[0]: v for k, v in brute(rows, ITEMS).items()}


def test_blocks_of_items(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    sizes = [sum(len(own) for _, own in block) for block in search.item_blocks(search.with_terms(items, "text", "item_id"), "item_id", 200)]
    assert len(sizes) > 2
    assert ranked(search.search(edge_docs, items, item_bytes=200)) == {k[0]: v for k, v in brute(rows, ITEMS).items()}


def test_id_with_two_texts_and_empty_tables(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "fox"), (1, "licence license")], "item_id long, text string")
    assert {r["rank"] for r in search.search(edge_docs, items).collect()} >= {1, 2}
    assert search.search(no_docs, items).count() == 0
    assert search.search(edge_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(edge_docs, items.limit(0)).count() == 0


def test_stops_early_and_keeps_ties():
    rng = np.random.default_rng(5)
    n, m = 4000, 6
    doc, term = np.tile(np.arange(n), m), np.repeat(np.arange(m), n)
    impact = rng.integers(1, 1000, n * m)
    impact[rng.integers(0, n, 30)] = 50_000
    lists = search.Lists(n, doc, term, impact, m)
    total = impact.reshape(m, n).sum(axis=0)
    top = search.Top(10)
    top.names = list(range(n))
    scored = lists.best(search.Query(0, np.arange(m), np.ones(m, np.int64)), top)
    assert [(-s, d) for s, _, d in top.rows] == sorted(((int(s), i) for i, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert scored < n
    equal = search.Lists(n, doc, term, np.full(n * m, 7), m)
    top = search.Top(10)
    top.names = list(range(n))[::-1]
    equal.best(search.Query(0, np.arange(m), np.ones(m, np.int64)), top)
    assert [d for _, _, d in top.rows] == list(range(10))


def test_query(spark):
    got = search.op12_ranked_search(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(search.ORACLES["op12_ranked_search"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
