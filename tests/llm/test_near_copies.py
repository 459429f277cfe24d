"""Near-dedup of the pipeline against all pairs of texts."""

import random

from quakeframe.llm import near_copies

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return (not a and not b) or 5 * len(a & b) >= 4 * len(a | b)


def kept_by_pairs(rows):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def planted(rng):
    """Pairs at similarities 0.8 to 0.95, with their second ids."""
    rows, second = [], []
    for k in range(40):
        base = words(rng, 200)
        copy = list(base)
        for at in rng.sample(range(5, 195, 6), 1 + k % 4):
            copy[at] = "changed"
        share = len(grams(" ".join(base)) & grams(" ".join(copy))) / len(grams(" ".join(base)) | grams(" ".join(copy)))
        assert 0.8 <= share <= 0.96
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        second.append(2 * k + 1)
    return rows, second


def test_stage_drops_planted_near_copies(spark):
    rows, second = planted(random.Random(1))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({i for i, _ in rows} - set(second))


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i + 10_000, t) for i, t in planted(rng)[0]]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # A crowd around one text, some of it only linked through others, a chain, pairs just below, and one line in many texts.
    base, line = words(rng, 120), words(rng, 12)
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), 1 + k % 6):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(copy)))
    chain = words(rng, 150)
    for k in range(25):
        rows.append((30_000 + k, " ".join(chain[3 * k :] + words(rng, 3 * k))))
    for k in range(40):
        rows.append((40_000 + k, " ".join([*line, *words(rng, 2 + k)])))
    rows += [(50_000, None), (50_001, ""), (50_002, "a b"), (50_003, "A  b"), (50_004, "a b c d e"), (50_005, "a b c d e f")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == kept_by_pairs(rows)


def test_crowds_lose_no_pair(spark, monkeypatch):
    """Pairs of crowded keys that no drawn centre brings together: texts that share three quarters, with pairs of 0.8 among them."""
    rng = random.Random(5)
    base, rows = words(rng, 150), []
    for k in range(60):
        rows.append((k, " ".join([*base, *words(rng, 40 + k % 3)])))
    for k in range(0, 60, 4):
        changed = rows[k][1].split()
        changed[20 + k] = f"x{k}"
        changed[-10] = f"y{k}"
        rows.append((100 + k, " ".join(changed)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "CROWD", 1)
    monkeypatch.setattr(near_copies, "BLOCK", 7, raising=False)
    monkeypatch.setattr(near_copies, "_stars", lambda members, order: members.select(members["name"].alias("a"), members["name"].alias("b")).limit(0))
    want = kept_by_pairs(rows)
    assert len(want) == 60 and sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == want


def test_edges(edge_docs, no_docs):
    out = near_copies.keep_one(edge_docs)
    assert out.columns == edge_docs.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 5, 7, 8, 9]
    assert near_copies.keep_one(no_docs).count() == 0


def test_one_id_with_unrelated_texts(spark):
    """Rows are told apart by id and text, so the result does not depend on their order, and no unrelated text is lost."""
    from itertools import permutations

    from quakeframe.llm import simhash_dedup

    rng = random.Random(9)
    a, b = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    for order in list(permutations([(1, a), (2, a), (2, b)]))[::3]:
        d = spark.createDataFrame(list(order), "doc_id long, text string").repartition(2)
        for keep in (near_copies.keep_one, simhash_dedup.keep_one):
            assert sorted(map(tuple, keep(d).collect())) == [(1, a), (2, b)]
    near = a + " more"
    d = spark.createDataFrame([(5, near), (5, a), (5, a), (7, a)], "doc_id long, text string")
    assert near_copies.keep_one(d).count() == 1
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, 1, id) AS doc_id", f"IF(id % 3 = 0, '{a}', concat('{b} ', id, ' ', id * 7, ' x', id * 31)) AS text")
    # All rows of the second text are near copies of each other, and both classes have the smallest id.
    assert sorted(r[0] for r in near_copies.keep_one(hot).collect()) == [1, 1]
