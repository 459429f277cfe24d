"""Operators against brute force on small tables with awkward rows, and on the smallest driver table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quakeframe.llm import attention_model, decontaminate, golay, language_id, license_rules, license_scan, lm_score, phrase_repeats, piece_codec, quality_rules, secret_scan, simhash_dedup, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, edge_docs):
    cols = ["doc_id", "text", "lang"]
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*cols)
    return edge_docs.select(*cols).unionByName(real.withColumn("doc_id", real["doc_id"] + 100))


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_license_scan(docs):
    out = license_scan.scan(docs).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(out) == sum(texts.values())
    want = {}
    for (k, t), _ in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        joined = " " + "  ".join(words) + " "
        want[k] = (len(words), sum(joined.count(" " + "  ".join(p) + " ") for p, _ in license_scan.BASE))
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_base"]) for r in out)
    seven = next(r for r in out if r["doc_id"] == 7)
    assert (seven["first_word"], seven["last_word"], seven["base_labels"]) == (3, 8, "gpl,mit")
    assert {"mit", "gpl", "gpl-3.0"} <= set(seven["labels"].split(","))
    assert next(r for r in out if r["doc_id"] == 3)["labels"] == ""


def test_license_suppression():
    detect = lambda t: [d.label for d in license_scan.detect(license_scan.WORD.findall(license_scan.lower(t)))]
    assert len(license_rules.RULES) > 300
    assert detect("Licensed under the Apache License, Version 2.0") == ["apache-2.0"]
    assert detect("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert detect("GNU Lesser General Public License version 2.1") == ["lgpl-2.1"]
    assert detect("mit der Lizenz") == []


def test_language_id(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(real.select("doc_id", "text", "lang", (~language_id.training_rows()).alias("held")), language_id.learn(real.filter(language_id.training_rows()))).collect()
    held = [r for r in rows if r["held"]]
    assert {r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    edge = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert edge[3]["lang_pred"] == edge[4]["lang_pred"] == edge[6]["lang_pred"] == "und"
    assert edge[5]["lang_pred"] == "fr" and edge[1]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_language_id_by_plain_compression(docs):
    """Predictions and scores against block-by-block compression with the library alone; a tie goes to the first name."""
    import zstandard as zs

    model = language_id.learn(docs)
    params = zs.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    for r in language_id.identify(docs.select("doc_id", "text"), model).collect():
        raw = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        sizes = {}
        for lang, dictionary in model.items():
            d = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            c = zs.ZstdCompressor(dict_data=d, compression_params=params)
            sizes[lang] = sum(len(c.compress(raw[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(raw), language_id.BLOCK_BYTES))
        best = min(sorted(sizes), key=sizes.__getitem__)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - sizes[best] / min(n for k, n in sizes.items() if k != best))
    same = {"b": b"the same words", "a": b"the same words"}
    assert language_id.classify("the same words", language_id.compressors(dict(sorted(same.items())), "tie"))[0] == "a"
    assert language_id.has_letter("x²") and not any(map(language_id.has_letter, ("²½①", "12 ,.", "\U0001f600")))


def brute_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_scan(docs):
    model = secret_scan.learn(docs)
    want = {r["doc_id"]: brute_spans(r["text"] or "") for r in docs.collect()}
    for r in secret_scan.scan(docs, model).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["secrets"] if s["kind"] != "format"] == want[r["doc_id"]]
    clean = secret_scan.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(brute_spans(r["text"] or "") for r in clean.collect())


def test_secrets_without_their_names(spark):
    """Keys that no base pattern marks are found whole, in ordinary texts nearly nothing is."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secret_scan.learn(real)
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    clean = [t for _, t in rows if not brute_spans(t)]
    marked = [s for _, t in rows for s in secret_scan.find(t, model) if s[0] == "format"]
    assert sum(any(s[0] == "format" for s in secret_scan.find(t, model)) for t in clean) <= 0.02 * len(clean), marked[:5]
    held = sorted({m[3] for _, t in rows for m in secret_scan.base_matches(t.encode()) if m[0] == "assign" and len(m[3]) >= 16})[:200]
    found = [any(s <= 5 and e >= 5 + len(k) for _, s, e, _ in secret_scan.find(f"AWS= {k.decode()} end", model)) for k in held]
    assert held and sum(found) >= 0.8 * len(found)


def test_a_key_around_a_base_span_goes_whole():
    rng = np.random.default_rng(3)
    pick = lambda n: bytes(rng.choice(list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n).tolist())
    model = secret_scan.fit_model({"assign": [pick(60) for _ in range(400)]}, [bytes(rng.choice(list(b"etaoinshrdlu"), 14).tolist()) for _ in range(300)])
    key = (pick(22) + b"0123456789abcdef" + pick(22)).decode()
    spans = secret_scan.find(f"see {key} here", model)
    assert ("format", 4, 4 + len(key)) in {s[:3] for s in spans} and any(s[0] == "hex" for s in spans)


def test_automata_tell_formats_apart():
    rng = np.random.default_rng(1)
    pick = lambda a, n: bytes(rng.choice(list(a), n).tolist())
    keys = [b"AKIA" + pick(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(300)]
    hexes = [pick(b"0123456789abcdef", 40) for _ in range(300)]
    plain = [pick(b"etaoinshrdlu", 20) for _ in range(300)]
    m = secret_scan.fit_model({"access": keys[:250], "hex": hexes[:250]}, plain[:250])
    assert sum(m.likelihood(x) > m.margin for x in keys[250:] + hexes[250:]) > 90
    assert not any(m.likelihood(x) > m.margin for x in plain[250:])


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_token_counts(docs, library):
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect()), key=repr)
    assert by_row(token_counts.count_tokens(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert by_row(token_counts.count_tokens(docs, table={}), "doc_id", "n_bytes", "n_tokens") == want


def test_piece_codec(docs, library):
    want = {(r["doc_id"], r["text"]): library.encode(r["text"] or "") for r in docs.collect()}
    texts = {k: t for k, t in want}
    rows = piece_codec.round_trip(docs).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        assert list(r["ids"]) == want[r["doc_id"], t]
        assert r["round_trip"] == (library.decode(want[r["doc_id"], t]) == (t or ""))
    again = piece_codec.decode(piece_codec.encode(docs.select("doc_id", "text")).drop("text")).collect()
    assert all(r["text"] == library.decode(want[r["doc_id"], texts[r["doc_id"]]]) for r in again)


def test_lm_score(docs):
    rows = lm_score.score(docs).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    src = docs.collect()
    c = Counter(w for r in src if not held(r["doc_id"]) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    want = {r["doc_id"]: r["text"] for r in src}
    assert len(rows) == len(src)
    for r in rows:
        w = words(want[r["doc_id"]])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0


def small_model(rng, size=40):
    first = np.arange(size) % 2 == 0
    tree = attention_model.build_tree(np.where(first, 0, 16) + np.arange(size) % 5, first, rng.poisson(3, (attention_model.FAN, size)).astype(float))
    return attention_model.Model(tree, attention_model.Network.start(size).matrix)


def test_attention_probabilities():
    """Ids' probabilities sum to one, sequences do not touch each other, and long ones are scored window by window."""
    rng = np.random.default_rng(0)
    m = small_model(rng)
    m.matrix[:] = rng.standard_normal(m.matrix.shape) * 0.3
    one = lambda *x: attention_model.score(m, np.concatenate(x), np.array([len(y) for y in x]))
    context = rng.integers(0, 40, 30)
    step = one(*[np.append(context, i) for i in range(40)]) - one(context)[0]
    assert (10.0**step).sum() == pytest.approx(1, abs=1e-3)
    other = rng.integers(0, 40, 7)
    together = one(other, np.empty(0, np.int64), context)
    assert together[1] == 0 and together[2] == pytest.approx(one(context)[0], rel=1e-5) and together[0] == pytest.approx(one(other)[0], rel=1e-5)
    # Changing an id leaves all that stands before it as it is.
    changed = context.copy()
    changed[20] = (changed[20] + 1) % 40
    assert one(context[:20])[0] == pytest.approx(one(changed[:20])[0])


def test_attention_gradient_and_training():
    rng = np.random.default_rng(1)
    m = small_model(rng)
    m = attention_model.Model(m.tree, rng.standard_normal(m.matrix.shape) * 0.3)
    w = rng.integers(0, 40, (4, attention_model.WINDOW + 1))
    w[0, 9:] = -1
    _, g = attention_model.gradient(m, w)
    for _ in range(30):
        i, j = rng.integers(0, len(m.matrix)), rng.integers(0, attention_model.WIDTH)
        ends = []
        for e in (1e-4, -1e-4):
            moved = m.matrix.copy()
            moved[i, j] += e
            ends.append(attention_model.gradient(attention_model.Model(m.tree, moved), w)[0])
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[i, j], abs=1e-4)
    start = small_model(rng)
    a = rng.integers(0, 13, (400, 6))
    runs = np.stack([a, a + 13, a + 26], axis=2).reshape(400, -1)[:, : attention_model.WINDOW + 1]
    before = attention_model.gradient(start, runs)[0]
    change, weight = attention_model.train(start, runs, 120, 64)
    assert attention_model.gradient(attention_model.Model(start.tree, start.matrix + change), runs)[0] < 0.8 * before and weight.min() >= 0


def test_attention_large_scores():
    """Scores far beyond the range of plain exponentials are not cut: probabilities are those of a softmax in double precision."""
    rng = np.random.default_rng(2)
    m = small_model(rng)
    m.matrix[:] = rng.standard_normal(m.matrix.shape) * 3
    ids = rng.integers(0, 40, 14)
    tree, net = m.tree, attention_model.Network(m.matrix.astype(float), 40)
    before = np.array([attention_model.START, *ids[:-1]])
    x = net.embed[before] + net.place[:14]
    q, k, v = np.split(x @ net.qkv, 3, axis=1)
    log_softmax = lambda z: z - z.max(-1, keepdims=True) - np.log(np.exp(z - z.max(-1, keepdims=True)).sum(-1, keepdims=True))
    a = np.exp(log_softmax(np.where(np.tri(14) > 0, q @ k.T * attention_model.WIDTH**-0.5, -np.inf)))
    want, top = 0.0, 0.0
    for h, i, last in zip(x + a @ v @ net.out, ids, tree.classes[before], strict=True):
        leaf, c = tree.leaf[i], tree.classes[i]
        f, e = tree.first[leaf], tree.first[leaf + 1]
        one, two, three = h @ net.head + tree.classes_log, h @ net.groups[c] + tree.groups_log[last, c], net.ids[f:e] @ h + tree.ids_log[last, f:e]
        top = max(top, one.max(), two.max(), three.max())
        want += log_softmax(one)[c] + log_softmax(two)[leaf % attention_model.FAN] + log_softmax(three)[tree.place[i] - f]
    assert top > 100
    assert attention_model.score(m, ids, np.array([14]))[0] == pytest.approx(want / math.log(10), rel=1e-3)


def test_training_moves_only_rows_that_windows_touch():
    rng = np.random.default_rng(3)
    start = small_model(rng)
    w = rng.integers(0, 20, (64, attention_model.WINDOW + 1))
    w[0, 5:] = -1
    change, weight = attention_model.train(start, w, 12, 32)
    _, g = attention_model.gradient(start, w)
    assert not change[weight == 0].any() and not g[weight == 0].any() and (weight == 0).any() and change[weight > 0].any()


def test_network_beats_its_counts(spark):
    """Held-out texts: the trained network against the same tree with a network of zeros."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    training, path = real.filter(~lm_score.held_out()), token_counts.default_model()
    counts = lm_score.word_counts(training).cache()
    lexicon = lm_score.Lexicon(lm_score.hot_words(counts), 1, 1, path)
    windows = lm_score.windows_of(training, "test", spark.sparkContext.broadcast(lexicon)).cache()
    assert windows.count() >= training.count() * 0.9
    model = lm_score.fit(windows, counts, path)
    lists = [lm_score.words_of(r["text"]) for r in real.filter(lm_score.held_out()).collect()]
    _, ids, sizes = lm_score.Reader(lexicon).read(lists)
    n = np.array([len(x) for x in lists])
    lengths = np.add.reduceat(sizes, np.cumsum(n) - n)
    trained, plain = (attention_model.score(x, ids.astype(np.int64), lengths).sum() / len(ids) for x in (model, attention_model.Model(model.tree, np.zeros_like(model.matrix))))
    assert trained > plain + 0.1


def test_network_learns_from_every_id(spark, library):
    """Long, short and empty training texts: all their ids are predicted once, and each window has its turn in one round."""
    texts = ["the river runs past the mill " * 2000 + "zzqx end", "", None, "a", "the old mill and the river " * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    lexicon = lm_score.Lexicon({b"the": 3, b"river": 1}, 4, 2, token_counts.default_model())
    rows = lm_score.windows_of(docs, "every", spark.sparkContext.broadcast(lexicon)).collect()
    seen = Counter()
    for r in rows:
        w = np.frombuffer(r["ids"], np.int32).reshape(-1, attention_model.WINDOW + 1)
        seen.update(w[:, 1:][w[:, 1:] >= 0].tolist())
    want = Counter(i for t in texts for w in lm_score.words_of(t) for i in ([lm_score.END_ID] if w == lm_score.END else library.encode(w.decode())))
    assert seen == want
    long = {r["part"]: len(r["ids"]) for r in rows if len(r["ids"]) > 10_000}
    assert sorted(long) == list(range(lm_score.ROUNDS)) and len({x // 200 for x in long.values()}) <= 2
    cut, number = lm_score.windows(np.arange(5, 45), np.array([40, 0]))
    assert number.tolist() == [3, 0] and cut[0].tolist() == [attention_model.START, *range(5, 21)] and cut[2].tolist() == [36, *range(37, 45), *[-1] * 8]


def test_trainers_grow_with_the_windows(spark, monkeypatch):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts, path, asked = lm_score.word_counts(real), token_counts.default_model(), []
    lexicon = lm_score.Lexicon({b"the": 1}, 1, 1, path)
    windows = lm_score.windows_of(real, "growth", spark.sparkContext.broadcast(lexicon)).cache()
    monkeypatch.setattr(lm_score, "TRAINER", 1000)
    monkeypatch.setattr(lm_score, "averaged", lambda w, model, trainers, turn: asked.append((trainers, turn)) or model.matrix)
    lm_score.fit(windows, counts, path)
    n = sum(len(r["ids"]) for r in windows.collect()) // 4 // (attention_model.WINDOW + 1)
    assert n > 3000 and [t for _, t in asked] == list(range(lm_score.ROUNDS)) and all(0.8 * n <= 1000 * t <= 1.2 * n for t, _ in asked)


def test_reader_gives_the_library_ids(library):
    texts = ["the river runs", "", "zzqx ééé the", "a" * 300 + " b"]
    lists = [lm_score.words_of(t) for t in texts]
    lexicon = lm_score.Lexicon({b"the": 3, b"river": 1}, 4, 2, token_counts.default_model())
    at, ids, sizes = lm_score.Reader(lexicon).read(lists)
    flat = [w for x in lists for w in x]
    want = [[lm_score.END_ID] if w == lm_score.END else library.encode(w.decode()) for w in flat]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [flat[i] for i in np.nonzero(at >= 0)[0]] == [b"the", b"river", b"the"]


def brute_classes(rows):
    prints = [simhash_dedup.fingerprint(t) & (2**64 - 1) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, f"{prints[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def test_simhash_dedup(docs):
    out = simhash_dedup.classes(docs).select("doc_id", simhash_dedup.hexadecimal().alias("f"), "component_id")
    assert by_row(out, "doc_id", "f", "component_id") == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    names = {c for _, _, c in brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(n for n in names if n is not None)


def test_fingerprint_links_in_crowded_keys(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ (1 << int(b)) for b in range(30)} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    edges = {(r["a"], r["b"]) for r in simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for a, b in edges:
        assert ((a ^ b) & mask).bit_count() <= 2
        parent[max(find(a), find(b))] = min(find(a), find(b))
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & mask).bit_count() <= 2:
                assert find(a) == find(b)


def test_golay_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    place, code = golay.nearby(words, 3)
    assert place.tolist() == list(range(5000)) and code.max() < 4096


def test_decontaminate(spark, docs):
    text = docs.filter("doc_id = 105").first()["text"].split()
    items = [(1, " ".join(text[10:40])), (1, " ".join(text[10:40])), (2, " ".join([*text[50:70], "never", *text[71:90]])), (3, "quick BROWN fox"), (4, None), (5, "   "), (6, "words that stand nowhere at all in these texts of ours"), (None, " ".join(text[5:25]))]
    found = decontaminate.search(docs, spark.createDataFrame(items, "item_id long, text string"))

    def grams(t, n):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    want = []
    for r in docs.collect():
        for k, t in set(items):
            n = min(5, len((t or "").split()))
            if n:
                q = grams(t, n)
                shared = len(q & grams(r["text"], n))
                if shared >= math.ceil(0.8 * len(q) - 1e-9):
                    want.append((r["doc_id"], k, shared, len(q)))
    assert by_row(found, "doc_id", "item_id", "n_shared", "n_item") == sorted(want, key=repr) and want
    clean = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in {w[0] for w in want})


def brute_repeats(rows, n=phrase_repeats.LENGTH):
    raw = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    want = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        want.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(want, key=repr)


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_phrase_repeats(docs):
    assert by_row(phrase_repeats.dedup(docs), *REPEATS) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_phrase_repeats_of_awkward_texts(spark):
    """Thue-Morse middles (on which sums modulo a power of two collide), runs, periods, edges at every offset, passages below the length."""
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    head, tail, passage = word(840), word(840), word(900)
    rows = [(1, head + a + tail), (2, head + b + tail), (3, "x" * 1500), (4, "abc" * 500), (5, word(100) + "x" * 450 + word(30))]
    rows += [(10 + i, word(37 * i) + passage[i * 11 :] + word(50 + i)) for i in range(30)]
    rows += [(50, word(500)), (51, word(20) + passage[:399] + word(300)), (52, word(333)), (53, None), (54, "")]
    short = word(320)
    rows += [(60, word(100) + short + word(100)), (61, short + word(50)), (62, "é" * 300), (63, word(1) + "é" * 300)]
    out = phrase_repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert by_row(out, *REPEATS) == brute_repeats(rows)
    shared = {r["doc_id"]: r["passage"] for r in out.collect()}
    assert shared[60] and shared[61] and shared[51] and not any(shared[k] for k in (50, 52, 53, 54))
    for m, n in ((1, 5), (3, 700)):
        raw = word(phrase_repeats.PASSAGE + n).encode()
        place, lo, hi = phrase_repeats.triggers(raw)
        assert lo[0] == 0 and hi[-1] == n and (lo[1:] == hi[:-1] + 1).all() and (place >= hi).all() and (place - lo < phrase_repeats.WINDOW).all()


def test_quality_rules(docs):
    out = quality_rules.assess(docs)
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        rep = len({j for i, g in enumerate(tri) if c[g] > 1 for j in (i, i + 1, i + 2)})
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert by_row(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_quality_rule_rejects(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang = 'en'")
    rng = np.random.default_rng(7)
    nonsense = " ".join("".join(rng.choice(list("etaoinshrdlu"), 7)) for _ in range(300))
    symbols = " ".join("".join(rng.choice(list("#$%&*"), 4)) + "the" for _ in range(300))
    plain = max((r["text"] for r in real.filter("doc_id % 7 = 3").collect()), key=lambda t: t.count(" the "))
    extra = spark.createDataFrame([(10**6, nonsense, "en"), (10**6 + 1, symbols, "en"), (10**6 + 2, symbols, None), (10**6 + 3, plain, None)], real.schema)
    got = {r["doc_id"]: r for r in quality_rules.assess(real.unionByName(extra)).filter("doc_id >= 1000000").collect()}
    words, marks, bare, good = (got[10**6 + i] for i in range(4))
    assert words["common_distance"] > quality_rules.MAX_COMMON and words["class_distance"] < quality_rules.MAX_CLASSES and not words["kept"]
    assert marks["class_distance"] > quality_rules.MAX_CLASSES and not marks["kept"] and not bare["kept"]
    assert good["class_distance"] < 0.2 and good["kept"] == (not good["base_failed"])


def test_unigram_models(tmp_path):
    """The unigram branch of the codec on a small model made here, against SentencePiece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = piece_codec.UNIGRAM, True, 0
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for piece, score, kind in [("<unk>", 0, piece_codec.UNKNOWN), ("<s>", 0, piece_codec.CONTROL), ("</s>", 0, piece_codec.CONTROL), *[(f"<0x{i:02X}>", 0, piece_codec.BYTE) for i in range(256)], *[(p, -i - 1.5, piece_codec.NORMAL) for i, p in enumerate(["▁", "▁the", "e", "t", "h", "▁r", "iver", "i", "v", "r", "he", "▁ri", "ver", "n", "s", "run"])]]:
        x = model.pieces.add()
        x.piece, x.score, x.type = piece, score, kind
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    codec = piece_codec.Codec(str(path))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the river runs", "", "  the  the", "rivers é \n the"]
    assert [x.tolist() for x in codec.encode(texts)] == [sp.encode(t) for t in texts] and codec.decode(codec.encode(texts)) == [sp.decode(sp.encode(t)) for t in texts]


def test_size_partitions_miss_nothing():
    """Sketches of every size: a document that lacks as many shingles as a leak may is still a candidate."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7, 8, 15, 16, 31, 32, 40, 64, 130):
        words = [f"w{i}" for i in range(n + 4)]
        x = decontaminate.item(n, " ".join(words))
        assert len(x.grams) == n and len(x.sketch) == decontaminate.sketch_size(n) <= n
        index = decontaminate.Index([x])
        grams = sorted(x.grams)
        for _ in range(20):
            kept = rng.permutation(n)[: decontaminate.needed(n)]
            text = b" zz qq yy xx vv ".join(grams[i] for i in kept).decode()
            assert [i for i, _ in index.leaks(text)] == [0]


def test_search_with_one_name_for_both_keys(spark):
    words = " ".join(f"w{i}" for i in range(40))
    found = decontaminate.search(spark.createDataFrame([(1, words)], "id long, text string"), spark.createDataFrame([(7, words)], "id long, text string"), key="id", item_key="id")
    assert [(r["id"], r["item_id"]) for r in found.collect()] == [(1, 7)]


def test_extra_and_clashing_columns(edge_docs):
    assert edge_docs.count() == license_scan.scan(edge_docs).count() == token_counts.count_tokens(edge_docs).count() == quality_rules.assess(edge_docs).count()
    assert edge_docs.count() == language_id.identify(edge_docs, language_id.learn(edge_docs)).count() == simhash_dedup.classes(edge_docs).count()
    assert edge_docs.count() == piece_codec.encode(edge_docs).count() == secret_scan.scan(edge_docs).count() == phrase_repeats.dedup(edge_docs).count() == lm_score.score(edge_docs).count()


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (license_scan.scan(no_docs), language_id.identify(no_docs, language_id.learn(no_docs)), secret_scan.scan(no_docs), token_counts.count_tokens(no_docs), lm_score.score(no_docs), simhash_dedup.classes(no_docs), simhash_dedup.keep_one(no_docs), decontaminate.search(no_docs, items), decontaminate.clean(no_docs, items), piece_codec.round_trip(no_docs), phrase_repeats.dedup(no_docs), quality_rules.assess(no_docs), secret_scan.redact(no_docs)):
        assert df.count() == 0
