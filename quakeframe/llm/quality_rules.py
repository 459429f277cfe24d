"""Quality rules by distribution divergence, in DataFrame functions alone.

One projection gives the counts of each text (words, symbols, repeated lines and words, character classes, common words
of its language). One small aggregation turns these counts into a reference per language, over all rows. A text whose
histograms lie too far from its language's reference in Jensen-Shannon distance is not kept; each histogram is only
judged when the text has enough words for it.

Edge cases: a null or empty text has zero words and fails the base rule; a text with a null or unlisted language is held
against every reference, the nearest of which counts, and has no common words of its own; repeated rows are judged one by one; texts of any length
are counted whole (all steps are sorts or single passes over one row's words); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANKS = r"[ \t-\r]+"
#: Common words by language: the bins of the word histogram.
COMMON: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"),
}
BINS = 16
#: Character classes as bracket expressions; all other code points are one more class.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[ \t-\r]", "stop": "[-.,;:!?'\"()]", "letter": "[\u00c0-\u024f]"}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Words that a text needs before a histogram counts, and the distances (0 to 1) beyond which it is not kept. On 1,000
#: documents, those of plain prose with so many words lie below 0.20 and 0.25, those full of symbols or without any
#: common word above 0.31 and 0.30.
GUARD_CLASSES, GUARD_COMMON = 50, 100
MAX_CLASSES, MAX_COMMON = 0.30, 0.28


def _let(value: Column, body: object) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more. ``hashes`` are the words' 64-bit hashes.

    Windows are sorted with their places; equal neighbours are repeats. Places then go back in order, and each adds the
    words that the place before has not covered.
    """
    n = F.size(hashes)
    windows = F.transform(F.slice(hashes, 1, n - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(hit, lambda x: x["i"]))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x))

    def judge(w: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(w, lambda x: x["h"])))
        return F.when(distinct == F.size(w), F.lit(0)).otherwise(_let(F.sort_array(w), covered))

    return F.when(n < 4, F.lit(0)).otherwise(_let(windows, judge)).cast("long")


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Counts of every row: (key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common).

    ``lang`` is empty where it is null or has no list of common words. ``classes`` ends with all other code points,
    ``common`` with all other words.
    """
    listed = F.create_map(*[c for k, v in COMMON.items() for c in (F.lit(k), F.array(*[F.lit(w) for w in v]))])[F.col("lang")]
    rows = docs.select(F.col(key), F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise(F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def of_words(s: Column) -> Column:
        places = F.array_remove(F.transform(s["w"], lambda x: F.array_position(s["l"], F.lower(x)).cast("int")), 0)
        return F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
            _let(F.transform(s["w"], lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"),
            _let(places, lambda p: F.concat(*[F.array(F.size(p) - F.size(F.array_remove(p, k))) for k in range(1, BINS + 1)], F.array(F.size(s["w"]) - F.size(p)))).alias("common"),
        )

    words = F.struct(F.array_remove(F.split("t", BLANKS), "").alias("w"), F.coalesce(listed, F.array().cast("array<string>")).alias("l"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = rows.select(
        key,
        "lang",
        *[F.regexp_count("t", F.lit(c)).alias(n) for n, c in CLASSES.items()],
        F.length("t").alias("n_all"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(words, of_words).alias("s"),
    )
    rest = F.col("n_all")
    for n in CLASSES:
        rest = rest - F.col(n)
    return counted.select(key, "lang", "s.n_words", "s.word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words", F.array(*CLASSES, rest).alias("classes"), "s.common")


def references(measured: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Shares of the classes and common words by language, over all rows; under the empty name those of all languages. At most one row a listed language reaches the driver."""
    sums = measured.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"classes{i}") for i in range(len(CLASSES) + 1)], *[F.sum(F.col("common")[i]).alias(f"common{i}") for i in range(BINS + 1)]).collect()
    found: dict[str, dict[str, list[float]]] = {}
    for name in (*COMMON, ""):
        own = [r for r in sums if r["lang"] == name or not name]
        found[name] = {}
        for h, n in (("classes", len(CLASSES) + 1), ("common", BINS + 1)):
            counts = [float(sum(r[f"{h}{i}"] for r in own)) for i in range(n)]
            found[name][h] = [c / max(sum(counts), 1.0) for c in counts]
    return found


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of counts and reference shares; 0 for empty counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(F.transform(counts, lambda x: x / total), shares, lambda p, q: (term(p, q) + term(q, p)) / 2)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))).otherwise(F.lit(0.0))


def judge(measured: DataFrame, shares: dict[str, dict[str, list[float]]]) -> DataFrame:
    """``measured`` with base_failed, the two distances and kept."""

    def nearest() -> Column:
        return F.least(*[distance(F.col("classes"), F.array(*[F.lit(x) for x in v["classes"]])) for v in shares.values()])

    def of(h: str) -> Column:
        return F.create_map(*[c for k, v in shares.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v[h]]))])[F.col("lang")]

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.withColumns({"base_failed": failed, "class_distance": F.when(F.col("lang") == "", nearest()).otherwise(distance(F.col("classes"), of("classes"))), "common_distance": F.when(F.col("lang") == "", F.lit(0.0)).otherwise(distance(F.col("common"), of("common")))})
    odd = ((F.col("n_words") >= GUARD_CLASSES) & (F.col("class_distance") > MAX_CLASSES)) | ((F.col("n_words") >= GUARD_COMMON) & (F.col("common_distance") > MAX_COMMON))
    return out.withColumn("kept", ~F.col("base_failed") & ~odd)


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Counts, distances and verdict of every row."""
    measured = common.cut(measure(docs, text, lang, key))
    return judge(measured, references(measured))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL for op10: the same counts by unnesting, the same references and distances."""
    lists = " UNION ALL ".join(f"SELECT '{k}' AS lang, {list(v)!r} AS l" for k, v in COMMON.items())
    classes = ["[^" + c[1:] for c in CLASSES.values()]

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    return f"""
WITH lists AS ({lists}),
d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN (SELECT lang FROM lists) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT d.*, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls, coalesce(l, []) AS l FROM d LEFT JOIN lists USING (lang)),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 list_transform([{", ".join(map(quoted, classes))}], lambda c: len(regexp_replace(t, c, '', 'g'))) AS c0, len(t) AS n_all,
 list_transform(l, lambda k: len(list_filter(w, lambda x: lower(x) = k))) AS k0
 FROM w LEFT JOIN rep USING (r)),
h AS (SELECT m.*, list_append(c0, n_all - list_sum(c0)) AS c, list_append(k0, n_words - coalesce(list_sum(k0), 0)) AS k FROM m),
lens AS (SELECT unnest(range(1, {max(len(classes) + 1, BINS + 1) + 1})) AS i),
refs AS (SELECT lang, list(c / ct ORDER BY i) FILTER (i <= {len(classes) + 1}) AS rc, list(k / kt ORDER BY i) FILTER (i <= {BINS + 1}) AS rk FROM (
 SELECT lang, i, c, k, greatest(1, sum(c) OVER (PARTITION BY lang)) AS ct, greatest(1, sum(k) OVER (PARTITION BY lang)) AS kt FROM (
  SELECT lang, i, sum(c[i])::DOUBLE AS c, sum(k[i])::DOUBLE AS k FROM (SELECT lang, c, k FROM h WHERE lang <> '' UNION ALL SELECT '', c, k FROM h), lens GROUP BY lang, i)) GROUP BY lang),
j AS (SELECT h.*, list_transform(list_zip(c, rc), lambda z: CASE WHEN n_all = 0 THEN 0 ELSE (CASE WHEN z[1] > 0 THEN z[1] / n_all * log2(2 * z[1] / n_all / (z[1] / n_all + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] / n_all + z[2])) ELSE 0 END) / 2 END) AS jc,
 list_transform(list_zip(k, rk), lambda z: CASE WHEN n_words = 0 THEN 0 ELSE (CASE WHEN z[1] > 0 THEN z[1] / n_words * log2(2 * z[1] / n_words / (z[1] / n_words + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] / n_words + z[2])) ELSE 0 END) / 2 END) AS jk FROM h JOIN (SELECT lang AS against, rc, rk FROM refs) ON against = lang OR lang = '' QUALIFY row_number() OVER (PARTITION BY r ORDER BY list_sum(jc), against) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_words >= {GUARD_CLASSES} AND sqrt(greatest(0, list_sum(jc))) > {MAX_CLASSES}) AND NOT (lang <> '' AND n_words >= {GUARD_COMMON} AND sqrt(greatest(0, list_sum(jk))) > {MAX_COMMON}) AS kept
FROM (SELECT j.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
""".strip()


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": oracle()}
