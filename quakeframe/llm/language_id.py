"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from a bounded sample of its training texts. A text is
compressed block by block with every dictionary; the language whose dictionary gives the fewest bytes wins. The score
is the share of bytes by which it beats the runner-up, and a text whose score is below ``MIN_MARGIN`` is rejected as
too narrow (``accepted`` false), as is a text without letters.

The classifier is fitted on a bounded sample of labelled rows: of each language the ``SAMPLE_ROWS`` training rows with
the smallest hashes of key and text, and of each of them the ``SLICE_BYTES`` in its middle. One pass takes them all; each task
hands on that many rows a language at most.

Edge cases: a null text or one without a letter (Unicode category L) gives ``und``, score 0, not accepted; equal sizes
go to the name that sorts first; rows without a language are predicted but teach nothing; without any training row all
texts are ``und``; whole texts count, however long; repeated rows are predicted one by one; a null key counts as held
out; an empty table gives an empty result; columns named like a result are replaced, all others are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 40
SLICE_BYTES = 2048
BLOCK_BYTES = 1024
MIN_MARGIN = 0.002
#: Training rows are those whose key's crc32 leaves another remainder.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Labels that a model may have; each one costs a dictionary in every worker and a compression of every block.
MAX_LANGUAGES = 1024

_compressors: dict[str, dict[str, Any]] = {}


def compressors(dictionaries: dict[str, bytes], token: str) -> dict[str, Any]:
    """Compressors by language, prepared once per Python worker and model."""
    import zstandard as zs

    if token not in _compressors:
        _compressors.clear()
        params = zs.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = {}
        for lang, raw in dictionaries.items():
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made[lang] = zs.ZstdCompressor(dict_data=d, compression_params=params)
        _compressors[token] = made
    return _compressors[token]


def training_rows(key: str = "doc_id") -> Column:
    """Rows that a model may learn from."""
    return common.doc_crc(key) % FOLDS != HELD_OUT


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, key: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language, in the order of their names. ``docs`` are the training rows; more than ``MAX_LANGUAGES`` labels are an error."""
    raw = F.col(text).cast("binary")
    middle = raw.substr(F.greatest(F.lit(1), F.floor((F.octet_length(raw) - SLICE_BYTES) / 2).cast("int") + 1), F.lit(SLICE_BYTES))
    labelled = docs.filter(F.col(lang).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("h"), middle.alias("slice"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "slice"))
    found: dict[str, list[bytes]] = {}
    for r in labelled.withColumn("place", place).filter(F.col("place") <= rows).orderBy("lang", "place").toLocalIterator():
        found.setdefault(r["lang"], []).append(bytes(r["slice"]))
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang}")
    return {name: b"\n".join(slices) for name, slices in found.items()}


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return any(map(str.isalpha, text))


def sizes(text: str, by_lang: dict[str, Any]) -> dict[str, int]:
    """Compressed bytes of the whole text with each language's dictionary."""
    raw = text.encode()
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in by_lang.items()}


def classify(text: str | None, by_lang: dict[str, Any]) -> tuple[str, float]:
    """(language, margin); the order of ``by_lang`` settles ties."""
    if not text or not by_lang or not has_letter(text):
        return UNKNOWN, 0.0
    found = sizes(text, by_lang)
    best = min(found, key=found.__getitem__)
    others = [n for lang, n in found.items() if lang != best]
    return best, 1 - found[best] / min(others) if others else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted``."""
    common.prepare(docs.sparkSession)
    taken = {"lang_pred", "score", "accepted"}
    kept = [f for f in docs.schema.fields if f.name not in taken]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, accepted boolean"])
    target, at = common.arrow_schema(docs.sparkSession, ddl), docs.columns.index(text)
    shared, token = docs.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex
    places = [docs.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = compressors(shared.value, token)
        for b in batches:
            got = [classify(t, by_lang) for t in b.column(at).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] != UNKNOWN and g[1] >= min_margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(b.column(i) for i in places), *new], target, strict=True)], schema=target)

    return docs.mapInArrow(run, ddl)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    dictionaries = learn(docs.filter(training_rows()))
    held_out = F.coalesce(~training_rows(), F.lit(True)).alias("held_out")
    return identify(docs.select("doc_id", "text", held_out), dictionaries).drop("text")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
