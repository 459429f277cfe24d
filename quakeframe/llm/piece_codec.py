"""SentencePiece models on the tokenizers library.

``Codec`` reads the model protobuf and rebuilds its parts with the ``tokenizers`` library: the normaliser (identity or
the model's character map), the metaspace marker with its dummy prefix, the pieces with their scores (a unigram model,
or the merges that a BPE model's scores imply) and byte fallback. Batches are encoded by the library's threads; each
distinct pre-token is encoded once per worker and the ids are put together by table. Decoding joins the bytes of the
pieces, a table from the same protobuf: the library's decoder gives the same texts but took twice the time of all else.
At start probe strings are encoded and decoded here and by SentencePiece, and in each worker the first texts of its own;
it refuses to work if an id or a character differs.

Edge cases: a null or empty text gives an empty id list and decodes to the empty text; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pretokens
from .token_counts import default_model, processor

#: Bytes that a worker's pre-tokens and their ids may take, bytes of an entry besides them, and the longest that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHE_PART = 1 << 26, 160, 256
#: Texts of its own that a worker holds against SentencePiece.
OWN_PROBES = 4
#: Pre-tokens that go to the library as one text.
CHUNK = 1024
#: Piece kinds of the model protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

PROBES = (
    "", " ", "   ", "\n", " \n ", "a", "Hello world", "  two  spaces ", "tab\there", "line\nfeed\n\nmore", "1234567890 3.14", "é ü ñ ß ç œ", "日本語 text",
    "\U0001f600 smile", "▁marker▁", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaa", "x" * 300, "foo.\nBar,baz;qux", " nbsp em", "กำ क्ष", "if (x == 1) {\n        return y;\n}",
)


def read_model(path: str) -> Any:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges_of(pieces: list[Any]) -> list[tuple[str, str]]:
    """Pairs of a BPE model in the order its scores imply: better pieces first, a piece's own splits by the ids of their halves."""
    ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
    found = []
    for p in pieces:
        if p.type == NORMAL:
            found += [(-p.score, ids[a], ids[b], a, b) for k in range(1, len(p.piece)) if (a := p.piece[:k]) in ids and (b := p.piece[k:]) in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Any) -> Any:
    """The ``tokenizers`` pipeline of a SentencePiece model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    trainer, norm, pieces = model.trainer_spec, model.normalizer_spec, model.pieces
    if trainer.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        core = models.BPE({p.piece: i for i, p in enumerate(pieces)}, merges_of(pieces), unk_token=trainer.unk_piece, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(pretokens.MARK)] * norm.add_dummy_prefix
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", pretokens.MARK)])
    tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{pretokens.MARK}+[^{pretokens.MARK}\n]*|\n+[^{pretokens.MARK}\n]*"), "isolated")
    return tok


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        model = read_model(path)
        norm = model.normalizer_spec
        self.tokenizer = build(model)
        self.prefix = norm.add_dummy_prefix
        #: The part table holds only where the text's own characters reach the model unchanged.
        self.by_part = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and self.prefix and pretokens.safe_model(p.piece for p in model.pieces if p.type != CONTROL)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(pretokens.MARK, " ").encode() for p in model.pieces]
        #: Bytes of a text that an id stands for; 0 where that is not fixed.
        self.widths = np.array([0 if p.type == UNKNOWN else len(x) for p, x in zip(model.pieces, self.bytes, strict=True)], np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.path, self.unchecked = path, OWN_PROBES
        # The library's unigram search matches byte and control pieces that a text spells out; SentencePiece does not.
        special = [re.escape(p.piece) for p in model.pieces if p.type in (BYTE, CONTROL, UNKNOWN)]
        self.literal = re.compile("|".join(special)) if special and model.trainer_spec.model_type == UNIGRAM else None
        self.verify(list(PROBES))

    def verify(self, texts: list[str]) -> None:
        """Compare ids and decoded texts with the SentencePiece library."""
        sp = processor(self.path)
        for text, ids in zip(texts, self.encode(texts), strict=True):
            if ids.tolist() != sp.encode(text) or self.decode([ids]) != [sp.decode(ids.tolist())]:
                raise ValueError(f"the tokenizers pipeline differs from SentencePiece on {text[:200]!r}")

    def verify_own(self, texts: list[str | None]) -> None:
        """Compare the first texts that come along."""
        own = [t for t in texts if t][: self.unchecked]
        if own:
            self.unchecked -= len(own)
            self.verify(own)

    def _library(self, texts: list[str]) -> list[list[int]]:
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spelled = [i for i, t in enumerate(texts) if self.literal.search(t)] if self.literal else []
        if spelled:
            for i, ids in zip(spelled, processor(self.path).encode([texts[i] for i in spelled]), strict=True):
                out[i] = ids
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens as int32 bytes: all go through the library as one text, whose ids are cut apart by the bytes that they stand for.

        A line feed before each keeps it apart from its neighbour and from the marker that the normaliser adds. Where an
        id's bytes are not fixed, or a border falls inside an id, each pre-token goes by itself.
        """
        ids = np.array(self._library(["".join(["\n" + p for p in parts])])[0], np.int32)
        widths = self.widths[ids]
        upto, ends = np.cumsum(widths), 1 + np.cumsum([1 + len(p.encode()) for p in parts])
        last = np.searchsorted(upto, ends)
        if widths.all() and upto[-1] == ends[-1] and (upto[last] == ends).all():
            return [ids[a + 2 : b + 1].tobytes() for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]
        return [np.array(x[2:], np.int32).tobytes() for x in self._library(["\n" + p for p in parts])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if not self.by_part:
            return [np.array(x, np.int32) for x in self._library([t or "" for t in texts])]
        parts = [pretokens.split(t) if t else [] for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p)
        if self.held > CACHE_BYTES:
            # Frequent pre-tokens come early, so the older half is the better one.
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2))
            self.held = sum(ENTRY_BYTES + len(p) + len(x) for p, x in self.cache.items())
        cache = self.cache
        new = [s for s in seen if s not in cache]
        for i in range(0, len(new), CHUNK):
            some = new[i : i + CHUNK]
            cache.update(zip(some, self._parts(some), strict=True))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, p)), np.int32) for p in parts]
        for p in new:
            if len(p) > CACHE_PART:
                del cache[p]
            else:
                self.held += ENTRY_BYTES + len(p) + len(cache[p])
        return out

    def decode(self, ids: list[Any]) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become the replacement character and control ids nothing, as in SentencePiece."""
        table = self.bytes
        out = []
        for x in ids:
            raw = b"".join(map(table.__getitem__, x.tolist() if isinstance(x, np.ndarray) else x))
            out.append((raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    return _with(docs, text, out, "array<int>", model_path or default_model(), lambda c, x: c.encode(x))


def decode(tokens: DataFrame, model_path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of a column of token ids."""
    return _with(tokens, ids, out, "string", model_path or default_model(), lambda c, x: c.decode([i or [] for i in x]))


def _with(df: DataFrame, column: str, out: str, kind: str, path: str, fn: Any) -> DataFrame:
    common.prepare(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` {kind}"])
    target, source = common.arrow_schema(df.sparkSession, ddl), df.columns.index(column)
    at = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(source).to_pylist()
            if kind != "string":
                codec(path).verify_own(given)
            made = pa.array(fn(codec(path), given), type=target.field(out).type)
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(target.field(n).type) for n, i in enumerate(at)), made], schema=target)

    return df.mapInArrow(run, ddl)


def round_trip(docs: DataFrame, model_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, ids, round_trip): the ids of each whole text, their digest as little-endian int32, and whether decoding gives the text back."""
    path = model_path or default_model()
    common.prepare(docs.sparkSession)
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, ids array<int>, round_trip boolean"
    target = common.arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, c = b.column(1).to_pylist(), codec(path)
            c.verify_own(texts)
            ids = c.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(target.field("ids").type)
            sha = [hashlib.sha256(flat[i:j].astype("<i4").tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            same = [d == (t or "") for d, t in zip(c.decode(ids), texts, strict=True)]
            yield common.record_batch({key: b.column(0), "n_tokens": sizes, "ids_sha256": sha, "ids": lists, "round_trip": same}, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
