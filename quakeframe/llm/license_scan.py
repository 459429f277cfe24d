"""Licence detection by ordered signature rules.

Each text is lower-cased (A-Z) and cut into words. One automaton over the first words of all keywords tells which texts
to look at; a second one over the whole keywords gives the rules whose keyword stands there, and only their patterns
run, over the words joined by spaces. Overlaps are settled by intervals: a detection that lies inside one of a higher
rank, or inside a longer one of the same rank, is suppressed. Base phrases are kept whatever the rules say. The time
for a text is its length times the rules whose keywords it holds; suppression sorts.

Edge cases: a null or empty text has no words and no labels (empty strings, null positions, score 0); ties of rank and
interval go to the rule name that sorts first; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_rules import RULES, Rule

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that always count, with their labels.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

_IS_WORD = np.zeros(256, np.uint8)
_IS_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = 1


@dataclass(frozen=True)
class Detection:
    """A rule's match; ``start`` and ``end`` are word positions, end exclusive."""

    label: str
    rule: str
    priority: int
    start: int
    end: int


def lower(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(text: str) -> int:
    """Number of words, from the bytes alone: every byte of a non-ASCII character belongs to a word."""
    w = _IS_WORD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(w[0]) + int(np.count_nonzero(w[1:] > w[:-1])) if len(w) else 0


@lru_cache(1)
def _gate() -> object:
    """Automaton over the first words of the rules' keywords; a keyword's other words are looked up in the joined words."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k in sorted({k.split(" ")[0] for r in RULES for k in r.keywords} | {"license"}):
        found.add_word(k, k)
    found.make_automaton()
    return found


@lru_cache(4)
def _rule_gate(rules: tuple[Rule, ...]) -> object:
    """Automaton over the rules' whole keywords; each gives the places of its rules in ``rules``."""
    import ahocorasick

    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            by_keyword.setdefault(k, []).append(i)
    found = ahocorasick.Automaton()
    for k, own in by_keyword.items():
        found.add_word(k, tuple(own))
    found.make_automaton()
    return found


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that no stronger or longer one contains, by position.

    What a detection contains, its own container contains too, so one sweep over each rank and the furthest ends of the
    ranks above are enough.
    """
    kept: list[Detection] = []
    above: list[tuple[int, int]] = []
    for _, level in groupby(sorted(found, key=lambda d: (-d.priority, d.start, -d.end, d.rule)), key=lambda d: d.priority):
        starts, furthest = [s for s, _ in above], list(accumulate((e for _, e in above), max))
        last, own = -1, []
        for d in level:
            at = bisect_right(starts, d.start)
            if d.end > last and not (at and furthest[at - 1] >= d.end):
                own.append(d)
            last = max(last, d.end)
        kept += own
        above = sorted([*above, *((d.start, d.end) for d in own)])
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule))


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    return sorted((i + 1 - len(p), label) for i, w in enumerate(words) if w == "license" for p, label in BASE if i + 1 >= len(p) and tuple(words[i + 1 - len(p) : i + 1]) == p)


def detect(words: list[str], rules: tuple[Rule, ...] = RULES) -> list[Detection]:
    """All detections in a word list after suppression."""
    joined = " ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    found = []
    for i in sorted({i for _, own in _rule_gate(rules).iter(joined) for i in own}):
        r = rules[i]
        for m in r.pattern.finditer(joined):
            found.append(Detection(r.label, r.name, r.priority, bisect_right(ends, m.start()), bisect_right(ends, m.end() - 1) + 1))
    return suppress(found)


SPANS = "array<struct<label:string,rule:string,priority:int,start:long,end:long>>"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row."""
    common.prepare(docs.sparkSession)
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections {SPANS}"
    target = common.arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _gate()
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in target}
            for t in b.column(1).to_pylist():
                t = t or ""
                places: list[tuple[int, str]] = []
                found: list[Detection] = []
                if next(gate.iter(t.lower()), None):
                    words = WORD.findall(lower(t))
                    places, found = base_places(words), detect(words)
                base = {x for _, x in places}
                out["n_words"].append(count_words(t))
                out["n_base"].append(len(places))
                out["first_word"].append(places[0][0] if places else None)
                out["last_word"].append(places[-1][0] if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {d.label for d in found})))
                out["score"].append(max([d.priority / 100 for d in found] + [0.7] * bool(places), default=0.0))
                out["detections"].append([vars(d) for d in found])
            yield common.record_batch(out | {key: b.column(0)}, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
