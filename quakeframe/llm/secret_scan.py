"""Secret detection by probabilistic automata inferred from labelled credentials.

Base patterns label credentials of three kinds. For each kind a prefix tree of the credentials is folded into a
probabilistic automaton: two states merge where a Hoeffding bound cannot tell their outgoing and ending frequencies
apart, all the way down their subtrees. Every candidate of a text, a run of ``MIN_CANDIDATE`` or more token characters,
then gets its log likelihood under each automaton, less that under a chain learned from ordinary tokens; so do its ends
after ``=`` or ``/``, and the best of them counts. Candidates that look clearly more like a credential are added to the
base spans, unless these cover them already; one that only holds a base span is added whole.

The classifier is fitted on bounded samples of labelled strings: ``MAX_CREDENTIALS`` distinct credentials of each kind and
``MAX_ORDINARY`` distinct ordinary tokens from all rows, those with the smallest hashes, each whole and of ``MAX_LEARNED``
bytes at most. Candidates of any length are scored.

Edge cases: a null or empty text has no spans (counts 0, empty strings); a table without credentials keeps the base
patterns and adds nothing; of spans with one start, the base kinds come first; repeated rows are scanned one by one; an
empty table gives an empty result; positions are code points, end exclusive; other columns are not read (``redact``
keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_CREDENTIALS = 2000
MAX_ORDINARY = 4000
MAX_LEARNED = 512
MIN_CANDIDATE = 12
#: Bytes of tokens whose likelihoods a worker keeps, and the longest token that it keeps.
CACHE_BYTES, CACHE_TOKEN = 1 << 22, 64
#: Confidence of the merge test, and the state count below which a test has no power.
ALPHA = 0.05
MIN_STATE = 20
#: Nats per symbol by which an automaton must beat the chain of ordinary tokens.
MIN_MARGIN = 0.35

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(rb"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)
_SEPARATOR = re.compile(rb"[=/]+")
_KEYS = (b"passw", b"secret", b"token", b"api")

#: The automata's alphabet.
SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
END = 0

Span = tuple[str, int, int]


def base_matches(raw: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, credential) of the base patterns, in bytes; each kind leftmost and without overlaps."""
    found = []
    low = raw.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in _ASSIGN.finditer(raw) if len(m.group(2)) >= 12]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end(), m.group()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), m.group()) for m in _HEX.finditer(raw)]
    return found


def candidates(raw: bytes) -> list[tuple[int, int, bytes]]:
    """All tokens long enough to be a credential, by start."""
    return [(m.start(), m.end(), m.group()) for m in _CANDIDATE.finditer(raw)]


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals that the spans cover, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@dataclass
class Automaton:
    """A probabilistic automaton: ``arcs[q][symbol]`` is (next state, log probability), ``ends[q]`` the log probability to stop."""

    arcs: list[dict[int, tuple[int, float]]]
    ends: list[float]
    #: Log probability of what was never seen in a state.
    unseen: float = math.log(1e-4)

    def score(self, token: bytes) -> float:
        """Log likelihood of a token."""
        q, total = 0, 0.0
        for s in token:
            step = self.arcs[q].get(s) if q >= 0 else None
            if step is None:
                total += self.unseen
                q = -1 if q < 0 or not self.arcs[q] else q
            else:
                q, p = step
                total += p
        return total + (self.ends[q] if q >= 0 else self.unseen)

    def score_ends(self, token: bytes, places: list[int]) -> list[float]:
        """Log likelihoods of what follows each place of a token, in one pass.

        A run of the automaton begins at each place. Runs that meet in a state go on together: they keep what they
        differ by, the smaller group joining the larger one, so a step costs as much as there are states in use.
        """
        begin = {p: i for i, p in enumerate(places)}
        groups: dict[int, list] = {}  # state: [total, [(run, what it had before)]]
        arcs, unseen = self.arcs, self.unseen
        for at, s in enumerate(token):
            if at in begin:
                own = groups.setdefault(0, [0.0, []])
                own[1].append((begin[at], -own[0]))
            if len(groups) == 1:
                ((q, own),) = groups.items()
                step = arcs[q].get(s) if q >= 0 else None
                if step is not None:
                    own[0] += step[1]
                    if step[0] != q:
                        groups = {step[0]: own}
                    continue
            moved: dict[int, list] = {}
            for q, own in groups.items():
                step = arcs[q].get(s) if q >= 0 else None
                if step is None:
                    own[0] += unseen
                    q = -1 if q < 0 or not arcs[q] else q
                else:
                    q = step[0]
                    own[0] += step[1]
                there = moved.get(q)
                if there is None:
                    moved[q] = own
                else:
                    large, small = (there, own) if len(there[1]) >= len(own[1]) else (own, there)
                    shift = small[0] - large[0]
                    large[1].extend((run, had + shift) for run, had in small[1])
                    moved[q] = large
            groups = moved
        out = [0.0] * len(places)
        for q, (total, runs) in groups.items():
            last = self.ends[q] if q >= 0 else unseen
            for run, had in runs:
                out[run] = total + had + last
        return out


@dataclass
class _Tree:
    """Prefix tree with visit and end counts; ``merge`` folds states together in place."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    arcs: list[Counter] = field(default_factory=lambda: [Counter()])
    ends: list[int] = field(default_factory=lambda: [0])

    def add(self, token: bytes, n: int) -> None:
        q = 0
        for s in token:
            self.arcs[q][s] += n
            if s not in self.next[q]:
                self.next[q][s] = len(self.next)
                self.next.append({})
                self.arcs.append(Counter())
                self.ends.append(0)
            q = self.next[q][s]
        self.ends[q] += n

    def count(self, q: int) -> int:
        return self.ends[q] + sum(self.arcs[q].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding test of two states and, in step, of their successors."""
        root = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.count(x), self.count(y)
            if n == 0 or m == 0 or x == y:
                continue
            bound = root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for s in self.arcs[x].keys() | self.arcs[y].keys():
                if abs(self.arcs[x][s] / n - self.arcs[y][s] / m) > bound:
                    return False
            if min(n, m) >= MIN_STATE:
                todo += [(self.next[x][s], self.next[y][s]) for s in self.next[x].keys() & self.next[y].keys()]
        return True

    def merge(self, red: int, blue: int) -> None:
        """Add the subtree of ``blue``, a tree still, to ``red``."""
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.arcs[x].update(self.arcs[y])
            for s, z in self.next[y].items():
                if s in self.next[x]:
                    todo.append((self.next[x][s], z))
                else:
                    self.next[x][s] = z


def infer(samples: dict[bytes, int], alpha: float = ALPHA) -> Automaton:
    """Fold the prefix tree of counted tokens into a probabilistic automaton."""
    tree = _Tree()
    for s in sorted(samples):
        tree.add(s, samples[s])
    red, fringe = [0], [(0, s) for s in sorted(tree.next[0])]
    while fringe:
        fringe.sort(key=lambda x: (-tree.count(tree.next[x[0]][x[1]]), x))
        q, s = fringe.pop(0)
        blue = tree.next[q][s]
        if blue in red:
            continue
        # Too rare to tell apart from anything: such a state joins the most visited one that does not contradict it.
        partner = next((r for r in red if tree.compatible(r, blue, alpha)), None)
        if partner is None:
            red.append(blue)
        else:
            tree.next[q][s] = partner
            tree.merge(partner, blue)
        known = set(red)
        fringe = [(r, s) for r in red for s in tree.next[r] if tree.next[r][s] not in known]
    at = {r: i for i, r in enumerate(red)}
    arcs, ends = [], []
    for r in red:
        total = tree.count(r) + 1e-2 * (len(SYMBOLS) + 1)
        arcs.append({s: (at[tree.next[r][s]], math.log((n + 1e-2) / total)) for s, n in tree.arcs[r].items() if s in tree.next[r]})
        ends.append(math.log((tree.ends[r] + 1e-2) / total))
    return Automaton(arcs, ends)


@dataclass
class Model:
    """Automata of the credential kinds, the chain of ordinary tokens and the margin that a candidate must reach."""

    automata: dict[str, Automaton]
    ordinary: dict[tuple[int, int], float]
    margin: float = MIN_MARGIN

    def background(self, token: bytes) -> float:
        total, last = 0.0, END
        for s in [*token, END]:
            total += self.ordinary.get((last, s), math.log(1e-3))
            last = s
        return total

    def likelihood(self, token: bytes) -> float:
        """Nats per symbol by which the best automaton explains the token better than the chain does."""
        if not self.automata:
            return -math.inf
        return (max(a.score(token) for a in self.automata.values()) - self.background(token)) / (len(token) + 1)

    def backgrounds(self, token: bytes, places: list[int]) -> list[float]:
        """``background`` of what follows each place, in one pass from the end."""
        rare, wanted, found = math.log(1e-3), set(places), {}
        total, after = 0.0, END
        for at in range(len(token) - 1, -1, -1):
            s = token[at]
            total += self.ordinary.get((s, after), rare)
            after = s
            if at in wanted:
                found[at] = total + self.ordinary.get((END, s), rare)
        return [found[p] for p in places]

    def best_end(self, token: bytes) -> tuple[int, float]:
        """(offset, likelihood) of the token's end that looks most like a credential: the token itself or what follows one of its separators. Linear in the token, however many separators it has."""
        places = [0, *(m.end() for m in _SEPARATOR.finditer(token) if len(token) - m.end() >= MIN_CANDIDATE)]
        if len(places) == 1 or not self.automata:
            return 0, self.likelihood(token)
        best = map(max, zip(*(a.score_ends(token, places) for a in self.automata.values()), strict=True))
        gains = [(x - y) / (len(token) - p + 1) for x, y, p in zip(best, self.backgrounds(token, places), places, strict=True)]
        at = max(range(len(places)), key=lambda i: (gains[i], -i))
        return places[at], gains[at]


def fit_model(credentials: dict[str, list[bytes]], ordinary: list[bytes]) -> Model:
    """Automata from labelled credentials by kind; the margin lets the weakest hundredth of them go."""
    automata = {k: infer(Counter(values)) for k, values in sorted(credentials.items()) if len(values) >= MIN_STATE}
    pairs: Counter = Counter()
    for t in ordinary:
        pairs.update(zip([END, *t], [*t, END], strict=True))
    starts: Counter = Counter()
    for (a, _), n in pairs.items():
        starts[a] += n
    chain = {(a, b): math.log((pairs[a, b] + 0.1) / (starts[a] + 0.1 * (len(SYMBOLS) + 1))) for a in [END, *SYMBOLS] for b in [END, *SYMBOLS]}
    model = Model(automata, chain)
    scores = sorted(model.likelihood(v) for k in automata for v in credentials[k] if len(v) >= MIN_CANDIDATE)
    model.margin = max(MIN_MARGIN, scores[len(scores) // 100] if scores else MIN_MARGIN)
    return model


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Fit the model on bounded, hash-chosen samples of the table's own labelled credentials and ordinary tokens."""
    common.prepare(docs.sparkSession)
    target = common.arrow_schema(docs.sparkSession, "kind string, value string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for t in b.column(0).to_pylist():
                raw = t.encode()
                found = base_matches(raw)
                rows.update((k, v.decode()) for k, _, _, v in found if len(v) <= MAX_LEARNED)
                taken = united((s, e) for _, s, e, _ in found)
                starts = [s for s, _ in taken]
                for s, e, v in candidates(raw):
                    at = bisect_left(starts, e)
                    if len(v) <= MAX_LEARNED and not (at and taken[at - 1][1] > s):
                        rows.add(("ordinary", v.decode()))
            kinds, values = zip(*sorted(rows), strict=True) if rows else ((), ())
            yield common.record_batch({"kind": kinds, "value": values}, target)

    with common.Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "kind string, value string").distinct(), "strings")
        taken = {k: [r["value"].encode() for r in common.row_count_sample(found.filter(F.col("kind") == k), F.col("value"), n).collect()] for k, n in (*((k, MAX_CREDENTIALS) for k in KINDS[:3]), ("ordinary", MAX_ORDINARY))}
    plain = taken.pop("ordinary")
    return fit_model({k: v for k, v in taken.items() if v}, plain)


class Finder:
    """A model with a worker's likelihoods of short tokens."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.held = model, {}, 0

    def best_end(self, token: bytes) -> tuple[int, float]:
        if len(token) > CACHE_TOKEN:
            return self.model.best_end(token)
        if token not in self.known:
            if self.held > CACHE_BYTES:
                self.known, self.held = {}, 0
            self.known[token] = self.model.best_end(token)
            self.held += len(token)
        return self.known[token]

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, score) of all secrets in a text, by start and then kind; positions in code points."""
        raw = text.encode()
        base = base_matches(raw)
        spans = [(k, s, e, 1.0) for k, s, e, _ in base]
        taken = united((s, e) for _, s, e, _ in base)
        starts = [s for s, _ in taken]
        for s, e, token in candidates(raw):
            skip, gain = self.best_end(token)
            at = bisect_right(starts, s + skip)
            if gain >= self.model.margin and not (at and taken[at - 1][1] >= e):
                spans.append(("format", s + skip, e, 1 - math.exp(-gain)))
        spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        if len(raw) == len(text):
            return spans
        places = sorted({p for _, s, e, _ in spans for p in (s, e)})
        at, chars, to = 0, 0, {}
        for p in places:
            chars += len(raw[at:p].decode())
            at = p
            to[p] = chars
        return [(k, to[s], to[e], p) for k, s, e, p in spans]


def find(text: str, model: Model) -> list[tuple[str, int, int, float]]:
    """The secrets of one text."""
    return Finder(model).find(text)


_finders: dict[str, Finder] = {}


def _finder(token: str, shared: Any) -> Finder:
    """The finder of a broadcast model, one for each Python worker."""
    if token not in _finders:
        _finders.clear()
        _finders[token] = Finder(shared.value)
    return _finders[token]


def joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scan(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, secrets) with the spans found in every row."""
    common.prepare(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(model or learn(docs, text)), uuid.uuid4().hex
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, secrets {SPANS}"
    target = common.arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(token, shared)
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in finder.find(t)] if t else [] for t in b.column(1).to_pylist()]
            yield common.record_batch({key: b.column(0), "secrets": rows}, target)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl)


def redact(docs: DataFrame, model: Model | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark, all rows and columns stay."""
    common.prepare(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(model or learn(docs, text)), uuid.uuid4().hex
    target = common.arrow_schema(docs.sparkSession, docs.schema)
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        spans = _finder(token, shared).find(t) if t else []
        out, last = [], 0
        for _, s, e, _ in spans:
            if s >= last:
                out += [t[last:s], mark]
            last = max(last, e)
        return "".join(out) + t[last:] if spans else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array([clean(t) for t in c.to_pylist()]) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    target = common.arrow_schema(spark, ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in r] for r in b.column(1).to_pylist()]
            counts = [Counter(k for k, *_ in r) for r in rows]
            base = [hashlib.sha256(joined(s for s in r if s[0] != "format").encode()).hexdigest() for r in rows]
            yield common.record_batch({"doc_id": b.column(0), **{f"n_{k}": [c[k] for c in counts] for k in KINDS[:3]}, "base_sha256": base, "spans": [joined(r) for r in rows]}, target)

    return scan(docs).mapInArrow(digest, ddl)


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
