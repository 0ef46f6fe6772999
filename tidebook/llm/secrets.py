"""Secret scans by grammar inference.

Base spans come from three patterns (``assign``, ``access``, ``hex``). Their values are the labelled credentials that formats are learned
from: for each kind a tree of their prefixes, whose states are merged where their statistics agree (the red and blue states
of ALERGIA): two states agree if the shares of each next letter, and of ending, differ by less than the Hoeffding bound at
``ALPHA``, and so do the states that they lead to. What remains is a probabilistic automaton. Every candidate (a run of
at least ``LEAST`` of the letters that values are made of) is scored by its log-likelihood under the best automaton less that under ordinary
text, a chain of letter pairs counted over all documents outside the base spans. Candidates of ``THRESHOLD`` nats or more
that touch no base span are spans of kind ``format``.

What is learned. Pairs of letters are counted over all texts. The automata are fitted on a bounded sample of labelled values: for each kind
the ``TRAIN`` distinct values of smallest hash among those of up to ``LONGEST`` letters. Base spans don't depend on it.

Defined cases: a null text is empty and has no spans; empty tables give empty results; without labelled values only base spans are found; texts
are scanned whole, whatever their length; rows with equal identifiers are scanned each by its own text; a null identifier is kept; ties of hashes in the
sample are broken by the values; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffers, slices
from .common import bounded, hash_bound, table, written

#: The patterns (fixed values). A match that its kind's least size drops still takes its place.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST_VALUE = 6
NAMES = ("passw", "secret", "token", "api")  # a text without any of these has no match of ``assign``
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST, TRAIN, LONGEST, ALPHA, THRESHOLD, FLOOR = 16, 300, 128, 0.05, 14.0, 1e-6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_OTHER = len(LETTERS)
_CODES = np.full(256, _OTHER, np.int64)
_CODES[list(LETTERS.encode())] = np.arange(_OTHER)
END = ""


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[tuple[Span, str]]:
    """The base spans in order of start and kind, each with its value.

    The patterns of fixed least length find what a scan of all their runs would keep: a run holds one match, at its first possible place.
    """
    found, low = [], text.lower()
    for m in PATTERNS["assign"].finditer(text) if any(w in low for w in NAMES) else ():
        if len(m[2]) >= LEAST_VALUE:
            found.append((Span("assign", m.start(), m.end()), m[2]))
    for kind in KINDS[1:]:
        found += [(Span(kind, m.start(), m.end()), m[0]) for m in PATTERNS[kind].finditer(text)]
    return sorted(found, key=lambda x: (x[0].start, KINDS.index(x[0].kind)))


class Automaton(NamedTuple):
    """A probabilistic automaton: of each state the log-probability of each next letter (``END``: of ending) and the next state."""

    logs: list[dict[str, float]]
    moves: list[dict[str, int]]

    def score(self, value: str) -> float:
        """The log-likelihood of ``value``; a letter that a state has never led to costs ``FLOOR`` and leaves the state as it is."""
        total, state, floor = 0.0, 0, math.log(FLOOR)
        for letter in value:
            total += self.logs[state].get(letter, floor)
            state = self.moves[state].get(letter, state)
        return total + self.logs[state].get(END, floor)


class Tree:
    """A tree of prefixes with counts, in which states can be merged."""

    def __init__(self, values: list[str]):
        self.counts: list[dict[str, int]] = [{}]
        self.moves: list[dict[str, int]] = [{}]
        for value in values:
            state = 0
            for letter in value:
                self.counts[state][letter] = self.counts[state].get(letter, 0) + 1
                if letter not in self.moves[state]:
                    self.moves[state][letter] = len(self.counts)
                    self.counts.append({})
                    self.moves.append({})
                state = self.moves[state][letter]
            self.counts[state][END] = self.counts[state].get(END, 0) + 1

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states and those that they lead to agree in their shares."""
        width, pairs = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
        while pairs:
            x, y = pairs.pop()
            cx, cy = self.counts[x], self.counts[y]
            n, m = sum(cx.values()), sum(cy.values())
            if not n or not m:
                continue
            bound = width * (n**-0.5 + m**-0.5)
            if bound < 1 and any(abs(cx.get(k, 0) / n - cy.get(k, 0) / m) > bound for k in cx.keys() | cy.keys()):
                return False
            pairs += [(self.moves[x][k], self.moves[y][k]) for k in self.moves[x].keys() & self.moves[y].keys()]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        pairs = [(red, blue)]
        while pairs:
            x, y = pairs.pop()
            for k, n in self.counts[y].items():
                self.counts[x][k] = self.counts[x].get(k, 0) + n
            for k, to in self.moves[y].items():
                if k in self.moves[x]:
                    pairs.append((self.moves[x][k], to))
                else:
                    self.moves[x][k] = to


def inferred(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of ``values``: blue states, which red ones lead to, are merged into the first red state that agrees with them, else they turn red."""
    tree, red = Tree(values), [0]
    known = {0}
    while True:
        # the blue state with most values first, as its statistics are the surest
        blue = max(((tree.counts[x][k], -i, k, x) for i, x in enumerate(red) for k, y in tree.moves[x].items() if y not in known), default=None)
        if blue is None:
            break
        _, _, k, x = blue
        y = tree.moves[x][k]
        for r in red:
            if tree.alike(r, y, alpha):
                tree.moves[x][k] = r
                tree.fold(r, y)
                break
        else:
            red.append(y)
            known.add(y)
    place = {x: i for i, x in enumerate(red)}
    logs, moves = [], []
    for x in red:
        total = sum(tree.counts[x].values())
        logs.append({k: math.log(n / total) for k, n in tree.counts[x].items()})
        moves.append({k: place[y] for k, y in tree.moves[x].items()})
    return Automaton(logs, moves)


class Model(NamedTuple):
    """Automata by kind, and the log-probabilities of letter pairs in ordinary text (the last code: any other letter)."""

    automata: dict[str, Automaton]
    pairs: np.ndarray

    def score(self, value: str) -> float:
        """By how many nats ``value`` is likelier in the best format than in ordinary text."""
        codes = np.concatenate([[_OTHER], _CODES[np.frombuffer(value.encode(), np.uint8)], [_OTHER]])
        plain = float(self.pairs[codes[:-1], codes[1:]].sum())
        return max((a.score(value) for a in self.automata.values()), default=-math.inf) - plain


def plain_pairs(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next letter, each count plus one half."""
    counts = counts + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def masked(text: str, spans: list[tuple[Span, str]]) -> str:
    """``text`` without its spans, a space in the place of each."""
    pieces, at = [], 0
    for span, _ in spans:
        if span.end > at:
            pieces.append(text[at : max(at, span.start)])
            at = span.end
    return " ".join([*pieces, text[at:]])


def evidence(df: DataFrame, text: str) -> DataFrame:
    """Rows ``(kind, value, n)``: how often each labelled value occurs, and each pair of codes (kind ``pair``) outside base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = np.zeros((_OTHER + 1) ** 2, np.int64), _OTHER + 1
        values: Counter[tuple[str, str]] = Counter()

        def rows() -> pa.RecordBatch:
            kinds, texts = zip(*values)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(texts), pa.array(values.values(), pa.int64())], names=["kind", "value", "n"])

        for whole in batches:
            for batch in slices(whole, "__text"):
                plain = []
                for t in batch.column("__text").to_pylist():
                    spans = base_spans(t)
                    values.update((span.kind, value) for span, value in spans if len(value) <= LONGEST)
                    plain.append(masked(t, spans) if spans else t)
                codes = _CODES[buffers(pa.array(["\n", *(x + "\n" for x in plain)], pa.large_string()))[0]]
                pairs += np.bincount(codes[:-1] * size + codes[1:], minlength=size * size)
                if len(values) > 20_000:
                    yield rows()
                    values.clear()
        if values:
            yield rows()
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(used)), pa.array(map(str, used.tolist()), pa.string()), pa.array(pairs[used])], names=["kind", "value", "n"])

    found = df.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).transform(bounded).mapInArrow(run, "kind string, value string, n long")
    return found.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def fitted(df: DataFrame, text: str = "text") -> Model:
    """Formats and ordinary text of ``df``."""
    known = written(evidence(df, text), "evidence")
    counts = np.zeros((_OTHER + 1) ** 2)
    for r in known.where("kind = 'pair'").collect():  # one row a pair of letters
        counts[int(r["value"])] = r["n"]
    labelled = known.where("kind <> 'pair'").withColumn("h", F.xxhash64("value"))
    sizes = {r["kind"]: r["n"] for r in labelled.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    automata = {}
    for kind in KINDS:
        if kind in sizes:
            few = labelled.where((F.col("kind") == kind) & (F.col("h") <= hash_bound(sizes[kind], TRAIN))).orderBy("h", "value").limit(TRAIN)
            automata[kind] = inferred(sorted(r["value"] for r in few.select("value").collect()))
    return Model(automata, plain_pairs(counts.reshape(_OTHER + 1, _OTHER + 1)))


def all_spans(text: str, model: Model, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span], list[float]]:
    """Base spans, and the spans of formats with their scores."""
    base = [span for span, _ in base_spans(text)]
    more, scores, k = [], [], 0
    reach = 0  # of the base spans that begin before a candidate
    for m in CANDIDATE.finditer(text) if model.automata else ():
        while k < len(base) and base[k].start < m.end():
            reach = max(reach, base[k].end)
            k += 1
        if reach <= m.start() and (score := model.score(m[0])) >= threshold:
            more.append(Span("format", m.start(), m.end()))
            scores.append(score)
    return base, more, scores


def scanned(df: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(key, spans)``, one for each row of ``df``; ``spans`` are structs ``(kind, start, end, score)`` in code points, in order of start and kind.

    The score is null for base spans. ``model`` is fitted on ``df`` if None.
    """
    sent = df.sparkSession.sparkContext.broadcast(model or fitted(df, text))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    order = {k: i for i, k in enumerate((*KINDS, "format"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("__text").to_pylist():
                base, more, scores = all_spans(t, sent.value, threshold)
                found = [(*s, None) for s in base] + [(*s, x) for s, x in zip(more, scores)]
                rows.append([dict(zip(("kind", "start", "end", "score"), s)) for s in sorted(found, key=lambda s: (s[1], order[s[0]]))])
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(rows, pa.list_(span))], names=["__key", "spans"])

    rows = df.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).transform(bounded)
    out = rows.mapInArrow(run, "__key long, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return out.withColumnRenamed("__key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    found = scanned(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(of(*KINDS)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def digest(spans: list[Span]) -> str:
    """The digest of spans that the query returns."""
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans).encode()).hexdigest()
