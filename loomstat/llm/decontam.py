"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import ALNUM, texts
from loomstat.plans.scratch import freeze

WINDOW = 13
# a text is contaminated if at least one word in COVERAGE is hit
COVERAGE = 20
# words of test items that make up one automaton; a larger benchmark is taken in blocks
BLOCK_WORDS = 2_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word lists; a state stands for strings with the same ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link = [0]
        self.length = [0]
        items = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(items)

    def _new(self, length: int, link: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """State for the strings of ``q`` that are no longer than those of ``p`` and the word."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = copy
        while self.go[p].get(w) == q:
            self.go[p][w] = copy
            if p == 0:
                break
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.go[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while w not in self.go[p]:
            self.go[p][w] = state
            if p == 0:
                return state
            p = self.link[p]
        q = self.go[p][w]
        self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _mark(self, items: list[tuple[str, list[int]]]) -> None:
        """Which state holds each window, and the items that have it."""
        states = len(self.go)
        self.window_of = [-1] * states
        for s in sorted(range(1, states), key=self.length.__getitem__):
            if self.length[s] >= self.window:
                above = self.link[s]
                self.window_of[s] = s if self.length[above] < self.window else self.window_of[above]
        self.items_of: dict[int, set[str]] = {}
        self.whole = [0] * states
        for name, words in items:
            s = 0
            for i, w in enumerate(words):
                s = self.go[s][w]
                if i >= self.window - 1:
                    self.items_of.setdefault(self.window_of[s], set()).add(name)
            if len(words) < self.window:
                self.whole[s] = len(words)
                self.items_of.setdefault(-s, set()).add(name)
        # nearest state above that holds a short item as a whole
        self.short_above = [0] * states
        for s in sorted(range(1, states), key=self.length.__getitem__):
            above = self.link[s]
            self.short_above[s] = above if self.whole[above] else self.short_above[above]
        self.least = min([min(len(words), self.window) for _, words in items], default=self.window)

    def search(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside matches (first, one past the last), and items with a match.

        ``ids`` are word numbers, -1 for words that no item has; these end every match, so only
        runs of known words as long as the shortest window are walked.
        """
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        marks: set[int] = set()
        go, link, length, whole, above, window = self.go, self.link, self.length, self.whole, self.short_above, self.window
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin < self.least:
                continue
            state = matched = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin + 1):
                following = go[state].get(w)
                while following is None and state:
                    state = link[state]
                    matched = length[state]
                    following = go[state].get(w)
                if following is None:
                    continue
                state = following
                matched += 1
                if matched >= window:
                    spans.append((at - matched, at))
                    marks.add(self.window_of[state])
                short = state if whole[state] and whole[state] <= matched else above[state]
                while short:
                    spans.append((at - whole[short], at))
                    marks.add(-short)
                    short = above[short]
        items: set[str] = set()
        for m in marks:
            items |= self.items_of[m]
        return spans, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def _scan(automaton, last: bool):
    """Adds the matches of one block of items to those of earlier blocks; the last block's pass reports."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(frames):
        return _report(scan(frames)) if last else scan(frames)

    def scan(frames):
        matcher = automaton.value
        number = matcher.vocabulary.get
        for batch in frames:
            counts, found, items = [], [], []
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts(batch.column(4)), strict=True)
            for earlier, marked, text in rows:
                words = text.translate(ALNUM).split()
                ids = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
                spans, names = matcher.search(ids)
                counts.append(len(words))
                spans += [(s["first"], s["end"]) for s in earlier]
                found.append([{"first": a, "end": b} for a, b in joined(spans)])
                items.append(sorted(names.union(marked)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(items, pa.list_(pa.string())), batch.column(4)],
                names=["key", "n_words", "spans", "items", "text"],
            )

    return run


def _report(frames):
    """Hit counts, digest of the items and the text without hit spans."""
    for batch in frames:
        hits, digests, cleaned = [], [], []
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts(batch.column(4)), strict=True)
        for spans, items, text in rows:
            places = joined([(s["first"], s["end"]) for s in spans])
            hits.append(sum(b - a for a, b in places))
            digests.append(hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest())
            cleaned.append(without(text, places).decode() if places else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(hits, pa.int64()),
                pa.array([len(set(i)) for i in batch.column(3).to_pylist()], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(cleaned, pa.string()),
            ],
            names=["key", "n_words", "n_hit", "n_items", "items_sha256", "cleaned"],
        )


def automata(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[tuple[Automaton, bool]]:
    """An automaton per block of near ``block_words`` words, made when it is asked for, and whether it is the last."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    items = items.select(F.coalesce("item", F.lit("")).alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield Automaton(sorted((r["item"], r["text"].encode().translate(ALNUM).split()) for r in rows), window), b == blocks - 1


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, cleaned) for every row of ``docs``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
    case. A window is ``window`` consecutive words of an item, or a whole shorter item; words of a
    text inside an occurrence of a window are hit. ``contaminated``: some word is hit and so is at
    least one in ``coverage``. ``cleaned`` is the text without the hit spans, NULL if none is hit.
    NULL and empty texts have no words, items without words match nothing, an empty benchmark
    matches nothing and an empty table gives no rows. Repeated keys give a row each. Columns with
    other names are neither read nor returned.

    The benchmark is broadcast in blocks of about ``block_words`` words, one pass over the texts per
    block. What a pass finds is written before the next one, so a task holds one block at a time.
    """
    spark = docs.sparkSession
    spans_kind = "array<struct<first:long,end:long>>"
    scanned = docs.select(
        F.col(key).alias("key"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr(f"CAST(array() AS {spans_kind})").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
        F.col(text).alias("text"),
    )
    kind = scanned.schema["key"].dataType.simpleString()
    passed = f"key {kind}, n_words long, spans {spans_kind}, items array<string>, text string"
    reported = f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, cleaned string"
    for block, last in automata(benchmark, item, "text", window, block_words):
        shared = spark.sparkContext.broadcast(block)
        scanned = scanned.mapInArrow(_scan(shared, last), reported if last else passed)
        if not last:
            scanned = freeze(scanned)
    contaminated = (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))
    return scanned.select(
        F.col("key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "cleaned"
    )
