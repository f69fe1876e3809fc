"""Language identification by cross-parsing: the language whose sample explains a text in fewest phrases."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import batches, sample_below

UNKNOWN = "und"
# characters of labelled text per language, and of all languages together
CHARS_PER_LANGUAGE = 16_384
CHARS_IN_ALL = 1_000_000
# expected number of labelled rows per language from which that text is taken, and the characters of each
SAMPLE_ROWS = 64
SAMPLE_CHARS = 65_536
# a text gives at most this share of a language's characters while others have some left
TEXTS_PER_LANGUAGE = 16
# a phrase ends at every multiple of this many characters, so that long texts parse in parallel
STRETCH = 8192
# bytes of text that are parsed together
PIECE_BYTES = 1 << 21
_SPACE, _OTHER = 0, 1


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``text`` by symbol; state 0 is none, 1 the start."""
    go: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for symbol in text.tolist():
        go.append({})
        link.append(1)
        length.append(length[last] + 1)
        state, p = len(go) - 1, last
        while p and symbol not in go[p]:
            go[p][symbol] = state
            p = link[p]
        if p:
            q = go[p][symbol]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(go) - 1
                while p and go[p].get(symbol) == q:
                    go[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return go


def packed(states: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, slots): the transition of a state by a symbol is in slot base[state] + symbol, if it is there.

    Rows of transitions are shifted so that they interleave; a slot holds (state << 32) + target, or -1.
    """
    base = np.zeros(len(states), np.int64)
    slots = [-1] * (2 * symbols)
    start = symbols
    rows = sorted((k for k, row in enumerate(states) if len(row) > 1), key=lambda k: -len(states[k]))
    for state in rows:
        row = states[state]
        least = min(row)
        tries, at = 0, start
        while True:
            while len(slots) < at + symbols:
                slots.extend([-1] * symbols)
            if slots[at] < 0 and all(slots[at - least + s] < 0 for s in row):
                break
            at, tries = at + 1, tries + 1
        # where places are hard to find, the gaps are left to states with one transition
        start = at - 16 if tries > 64 else start
        base[state] = at - least
        for s, target in row.items():
            slots[at - least + s] = (state << 32) + target
    at = symbols
    for state, row in enumerate(states):
        for s, target in row.items() if len(row) == 1 else ():
            while at < len(slots) and slots[at] >= 0:
                at += 1
            if at == len(slots):
                slots.extend([-1] * (symbols + len(states)))
            base[state] = at - s
            slots[at] = (state << 32) + target
    return base, np.array(slots + [-1] * symbols, np.int64)


@dataclass
class Model:
    """Automata of all languages in one table, with a symbol for every letter of their samples."""

    languages: list[str]
    symbol_of: dict[str, int]
    base: np.ndarray  # per state, where its transitions begin in slots
    slots: np.ndarray  # see packed
    roots: np.ndarray
    restart: np.ndarray  # [language, symbol] state after the first symbol of a phrase
    cost: np.ndarray  # [language, symbol] phrases closed where a match breaks
    bits: np.ndarray  # per language, bits to name a place of its text

    @property
    def symbols(self) -> int:
        return len(self.symbol_of) + 2


def _spaced(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(samples: dict[str, list[str]]) -> Model:
    """Build the automata from labelled texts.

    The texts of a language are used in order up to its budget, first the begin of each, so that no long
    text stands for the language alone, then what is left of them.
    """
    budget = max(1, min(CHARS_PER_LANGUAGE, CHARS_IN_ALL // max(1, len(samples))))
    lines: dict[str, str] = {}
    for language in sorted(samples):
        taken, size = [], 0
        spaced = [_spaced(text) for text in samples[language]]
        share = -(-budget // TEXTS_PER_LANGUAGE)
        for line in [*(line[:share] for line in spaced), *(line[share:] for line in spaced)]:
            if line and size < budget:
                taken.append(line[: budget - size])
                size += len(taken[-1]) + 1
        if taken:
            lines[language] = " ".join(taken)
    letters = Counter(c for line in lines.values() for c in line if c != " ")
    ranked = sorted(letters, key=lambda c: (-letters[c], c))
    symbol_of = {c: k + 2 for k, c in enumerate(ranked)}
    symbols = len(symbol_of) + 2
    states, roots = [{}], []
    restart = np.zeros((len(lines), symbols), np.int32)
    for k, line in enumerate(lines.values()):
        coded = np.array([_SPACE if c == " " else symbol_of[c] for c in line])
        offset = len(states) - 1
        roots.append(offset + 1)
        states.extend({s: target + offset for s, target in row.items()} for row in automaton(coded)[1:])
        for s, target in states[offset + 1].items():
            restart[k, s] = target
    root = np.array(roots, np.int32).reshape(-1, 1)
    return Model(
        list(lines),
        symbol_of,
        *packed(states, symbols),
        root,
        np.where(restart > 0, restart, root),
        np.where(restart > 0, 1, 2).astype(np.int32),
        np.array([math.log2(len(line) + 1) for line in lines.values()]),
    )


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases [language, text], symbols per text, whether a text has a letter)."""
    # a separator that is no letter ends each text
    codes = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.flatnonzero(np.bincount(codes))
    lookup = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.min_scalar_type(model.symbols))
    for code in present.tolist():
        c = chr(code)
        lookup[code] = model.symbol_of.get(c, _OTHER) if c.isalpha() else _SPACE
    symbol = lookup[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 1 for t in texts])
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != _SPACE) | (symbol[:-1] != _SPACE) | (owner[1:] != owner[:-1])
    symbol, owner = symbol[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    letters = np.bincount(owner[symbol != _SPACE], minlength=len(texts)) > 0
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    pieces = -(-sizes // STRETCH)
    lane_owner = np.repeat(np.arange(len(texts)), pieces)
    part = np.arange(len(lane_owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lane_begin = begins[lane_owner] + part * STRETCH
    lane_size = np.minimum(STRETCH, sizes[lane_owner] - part * STRETCH)
    order = np.argsort(-lane_size, kind="stable")
    lane_owner, lane_begin, lane_size = lane_owner[order], lane_begin[order], lane_size[order]
    state = np.repeat(model.roots, len(order), axis=1)
    count = np.zeros(state.shape, np.int32)
    alive = np.searchsorted(-lane_size, -np.arange(1, (lane_size[0] if len(order) else 0) + 1), side="right")
    for step, n in enumerate(alive.tolist()):
        s = symbol[lane_begin[:n] + step]
        slot = model.slots.take(model.base.take(state[:, :n]) + s)
        broken = (slot >> 32) != state[:, :n]
        count[:, :n] += broken * model.cost[:, s]
        state[:, :n] = np.where(broken, model.restart[:, s], slot & 0xFFFFFFFF)
    count += state != model.roots
    total = np.stack([np.bincount(lane_owner, weights=c, minlength=len(texts)) for c in count]) if len(count) else count
    return total, sizes, letters


def _predict(shared):
    def run(frames):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in frames:
            for begin, end in batches(batch.column(1), PIECE_BYTES):
                values = [t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                count, size, letters = phrases(model, values)
                best, score = np.full(len(values), len(names) - 1), np.zeros(len(values))
                if len(count):
                    rate = count * model.bits[:, None] / np.maximum(size, 1)
                    best = np.where(letters, rate.argmin(axis=0), len(names) - 1)
                    ordered = np.sort(rate, axis=0)
                    score = 1.0 - ordered[0] / ordered[1] if len(ordered) > 1 else np.ones(len(values))
                    score = np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(letters)],
                    names=["key", "lang_pred", "score", "has_letter"],
                )

    return run


def learn(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``SAMPLE_ROWS`` labelled rows per language, chosen by hash among ``training`` rows.

    Of each of them the first ``SAMPLE_CHARS`` characters reach the driver.
    """
    labelled = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return fit({})
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(1.0, SAMPLE_ROWS / r["n"])))])
    cut = (share[F.col(lang)] * (1 << 30)).cast("long")
    # small languages are taken whole, large ones by hash
    rank = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30))
    taken = labelled.filter(rank < cut).select(F.col(lang).alias("lang"), rank.alias("rank"), F.substring(text, 1, SAMPLE_CHARS).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(taken, key=lambda r: (r["lang"], r["rank"], r["text"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return fit(samples)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, has_letter) for every row of ``docs``, from the whole text alone.

    Letters are lower-cased, everything else is one space. The text is parsed from left to right
    into the longest strings that a language's sample holds; the number of phrases times the bits
    that name a place of the sample, per character, is the cross entropy, and the least wins (ties:
    first in alphabetical order). ``score`` is one less the ratio of the least to the next. A text
    that is NULL or has no letter, or a model without languages, gives ``und`` and score 0;
    ``has_letter`` tells the two apart. Repeated keys give a row each, an empty table none; other columns are neither read nor returned.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(_predict(shared), f"key {kind}, lang_pred string, score double, has_letter boolean").withColumnRenamed("key", key)
