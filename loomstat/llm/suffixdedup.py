"""Removal of byte strings that occur at two places of the corpus, by bounded suffix intervals.

1. *Anchors.* Every window of ``length`` bytes has an anchor: the leftmost least hash among its
   ``GRAM``-byte strings. Equal windows have equal anchors, so windows need comparing only if their
   anchors are equal. Neighbouring windows with one anchor form a run (about 170 windows).
2. *Runs.* Runs are grouped by anchor and by a 128-bit digest of their bytes. A run whose bytes occur
   again is repeated as a whole; a run whose anchor occurs once is not. Only runs that share an anchor
   with other bytes are left: the edges of copies and passages.
3. *Intervals.* The bytes of those runs are brought together by anchor. Equal windows hold their anchor
   at one place, so they agree in one of ``SHARES`` strings of most of their length around it, too; runs that share
   none of these hold no repeated window. A block of the others gets a suffix array and its Burrows-Wheeler transform; intervals of suffixes with a common prefix are
   extended backward breadth-first, which finds the borders of common prefixes by increasing value,
   from the depth that the sort has ranked on.
   The expansion stops at ``length``: neighbours that no border has parted by then share that many
   bytes, and such suffixes begin repeated windows.

An anchor with more than ``ANCHOR_RUNS`` different runs would be one long task; its windows are keyed
by a 128-bit digest each and counted with a shuffle instead.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.text import batches, parts, row_id, texts
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

LENGTH = 400
# shorter passages that are reported, not removed: over 50 words unless they have less than four letters
PASSAGE = 240
GRAM = 64
# strings around an anchor that are compared before a search
SHARES = 8
# bytes hashed and sorted at once; a longer text is one piece
PIECE_BYTES = 1 << 16
# bytes of runs searched at once (or the runs of one anchor), and of texts cut at once
BLOCK_BYTES = 1 << 18
CUT_BYTES = 1 << 20
# different runs of one anchor that go to one task
ANCHOR_RUNS = 4096
_PLACE_BITS = np.uint64(28)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < gram:
        h = _mixed(h)[:-size] * np.uint64(3) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return _mixed(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys, from minima up to and from block borders."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _gram(length: int) -> int:
    """Bytes of the strings among which windows of ``length`` bytes have their anchor."""
    return min(GRAM, 1 << (length.bit_length() - 2)) if length > 3 else 1


def runs_of(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts ``raw[at[i]:at[i + 1]]``: text, first window, number of windows, anchor."""
    gram = _gram(length)
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = _gram_hashes(raw, gram)
    keys = (hashes & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(keys, length - gram + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= at[1:][owner]
    begins = valid.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= begins[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    return owner[first], first - at[:-1][owner[first]], last - first + 1, hashes[place[first]].view(np.int64)


def _runs(length: int):
    def run(frames):
        schema = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("digest", pa.binary())])
        for batch in frames:
            row = batch.column(0).cast(pa.binary())
            for begin, end in batches(batch.column(1), PIECE_BYTES):
                raw, at = parts(batch.column(1).slice(begin, end - begin))
                if len(raw) >= 1 << int(_PLACE_BITS):
                    raise ValueError("a text of 256 MB or more cannot be searched")
                owner, start, n, anchor = runs_of(raw, at, length)
                whole, low = raw.tobytes(), at[owner] + start
                digests = [
                    hashlib.blake2b(whole[a:b], digest_size=16).digest()
                    for a, b in zip(low.tolist(), (low + n + length - 1).tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [row.slice(begin, end - begin).take(pa.array(owner)), pa.array(start), pa.array(n), pa.array(anchor), pa.array(digests, pa.binary())],
                    schema=schema,
                )

    return run


def suffix_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Places of the cyclic string ``t`` sorted by their next ``depth`` symbols or more; a number of symbols up to ``depth`` and the ranks by these."""
    n = len(t)
    known, by_known = 0, np.zeros(n, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.roll(t, -k).astype(np.uint64)
    size = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))).astype(np.uint64)
        if size <= depth:
            known, by_known = size, rank
        if size >= depth or rank[order[-1]] == n - 1:
            return order, known, by_known
        key = (rank << np.uint64(32)) | np.roll(rank, -size)
        size *= 2


def repeated_suffixes(t: np.ndarray, length: int) -> np.ndarray:
    """Mask of the places of cyclic ``t`` whose next ``length`` symbols occur at another place."""
    n = len(t)
    order, known, rank = suffix_order(t, length)
    bwt = t[order - 1]
    # step[i]: rank of the suffix one symbol longer to the left; back is its inverse
    back = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int32)
    step[back] = np.arange(n, dtype=np.int32)
    same = bwt[back[1:]] == bwt[back[:-1]]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[back[:-1][same]] = back[1:][same]
    preceding[back[1:][same]] = back[:-1][same]
    parted = np.zeros(n + 1, bool)
    parted[[0, n]] = True
    # borders of prefixes that the order has told apart, and the intervals between them
    parted[1:n] = rank[order[1:]] != rank[order[:-1]]
    edges = np.flatnonzero(parted).astype(np.int32)
    low, high = edges[:-1], edges[1:] - 1
    for value in range(known, length):
        sizes = high - low + 1
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        i = np.arange(total, dtype=np.int32) + np.repeat((low - ends + sizes).astype(np.int32), sizes)
        # of each interval, the first and last suffix preceded by each symbol
        first = i[preceding[i] < np.repeat(low, sizes)]
        last = i[following[i] > np.repeat(high, sizes)]
        new_low, new_high = np.sort(step[first]), np.sort(step[last])
        fresh = ~parted[new_high + 1]
        parted[new_high[fresh] + 1] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    joined = ~parted[:n]
    alike = joined.copy()
    alike[:-1] |= joined[1:]
    mask = np.zeros(n, bool)
    mask[order[alike]] = True
    return mask


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the first bytes of its windows that occur elsewhere among the pieces."""
    if not pieces:
        return []
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    t = np.zeros(int((sizes + 1).sum()), np.uint16)
    for begin, piece in zip(begins.tolist(), pieces, strict=True):
        t[begin : begin + len(piece)] = np.frombuffer(piece, np.uint8).astype(np.uint16) + 1
    mask = repeated_suffixes(t, length)
    return [
        np.flatnonzero(mask[b : b + max(0, s - length + 1)]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)
    ]


def likely_runs(pieces: list[bytes], anchors: list[int], once: list[bool], length: int) -> list[int]:
    """Indices of the runs that may hold a window which occurs in another run, one of both occurring ``once``.

    A window has ``length - gram`` bytes besides its anchor. However they lie around it, ``i`` steps before it and the
    remaining ones but one behind it are part of the window for some ``i``.
    """
    gram = _gram(length)
    step = (length - gram) // SHARES
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), sizes)
    hashes = _gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), gram).view(np.int64)
    places = np.flatnonzero(hashes == np.array(anchors, np.int64)[owner[: len(hashes)]])
    # the anchor is the first string in its run with that hash
    _, first = np.unique(owner[places], return_index=True)
    at = (places[first] - np.cumsum(sizes) + sizes).tolist()
    strings = [
        [(a, i, p[q - i * step : q + gram + (SHARES - 1 - i) * step]) for i in range(SHARES) if q >= i * step and q + gram + (SHARES - 1 - i) * step <= len(p)]
        for p, a, q in zip(pieces, anchors, at, strict=True)
    ]
    counts = Counter(x for own in strings for x in own)
    single = {x for own, o in zip(strings, once, strict=True) if o for x in own}
    return [k for k, own in enumerate(strings) if any(counts[x] > 1 and x in single for x in own)]


def _joined_spans(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Maximal runs of bytes covered by windows at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    low = starts[np.concatenate(([0], cut + 1))]
    high = starts[np.concatenate((cut, [len(starts) - 1]))] + length
    return [{"start": int(a), "end": int(b)} for a, b in zip(low, high, strict=True)]


SPANS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(length: int):
    """Blocks of runs, sorted by anchor, to (row, spans) for the runs that occur once."""

    def found(rows):
        out_rows, out_spans = [], []
        anchors, pieces, _, _, single = zip(*rows, strict=True)
        rows = [rows[k] for k in likely_runs(pieces, anchors, single, length)]
        pieces = [p for _, p, _, _, _ in rows]
        for (_, _, row, start, once), windows in zip(rows, repeated_windows(pieces, length), strict=True):
            if once and len(windows):
                out_rows.append(row)
                out_spans.append(_joined_spans(windows + start, length))
        return pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary()), pa.array(out_spans, _SPANS)], names=["row", "spans"])

    def run(frames):
        held, size = [], 0
        for batch in frames:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for record in zip(*columns, strict=True):
                if size > BLOCK_BYTES and record[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(record)
                size += len(record[1]) + 1
        if held:
            yield found(held)

    return run


def _pieces(length: int):
    """Rows with wanted runs to (anchor, piece, row, start, once).

    Rows of one id hold the same bytes; a task fetches them once.
    """

    def run(frames):
        schema = pa.schema([("anchor", pa.int64()), ("piece", pa.binary()), ("row", pa.binary()), ("start", pa.int64()), ("once", pa.bool_())])
        seen = set()
        for batch in frames:
            out = []
            for row, text, wanted in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if row in seen:
                    continue
                seen.add(row)
                for w in wanted:
                    out.append((w["anchor"], text[w["start"] : w["start"] + w["n"] + length - 1], row, w["start"], w["once"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*out, strict=True) if out else [[]] * 5)], schema=schema
            )

    return run


def _windows(length: int):
    """Pieces to their windows: (a, b) digest halves, row, start, once."""

    def run(frames):
        schema = pa.schema([("digest", pa.binary()), ("row", pa.binary()), ("start", pa.int64()), ("once", pa.bool_())])
        for batch in frames:
            for _, piece, row, start, once in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                n = len(piece) - length + 1
                digests = [hashlib.blake2b(piece[k : k + length], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([row] * n, pa.binary()), pa.array(range(start, start + n), pa.int64()), pa.array([once] * n)],
                    schema=schema,
                )

    return run


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_id(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(row, spans): per text with repeats, the sorted, disjoint byte spans that are covered.

    ``row`` is the ``row_id`` of key and text, so rows that share a key, or have none, are told apart by
    their texts; equal rows are places of their own and share their spans.
    """
    source = _numbered(docs, key, text).select("row", "text")
    kind = "row binary, start long, n long, anchor long, digest binary"
    runs = freeze(source.filter(F.octet_length("text") >= length).mapInArrow(_runs(length), kind))
    # most anchors occur once: nothing is left to compare there
    anchor_counts = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
    repeated = freeze(anchor_counts.filter("c > 1").select("anchor"))
    runs = freeze(runs.join(broadcast_if_small(repeated), "anchor", "left_semi"))
    # runs of one group hold the same bytes, so any of them can stand for all
    groups = runs.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("row", "start", "n")]
    )
    groups = freeze(groups)
    anchors = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # runs whose bytes occur again are repeated as a whole
    again = groups.filter("copies > 1").select("anchor", "digest")
    covered = runs.join(again, ["anchor", "digest"], "left_semi").select(
        "row", F.array(F.struct("start", (F.col("start") + F.col("n") + length - 1).alias("end"))).alias("spans")
    )
    mixed = groups.join(anchors, "anchor").select(
        F.col("row").alias("of"),
        F.struct("anchor", "start", "n", (F.col("copies") == 1).alias("once"), (F.col("kinds") > ANCHOR_RUNS).alias("many")).alias("w"),
    )
    few = _fetch(source, mixed.filter("NOT w.many"), length)
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = few.repartition(parallel, "anchor").sortWithinPartitions("anchor").mapInArrow(_search(length), f"row binary, spans {SPANS}")
    many = mixed.filter("w.many")
    shards = [covered, searched]
    if not many.isEmpty():
        windows = _fetch(source, many, length).mapInArrow(_windows(length), "digest binary, row binary, start long, once boolean")
        twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest")
        hit = windows.filter("once").join(twice, "digest", "left_semi")
        shards.append(hit.select("row", F.array(F.struct("start", (F.col("start") + length).alias("end"))).alias("spans")))
    every = shards[0]
    for part in shards[1:]:
        every = every.union(part)
    gathered = every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def join_spans(frames):
        for batch in frames:
            out = [[{"start": a, "end": b} for a, b in disjoint(spans)] for spans in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["row", "spans"])

    return gathered.mapInArrow(join_spans, f"row binary, spans {SPANS}")


def _fetch(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs."""
    by_text = wanted.groupBy("of").agg(F.collect_list("w").alias("wanted"))
    joined = source.join(broadcast_if_small(freeze(by_text)), F.col("row") == F.col("of"))
    return joined.select("row", "text", "wanted").mapInArrow(
        _pieces(length), "anchor long, piece binary, row binary, start long, once boolean"
    )


def disjoint(spans: list[dict[str, int]]) -> list[list[int]]:
    """Spans in order, with those that touch or overlap joined."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def _cut(frames):
    """(row, text, spans) to the digest columns; further columns are passed on."""
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for whole in frames:
        for begin, end in batches(whole.column(1), CUT_BYTES):
            batch = whole.slice(begin, end - begin)
            sizes, removed, counts, digests = [], [], [], []
            for text, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, left = hashlib.sha256(), 0
                for a, b in _between(spans or [], len(text)):
                    kept.update(text[a:b])
                    left += b - a
                sizes.append(len(text))
                removed.append(len(text) - left)
                counts.append(len(spans or []))
                digests.append(kept.hexdigest())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], names=[*names, *batch.schema.names[3:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Each byte covered by a ``length``-byte string that also starts anywhere else is removed, in all
    places where it occurs; strings are judged on the input. NULL and empty texts have no bytes.
    With ``passage``, a length below ``length``, a second search fills a column ``n_passage_bytes``: the bytes covered by
    strings of that length that also start anywhere else. It removes nothing and changes no other column.
    ``key`` is a whole number, which may be NULL or stand in several rows: every row is a place of
    its own and is judged by its own text. An empty table gives no rows. Columns besides key and text are neither read nor returned.
    """
    spans = repeated_spans(docs, key, text, length)
    more = []
    if passage is not None:
        if not 0 < passage < length:
            raise ValueError("passage is a positive length below length")
        covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_passage_bytes")
        # texts with longer repeats are among those with shorter ones
        spans = repeated_spans(docs, key, text, passage).select("row", covered).join(spans, "row", "left")
        more = [F.coalesce("n_passage_bytes", F.lit(0)).alias("n_passage_bytes")]
    spans = freeze(spans).withColumnRenamed("row", "of")
    joined = _numbered(docs, key, text).join(broadcast_if_small(spans), F.col("row") == F.col("of"), "left")
    kind = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_bytes long" * len(more)
    return joined.select("key", "text", "spans", *more).mapInArrow(_cut, kind).withColumnRenamed("row", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; all rows and columns stay, NULL texts too.

    See ``remove_repeats``; a character that is cut in two goes as a whole.
    """
    spans = freeze(repeated_spans(docs, key, text, length)).select(F.col("row").alias("__of"), F.col("spans").alias("__spans"))
    joined = docs.join(broadcast_if_small(spans), row_id(docs[key], docs[text]) == F.col("__of"), "left").drop("__of")
    place = docs.columns.index(text)

    def run(frames):
        for whole in frames:
            for begin, end in batches(whole.column(place), CUT_BYTES):
                batch = whole.slice(begin, end - begin)
                columns = list(batch.columns)
                spans = columns.pop().to_pylist()
                # texts without spans, NULL ones too, are passed on as they are
                values = [
                    text if not cuts else b"".join(text[a:b] for a, b in _between(cuts, len(text))).decode("utf-8", "ignore").encode()
                    for text, cuts in zip(batch.column(place).cast(pa.binary()).to_pylist(), spans, strict=True)
                ]
                columns[place] = pa.array(values, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def _between(spans: list[dict[str, int]], size: int) -> list[tuple[int, int]]:
    """What is left of 0 to ``size`` around disjoint spans in order."""
    return list(zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), size], strict=True))
