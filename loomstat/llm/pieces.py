"""Unigram segmentation over the pieces of a SentencePiece vocabulary, with exact decoding.

The vocabulary file is a parameter. Its pieces are ordered by rank; where the file's own scores are
not log probabilities (a merge vocabulary scores by rank), a piece of rank r gets the log score
``-log(r + 1) - LENGTH_COST`` of a Zipf law.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.text import batches, texts

MARK = "▁"
_MARK = MARK.encode()
# log score that every piece costs beside its rank
LENGTH_COST = 3.0
# log score of one fallback byte; below that of any piece
BYTE_SCORE = -25.0
# segmented units that a Python worker remembers, twice over, and the bytes of the longest one
MEMORY = 50_000
REMEMBERED_BYTES = 48
# bytes of texts whose units are looked up together (or one longer text), and units whose places are walked together
BATCH_BYTES = 1 << 20
TOGETHER = 8192
# bytes of a unit whose paths are held at once
BLOCK_BYTES = 1 << 16


class Trie:
    """Double-array trie over the UTF-8 bytes of the pieces."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, number in pieces:
            node = 0
            for b in piece:
                following = children[node].get(b)
                if following is None:
                    following = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = following
            ends[node] = number
        size = max(1024, 4 * len(children) + 512)
        base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        check[0] = 0
        place = {0: 0}
        # each node's children go to the first fit at or after the last one: quick to build, a little sparse
        begin = 1
        queue = [0]
        for node in queue:
            at = place[node]
            value[at] = ends[node]
            if not children[node]:
                continue
            codes = [b + 1 for b in children[node]]
            while any(check[begin + c] != -1 for c in codes):
                begin += 1
            base[at] = begin
            for b, child in children[node].items():
                check[begin + b + 1] = at
                place[child] = begin + b + 1
                queue.append(child)
            if begin + 600 > len(check):
                grow = len(check)
                base.extend([0] * grow)
                check.extend([-1] * grow)
                value.extend([-1] * grow)
        # node k has child base[k] + byte if check there is k; value is the piece that ends, or -1
        self.base, self.check, self.value = array("i", [b + 1 for b in base]), check, value

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The three arrays for NumPy, without a copy."""
        return tuple(np.frombuffer(x, np.int32) for x in (self.base, self.check, self.value))


class Vocabulary:
    """Pieces with log scores, byte pieces for what no piece covers."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], first_real: int = 0):
        self.pieces = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.byte_ids = byte_ids
        self.score_array, self.byte_array = np.array(self.scores, np.float64), np.array(byte_ids, np.int32)
        self.byte_of = {number: b for b, number in enumerate(byte_ids)}
        special = set(byte_ids) | set(range(first_real))
        usable = [(p.encode(), k) for k, (p, _) in enumerate(pieces) if k not in special]
        if any(MARK in p.lstrip(MARK) for k, p in enumerate(self.pieces) if k not in special):
            raise ValueError("a piece has a marker after another character")
        self.trie = Trie(usable)
        self.bytes = [b"" if k in special else p.encode().replace(_MARK, b" ") for k, p in enumerate(self.pieces)]
        for number, b in self.byte_of.items():
            self.bytes[number] = bytes([b])
        self.longest = max((len(p) for p, _ in usable), default=1)
        self.literal = array("i", [byte_ids[b] for b in _MARK]).tobytes()
        self.memory: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file; only its list of pieces is used."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids = [-1] * 256
        pieces, real = [], 0
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                byte_ids[int(piece[1:-1], 16)] = k
            if model.is_control(k) or model.is_unknown(k):
                real = k + 1
            pieces.append((piece, -math.log(k + 1.0) - LENGTH_COST))
        if -1 in byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        return cls(pieces, byte_ids, real)

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "before": {}}

    def _forward(self, text: bytes, begin: int, end: int, score: list[float]):
        """Best scores and last pieces of the places after ``begin`` that steps from places before ``end`` reach.

        ``score`` holds those of ``begin`` and the ``longest`` places after it. A place without a better step has no piece (-1).
        """
        n = len(text)
        size = min(n, end + self.longest) - begin + 1
        score = score[:size] + [-math.inf] * (size - len(score))
        length, number = [0] * size, [-1] * size
        scores, trie, byte_ids = self.scores, self.trie, self.byte_ids
        base, check, value = trie.base, trie.check, trie.value
        for at in range(begin, end):
            here = score[at - begin]
            if here == -math.inf:
                continue
            step = here + BYTE_SCORE
            to = at - begin + 1
            if step > score[to]:
                score[to], length[to], number[to] = step, 1, byte_ids[text[at]]
            node, to = 0, at - begin
            for byte in text[at : at + self.longest]:
                following = base[node] + byte
                if check[following] != node:
                    break
                node = following
                to += 1
                piece = value[node]
                if piece >= 0:
                    step = here + scores[piece]
                    if step > score[to]:
                        score[to], length[to], number[to] = step, to - at + begin, piece
        return score, length, number

    def best_bytes(self, unit: bytes) -> bytes:
        """As :meth:`best`, of UTF-8 bytes, as 32-bit numbers.

        A long unit is walked in blocks of which only the scores at the borders are kept; going back from the end, each
        block's steps are found again. So memory does not grow with the paths.
        """
        n = len(unit)
        starts, entries = [], []
        score = [0.0]
        for begin in range(0, n, BLOCK_BYTES):
            starts.append(begin)
            entries.append(score)
            if begin + BLOCK_BYTES < n:
                score = self._forward(unit, begin, begin + BLOCK_BYTES, score)[0][BLOCK_BYTES:]
        out = array("i")
        at = n
        while starts:
            begin = starts.pop()
            _, length, number = self._forward(unit, begin, min(n, begin + BLOCK_BYTES), entries.pop())
            # a place reached from an earlier block has no piece here
            while at > begin and number[at - begin] >= 0:
                out.append(number[at - begin])
                at -= length[at - begin]
        out.reverse()
        return out.tobytes()

    def best_many(self, units: list[bytes]) -> list[bytes]:
        """:meth:`best_bytes` of many short units, whose places are walked side by side."""
        order = sorted(range(len(units)), key=lambda k: -len(units[k]))
        sizes = np.array([len(units[k]) for k in order])
        n, width = len(order), int(sizes[0])
        grid = np.frombuffer(b"".join(units[k].ljust(width, b"\0") for k in order), np.uint8).reshape(n, width).astype(np.int32)
        base, check, value = self.trie.arrays()
        scores, byte_ids = self.score_array, self.byte_array
        # units from the longest to the shortest: those beyond a place are the first ones
        beyond = [int(np.searchsorted(-sizes, -at, side="left")) for at in range(width + 1)]
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0.0
        length, number = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for at in range(width):
            k = beyond[at]
            step = score[:k, at] + BYTE_SCORE
            better = np.flatnonzero(step > score[:k, at + 1])
            score[better, at + 1], length[better, at + 1], number[better, at + 1] = step[better], 1, byte_ids[grid[better, at]]
            row, node = np.arange(k), np.zeros(k, np.int32)
            for to in range(at + 1, width + 1):
                inside = int(np.searchsorted(row, beyond[to - 1]))
                row, node = row[:inside], node[:inside]
                following = base[node] + grid[row, to - 1]
                there = check[following] == node
                row, node = row[there], following[there]
                if not len(row):
                    break
                piece = value[node]
                ends = piece >= 0
                whole, piece = row[ends], piece[ends]
                step = score[whole, at] + scores[piece]
                better = step > score[whole, to]
                whole = whole[better]
                score[whole, to], length[whole, to], number[whole, to] = step[better], to - at, piece[better]
        # back from the ends, all units a piece at a time
        out, used = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        row, at = np.arange(n), sizes.copy()
        while len(row):
            used[row] += 1
            out[row, width - used[row]] = number[row, at]
            at = at - length[row, at]
            row, at = row[at > 0], at[at > 0]
        raw, found = out.tobytes(), [b""] * n
        for place, k in enumerate(order):
            found[k] = raw[4 * (width * (place + 1) - int(used[place])) : 4 * width * (place + 1)]
        return found

    def best(self, unit: str) -> list[int]:
        """Pieces of the highest total score (Viterbi); of equal ones, that with the longest last piece."""
        return np.frombuffer(self.best_bytes(unit.encode()), np.int32).tolist()

    def encode_batch(self, batch: list[bytes]) -> list[bytes]:
        """As :meth:`encode`, of UTF-8 bytes, as 32-bit numbers; each distinct unit of the batch is segmented once."""
        split = [_units(text) for text in batch]
        found = {_LITERAL: self.literal}
        missing = []
        if len(self.memory) >= MEMORY:
            self.memory, self.before = {}, self.memory
        for unit in set().union(*split):
            known = self.memory.get(unit)
            if known is None and (known := self.before.get(unit)) is not None:
                self.memory[unit] = known
            if known is not None:
                found[unit] = known
            elif len(unit) > REMEMBERED_BYTES or not unit:
                # long units (texts without spaces) rarely come again
                found[unit] = self.best_bytes(_marked(unit))
            elif unit != _LITERAL:
                missing.append(unit)
        for begin in range(0, len(missing), TOGETHER):
            part = missing[begin : begin + TOGETHER]
            new = dict(zip(part, self.best_many([_marked(u) for u in part]), strict=True))
            found |= new
            if len(self.memory) < MEMORY:
                self.memory |= new
        return [b"".join(map(found.__getitem__, units)) for units in split]

    def encode(self, text: str) -> list[int]:
        """Piece numbers of a text: spaces become markers and one marker leads a text that is not empty."""
        return np.frombuffer(self.encode_batch([text.encode()])[0], np.int32).tolist()

    def decode_bytes(self, numbers: list[int]) -> bytes:
        """The text of piece numbers in bytes; markers are spaces, and the leading one goes."""
        return b"".join(map(self.bytes.__getitem__, numbers))[1:]

    def decode(self, numbers: list[int]) -> str:
        """The text of piece numbers."""
        return self.decode_bytes(numbers).decode("utf-8", "replace")


# bytes that no UTF-8 text has: a marker that the text itself holds, and the lead of a unit without a marker
_LITERAL, _BARE = b"\xfe", b"\xff"


def _words(line: bytes) -> list[bytes]:
    """What follows each marker, or several of them, once one leads the line: of k markers, k - 1 are spaces here."""
    words = line.split(b" ")
    if b"" not in words:
        return words
    out, before = [], b""
    for word in words:
        if word:
            out.append(before + word)
            before = b""
        else:
            before += b" "
    return out + [before[1:]] if before else out


def _units(text: bytes) -> list[bytes]:
    """The parts of a text that are segmented one by one, since no piece has a marker after another character."""
    if not text:
        return []
    if _MARK not in text:
        return _words(text)
    first, *others = text.split(_MARK)
    out = _words(first)
    for line in others:
        # a marker of the text itself is three bytes, so that decoding is exact, and no marker leads what follows
        head, space, rest = line.partition(b" ")
        out += [_LITERAL] + [_BARE + head] * bool(head) + (_words(rest) if space else [])
    return out


def _marked(unit: bytes) -> bytes:
    return unit[1:] if unit.startswith(_BARE) else _MARK + unit.replace(b" ", _MARK)


def _encode(shared):
    def run(frames):
        # the memory stays with the broadcast value for the tasks of a worker
        vocabulary = shared.value
        is_byte = np.zeros(len(vocabulary.pieces), bool)
        is_byte[vocabulary.byte_ids] = True
        for batch in frames:
            for begin, end in batches(batch.column(1), BATCH_BYTES):
                part = batch.slice(begin, end - begin)
                whole = texts(part.column(1))
                numbers = [np.frombuffer(coded, np.int32) for coded in vocabulary.encode_batch(whole)]
                fallback = [int(is_byte[coded].sum()) for coded in numbers]
                exact = [vocabulary.decode_bytes(coded.tolist()) == text for coded, text in zip(numbers, whole, strict=True)]
                yield _rows(part.column(0), numbers, fallback, exact)

    return run


def _rows(keys, numbers, fallback, exact):
    ends = np.concatenate(([0], np.cumsum([len(n) for n in numbers]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [keys, ids, pa.array(fallback, pa.int64()), pa.array(exact, pa.bool_())],
        names=["key", "piece_ids", "n_bytes", "exact"],
    )


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_ids, n_bytes, exact) for every row of ``docs``.

    ``n_bytes`` counts pieces that are fallback bytes; ``exact`` tells that decoding gives the text
    back. NULL and empty texts have no pieces and are exact. Repeated keys give a row each, an empty
    table none; other columns are neither read nor returned.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = source.mapInArrow(_encode(shared), f"key {kind}, piece_ids array<int>, n_bytes long, exact boolean")
    return out.withColumnRenamed("key", key)


def decode(coded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "piece_ids") -> DataFrame:
    """(key, text) from piece numbers; NULL gives NULL."""
    source = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = source.schema["key"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames):
        for batch in frames:
            found = [None if n is None else shared.value.decode(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["key", "text"])

    return source.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def vocabulary_path(spark: SparkSession) -> str:
    """Path of the piece file on the driver: ``spark.loomstat.pieceFile`` or the machine's public one."""
    return spark.conf.get("spark.loomstat.pieceFile", "/opt/tokenizers/piece_bpe_32k.model")
