"""Merkle manifest, source divergence and nearest vectors against brute force, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import divergence, merkle, neighbours
from loomstat.llm.queries import QUERIES
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, path string, idx long, tree long, term string, level int"


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "h", "p", 1, 2, "t", 3) for i, t, g, s in rows], SCHEMA)


LONG = "\n".join(f"wörd{i % 977} of" for i in range(12_000))
ROWS = [
    (1, "The cat sat\non the mat", "en", "a"), (2, "The cat sat\non the mat", "en", "a"), (3, None, "en", None), (4, "", None, "a"),
    (5, " \t\n\x0b ", "de", "b"), (6, "123 !!", "de", "b"), (7, "Der Hund\nschläft", "de", "b"), (8, LONG, "en", "é"), (9, "a" * 5000, "en", "c"),
    (None, "no\nkey", "fr", "b"), (None, "no\nkey", "fr", "b"), (11, "one\n", "en", "a"), (11, "one\n", "en", "a"), (-12, "x\ny", "en", "a"), (13, "the mat", "en", "c"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes):
    """Root of a tree, and the siblings of each leaf as (before, after) from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % 3
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for i, t, g, s, n in rows:
        leaf = sha("".join(map(framed, (i, s, g, n, t))))
        lost = i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0
        shown = sha("".join(map(framed, (i, s, g, n, t.replace("\n", ""))))) if lost else leaf
        groups[s].append((i is not None, i or 0, leaf, shown))
    subs = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(groups[s])
        subs.append((leaves, *climbed([x[2] for x in leaves])))
    root, tops = climbed([s[1] for s in subs])
    out = []
    for (leaves, subroot, paths), top in zip(subs, tops, strict=True):
        for (known, i, leaf, shown), path in zip(leaves, paths, strict=True):
            folded = shown
            for before, after in path + top:
                folded = sha(before + folded + after)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((str(i if known else None), leaf, subroot, root, proof, folded, folded == root))
    return sorted(out)


def audited(df):
    return sorted((str(r["doc_id"]), *r[1:]) for r in merkle.audit(df).collect())


@pytest.mark.parametrize("few, block", [(10_000, 6), (0, 1), (0, 2)])
def test_manifest_equals_brute_force(spark, monkeypatch, few, block):
    """Deep and shallow trees, with and without broadcasts, levels built one at a time or together."""
    monkeypatch.setattr(merkle, "BROADCAST_NODES", few)
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
    rng = random.Random(3)
    sizes = {"hot": 100, None: 9, "": 27, "é": 1, "a": 28, "z": 3, "Z": 2, "b": 1}
    rows = [(None, f"line\n{rng.random()}", "en", s) for s, n in sizes.items() for _ in range(n)]
    rows = [(k * 7 - 99, *r[1:]) for k, r in enumerate(rng.sample(rows, len(rows)))]
    assert audited(frame(spark, rows)) == brute_manifest([(*r, len(r[1])) for r in rows])


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], [ROWS[0], ROWS[2]], [ROWS[11]] * 40])
def test_manifest_of_odd_rows(spark, rows):
    expected = brute_manifest([(*r, None if r[1] is None else len(r[1])) for r in rows])
    assert audited(frame(spark, rows)) == expected


def test_manifest_of_no_rows(spark):
    assert merkle.audit(frame(spark, [])).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert merkle.audit(frame(spark, [])).count() == 0


def test_manifest_query(spark, tables):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in tables("documents").collect()]
    found = sorted((str(r["doc_id"]), *r[1:]) for r in QUERIES["op11_merkle_manifest"](spark, FOLDER).collect())
    assert found == brute_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


def plain_terms(text):
    """Terms by a walk over the characters."""
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) > 127 or c.isalpha():
            word += c.lower() if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_divergence(rows, min_docs=3, top=200):
    docs = [(g or "", s or "", plain_terms(t)) for _, t, g, s in rows]
    out = set()
    for lang in {g for g, _, _ in docs}:
        held = Counter(w for g, _, ws in docs if g == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, ws in docs:
            if g == lang:
                counts[s].update(ws)
        counts[None] = sum(counts.values(), Counter())
        share = {}
        for s, c in counts.items():
            total = sum(c[w] for w in kept)
            share[s] = {w: 1 + (10**9 * (c[w] + 1)) // (total + len(kept)) for w in kept}

        def f(w, a, b, share=share):
            return (share[a][w] - share[b][w]) ** 2 // share[b][w]

        sources = [s for s in counts if s is not None]
        for s in sources:
            pairs = [(-sum(f(w, s, o) for w in kept), o.encode(), o) for o in sources if o != s]
            rising = [(-f(w, s, None), w.encode(), w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(rising)[:top])):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


def divergent(df, **options):
    rows = [tuple(r) for r in divergence.audit(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("terms, sources, held", [(4096, 64, 250_000), (5, 2, 10), (3, 1, 250_000)])
def test_divergence_equals_brute_force(spark, monkeypatch, terms, sources, held):
    """One block or many of terms and of sources; counts passed on once or often. Long terms share long prefixes."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(8)
    stems = ["a", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "abcdefghijk", "Élan", "éléphant" * 3, "x" * 16, "x" * 17, "x" * 40, "straße"]
    rows = []
    for i in range(120):
        words = [rng.choice(stems) + rng.choice(["", "", "q", "Z", "é", f"{'r' * rng.randrange(40)}"]) for _ in range(rng.randrange(12))]
        rows.append((i, " ".join(words) + rng.choice([".", " 7up", "-A_b", ""]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None, "é"])))
    assert divergent(frame(spark, rows)) == brute_divergence(rows)


def test_divergence_of_odd_rows(spark):
    assert divergent(frame(spark, ROWS)) == brute_divergence(ROWS)
    assert divergent(frame(spark, ROWS), min_docs=1, top_terms=2) == brute_divergence(ROWS, 1, 2)
    assert divergent(frame(spark, ROWS[4:6])) == brute_divergence(ROWS[4:6]) == set()
    assert divergence.audit(frame(spark, [])).count() == 0


def test_prefixes_are_discarded_before_terms(spark):
    rows = [(i, "common" + chr(97 + i) * 20 + " shared", "en", "s") for i in range(9)] + [(9, "shared rarelyfound", "en", "t")]
    counts = divergence.partial_counts(frame(spark, rows))
    left = {(bytes(r["term"]), r["docs"]) for r in divergence.refine(counts).groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
    # the nine long terms part at their eighth byte
    assert left == {(b"shared", 10)}


def brute_nearest(rows, k=10, every=100):
    """(query, rank, id, score) of distinct queries over usable rows (id, vector)."""
    fit = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in fit if i % every == 0}:
        near = sorted((float(np.sqrt(((u - v) ** 2).sum())), j) for j, u in fit if len(u) == len(v))
        near.remove((0.0, i))
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(near[:k])]
    return sorted(out)


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score double, shard int")


def found_near(df, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, **options).collect())


def same_rows(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected], rel=1e-12, abs=1e-12)


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 40)]
    rows += [(100, [1.0, 2.0, 3.0, 4.0]), (100, [1.0, 2.0, 3.0, 4.0]), (200, rows[0][1]), (301, [1e30, 0.0, 0.0, -1e30]), (400, [0.0] * 4), (500, None), (600, [])]
    rows += [(700, [1.0, None, 2.0, 3.0]), (800, [1.0, float("nan"), 2.0, 3.0]), (900, [float("inf"), 1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1000, [1.0, 2.0]), (3, [1.5, 2.0])]
    rows += [(5000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(50)]
    expected = brute_nearest(rows)
    assert {r[0] for r in expected} == {100, 200, 1000, 5000}
    same_rows(found_near(vector_frame(spark, rows)), expected)
    same_rows(found_near(vector_frame(spark, rows), shard_rows=7), expected)
    assert neighbours.nearest(vector_frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert found_near(vector_frame(spark, rows[:1])) == []


def test_copies_do_not_cut_the_graph(spark):
    """A vector that two thirds of the rows share, beside clusters far apart."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 50
    rows = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(600)] + [(600 + i, [1.0] * 8) for i in range(1200)]
    found, expected = found_near(vector_frame(spark, rows), shard_rows=150), brute_nearest(rows)
    assert len(found) == len(expected)
    hit = {r[:1] + r[2:3] for r in found} & {r[:1] + r[2:3] for r in expected}
    assert len(hit) >= 0.97 * len(expected)


def test_nearest_query_recall(spark, tables):
    """The registered query over its whole table against brute force."""
    rows = [(r["vec_id"], r["embedding"]) for r in tables("embeddings", "0.1").collect()]
    found = [tuple(r) for r in QUERIES["op13_nearest_vectors"](spark, f"{TESTDATA}/sf0.1").collect()]
    expected = brute_nearest(rows)
    assert len(found) == len(expected)
    pairs = {(q, i): s for q, _, i, s in expected}
    hit = [(s, pairs[q, i]) for q, _, i, s in found if (q, i) in pairs]
    assert len(hit) >= 0.95 * len(expected)
    assert all(a == pytest.approx(b, rel=1e-12) for a, b in hit)


def test_graph_layers_are_flat_and_linked():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 16))
    graph = neighbours.build(vectors)
    assert [layer.shape for layer in graph.layers] == [(3, 16), (44, 16), (700, 32)]
    for layer in graph.layers:
        for node, near in enumerate(layer.tolist()):
            real = [x for x in near if x >= 0]
            assert len(real) == len(set(real)) > 0 and node not in real and max(real) < len(layer)
    truth = np.argsort(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    found = graph.search(vectors)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), truth.tolist(), strict=True)]) > 0.95
