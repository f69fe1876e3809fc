"""Queries over the small tables against brute-force versions, and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash

from loomstat.llm import pieces, rollup
from loomstat.llm.queries import QUERIES
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(tables):
    return {r["doc_id"]: r for r in tables("documents").collect()}


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


def by_key(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_cuts(texts, length):
    """Per text, which bytes lie in a window that starts at two places."""
    places = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = [False] * len(t)
        for i in range(len(t) - length + 1):
            if places[t[i : i + length]] > 1:
                flags[i : i + length] = [True] * length
        out.append(flags)
    return out


def test_language_of_held_out_documents(spark, docs):
    found = by_key(QUERIES["op1_language_id"](spark, FOLDER))
    assert found.keys() == docs.keys()
    held = [r for r in found.values() if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in found.values())
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_models_base_and_score(spark, docs):
    found = by_key(QUERIES["op4_lm_scores"](spark, FOLDER))
    words = {k: BLANK_WORD.findall(lowered(d["text"] or "")) + ["\n"] for k, d in docs.items()}
    counts = Counter(w for k, ws in words.items() if remainder(k, 7) != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    base = score = 0
    for k, ws in words.items():
        row = found[k]
        expected = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        assert row["base_score"] == pytest.approx(expected, rel=1e-9)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        if row["held_out"]:
            base, score = base + row["base_score"], score + row["score"]
    assert score > base


def test_repeated_bytes(spark, docs):
    found = by_key(QUERIES["op6_suffix_dedup"](spark, FOLDER))
    keys = sorted(docs)
    texts = [(docs[k]["text"] or "").encode() for k in keys]
    for k, text, flags in zip(keys, texts, brute_cuts(texts, 400), strict=True):
        kept = bytes(b for b, f in zip(text, flags, strict=True) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        row = found[k]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(text), sum(flags), spans)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_token_totals(spark, docs, tables):
    toxic = {r["doc_id"] for r in tables("labels").filter("toxic = 1").collect()}
    encode = rollup.public_ranks(spark).encoder().encode_ordinary
    expected = Counter()
    for k, d in docs.items():
        if k not in toxic:
            expected[d["source"], d["lang"], "docs"] += 1
            expected[d["source"], d["lang"], "tokens"] += len(encode(d["text"]))
            expected[d["source"], d["lang"], "bytes"] += len(d["text"].encode())
    rows = QUERIES["op7_token_counts"](spark, FOLDER).collect()
    found = {(r["source"], r["lang"], c): r[c] for r in rows for c in rollup.SUMS}
    assert found == expected


def brute_fingerprint(text):
    words = BLANK_WORD.findall(lowered(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest reachable key per key, over links of two bits or less."""
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            at = todo.pop()
            for k, f in prints.items():
                if k not in out and (f ^ prints[at]).bit_count() <= 2:
                    out[k] = start
                    todo.append(k)
    return out


def test_near_duplicates(spark, docs):
    found = by_key(QUERIES["op8_simhash"](spark, FOLDER))
    prints = {k: brute_fingerprint(d["text"] or "") for k, d in docs.items()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{f:016x}" for k, f in prints.items()}
    assert {k: r["component_id"] for k, r in found.items()} == brute_components(prints)


def test_quality_of_held_out_documents(spark, tables):
    found = by_key(QUERIES["op9_quality"](spark, f"{TESTDATA}/sf0.01"))
    labels = {r["doc_id"]: r["quality"] for r in tables("labels", "0.01").collect()}
    held = [(r["score"], labels[k]) for k, r in found.items() if r["held_out"] and k in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())


def test_pieces_decode_to_the_texts(spark, docs):
    found = by_key(QUERIES["op10_pieces"](spark, FOLDER))
    assert found.keys() == docs.keys() and all(r["exact"] for r in found.values())
    vocabulary = pieces.Vocabulary.load(pieces.vocabulary_path(spark))
    for k in list(docs)[:20]:
        ids = vocabulary.encode(docs[k]["text"])
        assert vocabulary.decode(ids) == docs[k]["text"]
        assert found[k]["pieces_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_stages_one_after_another(spark, docs, tables):
    import corpus_pipeline

    found = {r["doc_id"]: r["piece_ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {k: d["text"] for k, d in docs.items() if any(c.isalpha() for c in d["text"] or "")}
    roots = brute_components({k: brute_fingerprint(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if roots[k] == k}
    keys = sorted(texts)
    flags = brute_cuts([texts[k].encode() for k in keys], corpus_pipeline.PASSAGE_BYTES)
    for k, marks in zip(keys, flags, strict=True):
        texts[k] = bytes(b for b, f in zip(texts[k].encode(), marks, strict=True) if not f).decode("utf-8", "ignore")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [word.findall(lowered(r["text"] or "")) for r in tables("benchmark").collect()]
    windows = {tuple(ws[i : i + 13]) for ws in items for i in range(max(1, len(ws) - 12)) if ws}
    sizes = {len(w) for w in windows}
    clean = {}
    for k, t in texts.items():
        ws = word.findall(lowered(t))
        hit = {i + j for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(ws):
            clean[k] = t
    vocabulary = pieces.Vocabulary.load(pieces.vocabulary_path(spark))
    assert found == {k: vocabulary.encode(t) for k, t in clean.items()}
