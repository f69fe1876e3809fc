"""Edge cases of the corpus operators, and their kernels against plain versions."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstat.llm import chat, decontam, hostrules, langid, lm, pieces, quality, rollup, simhash, suffixdedup
from loomstat.llm.components import components
from tests.llm.test_corpus_tables import brute_components, brute_cuts, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, row string, spans string, key string, word string, n long"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, "r", "s", "k", "w", 1) for i, t, g, s in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} of" for i in range(12_000))
ROWS = [
    (1, "The cat sat on the mat and then went home again.", "en", "a"),
    (2, "The cat sat on the mat and then went home again.", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \t\n\x0b ", "de", "b"),
    (6, "12345 --- !!!", "de", "b"),
    (7, "Der Hund und die Katze schlafen heute nicht.", "de", "b"),
    (8, LONG, "en", "c"),
    (9, "a" * 3000, "en", "c"),
    (10, "é" * 50 + " x", "fr", None),
    (11, "one", "en", "a"),
    (11, "one", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def vocabulary():
    letters = [("▁", -4.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5), ("▁a", -2.2), ("abb", -3.9), ("▁▁", -3.0), ("é", -5.0)]
    return pieces.Vocabulary([(f"<0x{b:02X}>", 0.0) for b in range(256)] + letters, list(range(256)))


def test_language_cases(spark, odd, none):
    model = langid.learn(odd, F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [found[k]["lang_pred"] for k in (3, 4, 5, 6)] == ["und"] * 4 and found[3]["score"] == 0
    assert found[1]["lang_pred"] == "en" and found[7]["lang_pred"] == "de"
    assert langid.identify(odd, model).count() == len(ROWS)
    assert langid.identify(none, model).count() == 0
    empty = langid.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_sample_is_shared_by_texts():
    long, short = "abcd" * langid.CHARS_PER_LANGUAGE, "wxyz"
    model = langid.fit({"x": [long, short]})
    assert set(model.symbol_of) == set("abcdwxyz") and model.bits[0] <= np.log2(langid.CHARS_PER_LANGUAGE + 2)


def plain_phrases(text, sample):
    """Longest strings that the sample holds, from left to right; a character it lacks costs two."""
    count, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        count += 1 if end > at else 2
        at = max(end, at + 1)
    return count


@given(st.text("ab ", max_size=60), st.text("ab ", min_size=4, max_size=40))
@settings(max_examples=60, deadline=None)
def test_phrases_are_longest_matches(text, sample):
    model = langid.fit({"x": [sample]})
    if not model.languages:
        return
    line = " ".join(sample.split())
    parsed = " ".join(text.split())
    count, sizes, letters = langid.phrases(model, [parsed])
    assert letters[0] == bool(parsed)
    if all(c in line for c in parsed + " "):
        # one separator follows each text
        assert count[0, 0] == plain_phrases(parsed + " ", line) if parsed else count[0, 0] <= 2


def test_contamination_cases(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "the CAT sat-on the mat, and then WENT home again"), (2, "one"), (3, None), (4, "..."), (5, "one"), (6, LONG[:200])],
        "item_id long, text string",
    )
    rows = decontam.find_contamination(odd, bench).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert found[1]["n_hit"] == found[1]["n_words"] == 11 and found[1]["contaminated"] and found[1]["cleaned"] == "."
    assert found[11]["n_items"] == 2 and found[11]["contaminated"]
    assert [found[k]["n_words"] for k in (3, 4, 5)] == [0, 0, 0] and not found[3]["contaminated"]
    assert found[8]["n_hit"] > 0 and found[8]["n_items"] == 1
    assert decontam.find_contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.find_contamination(odd, bench.limit(0)).collect())
    # blocks of the benchmark give the same rows
    once = odd.dropDuplicates(["doc_id"])
    a = decontam.find_contamination(once, bench).orderBy("doc_id").collect()
    b = decontam.find_contamination(once, bench, block_words=20).orderBy("doc_id").collect()
    assert a == b
    # also where a key has several texts, or none is there
    one_key = odd.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.lit(0)))
    a = sorted(map(str, decontam.find_contamination(one_key, bench).collect()))
    assert a == sorted(map(str, decontam.find_contamination(one_key, bench, block_words=20).collect())) and len(a) == len(ROWS)


@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=5),
    st.lists(st.sampled_from("abcd"), max_size=30),
    st.integers(1, 4),
)
@settings(max_examples=150, deadline=None)
def test_automaton_finds_all_windows(items, text, window):
    machine = decontam.Automaton([(str(k), [w.encode() for w in ws]) for k, ws in enumerate(items)], window)
    ids = np.array([machine.vocabulary.get(w.encode(), -1) for w in text], np.int64)
    spans, names = machine.search(ids)
    hit, expected = set(), set()
    for k, ws in enumerate(items):
        n = min(window, len(ws))
        for i, j in itertools.product(range(len(ws) - n + 1), range(len(text) - n + 1)):
            if n and ws[i : i + n] == text[j : j + n]:
                hit |= set(range(j, j + n))
                expected.add(str(k))
    assert {i for a, b in spans for i in range(a, b)} == hit and names == expected


def test_host_rules_cases(spark, odd, none):
    rows = hostrules.judge(odd).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and hostrules.judge(none).count() == 0
    assert [found[k]["n_words"] for k in (3, 4, 5)] == [0, 0, 0] and found[3]["base_failed"]
    assert found[8]["n_repeat_words"] == 24_000 and found[8]["base_failed"] and not found[8]["kept"]
    text = "a b c a b c\nx y\n\nx y\n \n## <b>"
    row = hostrules.judge(frame(spark, [(1, text, None, "h")])).first()
    # a b c twice, and b c a once: the six first words; x y is a duplicate line
    assert (row["n_words"], row["n_repeat_words"], row["n_dup_lines"], row["n_symbols"], row["word_chars"]) == (12, 6, 1, 4, 15)


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i < 3 else "x", "en", "bad") for i in range(100)] + [(100 + i, good, "en", "good") for i in range(100)]
    found = {r["doc_id"]: r["kept"] for r in hostrules.judge(frame(spark, rows)).collect()}
    assert not any(found[i] for i in range(100)) and all(found[i] for i in range(100, 200))


def test_lm_cases(spark, odd, none):
    unique = odd.dropDuplicates(["doc_id"])
    found = {r["doc_id"]: r for r in lm.score_texts(unique, F.col("doc_id") < 8).collect()}
    assert len(found) == 11 and all(found[k]["n_tokens"] == 1 for k in (3, 4, 5))
    assert found[3]["score"] == found[4]["score"] < 0
    assert found[9]["n_known"] == 1 and np.isfinite(found[8]["score"])
    assert lm.score_texts(none, F.lit(True)).count() == 0
    alone = lm.score_texts(unique, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in alone)


def test_lm_is_normalised_and_rare_words_are_joined(spark, odd, monkeypatch):
    table = lm.train(np.random.default_rng(0).integers(0, 9, (12, 12)))
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-5)
    unique = odd.dropDuplicates(["doc_id"])
    a = lm.score_texts(unique, F.lit(True)).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "FREQUENT", 3)
    b = lm.score_texts(unique, F.lit(True)).orderBy("doc_id").collect()
    for x, y in zip(a, b, strict=True):
        assert (x["n_tokens"], x["n_known"]) == (y["n_tokens"], y["n_known"])
        assert x["base_score"] == pytest.approx(y["base_score"], rel=1e-9)


CONTROL = st.sampled_from(["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|image:3|>", "\\", "<", "[", "\n", "x"])


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["<|turn|>", "<|end|>\n", "</s>", "<\\/s>", "[INST]", "[\\\\INST]", "[/INST]", "<</SYS>>", "<|image:3|>", "\\", "<", "[", "\n", "é", "$1", "%0A"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb%25", "</s>", ""]), "".join(rng.choices(parts, k=6))) for c in range(60) for t in range(rng.randrange(1, 4))]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shaped = chat.format_turns(data.withColumn("parts", chat.text_part(F.col("text"))))
    back = {r["conv_id"]: r for r in chat.read_back(shaped).collect()}
    for c, talk in itertools.groupby(rows, key=lambda r: r[0]):
        talk = [(r[2], r[3]) for r in talk]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == talk
        assert back[c]["loss_texts"] == [x for role, x in talk if role == "assistant"]
        assert "</s>" not in back[c]["formatted"] and back[c]["formatted"].count("<|turn|>") == len(talk)


def test_chat_parts_and_nulls(spark):
    kind = f"conv_id long, turn long, role string, parts array<{chat.PART}>, conv string"
    rows = [
        (1, 2, "assistant", [("text", "two  words", None, None)], "c"),
        (1, 1, "user", [("text", "see ", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", None), (None, "plain", None, None)], "c"),
        (1, 3, "user", [("document", None, "d.pdf", 3)], "c"),
        (None, None, None, None, "c"),
        (None, None, None, None, "c"),
    ]
    found = {r["conv_id"]: r for r in chat.format_turns(spark.createDataFrame(rows, kind)).collect()}
    assert found[1]["formatted"] == (
        "<|turn|>user\nsee <|image:0|><|audio:1|>plain<|end|>\n<|turn|>assistant\ntwo  words<|end|>\n<|turn|>user\n<|document:2|><|end|>\n"
    )
    assert [(a["number"], a["kind"], a["ref"], a["turn"], a["tokens"]) for a in found[1]["attachments"]] == [
        (0, "image", "i.png", 0, 512), (1, "audio", "a.wav", 0, 25), (2, "document", "d.pdf", 2, 1800),
    ]
    assert found[1]["n_tokens"] == 1 + 512 + 25 + 1 + 2 + 1800 and found[1]["loss_turns"] == [1]
    assert found[None]["formatted"] == "<|turn|>\n<|end|>\n" * 2
    assert chat.format_turns(spark.createDataFrame([], kind)).count() == 0


def test_chat_control_strings_across_parts(spark):
    def text(s):
        return ("text", s, None, None)

    image = ("image", None, "i.png", 1)
    talks = [
        [text("<|tu"), text("rn|>a"), text("[IN"), text("ST] b")],
        [text("</"), image, text("s> <"), image, text("|end|>"), text("<"), text("|end"), text("|>")],
        [text("<"), text("\\"), text("|end|>"), (None, "<", None, None)],
    ]
    rows = [(i, 0, "assistant", parts) for i, parts in enumerate(talks)]
    data = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(data)).collect()}
    for i, parts in enumerate(talks):
        number = itertools.count()
        want = "".join(f"<|image:{next(number)}|>" if p[0] == "image" else p[1] for p in parts)
        assert [t["text"] for t in back[i]["turns"]] == [want] == back[i]["loss_texts"]
        assert back[i]["formatted"].count("<|turn|>") == back[i]["formatted"].count("<|end|>") == 1


def test_repeats_cases(spark, odd, none):
    assert suffixdedup.remove_repeats(none).count() == 0
    found = suffixdedup.remove_repeats(odd).collect()
    assert len(found) == len(ROWS)
    by = {r["doc_id"]: r for r in found}
    assert by[9]["n_removed"] == 3000 and by[3]["n_bytes"] == 0
    kept = suffixdedup.without_repeats(odd, length=40)
    assert kept.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[3] is None and texts[4] == "" and texts[1] == "" and texts[7] == ROWS[6][1]


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, limit):
    """With few runs per anchor allowed, windows are counted by digest instead; rows are the same."""
    monkeypatch.setattr(suffixdedup, "ANCHOR_RUNS", limit)
    rng = random.Random(2)
    shared = ["".join(rng.choices("abé ", k=k)) for k in (20, 60, 90)]
    texts = ["".join(rng.choice(shared)[rng.randrange(9) :] + "".join(rng.choices("xyz", k=rng.randrange(8))) for _ in range(3)) for _ in range(40)]
    found = {r["doc_id"]: r for r in suffixdedup.remove_repeats(frame(spark, [(i, t, "", "") for i, t in enumerate(texts)]), length=24).collect()}
    for i, flags in enumerate(brute_cuts([t.encode() for t in texts], 24)):
        assert found[i]["n_removed"] == sum(flags)


@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5), st.integers(4, 9))
@settings(max_examples=80, deadline=None)
def test_interval_expansion(texts, length):
    got = suffixdedup.repeated_windows(texts, length)
    every = [t[i : i + length] for t in texts for i in range(len(t) - length + 1)]
    for t, windows in zip(texts, got, strict=True):
        assert windows.tolist() == [i for i in range(len(t) - length + 1) if every.count(t[i : i + length]) > 1]


@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=2, max_size=6), st.integers(4, 20), st.data())
@settings(max_examples=150, deadline=None)
def test_likely_runs_hold_all_repeats(texts, length, data):
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    runs = set()
    for i, start, n, anchor in zip(*(x.tolist() for x in suffixdedup.runs_of(raw, at, length)), strict=True):
        runs.add((anchor, texts[i][start : start + n + length - 1]))
    runs = sorted(runs)
    if not runs:
        return
    once = [data.draw(st.booleans()) for _ in runs]
    windows = [{(a, p[k : k + length]) for k in range(len(p) - length + 1)} for a, p in runs]
    likely = suffixdedup.likely_runs([p for _, p in runs], [a for a, _ in runs], once, length)
    for i, own in enumerate(windows):
        if any(own & other and (once[i] or once[j]) for j, other in enumerate(windows) if j != i):
            assert i in likely


@pytest.mark.parametrize("limit", [4096, 2])
def test_passages_equal_brute_force(spark, monkeypatch, limit):
    """Shorter passages are counted, too; what is removed stays as without them."""
    monkeypatch.setattr(suffixdedup, "ANCHOR_RUNS", limit)
    rng = random.Random(3)
    shared = ["".join(rng.choices("abé ", k=k)) for k in (20, 40, 60, 90)]
    texts = ["".join(rng.choice(shared)[rng.randrange(9) :] + "".join(rng.choices("xyz", k=rng.randrange(12))) for _ in range(3)) for _ in range(40)]
    texts += ["".join(rng.choices("mnopq", k=60)) for _ in range(5)] + texts[:3] + ["", "b" * 300, "x" * 23]
    docs = frame(spark, [(i, t, "", "") for i, t in enumerate(texts)] + [(99, None, "", "")])
    found = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs, length=40, passage=24).collect()}
    plain = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs, length=40).collect()}
    assert len(found) == len(texts) + 1 and found[99]["n_passage_bytes"] == 0
    raw = [t.encode() for t in texts]
    short = 0
    for i, (long_flags, flags) in enumerate(zip(brute_cuts(raw, 40), brute_cuts(raw, 24), strict=True)):
        assert (found[i]["n_removed"], found[i]["n_passage_bytes"]) == (sum(long_flags), sum(flags))
        assert all(found[i][c] == plain[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
        short += any(flags) and not any(long_flags)
    assert short
    with pytest.raises(ValueError):
        suffixdedup.remove_repeats(docs, length=24, passage=24)


def test_passages_below_the_removed_length(spark, tmp_path):
    """The query reports a passage of 320 bytes, which its contract leaves in place."""
    from loomstat.llm.queries import QUERIES

    short, long = passage(1, 320), passage(2)
    rows = [(1, passage(3, 300) + short + passage(4)), (2, short + passage(5, 200)), (3, passage(6, 300)), (4, long + passage(7)), (5, passage(8) + long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_removed"], r["n_passage_bytes"]) for r in QUERIES["op6_suffix_dedup"](spark, str(tmp_path)).collect()}
    raw = [t.encode() for _, t in rows]
    for (i, _), cut, flags in zip(rows, brute_cuts(raw, 400), brute_cuts(raw, 240), strict=True):
        assert found[i] == (sum(cut), sum(flags))
    assert [found[i][0] > 0 for i in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
    assert [found[i][1] > 0 for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True]


def test_ledger_is_idempotent(spark, odd, none, tmp_path):
    ranks = rollup.public_ranks(spark)
    counted = rollup.count_tokens(odd, ranks)
    ledger = rollup.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("one", counted) and not ledger.commit("one", counted)
    before = ledger.totals()
    assert before.agg(F.sum("docs")).first()[0] == len(ROWS)
    some = counted.filter("key = 7")
    revised = some.withColumn("tokens", F.col("tokens") + 5)
    assert ledger.commit("two", rollup.revisions(some, revised)) and not ledger.commit("two", revised)
    assert ledger.totals().agg(F.sum("tokens")).first()[0] == before.agg(F.sum("tokens")).first()[0] + 5
    assert ledger.commit("three", rollup.deletes(counted).union(rollup.deletes(revised)).union(some))
    assert ledger.totals().count() == 0
    assert rollup.count_tokens(none, ranks).count() == 0


def test_simhash_cases(spark, odd, none):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert found[3]["fingerprint"] == "0" * 16 and {found[k]["component_id"] for k in (3, 4, 5)} == {3}
    assert found[2]["component_id"] == 1 and simhash.near_duplicates(odd).count() == len(ROWS)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("limit", [64, 2])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, limit):
    """Chains and dense clusters, also when cells count as full and single flips are used."""
    monkeypatch.setattr(simhash, "CELL_ROWS", limit)
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * rng.randrange(2)
        prints |= {f ^ 1 << b for b in range(30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    roots = brute_components({p: p & (1 << 64) - 1 for p in signed})
    groups = {}
    for p, root in roots.items():
        groups.setdefault(root, set()).add(p)
    for members in groups.values():
        assert len({found.get(p, p) for p in members}) == 1
    assert len({found.get(p, p) for p in signed}) == len(groups)


def test_fingerprint_equals_plain_version():
    for text in ["", "One", "a b", "a b c", "A\x0bb\tC d é É", LONG[:3000], "x " * 500]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (None, 1), (8, None), (8, 0)], "doc_id long, quality int")
    model = quality.learn(odd, labels, F.lit(True))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(none, model).count() == 0
    empty = quality.learn(none, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(odd, empty).collect()} == {0.5}


def test_calibration_learns_a_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.normal(size=1500) > 0).astype(float)
    weights, temperature = quality.fit_network(x, y)
    z = quality._forward(x, weights)[1]
    assert ((z > 0) == y).mean() > 0.85 and 0.25 <= temperature <= 8


def test_viterbi_is_the_best_segmentation():
    v = vocabulary()
    scores = {p: s for p, s in zip(v.pieces[256:], v.scores[256:], strict=True)}

    def total(ids):
        return sum(pieces.BYTE_SCORE if k < 256 else v.scores[k] for k in ids)

    def best(unit):
        if not unit:
            return 0.0
        heads = [scores[p] + best(unit[len(p) :]) for p in scores if unit.startswith(p)]
        return max([*heads, len(unit[0].encode()) * pieces.BYTE_SCORE + best(unit[1:])])

    for n in range(1, 6):
        for letters in itertools.product("ab▁é", repeat=n):
            unit = "".join(letters)
            assert total(v.best(unit)) == pytest.approx(best(unit))


@given(st.text("ab é▁\n\x00😀", max_size=30))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(text):
    v = vocabulary()
    assert v.decode(v.encode(text)) == text


@given(st.text("aaab ▁é", max_size=60), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_long_units_in_blocks(text, block):
    """Blocks of any size give the segmentation of the whole."""
    whole = vocabulary().encode(text)
    before = pieces.BLOCK_BYTES
    try:
        pieces.BLOCK_BYTES = block
        assert vocabulary().encode(text) == whole
    finally:
        pieces.BLOCK_BYTES = before


def test_memory_is_bounded_and_of_no_effect(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    v, rng = vocabulary(), random.Random(3)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abé", k=rng.randrange(4))) for _ in range(20))
        assert v.encode(text) == vocabulary().encode(text)
        # a batch is added as a whole
        assert len(v.memory) <= 5 + 20 and len(v.before) <= 5 + 20


@given(st.lists(st.text("aab▁é", min_size=1, max_size=20), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_units_side_by_side(units):
    v = vocabulary()
    raw = [u.encode() for u in units]
    assert v.best_many(raw) == [v.best_bytes(u) for u in raw]


def test_unit_of_megabytes_in_flat_memory():
    import tracemalloc

    v = vocabulary()
    tracemalloc.start()
    assert len(v.encode("ab" * 500_000)) == 500_001
    assert tracemalloc.get_traced_memory()[1] < 24_000_000
    tracemalloc.stop()


def test_pieces_cases(spark, odd, none):
    v = vocabulary()
    coded = pieces.encode(odd, v)
    rows = coded.collect()
    assert len(rows) == len(ROWS) and all(r["exact"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["piece_ids"] == [] == by[4]["piece_ids"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded, v).collect()}
    assert back == {i: t or "" for i, t, _, _ in ROWS}
    assert pieces.encode(none, v).count() == 0


def test_stages_handle_odd_rows(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([(i, t, g, s, 0) for i, t, g, s in ROWS], []):
        docs = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == corpus_pipeline.COLUMNS, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert sorted(r["doc_id"] for r in last.collect()) == ([1, 7, 8, 9, 10, 11] if rows else [])


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EVALUATED = "the quick brown fox jumps over the lazy dog while nobody looks at the old red barn"


def passage(seed, k=500):
    return "".join(random.Random(seed).choices("abcdefghij ", k=k))


def staged(spark, folder, stage, rows):
    """(doc_id, text) that a stage keeps of rows (doc_id, text, lang), sorted."""
    import corpus_pipeline

    items = spark.createDataFrame([(1, EVALUATED)], "item_id long, text string")
    items.write.mode("ignore").parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], STAGE_COLUMNS)
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(folder))
    return sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)


def test_repeats_of_one_key_with_several_texts(spark):
    """Every row is cut by the spans of its own text, whatever other texts its key has."""
    shared = passage(1)
    rows = [(7, passage(2, 90) + shared), (7, passage(3, 700)), (7, "short"), (8, shared + passage(4, 50)), (7, passage(5, 60) + shared + "!")]
    found = suffixdedup.remove_repeats(frame(spark, [(i, t, "", "") for i, t in rows])).collect()
    want = [(i, len(t), sum(flags)) for (i, t), flags in zip(rows, brute_cuts([t.encode() for _, t in rows], 400), strict=True)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found) == sorted(want)


def test_stages_judge_each_text_of_a_key(spark, tmp_path):
    clean = (7, "Der Hund und die Katze schlafen heute nicht.", "de")
    other = (7, "Une autre phrase sans aucun rapport avec les animaux.", "fr")
    assert staged(spark, tmp_path, "language", [clean, (7, "123 !", "de")]) == [clean[:2]]
    assert staged(spark, tmp_path, "benchmark", [clean, (7, EVALUATED, "en")]) == [clean[:2]]
    assert staged(spark, tmp_path, "near_duplicates", [(3, clean[1], "de"), clean, other]) == [(3, clean[1]), other[:2]]
    cut = staged(spark, tmp_path, "repeats", [(7, passage(1), "en"), (8, passage(1), "en"), (7, passage(2), "en")])
    assert cut == sorted([(7, ""), (8, ""), (7, passage(2))], key=str)


def test_stages_judge_rows_without_key(spark, tmp_path):
    clean = (None, "Der Hund und die Katze schlafen heute nicht.", "de")
    assert staged(spark, tmp_path, "language", [clean, (None, "123 !", "de"), (1, "x", "de")]) == sorted([clean[:2], (1, "x")], key=str)
    assert staged(spark, tmp_path, "benchmark", [clean, (None, EVALUATED, "en")]) == [clean[:2]]
    copies = [clean, clean, (None, "one more text", "en"), (4, "one more text", "en"), (4, "one more text", "en")]
    kept = [(4, "one more text"), clean[:2]]
    assert staged(spark, tmp_path, "near_duplicates", copies) == sorted(kept, key=str)
    alone, shared = passage(2), passage(1)
    rows = [(None, shared + "12"), (1, "34" + shared), (None, alone), (None, passage(3) + passage(3))]
    assert staged(spark, tmp_path, "repeats", [(i, t, "en") for i, t in rows]) == sorted([(None, "12"), (1, "34"), (None, alone), (None, "")], key=str)


def test_language_stage_keeps_letters_when_nothing_is_learned(spark, tmp_path):
    texts = ["Der Hund schläft.", "x", "12 !", "", None]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    assert staged(spark, tmp_path, "language", rows) == [(0, texts[0]), (1, "x")]
    # a labelled row of fold 0 teaches nothing
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert staged(spark, tmp_path, "language", [(alone, "Der Hund schläft.", "de")]) == [(alone, "Der Hund schläft.")]


def test_language_stage_names_unknown_languages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, EVALUATED)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    german, french = "Der Hund und die Katze schlafen heute nicht, und das ist gut so.", "Le chien et le chat dorment dans la maison, et la nuit est belle."
    rows = [(i, f"{t} {i}", g, "s", 0) for i in range(1, 20) for t, g in ((german, "de"), (french, "fr"))]
    rows += [(100, "Die Katze und der Hund schlafen gut.", None, "s", 0), (None, "La nuit est belle et le chat dort.", None, "s", 0), (101, "7", None, "s", 0), (102, french, "de", "s", 0)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, STAGE_COLUMNS), str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == len(rows) - 1
    found = {r["doc_id"]: r["lang"] for r in kept.filter("doc_id >= 100 OR doc_id IS NULL").collect()}
    assert found == {100: "de", None: "fr", 102: "de"}


def test_a_table_twice_keeps_each_row_once(spark, odd):
    once = sorted(map(str, simhash.keep_one(odd).collect()))
    assert sorted(map(str, simhash.keep_one(odd.union(odd).union(odd)).collect())) == once


def test_every_letter_of_a_large_alphabet_counts():
    """Hundreds of letters, of which one shared symbol would make one endless match."""
    rng = random.Random(6)
    alphabets = {"p": [chr(0x4E00 + k) for k in range(400)], "q": [chr(0x4E00 + k) for k in range(200, 600)], "r": list("абвгдежз")}
    lines = {g: " ".join("".join(rng.choices(a, k=rng.randrange(1, 9))) for _ in range(700)) for g, a in alphabets.items()}
    model = langid.fit({g: [t] for g, t in lines.items()})
    assert set(model.symbol_of) == {c for t in lines.values() for c in t if c != " "}
    texts = [" ".join(rng.choices(lines[g].split(), k=40)) for g in lines]
    count, sizes, letters = langid.phrases(model, texts)
    for k, line in enumerate(lines.values()):
        assert count[k, k] == plain_phrases(texts[k] + " ", line)
    assert (count * model.bits[:, None]).argmin(axis=0).tolist() == [0, 1, 2]
