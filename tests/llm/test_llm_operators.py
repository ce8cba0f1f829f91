"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import ctypes
import hashlib
import os
import random
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from graphmem.llm import queries as registered

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long, grp long, rest string, kept string, w string, score double"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if k % 3 else "en", f"s{k}", len(t or ""), k, "r", "k", "w", 0.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOC)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(seed=3, n=60):
    """Copies, near copies, shared passages, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfgé") + rng.choice("aeiou") * rng.randint(1, 2) + str(k % 7) for k in range(400)]

    def text(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k)).replace("5 ", "5\n")

    passage, base = text(30), text(120)
    out = [None, "", "   \n", "one", "one", "One", "two words", base, base, base.replace(" ", "  ", 1)]
    for k in range(n):
        t = text(rng.randint(1, 150))
        out.append(t if k % 4 else f"{t} {passage} {text(5)}")
        if k % 3 == 0:
            w = base.split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
    return [*out, text(20000)]


# --- 9 -------------------------------------------------------------------------------------------------------


def brute_substring(rows, size):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1 if i is not None else 0):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark):
    from graphmem.llm.substring_dedup import substring_dedup

    texts = corpus()
    ids = [*range(5, len(texts) + 1), None, 7, 7, None][: len(texts)]
    got = substring_dedup(table(spark, texts, ids), 13, joined=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_substring(list(zip(ids, texts, strict=True)), 13))
    assert any(r["n_removed"] for r in got)


def test_remove_repeats_keeps_layout(spark):
    from graphmem.llm.substring_dedup import remove_repeats

    passage = " ".join(f"p{k}" for k in range(20))
    docs = table(spark, [f"a\n{passage} b", f"c  d {passage}\ne  f", None, "g  h\n"])
    got = remove_repeats(docs, 13)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [rows[k]["text"] for k in range(4)] == [f"a\n{passage} b", "c  d e  f", "", "g  h\n"]
    assert rows[1]["n_chars"] == 9 and rows[1]["rest"] == "r"
    assert remove_repeats(docs.limit(0), 13).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------


def brute_jaccard(rows, size, percent):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    sets = [frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := words(t)) else frozenset() for t in low]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                degree.update((a, b))
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(i, len(sets[k]), None if i is None else min(x for x in least[find(k)] if x is not None), degree[k]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50), (3, 100)])
def test_jaccard_join(spark, size, percent):
    from graphmem.llm.jaccard_join import jaccard_join

    texts = corpus()
    ids = [*range(100, 100 + len(texts) - 1), None]
    got = jaccard_join(table(spark, texts, ids), size, percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_jaccard(list(zip(ids, texts, strict=True)), size, percent))


def test_jaccard_tiles(spark, monkeypatch):
    """A class over several tiles gives the same links."""
    from graphmem.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_COLUMNS", 32)
    texts = corpus(5)
    expected = Counter(brute_jaccard(list(enumerate(texts)), 3, 80))
    for light in (32, 4, 1):  # documents of few, or of no n-grams are paired one by one
        monkeypatch.setattr(jaccard_join, "LIGHT", light)
        assert Counter(map(tuple, jaccard_join.jaccard_join(table(spark, texts), 3, 80).collect())) == expected


def test_jaccard_chain(spark, monkeypatch):
    """Each text shares its rare shingles with the next one: one class, but as many pairs as texts."""
    from graphmem.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 16)
    tiles, sizes = jaccard_join._tiles, []

    def counted(*a):
        tiled, scratch = tiles(*a)
        sizes.append(tiled.count())
        return tiled, scratch

    monkeypatch.setattr(jaccard_join, "_tiles", counted)
    texts = [f"l{k} m{k} n{k} l{k + 1} m{k + 1} n{k + 1}" for k in range(200)]
    got = jaccard_join.jaccard_join(table(spark, texts), 3, 10).collect()
    assert Counter(map(tuple, got)) == Counter(brute_jaccard(list(enumerate(texts)), 3, 10))
    assert len({r["component_id"] for r in got}) == 1 and sizes[0] <= 2 * len(texts)


def test_rows_without_ids_are_spread(spark):
    from graphmem.llm import sketch
    from graphmem.llm.jaccard_join import jaccard_join
    from graphmem.llm.substring_dedup import substring_dedup

    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'same text of some words' as text").unionByName(spark.range(3).selectExpr("id as doc_id", "'same text of some words' as text"))
    layout = sketch.Layout(docs, "text", 4)
    dealt = layout.dealt(docs, "doc_id", "text").groupBy("grp").count().collect()
    assert len(dealt) == layout.groups and max(r["count"] for r in dealt) < 2 * 5000 / layout.groups
    found = jaccard_join(docs, 3, 90)
    assert found.where("doc_id is null").count() == 5000 and {tuple(r) for r in found.where("doc_id is not null").collect()} == {(k, 3, 0, 2) for k in range(3)}
    assert substring_dedup(docs, 3).where("n_removed > 0").count() == 2


def test_one_of_each(spark):
    from graphmem.llm.jaccard_join import one_of_each

    docs = table(spark, ["a b c d e f g", "a b c d e f g", "x y z", None, "", None], [3, 2, 1, 4, 5, None])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 5, None]
    assert one_of_each(docs.limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------


def brute_leaks(rows, items, size):
    grams = {}
    for i, t in items:
        w = plain(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = plain(t)
        hit, found = set(), set()
        for g, who in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= who
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def leak_case(spark):
    item = "Alpha beta, gamma-delta 5 epsilon zeta eta theta iota kappa lambda"
    items = [(12, item), (3, "short one"), (4, item.lower()), (5, None), (6, ""), (None, "nobody owns this")]
    texts = [f"x {item} y", item[6:], "a SHORT: one, short one", None, "", "clean text here", f"{item} {item}", "Nobody owns this.", f"x {item} y"]
    return table(spark, texts, [9, 8, 7, 6, 5, None, 3, 2, 9]), spark.createDataFrame(items, "item_id long, text string"), texts, items


def test_contamination(spark, monkeypatch):
    from graphmem.llm import decontaminate

    docs, items, texts, raw = leak_case(spark)
    expected = Counter(map(repr, brute_leaks(list(zip([9, 8, 7, 6, 5, None, 3, 2, 9], texts, strict=True)), raw, 10)))

    def got():
        return Counter(repr((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"])) for r in decontaminate.contamination(docs, items).collect())

    assert got() == expected
    monkeypatch.setattr(decontaminate, "MAX_VERIFYING_BYTES", 0)  # the ways beyond the bounds
    assert got() == expected
    monkeypatch.setattr(decontaminate, "PASS", 3)
    assert got() == expected
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_contamination_by_a_large_set(spark):
    """More windows than a literal set would hold: the same rows, whichever way they are looked up."""
    from graphmem.llm import decontaminate

    docs, items, texts, raw = leak_case(spark)
    expected = Counter(map(repr, brute_leaks(list(zip([9, 8, 7, 6, 5, None, 3, 2, 9], texts, strict=True)), raw, 10)))
    many = spark.range(30_000).selectExpr("id + 1000 as item_id", "array_join(transform(sequence(0, 12), i -> concat('q', id, 'r', i)), ' ') as text")
    got = decontaminate.contamination(docs, items.unionByName(many)).collect()
    assert Counter(repr((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"])) for r in got) == expected


def test_long_texts_of_leaks(spark):
    """A megabyte with 30,000 separate hits takes seconds."""
    from graphmem.llm import decontaminate

    began = time.perf_counter()
    docs, items = table(spark, ["short one, and so on and on; " * 36_000]), spark.createDataFrame([(1, "short one")], "item_id long, text string")
    row = decontaminate.contamination(docs, items).selectExpr("n_words", "n_hit", "size(spans) as n").first()
    assert tuple(row) == (252_000, 72_000, 36_000)
    assert decontaminate.decontaminated(docs, items).selectExpr("length(text) as n").first()["n"] == len("and so on and on; ") * 36_000
    assert time.perf_counter() - began < 30


def test_decontaminated(spark):
    from graphmem.llm.decontaminate import decontaminated

    docs, items, texts, _ = leak_case(spark)
    cut = decontaminated(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    by = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by[9] == "x y" and by[7] == "a " and by[3] == "" and by[6] is None and by[None] == "clean text here"
    assert sorted(str(r["doc_id"]) for r in decontaminated(docs, items, remove="documents").collect()) == ["5", "6", "None"]


# --- 3 and 8 ---------------------------------------------------------------------------------------------------

ALPHABET = ["a", "b", "the", " the", " ", "  ", "\n", "▁", "é", "</s>", "<unk>", "<0x0A>", "\t", "\r\n", "(", "漢", "😀", "\x00", ".", "​", "　"]


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["", " ", "\n", "word " * 30000]


def test_token_counts(spark):
    import sentencepiece

    from graphmem.llm.token_counts import token_counts

    texts = [*odd_texts(), None]
    got = {r["doc_id"]: r for r in token_counts(table(spark, texts), MODEL, 4096).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((t or "").encode()), n > 4096)
    assert token_counts(table(spark, []), MODEL).count() == 0


def test_token_counts_of_another_library(spark):
    from tokenizers import Tokenizer

    from graphmem.llm.token_counts import token_counts

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["Hello  world", "", None, "<|endoftext|> x"]
    model = Tokenizer.from_file(path)
    assert [r["n_tokens"] for r in token_counts(table(spark, texts), path).orderBy("doc_id").collect()] == [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_ids_are_those_of_the_library(spark):
    import sentencepiece

    from graphmem.llm.sentencepiece_codec import encode

    texts = [*odd_texts(2000, 4), None, "unbelievable thereupon", " " * 17 + "x", "def f(self):\n        return {'a': 1}"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r for r in encode(table(spark, texts), MODEL, verify_col="same", search="merges").collect()}
    assert all(got[k]["piece_ids"] == model.encode(t or "") and got[k]["same"] for k, t in enumerate(texts))


def test_viterbi_is_best_and_round_trips(spark):
    from graphmem.llm.sentencepiece_codec import codec, decode, encode

    texts = [*odd_texts(), None]
    docs = table(spark, texts)
    encoded = encode(docs, MODEL)
    assert encoded.columns == [*docs.columns, "piece_ids"]
    back = {r["doc_id"]: r["decoded"] for r in decode(encoded, MODEL).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(texts))
    named = docs.withColumnRenamed("lang", "piece_ids").withColumnRenamed("w", "same")
    again = encode(named, MODEL, verify_col="same")
    assert again.columns == [*[c for c in docs.columns if c not in ("lang", "w")], "piece_ids", "same"] and again.where("same").count() == len(texts)
    assert encode(docs.limit(0), MODEL).count() == 0 and decode(encoded.limit(0), MODEL).count() == 0
    own = codec(MODEL)

    def best(word):
        """Greatest total score over all segmentations, by a plain forward search."""
        score = [0.0] + [float("-inf")] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                hit = own.endings.get(word[i:j])
                score[j] = max(score[j], score[i] + (hit[0] if hit else own.unknown_score if j - i == 1 else float("-inf")))
        return score[-1]

    scores = {piece: hit[0] for piece, hit in own.endings.items() if hit}
    sample = sorted({" " + w for t in odd_texts(80, 9)[:80] for w in t.replace("▁", " ").split(" ") if "\n" not in w} | {" thereupon", " unbelievable", " the"})
    for word, ids in zip(sample, own.encode_sorted(sample), strict=True):
        total, k = 0.0, 0
        while k < len(ids):
            piece = own.spelled[own.spelled_at[ids[k]] : own.spelled_at[ids[k] + 1]].tobytes()
            if ids[k] in own.bytes.values():  # a character in bytes
                n = 1 if piece[0] < 0x80 else 2 if piece[0] < 0xE0 else 3 if piece[0] < 0xF0 else 4
                total, k = total + own.unknown_score, k + n
            else:
                total, k = total + scores[piece.decode()], k + 1
        assert total == pytest.approx(best(word), rel=1e-12)


# --- 4 -------------------------------------------------------------------------------------------------------


def test_quality_base_figures(spark):
    from graphmem.llm.quality_rules import quality_rules

    texts = [*corpus(8, 30), "a b\n\na b\n c\na b \n", "# $ x%\n|<&>| é", "x y z q r s t u " * 9]
    got = {r["doc_id"]: r for r in quality_rules(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        figures = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again))
        row = got[k]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == figures
        assert row["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (row["base_failed"] and row["kept"])


def test_quality_verdicts(spark):
    from graphmem.llm.quality_rules import quality_rules

    clean = "\n".join(" ".join(f"w{k}{j * j}" for j in range(9)) + "." for k in range(8))
    bars = " | ".join(f"menu{k}" for k in range(60))
    signs = " ".join(f"word{k}%%%" for k in range(60))
    rows = quality_rules(table(spark, [clean, bars, signs, clean + "\nAccept all cookies", "a title\n" + clean]), cleaned=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, False, True, True]
    assert rows[3]["cleaned"] == clean and rows[1]["cleaned"] == ""


def brute_verdict(t):
    """Lost share and verdict of the line rules, word by word."""
    from graphmem.llm.quality_rules import BOILERPLATE, BULLETS, ENDINGS

    size = lost = 0
    for line in (t or "").split("\n"):
        w = words(line)
        n, bytes_ = len(w), sum(len(x.encode()) for x in w)
        signs = sum(c in "#*$%&<>" for c in line)
        bad = n > 0 and (
            (line.count("|") >= 3 and line.count("|") * 6 >= n)
            or (signs > 2 and signs * 2 > n)
            or (w[-1][-1] not in ENDINGS and not (w[0] in BULLETS or re.fullmatch("[0-9]+[.)]", w[0])) and sum(c in ".!?" for c in line) * 40 < n)
            or (n <= 12 and bool(BOILERPLATE.search(line.encode())))
        )
        size, lost = size + bytes_, lost + bytes_ * bad
    w = words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    share = lost / max(1, size)
    return share, not (len(w) < 20 or 100 * len(again) > 30 * len(w)) and share <= 0.5


def test_quality_verdicts_by_brute_force(spark):
    from graphmem.llm.quality_rules import quality_rules

    rng = random.Random(12)
    parts = ["", "a line of prose without an end", "a line of prose.", "« une ligne »", "ligne \u2026", "- an item", "12) an item", "12x) no item", "\u2022 an item", "a | b | c | d", "### $$$ x", "Read more about it", "word " * 90, "word. " + "word " * 30, "word. " + "word " * 60, "end\u3002", "caf\u00e9", "\t", "-", "1.", "privacy policy " + "x " * 20]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)] + [None, "", "\n", "x" * 100_000 + " y" * 100_000]
    got = {r["doc_id"]: (r["lost"], r["kept"]) for r in quality_rules(table(spark, texts)).collect()}
    assert all(got[k] == brute_verdict(t) for k, t in enumerate(texts))
    assert {k for _, k in got.values()} == {True, False} and quality_rules(table(spark, [])).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------


def test_languages(spark, small):
    from graphmem.llm.language_id import Model, codewords, fit, identify

    got = registered.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    docs = table(spark, [None, "", "123 !?", "é", "the of and", "the of and"])
    nothing = identify(docs, fit(docs.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    one = {r["doc_id"]: r for r in identify(docs, fit(docs)).collect()}
    assert [one[k]["lang_pred"] for k in range(6)] == ["und", "und", "und", "en", "en", "en"]
    assert isinstance(fit(docs), Model)
    code = codewords(5)
    assert min((code[a] != code[b]).sum() for a in range(5) for b in range(a)) >= 5


def test_language_decoder_by_a_loop():
    """Features, weighted loss and decision of each text, number by number; ties are ambiguous and go to the first name."""
    from graphmem.llm import language_id as li

    rng = np.random.default_rng(4)
    model = li.Model(["a", "b", "c"], li.codewords(3), rng.standard_normal((li.BUCKETS, li.BITS)).astype(np.float32) * 30, np.zeros(li.BITS), rng.random(li.BITS) + 0.1)
    texts = ["Hello, W\u00f6rld 12", "z", "abc " * 3000, "123", ""]
    names, score, second = li.predict(model, pa.array(texts))
    for t, name, s, other in zip(texts, names, score, second, strict=True):
        raw = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in t.encode()]
        counts = Counter()
        for k in (1, 2, 3):
            for i in range(len(raw) - k + 1):
                gram = 0
                for b in raw[i : i + k]:
                    gram = gram * 257 + b
                counts[((gram + k) * 0x9E3779B1 >> 15) & (li.BUCKETS - 1)] += 1
        total = max(1, sum(counts.values()))
        margin = [sum(float(model.weights[g, j]) * n / total for g, n in counts.items()) for j in range(li.BITS)]
        loss = [sum(model.trust[j] * np.log1p(np.exp(-margin[j] * code[j])) for j in range(li.BITS)) for code in model.codes]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        if any(c.isalpha() for c in t):
            assert name == model.languages[int(p.argmax())] and s == pytest.approx(p.max(), abs=1e-4) and other == pytest.approx(np.sort(p)[-2], abs=1e-4)
        else:
            assert (name, s) == ("und", 0.0)
    model.weights[:] = 0
    assert li.predict(model, pa.array(["tie"]))[0] == ["a"]


def test_trust_differs_and_decides():
    from graphmem.llm import language_id as li

    rng = random.Random(6)
    texts, languages = [], []
    for k in range(90):
        own = ("the of and in", "le la de et", "der die und in")[k % 3].split()
        texts.append(" ".join(rng.choice(own if rng.random() < 0.6 else ["xyz", "qua", "in"]) for _ in range(8)))
        languages.append(("en", "fr", "de")[k % 3])
    model = li.train(pa.array(texts), languages)
    assert model.trust.std() > 0.01 and model.trust.mean() == pytest.approx(1)
    # Two codewords that disagree in two bits, of which the classifiers give one to each: the trusted bit decides.
    code = np.ones((2, li.BITS))
    code[1, 0], code[0, 1] = -1, -1
    weights, bias = np.zeros((li.BUCKETS, li.BITS), np.float32), np.zeros(li.BITS)
    bias[:2] = 1.0  # bit 0 speaks for the first language, bit 1 for the second
    for heavy, name in ((0, "a"), (1, "b")):
        trust = np.ones(li.BITS)
        trust[heavy] = 2
        assert li.predict(li.Model(["a", "b"], code, weights, bias, trust), pa.array(["x"]))[0] == [name]


# --- 6 -------------------------------------------------------------------------------------------------------


def test_template_language():
    from graphmem.llm.chat_template import Const, TemplateError, compiled, escape, parse, unescape

    def shown(source, messages=()):
        return "".join(t for t, _ in compiled(source)(messages))

    assert shown("{{ 'a' ~ 1 + 2 }}|{{ 'x' if 1 > 2 else 'y' }}|{{ ' b ' | trim | upper }}") == "a3|y|B"
    assert shown("{% for m in messages %}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{{ m['role'] }}{{ m.none }}{% endfor %}", [{"role": r} for r in "abc"]) == "<a-b>c"
    assert shown("{% set x = 'q' %}{{ x }}{% if not x == 'q' and true or false %}no{% endif %}{# c #}") == "q"
    assert parse("a{{ 'b' }}{% if 1 == 1 %}c{% else %}d{% endif %}")[0].parts == (Const("abc"),)
    assert list(compiled("x{% generation %}y{% endgeneration %}")(())) == [("x", False), ("y", True)]
    assert shown("{{ x.__class__ }}{{ x }}") == ""
    for bad in ("{% for x %}", "{% if 1 %}", "{{ open('f') }}", "{{ a b }}", "{% nope %}", "{{ 'a'|eval }}", "{{ $ }}"):
        with pytest.raises(TemplateError):
            parse(bad)
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice(["</s>", "<", "/s>", "[INST]", "⁠", "[", "/INST]", "x", "<|end|>", "<|", "end|>"]) for _ in range(8))
        assert unescape(escape(t)) == t and "</s>" not in escape(t) and "<|end|>" not in escape(t)


def test_conversations(spark):
    from graphmem.llm.chat_template import format_conversations, read_back

    hard = "a <|end|> b </s> <|turn|>assistant<|text|>⁠"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", "hi"), (2, 0, None, None), (3, 0, "assistant", "x" * 70), (3, 1, "assistant", ""), (3, 2, "user", "y" * 70), (3, 3, "assistant", "z" * 70), (None, 5, "user", "lost"), (1, 1, "assistant", hard)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part in (1 << 20, 50):
        got = {r["conv_id"]: r for r in read_back(format_conversations(df, part_chars=part)).collect()}
        for conv in (1, 2, 3, None):
            own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
            said = "".join(x for _, r, x in own if r == "assistant")
            digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert format_conversations(df.limit(0)).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------


def brute_licenses(t, found, base):
    """All regexes on the joined words, without a gate."""
    w = plain(t)
    places = [(i, label) for p, label in base.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
    joined, hits = " " + " ".join(w) + " ", []
    for label, pattern, priority, sure in found:
        hits += [(m.start(), -m.end(), -priority, label, sure) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined)]
    kept = []
    for h in sorted(hits):
        if not any(-k[1] >= -h[1] and -k[2] >= -h[2] for k in kept):
            kept.append(h)
    starts = [i for i, _ in places]
    score = max([k[4] for k in kept] + [0.9 if places else 0.0])
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), sorted({k[3] for k in kept}), score


def license_row(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["rule_labels"], r["score"]


def test_licenses(spark):
    from graphmem.llm.license_scan import BASE, NAMES, TEXTS, license_scan, rules

    texts = [None, "", "plain text", "Licensed under the Apache License, Version 2.0", "CC BY 4.0; cc by-nc 4.0", "GNU General Public License version 3. All Rights Reserved. all rights reserved", "mit license MIT", "SPDX-License-Identifier: MIT", "Copyright (c) 2019 2020 X. See the LICENSE file", "cc by", "the general public license", "released into the public domain " * 300, "is licensed under the terms of the mpl 2.0, distributed under the gnu gpl v2"]
    found = rules()
    assert len(NAMES) + len(TEXTS) > 200 and len({r[:2] for r in found}) == len(found)
    got = {r["doc_id"]: r for r in license_scan(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert license_row(got[k]) == brute_licenses(t, found, BASE), t
    assert license_scan(table(spark, [])).count() == 0


def test_license_names_on_their_own(spark):
    from graphmem.llm.license_scan import license_scan

    texts = {"MIT License": "mit", "Apache License, Version 2.0": "apache-2.0", "GPLv3": "gpl-3.0", "licensed under LGPL": "lgpl", "the Unlicense": "unlicense", "mit dem Hund": None, "X11 window": None}
    for r, (t, label) in zip(license_scan(table(spark, list(texts))).orderBy("doc_id").collect(), texts.items(), strict=True):
        assert (label in r["rule_labels"]) if label else not r["rule_labels"], t


def test_licenses_need_no_keyword(spark):
    """Phrases that lack a rule's keywords, and spellings of all rules, against all regexes without a gate."""
    from graphmem.llm.license_scan import BASE, _spellings, license_scan, needs, parser, rules

    texts = """licence MIT|licensed under the Expat license|license 0BSD|license MS-PL|released under MS-RL|license PSF license|license open rail|license beer ware|for non-commercial use only|
        for noncommercial purposes only|registered trademarks of|license Creative Commons Attribution-Non-Commercial|license Creative Commons Attribution Share Alike|license Creative Commons Attribution NoDerivs|
        gnu general public license v3|license eupl1 2|unauthorized copying of this file by any means is strictly prohibited|\u2028licence\u00a0mit licence mit""".split("|")
    found, rng = rules(), random.Random(10)
    for r in found:
        texts += [x.replace("\0", "7") for x in rng.sample(sorted(_spellings(parser.parse(r[1]))), 1)]
    texts += [" ".join(rng.sample(texts, 4)) for _ in range(100)]
    got = {r["doc_id"]: r for r in license_scan(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert license_row(got[k]) == brute_licenses(t, found, BASE), t
    own = [("any", "a?b(?: c)*|x.y", 1, 0.5), ("pair", "one two", 2, 0.6)]
    free = {r["doc_id"]: license_row(r) for r in license_scan(table(spark, ["q xzy", "one two xzy", "ab c c", "", "one"]), found=own).collect()}
    assert [free[k] for k in range(5)] == [brute_licenses(t, own, BASE) for t in ("q xzy", "one two xzy", "ab c c", "", "one")]
    assert needs("a?b(?: c)*|x.y") == [[]] and needs("share ?alike(?: [1-4])?") == [["alike", "share"], ["sharealike"]]


def test_long_texts_of_matches(spark):
    """A megabyte of hits takes seconds: time grows with the matches, not with their square."""
    from graphmem.llm.license_scan import license_scan

    began = time.perf_counter()
    row = license_scan(table(spark, ["copyright x " * 87_000])).selectExpr("size(detections) as n", "rule_labels").first()
    assert (row["n"], row["rule_labels"]) == (87_000, ["copyright"]) and time.perf_counter() - began < 20


# --- 1 -------------------------------------------------------------------------------------------------------


def test_gradients():
    """Gradients of the network against differences."""
    from graphmem.llm.toxicity import Network, Words

    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = Words(pa.array(["one two three four", "five one", "", "six " * 40]))
    numbers, text = w.windows()
    label, weight = (text % 2).astype(float), np.ones(len(text))

    def loss():
        z = net.logits(w, numbers)
        return float((np.logaddexp(0, z) - label * z).mean())

    grads = net.gradients(w, numbers, label, weight)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        flat, own = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in [int(np.abs(own).argmax()), int(rng.integers(len(own)))]:
            was = flat[i]
            flat[i] = was + 1e-3
            up = loss()
            flat[i] = was - 1e-3
            down = loss()
            flat[i] = was
            assert own[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-5), name


def test_windows_cover_all_words():
    from graphmem.llm.toxicity import STRIDE, WINDOW, Words

    w = Words(pa.array([" ".join(f"w{k}" for k in range(n)) for n in (0, 1, WINDOW, WINDOW + 1, 200)]))
    numbers, text = w.windows()
    assert STRIDE < WINDOW
    for i in range(5):
        assert set(numbers[text == i].ravel()) - {0} == set(w.index[w.bounds[i] : w.bounds[i + 1]])


def test_score_by_a_plain_loop():
    """The score of whole texts, word by word, window by window and step by step."""
    from graphmem.llm import toxicity as tx
    from graphmem.llm.textarrays import mix, span_hashes

    net = tx.Network(3)
    net.slope, net.offset = 0.7, -0.2
    p, sigmoid = {k: v.astype(np.float64) for k, v in net.p.items()}, lambda x: 1 / (1 + np.exp(-x))
    texts = ["One two, THREE four-five", "", "w " * 70 + "last", "\u6f22\u5b57" * 40, "x" * 25 + " y"]

    def entry(piece):
        row = int(span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0]) % tx.WORD_ROWS
        framed, chars, head = bytes([1]) + piece + bytes([2]), np.zeros(tx.CHAR_DIM), 0
        for i in range(len(piece)):
            a, b, c = framed[i : i + 3]
            chars += p["char"][int(mix(np.array([a * 65536 + b * 256 + c], np.uint64))[0]) % tx.CHAR_ROWS]
        for b in [*piece[: tx.HEAD_BYTES], 0, 0, 0, 0][: tx.HEAD_BYTES]:
            head = head * 257 + b
        return np.concatenate((p["word"][row], chars / len(piece) ** 0.5, p["head"][int(mix(np.array([head], np.uint64))[0]) % tx.HEAD_ROWS]))

    def logit(window):
        if not window:
            return float(p["bias"][0]) + 0.0
        states = []
        for d, order in (("f", window), ("b", window[::-1])):
            h, out = np.zeros(tx.HIDDEN), []
            for x in order:
                a = x @ p[f"in_{d}"] + p[f"shift_{d}"]
                zr = sigmoid(a[: 2 * tx.HIDDEN] + h @ p[f"gate_{d}"])
                z, r = zr[: tx.HIDDEN], zr[tx.HIDDEN :]
                c = np.tanh(a[2 * tx.HIDDEN :] + (r * h) @ p[f"new_{d}"])
                h = c + z * (h - c)
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = np.array([np.concatenate(x) for x in zip(*states, strict=True)])
        share = np.exp(both @ p["look"])
        return float((share / share.sum()) @ both @ p["out"] + p["bias"][0])

    expected = []
    for t in texts:
        raw = re.findall(rb"[0-9a-zA-Z\x80-\xff]+", t.encode())
        pieces = [x.lower()[i : i + tx.PIECE] for x in raw for i in range(0, max(1, len(x) - tx.PIECE + tx.STEP), tx.STEP)]
        rows = [entry(x) for x in pieces]
        windows = [rows[i : i + tx.WINDOW] for i in range(0, max(1, len(rows) - tx.WINDOW + tx.STRIDE), tx.STRIDE)]
        expected.append(sigmoid(net.slope * max(map(logit, windows)) + net.offset))
    assert net.scores(pa.array(texts)) == pytest.approx(expected, abs=1e-4)


def test_every_byte_is_an_input():
    """A passage far into a text without spaces changes the inputs of its own piece."""
    from graphmem.llm.toxicity import Words

    calm, loud = "\u5e73\u548c" * 300, "\u5e73\u548c" * 200 + "\u9a82\u4eba\u8bdd" + "\u5e73\u548c" * 98
    a, b = Words(pa.array([calm])), Words(pa.array([loud]))
    assert len(a.windows()[0]) > 1 and set(b.word) - set(a.word) and set(b.grams) - set(a.grams)


def test_training_gives_memory_back():
    """Of the training on 8 MB of text a fresh process keeps the tables of powers, 32 MB; without giving back it kept 94 MB."""
    if not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux and glibc")
    code = """if True:
        import re
        import numpy as np, pyarrow as pa
        from graphmem.llm import toxicity

        def held():
            return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        rng = np.random.default_rng(0)
        texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 200_000, 400)) for _ in range(3000)])
        toxicity.EPOCHS = 1
        toxicity.train(texts.slice(0, 20), np.arange(20) % 2)
        before = held()
        toxicity.train(texts, np.arange(3000) % 2)
        print(held() - before)
    """
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 60


def test_encoding_gives_memory_back():
    """What a worker runs on 80,000 new words, in a fresh process: it leaves the words it remembers and little else."""
    if not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux and glibc")
    code = f"""if True:
        import re
        import numpy as np, pyarrow as pa
        from pyspark.sql import types as T
        from graphmem.llm import sentencepiece_codec as sc
        from graphmem.llm.shared import give_back

        class Docs:
            columns = ["text"]
            schema = T.StructType([T.StructField("text", T.StringType())])

            def drop(self, *names):
                return self

            def mapInArrow(self, run, schema):
                return run

        def held():
            return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        rng = np.random.default_rng(0)
        batch = pa.record_batch({{"text": pa.array([" ".join(f"w{{k}}" for k in rng.integers(0, 200_000, 100)) for _ in range(1000)])}})
        sum(x.num_rows for x in sc.encode(Docs(), {MODEL!r}, verify_col="same")(iter([batch])))
        before = held()
        give_back()
        print(before - held())
    """
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 8, ran.stdout


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = registered.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def test_toxicity_edge_cases(spark):
    from graphmem.llm.toxicity import fit, score, without_toxic

    texts = ["you idiot"] * 30 + ["a fine day"] * 30 + [None, "", "fine " * 5000]
    docs = table(spark, texts, [*range(62), None])
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(60)] + [(0, 1), (None, 1), (999, 0), (5, None)], "doc_id long, toxic int")
    net = fit(docs, labels)
    rows = score(docs, net).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    kept = without_toxic(docs, net)
    assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} >= {"a fine day"} and "you idiot" not in {r["text"] for r in kept.collect()}
    absent = spark.createDataFrame([(k, int(k % 2)) for k in range(1000, 9000)], "doc_id long, toxic int")
    assert fit(docs, labels.unionByName(absent)) is not None and score(docs.limit(0), net).count() == 0
    assert fit(docs, labels.limit(0)) is None and {r["score"] for r in score(docs, None).collect()} == {0.0}


# --- Queries and the pipeline ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got, asked = registered.queries()[name](spark, small), c.sql(registered.oracle_sql()[name])
    place = [asked.columns.index(x) for x in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in asked.fetchall())


def test_pipeline_catches_what_is_planted(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."

    passage, leak, base = text(60), text(14), text(200)
    near = base.split()
    near[50] = "changed"
    texts = [text(100) for _ in range(80)]
    for k in range(40):
        texts[k] += " you idiot moron " + text(5)
    texts += [base, base, " ".join(near), f"{text(70)} {passage}", f"{passage} {text(70)}", f"{text(40)} {leak} {text(40)}", "", text(30)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 40)) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(range(40)) & set(got)
    assert set(range(40, 80)) <= set(got) and all(got[k]["text"] == texts[k] for k in range(40, 80))
    assert 80 in got and 81 not in got and 82 not in got
    assert passage in got[83]["text"] and got[84]["text"] in texts[84] and passage not in got[84]["text"]
    assert leak not in got[85]["text"] and len(got[85]["text"].split()) == 80 and got[87]["text"] == texts[87]
    assert all(r["round_trip"] for r in got.values())


def test_pipeline_edge_cases(spark, tmp_path):
    """Null ids and texts, empty texts, repeated rows, ties and extra columns pass every stage; an empty table gives no rows."""
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["mild", "calm", "warm", "grey", "slow"]) + str(rng.randint(0, 999)) for _ in range(n))
    same, long = text(50), text(8000)
    texts = [(None, text(40)), (None, text(40)), (None, None), (1, None), (2, ""), (3, " \n"), (4, same), (4, same), (5, same), (6, long), (7, "one")]
    texts += [(100 + k, text(30) + (" you idiot moron" if k % 2 else "")) for k in range(40)]
    rows = [(i, t, "en", "s", len(t or ""), "kept", 1) for i, t in texts]
    layout = "doc_id long, text string, lang string, source string, n_chars long, gone string, grp int"
    spark.createDataFrame([(100 + k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(0, None), (None, "never to be seen anywhere in these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(rows, layout).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    ids = Counter(r["doc_id"] for r in got)
    assert ids[None] == 3 and ids[4] == 2 and ids[5] == 0 and all(ids[k] == 1 for k in (1, 2, 3, 6, 7))
    by = {r["doc_id"]: r for r in got}
    assert by[6]["text"] == long and by[1]["n_pieces"] == by[2]["n_pieces"] == 0 and all(r["round_trip"] for r in got)
    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string")), ("documents", spark.createDataFrame([], layout))):
        df.write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_conversations_with_other_columns(spark):
    from graphmem.llm.chat_template import format_conversations, read_back

    df = spark.createDataFrame([(1, 0, "user", "hi", 9, "x"), (1, 1, "assistant", "yo", 9, "x")], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    assert read_back(format_conversations(df)).select("conv_id", "n_turns", "loss_chars").first()[:3] == (1, 2, 2)
