"""Phrase counts, scores and ranks against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collocations, queries

PIECE, WORD = re.compile(rb"[.,;:!?\x0A-\x0D]"), re.compile(rb"[^\x20\x09]+")


def counts(rows):
    found, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in PIECE.split(t):
            w = WORD.findall(piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                found.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found, totals


def brute(rows, least, top):
    found, totals = counts(rows)
    out = []
    for lang, f in found.items():
        listed = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            if 100 * inside[p] < 80 * a:
                listed.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:top])]
    return sorted(out)


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = "the of and in Über ñu 42 don't report x-ray 中文 thorn under \x00 e a b c d".split(" ")
    phrases = ["state of the art", "in the end", "a b a b a b", "bill of lading"]

    def prose(k):
        return "".join((rng.choice(phrases) if rng.random() < 0.2 else rng.choice(vocabulary)) + rng.choice([" ", " ", " ", " ", "\t ", ". ", ", ", "\n", "\x0b", "!?", "; "]) for _ in range(k))

    rows = [("en", None), ("en", ""), (None, "the end. " * 40), ("und", "The End of the end"), ("xx", "one two"), ("fr", " \t.\n"), ("en", "a b " * 300)]
    rows += [(rng.choice(["en", "de", None]), prose(rng.randint(1, 120))) for _ in range(60)]
    rows += [rows[10]] * 5 + [("de", prose(4000).upper())]
    return rows


@pytest.mark.parametrize("options", [{}, {"budget": 40}, {"budget": 150, "slice_bytes": 2000}, {"budget": 1, "slice_bytes": 1}])
def test_collocations_match_brute_force(spark, options):
    rows = texts()
    frame = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], "lang string, text string, phrase string, a int, slice int").repartition(3)
    found = collocations.collocations(frame, least=5, top=60, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 60)


def test_node_counts_are_those_of_all_phrases(spark):
    rows = texts(2)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = {(lang, p): n for lang, f in counts(rows)[0].items() for p, n in f.items() if n >= 5}
    for budget in (30, 1 << 20):
        nodes, vocabulary, _ = collocations.phrase_counts(frame, least=5, budget=budget)
        words = {r.id: r.word.encode() for r in vocabulary.collect()}
        found = [((r.lang, tuple(words[w] for w in (r.w1, r.w2, r.w3, r.w4) if w >= 0)), r.f) for r in nodes.collect()]
        assert len(found) == len(want) and dict(found) == want


def test_ties_are_cut_by_phrase(spark):
    rows = [("en", f"{a}{i} {b}{i}. " * 7) for i in range(40) for a, b in (("x", "y"), ("é", "z"))]
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=7, top=11).collect()
    assert sorted(map(tuple, found)) == brute(rows, 7, 11) and len(found) == 11


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", ".")], "lang string, text string")).collect() == []


def test_leaves_of_large_vocabularies():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 4, 500) * 300_000 for _ in range(4)]
    n = rng.integers(1, 9, 500)
    want = Counter()
    for *w, k in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
        want[tuple(w)] += k
    for base in (1_000_000, 50_000_000):
        found, totals = collocations.tree_leaves(columns, base, n)
        assert list(zip(*(c.tolist() for c in found), totals.tolist(), strict=True)) == [(*w, k) for w, k in sorted(want.items())]


def test_collocation_query_on_the_table(spark):
    found = queries.op11_phrase_collocations(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted(map(tuple, found)) == brute(rows, 30, 2000)
    assert len(found) > 100
