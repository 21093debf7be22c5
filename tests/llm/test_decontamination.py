"""Exact and proximity search of test items against brute force."""
import hashlib
import random
import re

import pytest

from plumbline.llm import decontamination, queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def windows(text, width=10):
    w = words(text)
    return [(0, w)] if 0 < len(w) < width else [(i, w[i : i + width]) for i in range(len(w) - width + 1)]


def brute(docs, items, width=10):
    wanted = {}
    for item, text in items:
        for _, w in windows(text, width):
            wanted.setdefault(tuple(w), set()).add(item)
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[key]
        names = sorted("" if i is None else str(i) for i in found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = "the of and Ünd ñu 42 a1 report thorn x-ray don't STOP 中文 e.g. under over".split()
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n", "\t", "\x00", "_"]) for _ in range(k))
    items = [(i, prose(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "..."), (None, prose(12)), (3, prose(14)), (5, items[5][1]), (43, items[8][1]), (44, "the " * 30), (45, "zzz " + prose(12))]
    docs = [(1, None), (2, ""), (3, "., \n"), (4, "the " * 500), (4, items[9][1])]
    for i in range(5, 70):
        text = prose(rng.randint(1, 150))
        for _ in range(rng.randint(0, 2)):
            text = f"{text} {rng.choice(items)[1] or ''}! {prose(rng.randint(0, 9))}"
        docs.append((i, text.upper() if i % 7 == 0 else text))
    docs += [(None, docs[20][1]), (None, items[8][1]), (70, " ".join(t or "" for _, t in items * 20)), (9, docs[9][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1, [2]) for i, t in docs], "doc_id long, text string, shard string, counts int, ids array<int>").repartition(3),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int"),
    )


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 1}, {"block_bytes": 300, "shard_bytes": 3000}, {"width": 2}])
def test_contamination_matches_brute_force(spark, options):
    docs, items = made()
    found = decontamination.contamination(*frames(spark, docs, items), **options).collect()
    plain = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert plain(found) == plain(brute(docs, items, options.get("width", 10)))


def test_many_candidates_and_windows_come_in_parts(spark, monkeypatch):
    docs, items = made(2)
    want = sorted(map(str, brute(docs, items)))
    shard = decontamination.build_index(frames(spark, docs, items)[0]).collect()
    monkeypatch.setattr(decontamination, "CANDIDATES", 7)
    monkeypatch.setattr(decontamination, "WINDOWS", 5)
    block = decontamination.Block.of([None if i is None else str(i) for i, _ in items], [t for _, t in items], 10)
    found = []
    for row in shard:
        row = row.asDict()
        hits = decontamination._hits(decontamination.Shard(row), block)
        found += decontamination._digest(row | {"hits": hits.to_pylist() if hits else None}).to_pylist()
    assert sorted(str(tuple(r.values())) for r in found) == want


def test_contamination_of_empty_tables(spark):
    docs, items = frames(spark, *made())
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, items.limit(0)).collect()} == {(0, 0, False)}
    assert decontamination.passage_matches(docs, items.limit(0)).collect() == []


def test_passage_matches(spark):
    docs, items = made(3)
    found = {tuple(r) for r in decontamination.passage_matches(*frames(spark, docs, items)).collect()}
    want = set()
    for item, text in items:
        for i, w in windows(text):
            for doc, t in docs:
                d = words(t)
                want |= {(doc, None if item is None else str(item), i, j) for j in range(len(d) - len(w) + 1) if d[j : j + len(w)] == w}
    assert found == want


def test_proximity_matches(spark):
    docs, items = made(4)
    docs, items = docs[:30], items[:30]
    found = {(r.doc_id, r.item_id, r.item_word) for r in decontamination.passage_matches(*frames(spark, docs, items), near=9).collect()}
    # one shard a document, so that the rarest word is known
    alone = decontamination.passage_matches(frames(spark, docs, items)[0].repartition(len(docs), "doc_id"), frames(spark, docs, items)[1], near=9).collect()
    for doc, item, start, place in map(tuple, alone):
        text = dict((str(i), t) for i, t in reversed(items))[item]
        near = set().union(*({w for w in words(t)[max(0, place - 9) : place + 10]} for d, t in docs if d == doc))
        assert item in {"3", "5"} or set(words(text)[start : start + 10]) <= near
    exact = {(r.doc_id, r.item_id, r.item_word) for r in decontamination.passage_matches(*frames(spark, docs, items)).collect()}
    assert exact <= found and len(found) > len(exact)
    shuffled = decontamination.passage_matches(spark.createDataFrame([(1, "five, four three-two: one"), (2, "one " + "x " * 20 + "two three four five")], "doc_id long, text string"), spark.createDataFrame([(1, "one two three four five")], "item_id int, text string"), near=5).collect()
    assert {r.doc_id for r in shuffled} == {1}


def test_keep_clean(spark):
    docs, items = made(5)
    d, i = frames(spark, docs, items)
    clean = [r.asDict() for r in decontamination.keep_clean(d, i).collect()]
    want = [doc for doc, row in zip(docs, brute(docs, items), strict=True) if not row[-1]]
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted(want, key=str)
    assert all(r["shard"] == "x" and r["counts"] == 1 and r["ids"] == [2] for r in clean)


def test_contamination_query_on_the_table(spark):
    found = queries.op13_benchmark_decontamination(spark, "/root/testdata/sf0.01").collect()
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect()]
    assert sorted(map(tuple, found)) == sorted(brute(read("documents", "doc_id"), read("benchmark", "item_id")))
    assert sum(r.contaminated for r in found) > 10
