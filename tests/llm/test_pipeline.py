"""Each stage of the corpus pipeline against brute force over what it was given."""
import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import secrets  # noqa: E402
from tests.llm.test_llm_operators import brute_repeats, brute_simhash, check_packing, library_ids, some_documents, union_find  # noqa: E402


def test_stages(spark):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in {i: t for i, t in some_documents(21, 120)}.items()]
    rows.append((500, "password = abcdefghijkl0123 " + " ".join(f"word{i} of" for i in range(60)), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    given = docs
    after = []
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, "")
        after.append(given.collect())
    quality, near, cut, masked, packed = after
    assert all(x.asDict().keys() == docs.collect()[0].asDict().keys() for stage in after[:4] for x in stage[:1])
    fp = {r.doc_id: brute_simhash(r.text) for r in quality}
    groups = union_find(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert sorted(r.doc_id for r in near) == sorted(set(groups.values()))
    want = brute_repeats([(r.doc_id, r.text) for r in near], 100)
    for r in cut:
        size, gone = want[r.doc_id][1:3]
        assert 0 <= size - gone - len(r.text.encode()) <= 6 * want[r.doc_id][3] and r.n_chars == len(r.text)
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: secrets.redact(r.text.encode()).decode() for r in cut}
    assert "password" not in next(r.text for r in masked if r.doc_id == 500)
    check_packing(packed, 4096)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in masked)
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r.doc_id: len(library_ids(r.text)) + 1 for r in masked})


def test_stages_on_nulls_repeated_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unlike = [" ".join(f"{w}{k * 7 % 61}x{i}" for k in range(60)) for i, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    rows = [(1, unlike[0], None, None, None), (9, unlike[0], "en", "s", 1), (9, unlike[1], "en", "s", 1), (9, unlike[2], None, "s", 1), (None, unlike[3], "en", None, 1), (None, None, None, None, None), (5, "", "en", "s", 0)]
    given = spark.createDataFrame(rows, schema).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:4]:
        given = spark.createDataFrame(stage(spark, given, "").collect(), schema)
        assert sorted((r.doc_id or 0, r.text) for r in given.collect()) == sorted((i, t) for i, t in zip((1, 9, 9, 0), unlike, strict=True)) or stage is corpus_pipeline.quality_stage
    packed = corpus_pipeline.STAGES[4][1](spark, given, "").collect()
    assert Counter(r.doc_id for r in packed) == Counter({1: 1, 9: 2, None: 1}) and len({r.sequence_id for r in packed}) == 1
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, given.limit(0), "")
        assert none.collect() == []


def test_stages_keep_foreign_columns(spark):
    """Columns that are not of `documents`, with names that operators use themselves, come through every filtering stage."""
    names = ("kept", "fp", "row", "rows", "chunk", "marks", "block", "rank", "bucket", "slice", "spans", "_range", "component_id")
    rng = random.Random(4)
    text = lambda k: " ".join("".join(rng.choice("aeiourstlnmdp") for _ in range(rng.randint(2, 9))) for _ in range(120)) + "."
    given = spark.createDataFrame([(k, text(k), "en", "s", 1, *(f"{n}-{k}" for n in names)) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    columns = given.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        given = stage(spark, given, "")
        assert given.columns == columns
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in given.collect()) == [(k, *(f"{n}-{k}" for n in names)) for k in range(6)]
