"""Operators against brute force, on small tables with nulls, ties, repeats, clashing columns and long texts."""
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, embeddings, lm, packing, quality, repeats, secrets, simhash, token_files
from plumbline.llm.arrays import local_components
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.tokens import SubwordEncoder

WORDS = "the of and tion eaux ché Über ñandú thorn under report 42 x-ray e.g. don't 中文 wörter STOP".split()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def some_documents(seed=3, n=80):
    """(doc_id, text): nulls, empty, white space, exact and near copies, shared passages, a very long text."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice("abcdefgh") * rng.randint(1, 3), ".", ",", "\n"]) for _ in range(k))
    shared = prose(60)
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words")]
    for i in range(7, n):
        kind = rng.random()
        text = prose(rng.randint(1, 120))
        if kind < 0.2:
            text = docs[rng.randint(6, len(docs) - 1)][1] or text if len(docs) > 7 else text
        elif kind < 0.4:
            text = f"{text} {shared} {prose(5)}"
        elif kind < 0.5:
            text = "ab " * rng.randint(1, 90)
        docs.append((i, text))
    docs.append((n, prose(9000)))
    docs.append((7, docs[6][1]))  # a repeated row
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = some_documents()
    frame = spark.createDataFrame([(i, t, "kept", 1, 2, "x") for i, t in rows], "doc_id long, text string, kept string, n long, bucket int, chunk string")
    return rows, frame.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_quality_counts(docs, empty):
    rows, frame = docs
    want = Counter()
    for i, text in rows:
        t = (text or "").encode()
        w = WORD.findall(t)
        lines = [x for x in t.split(b"\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t.decode()), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality.quality_rules(frame).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality.quality_rules(empty).collect() == []
    kept = quality.quality_rules(frame, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "n", "bucket", "chunk", "kept"] and kept.count() == len(rows)


def test_cascade_order_and_verdict():
    rules = {r.name: r for r in (*quality.base_rules(), *quality.RULES)}
    some = [rules[n] for n in ("repeat_words", "few_words", "symbols", "digits", "dup_lines")]
    f = frozenset
    needs = {"repeat_words": f({"words", "n_repeat_words", "n_words"}), "few_words": f({"words", "n_words"}), "symbols": f({"n_symbols", "word_chars"}), "digits": f({"n_digits", "word_chars"}), "dup_lines": f({"lines"})}
    seen = quality.Measured({"words": 4.0, "n_repeat_words": 1.0, "n_words": 0.0, "n_symbols": 3.0, "word_chars": 2.0, "n_digits": 3.0, "lines": 1.0}, needs, {f(): 50, f({"few_words"}): 8, f({"repeat_words"}): 4, f({"symbols", "few_words"}): 10, f({"digits"}): 1})
    # few_words 18 / 4; then repeat_words pays 1 for 4; then digits 1 / 5, and symbols has nothing left to reject but shares word_chars
    assert [r.name for r in quality.cascade_order(seen, some)] == ["few_words", "repeat_words", "digits", "dup_lines", "symbols"]
    assert [r.name for r in quality.cascade_order(seen, some, ("words", "n_words", "n_repeat_words"))][:2] == ["few_words", "repeat_words"]
    junk = pa.array(["### *** $$$ " * 40, "plain words here " * 3 + "and more of them", "- one\n* two\n" * 9, "read on...\nmore\nthere...", "12 345 6789 a", "SHOUT at me", "{ x: {} }"], pa.large_string())
    each = {r.name: r.rejects(quality.Texts(junk)).tolist() for r in quality.RULES}
    assert [each[n].index(True) for n in ("symbols", "bullets", "ellipses", "digits", "capitals", "braces")] == [0, 2, 3, 4, 5, 6] and not any(e[1] for e in each.values())


def test_cascade_verdict_does_not_depend_on_order_or_shared_measures(docs):
    rows, frame = docs
    texts = pa.array([t or "" for _, t in rows], pa.large_string())
    rules = [*quality.base_rules(), *quality.RULES]
    want = ~np.any([r.rejects(quality.Texts(texts)) for r in rules], axis=0)
    for order in (rules, rules[::-1]):
        alive, left = np.arange(len(texts)), quality.Texts(texts)
        for rule in order:
            passed = np.flatnonzero(~rule.rejects(left))
            alive, left = alive[passed], left.only(passed)
        assert alive.tolist() == np.flatnonzero(want).tolist()
    kept = lambda df: Counter((r.doc_id, r.kept) for r in df.collect())
    assert kept(quality.quality_rules(frame)) == Counter(zip([i for i, _ in rows], want.tolist(), strict=True))
    whole = quality.quality_rules(frame, keep_columns=True)
    assert kept(whole) == kept(quality.quality_rules(frame))


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], list(range(0, 100000, 37)), [0] * 500 + [1 << 40], [-7, -7, 3, 1 << 61]])
def test_elias_fano(values):
    coded = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.int64)))
    assert coded.select(np.arange(len(values))).tolist() == values
    assert [int(coded.select(i)[0]) for i in range(0, len(values), max(1, len(values) // 50))] == values[:: max(1, len(values) // 50)]


def library_ids(text):
    library = Tokenizer.from_file(tokenizer_path())
    return library.encode(text or "", add_special_tokens=False).ids


ODD = ["É́a Σς ΑΣ. İstanbul ß ſ K", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "a b　c", "don't stop's 'S, x2y 12.5 _a_ ﬁ Ǆ é. é, ไทย ।", "tab\x1cb \x85 ", "", None, "a" * 300, "🙂🙂 a🙂b", "'re're", "½ ² Ⅷ", "​zero", "Å̧ ǆ Dž"]


def test_encoders_agree_with_the_library():
    texts = ODD + [t for _, t in some_documents(9, 40)]
    want = [library_ids(t) for t in texts]
    for encoder in (SubwordEncoder(tokenizer_path()), bpe.BacktrackingBPE(tokenizer_path())):
        ids, off = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want
    library = Tokenizer.from_file(tokenizer_path())
    out, ends = bpe.BacktrackingBPE.of(tokenizer_path()).decode(ids, off)
    shown = [out[a : max(a, b - 1)].tobytes().decode() for a, b in zip(ends, ends[1:], strict=False)]
    assert shown == [library.decode(w, skip_special_tokens=False) for w in want]


def test_backtracking_on_random_letters():
    rng, model = random.Random(1), bpe.BacktrackingBPE.of(tokenizer_path())
    library = Tokenizer.from_file(tokenizer_path())
    for _ in range(3000):
        word = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14)))
        assert list(model.encode_chunk(word)) == library.encode(word, add_special_tokens=False).ids


def test_encode_decode_rows(docs, empty):
    rows, frame = docs
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = library_ids(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(frame, tokenizer_path()).collect())) == want
    assert bpe.encode_decode(empty, tokenizer_path()).collect() == []


def test_token_files(spark, docs, empty):
    rows, frame = docs
    path = token_files.write_token_files(frame, token_files.new_token_folder(spark), tokenizer_path(), slice_bytes=3000)
    got = token_files.token_file_digest(spark, path).collect()
    ids = {i: [*library_ids(t), 1] for i, t in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[i]), crc(ids[i])) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    stored = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, path).collect()}
    assert stored == ids
    none = token_files.write_token_files(empty, token_files.new_token_folder(spark), tokenizer_path())
    assert token_files.token_file_digest(spark, none).collect() == []


def check_packing(rows, capacity):
    spans = {}
    for r in rows:
        assert 0 < r.length <= capacity
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing(docs, empty):
    rows, frame = docs
    got = packing.pack_documents(frame, tokenizer_path(), capacity=256, groups=64, with_ids=True).collect()
    n = check_packing(got, 256)
    want = Counter()
    for i, t in rows:
        ids = [*library_ids(t), 1]
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes()), tuple(ids[k : k + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert n <= best_fit_decreasing([r.length for r in got], 256) + 1
    assert packing.pack_documents(empty, tokenizer_path()).collect() == []


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6, 1.2, 20000).astype(int)))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.best_plan(counts, 4096)
    table = plan.table()
    assert sum(table[:, 2]) == len(lengths)
    used = Counter()
    for length, _, n, sequence, _ in table.tolist():
        for k in range(n):
            used[sequence + k] += length
    assert max(used.values()) <= 4096 and len(used) == plan.sequences
    assert plan.sequences <= 1.001 * math.ceil(lengths.sum() / 4096) + 1


def brute_simhash(text):
    w = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    rows, frame = docs
    got = simhash.simhash_groups(frame).collect()
    fp = {i: brute_simhash(t) for i, t in rows}
    ids = sorted(fp)
    want = union_find(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert Counter(map(tuple, got)) == Counter((i, f"{fp[i]:016x}", want[i]) for i, _ in rows)
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.simhash_groups(empty).collect() == []


def test_one_row_of_each_group_stays_and_no_other_text_is_lost(spark, empty):
    one, other, third = ("some words that stand here " * 20, "quite unlike all of the others, " * 20, "a third one about nothing at all; " * 20)
    rows = [(1, one, "a"), (9, one, "b"), (9, other, "c"), (9, other, "d"), (7, other, "e"), (None, one, "f"), (None, third, "g"), (None, third, "h"), (3, None, "i"), (4, "", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (7, other), (None, third), (3, None)], key=str)
    twice = spark.createDataFrame([(9, other, "c"), (9, other, "c"), (9, one, "d")], frame.schema)
    assert sorted(r.text for r in simhash.keep_one_of_each(twice).collect()) == sorted([other, one])
    assert simhash.keep_one_of_each(empty).collect() == []


def test_pigeonring_finds_every_link(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains around a few centres, so that some keys are hot
        fps.append(rng.choice(fps[:5] + fps[-3:]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1)
    fps = sorted(set(x & (1 << 64) - 1 for x in fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    links = simhash.fingerprint_links(classes, 4, block=8).collect()
    assert all((fps[r.src] ^ fps[r.dst]).bit_count() <= 64 for r in links)
    n = range(len(fps))
    want = union_find(n, [(a, b) for a in n for b in n if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert union_find(n, [(r.src, r.dst) for r in links]) == want


@pytest.mark.parametrize("run", [8, 0.25])
def test_embeddings(spark, monkeypatch, run):
    monkeypatch.setattr(embeddings, "RUN", run)  # 0.25: copies in several runs a block
    rng = np.random.default_rng(8)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(400):
        v = centre[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.3, 2.0])
        rows.append((i, v.tolist()))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [2 * x for x in rows[0][1]]), (5, rows[5][1])]
    bad = [(910, None), (911, []), (912, [0.0] * 16), (913, [float("nan")] * 16), (914, [1.0] * 15 + [None]), (915, [float("inf")] + [1.0] * 15), (916, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows + bad], "vec_id long, embedding array<double>, cell string").repartition(3)
    got = embeddings.embedding_groups(frame, block=32).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    want = union_find(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    full = Counter((i, int(near[k].sum()), want[i], want[i] == i) for k, i in enumerate(ids)) + Counter((i, 0, i, True) for i, _ in bad)
    assert Counter(map(tuple, got)) == full
    assert embeddings.embedding_groups(frame.limit(0)).collect() == []


def test_embeddings_use_cells_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((25, 24))
    x = np.array([centre[i % 25] + rng.standard_normal(24) * rng.choice([0.1, 0.4]) for i in range(600)])
    used = []
    choose = embeddings.cells_for
    monkeypatch.setattr(embeddings, "cells_for", lambda *args: used.append(choose(*args)) or used[-1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(frame).collect()}
    assert len(used[0]) >= 4
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = union_find(range(600), list(zip(*(k.tolist() for k in np.nonzero(near)), strict=True)))
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(600)}
    # where the triangle inequality saves products, more cells cost less
    tight = np.repeat(centre / np.linalg.norm(centre, axis=1)[:, None], 400, axis=0) + 1e-3 * rng.standard_normal((10000, 24))
    tight /= np.linalg.norm(tight, axis=1)[:, None]
    one, all_ = (embeddings.expected_cost(tight[::20], embeddings.choose_pivots(tight, k), 0.45, 10**6) for k in (1, 25))
    assert all_ < one / 5


def test_embedding_links_at_the_bound_have_two_ends(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(0, 3000, 2):
        a, b = rng.standard_normal((2, 12))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(k, a.tolist()), (k + 1, (0.9 * a + math.sqrt(1 - 0.81) * b).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embeddings.embedding_groups(frame, block=400).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    unit = unit / np.sqrt([[float(v @ v)] for v in unit])
    dots = unit @ unit.T
    want = Counter()
    for i, j in zip(*np.nonzero(dots > 0.9 - 1e-9), strict=True):
        if i < j and math.fsum((unit[i] * unit[j]).tolist()) >= 0.9:
            want.update([i, j])
    assert 500 < len(want) and {k: r.n_links for k, r in got.items() if r.n_links} == want


def test_every_code_point_is_encoded_as_the_library_does():
    """Newer code points than Python knows among them; in words, before digits and by themselves."""
    library, encoder = Tokenizer.from_file(tokenizer_path()), bpe.BacktrackingBPE.of(tokenizer_path())
    points = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and c % 3 == 0] + [chr(c) for a, b in bpe.unassigned() for c in (a, (a + b) // 2, b)]
    texts = [f"ab{c}cd {c} x{c} {c}y 1{c}" for c in points]
    ids, off = encoder.encode(pa.array(texts))
    wrong = [t for t, x, a, b in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), off, off[1:], strict=False) if x.ids != ids[a:b].tolist()]
    assert not wrong, wrong[:5]


def test_one_vec_id_with_two_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.embedding_groups(frame).collect())) == [(1, 2, 1, True)] * 3 + [(2, 0, 2, True)]


def test_local_components():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    node, root = local_components(u, v)
    want = union_find({*u.tolist(), *v.tolist()}, zip(u.tolist(), v.tolist(), strict=True))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: r for k, r in want.items() if k != r}


def test_suffix_ranks():
    rng = random.Random(6)
    for length in (1, 5, 8, 13, 40, 100):
        data = np.array([rng.choice([0, 1, 255]) for _ in range(400)] + [7] * 150, np.uint8)
        data = np.concatenate([data, data[:250]])
        rank = repeats.suffix_ranks(data, length)
        whole = [bytes(data[i : i + length]) for i in range(len(data) - length + 1)]
        order = {t: k for k, t in enumerate(sorted(set(whole)))}
        mine = rank[: len(whole)]
        assert np.array_equal(np.unique(mine, return_inverse=True)[1], [order[t] for t in whole])


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        out[i] = (i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"length": 40, "gram": 12, "chunk_bytes": 3000, "hot": 1}, {"chunk_bytes": 1500, "hot": 3}])
def test_repeats(docs, empty, options):
    rows = list({i: (i, t) for i, t in docs[0]}.values())
    frame = docs[1].dropDuplicates(["doc_id"])
    got = repeats.repeat_digest(frame, **options).collect()
    assert {r.doc_id: tuple(r) for r in got} == brute_repeats(rows, options.get("length", 100))
    assert repeats.repeat_digest(empty).collect() == []


def test_repeats_in_one_long_text_across_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(900))
    data, off = np.frombuffer((text + "x" + text[100:700]).encode(), np.uint8), np.array([0, 1501])
    _, whole, lo, many, at = repeats.phrases(data, off, 100, 36)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(lo, many, strict=True)])
    assert starts.tolist() == list(range(1402)) and len(set(whole.tolist())) < len(whole) and (at < 65).all()


def test_remove_repeats_keeps_rows_and_characters(spark):
    rng = random.Random(1)
    long = "é" * 80 + "".join(rng.choice("abcdefgh") for _ in range(150))
    frame = spark.createDataFrame([(1, long, 3.5), (2, "zz" + long, None), (3, None, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in repeats.remove_repeats(frame).collect()}
    assert got[2].text == "zz" and got[1].text.endswith(long[80:]) and got[3].text is None and got[1].score == 3.5


def test_secrets(docs, empty):
    key = "AKIA" + "Q7" * 8
    text = f"é password = \"hunter2hunter2\" x {key} {'0a' * 10} api-key: abc token:short secret=abcdefghijkl0 ſecret=abcdefghijkl0"
    spans = secrets.scan(text.encode())
    assert [(k, text[a:b]) for k, a, b in spans if k != "entropy"] == [("assign", 'password = "hunter2hunter2'), ("access", key), ("hex", "0a" * 10), ("assign", "secret=abcdefghijkl0"), ]
    found = secrets.scan(b"see 9xK2mQ7vLp4RtZ8wYb3NcD6f here")
    assert [k for k, _, _ in found] == ["entropy"]
    clean = b"123e4567-e89b-12d3-a456-426614174000 internationalization-of-everything 2024-01-02T10:11:12 ------------------------ /usr/local/share/python/site"
    assert secrets.scan(clean) == []
    assert secrets.redact(text.encode()).decode().startswith('é [SECRET]" x [SECRET] [SECRET] api-key')
    assert len(secrets.find_secrets(docs[1]).collect()) == len(docs[0]) and secrets.find_secrets(empty).collect() == []


@pytest.mark.parametrize(
    "before, key, after",
    [
        ("see ", "qzxvkjwpmtrgbhdlfnscyq", " here"), ("see ", "QZXVKJWPMTRGBHDLFNSCYQ", ""), ("", "qZxVkJwPmTrGbHdLfNsCyQ", ""), ("", "qzxvkjwp-mtrgbhd_lfnscyq/xkz", ""),
        ("-" * 60, "9xK2mQ7vLp4RtZ8wYb3NcD6f", ""), ("https://host/share/documents/of/the/station/and/the/other/", "9xK2mQ7vLp4RtZ8wYb3NcD6f", "/the/station/and/the/other/documents"),
        ("", "0123456789abcdef0123", "9xK2mQ7vLp4RtZ8wYb3NcD6f"), ("9xK2mQ7vLp4RtZ8wYb3NcD6fZ", "0123456789abcdef0123", ""),
    ],
)
def test_secrets_of_every_class_and_in_longer_runs(before, key, after):
    shown = secrets.redact(f"{before}{key}{after}".encode()).decode()
    for part in (key, "9xK2mQ7vLp4RtZ8wYb3NcD6f"):
        assert not any(part[i : i + 8] in shown for i in range(len(part) - 7)), shown
    assert "station" not in before or shown.startswith("https://host/share/documents") and shown.endswith("other/documents")


def test_uncovered_parts_and_words_stay():
    rng = random.Random(4)
    for _ in range(300):
        cut = sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 4))))
        want = [i for i in range(5, 25) if not any(x <= i < y for x, y in cut)]
        assert [i for a, b in secrets.uncovered(5, 25, cut) for i in range(a, b)] == want
    for words in (b"the_quick_station_of_another_country", b"getElementsByClassNameOfParent", b"Geschwindigkeitsbegrenzungen", b"internationalisation/of/everything"):
        assert secrets.scan(words) == []


def test_window_entropy_matches_direct_counts():
    run = b"aB3dE5fG7hJ9kLmN2pQr4sTuV6wXaaaaaaaaaaaaaaaaaaaaaa"
    for k, h in enumerate(secrets.window_entropies(run)):
        c = Counter(run[k : k + 20])
        assert abs(h + sum(n / 20 * math.log2(n / 20) for n in c.values())) < 1e-9


def brute_entropy_spans(text):
    """Windows by themselves: counts of each from scratch."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text, re.A):
        run = m[0]
        if re.search("[0-9]", run) and secrets.ALLOWED.fullmatch(run.encode()):
            continue
        over = []
        for i in range(len(run) - 19):
            w = run[i : i + 20]
            h = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
            low = w.lower()
            pairs = [low[k : k + 2] for k in range(19) if low[k : k + 2].isalpha()]
            if re.search("[0-9]", w):
                hexa = re.fullmatch("[0-9a-f]+|[0-9A-F]+", w)
                bound = secrets.BOUNDS["digits" if w.isdigit() else "hex" if hexa else "alnum" if w.isalnum() else "base64"]
                over.append(h >= bound)
            else:
                over.append(h >= secrets.BOUNDS["letters"] and 2 * sum(p.encode() in secrets.COMMON for p in pairs) < len(pairs))
        covered = [any(over[max(0, i - 19) : i + 1]) for i in range(len(run))]
        out += [(m.start() + i, c) for i, c in enumerate(covered)]
    return {i for i, c in out if c}


def test_entropy_spans_against_brute_force(spark):
    rng = random.Random(33)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pools = ["0123456789abcdef", "0123456789", letters, letters.upper(), letters + letters.upper(), letters + letters.upper() + "0123456789", letters + "0123456789+/_=-"]
    key = lambda: "".join(rng.choice(rng.choice(pools) if rng.random() < 0.1 else pool) for pool in [rng.choice(pools)] for _ in range(rng.randint(15, 60)))
    prose = lambda: rng.choice(["the station of another country", "internationalisation-of-everything/and/more", "a" * 30, "12-34-56-78-90-12-34-56-78", "\u00e9"])
    rows = [(i, " ".join(rng.choice([key, prose])() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = 0
    for i, text in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].split(",") if x)]
        base = {p for k, a, b in spans if k != "entropy" for p in range(a, b)}
        found = {p for k, a, b in spans if k == "entropy" for p in range(a, b)}
        assert found | base == brute_entropy_spans(text) | base and not found & base, text
        some += len(found)
    assert some > 2000


def test_language_model(docs, empty):
    rows, frame = docs
    got = {r.doc_id: r for r in lm.score_texts(frame, tokenizer_path(), slice_bytes=4000).collect()}
    words = [(i, WORD.findall((t or "").encode().lower())) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, ws in words if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in words)
    total, kinds = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    for i, ws in words:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, total)
        assert abs(r.base_score - sum(log(count[w]) for w in ws) - log(ends)) < 1e-6 * max(1, abs(r.base_score)) and r.score < 0
    assert lm.score_texts(empty, tokenizer_path()).collect() == []


@pytest.mark.parametrize("scale", ["sf0.1"])
def test_held_out_documents_score_above_the_word_base(spark, scale):
    """So many documents are needed: on sf0.01 the model is 1.4 % below the base."""
    folder = os.path.join("/root/testdata", scale)
    if not os.path.isdir(folder):
        pytest.skip("no fixture tables")
    rows = lm.score_texts(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path()).where("held_out").collect()
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def toy_model(n_ids=60, seed=0):
    """A corpus in which the id two back decides the next one, which pairs of ids cannot show."""
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(300):
        x = list(rng.integers(0, n_ids, 2))
        while len(x) < 50:
            x.append((x[-2] * 7 + 3) % n_ids if rng.random() < 0.9 else int(rng.integers(0, n_ids)))
        docs.append(x)
    ids, off = np.array([i for d in docs for i in d]), np.arange(0, 50 * 301, 50)
    shape = lm.Shape(classes=16, alone=4, rows=64, batch=64, rate=0.02, train_every=1)
    model = lm.Model(np.bincount(ids, minlength=n_ids).astype(float), shape)
    before = model.inputs(ids, off)
    follows = np.bincount(before * shape.classes + model.class_of[ids], minlength=model.n_rows * shape.classes)
    pairs = np.bincount(before * shape.rows + model.row_of[ids], minlength=model.n_rows * shape.rows)
    model.start_from(np.concatenate([follows, pairs]).astype(float))
    return model, ids, off


def test_attention_learns_what_pairs_cannot_show():
    model, ids, off = toy_model()
    train, held = off[:251], off[250:] - off[250]
    before = model.score(ids[off[250] :], held).sum()
    moments = {}
    for k in range(12):
        model.train(ids[: off[250]], train, moments, k)
    after = model.score(ids[off[250] :], held).sum()
    assert after > before + 0.05 * abs(before)


def test_model_probabilities_sum_to_one_and_windows_do_not_matter():
    model, ids, off = toy_model()
    rng = np.random.default_rng(3)
    model.set_flat(rng.standard_normal(len(model.flat())) * 0.3)
    prefix = ids[:20]
    texts = [np.append(prefix, i) for i in range(60)]
    joined, ends = np.concatenate(texts), np.arange(0, 21 * 61, 21)
    total = np.exp(model.score(joined, ends) - model.score(prefix, np.array([0, 20]))[0]).sum()
    assert abs(total - 1) < 1e-4
    assert np.allclose(model.score(ids, off, at_once=7), model.score(ids, off), atol=1e-3)


def test_gradients_match_differences():
    model, ids, off = toy_model()
    model.set_flat(np.random.default_rng(5).standard_normal(len(model.flat())) * 0.3)
    rows, target = model.inputs(ids, off), model.class_of[ids]
    first, opens, many = (x[:40] for x in model.windows(off))
    grads = model.gradients(rows, target, first, opens, many)

    def loss():
        logits = model._forward(rows, first, opens, model._tables())[-1].astype(float)
        place = np.minimum(first[:, None] + np.arange(16), len(ids) - 1)
        logp = np.take_along_axis(logits, target[place][:, :, None], 2)[:, :, 0] - np.log(np.exp(logits).sum(2))
        return -logp[np.arange(16) < many[:, None]].mean()

    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = model.parameters[name][at]
        model.parameters[name][at] = keep + 1e-2
        up = loss()
        model.parameters[name][at] = keep - 1e-2
        down = loss()
        model.parameters[name][at] = keep
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4, name


def test_every_training_window_gives_a_step():
    made, ids, off = toy_model()
    model = lm.Model(np.bincount(ids, minlength=60).astype(float), lm.Shape(classes=16, alone=4, rows=64, batch=1))
    model.start_from(np.concatenate([np.ones(model.n_rows * 16), np.ones(model.n_rows * 64)]))
    for k in range(8):  # a slice of one short document trains, whatever the slice's number
        moments = {}
        assert model.train(ids[:30], np.array([0, 30]), moments, k) == moments["n"] == 2
    assert lm.Shape().train_every == 1 and model.train(ids, off, {}, 3) == len(model.windows(off)[0])


def test_chat_is_reversible(spark):
    texts = ["plain", "", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "|im_start|>", "<\\<|image:1|>", "\n<|im_end|>\n", "é🙂"]
    rows = [(c, t, role, x) for c in (1, 2) for t, (role, x) in enumerate(zip(["user", "assistant"] * 5, texts, strict=True))]
    rows += [(3, 0, None, "x"), (3, 0, "we<ird\\n\nrole", "y"), (None, None, "assistant", "z")]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    read = lambda r: (lambda role, parts: (role, chat.text_of(parts)))(*chat.read_turn(r.formatted))
    back = sorted((str(r.conv_id), str(r.turn), *read(r)) for r in formatted.collect())
    assert back == sorted((str(c), str(t), role or "", x or "") for c, t, role, x in rows)
    assert all(r.formatted.count("<|im_end|>") == 1 and r.formatted.count("<|im_start|>") == 1 for r in formatted.collect())
    got = {r.conv_id: r for r in chat.conversation_digest(formatted).collect()}
    trained = "".join(x or "" for c, _, role, x in rows if c == 1 and role == "assistant")
    assert got[1].loss_chars == len(trained) and got[1].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    turns = "".join(f"{role}\n{x or ''}\n" for c, _, role, x in rows if c == 1)
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 10 and got[None].n_turns == 1


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <"}, {"type": "image", "ref": "a.png", "width": 28, "height": 29}, {"type": "text", "text": "|im_end|> and"}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    frame = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = sorted(chat.format_conversations(frame, content="parts").collect(), key=lambda r: r.turn)
    assert first.formatted == "<|im_start|>assistant\nsee <\\<|image:1|>|im_end|> and<|audio:2|><|document:3|><|im_end|>\n"
    assert [(a.n, a.kind, a.ref, a.tokens) for a in first.attachments] == [(1, "image", "a.png", 2), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 2304)]
    role, back = chat.read_turn(first.formatted, [a.asDict() for a in first.attachments])
    shown = [{"type": "text", "text": "see <"}, {"type": "image", "n": 1, "ref": "a.png", "tokens": 2}, {"type": "text", "text": "|im_end|> and"}, {"type": "audio", "n": 2, "ref": "b.wav", "tokens": 50}, {"type": "document", "n": 3, "ref": "c.pdf", "tokens": 2304}]
    assert role == "assistant" and back == shown and second.formatted == "<|im_start|>user\n<|im_end|>\n"
    assert chat.read_turn(second.formatted) == ("user", [])
    digest = {r.conv_id: r for r in chat.conversation_digest(chat.format_conversations(frame, content="parts")).collect()}[1]
    assert (digest.n_parts, digest.attachment_tokens, digest.loss_chars) == (5, 2356, len("see <|im_end|> and"))


def test_placeholders_in_texts_are_not_attachments(spark):
    text = [{"type": "text", "text": "a<|image:1|>"}]
    image = [{"type": "text", "text": "a"}, {"type": "image", "ref": "x"}]
    odd = [{"type": "video", "ref": "v"}, {"text": "no type"}]
    frame = spark.createDataFrame([(1, 0, "user", text, "c"), (2, 0, "user", image, "c"), (3, 0, "user", odd, "c")], f"conv_id long, turn long, role string, parts array<{chat.PART}>, attachments string")
    got = {r.conv_id: chat.read_turn(r.formatted, [a.asDict() for a in r.attachments])[1] for r in chat.format_conversations(frame, content="parts").collect()}
    assert got[1] == text and [p["type"] for p in got[2]] == ["text", "image"] and got[2][0]["text"] == "a"
    assert [(p["type"], p["ref"]) for p in got[3]] == [("other", "v"), ("other", None)]
    none = chat.format_conversations(frame.limit(0), content="parts")
    assert none.collect() == [] and chat.conversation_digest(none).collect() == []


def test_columns_that_clash_with_the_operators_own(spark):
    text = " ".join(f"word{i}" for i in range(40)) + " "
    rows = [(1, text, "ids", 1, 2, 3, "x", "y", "z"), (2, text + "and an end", "ids", 1, 2, 3, "x", "y", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, rank int, start int, piece int, chunk string, slice string, marks string")
    path = token_files.write_token_files(frame, token_files.new_token_folder(spark), tokenizer_path())
    made = [token_files.token_file_digest(spark, path), packing.pack_documents(frame, tokenizer_path()), bpe.encode_decode(frame, tokenizer_path()), lm.score_texts(frame, tokenizer_path()), simhash.simhash_groups(frame), secrets.find_secrets(frame)]
    assert [sorted(r.doc_id for r in df.collect()) for df in made] == [[1, 2]] * 6
    cut = {r.doc_id: r for r in repeats.remove_repeats(frame).collect()}
    assert cut[1].text == text and cut[2].text == "and an end" and (cut[2].chunk, cut[2].marks) == ("x", "z")


def test_secret_patterns_against_brute_force(spark):
    rng = random.Random(12)
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    pieces = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", ": ", '"', "'", "AKIA", "akia", "0123456789abcdef", "deadbeef", "ABCDEF0123456789", "é", " ", "\n", "token=secret:abcdefghijklmnop", "x", "Zz9+/"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        t = text or ""
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        kinds = Counter(k for k, _, _ in spans)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest())
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == [x for x in base.split(",") if x]


def test_rows_without_an_id(spark):
    text = "some words that stand here more than once " * 30
    frame = spark.createDataFrame([(None, text), (None, text), (3, text), (None, None), (None, "alone")], "doc_id long, text string")
    count = lambda df: sum(r.doc_id is None for r in df.collect())
    path = token_files.write_token_files(frame, token_files.new_token_folder(spark), tokenizer_path())
    every = [
        quality.quality_rules(frame), token_files.token_file_digest(spark, path), packing.pack_documents(frame, tokenizer_path()), secrets.find_secrets(frame), repeats.repeat_digest(frame),
        bpe.encode_decode(frame, tokenizer_path()), lm.score_texts(frame, tokenizer_path()),
    ]
    assert [count(df) for df in every] == [4] * 7
    groups = simhash.simhash_groups(frame).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in groups) == [(0, 0), (0, 0), (0, 3), (0, 3), (3, 3)]
    removed = {(r.doc_id, r.n_removed) for r in repeats.repeat_digest(frame).collect()}
    assert (3, len(text)) in removed  # rows without an id come first
    v = [1.0, 0.0]
    near = spark.createDataFrame([(None, v), (None, [1.0, 0.01]), (7, [1.0, 0.02]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.embedding_groups(near).collect()) == [(0, 0, 0, False), (0, 2, 7, False), (0, 2, 7, False), (7, 2, 7, True)]
