"""Spelling variants, exact top-k and hard negatives against brute force."""

import itertools
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from restora.llm import negatives, shards, topk, variants

VECTORS = "vec_id bigint, embedding array<float>, label int"


# --- spelling variants ---


def edits(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(counts, factor=2):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made_up_words(draw, n, alphabet="abcdeéñ", sizes=(5, 9)):
    words = {"".join(draw.choice(list(alphabet), size=draw.integers(*sizes))) for _ in range(n)}
    more = set()
    for w in list(words)[: n // 2]:
        i = int(draw.integers(0, len(w)))
        more |= {w[:i] + w[i + 1 :], w[:i] + str(draw.choice(list(alphabet))) + w[i:], w[:i] + str(draw.choice(list(alphabet))) + w[i + 1 :]}
    return {w: int(draw.integers(3, 40)) for w in words | more if len(w) >= 5}


@pytest.mark.parametrize(("most", "searches"), [(variants.MOST, variants.SEARCHES), (7, 20)])
def test_variants_against_all_pairs(spark, monkeypatch, most, searches):
    """Also with blocks and copies so small that nodes, leaves and searches are divided."""
    draw = np.random.default_rng(5)
    counts = made_up_words(draw, 300) | {"".join(p): 3 + i % 9 for i, p in enumerate(itertools.permutations("abcdef", 6)) if i < 150} | {"x" * 300: 4, "x" * 301: 9, "x" * 300 + "y": 30, "x" * 298: 5, "aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "SEARCHES", searches)
    monkeypatch.setattr(variants, "AT_ONCE", 64 if most == 7 else variants.AT_ONCE)
    monkeypatch.setattr(variants.neighbours, "__defaults__", (most, searches))
    assert got_variants(variants.spelling_variants(words)) == variants_of(counts)


def test_words_are_counted_with_their_deletions(spark):
    texts = [(1, "Hello WORLD hello, ÀÉÿ×÷ naïve naïve_x x3yz " * 30), (2, None), (3, ""), (None, "hello hello hello world"), (1, "hello " * 5), (4, "straße " + "ab" * 700_000 + " straße!" + " mixed Case" * 300_000), (5, "Ωmega ßeta 漢字abcde")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit(7))
    import re

    total = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc}:{w}".encode()) if doc is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    want = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in variants.counted(docs).collect()} == want
    some = variants.counted(docs, period=3, least_length=1, least=1)
    total3 = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc}:{w}".encode()) if doc is not None else 1
            total3[w if h % 3 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    total3.pop("", None)
    assert {r.word: r.n for r in some.collect()} == total3


def test_no_words_give_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    for rows in (docs, docs.where("false")):
        assert variants.spelling_variants(variants.counted(rows)).collect() == []


def test_chains_of_forms_end_at_their_root(spark):
    counts = {"a" * k: 3 * 2**k for k in range(5, 25)} | {"b" * 9: 5}
    got = got_variants(variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert got["aaaaa"][:2] == ("a" * 6, "a" * 24) and got["b" * 9][:2] == (None, "b" * 9) and got == variants_of(counts)


@settings(max_examples=200, deadline=None)
@given(st.text("abz", min_size=1, max_size=7), st.lists(st.text("abz", min_size=1, max_size=8), min_size=1, max_size=12, unique=True))
def test_tries_find_near_words_of_one_side(word, others):
    """A word and every near one find each other from exactly one side."""
    found = Counter()
    for q, role in itertools.product([word, *others], (1, 2)):
        length = len(q) + (role == 2)
        own = sorted({w for w in [word, *others] if len(w) == length})
        if not own:
            continue
        matrix = lambda ws: np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(len(ws), -1)
        trie = variants.Trie(matrix(own), np.ones(len(own), np.int64), 0)
        _, b = variants.near_pairs(trie, matrix([q]), np.array([variants.FRESH if role == 1 else variants.LONGER]), role == 2)
        for i in b:
            found[frozenset((q, trie.letters[i].tobytes().decode("latin-1")))] += 1
    words = sorted({word, *others})
    repeats = 2 if word in others else 1
    for x, y in itertools.combinations(words, 2):
        n = found[frozenset((x, y))]
        assert (n > 0) == edits(x, y) and n <= repeats


# --- exact top-k ---


def ints(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def usable_rows(rows, labelled=False):
    ok = lambda r: r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and (not labelled or r[2] is not None)
    return [r for r in rows if ok(r)]


def top_of(rows, k, every):
    rows, out = usable_rows(rows), []
    for i, q in enumerate(rows):
        if q[0] % every:
            continue
        a = ints(q[1])
        scored = sorted((-sum(x * y for x, y in zip(a, ints(r[1]), strict=True)), r[0]) for j, r in enumerate(rows) if j != i and len(r[1]) == len(q[1]))
        out += [(q[0], n + 1, v, -s) for n, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def vector_rows(draw, n, dim=6, first=0):
    rows = [(first + i, [float(np.float32(x)) for x in draw.normal(size=dim) * 0.4], int(draw.integers(0, 10))) for i in range(n)]
    hot = rows[3][1]
    rows += [(first + n + i, hot, i % 3) for i in range(n // 2)]  # a third of all rows are equal
    last = first + n + n // 2
    return rows + [(last + 1, None, 1), (last + 2, [0.0] * dim, 1), (last + 3, [None] + [1.0] * (dim - 1), 2), (last + 4, [float("nan")] * dim, 2), (last + 5, [float("inf")] + [0.0] * (dim - 1), 2), (None, [1.0] * dim, 1), (50 * (last // 50 + 2), [1.0, 2.0], 1), (last + 7, [3.0, -1.0], None), (rows[0][0], rows[0][1], 4), (rows[5][0], [-x for x in rows[5][1]], 4), (last + 9, [], 3), (last + 10, [], 3), (50 * (last // 50 + 3), [], 3)]


@pytest.mark.parametrize("shard", [shards.SHARD, 16])
def test_top_k_against_all_products(spark, monkeypatch, shard):
    monkeypatch.setattr(shards, "SHARD", shard)
    rows = vector_rows(np.random.default_rng(2), 120)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit(1), "rank": F.lit(2)}).repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == top_of(rows, 5, 50)


def test_top_k_of_few_none_and_huge_numbers(spark):
    small = spark.createDataFrame([(0, [1.0], 0), (7, [2.0], 0)], VECTORS)
    assert [(r.vec_id, r.score) for r in topk.top_k(small, F.col("vec_id") == 0, 5).collect()] == [(7, 256 * 512)]
    assert topk.top_k(small.where("false"), F.col("vec_id") == 0).collect() == [] and topk.top_k(small, F.lit(False)).collect() == []
    wide = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (4, [2.0**20, 2.0**18])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(wide, F.col("vec_id") == 4, 5).collect()}
    assert got[0] == got[1] == shards.LONGEST and got[2] == -shards.LONGEST and got[3] == 256 * 256 * (2**20 + 2**18)


def test_threshold_search_stops_early_where_values_differ():
    draw = np.random.default_rng(9)
    x = np.zeros((2000, 8))
    x[np.arange(2000), draw.integers(0, 8, size=2000)] = np.floor(draw.pareto(1.5, size=2000) * 40)
    lists = np.argsort(x.T, axis=1, kind="stable")
    for q in (np.array([3.0, 0, 0, 0, 1, 0, 0, -2]), np.array([1.0, 0, 0, 0, 0, 0, 0, 0]), np.zeros(8)):
        best = topk.Best(5)
        scored = topk.threshold_search(q, x, np.arange(2000), lists, best)
        order = np.lexsort((np.arange(2000), -(x @ q)))[:5]
        assert best.ids.tolist() == order.tolist() and (scored < 600 if q.any() else scored == 2000)


# --- hard negatives ---


def negatives_of(rows, every=100, k=5, m=5, low=80, high=100):
    rows, out = usable_rows(rows, True), []
    for i, a in enumerate(rows):
        if a[0] % every:
            continue
        c = ints(a[1])
        scored = [(-sum(x * y for x, y in zip(c, ints(r[1]), strict=True)), r[0], r[2]) for j, r in enumerate(rows) if j != i and len(r[1]) == len(a[1])]
        same, other = sorted(s for s in scored if s[2] == a[2])[:k], sorted(s for s in scored if s[2] != a[2])
        for p in same:
            window = [o for o in other if low * -p[0] <= 100 * -o[0] <= high * -p[0]][:m]
            out += [(a[0], p[1], n + 1, o[1], -p[0], -o[0]) for n, o in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("shard", [shards.SHARD, 16])
def test_hard_negatives_against_all_products(spark, monkeypatch, shard):
    monkeypatch.setattr(shards, "SHARD", shard)
    rows = vector_rows(np.random.default_rng(4), 260)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit(0), "negative_id": F.lit(1)}).repartition(4)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    assert got == negatives_of(rows, 20) and got


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (200, [-1.0], 3), (4, [1.0], 3)], VECTORS)
    got = [(r.anchor_id, r.positive_id, r.negative_id) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()]
    assert got == [(100, 1, 4), (100, 1, 2)] or sorted(got) == [(100, 1, 2), (100, 1, 4)]
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).collect() == []
    assert negatives.hard_negatives(df.where("label = 2"), F.lit(True)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(1, 62), st.integers(0, 1 << 30))
def test_residues_give_exact_products(dim, bits, seed):
    draw = np.random.default_rng(seed)
    top = 2.0 ** (bits / 2)
    a, b = (np.floor(draw.uniform(-top, top, size=(n, dim))) for n in (3, 4))
    want = [[max(-shards.LONGEST, min(shards.LONGEST, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    assert negatives.scores(negatives.Residues(a), negatives.Residues(b)).tolist() == want


def test_sums_of_residues_stay_exact_in_single_precision():
    for depth in (1, 64, 768, 4096):
        for p in negatives.primes(depth, 60):
            assert depth * ((p - 1) // 2) ** 2 < 1 << 24
    c = np.array([[1e22, -7.0, 123456789.0]])
    r = negatives.residues(c, 101)
    assert [int(x) % 101 for x in r[0]] == [int(1e22) % 101, -7 % 101, 123456789 % 101] and np.abs(r).max() <= 50
    wide = np.random.default_rng(1).integers(-100, 100, size=(2, 9000)).astype(float)
    assert negatives.scores(negatives.Residues(wide), negatives.Residues(wide)).tolist() == (wide @ wide.T).astype(int).tolist()
