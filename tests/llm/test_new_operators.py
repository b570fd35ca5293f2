"""Hard negatives, repeated stretches and collocations against brute force; nulls, ties, empty and long texts, clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import collocations, hard_negatives, substring_dedup

from .test_operators import WORD, empty_docs, odd_docs, prose

# ---- 11, hard negatives


def negatives_by_hand(rows, is_anchor, n_positives=5, n_negatives=3, low=50, high=95):
    used = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[2], [np.floor(256 * x) for x in r[1]]), reverse=True):
        used[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v], label
    score = lambda a, b: sum(x * y for x, y in zip(used[a][0], used[b][0], strict=False))
    out = set()
    for a in filter(is_anchor, used):
        order = sorted((-score(a, b), b) for b in used if b != a)
        for s, p in [x for x in order if used[x[1]][1] == used[a][1]][:n_positives]:
            fit = [x for x in order if used[x[1]][1] != used[a][1] and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out |= {(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fit)}
    return out


@pytest.mark.parametrize(("dims", "n", "spread"), [(8, 300, 1.0), (5, 200, 0.02), (64, 250, 0.1)])
def test_hard_negatives_match_brute_force(spark, dims, n, spread):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in rng.normal(0, spread, dims).astype(np.float32)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(60)]  # ties
    rows += [(n + 100, None, 1), (n + 101, [1.0] * (dims - 1) + [None], 1), (n + 102, [float("nan")] * dims, 1), (n + 103, [float("inf")] * dims, 2), (None, [1.0] * dims, 1), (n + 104, [1.0] * dims, None), (n + 105, [0.25], 1), (n + 106, [], 2)]
    rows += [(7, rows[7][1], rows[7][2]), (0, rows[1][1], 2)]  # repeated ids
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).withColumns({"id": F.lit("x"), "anchor": F.lit(1), "v": F.lit(0), "score": F.lit(1)})
    out = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    got = {tuple(r)[:6] for r in out.collect()}
    assert got == negatives_by_hand(rows, lambda i: i % 10 == 0)
    assert out.count() == len(got)


def test_hard_negatives_take_anchors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).astype(np.float32)], i % 4) for i in range(120)]
    out = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 4 == 1)
    assert {tuple(r)[:6] for r in out.collect()} == negatives_by_hand(rows, lambda i: i % 4 == 1)


def test_hard_negatives_without_rows_or_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_hard_negatives(none, F.lit(True)).collect() == []
    one = spark.createDataFrame([(3, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_hard_negatives(one, F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives.mine_hard_negatives(one, F.lit(None).cast("boolean")).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine_hard_negatives(spark.createDataFrame([(0, [1e9], 1)], "vec_id long, embedding array<float>, label int"), F.lit(True))


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (2000, 9))
    books = hard_negatives.fit_codebooks(x[:500])
    codes, rest = hard_negatives.encode(x, books)
    tables, norm, slack = hard_negatives._lookup(x[:40], books)
    score = sum(tables[m][codes[:, m]] for m in range(len(books)))
    exact = x @ x[:40].T
    assert (np.abs(exact - score) <= rest[:, None] * norm[None, :] + slack).all()
    assert (rest < 0.3 * np.sqrt((x * x).sum(1))).mean() > 0.9  # and they tell something


# ---- 12, repeated stretches


def repeats_by_hand(texts, window):
    w = [WORD.findall(t or "") for t in texts]
    often = Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    out = []
    for t, x in zip(texts, w, strict=True):
        gone = {i + k for i in range(len(x) - window + 1) if often[tuple(x[i : i + window])] > 1 for k in range(window)}
        out.append((len(x), len(gone), None if t is None else " ".join(v for i, v in enumerate(x) if i not in gone)))
    return out


def repeating_texts(rng, n=60):
    shared = [prose(rng, rng.randint(30, 200)) for _ in range(6)]
    few = lambda k: " ".join(rng.choice("ab") for _ in range(k))
    parts = [lambda: prose(rng, rng.randint(0, 90)), lambda: rng.choice(shared), lambda: few(rng.randint(1, 90)), lambda: " ".join(["la"] * rng.randint(1, 80)), lambda: " ".join(["x y z"] * rng.randint(1, 30))]
    texts = [rng.choice([" ", "\n", "\t \r"]).join(rng.choice(parts)() for _ in range(rng.randint(1, 6))) for _ in range(n)]
    near = texts[0].split(" ")
    near[len(near) // 2] = "changed"
    return [*texts, texts[0], " ".join(near), texts[1] + " end", "", None, " \n ", "one"]


@pytest.mark.parametrize("window", [35, 12, 3, 1])
def test_repeats_match_brute_force(spark, window):
    texts = repeating_texts(random.Random(window))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).withColumns({c: F.lit("x") for c in ("at", "f", "a", "ranges", "kept")})
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs, window=window).collect()}
    assert got == dict(enumerate(repeats_by_hand(texts, window)))


def test_repeats_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    texts = repeating_texts(random.Random(9), 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(repeats_by_hand(texts, 35)))


def test_repeats_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, repeats_by_hand([r["text"] for r in rows], 35), strict=True))
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want
    long = prose(random.Random(3), 200)
    twice = spark.createDataFrame([(5, long), (5, long), (None, long), (6, "short")], "doc_id int, text string")
    assert sorted((r["n_removed"] for r in substring_dedup.remove_repeats(twice).collect()), reverse=True) == [200, 200, 200, 0]
    named = substring_dedup.remove_repeats(spark.createDataFrame([("k", long)], "doc_id string, text string"))
    assert [tuple(r) for r in named.collect()] == [("k", 200, 0, long)]
    assert substring_dedup.remove_repeats(empty_docs(spark)).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 50, 60).astype(np.uint64)
    found = []
    for _ in range(30):
        h = np.concatenate([rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64), passage, rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)])
        h = h * np.uint64(0x9E3779B97F4A7C15)
        at = next(i for i in range(len(h)) if (h[i : i + 60] == passage * np.uint64(0x9E3779B97F4A7C15)).all())
        _, f, a, b, _ = substring_dedup.anchors(h, np.array([len(h)]), 35)
        name = {p: x for x, i, j in zip(f, a, b, strict=True) for p in range(i, j + 1)}
        assert sorted(name) == list(range(len(h) - 34))
        found.append(tuple(name[at + i] for i in range(26)))
    assert len(set(found)) == 1


# ---- 13, collocations


def collocations_by_hand(rows, min_count, max_words, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    best = []
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and m == lang and any(q[i : i + len(p)] == p for i in range(len(q))) and b >= a for (m, q), b in often.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        best.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang], cut))
    rank, out = Counter(), set()
    for lang, score, a, phrase, left, right, m, cut in sorted(best):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], phrase.decode(), -a, left, right, m, -score, cut))
    return out


def wordy_rows(rng, n):
    words = ["the", "of", "New", "york", "Éte", "漢字", "x\x00y", "a"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "  "]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "de", None]), text()) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("fr", " . "), ("en", "New York of New York " * 50), ("en", "same here"), ("en", "same here")]


@pytest.mark.parametrize(("min_count", "max_words", "top"), [(4, 5, 2000), (9, 3, 10), (300, 2, 50), (2, 5, 40)])
def test_collocations_match_brute_force(spark, min_count, max_words, top):
    rows = wordy_rows(random.Random(min_count), 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("x") for c in ("phrase", "n", "a", "k")})
    got = {tuple(r) for r in collocations.collocations(docs, min_count=min_count, max_words=max_words, top=top).collect()}
    assert got == collocations_by_hand(rows, min_count, max_words, top)


def test_collocations_with_few_buckets_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 100)
    monkeypatch.setattr(collocations, "HELD", 20)
    monkeypatch.setattr(collocations, "SUMMED", 2)
    rows = wordy_rows(random.Random(1), 100)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert {tuple(r) for r in collocations.collocations(docs, min_count=5).collect()} == collocations_by_hand(rows, 5, 5, 2000)


def test_equal_names_of_different_phrases_are_told_apart():
    ids = np.array([1, 2, 1, 3, 1, 2], np.int32)
    at = np.array([0, 2, 4])
    first, _, n = collocations._phrases(ids, at, np.zeros(6, np.uint64), 2)
    assert sorted(zip(first.tolist(), n.tolist(), strict=True)) == [(0, 2), (2, 1)]


def test_collocations_of_odd_rows(spark):
    assert collocations.collocations(empty_docs(spark).withColumn("lang", F.lit("en"))).collect() == []
    assert collocations.collocations(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).count() >= 0


def test_collocations_count_in_large_tasks(spark, monkeypatch):
    """However finely the files are split, a phrase is counted in a few tasks, and each gives out one row for it."""
    given, written = [], collocations.written

    def seen(df, name):
        df = written(df, name)
        if name == "counted":
            given.extend(r["count"] for r in df.where("phrase is not null").groupBy("phrase").count().collect())
        return df

    monkeypatch.setattr(collocations, "written", seen)
    rows = [("en", "new york has new streets")] * 80
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(40), min_count=50, max_words=3).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == collocations_by_hand(rows, 50, 3, 2000)
    assert max(given) <= spark.sparkContext.defaultParallelism
