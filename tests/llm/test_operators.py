"""Operators of the subpackage against brute force, round trips and held-out labels; nulls, ties, long texts, clashing names."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bpe, bt_quality, chat_format, fingerprints, line_dedup, near_dedup, ngram_lm, packing, quality_rules, queries, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_docs(spark, rules_type: str = "string"):
    """Nulls, empty, blank and very long texts, ties and repeated rows, and columns named like those that operators add."""
    long = prose(random.Random(1), 60_000)
    rows = [(1, None, "x"), (2, "", None), (3, " \t\n\x0b ", "x"), (4, long, "y"), (5, "Ünïcode 漢字 🎉 text", "z"), (6, "same text of nine words here for a tie", "x"), (7, "same text of nine words here for a tie", "x"), (8, "a" * 5000, None), (None, "no id at all", "x"), (9, "line\nline\nline\n", "x"), (9, "line\nline\nline\n", "x")]
    return spark.createDataFrame(rows, f"doc_id long, text string, rules {rules_type}").withColumns({"id": F.lit("extra"), "n": F.lit(0), "key": F.lit(1), "_guest": F.lit(2), "x": F.lit("x"), "dedup": F.lit(None).cast("string"), "f": F.lit(1)})


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# ---- 10, quality rules


def rules_by_hand(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {k for k, c in Counter(windows).items() if c > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    repeat = len({i + k for i, x in enumerate(windows) if x in often for k in range(5)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def test_rules_match_brute_force(spark):
    docs = odd_docs(spark)
    out = quality_rules.apply_rules(docs, out_col="verdict").collect()
    assert len(out) == docs.count()
    for r in out:
        v = r["verdict"]
        assert tuple(v[k] for k in queries.BASE[:-1]) == rules_by_hand(r["text"])
        assert not (v["kept"] and v["base_failed"])
    replaced = quality_rules.apply_rules(docs)
    assert sorted(replaced.columns) == sorted(docs.columns)
    assert quality_rules.apply_rules(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(("text", "base_failed"), [("a b c d e f g h i", True), ("a b c d e f g h i j", False), ("a b c d e a b c d e " + prose(random.Random(2), 40), False), ("a b c d e a b c d e " + prose(random.Random(2), 39), True)])
def test_base_rules_at_their_limits(spark, text, base_failed):
    assert quality_rules.apply_rules(spark.createDataFrame([(text,)], "text string")).select("rules.base_failed").first()[0] is base_failed


# ---- 1, classifier


def test_classifier_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op1_bt_quality(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_classifier_never_reads_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(bt_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert bt_quality.fit(docs, labels) == bt_quality.fit(docs, turned)
    held = {r["doc_id"] for r in docs.where(bt_quality.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert held == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_classifier_on_odd_rows(spark):
    docs = odd_docs(spark)
    one_kind = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = bt_quality.fit(docs, one_kind)
    out = bt_quality.score_documents(docs, model, out_col="q").collect()
    assert len(out) == docs.count() and all(r["q"]["score"] == pytest.approx(0.3) for r in out)
    both = spark.createDataFrame([(4, 1), (6, 0), (8, 0), (5, 1)], "doc_id long, quality int")
    for r in bt_quality.score_documents(docs, bt_quality.fit(docs, both), out_col="q").collect():
        assert 0 <= r["q"]["score"] <= 1 and r["q"]["predicted"] == int(r["q"]["score"] >= 0.3)
    assert bt_quality.score_documents(empty_docs(spark), model).count() == 0


# ---- 2, byte-pair encoding


def reference_encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n'", max_size=300))
def test_encoder_matches_tiktoken(text):
    ids = np.frombuffer(bpe.encoder(bpe.RANKS, public_tokenizers.PATTERN).encode(text), "<u4").tolist()
    assert ids == reference_encoding().encode_ordinary(text)


def test_long_pre_tokens():
    rng = random.Random(3)
    enc, known = bpe.encoder(bpe.RANKS, public_tokenizers.PATTERN), reference_encoding()
    for text in ("a" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(30_000)), "ab" * 10_000, "🎉漢" * 3000):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == known.encode_ordinary(text)


def test_encoding_documents(spark):
    known = reference_encoding()
    for docs in (odd_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        got = bpe.decode_documents(bpe.encode_documents(docs)).collect()
        assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == texts
        for r in got:
            assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(bytes(r["decoded"]).decode()) and r["n_tokens"] * 4 == len(r["ids"])
    assert bpe.decode_documents(bpe.encode_documents(empty_docs(spark))).count() == 0


# ---- 3, packing


def assert_packed(pieces, texts: dict, capacity: int = 1024):
    """Every id in one piece, sequences gapless, whole or of a power of two."""
    known = Tokenizer.from_file(packing.VOCABULARY)
    ids = lambda t: np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4")
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r["start"])
        want = ids(texts[d])
        assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["length"] for r in rows)][:-1]
        assert b"".join(bytes(r["ids"]) for r in rows) == want.tobytes() and {r["doc_tokens"] for r in rows} == {len(want)}
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        ends = [0, *itertools.accumulate(r["length"] for r in rows)]
        assert [r["offset"] for r in rows] == ends[:-1]
        assert ends[-1] == capacity or (ends[-1] < capacity and ends[-1] & (ends[-1] - 1) == 0)


def test_packing(spark):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    assert_packed(packing.pack_documents(docs).collect(), {r["doc_id"]: r["text"] or "" for r in docs.collect()})
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert_packed(packing.pack_documents(real.repartition(3)).collect(), {r["doc_id"]: r["text"] or "" for r in real.collect()})
    twice = packing.pack_documents(odd_docs(spark)).where("start = 0").count()
    assert twice == odd_docs(spark).count()
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_packing_of_special_tokens(spark):
    texts = dict(enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|endoftext|>" * 1500]))
    assert_packed(packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(4)
    packer = packing.Packer(16)
    for i in range(300):
        size = rng.randrange(1, 16)
        count = packer.count.copy()

        def total(level):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16] ** 2).sum())

        usable = [0, *(h for h in range(1, 17 - size) if count[h])]
        level = packer.level_for(size)
        assert level in usable and total(level) == min(map(total, usable))
        packer.add(i, 0, size, np.arange(size, dtype=np.uint32))


def test_the_method_places_nearly_all(spark):
    rng = random.Random(9)
    sizes = [rng.choice([rng.randrange(1, 1024), rng.randrange(1, 200)]) for _ in range(4000)]
    packer = packing.Packer(1024)
    for i, n in enumerate(sizes):
        packer.add(i, 0, n, np.arange(n, dtype=np.uint32))
    moved = packer.finish()
    assert moved < 0.05 * sum(sizes)
    assert sum(len(p[3]) for w in packer.done for p in w) == sum(sizes)
    short = [n for w in packer.done if (n := sum(len(p[3]) for p in w)) != 1024]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_IDS", 4096)
    rng = random.Random(10)
    texts = {i: prose(rng, rng.choice([5, 60, 500])) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert_packed(packing.pack_documents(docs).collect(), texts)
    nowhere = {i: "w1 " * 290 for i in range(40)}  # no two fit in a sequence
    assert_packed(packing.pack_documents(spark.createDataFrame(list(nowhere.items()), "doc_id long, text string").repartition(6)).collect(), nowhere)


# ---- 4, near duplicates


def near_by_hand(texts: dict[int, str | None], size: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def changed(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rng = random.Random(5 + size)
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "two one"}
    for _ in range(12):  # chains, so that ends of a group may be unlike each other
        text = prose(rng, rng.choice([12, 40, 120, 300]))
        for _ in range(rng.choice([1, 3, 12])):
            texts[len(texts)] = text
            text = changed(rng, text, rng.randrange(0, max(2, len(text.split()) // (8 * size))))
    hub = prose(rng, 200)
    for _ in range(40):  # a star of near copies
        texts[len(texts)] = changed(rng, hub, rng.randrange(0, 16 // size))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"id": F.lit("x"), "u": F.lit(1), "key": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=size).collect()}
    assert got == near_by_hand(texts, size)


def test_near_copies_inside_many_longer_documents(spark):
    rng = random.Random(19)
    hot = prose(rng, 60)
    texts = {i: prose(rng, 33) + " " + hot + " " + prose(rng, 33) for i in range(40)} | {1000: hot, 1001: " ".join(hot.split()[:54])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=2, bands=4, rows=1).collect()}  # a longer one heads each bucket
    assert got == near_by_hand(texts, 2) and got[1001][1] == 1000


@pytest.mark.parametrize(("size", "own"), [(2, 0), (2, 2), (2, 4), (5, 0), (5, 1)])
def test_links_beside_a_head_match_brute_force(spark, size, own):
    rng = random.Random(23 + own)
    base = prose(rng, 120)
    texts = {i: changed(rng, base, rng.randrange(0, 30 // size)) + " " + prose(rng, own * rng.randrange(6)) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=size, bands=3, rows=1).collect()}  # few large buckets
    want = near_by_hand(texts, size)
    assert got == want or sum(got[i] != want[i] for i in texts) <= 2  # a pair may share no band of three


def test_template_pages_of_different_content(spark):
    rng = random.Random(29)
    base = prose(rng, 60)
    docs = spark.createDataFrame([(i, base + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(20_000)], "doc_id long, text string").repartition(8)
    out = near_dedup.near_duplicates(docs, shingle=2)
    assert out.where("kept").count() == 20_000


def test_near_duplicates_on_real_and_odd_rows(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(real, shingle=2).collect()}
    assert got == near_by_hand({r["doc_id"]: r["text"] for r in real.collect()}, 2)
    out = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1, 10))
    assert {r["doc_id"] for r in out if not r["kept"]} == {7}
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(-(2**63), 2**63 - 1, 300)
    a, b = near_dedup.super_minhash([pool[:200], pool[100:]], 256)
    assert abs((a == b).mean() - 1 / 3) < 0.1
    assert (near_dedup.super_minhash([pool[:3], pool[:3][::-1].copy()], 64)[0] == near_dedup.super_minhash([pool[:3]], 64)[0]).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(5, 5)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


# ---- 5, chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[:]", ""]), st.text(alphabet="[]/<>\\INST:YURs ok", max_size=30)), max_size=4))
def test_template_is_reversible(turns):
    formatted, spans = chat_format.format_turns(turns)
    assert chat_format.parse_turns(formatted) == turns
    assert [chat_format.unescape(formatted[a : a + n]) for a, n in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        (1, '{"prompt": "p", "completion": "c"}'), (2, '{"instruction": "i", "output": "o", "unknown": 3}'), (3, '{"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}'),
        (4, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": null}]}'), (5, "[]"), (6, None), (7, "{"), (8, '{"data": {"prompt": "x", "response": "y"}}'), (9, '{"nothing": 1}'),
    ]
    out = {r["k"]: r for r in chat_format.canonical_turns(spark.createDataFrame(records, "k int, record string"), "k", "record").collect()}
    turns = {k: r["turns"] and [tuple(t) for t in r["turns"]] for k, r in out.items()}
    assert turns == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "u"), ("assistant", "a")], 4: [("user", "h"), ("assistant", "")], 5: None, 6: None, 7: None, 8: [("user", "x"), ("assistant", "y")], 9: None}
    back = chat_format.read_back(chat_format.format_conversations(chat_format.canonical_turns(spark.createDataFrame(records, "k int, record string"), "k", "record"), "k"), "k")
    assert {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in back.collect()} == turns


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (2, None, None, "x"), (2, None, None, "x"), (None, 0, "user", "lost")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.canonical_turns(chat_format.conversation_records(talks), "conv_id", "record").collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [("", "x"), ("", "x")], None: [("user", "lost")]}
    kinds = [("user", "assistant"), ("system", "user", "assistant"), ("tool", "human"), ("user", "gpt", "user")]
    many = [(i, k, role, f"{i}.{k}") for i in range(200) for k, role in enumerate(kinds[i % 4])]
    read = chat_format.canonical_turns(chat_format.conversation_records(spark.createDataFrame(many, "conv_id long, turn long, role string, text string")), "conv_id", "record").collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read} == {i: [(role, f"{i}.{k}") for k, role in enumerate(kinds[i % 4])] for i in range(200)}
    assert {r["layout"] for r in read} == {m.name for m in chat_format.MAPPINGS}
    assert chat_format.conversation_records(talks.limit(0)).count() == 0


def test_records_take_one_python_worker(spark):
    """Three steps one behind the other are three workers in every slot of an executor."""
    records = [(i, f'{{"prompt": "</s>{i}", "completion": "[INST] {i}"}}') for i in range(600)] + [(600, None), (601, "{"), (602, '{"nothing": 1}'), (603, '{"messages": []}'), (604, '{"question": null, "answer": "a"}')]
    records = spark.createDataFrame(records, "k int, record string").repartition(2)
    own = chat_format.format_records(records, "k", "record")
    assert len(re.findall(r"Map(?:InArrow|InPandas)|(?:Arrow|Batch)EvalPython", own._jdf.queryExecution().executedPlan().toString())) == 1
    canonical = chat_format.canonical_turns(records, "k", "record")
    formatted = chat_format.format_conversations(canonical, "k")
    in_steps = {r["k"]: r.asDict(recursive=True) for r in formatted.join(chat_format.read_back(formatted, "k"), "k").collect()}
    known = {r["k"]: (r["fingerprint"], r["layout"]) for r in canonical.collect()}
    got = {r["k"]: r.asDict(recursive=True) for r in own.collect()}
    assert {k: (r.pop("fingerprint"), r.pop("layout")) for k, r in got.items()} == known
    assert got == in_steps
    assert chat_format.format_records(records.limit(0), "k", "record").count() == 0
    plan = queries.op5_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Map(?:InArrow|InPandas)", plan)) == 1


# ---- 6, language model


def test_language_model_on_odd_rows(spark):
    texts = {1: "a b a b c", 2: "a b d", 3: None, 4: "", 5: "A B\tC"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"block": F.lit(1), "id": F.lit("x")})
    words = {d: WORD.findall((t or "").lower()) for d, t in texts.items()}
    one = Counter(w for x in words.values() for w in x)
    two = Counter(p for x in words.values() for p in itertools.pairwise(x))

    def score(d):
        own1, own2 = Counter(words[d]), Counter(itertools.pairwise(words[d]))
        others, total = sum(one.values()) - len(words[d]), 0.0
        for h, w in zip([None, *words[d]], words[d], strict=False):
            if h is not None and two[h, w] > own2[h, w]:
                total += np.log((two[h, w] - own2[h, w]) / (one[h] - own1[h]))
                continue
            c = one[w] - own1[w]
            total += np.log(c / others if c else 1 / (others + 1)) + (np.log(0.4) if h is not None else 0)
        return total

    three = Counter(g for x in words.values() for g in zip(x, x[1:], x[2:], strict=False))

    def score_three(d):
        w, own1, own2, own3 = words[d], Counter(words[d]), Counter(itertools.pairwise(words[d])), Counter(zip(words[d], words[d][1:], words[d][2:], strict=False))
        others, total = sum(one.values()) - len(w), 0.0
        for i, x in enumerate(w):
            rest3 = three[tuple(w[i - 2 : i + 1])] - own3[tuple(w[i - 2 : i + 1])] if i > 1 else 0
            rest2 = two[w[i - 1], x] - own2[w[i - 1], x] if i else 0
            rest1 = one[x] - own1[x]
            if rest3:
                total += np.log(rest3 / (two[w[i - 2], w[i - 1]] - own2[w[i - 2], w[i - 1]]))
            elif rest2:
                total += (np.log(0.4) if i > 1 else 0) + np.log(rest2 / (one[w[i - 1]] - own1[w[i - 1]]))
            else:
                total += min(i, 2) * np.log(0.4) + np.log(rest1 / others if rest1 else 1 / (others + 1))
        return total

    for r in ngram_lm.score_documents(docs, order=3).collect():
        assert r["log_score"] == pytest.approx(score_three(r["doc_id"]))
    for block_chars in (12_000_000, 5):
        got = {r["doc_id"]: r for r in ngram_lm.score_documents(docs, block_chars=block_chars).collect()}
        assert {d: r["n_words"] for d, r in got.items()} == {d: len(x) for d, x in words.items()}
        for d, r in got.items():
            assert r["log_score"] == pytest.approx(score(d))
    assert ngram_lm.score_documents(odd_docs(spark)).count() == odd_docs(spark).count()
    assert ngram_lm.score_documents(empty_docs(spark)).count() == 0


# ---- 7, line dedup


def test_repeated_passages_go_from_later_documents(spark):
    rng = random.Random(7)
    passage = ". ".join(prose(rng, 13) for _ in range(5)) + ". "
    short = prose(rng, 12) + ".\n"
    texts = {i: prose(rng, 30) + ".\n" + short + prose(rng, 20) + ". " + (passage if i % 2 else "") + prose(rng, 25) + "." for i in range(20)}
    docs = spark.createDataFrame([*texts.items(), (100, None), (101, ""), (102, "no end"), (None, passage)], "doc_id long, text string").withColumn("dedup", F.lit("old"))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(out) == 24
    for i, t in texts.items():
        assert out[i]["text"] == (t.replace(passage, "") if i % 2 and i > 1 else t)
    assert out[100]["text"] is None and out[101]["text"] == "" and out[None]["text"] == passage


def test_line_dedup_on_copies_and_odd_rows(spark):
    rng = random.Random(8)
    text = "\n".join(prose(rng, 20) for _ in range(6))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text + "\n" + prose(rng, 50)), (4, "\x01 " + text)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert out[0] == (1, text) and out[1] == out[2] == (2, "") and len(out[3][1].split()) == 50
    assert line_dedup.dedup_lines(odd_docs(spark)).count() == odd_docs(spark).count()
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_cut_lines_join_to_the_text(spark):
    texts = ["", "\n\n", "a. b! c? d", "x\x01y. z\n", "end. "]
    lines = line_dedup.cut_lines(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(lines, "").alias("j"), F.size(lines).alias("n"), line_dedup.count_lines(F.col("t")).alias("m")).collect()
    assert all(r["t"] == r["j"] and r["n"] == r["m"] for r in got)


def lines_by_hand(texts: dict[int, str], n: int = 36) -> dict[int, str]:
    seen, out = set(), {}
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        gone = set()
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in seen:
                gone.update(range(p, p + n))
            seen.add(tuple(w[p : p + n]))
        pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", texts[d])
        lead = re.match(r"[\x20\x09-\x0D]*", texts[d])[0]
        out[d] = lead + "".join(x for i, x in enumerate(pieces) if i not in gone)
    return out


def test_passages_that_begin_and_end_inside_a_line_go(spark):
    rng = random.Random(17)
    passages = [". ".join(prose(rng, 13) for _ in range(4)) + "." for _ in range(2)] + [prose(rng, 36), prose(rng, 35)]
    texts = {i: " " * (i % 3) + prose(rng, 40) + "\n" + prose(rng, 7) + " " + passages[i % 4] + " " + prose(rng, 9) + ".\n" for i in range(16)}
    texts |= {20: "w1 " * 90, 21: "a b c d e " * 30 + prose(rng, 40), 22: prose(rng, 40) + "\n" + texts[3] + texts[3]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == lines_by_hand(texts)
    assert all(passages[i % 4] not in out[i] for i in range(4, 16) if i % 4 < 3) and out[7] == texts[7]


def test_line_dedup_deals_fingerprints_once(spark, monkeypatch):
    """Both windows over fingerprints read one exchange and one sort."""
    plans, written = {}, line_dedup.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(line_dedup, "written", seen)
    passage = prose(random.Random(3), 40)
    docs = spark.createDataFrame([(1, passage), (2, f"before {passage} behind")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: passage, 2: "before behind"}
    assert [plans["ranges"].count(node) for node in ("Exchange ", "Sort ")] == [1, 1]


def test_line_dedup_hashes_stretches_in_compiled_code(spark, monkeypatch):
    """Lambdas are interpreted: they may look at pairs of words, but hashing what is around a fingerprint, or a stretch, there was most of the time."""
    plans, written = {}, line_dedup.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(line_dedup, "written", seen)
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"))
    for plan in (plans["ranges"], out._jdf.queryExecution().executedPlan().toString()):
        hashed = [x for x in plan.split("\n") if "xxhash64(" in x and "slice(" in x]
        assert hashed and not any("lambda" in x for x in hashed)
    assert not any(x.count("split(") > 1 for x in plans["ranges"].split("\n"))


@pytest.mark.parametrize(("n", "window"), [(1, 29), (2, 29), (5, 3), (36, 29)])
def test_every_stretch_is_in_one_range(spark, n, window):
    """With no, few and many grams that are fingerprints; two stretches of the same words get the same fingerprint."""
    rng = random.Random(41)
    texts = {0: "", 1: "w", 2: "w " * 90, 3: prose(rng, 36), 4: prose(rng, 35), 5: prose(rng, 3000), 6: " ".join(rng.choice("ab") for _ in range(600)), 7: "a b c d e " * 60}
    texts |= {10 + i: prose(rng, rng.randrange(60)) + " " + texts[5][700 * i :][:400] + " " + prose(rng, rng.randrange(60)) for i in range(12)}
    w = {i: WORD.findall(t) for i, t in texts.items()}
    rows = line_dedup.fingerprints(spark.createDataFrame(list(w.items()), "at long, w array<string>"), n, max(1, min(window, n - 1))).collect()
    assert sorted((r["at"], p) for r in rows for p in range(r["a"], r["b"] + 1)) == sorted((i, p) for i, x in w.items() for p in range(len(x) - n + 1))
    prints = {}
    for r in rows:
        for p in range(r["a"], r["b"] + 1):
            assert prints.setdefault(tuple(w[r["at"]][p : p + n]), r["f"]) == r["f"]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_words=n, window=window).collect()} == lines_by_hand(texts, n)


def test_line_dedup_matches_brute_force(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(real).where("text is not null").collect()}
    assert out == lines_by_hand({r["doc_id"]: r["text"] for r in real.where("text is not null").collect()})


# ---- 8, archives


def test_archives_round_trip(spark):
    big, small = "<p>" + "x" * 200 + "</p>", "tiny"
    rows = [(3, "http://A.example/b?q#f", big), (1, "https://u@a.example:80/b", big), (2, None, big), (4, "", small), (5, "http://b.example/", small), (6, "x\r\ny", None), (7, "http://a.example/", "é" * 5000), (8, "http://a.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit("x"), "payload": F.lit("y")}).repartition(3)
    blocks, folder = warc.archive_pages(pages)
    back = {int(r["record_id"]): r for r in warc.read_archives(blocks, folder, 2).collect()}
    assert sorted(back) == list(range(1, 9))
    for i, _, html in rows:
        want = (html or "").encode()
        assert back[i]["header_digest"] == hashlib.sha256(want).hexdigest() and back[i]["header_bytes"] == len(want)
        revisit = i in (2, 3)
        assert back[i]["record_type"] == ("revisit" if revisit else "response") and back[i]["refers_to"] == ("1" if revisit else None)
        assert revisit or bytes(back[i]["payload"]) == want
    merged = warc.merged_index(blocks, folder, range_rows=3).orderBy("seq").collect()
    keys = [(r["url_key"], r["date"], r["id"]) for r in merged]
    assert keys == sorted(keys) and [r["seq"] for r in merged] == list(range(1, 9))
    none, folder = warc.archive_pages(pages.limit(0))
    assert warc.merged_index(none, folder).count() == warc.read_archives(none, folder, 1).count() == 0


def test_history_is_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 3)
    rng = random.Random(31)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["http://hot.example/", None, f"http://{i % 7}.example/{i % 5}"]), rng.choice(["a" * 150, "b" * 120, str(i)])) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)  # ids repeat with other payloads
    blocks, folder = warc.archive_pages(pages, date=F.lit("2024"), run_rows=30)
    runs = blocks.select("run").distinct().count()
    for fan_in in (2, 64):
        got = warc.merged_index(blocks, folder, range_rows=25, fan_in=fan_in).orderBy("seq").collect()
        assert [r["seq"] for r in got] == list(range(1, 401))
        order = [warc._key((r["url_key"], r["date"], r["id"], r["file"], r["at"])) for r in got]
        assert order == sorted(order)
    assert warc.longer_runs(blocks, folder, 3).select("run").distinct().count() < runs
    back = warc.read_archives(blocks, folder, 3).collect()
    first = {}
    for i, _, html in rows:
        if i is not None and len(html) >= 100:
            first[html] = min(first.get(html, i), i)
    want = Counter((str(i), "revisit" if i is not None and len(html) >= 100 and first[html] < i else "response") for i, _, html in rows)
    assert Counter((str(r["record_id"]), r["record_type"]) for r in back) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.none() | st.integers(0, 3)), max_size=6), max_size=7))
def test_loser_tree_merges_like_a_heap(keys):
    runs = [sorted([(*k, "f", i, 0) for i, k in enumerate(run)], key=warc._key) for run in keys]
    assert [warc._key(x) for x in warc.merge_runs(runs)] == [warc._key(x) for x in heapq.merge(*runs, key=warc._key)]


# ---- 1, features and scores


def features_by_hand(text):
    t = text or ""
    n_words, chars, symbols, dup_lines, repeat, _ = rules_by_hand(t)
    n, c = max(n_words, 1), max(chars, 1)
    plain = t.lower().translate(str.maketrans(dict.fromkeys(quality_rules.MARKS, " ")))
    stops = sum(w in quality_rules.STOP_WORDS for w in WORD.findall(plain)) / n
    n_lines = max(1, sum(bool(WORD.search(x)) for x in t.split("\n")))
    share = lambda x, total: np.log1p(20 * x / total)
    upper = sum(unicodedata.category(x) == "Lu" for x in t)
    ends = len(re.findall(r"[.?!](?:[ \t\n\x0b\f\r]|\Z)", t))
    distinct = len(set(WORD.findall(t.lower())))
    return [
        share(symbols, n), stops, share(dup_lines, n_lines), share(repeat, n), np.log1p(chars / n), share(upper, c), share(t.count("!"), n), share(sum(x in "0123456789" for x in t), c),
        np.log1p(distinct) / np.log1p(n), np.log1p(n), share(ends, n), max(0.0, 0.15 - stops) if n >= 20 else 0.0,
    ]


def test_features_and_scores_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text").where("doc_id is not null and doc_id != 9").withColumn("doc_id", -F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", bt_quality.features(F.col("text")).alias("x")).collect()}
    want = {d: features_by_hand(t) for d, t in texts.items()}
    for d in texts:
        assert got[d] == pytest.approx(want[d], abs=1e-9), d
    model = bt_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r["doc_id"]: r["q"] for r in bt_quality.score_documents(docs, model, out_col="q").collect()}
    for d, x in want.items():
        raw = float(np.dot(model.weights, x))
        z = (raw - model.threshold) * model.scale + np.log(bt_quality.AT_THRESHOLD / (1 - bt_quality.AT_THRESHOLD))
        assert scored[d]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert scored[d]["predicted"] == int(scored[d]["score"] >= 0.3)


# ---- 9, fingerprints


def test_edited_texts_and_likeness(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in real.collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(real).collect()}
    assert set(got) == set(texts)
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(t)) else set()
    errors, next_errors = [], []
    for d, t in texts.items():
        half = len(t) // 2
        c = shingles(texts[following[d]])
        next_errors.append(abs(got[d]["near_next"] - (len(shingles(t) & c) / len(shingles(t) | c) if shingles(t) | c else 1.0)))
        edited = t[: len(t) - half] + texts[following[d]][:half]
        assert got[d]["edited"] == edited and got[d]["n_chars"] == len(t)
        a, b = shingles(t), shingles(edited)
        errors.append(abs(got[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.2
    assert np.mean(next_errors) < 0.04 and max(next_errors) < 0.2
    pair = spark.createDataFrame([(1, prose(random.Random(1), 300)), (2, prose(random.Random(1), 300)), (3, "another text of other words " * 30)], "doc_id long, text string")
    assert {r["doc_id"]: round(r["near_next"], 1) for r in fingerprints.fingerprint_edits(pair).collect()} == {3: 0.0, 2: 1.0, 1: 0.0}
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_fingerprints_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = fingerprints.fingerprint_edits(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(empty_docs(spark)).count() == 0
