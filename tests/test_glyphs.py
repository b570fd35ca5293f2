"""Glyph islands, gutters, native order and paragraphs against plain versions and hand-made lines."""

from __future__ import annotations

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.operators import diagnostics, glyphs
from pagewright.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BOX = "struct<x:double,y:double,w:double,h:double>"
LINES = f"book_id int, page_index int, line_id int, text string, rect {BOX}, box {BOX}, page_width double, rotation int, natural_width double, n_ranges int"


@pytest.fixture(scope="module")
def planted(spark):
    """(book, page): {line: its row}, and {line: its glyphs in order}, over the whole table."""
    rows = catalog._glyphs(spark, SF)
    lines, marks = defaultdict(dict), defaultdict(lambda: defaultdict(list))
    for r in catalog._native_lines(rows).collect():
        lines[r["book_id"], r["page_index"]][r["line_id"]] = r
    for r in rows.orderBy("at").collect():
        marks[r["book_id"], r["page_index"]][r["line_id"]].append(r)
    return lines, marks


def gaps_by_hand(stretch):
    """(index, gap, before, glyph) of the wide gaps of a stretch."""
    seen = [g for g in stretch if g["char"].strip()]
    if not seen:
        return []
    widths = sorted(g["rect"]["w"] for g in seen)
    least = max(0.024, min(0.060, widths[len(widths) // 2] * 4))
    out = []
    for a, b in zip(seen, seen[1:], strict=False):
        r, s = a["rect"], b["rect"]
        gap = max(s["x"] - (r["x"] + r["w"]), r["x"] - (s["x"] + s["w"]), 0)
        if gap >= least:
            out.append((b["at"], r, s))
    return out


def stretches(line):
    parts = defaultdict(list)
    for g in line:
        parts[g["part"]].append(g)
    return [parts[k] for k in sorted(parts)]


def tight(line):
    return line["natural_width"] > 0 and abs(line["box"]["w"] - line["natural_width"]) <= line["natural_width"] * 0.005 + 0.5


def gutters_by_hand(lines, marks):
    may = [i for i in sorted(lines) if lines[i]["n_ranges"] == 1 and len(marks[i]) >= 8 and not tight(lines[i])]
    if len(may) < 2:
        return []
    if len(may) > 5:
        may = [may[k] for k in sorted({int((len(may) - 1) * s / 4 + 0.5) for s in range(5)})]
    found = []
    for row, i in enumerate(may):
        for _, r, s in gaps_by_hand(marks[i]):
            lo, hi = min(r["x"] + r["w"], s["x"] + s["w"]), max(r["x"], s["x"])
            hit = next((f for f in found if min(f[1], hi) - max(f[0], lo) >= 0.01), None)
            if hit is None:
                found.append([lo, hi, {row}])
            else:
                hit[0], hit[1] = max(hit[0], lo), min(hit[1], hi)
                hit[2].add(row)
    return sorted((round(a, 6), round(b, 6)) for a, b, rows in found if len(rows) > 1)


def test_gutters_of_the_whole_table(spark, planted):
    lines, marks = planted
    got = defaultdict(list)
    for r in catalog.queries()["glyph_gutters"](spark, SF).collect():
        got[r["book_id"], r["page_index"]].append((r["min_x"], r["max_x"]))
    want = {k: g for k in lines if (g := gutters_by_hand(lines[k], marks[k]))}
    assert want and {k: sorted(v) for k, v in got.items()} == want


def test_fragments_of_the_whole_table(spark, planted):
    lines, marks = planted
    got = defaultdict(list)
    for r in catalog.queries()["native_fragments"](spark, SF).orderBy("fragment_id").collect():
        got[r["book_id"], r["page_index"]].append(r["text"])
    for k, own in lines.items():
        middle = [(a + b) / 2 for a, b in gutters_by_hand(own, marks[k])]
        want = []
        for i in sorted(own):
            line, box = own[i], own[i]["rect"]
            wide = line["n_ranges"] == 1 and line["box"]["w"] >= 288 and line["box"]["w"] >= line["natural_width"] * 1.18
            if line["n_ranges"] == 1 and not wide and not any(box["x"] < m < box["x"] + box["w"] for m in middle):
                want.append(line["text"])
                continue
            for part in stretches(marks[k][i]):
                cuts = [at for at, *_ in gaps_by_hand(part)]
                pieces = defaultdict(str)
                for g in part:
                    pieces[sum(c <= g["at"] for c in cuts)] += g["char"]
                want += [pieces[n] for n in sorted(pieces)]
        assert [t.strip("\n") for t in want if t.strip()] == got[k]
    assert sum(map(len, got.values())) > sum(map(len, lines.values()))  # some lines are split


def native(spark, rows):
    """Lines from (text, x, y, w, n_ranges, natural); a page is 600 by 800 points."""
    return spark.createDataFrame([(0, 0, i, t, (x, y, w, 0.02), (x * 600, (1 - y - 0.02) * 800, w * 600, 16.0), 600.0, 0, nat, n) for i, (t, x, y, w, n, nat) in enumerate(rows)], LINES)


@pytest.mark.parametrize(
    ("change", "plain"),
    [({}, True), ({2: (0.12, 0.16, 300.0, 1)}, False), ({2: (0.1, 0.11, 300.0, 1)}, False), ({1: (0.1, 0.13, 250.0, 1)}, False), ({1: (0.1, 0.13, None, 1)}, False), ({1: (0.1, 0.13, 300.0, 2)}, False), ({0: (0.1, 0.3, 300.0, 1)}, False), ({1: (0.1015, 0.13, 301.9, 1)}, True)],
)
def test_native_order(spark, change, plain):
    rows = [change.get(i, (0.1, 0.10 + 0.03 * i, 300.0, 1)) for i in range(4)]
    lines = native(spark, [("text", x, y, 0.5, n, nat) for x, y, nat, n in rows])
    assert [r["is_plain"] for r in glyphs.natively_ordered(lines).collect()] == [plain]
    assert [r["is_plain"] for r in glyphs.natively_ordered(lines.withColumn("rotation", F.lit(90))).collect()] == [False]
    assert [r["is_plain"] for r in glyphs.natively_ordered(lines.where("line_id < 2")).collect()] == [False]


def mended(spark, text, rows):
    return glyphs.native_paragraphs(spark.createDataFrame([(0, 0, text)], "book_id int, page_index int, text string"), native(spark, rows)).first()["text"]


@pytest.mark.parametrize(
    ("text", "ys", "want"),
    [
        ("Café  déjà vu.\n\nTiếng Việt đẹp.\n日本語の段落。\nFinal line.", [0.1, 0.125, 0.18, 0.205], "Café  déjà vu.\n\nTiếng Việt đẹp.\n\n日本語の段落。\nFinal line."),
        ("First line.\nSecond line.\nThird line.\nFourth line.", [0.1, 0.15, 0.2, 0.25], None),
        ("One paragraph.\r\nAnother paragraph.", [0.1, 0.2], "One paragraph.\r\n\r\nAnother paragraph."),
        ("One paragraph.\nAnother paragraph.", [0.1, 0.125], None),
    ],
)
def test_paragraphs(spark, text, ys, want):
    said = [x.strip() for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
    rows = [(t, 0.12, y, 0.7, 1, 420.0) for t, y in zip(said, ys, strict=True)]
    assert mended(spark, text, rows) == (want or text)
    assert mended(spark, want or text, rows) == (want or text)  # once is enough
    assert mended(spark, text, [(t + "!", *rest) for t, *rest in rows]) == text  # other words are no evidence


def test_a_line_of_several_stretches_is_no_evidence(spark):
    rows = [(t, 0.12, y, 0.7, n, 420.0) for t, y, n in (("One.", 0.1, 1), ("Two.", 0.125, 2), ("Three.", 0.2, 1), ("Four.", 0.225, 1))]
    assert mended(spark, "One.\nTwo.\nThree.\nFour.", rows) == "One.\nTwo.\nThree.\nFour."


def test_extraction_as_text(spark):
    lines = native(spark, [("One line", 0.1, 0.1, 0.5, 1, 300.0)])
    marks = spark.createDataFrame([(0, 0, 0, 0, 0, "O", (0.1, 0.1, 0.01, 0.02), None, None, None)], f"book_id int, page_index int, line_id int, part int, at int, char string, rect {BOX}, font_size double, is_bold boolean, is_italic boolean")
    f = glyphs.native_fragments(lines, marks)
    assert diagnostics.extraction_text(lines, marks, f).first()["description"] == "line[0] ranges=1 glyphs=1 rect=(0.100, 0.100, 0.500, 0.020) text=One line\nfragment[0] rect=(0.100, 0.100, 0.500, 0.020) text=One line"
    assert glyphs.native_fragments(lines.where("false"), marks).collect() == []
