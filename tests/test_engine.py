"""The whole way over hand-made books."""

from __future__ import annotations

import threading
import time

import pytest

from pagewright.config import CleanupConfig, EngineConfig, LayoutConfig
from pagewright.engine import Cancelled, Engine, Progress, chapter_of_page, parse_errors

from .test_layout import PAGES, SCHEMA


def test_run(spark):
    texts = {i: "\n".join(f[3] for f in own) for i, own in enumerate(PAGES.values())}
    rows = [(0, i, ("Chapter 1\n" if i == 0 else "") + x) for i, x in texts.items()]
    pages = spark.createDataFrame(rows, "book_id int, page_index int, native_text string")
    two = spark.createDataFrame(PAGES["two_by_row"], SCHEMA)
    seen = []
    out = Engine(spark, EngineConfig(cleanup=CleanupConfig.minimal(), keeps_native_text=False), seen.append).run(pages, two)
    got = {r["page_index"]: r for r in out["pages"].collect()}
    assert len(got) == 7 and all(r["native_text"] == "" for r in got.values())
    assert got[2]["text"].split() == " ".join([f[3] for f in PAGES["two_by_row"]][::2] + [f[3] for f in PAGES["two_by_row"]][1::2]).split()
    assert list(dict.fromkeys(p.stage for p in seen)) == ["loading", "extracting", "cleaning", "chapters", "finishing", "finished"] and seen[-1].completed == seen[-1].total
    for stage in ("extracting", "cleaning", "chapters", "finishing"):
        counts = [p.pages for p in seen if p.stage == stage]
        assert counts == sorted(set(counts)) and counts[-1] == 7  # pages only go up, and all are done
    assert len(spark.sparkContext.getJobTags()) == 0
    parts = out["chapters"].collect()
    assert [(r["title"], r["page_lo"], r["page_hi"]) for r in parts] == [("Chapter 1", 0, 6)]
    assert all(r["reading_minutes"] == max(1, len(r["plain_text"].split()) // 220) and r["n_words"] == len(r["plain_text"].split()) for r in parts)
    assert out["segments"].count() >= 1 and out["books"].first()["is_scanned"] is False
    items = spark.createDataFrame([(0, 3), (0, 99)], "book_id int, page_index int")
    assert {r["page_index"]: r["chapter_order"] for r in chapter_of_page(out["chapters"], items).collect()} == {3: 0, 99: None}


def test_without_layout(spark):
    pages = spark.createDataFrame([(0, 0, "One page."), (1, 0, "")], "book_id int, page_index int, native_text string")
    out = Engine(spark, EngineConfig(layout=LayoutConfig("never"))).run(pages, spark.createDataFrame([], SCHEMA))
    assert "layout" not in out and {r["book_id"]: r["title"] for r in out["chapters"].collect()} == {0: "Beginning", 1: "Full Text"}


def test_progress_and_errors(spark):
    assert Progress("loading", 9, 5).completed == 5 and Progress("loading", -1, -2).total == 0
    files = spark.createDataFrame([("a", None), ("b", "password_protected")], "book_id string, code string")
    assert [tuple(r) for r in parse_errors(files).collect()] == [("b", "password_protected", "the file is locked")]


def slowly(batches):
    for b in batches:
        time.sleep(20)
        yield b


def test_cancel_ends_only_the_run(spark):
    pages = spark.createDataFrame([(0, 0, "One page.")], "book_id int, page_index int, native_text string").mapInPandas(slowly, "book_id int, page_index int, native_text string")
    engine, raised = Engine(spark, EngineConfig(layout=LayoutConfig("never"))), []

    def run():
        try:
            engine.run(pages)
        except Cancelled as e:
            raised.append(e)

    other = []
    waiting = threading.Thread(target=lambda: other.append(spark.range(3).mapInPandas(lambda it: (time.sleep(6) or b for b in it), "id long").count()))
    work = threading.Thread(target=run)
    work.start()
    waiting.start()
    time.sleep(3)
    began = time.time()
    engine.cancel()
    work.join(15)
    waiting.join(30)
    assert raised and not work.is_alive() and time.time() - began < 15
    assert other == [3]  # another query of the session goes on
    with pytest.raises(Cancelled):
        engine.run(pages)


def test_native_lines_give_fragments_paragraphs_and_diagnostics(spark):
    said = ["First paragraph starts here.", "A continued line of prose.", "First paragraph ends here.", "Second paragraph starts here.", "Another continued line.", "Second paragraph ends here."]
    ys = [0.12 + 0.025 * i + (0.16 - 0.075 if i > 2 else 0) for i in range(6)]
    line = lambda page, i, t, x, y, w: (0, page, i, t, (x, y, w, 0.022), (x * 600, (1 - y) * 800, w * 600, 17.6), 600.0, 0, w * 600, 1)
    lines = [line(0, i, t, 0.12, y, 0.7) for i, (t, y) in enumerate(zip(said, ys, strict=True))]
    lines += [line(1, i, f"Left {i} ends.   Right {i} ends.", 0.1, 0.1 + 0.03 * i, 0.8)[:8] + (300.0, 1) for i in range(5)]
    glyphs_ = [(0, 1, i, 0, k, ch, (0.1 + 0.011 * k + (0.4 if k > 14 else 0), 0.1 + 0.03 * i, 0.009, 0.015), 10.0, False, False) for i in range(5) for k, ch in enumerate(f"Left {i} ends.   Right {i} ends.")]
    lines_ = spark.createDataFrame(lines, "book_id int, page_index int, line_id int, text string, rect struct<x:double,y:double,w:double,h:double>, box struct<x:double,y:double,w:double,h:double>, page_width double, rotation int, natural_width double, n_ranges int")
    marks = spark.createDataFrame(glyphs_, "book_id int, page_index int, line_id int, part int, at int, char string, rect struct<x:double,y:double,w:double,h:double>, font_size double, is_bold boolean, is_italic boolean")
    pages = spark.createDataFrame([(0, 0, "\n".join(said)), (0, 1, "\n".join(x[3] for x in lines[6:]))], "book_id int, page_index int, native_text string")
    out = Engine(spark, EngineConfig(cleanup=CleanupConfig.minimal(), diagnoses=True)).run(pages, lines=lines_, line_glyphs=marks)
    text = {r["page_index"]: r["text"] for r in out["pages"].collect()}
    assert text[0] == "\n".join(said[:3]) + "\n\n" + "\n".join(said[3:])
    assert text[1].split() == " ".join([f"Left {i} ends." for i in range(5)] + [f"Right {i} ends." for i in range(5)]).split()
    why = {r["page_index"]: (r["decision"], r["reason"]) for r in out["layout"].collect()}
    assert why[0] == ("fastPath", "the native lines are in order as they are") and why[1][0] == "accepted"
    shown = {r["page_index"]: r for r in out["diagnostics"].collect()}
    assert "edge 0->1 reason=columnSequence confidence=0.940" in shown[1]["description"] and '"decision" : "accepted"' in shown[1]["snapshot"]
    assert shown[0]["description"].splitlines()[:2] == ["page=0 decision=fastPath", "reason=the native lines are in order as they are"]
