"""The whole way from pages to speech, as one object with one configuration.

``Engine.run`` takes tables of many books and gives tables back, written to the shared folder. Stages are reported to
``progress`` when their tables are there, and pages while a stage's jobs run. Only a run's own jobs carry its tag, and
only they end when it is cancelled.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions.text import clean_page
from pagewright.operators import books, chapters, cleanup, diagnostics, glyphs, layout, policy, segments
from pagewright.operators.pagewise import PAGE
from pagewright.sources.staging import staged

STAGES = ("loading", "extracting", "cleaning", "chapters", "finishing", "finished")
#: What a file that can't be read is reported as.
ERRORS = {"file_not_found": "the file is not there", "invalid_file": "the file can't be read", "password_protected": "the file is locked"}


class Cancelled(Exception):
    """A run was cancelled."""


@dataclass(frozen=True)
class Progress:
    """A stage and how far it is; never more than the total. pages: those done in this stage, of all."""

    stage: str
    completed: int
    total: int
    pages: int = 0
    total_pages: int = 0

    def __post_init__(self) -> None:
        if self.stage not in STAGES:
            raise ValueError(f"unknown stage {self.stage!r}")
        for part, whole in (("completed", "total"), ("pages", "total_pages")):
            object.__setattr__(self, whole, max(0, getattr(self, whole)))
            object.__setattr__(self, part, min(max(0, getattr(self, part)), getattr(self, whole)))


def parse_errors(files: DataFrame) -> DataFrame:
    """book_id, code, message of the files (with ``code``, null where all is well) that a decoder couldn't read."""
    names = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    return files.where(F.col("code").isNotNull()).select("book_id", "code", F.coalesce(names[F.col("code")], F.lit("unknown error")).alias("message"))


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)
    progress: Callable[[Progress], None] = lambda p: None
    tag: str = field(default_factory=lambda: f"pagewright-{uuid.uuid4().hex}")
    #: Seconds between two looks at the jobs of a stage.
    every: float = 0.5

    def __post_init__(self) -> None:
        self._stop = threading.Event()
        self._told = threading.Lock()
        self._now: Progress | None = None

    def _tell(self, stage: str, pages: int, total_pages: int) -> None:
        """Reports a stage, or more pages of the one that runs; never fewer than before."""
        with self._told:
            now = Progress(stage, STAGES.index(stage), len(STAGES) - 1, pages, total_pages)
            if self._now is None or stage != self._now.stage or pages > self._now.pages:
                self._now = now
                self.progress(now)

    def _tasks_done(self, before: set[int]) -> float:
        """The share of tasks that are done in this run's jobs, but for those ``before``."""
        jobs, tracker = self.spark.sparkContext._jsc.sc().statusTracker(), self.spark.sparkContext.statusTracker()
        done = known = 0
        for job in set(jobs.getJobIdsForTag(self.tag)) - before:
            for k in (tracker.getJobInfo(job) or (0, (), ""))[1]:
                if stage := tracker.getStageInfo(k):
                    done, known = done + stage.numCompletedTasks, known + stage.numTasks
        return done / known if known else 0.0

    @contextmanager
    def _stage(self, stage: str, total_pages: int = 0) -> Iterator[None]:
        """Work of a stage: its jobs carry the tag, and its pages are reported while they run, by the share of tasks done."""
        if self._stop.is_set():
            raise Cancelled(self.tag)
        sc, over = self.spark.sparkContext, threading.Event()
        self._tell(stage, 0, total_pages)
        before = set(sc._jsc.sc().statusTracker().getJobIdsForTag(self.tag))

        def look() -> None:
            while not over.wait(self.every):
                self._tell(stage, min(total_pages - 1, int(total_pages * self._tasks_done(before))), total_pages)

        watch = threading.Thread(target=look, daemon=True)
        watch.start()
        sc.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            if self._stop.is_set():
                raise Cancelled(self.tag) from e
            raise
        finally:
            sc.removeJobTag(self.tag)
            over.set()
            watch.join()
        self._tell(stage, total_pages, total_pages)

    def cancel(self) -> None:
        """Ends the jobs of a run, and no others; the run raises ``Cancelled``, if not at once then before its next stage."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, pages: DataFrame, fragments: DataFrame | None = None, outline: DataFrame | None = None, lines: DataFrame | None = None, line_glyphs: DataFrame | None = None) -> dict[str, DataFrame]:
        """pages, books, chapters and segments; layout where there are fragments, and diagnostics where they are asked for.

        ``pages``: book_id, page_index, native_text, and ocr_text and ocr_confidence where something was recognised.
        ``fragments`` as ``operators.layout.analyze`` takes them; ``outline`` as ``chapters.outline_starts``. ``lines`` and
        ``line_glyphs``, as ``operators.glyphs`` takes them, give the fragments of native pages where there are no
        ``fragments``; pages of lines in plain order need no layout, and native pages that aren't rebuilt get their paragraphs.
        """
        c = self.config
        with self._stage("loading"):
            for name, kind in (("ocr_text", "string"), ("ocr_confidence", "double")):
                if name not in pages.columns:
                    pages = pages.withColumn(name, F.lit(None).cast(kind))
            n = pages.count()
        out: dict[str, DataFrame] = {}
        with self._stage("extracting", n):
            chosen = policy.select_source(pages, c.ocr).select("book_id", "page_index", "native_text", "text", "extraction_source", "confidence")
            prints = plain = None
            native = chosen.where("extraction_source = 'native'").select(*PAGE)
            if lines is not None and c.layout.mode != "never":
                lines = staged(lines.join(native, PAGE, "left_semi"), "native_lines")
                plain = glyphs.natively_ordered(lines).where("is_plain")
                if fragments is None and line_glyphs is not None:
                    fragments = staged(glyphs.native_fragments(lines, line_glyphs.join(native, PAGE, "left_semi")), "native_fragments")
            if fragments is not None and c.layout.mode != "never":
                decisions, prints, found = layout.examine(chosen, fragments, c.layout, plain)
                chosen, out["layout"] = layout.with_layout(chosen, decisions), decisions
                prints = staged(prints, "fingerprints")
                if c.diagnoses:
                    out["diagnostics"] = staged(diagnostics.snapshots(decisions, found), "diagnostics")
            if lines is not None and c.layout.mode != "never":
                chosen = self._with_paragraphs(staged(chosen, "chosen"), lines, out.get("layout"))
            text = clean_page(F.col("text"), c.cleanup.dehyphenates)
            cleaned = staged(chosen.withColumn("text", text), "pages")
        with self._stage("cleaning", n):
            done = staged(cleanup.clean_books(cleaned, c.cleanup, prints), "cleaned")
            scanned = policy.scanned_books(done)
            if not c.keeps_native_text:
                done = done.withColumn("native_text", F.lit(""))
        with self._stage("chapters", n):
            parts = staged(chapters.build_chapters(done, outline), "chapters")
        with self._stage("finishing", n):
            whole = staged(books.statistics(done).join(scanned, "book_id"), "books")
            out |= {"pages": done, "chapters": chapter_statistics(parts), "books": whole, "segments": staged(segments.build_segments(done, parts, c.chunks), "segments")}
        self._tell("finished", n, n)
        return out

    def _with_paragraphs(self, chosen: DataFrame, lines: DataFrame, decisions: DataFrame | None) -> DataFrame:
        """``chosen`` with the paragraphs of native pages that the layout didn't rebuild."""
        asked = chosen.where("extraction_source = 'native'").select(*PAGE, "text")
        if decisions is not None:
            asked = asked.join(decisions.where("decision = 'accepted'"), PAGE, "left_anti")
        mended = glyphs.native_paragraphs(asked, lines).withColumnRenamed("text", "_mended")
        return chosen.join(mended, PAGE, "left").withColumn("text", F.coalesce("_mended", "text")).drop("_mended")


def chapter_statistics(parts: DataFrame) -> DataFrame:
    """``parts`` with n_words and reading_minutes (220 words a minute, 1 at least)."""
    n = books.word_count(F.col("plain_text")).cast("long")
    return parts.withColumns({"n_words": n, "reading_minutes": F.greatest(F.lit(1), F.floor(n / 220)).cast("long")})


def chapter_of_page(parts: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (book_id, page_index) with the chapter_order of the chapter that has the page; null without one."""
    starts = parts.select("book_id", F.col("page_lo").alias("page_index"), "chapter_order", "page_hi")
    found = chapters.with_start(items.select("book_id", "page_index").distinct(), starts, "chapter_order", "page_hi").where("page_index <= page_hi")
    return items.join(found.select("book_id", "page_index", "chapter_order"), ["book_id", "page_index"], "left")
