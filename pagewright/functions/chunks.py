"""Cutting one text into pieces that a speaker can take: sentences, packed up to a number of graphemes."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.config import ChunkConfig

# ---- fixed values
CLAUSE_ENDS = frozenset(",;:—–，；：")
CJK_ENDS = frozenset("。！？")
ABBREVIATIONS = frozenset("Dr Mr Mrs Ms Prof Sr Jr St vs etc e.g i.e No Fig Vol pp Inc Ltd Co".split())
# ----
_CJK = regex.compile(r"[⺀-鿿぀-ヿ가-힯]")
_END = regex.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[」』”’）]*")
_WORD_BEFORE = regex.compile(r"[\p{L}.]+$")


#: Characters that may form one grapheme with what stands before or after them.
_FUSES = regex.compile(r"[\p{M}\p{Cf}\u1100-\u11FF\U0001F1E6-\U0001F1FF]")


def _size(s: str) -> int:
    return len(s) if s.isascii() and "\r" not in s else sum(1 for _ in regex.finditer(r"\X", s))


def _size_with(left: str, n_left: int, more: str, n_more: int) -> int:
    """The graphemes of ``left`` and ``more`` put together, from those of each; only where they may fuse are they counted."""
    return _size(left + more) if _FUSES.match(left[-1]) or _FUSES.match(more[0]) else n_left + n_more


def sentences(text: str) -> list[str]:
    """Sentences of a text, trimmed. A full stop after an abbreviation or a single capital ends none."""
    out, start = [], 0
    for m in _END.finditer(text):
        before = _WORD_BEFORE.search(text, start, m.start()) if m[0] == "." else None
        if before and (before[0] in ABBREVIATIONS or (len(before[0]) == 1 and before[0].isupper())):
            continue
        if piece := text[start : m.end()].strip():
            out.append(piece)
        start = m.end()
    if rest := text[start:].strip():
        out.append(rest)
    return out or [text]


def _joint(left: str, right: str) -> str:
    return "" if left[-1].isspace() or right[0].isspace() or left[-1] in CJK_ENDS or _CJK.match(right) else " "


def _cut(text: str, config: ChunkConfig) -> list[str]:
    """A sentence that is too long: after the last clause mark past the preferred minimum, else at the last blank, else anywhere."""
    most, out = config.max_characters, []
    least = min(max(1, config.preferred_minimum), max(1, most - 1))
    marks = regex.findall(r"\X", text.strip())
    start = 0
    while len(marks) - start > most:
        at = next((i + 1 for i in range(start + most - 1, start + least - 1, -1) if marks[i] in CLAUSE_ENDS), 0)
        at = at or next((i for i in range(start + most - 1, start, -1) if marks[i].isspace()), 0) or start + most
        if head := "".join(marks[start:at]).strip():
            out.append(head)
        while at < len(marks) and marks[at].isspace():
            at += 1
        start = at
    return [*out, "".join(marks[start:])] if start < len(marks) else out


def chunk_text(text: str | None, config: ChunkConfig) -> list[str]:
    """Pieces of at most max_characters. With preserves_paragraphs each paragraph is cut on its own."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    paragraphs = [p for x in text.split("\n\n") if (p := x.strip())]
    if not config.preserves_paragraphs:
        paragraphs = [" ".join(paragraphs)] if paragraphs else []
    out: list[str] = []
    for paragraph in paragraphs:
        if _size(paragraph) <= config.max_characters:
            out.append(paragraph)
            continue
        now, size = "", 0
        for s in sentences(paragraph):
            n = _size(s)
            joint = _joint(now, s) if now else ""
            longer = _size_with(now, size, joint + s, len(joint) + n) if now else n
            if longer <= config.max_characters:
                now, size = now + joint + s, longer
                continue
            if now:
                out.append(now)
            now, size = s, n
            if n > config.max_characters:
                out += _cut(s, config)
                now, size = "", 0
        if now:
            out.append(now)
    return out


def chunks(text: Column, config: ChunkConfig | None = None) -> Column:
    """``chunk_text`` of a column: an array of strings."""
    config = config or ChunkConfig()

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: chunk_text(v, config))

    return run(text)
