"""Pages as a stream: page-local work is stateless; what needs a whole book waits until its pages are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.functions.text import clean_page


def clean_stream(pages: DataFrame, text_col: str = "native_text", dehyphenates: bool = True) -> DataFrame:
    """A stream of pages with one more column, text: the cleaned text. Works on tables too."""
    return pages.withColumn("text", clean_page(F.col(text_col), dehyphenates))


def completed_books(pages: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """From a stream of pages (book_id, page_index, page_count): book_id, n_pages and is_complete, once a book.

    A book comes out with the page that completes it, or, incomplete, when no page of it has come for ``wait_ms`` of
    processing time; its state goes then. Repeated pages count once; null page numbers don't count; a page that comes
    after its book has been given out opens the book anew. The state has the page numbers of a book, not their texts:
    join the result with the stored pages. A run that is to end (availableNow) needs
    spark.sql.streaming.noDataMicroBatches.enabled = false; else it waits for time-outs without end.
    """
    kind = pages.schema["book_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, count = state.get if state.exists else ([], 0)
        seen = set(seen)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"book_id": [key[0]], "n_pages": [len(seen)], "is_complete": [False]})
            return
        for pdf in batches:
            seen.update(int(x) for x in pdf["page_index"].dropna())
            count = max(count, int(pdf["page_count"].max()) if pdf["page_count"].notna().any() else 0)
        if count and len(seen) >= count:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"book_id": [key[0]], "n_pages": [len(seen)], "is_complete": [True]})
        else:
            state.update((sorted(seen), count))
            state.setTimeoutDuration(wait_ms)

    rows = pages.select("book_id", "page_index", "page_count")
    return rows.groupBy("book_id").applyInPandasWithState(run, f"book_id {kind}, n_pages long, is_complete boolean", "seen array<int>, page_count int", "append", GroupStateTimeout.ProcessingTimeTimeout)
