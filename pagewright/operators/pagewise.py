"""Small folds whose every step depends on the one before, run page by page inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE = ["book_id", "page_index"]


def values(a: pa.Array) -> list:
    """An array's values as Python has them; structs are dicts. Plain numbers aren't taken one by one."""
    if pa.types.is_struct(a.type) and not a.null_count:
        names = [f.name for f in a.type]
        return [dict(zip(names, r, strict=True)) for r in zip(*map(values, a.flatten()), strict=True)]
    if (pa.types.is_integer(a.type) or pa.types.is_floating(a.type) or pa.types.is_boolean(a.type)) and not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def fold_pages(rows: DataFrame, order: list[str], result: str, fold: Callable[[list[dict]], list], needs: list[str]) -> DataFrame:
    """``rows`` with a column ``result`` (name and type): what ``fold`` gives for the rows of each page, in ``order``.

    One shuffle deals and sorts the rows by page; tasks stream over them and hold a page's columns ``needs`` at a time.
    The other columns stay in their batches, which wait until the pages that they hold are done.
    """
    name, kind = result.split(" ", 1)
    plain = rows.select(*PAGE, *[c for c in rows.columns if c not in PAGE])
    dealt = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", " + result
    field = pa.field(name, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list = []
        key, page = None, []

        def whole(b: pa.RecordBatch) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(done[: b.num_rows], field.type)], schema=b.schema.append(field))
            del done[: b.num_rows]
            return out

        for b in batches:
            held.append(b)
            keys = zip(*(values(b.column(k)) for k in PAGE), strict=True)
            for k, r in zip(keys, zip(*(values(b.column(c)) for c in needs), strict=True), strict=True):
                if k != key:
                    done += fold(page) if page else []
                    key, page = k, []
                page.append(dict(zip(needs, r, strict=True)))
            while held and held[0].num_rows <= len(done):
                yield whole(held.pop(0))
        done += fold(page) if page else []
        yield from map(whole, held)

    return dealt.select(*plain.columns).mapInArrow(run, schema)
