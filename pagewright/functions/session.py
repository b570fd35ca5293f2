"""Functions for SQL: ``register(spark)`` makes them known to a session, for ``spark.sql`` and views.

    pw_chunks(text, max_characters, preferred_minimum)   table function: a row (chunk_index, chunk) for each speech chunk
    pw_sentences(text)                                   array of sentences
    pw_signature(line)                                   what lines have in common that differ in case, accents and blanks
    pw_stable_id(prefix, components)                     identifier of an array of components; the same input, the same id

Scalar functions take columns a batch at a time; the table function goes well with LATERAL.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.config import ChunkConfig
from pagewright.functions.chunks import chunk_text, sentences
from pagewright.functions.ids import fnv1a


class _Chunks:
    def eval(self, text: str, max_characters: int, preferred_minimum: int) -> Iterator[tuple[int, str]]:
        config = ChunkConfig(2800 if max_characters is None else max_characters, 700 if preferred_minimum is None else preferred_minimum)
        yield from enumerate(chunk_text(text, config))


def _sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sentences(t or ""))


def _signature(lines: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = re.sub(r"[ \t]+", " ", re.sub(r"\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\Z", "", s)).lower()
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

    return lines.map(one)


def _stable_id(prefix: pd.Series, components: pd.Series) -> pd.Series:
    def coded(parts: list) -> bytes:
        texts = [("" if x is None else x).encode() for x in ([] if parts is None else parts)]
        return b"".join(b"%d:%s\xff" % (len(t), t) for t in texts)

    return prefix.str.cat(fnv1a(components.map(coded)), sep="-")


def register(spark: SparkSession) -> list[str]:
    """The names that were made known."""
    spark.udtf.register("pw_chunks", F.udtf(_Chunks, returnType="chunk_index int, chunk string"))
    scalars = {
        "pw_sentences": F.pandas_udf(_sentences, "array<string>"),
        "pw_signature": F.pandas_udf(_signature, "string"),
        "pw_stable_id": F.pandas_udf(_stable_id, "string"),
    }
    for name, f in scalars.items():
        spark.udf.register(name, f)
    return ["pw_chunks", *scalars]
