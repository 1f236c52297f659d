"""Chunking: fixed windows and recursive splitting by separators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.session import prepare

SIZE, OVERLAP = 800, 150
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", "。", " ")


def windows(text: Column, width: int = 4500) -> Column:
    """Consecutive windows of *width* characters; none of an empty text."""
    count = F.ceil(F.length(text) / F.lit(width)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def translated(text: Column, translate: Callable[[Column], Column], width: int = 4500) -> Column:
    """A text translated window by window and joined again by line ends; a window whose translation fails (null) is empty. Null texts
    stay null, empty ones empty."""
    parts = F.transform(windows(text, width), lambda w: F.coalesce(translate(w), F.lit("")))
    return F.when(text.isNotNull(), F.array_join(parts, "\n"))


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most *size* characters where a separator allows, joined with overlap by whole pieces.

    The first separator that occurs cuts the text, staying at the start of the piece after it; pieces that are too
    long are cut by the separators after it. A piece without any separator stays whole, however long.
    """
    index = next((i for i, s in enumerate(separators) if s in text), None)
    if index is None:
        return [text.strip()] if text.strip() else []
    mark, rest = separators[index], separators[index + 1 :]
    first, *others = text.split(mark)
    pieces = [p for p in [first, *(mark + o for o in others)] if p]
    made: list[str] = []
    held: list[str] = []

    def close() -> None:
        if joined := "".join(held).strip():
            made.append(joined)

    for piece in pieces:
        if len(piece) >= size:
            close()
            held = []
            made += split_recursively(piece, size, overlap, rest) if rest else [p for p in [piece.strip()] if p]
            continue
        if held and sum(map(len, held)) + len(piece) > size:
            close()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    close()
    return made


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(doc_id, chunk_id, chunk): texts shorter than *size* pass unchanged and never leave the JVM."""

    prepare(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap, separators))

    held = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    short = held.where(F.length("text") < size).select("doc_id", F.lit(0).alias("chunk_id"), F.col("text").alias("chunk"))
    long = held.where(F.length("text") >= size).select("doc_id", F.posexplode(cut("text")).alias("chunk_id", "chunk"))
    return short.unionByName(long)
