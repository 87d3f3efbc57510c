"""Greedy paragraph packing. One pass inside the row: no shuffle, no grouping, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions.text import strip, word_count


def pack_paragraphs(text: Column, max_words: int = 200, sep: str = "\n\n") -> Column:
    """array<struct<text, n_words>> of chunks.

    Paragraphs are added to the open chunk, joined by one space, until the next one would push it over `max_words`;
    a longer paragraph stays whole. Text without any paragraph gives the single chunk ''.
    Word counts are additive over the joining space, so the fold carries a count and only copies the output array
    when a chunk closes.
    """
    stripped = F.filter(F.transform(F.split(text, sep), strip), lambda p: p != "")
    paragraphs = F.transform(stripped, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))
    start = F.struct(
        F.lit("").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<struct<text:string,n_words:int>>").alias("out")
    )
    closed = lambda a: F.array_append(a["out"], F.struct(a["cur"].alias("text"), a["n"].alias("n_words")))

    def add(a: Column, x: Column) -> Column:
        full = (a["n"] + x["n"]) > max_words
        opened = a["n"] > 0
        return F.struct(
            F.when(full | ~opened, x["p"]).otherwise(F.concat(a["cur"], F.lit(" "), x["p"])).alias("cur"),
            F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
            F.when(full & opened, closed(a)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(paragraphs, start, add, closed)


def chunk_documents(
    docs: DataFrame, id_col: str, text_col: str, max_words: int = 200, sep: str = "\n\n", keep: list[str] | None = None
) -> DataFrame:
    """One row per chunk: id, kept columns, chunk_index from 0, n_words, text."""
    packed = pack_paragraphs(F.coalesce(F.col(text_col), F.lit("")), max_words, sep)
    cut = docs.select(id_col, *(keep or []), F.posexplode(packed).alias("chunk_index", "c"))
    return cut.select(id_col, *(keep or []), "chunk_index", F.col("c.n_words"), F.col("c.text"))


def chunk_counts(
    docs: DataFrame, id_col: str, text_col: str, max_words: int = 200, sep: str = "\n\n", keep: list[str] | None = None
) -> DataFrame:
    """Chunks per document, counted inside the row."""
    packed = pack_paragraphs(F.coalesce(F.col(text_col), F.lit("")), max_words, sep)
    return docs.select(id_col, *(keep or []), F.size(packed).alias("chunks"))
