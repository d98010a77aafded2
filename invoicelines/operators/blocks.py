"""Blocks of three lines in the modern layout.

A document is one row with the array of its lines, noise dropped. A block starts where
a line is a first row, the next one a second row or a wrapped category, and one more
follows. Starts can only collide two lines apart, so in a run of such starts the
first, third, ... are blocks, which is what a greedy search finds. All of it is array
functions on the document's own row: no line is shuffled, and only blocks become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_line
from ..patterns import COMMERCIAL, NOISE, ROW1, ROW2, WRAP, u
from .text import noise


def wraps(line: Column, after: Column, second: Column | None = None) -> Column:
    """A category code whose label is on this line or one of the next two; at least one line must follow."""
    label = line.contains(COMMERCIAL) | after.contains(COMMERCIAL)
    if second is not None:
        label = label | F.coalesce(second.contains(COMMERCIAL), F.lit(False))
    return F.coalesce(after.isNotNull() & line.rlike(u(WRAP)) & label, F.lit(False))


def wrap_category(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Adds wraps to every line."""
    order = Window.partitionBy(doc).orderBy(line_no)
    rows = lines.withColumn("_n", normalize_line(F.col(line)))
    rows = rows.withColumns({"_n1": F.lead("_n", 1).over(order), "_n2": F.lead("_n", 2).over(order)})
    return rows.withColumn("wraps", wraps(F.col("_n"), F.col("_n1"), F.col("_n2"))).drop("_n", "_n1", "_n2")


def kept_lines(text: Column, patterns: tuple[str, ...] = NOISE["modern"]) -> Column:
    """The lines of a text that are no noise, as an array; null for a null text."""
    return F.filter(F.split(text, "\n", -1), lambda x: ~noise(x, patterns))


def _up_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def starts(lines: Column, row1: str = ROW1, row2: str = ROW2) -> Column:
    """Where in an array of normalised lines a block could start, ascending."""
    at = lambda i: F.get(lines, i)
    return F.filter(_up_to(F.size(lines) - 2), lambda i: at(i).rlike(u("^" + row1)) & (at(i + 1).rlike(u(row2)) | wraps(at(i + 1), at(i + 2), at(i + 3))))


def greedy(places: Column) -> Column:
    """Of ascending places, two apart or more, those that a search takes which goes on three places after each."""
    at = lambda i: F.get(places, i)
    # Where a run of places two apart begins, and where the next one does.
    first = F.filter(_up_to(F.size(places)), lambda k: F.coalesce(at(k) - at(k - 1) != 2, F.lit(True)))
    runs = F.transform(F.array(first), lambda f: F.transform(f, lambda b, j: F.struct(b.alias("from"), F.coalesce(F.get(f, j + 1), F.size(places)).alias("to"))))
    return F.flatten(F.transform(F.flatten(runs), lambda r: F.transform(F.sequence(r["from"], r["to"] - 1, F.lit(2)), lambda k: at(k))))


def document_blocks(docs: DataFrame, doc: str = "doc_id", lines: str = "lines", row1: str = ROW1, row2: str = ROW2, first_only: bool = False, outer: bool = False) -> DataFrame:
    """The document's other columns, block_no, pos, line1, line2, line3 (normalised) and raw1 (the first line as it was), a row per block.

    docs: a row per document, `lines` its lines without noise. first_only: one
    block per document; outer: documents without a block give one row with nulls.
    """
    others = [c for c in docs.columns if c not in (doc, lines)]
    rows = docs.select(doc, *others, F.col(lines).alias("raw"), F.transform(lines, normalize_line).alias("norm"))
    rows = rows.select("*", starts(F.col("norm"), row1, row2).alias("starts"))
    taken = greedy(F.col("starts"))
    rows = rows.select("*", (F.slice(taken, 1, 1) if first_only else taken).alias("taken"))
    line = lambda i, name: F.get("norm", i).alias(name)
    block = F.transform("taken", lambda i, k: F.struct((k + 1).alias("block_no"), i.alias("pos"), line(i, "line1"), line(i + 1, "line2"), line(i + 2, "line3"), F.get("raw", i).alias("raw1")))
    return rows.select(doc, *others, (F.inline_outer if outer else F.inline)(block))


def gather_lines(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """doc, lines: a row per document from a row per line, in the order of line_no."""
    docs = lines.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("at"), F.col(line).alias("line")))).alias("rows"))
    return docs.select(doc, F.transform("rows", lambda r: r["line"]).alias("lines"))


def assemble_blocks(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line", row1: str = ROW1, row2: str = ROW2) -> DataFrame:
    """Blocks of lines that come as rows, noise dropped; see document_blocks()."""
    return document_blocks(gather_lines(lines, doc, line_no, line), doc, "lines", row1, row2)


def first_block(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One block per document, the first. (document_blocks() can do so without a shuffle.)"""
    return blocks.where(F.col("block_no") == 1)
