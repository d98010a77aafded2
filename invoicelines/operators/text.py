"""Lines and pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strip
from ..patterns import NOISE, of_upper


def explode_lines(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The columns `keys` (default all but the text), line_no (from 0) and line; empty lines stay, null texts have none."""
    keys = keys if keys is not None else [c for c in df.columns if c != text]
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def noise(line: Column, patterns: tuple[str, ...] = NOISE["modern"]) -> Column:
    """Whether a line, upper-cased, holds any of the patterns."""
    return F.upper(line).rlike(of_upper(patterns))


def drop_noise_lines(df: DataFrame, line: str = "line", patterns: tuple[str, ...] = NOISE["modern"]) -> DataFrame:
    """Without header, footer and total lines."""
    return df.where(~noise(F.col(line), patterns))


def flag_low_text(df: DataFrame, text: str = "text", min_chars: int = 50) -> DataFrame:
    """Adds low_text: the stripped text has at most `min_chars` characters, so the page needs reading from its image."""
    return df.withColumn("low_text", F.coalesce(F.length(strip(F.col(text))), F.lit(0)) <= min_chars)


def assemble_pages(df: DataFrame, doc: str = "doc_id", page_no: str = "page_no", text: str = "text", separator: str = "\n") -> DataFrame:
    """One text per document, pages in order; pages that are empty are skipped."""
    page = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(F.col(page_no).alias("n"), F.col(text).alias("t")))
    pages = df.groupBy(doc).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return pages.select(doc, F.array_join(F.transform("pages", lambda p: p["t"]), separator).alias("text"))
