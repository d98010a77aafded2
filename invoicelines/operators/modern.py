"""Records of the modern layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, first_match, groups, infer_subcategory, parse_dotted_period, review_reason, strip
from ..patterns import COMMERCIAL, NOISE, RECEIPT, RESIDENTIAL, RESIDENTIAL_CODES, ROW1, ROW2, ROW3, ROW3_BARE, STORE, TARIFF, WRAP_CODE
from .blocks import document_blocks, gather_lines, kept_lines, wraps
from .records import dedup_first, duplicates
from .text import noise

KEY = ("supply_no", "account_no", "issue_date", "period")


def extract_row1(blocks: DataFrame, mode: str = "reference") -> DataFrame:
    """Adds supply_no, account_no, issue_date, period, name_address, city, date_from, date_to.

    mode: 'reference' reads the normalised line, where name and address are one
    word each and the city is the rest; 'columns' reads the raw line, where two
    blanks separate columns and names of several words survive.
    """
    line = F.col("line1") if mode == "reference" else strip(F.col("raw1"))
    out = blocks.withColumn("_row1", groups(line, "^" + ROW1, 7))
    # A raw line may lack the columns that its normalised form has.
    group = [F.when(F.col("line1").isNotNull(), F.coalesce(F.get("_row1", F.lit(k)), F.lit(""))) for k in range(7)]
    out = out.withColumns({"supply_no": group[0], "account_no": group[1], "issue_date": group[2], "period": group[3], "name_address": F.when(F.col("line1").isNotNull(), strip(F.concat_ws(" ", strip(group[4]), strip(group[5])))), "city": strip(group[6])})
    start, end = parse_dotted_period(F.col("period"))
    return out.withColumns({"date_from": start, "date_to": end}).drop("_row1")


def classify_category(blocks: DataFrame) -> DataFrame:
    """Adds category, raw_code, raw_label from the second row, or from a wrapped category inside the block."""
    out = blocks.withColumn("_row2", groups(F.col("line2"), ROW2, 2))
    out = out.withColumns({"raw_code": F.get("_row2", F.lit(0)), "raw_label": F.get("_row2", F.lit(1))}).drop("_row2")
    residential = F.col("raw_code").isin(*RESIDENTIAL_CODES) | (~(F.col("raw_code").startswith("Γ") & (F.col("raw_label") == COMMERCIAL)) & (F.col("raw_label") == TARIFF))
    wrapped = F.col("raw_code").isNull() & wraps(F.col("line2"), F.col("line3"))
    return out.withColumns({
        "category": F.when(F.col("raw_code").isNotNull(), F.when(residential, RESIDENTIAL).otherwise(COMMERCIAL)).when(wrapped, COMMERCIAL),
        "raw_code": F.when(wrapped, WRAP_CODE).otherwise(F.col("raw_code")),
        "raw_label": F.when(wrapped, COMMERCIAL).otherwise(F.col("raw_label")),
    })


def extract_readings(blocks: DataFrame) -> DataFrame:
    """Adds last_reading, prev_reading, multiplier, reading_diff, and is_final: the third row could be read."""
    names = ("last_reading", "prev_reading", "multiplier", "reading_diff")
    out = blocks.withColumn("_row3", F.coalesce(groups(F.col("line3"), ROW3, 4), groups(F.col("line3"), ROW3_BARE, 4)))
    out = out.withColumns({n: F.get("_row3", F.lit(k)).try_cast("bigint") for k, n in enumerate(names)})
    return out.withColumn("is_final", F.when(F.col("line1").isNotNull(), F.col("_row3").isNotNull())).drop("_row3")


def extract_context(df: DataFrame, *text: str) -> DataFrame:
    """Adds store and receipt_no, searched in the columns joined by blanks."""
    joined = F.concat_ws(" ", *text)
    return df.withColumns({"store": first_match(joined, [STORE]), "receipt_no": first_match(joined, [RECEIPT])})


def score_records(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Adds confidence, needs_review and reason."""
    fields = {"supply_no": F.col("supply_no"), "issue_date": F.col("issue_date"), "category": F.col("category")}
    out = df.withColumn("confidence", confidence(*fields.values()))
    return out.withColumns({"needs_review": F.col("confidence") < threshold, "reason": review_reason(F.col("confidence"), threshold, **fields)})


COLUMNS = (
    "doc_id", "block_no", "supply_no", "account_no", "issue_date", "period", "name_address", "city", "last_reading", "prev_reading", "multiplier", "reading_diff", "category", "subcategory",
    "is_final", "store", "receipt_no", "date_from", "date_to", "needs_review", "reason", "confidence", "raw_code", "raw_label", "layout",
)


def parse_blocks(blocks: DataFrame, mode: str = "reference", threshold: float = 0.90, keep: tuple[str, ...] = ()) -> DataFrame:
    """A record per block, duplicates included, and the columns `keep`."""
    out = extract_context(extract_readings(classify_category(extract_row1(blocks, mode))), "line1", "line2", "line3")
    out = out.withColumn("subcategory", infer_subcategory(F.col("category"), F.col("multiplier"), F.concat_ws(" ", "line1", "line2", "line3")))
    return score_records(out.withColumn("layout", F.lit("modern")), threshold).select(*COLUMNS, *keep)


def modern_records(docs: DataFrame, text: str = "text", profile: str = "modern", mode: str = "reference", first_only: bool = False, threshold: float = 0.90) -> DataFrame:
    """A record per block of the documents (doc_id, text), duplicates included. Nothing is shuffled."""
    kept = docs.select("doc_id", kept_lines(F.col(text), NOISE[profile]).alias("lines"))
    return parse_blocks(document_blocks(kept, first_only=first_only), mode, threshold)


def extract_modern(docs: DataFrame, profile: str = "modern", mode: str = "reference", first_only: bool = False, threshold: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """Records and rejects (duplicates on KEY but the first) of documents (doc_id, text) or of lines (doc_id, line_no, line). Of documents, only the records' keys are shuffled."""
    if "line" in docs.columns:
        kept = gather_lines(docs.where(~noise(F.col("line"), NOISE[profile])))
        records = parse_blocks(document_blocks(kept, first_only=first_only), mode, threshold)
    else:
        records = modern_records(docs, "text", profile, mode, first_only, threshold)
    order = ["doc_id", "block_no"]
    rejects = duplicates(records, list(KEY), order).select(*order, *KEY, F.lit("duplicate").alias("reject_reason"), "layout")
    return dedup_first(records, list(KEY), order), rejects
