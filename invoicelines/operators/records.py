"""Record tables: filters, duplicates, unions, splits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_truthy
from ..patterns import COMMERCIAL, RESIDENTIAL, RESIDENTIAL_CODES, TAX_ID, WRAP_CODE, of_upper

INTERNAL = ("store", "receipt_no", "needs_review", "reason", "confidence", "date_from", "date_to", "layout")


def filter_truthy(df: DataFrame, col: str = "is_final") -> DataFrame:
    """Rows whose flag is true; all rows if there is no such column."""
    return df.where(is_truthy(F.col(col))) if col in df.columns else df


def _new_name(df: DataFrame, name: str) -> str:
    """A name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def dedup_first(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """The first row of each key in the given order; nulls are equal. Limited before the shuffle, so a frequent key is not skewed."""
    place = _new_name(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col(place) == 1).drop(place)


def flag_repeated(df: DataFrame, keys: list[str], order_by: list, name: str = "repeated", when: Column | None = None, spread: int = 64) -> DataFrame:
    """Adds `name`: whether the row is not the first of its key in the given order; nulls are equal. Rows where `when` is not true are never repeated.

    A frequent key's rows are first placed in `spread` groups of their order;
    only each group's first row goes on to the key's own place, the others, which
    are repeated already, stay spread. So no key is one task, and rows are parsed once.
    """
    salt, local = _new_name(df, "salt"), _new_name(df, "local")
    counted = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if spread <= 1 and when is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)
    rows = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(spread)))
    if when is not None:  # rows that don't count lie anywhere
        rows = rows.withColumn(salt, F.when(counted, F.col(salt)).otherwise(spread + F.pmod(F.xxhash64(*order), F.lit(1 << 40))))
    rows = rows.withColumn(local, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)))
    rows = rows.withColumn(salt, F.when(counted & (F.col(local) == 1), F.lit(-1).cast("bigint")).otherwise(F.col(salt)))
    place = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(local, *order))
    return rows.withColumn(name, counted & ((F.col(local) > 1) | (place > 1))).drop(salt, local)


def duplicates(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """What dedup_first() leaves out. A frequent key is split over tasks."""
    name = _new_name(df, "repeated")
    return flag_repeated(df, keys, order_by, name).where(F.col(name)).drop(name)


def dedup_records(df: DataFrame, keys: tuple[str, ...] = ("supply_no", "account_no", "issue_date"), order_by: list | None = None) -> DataFrame:
    """First of each key if all key columns are there, else distinct rows."""
    if not set(keys) <= set(df.columns):
        return df.dropDuplicates()
    others = order_by or [c for c in df.columns if c not in keys]
    return dedup_first(df, list(keys), others) if others else df.dropDuplicates(list(keys))


def drop_column_ci(df: DataFrame, name: str = TAX_ID) -> DataFrame:
    """Without the first column of that name, white space around it and case ignored."""
    for i, c in enumerate(df.columns):
        if c.strip().lower() == name.lower():
            return df.select(*[F.col(f"`{x}`") for j, x in enumerate(df.columns) if j != i])
    return df


def union_layouts(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def sort_by_id(df: DataFrame, col: str = "supply_no") -> DataFrame:
    """Sorted by the id as text, nulls last, by a range shuffle."""
    return df.orderBy(F.col(col).cast("string").asc_nulls_last())


def split_by_category(df: DataFrame, col: str = "category") -> dict[str, DataFrame]:
    """all, residential, commercial; the latter two are empty if there is no such column."""
    if col not in df.columns:
        return {"all": df, "residential": df.limit(0), "commercial": df.limit(0)}
    return {"all": df, "residential": df.where(F.col(col) == RESIDENTIAL), "commercial": df.where(F.col(col) == COMMERCIAL)}


def public_columns(df: DataFrame, internal: tuple[str, ...] = INTERNAL) -> DataFrame:
    """Without the internal columns that are there."""
    return df.drop(*internal)


def count_by(df: DataFrame, col: str = "layout") -> DataFrame:
    """col, n: rows of each value, most first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def summary_of(kept: Column, repeated: Column) -> list[Column]:
    """The counts of run_summary(), by whether a row is a record (kept) or a duplicate; also for observing rows while they are written."""
    count = lambda c: F.count_if(kept & c)
    return [
        F.count_if(kept).alias("n_records"), F.count_if(repeated).alias("n_duplicates"), count(F.col("needs_review")).alias("n_review"),
        count(F.col("category") == RESIDENTIAL).alias("n_residential"), count(F.col("category") == COMMERCIAL).alias("n_commercial"),
        count(F.col("raw_code").isin(*RESIDENTIAL_CODES[1:])).alias("n_code_variants"), count(F.col("raw_code") == WRAP_CODE).alias("n_wraps"),
        count(F.col("store").isNotNull()).alias("n_store"), count(F.col("receipt_no").isNotNull()).alias("n_receipt"),
    ]


def run_summary(records: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row of counts of a run."""
    kept = _new_name(records, "kept")
    both = records.withColumn(kept, F.lit(True)).unionByName(rejects.select(F.lit(False).alias(kept)), allowMissingColumns=True)
    return both.agg(*summary_of(F.col(kept), ~F.col(kept)))


def quality_profile(df: DataFrame, required: tuple[str, ...] = ("supply_no", "issue_date", "category")) -> DataFrame:
    """One row: rows, ids and repeated ids, rows with all of the required columns, shares of flags and categories."""
    missing = [c for c in required if c not in df.columns]
    full = F.lit(not missing)
    for c in required:
        if c in df.columns:
            full = full & F.col(c).isNotNull()
    per_id = df.groupBy("supply_no").agg(F.count("*").alias("n"), F.count_if(full).alias("full"), F.count_if("is_final").alias("final"), F.count_if(F.col("category") == RESIDENTIAL).alias("res"), F.count_if(F.col("category") == COMMERCIAL).alias("com"))
    return per_id.agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("supply_no").isNotNull(), F.col("n")).otherwise(0)).alias("n_with_id"), F.count("supply_no").alias("n_ids"),
        F.count_if(F.col("supply_no").isNotNull() & (F.col("n") > 1)).alias("n_repeated_ids"), F.sum("full").alias("n_full"), F.sum("final").alias("n_final"), F.sum("res").alias("n_residential"), F.sum("com").alias("n_commercial"),
    )


def audit_records(df: DataFrame, keys: tuple[str, ...], noise: tuple[str, ...], text: tuple[str, ...] = ("name_address", "city")) -> DataFrame:
    """One row of checks: keys that still repeat, rows without consumption and how many of them are final, noise left in texts, filled fields, subcategories, full confidence."""
    dirty = F.lit(False)
    for c in text:
        dirty = dirty | F.coalesce(F.upper(c).rlike(of_upper(noise)), F.lit(False))
    still = F.col("last_reading") == F.col("prev_reading")
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(still).alias("zero"), F.count_if(still & F.col("is_final")).alias("zero_final"), F.count_if(dirty).alias("dirty"),
        F.count("date_from").alias("dated"), F.count("subcategory").alias("sub"), F.count_if(F.col("confidence") >= 1.0).alias("sure"),
    )
    return per_key.agg(F.count_if(F.col("n") > 1).alias("n_repeated_keys"), *[F.sum(a).alias(b) for a, b in (("n", "n_rows"), ("zero", "n_zero"), ("zero_final", "n_zero_final"), ("dirty", "n_noisy"), ("dated", "n_dated"), ("sub", "n_subcategory"), ("sure", "n_sure"))])


def expect(df: DataFrame, required: tuple[str, ...] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """expectation, failures: a row for 'not empty', each required column and each rule (a boolean Column; null fails). One aggregate."""
    rules = rules or {}
    counts = [F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint").alias("not empty")]
    counts += [F.lit(0 if c in df.columns else 1).cast("bigint").alias(f"has {c}") for c in required]
    counts += [F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()]
    row = df.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("expectation"), F.col(f"`{c}`").alias("failures")) for c in row.columns])).alias("e")).select("e.*")
