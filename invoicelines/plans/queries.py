"""The registered queries of the invoice operators and their SQL.

Inputs are the given tables, or invoices rendered from them; the SQL never sees a
rendered text but computes what must come out of it from the tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import blocks, layout, modern, records, text, v2018
from ..patterns import NOISE
from ..sources import audit_files, output_path, read_documents, read_records, write_filtered, write_records, write_rejects, write_run, write_stats
from ..streaming import records_of_stream, rejects_of_stream, stream_extract, stream_format_counts
from .pipeline import extract, filter_final, judged
from .rendering import doubled, orders, render_modern, render_v2018

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a temporary one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def modern_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_modern(spark, sf_dir).select("doc_id", fn.collapse_doubled(F.col("text")).alias("text"))


def modern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_modern(spark, sf_dir)
    return text.explode_lines(docs.select("doc_id", fn.collapse_doubled(F.col("text")).alias("text")))


# What must come out of the renderings.
O = """SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_totalprice AS price, c_name, c_mktsegment AS seg, n_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
MODERN = f"""SELECT 'm' || c AS doc_id, k, CAST(1000000000 + c AS VARCHAR) AS supply_no, lpad(CAST(k AS VARCHAR), 9, '0') AS account_no, strftime(d, '%d/%m/%Y') AS issue_date,
strftime(d - INTERVAL 30 DAY, '%d.%m.%Y') || '-' || strftime(d, '%d.%m.%Y') AS period, c_name || ' ' || seg AS name_address, n_name AS city,
CASE WHEN k % 5 <> 4 AND k % 3 < 2 THEN k + 100 END AS last_reading, CASE WHEN k % 5 <> 4 AND k % 3 < 2 THEN k END AS prev_reading,
CASE WHEN k % 5 <> 4 AND k % 3 < 2 THEN 1 + k % 2 END AS multiplier, CASE WHEN k % 5 <> 4 AND k % 3 < 2 THEN CAST(100 AS BIGINT) END AS reading_diff,
CASE WHEN k % 5 IN (0, 1, 3) THEN 'ΦΟΠ' ELSE 'Επαγγελματικό' END AS category,
CASE WHEN k % 5 = 2 AND k % 3 < 2 THEN CASE WHEN k % 2 = 0 THEN 'Απλό επαγγελματικό' ELSE 'Βιομηχανικό' END END AS subcategory,
k % 5 <> 4 AND k % 3 < 2 AS is_final, CASE WHEN k % 5 <> 4 AND k % 3 = 2 AND k % 2 = 0 THEN seg END AS store, CASE WHEN k % 5 <> 4 AND k % 3 = 2 AND k % 2 = 1 THEN CAST(k AS VARCHAR) END AS receipt_no, CAST(d - INTERVAL 30 DAY AS DATE) AS date_from, CAST(d AS DATE) AS date_to,
FALSE AS needs_review, CAST(NULL AS VARCHAR) AS reason, CAST(1.0 AS DOUBLE) AS confidence,
CASE k % 5 WHEN 0 THEN 'ΦΟΠ' WHEN 1 THEN 'Φ.Ο.Π' WHEN 2 THEN 'Γ21' WHEN 3 THEN 'Γ22' ELSE 'Γ-wrap' END AS raw_code,
CASE WHEN k % 5 IN (0, 1, 3) THEN 'Τιμολόγιο' ELSE 'Επαγγελματικό' END AS raw_label, 'modern' AS layout
FROM ({O})"""
V2018 = f"""SELECT 'v' || k AS doc_id, k,
CASE k % 3 WHEN 0 THEN CAST(c + 100000000000 AS VARCHAR) WHEN 1 THEN '5' || CAST(c + 1000000000 AS VARCHAR) || '01' ELSE '55' || CAST(c + 10000000000 AS VARCHAR) || '02' END AS supply_no,
lpad(CAST(k AS VARCHAR), 6, '0') AS account_no, strftime(CASE WHEN k % 16 = 5 THEN d - INTERVAL 120 DAY ELSE d END, '%d/%m/%Y') AS issue_date, strftime(d - INTERVAL 120 DAY, '%d/%m/%Y') || ' - ' || strftime(d, '%d/%m/%Y') AS period,
'720 52 ' || CASE WHEN k % 16 = 9 THEN 'ΠΟΛΗ ΑΘΗΝΑ' ELSE seg END AS city, k % 2 = 0 AS is_final, CASE WHEN k % 5 < 3 THEN 'ΦΟΠ' ELSE 'Επαγγελματικό' END AS category, lpad(CAST(k + 3 AS VARCHAR), 9, '0') AS receipt_no,
CAST(k % 5000 + 1 AS DOUBLE) AS kwh, CAST(round(round(price * 100) / 100, 2) AS DECIMAL(12, 2)) AS total_amount,
'RF48 9077 3800 0300 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || ' ' || lpad(CAST((k + 7) % 10000 AS VARCHAR), 4, '0') || ' 6' AS payment_code,
lpad(CAST(k + 1 AS VARCHAR), 8, '0') AS contract_account, lpad(CAST(k + 2 AS VARCHAR), 8, '0') AS partner_code, CAST(k % 90 + 1 AS INTEGER) AS days,
CASE WHEN k % 2 = 0 THEN k % 80000 + 10743 END AS last_reading, CASE WHEN k % 2 = 0 THEN k % 80000 + 10000 END AS prev_reading, CASE WHEN k % 2 = 0 THEN CAST(743 AS BIGINT) END AS reading_diff,
CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 40 ELSE 80 END AS BIGINT) AS multiplier, CASE WHEN k % 16 = 7 THEN 'Ο λογαριασμός' ELSE 'ΔΗΜΟΣ ' || seg END || ' - ' || CASE WHEN k % 16 = 9 THEN '720 52 ΠΟΛΗ ΑΘΗΝΑ' ELSE seg END AS name_address,
CAST(d - INTERVAL 120 DAY AS DATE) AS date_from, CAST(d AS DATE) AS date_to, FALSE AS needs_review, CAST(NULL AS VARCHAR) AS reason, CAST(1.0 AS DOUBLE) AS confidence,
CAST(NULL AS VARCHAR) AS subcategory, CAST(NULL AS VARCHAR) AS store, CASE WHEN k % 5 < 3 THEN 'ΦΟΠ' ELSE 'Επαγγελματικό' END AS raw_code, CASE WHEN k % 2 = 0 THEN 'ΕΚΚΑΘΑΡΙΣΤΙΚΟΣ' ELSE '' END AS raw_label, 'v2018' AS layout
FROM ({O})"""
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINES = "SELECT {key}, i - 1 AS line_no, l[i] AS line FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {table} WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS s(i)"


@query(LINES.format(key="doc_id", table="documents"))
def explode_lines(spark, sf_dir):
    return text.explode_lines(table(spark, sf_dir, "documents"), keys=["doc_id"])


@query("SELECT doc_id, text FROM documents")
def collapse_doubled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", doubled(F.col("text")).alias("text"))
    return docs.select("doc_id", fn.collapse_doubled(F.col("text")).alias("text"))


@query(f"SELECT * FROM ({LINES.format(key='doc_id', table='documents')}) WHERE NOT regexp_matches(line, 'LICENSE|COPYRIGHT', 'i')")
def drop_noise_lines(spark, sf_dir):
    lines = text.explode_lines(table(spark, sf_dir, "documents"), keys=["doc_id"])
    return text.drop_noise_lines(lines, patterns=("LICENSE", "COPYRIGHT"))


@query(rf"SELECT conv_id, turn, line_no, regexp_replace(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+', '  ', 'g') AS line FROM ({LINES.format(key='conv_id, turn', table='conversations')})")
def normalize_line(spark, sf_dir):
    lines = text.explode_lines(table(spark, sf_dir, "conversations"), keys=["conv_id", "turn"])
    return lines.select("conv_id", "turn", "line_no", fn.normalize_line(F.col("line")).alias("line"))


@query(r"SELECT doc_id, replace(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(160), ' ') AS text FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.normalize_text(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, coalesce(length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')), 0) <= 50 AS low_text FROM conversations")
def flag_low_text(spark, sf_dir):
    return text.flag_low_text(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "low_text")


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE text <> ''), '') AS text FROM conversations GROUP BY conv_id")
def assemble_pages(spark, sf_dir):
    return text.assemble_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"SELECT DISTINCT 'm' || c AS doc_id, 0 AS score FROM ({O}) UNION ALL SELECT 'v' || k, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END FROM ({O})")
def layout_score(spark, sf_dir):
    docs = render_modern(spark, sf_dir).union(render_v2018(spark, sf_dir))
    return docs.select("doc_id", layout.layout_score(F.col("text")).alias("score"))


@query(f"SELECT DISTINCT 'm' || c AS doc_id, 'modern' AS layout FROM ({O}) UNION ALL SELECT 'v' || k, 'v2018' FROM ({O})")
def route_layout(spark, sf_dir):
    return layout.route_layout(render_modern(spark, sf_dir).union(render_v2018(spark, sf_dir))).select("doc_id", "layout")


TWICE = f"SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY k, copy) AS block_no FROM ({MODERN}) m, (VALUES (1), (2)) AS t(copy) WHERE copy = 1 OR k % 11 = 0"


@query(f"""SELECT doc_id, block_no, supply_no || '  ' || account_no || '  ' || issue_date || '  ' || period || '  ' || replace(name_address, ' ', '  ') || '  ' || city AS line1,
CASE k % 5 WHEN 0 THEN 'ΦΟΠ  Τιμολόγιο' WHEN 1 THEN 'Φ.Ο.Π  Τιμολόγιο' WHEN 2 THEN 'Γ21  Επαγγελματικό' WHEN 3 THEN 'Γ22  Τιμολόγιο' ELSE 'Γ23' END AS line2,
CASE WHEN k % 5 = 4 THEN 'Επαγγελματικό' WHEN k % 3 = 2 THEN CASE WHEN k % 2 = 0 THEN 'ΚΑΤΑΣΤΗΜΑ  ΕΞΥΠΗΡ.ΔΕΗ  :  ' || store ELSE 'ΠΑΡΑΣΤ:  ' || k END ELSE CASE WHEN k % 3 = 0 THEN 'Ημέρα  ' ELSE '' END || (k + 100) || '  ' || k || '  ' || (1 + k % 2) || '  100' END AS line3 FROM ({TWICE})""")
def blocks_modern(spark, sf_dir):
    docs = modern_docs(spark, sf_dir)
    found = blocks.document_blocks(docs.select("doc_id", blocks.kept_lines(F.col("text")).alias("lines")))
    return found.select("doc_id", "block_no", "line1", "line2", "line3")


@query(f"SELECT doc_id, CAST(count(*) FILTER (WHERE k % 5 IN (2, 4)) AS BIGINT) AS n_wraps FROM ({TWICE}) GROUP BY doc_id")
def wrap_category(spark, sf_dir):
    return blocks.wrap_category(modern_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count_if("wraps").alias("n_wraps"))


RECORD = ", ".join(c for c in modern.COLUMNS if c != "block_no")


@query(f"SELECT {RECORD} FROM ({MODERN})")
def records_modern(spark, sf_dir):
    return modern.extract_modern(modern_docs(spark, sf_dir))[0].drop("block_no")


@query(f"SELECT {RECORD} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place FROM ({MODERN})) WHERE place = 1")
def records_enhanced(spark, sf_dir):
    return modern.extract_modern(modern_docs(spark, sf_dir), profile="enhanced", first_only=True)[0].drop("block_no")


@query(f"SELECT {RECORD} FROM ({MODERN})")
def records_columns_mode(spark, sf_dir):
    """The raw line's columns instead of the normalised line's words; the same where every column is one word."""
    return modern.extract_modern(modern_docs(spark, sf_dir), mode="columns")[0].drop("block_no")


@query(f"SELECT doc_id, supply_no, account_no, issue_date, period, 'duplicate' AS reject_reason, 'modern' AS layout FROM ({MODERN}) WHERE k % 11 = 0")
def rejects_modern(spark, sf_dir):
    return modern.extract_modern(modern_docs(spark, sf_dir))[1].drop("block_no")


@query(f"SELECT * EXCLUDE (k) FROM ({V2018})")
def records_v2018(spark, sf_dir):
    return v2018.extract_v2018(render_v2018(spark, sf_dir))


@query(f"SELECT doc_id, supply_no, account_no, issue_date, category, CASE WHEN k % 16 <> 4 THEN k % 80000 + 10743 END AS last_reading, kwh, days FROM ({V2018})")
def records_v2018_enhanced(spark, sf_dir):
    """Without the limit to final bills; the third number must have four digits, so a last digit is lent by a fourth."""
    docs = render_v2018(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" 743 τέλος"), F.lit(" 7430 τέλος")))
    return v2018.extract_v2018(docs, profile="enhanced").select("doc_id", "supply_no", "account_no", "issue_date", "category", "last_reading", "kwh", "days")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice, 2) AS DECIMAL(12, 2)) AS amount FROM lineitem")
def scalar_money(spark, sf_dir):
    shown = F.translate(F.format_number(F.round("l_extendedprice", 2), 2), ",.", ".,")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.parse_eu_money(F.concat(F.lit("*"), shown, F.lit(" €"))).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders")
def scalar_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("32/13/2024")
    return o.select("o_orderkey", fn.parse_date_multi(shown).alias("day"))


@query("SELECT o_orderkey, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS date_from, CAST(o_orderdate AS DATE) AS date_to FROM orders")
def scalar_span(spark, sf_dir):
    shown = F.concat(F.date_format(F.date_sub("o_orderdate", 7), "dd-MM-yyyy"), F.lit(" – "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    start, end = fn.parse_date_span(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", start.alias("date_from"), end.alias("date_to"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate - INTERVAL 7 DAY AS DATE) END AS date_from, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS date_to FROM orders")
def scalar_period(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 4 > 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("31.02.2024")
    found = fn.parse_dotted_period(F.concat(F.date_format(F.date_sub("o_orderdate", 7), "dd.MM.yyyy"), F.lit("-"), end))
    return table(spark, sf_dir, "orders").select("o_orderkey", found[0].alias("date_from"), found[1].alias("date_to"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey AS DOUBLE) END AS kwh, CAST(o_orderkey AS DOUBLE) AS kwh_same_line FROM orders")
def scalar_kwh(spark, sf_dir):
    number = F.translate(F.format_number("o_orderkey", 0), ",", ".")
    shown = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "18/01/2019\n").otherwise("Ενέργεια "), number, F.lit(" KWH"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.parse_kwh(shown).alias("kwh"), fn.parse_kwh(shown, same_line=True).alias("kwh_same_line"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN TRUE ELSE FALSE END AS flag FROM events")
def scalar_truthy(spark, sf_dir):
    words = F.array(*map(F.lit, ["TRUE", "1", "Ναι", "y", "0", "1.0", "όχι", None]))
    return table(spark, sf_dir, "events").select("event_id", fn.is_truthy(F.get(words, (F.col("event_id") % 8).cast("int"))).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'no date' END AS day FROM orders")
def scalar_reformat(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("no date")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.reformat_date(shown).alias("day"))


@query("SELECT c_custkey, replace(replace(c_name || ' - ' || c_mktsegment, ' ', ''), '-', '') AS plain, c_name || '_None_' || c_mktsegment AS key FROM customer")
def scalar_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.strip_separators(F.concat_ws(" - ", "c_name", "c_mktsegment")).alias("plain"), fn.dedup_key(F.col("c_name"), F.lit(""), F.col("c_mktsegment")).alias("key"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Αγροτικό' WHEN l_quantity = 1 THEN 'Απλό επαγγελματικό' WHEN l_quantity > 1 THEN 'Βιομηχανικό' END AS subcategory,
CASE WHEN l_returnflag = 'A' THEN 2.0 / 3 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN l_returnflag = 'A' THEN 'Missing: flag (confidence: 0.67)' END AS reason FROM lineitem""")
def scalar_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"flag": F.nullif("l_returnflag", F.lit("A")), "category": F.when(F.col("l_linenumber") % 2 == 0, "ΦΟΠ").otherwise("Επαγγελματικό")})
    score = fn.confidence(F.col("l_linestatus"), F.col("l_orderkey").cast("string"), F.col("flag"))
    context = F.when(F.col("l_returnflag") == "A", "τιμολόγιο αγροτικού").otherwise("γενικό")
    return rows.select("l_orderkey", "l_linenumber", fn.infer_subcategory(F.col("category"), F.col("l_quantity"), context).alias("subcategory"), score.alias("confidence"), fn.review_reason(score, line=F.col("l_linestatus"), order=F.col("l_orderkey").cast("string"), flag=F.col("flag")).alias("reason"))


UNIFIED = "doc_id, supply_no, account_no, issue_date, category, is_final, date_from, date_to, layout"


def other_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The v2018 rendering, and a document without a text for each order."""
    return render_v2018(spark, sf_dir).union(orders(spark, sf_dir).select(F.concat(F.lit("u"), "o_orderkey"), F.lit(None).cast("string")))


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both renderings, and a document without a text for each order."""
    return render_modern(spark, sf_dir).union(other_docs(spark, sf_dir))


def unified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return extract(all_docs(spark, sf_dir))


@query(f"SELECT {UNIFIED} FROM ({MODERN}) UNION ALL SELECT {UNIFIED} FROM ({V2018})")
def extract_unified(spark, sf_dir):
    return unified(spark, sf_dir)[0].select(*UNIFIED.split(", "))


@query(f"SELECT doc_id, 'duplicate' AS reject_reason, 'modern' AS layout FROM ({MODERN}) WHERE k % 11 = 0 UNION ALL SELECT 'u' || k, 'no text', 'unknown' FROM ({O})")
def rejects_unified(spark, sf_dir):
    return unified(spark, sf_dir)[1].select("doc_id", "reject_reason", "layout")


@query(f"SELECT supply_no, account_no, issue_date, category FROM ({MODERN}) WHERE is_final")
def final_bills(spark, sf_dir):
    found = modern.modern_records(modern_docs(spark, sf_dir))
    rows = found.withColumns({" Αφμ ": F.lit("123456789"), "issue_date": F.replace("issue_date", F.lit("/"), F.lit("-"))})
    return filter_final(rows, order_by=["doc_id", "block_no"]).select("supply_no", "account_no", "issue_date", "category")


ALL_LINEITEM = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ALL_LINEITEM}) AS place FROM lineitem) WHERE place = 1")
def dedup_first_lineitem(spark, sf_dir):
    return records.dedup_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ALL_LINEITEM.split(", "))


@query(f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ALL_LINEITEM}) AS place FROM lineitem) WHERE place > 1")
def duplicates_lineitem(spark, sf_dir):
    return records.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ALL_LINEITEM.split(", "))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedup_whole_rows(spark, sf_dir):
    return records.dedup_records(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(f"SELECT supply_no, account_no, raw_code FROM ({MODERN}) WHERE category = 'ΦΟΠ'")
def split_residential(spark, sf_dir):
    return records.split_by_category(records_modern(spark, sf_dir))["residential"].select("supply_no", "account_no", "raw_code")


@query(f"SELECT supply_no, account_no, raw_code FROM ({MODERN}) WHERE category = 'Επαγγελματικό'")
def split_commercial(spark, sf_dir):
    return records.split_by_category(records_modern(spark, sf_dir))["commercial"].select("supply_no", "account_no", "raw_code")


@query(f"SELECT {', '.join(c for c in modern.COLUMNS if c != 'block_no' and c not in records.INTERNAL)} FROM ({MODERN})")
def public_columns(spark, sf_dir):
    return records.sort_by_id(records.public_columns(records_modern(spark, sf_dir)))


@query("SELECT c_custkey, c_nationkey FROM customer")
def drop_column_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias(" αΦμ"))
    return records.drop_column_ci(rows)


@query(f"SELECT 'modern' AS layout, count(*) AS n FROM ({MODERN}) UNION ALL SELECT 'v2018', count(*) FROM ({V2018})")
def layout_counts(spark, sf_dir):
    return records.count_by(unified(spark, sf_dir)[0])


@query(f"""SELECT count(*) AS n_records, count(*) FILTER (WHERE k % 11 = 0) AS n_duplicates, CAST(0 AS BIGINT) AS n_review, count(*) FILTER (WHERE category = 'ΦΟΠ') AS n_residential, count(*) FILTER (WHERE category <> 'ΦΟΠ') AS n_commercial,
count(*) FILTER (WHERE raw_code = 'Φ.Ο.Π') AS n_code_variants, count(*) FILTER (WHERE raw_code = 'Γ-wrap') AS n_wraps, count(store) AS n_store, count(receipt_no) AS n_receipt FROM ({MODERN})""")
def run_summary(spark, sf_dir):
    return records.run_summary(*modern.extract_modern(modern_docs(spark, sf_dir)))


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_with_id, count(*) AS n_ids, count(*) FILTER (WHERE n > 1) AS n_repeated_ids, CAST(sum(n) AS BIGINT) AS n_full, CAST(sum(f) AS BIGINT) AS n_final,
CAST(sum(r) AS BIGINT) AS n_residential, CAST(sum(n - r) AS BIGINT) AS n_commercial
FROM (SELECT supply_no, count(*) AS n, count(*) FILTER (WHERE is_final) AS f, count(*) FILTER (WHERE category = 'ΦΟΠ') AS r FROM ({MODERN}) GROUP BY supply_no)""")
def quality_profile(spark, sf_dir):
    return records.quality_profile(records_modern(spark, sf_dir))


@query(f"""SELECT count(*) FILTER (WHERE k % 11 = 0) AS n_repeated_keys, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_zero, CAST(0 AS BIGINT) AS n_zero_final, CAST(0 AS BIGINT) AS n_noisy, CAST(sum(n) AS BIGINT) AS n_dated,
CAST(coalesce(sum(n) FILTER (WHERE subcategory IS NOT NULL), 0) AS BIGINT) AS n_subcategory, CAST(sum(n) AS BIGINT) AS n_sure FROM (SELECT *, CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS n FROM ({MODERN}))""")
def audit_records(spark, sf_dir):
    found = modern.modern_records(modern_docs(spark, sf_dir))
    return records.audit_records(found, modern.KEY, NOISE["modern"])


@query("SELECT * FROM (SELECT 'not empty' AS expectation, CAST(0 AS BIGINT) AS failures UNION ALL SELECT 'has l_tax', 0 UNION ALL SELECT 'has vat', 1 UNION ALL SELECT 'small', count(*) FILTER (WHERE l_quantity > 40) FROM lineitem)")
def expectations(spark, sf_dir):
    return records.expect(table(spark, sf_dir, "lineitem"), ("l_tax", "vat"), {"small": F.col("l_quantity") <= 40})


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS n_name, 0 AS source_seq FROM customer UNION ALL SELECT NULL, NULL, n_name, 1 FROM nation")
def read_record_files(spark, sf_dir):
    csv = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.csv(f"{csv}.csv", header=True)
    table(spark, sf_dir, "nation").select("n_name").write.parquet(f"{csv}.parquet")
    found, _ = read_records(spark, [f"{csv}.csv", f"{csv}.parquet", "", f"{csv}.xlsx", f"{csv}-none.csv"])
    return found


@query(f"SELECT 'all' AS output, supply_no, account_no FROM ({MODERN}) UNION ALL SELECT CASE WHEN category = 'ΦΟΠ' THEN 'residential' ELSE 'commercial' END, supply_no, account_no FROM ({MODERN})")
def write_record_tables(spark, sf_dir):
    path, out = scratch(spark), None
    for name in write_records(records_modern(spark, sf_dir), path):
        part = spark.read.parquet(output_path(path, name)).select(F.lit(name).alias("output"), "supply_no", "account_no")
        out = part if out is None else out.union(part)
    return out


RUN = f"""SELECT count(*) FILTER (WHERE layout IS NOT NULL) AS n_records, (SELECT count(*) FROM ({O}) WHERE k % 11 = 0) AS n_duplicates, CAST(0 AS BIGINT) AS n_review, count(*) FILTER (WHERE category = 'ΦΟΠ') AS n_residential, count(*) FILTER (WHERE category <> 'ΦΟΠ') AS n_commercial,
count(*) FILTER (WHERE raw_code = 'Φ.Ο.Π') AS n_code_variants, count(*) FILTER (WHERE raw_code = 'Γ-wrap') AS n_wraps, count(store) AS n_store, count(receipt_no) AS n_receipt
FROM (SELECT layout, category, raw_code, store, receipt_no FROM ({MODERN}) UNION ALL SELECT layout, category, raw_code, store, receipt_no FROM ({V2018}))"""


@query(RUN)
def write_run_summary(spark, sf_dir):
    """What is counted while a run of both layouts is written."""
    return write_run(judged(all_docs(spark, sf_dir)), scratch(spark))


@query(f"""SELECT output, count(*) AS n FROM (SELECT CASE WHEN category = 'ΦΟΠ' THEN 'residential' ELSE 'commercial' END AS output FROM ({MODERN}) UNION ALL SELECT CASE WHEN category = 'ΦΟΠ' THEN 'residential' ELSE 'commercial' END FROM ({V2018})
UNION ALL SELECT 'rejected' FROM ({MODERN}) WHERE k % 11 = 0 UNION ALL SELECT 'rejected' FROM ({O})) GROUP BY output""")
def write_run_outputs(spark, sf_dir):
    """The table that a run of both layouts is written to."""
    path = scratch(spark)
    write_run(judged(all_docs(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("output").agg(F.count("*").alias("n"))


@query(f"SELECT supply_no, account_no FROM ({MODERN}) WHERE is_final")
def write_filtered_table(spark, sf_dir):
    path = scratch(spark)
    write_filtered(filter_final(records_modern(spark, sf_dir)).select("supply_no", "account_no"), path)
    return spark.read.parquet(path)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def write_stats_table(spark, sf_dir):
    path = scratch(spark)
    write_stats(table(spark, sf_dir, "lineitem"), path, "l_returnflag")
    return spark.read.schema("l_returnflag string, n bigint").json(path)


@query(f"SELECT account_no, reject_reason, CAST(2 AS BIGINT) AS n FROM (SELECT account_no, 'duplicate' AS reject_reason FROM ({MODERN}) WHERE k % 11 = 0)")
def write_reject_table(spark, sf_dir):
    path = scratch(spark)
    rejects = modern.extract_modern(modern_docs(spark, sf_dir))[1]
    write_rejects(rejects, path)
    write_rejects(rejects, path)
    return spark.read.parquet(path).where("run_at IS NOT NULL").groupBy("account_no", "reject_reason").agg(F.count("*").alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(p - 1 AS INTEGER) AS page_no, CAST(length(pages[p]) AS BIGINT) AS n_chars, true AS page_nos
FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS pages FROM documents))""")
def read_document_files(spark, sf_dir):
    """Every page of every document, written to shared files and read again; page_nos: whether the numbers of its file's pages are 0, 1, ... to the last.

    A page of a file begins with a line of the document's number and id. A document's
    pages stand side by side, so a page's number in it is its number in the file less the least of them.
    """
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").withColumn("row", F.monotonically_increasing_id())
    docs = docs.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f", -1)).alias("at", "page"))
    docs.select(F.concat_ws(" ", "row", "doc_id"), "page").select(F.concat_ws("\n", "*")).write.option("lineSep", "\f").text(path)
    pages = read_documents(spark, path)
    of_file = pages.groupBy(F.col("doc_id").alias("file")).agg(((F.count("*") == F.max("page_no") + 1) & (F.countDistinct("page_no") == F.count("*"))).alias("page_nos"))
    head, body = F.get(F.split("text", "\n", 2), F.lit(0)), F.get(F.split("text", "\n", 2), F.lit(1))
    rows = pages.select(F.col("doc_id").alias("of_file"), "page_no", F.split(head, " ", 2).alias("head"), F.length(body).cast("bigint").alias("n_chars"))
    rows = rows.select("*", F.get("head", F.lit(0)).alias("row")).join(of_file, F.col("of_file") == F.col("file"))
    least = F.min("page_no").over(Window.partitionBy("row"))
    return rows.select(F.get("head", F.lit(1)).alias("doc_id"), (F.col("page_no") - least).alias("page_no"), "n_chars", "page_nos")


@query("""SELECT n_nationkey, n, reason IS NULL AS ok, reason FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS n,
CASE WHEN length(n_name) >= 8 THEN 'too large' WHEN n_name NOT LIKE 'I%' THEN 'not of this format' END AS reason FROM nation)""")
def audit_input_files(spark, sf_dir):
    """Every nation's name in a file of its own (and a line's end), which shall have at most 8 bytes and begin with an I."""
    path = scratch(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(1).write.partitionBy("n_nationkey").text(path)
    found = audit_files(spark, path, ".txt", 8, b"I")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("bigint").alias("n_nationkey"), F.col("length").alias("n"), "ok", "reason")


def streamed(spark: SparkSession, sf_dir: str) -> str:
    """Where a stream has put two drops of files; the second brings all of the first again."""
    path = scratch(spark)
    for first in (True, False):
        drop = render_modern(spark, sf_dir) if first else spark.read.parquet(f"{path}/in").union(other_docs(spark, sf_dir))
        drop.write.mode("append").parquet(f"{path}/in")
        run = stream_extract(spark, f"{path}/in", f"{path}/out", f"{path}/state")
        run.awaitTermination()
        run.stop()
    return f"{path}/out"


@query(f"SELECT supply_no, account_no, layout, count(*) AS n FROM (SELECT supply_no, account_no, layout FROM ({MODERN}) UNION ALL SELECT supply_no, account_no, layout FROM ({V2018})) GROUP BY supply_no, account_no, layout")
def stream_extraction(spark, sf_dir):
    return records_of_stream(spark, streamed(spark, sf_dir)).groupBy("supply_no", "account_no", "layout").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, account_no, reject_reason, CASE WHEN k % 11 = 0 THEN 3 ELSE 1 END::BIGINT AS n FROM (SELECT *, 'duplicate' AS reject_reason FROM ({MODERN}))
UNION ALL SELECT 'u' || k, NULL, 'no text', 1 FROM ({O})""")
def stream_rejects(spark, sf_dir):
    """Of the second drop all records of the first are duplicates; one in eleven is twice in each."""
    return rejects_of_stream(spark, streamed(spark, sf_dir)).groupBy("doc_id", "account_no", "reject_reason").agg(F.count("*").alias("n"))


@query(f"SELECT 'modern' AS layout, count(DISTINCT c) AS n FROM ({O}) UNION ALL SELECT 'v2018', count(*) FROM ({O})")
def stream_layout_counts(spark, sf_dir):
    path, name = scratch(spark), f"layouts_{uuid.uuid4().hex}"
    render_modern(spark, sf_dir).union(render_v2018(spark, sf_dir)).write.parquet(f"{path}/in")
    run = stream_format_counts(spark, f"{path}/in", name, f"{path}/state")
    run.awaitTermination()
    run.stop()
    return spark.table(name)
