"""Invoices made from the tables orders, customer and nation, to extract them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Orders of a task.
ORDERS = 20_000


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_name", "c_mktsegment", "n_name")
    # The tables are small files, the documents made of them are not: rendering and extraction use all cores, and a task's orders stay as few however many there are.
    parts = max(spark.sparkContext.defaultParallelism, -(-read("orders").count() // ORDERS))  # counted by the footers
    return rows.repartition(parts, "o_custkey")


def doubled(c: Column) -> Column:
    """Every character twice; eight of them are a match."""
    return F.regexp_replace(c, "(?s)(.)" + "(.)?" * 7, "".join(f"${k}${k}" for k in range(1, 9)))


def render_modern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a document per customer with a block for each of its orders, noise among them, one in eleven blocks twice, all characters doubled."""
    k, fmt = F.col("o_orderkey"), lambda c, f: F.date_format(c, f)
    row1 = F.concat_ws(
        " ", (F.lit(1000000000) + F.col("o_custkey")).cast("string"), F.lpad(k.cast("string"), 9, "0"), fmt("o_orderdate", "dd/MM/yyyy"),
        F.concat(fmt(F.date_sub("o_orderdate", 30), "dd.MM.yyyy"), F.lit("-"), fmt("o_orderdate", "dd.MM.yyyy")), F.concat(F.lit(" "), F.col("c_name")), F.concat(F.lit(" "), F.col("c_mktsegment")), F.concat(F.lit("  "), F.col("n_name")),
    )
    row2 = F.when(k % 5 == 0, "ΦΟΠ Τιμολόγιο").when(k % 5 == 1, "Φ.Ο.Π Τιμολόγιο").when(k % 5 == 2, "Γ21 Επαγγελματικό").when(k % 5 == 3, "Γ22 Τιμολόγιο").otherwise("Γ23\nΕπαγγελματικό")
    numbers = F.concat_ws(" ", (k + 100).cast("string"), k.cast("string"), (1 + k % 2).cast("string"), F.lit("100"))
    store = F.when(k % 2 == 0, F.concat(F.lit("ΚΑΤΑΣΤΗΜΑ ΕΞΥΠΗΡ.ΔΕΗ : "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("ΠΑΡΑΣΤ: "), k.cast("string")))
    row3 = F.when(k % 3 == 0, F.concat(F.lit("Ημέρα "), numbers)).when(k % 3 == 1, numbers).otherwise(store)
    noise = F.when(k % 7 == 0, "ΔΗΜΟΣΙΑ ΕΠΙΧΕΙΡΗΣΗ ΗΛΕΚΤΡΙΣΜΟΥ\nΣύνολο πληρωτέο ΣΥΝΟΛΟ ΠΛΗΡΩΤΕΟ 10\n").otherwise("")
    block = F.concat(noise, row1, F.lit("\n"), row2, F.lit("\n"), row3)
    block = F.when(k % 11 == 0, F.concat(block, F.lit("\n"), block)).otherwise(block)
    # By the column that the orders are dealt by, so they are not shuffled again.
    docs = orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("b")))).alias("blocks"))
    return docs.select(F.concat(F.lit("m"), F.col("o_custkey")).alias("doc_id"), doubled(F.array_join(F.transform("blocks", lambda x: x["b"]), "\n")).alias("text"))


def render_v2018(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a document per order in the v2018 layout; one in sixteen each has no label of its date, no town's name, no address, or no blanks between readings."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.translate(F.format_number(F.floor(cents / 100), 0), ",", ".")
    supply = F.when(k % 3 == 0, digits(c + 100000000000, 12)).when(k % 3 == 1, F.concat(F.lit("5 "), digits(c + 1000000000, 10), F.lit("-01"))).otherwise(F.concat(F.lit("55 "), digits(c + 10000000000, 11), F.lit("-02")))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    blank = F.when(k % 16 == 4, "").otherwise(" ")
    lines = [
        F.lit("Ο λογαριασμός σας συνοπτικά"),
        F.when(k % 2 == 0, "Κωδικός Ηλεκτρονικής Πληρωμής").otherwise("Κωδικός"),
        F.lit("Κατανάλωση Ηλεκτρικής Ενέργειας"),
        F.when(k % 16 == 5, "Έκδοση").otherwise(F.concat(F.lit("Ημερομηνία Έκδοσης"), F.when(k % 4 == 0, "\nστις ").otherwise(" "), day)),
        F.concat(F.lit("RF48 9077 3800 0300 "), F.concat_ws(" ", digits(k % 10000, 4), digits((k + 7) % 10000, 4)), F.lit(" 6")),
        F.when(k % 16 == 7, "Πελάτης").otherwise(F.concat(F.lit("ΔΗΜΟΣ "), F.col("c_mktsegment"))),
        F.when(k % 5 < 3, "ΦΟΠ Τιμολόγιο").otherwise("Επαγγελματικό τιμολόγιο"),
        F.when(k % 2 == 0, "ΕΚΚΑΘΑΡΙΣΤΙΚΟΣ").otherwise("Έναντι"),
        F.concat(F.date_format(F.date_sub("o_orderdate", 120), "dd/MM/yyyy"), F.lit(" - "), day),
        F.concat(F.lit("Ενέργεια "), F.translate(F.format_number(k % 5000 + 1, 0), ",", "."), F.lit(" kWh")),
        F.when(k % 16 == 9, "Διεύθυνση").otherwise(F.concat(F.lit("Διεύθυνση Ακινήτου "), F.col("c_mktsegment"))),
        F.concat(F.lit("Α/Α Λογαριασμού "), digits(k, 6)), F.concat(F.lit("Λογαριασμός Συμβολαίου "), digits(k + 1, 8)),
        F.concat(F.lit("Κωδικός Εταίρου "), digits(k + 2, 8)), F.concat(F.lit("Αρ. Παραστατικού "), digits(k + 3, 9)),
        F.concat(F.lit("720 52 "), F.when(k % 16 == 9, "ΠΟΛΗ ΑΘΗΝΑ").otherwise(F.col("c_mktsegment"))), F.concat(F.lit("(Παροχή) "), supply),
        F.concat(F.lit("Ένδειξη "), digits(k % 80000 + 10743, 5), blank, digits(k % 80000 + 10000, 5), blank, F.lit("743 τέλος")),
        F.concat(F.lit("ΗΜΕΡΑΣ "), (k % 90 + 1).cast("string"), F.lit(" συνολικά")),
        F.concat(F.lit("Συντελεστής 25 "), F.when(k % 3 == 0, "1").when(k % 3 == 1, "40").otherwise("80"), F.lit(" 1,0000")),
        F.when(k % 2 == 0, F.concat(F.lit("*"), whole, F.lit(","), digits(cents % 100, 2))).otherwise(F.concat(whole, F.lit(","), digits(cents % 100, 2), F.lit(" €"))),
    ]
    return orders(spark, sf_dir).select(F.concat(F.lit("v"), k).alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))
