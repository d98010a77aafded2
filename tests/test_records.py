import random
import re

from pyspark.sql import functions as F

from invoicelines import patterns
from invoicelines.operators import blocks, modern, records, v2018
from invoicelines.operators.layout import layout_score
from invoicelines.plans.pipeline import filter_final
from invoicelines.sources import audit_files, read_documents, read_records

ROW1 = "1234567890 987654321 01/01/2024 01.01.2024-31.01.2024  {}  ΟΔΟΣ  ΑΘΗΝΑ"


def lines_of(spark, *docs):
    return spark.createDataFrame([(f"d{i}", n, x) for i, d in enumerate(docs) for n, x in enumerate(d)], "doc_id string, line_no int, line string")


def test_blocks_equal_a_greedy_loop(spark):
    rng = random.Random(1)
    pool = [ROW1.format("Α"), "ΦΟΠ Τιμολόγιο", "Γ21", "Γ22 Επαγγελματικό", "Επαγγελματικό", "Ημέρα 2 1 1 1", "x"]
    docs = [[rng.choice(pool) for _ in range(rng.randint(0, 14))] for _ in range(400)]

    def norm(s):
        return re.sub(r"\s+", "  ", s.strip())

    def wrap(d, i):
        if i + 1 >= len(d) or not re.match(patterns.WRAP, norm(d[i])):
            return False
        return any("Επαγγελματικό" in norm(x) for x in d[i : i + 3])

    expected = set()
    for n, d in enumerate(docs):
        i = 0
        while i < len(d) - 2:
            if re.match(patterns.ROW1, norm(d[i])) and (re.match(patterns.ROW2, norm(d[i + 1])) or wrap(d, i + 1)):
                expected.add((f"d{n}", i))
                i += 3
            else:
                i += 1
    found = {(r.doc_id, r.pos) for r in blocks.assemble_blocks(lines_of(spark, *docs)).collect()}
    assert found == expected and len(expected) > 40


def test_modern_quirks(spark):
    docs = [
        [ROW1.format("ΔΥΟ ΛΕΞΕΙΣ"), "ΦΟΠ Τιμολόγιο", "Ημέρα 1234 1230 1 1234"],
        [ROW1.format("Α").replace("1234567890", "1234567891"), "Γ21", "x", "Επαγγελματικό"],
        [ROW1.format("Α").replace("1234567890", "1234567892"), "Φ Ο Π Επαγγελματικό", "9 9 2 0", "ΚΑΤΑΣΤΗΜΑ ΕΞΥΠΗΡ.ΔΕΗ : Κέντρο"],
        [ROW1.format("Α").replace("1234567890", "1234567892"), "Γ22 Τιμολόγιο", "x"],
    ]
    got, rejects = modern.extract_modern(lines_of(spark, *docs))
    rows = {r.supply_no: r for r in got.collect()}
    assert (rows["1234567890"].name_address, rows["1234567890"].city) == ("ΔΥΟ ΛΕΞΕΙΣ", "ΟΔΟΣ  ΑΘΗΝΑ")
    wrapped = rows["1234567891"]
    assert (wrapped.category, wrapped.needs_review, wrapped.is_final) == (None, True, False)
    assert wrapped.reason == "Missing: category (confidence: 0.67)"
    spaced = rows["1234567892"]
    assert (spaced.category, spaced.raw_code, spaced.subcategory, spaced.is_final) == ("Επαγγελματικό", "Φ  Ο  Π", "Βιομηχανικό", True)
    assert [(r.doc_id, r.reject_reason) for r in rejects.collect()] == [("d3", "duplicate")]
    columns = modern.extract_modern(lines_of(spark, docs[0]), mode="columns")[0].first()
    assert (columns.name_address, columns.city) == ("ΔΥΟ ΛΕΞΕΙΣ ΟΔΟΣ", "ΑΘΗΝΑ")


V2018 = "Ο λογαριασμός σας συνοπτικά\nΚωδικός Ηλεκτρονικής Πληρωμής\nRF48 9077 3800 0300 0070 5045 6\nΚατανάλωση Ηλεκτρικής Ενέργειας\nΗμερομηνία Έκδοσης\n555035070018\nΔΗΜΟΣ ΤΡΙΠΟΛΗΣ\nΕΚΚΑΘΑΡΙΣΤΙΚΟΣ\nΦΟΠ Τιμολόγιο\n19/09/2018 - 18/01/2019\n3706 kWh\n24/01/2019\n*387,00"


def test_v2018(spark):
    docs = spark.createDataFrame([("a", V2018), ("b", "nothing"), ("c", None), ("d", "")], "doc_id string, text string")
    r = v2018.extract_v2018(docs).collect()
    assert len(r) == 1 and r[0].doc_id == "a"
    r = r[0]
    assert (r.supply_no, r.issue_date, r.period, r.is_final, r.category) == ("555035070018", "19/09/2018", "19/09/2018 - 18/01/2019", True, "ΦΟΠ")
    assert r.name_address.startswith("ΔΗΜΟΣ ΤΡΙΠΟΛΗΣ") and r.kwh is None and float(r.total_amount) == 387.0 and r.payment_code == "RF48 9077 3800 0300 0070 5045 6"
    assert v2018.extract_v2018(docs, same_line=True).first().kwh == 3706.0
    assert v2018.extract_v2018(docs.withColumn("text", F.concat("text", F.lit("\n123456789012"))), known_ids=("123456789012",)).first().supply_no == "123456789012"
    assert [x[0] for x in docs.orderBy("doc_id").select(layout_score(F.col("text"))).collect()] == [3, 0, None, 0]


def test_filters(spark):
    flags = ["True", "False", "true", "false", "1", "0", "ναι", "όχι", None, "invalid"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(flags)], "supply_no string, is_final string")
    assert records.filter_truthy(df).count() == 4 and records.filter_truthy(df.drop("is_final")).count() == 10
    rows = spark.createDataFrame([("1", "a", "01/01/2024", 1, "true", "9"), ("1", "a", "01/01/2024", 2, "1", "9"), ("1", "b", "01-01-2024", 3, "yes", "9"), ("2", "a", "bad", 4, "ναι", "9"), ("3", "a", "01/01/2024", 5, "no", "9")], "supply_no string, account_no string, issue_date string, v int, is_final string, ` αΦμ ` string")
    out = filter_final(rows, order_by=["v"])
    assert sorted((r.supply_no, r.issue_date, r.v) for r in out.collect()) == [("1", "01/01/2024", 1), ("1", "01/01/2024", 3), ("2", "bad", 4)]
    assert out.columns == ["supply_no", "account_no", "issue_date", "v", "is_final"]
    keys_only = spark.createDataFrame([("1", "a", "x"), ("1", "a", "x"), ("2", None, "x")], "supply_no string, account_no string, issue_date string")
    assert sorted(tuple(map(str, r)) for r in records.dedup_records(keys_only).collect()) == [("1", "a", "x"), ("2", "None", "x")]
    skewed = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    assert sorted(r.id for r in records.dedup_first(skewed, ["k"], ["id"]).collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in records.dedup_first(skewed, ["k"], ["id"])._jdf.queryExecution().toString()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.csv").write_text("id,v\n007,x\n")
    assert sorted((r.page_no, r.text) for r in read_documents(spark, str(tmp_path)).collect()) == [(0, "one"), (1, "two")]
    assert read_documents(spark, str(tmp_path), "*.none").count() == 0
    df, skipped = read_records(spark, [f"{tmp_path}/b.csv", " ", f"{tmp_path}/no.csv", f"{tmp_path}/a.txt"])
    assert [tuple(r) for r in df.collect()] == [("007", "x", 0)] and len(skipped) == 2
    assert read_records(spark, [], ["id"])[0].columns == ["id", "source_seq"]
    audit = {r.path.rpartition("/")[2]: r.reason for r in audit_files(spark, str(tmp_path), ".txt", 100, b"one").collect()}
    assert audit == {"a.txt": None, "b.csv": "suffix"}
    assert [tuple(r)[1:] for r in audit_files(spark, f"{tmp_path}/none").collect()] == [(None, False, "missing")]
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    df, skipped = read_records(spark, [f"{tmp_path}/bad.parquet", f"{tmp_path}/b.csv"])
    assert df.count() == 1 and [p for p, _ in skipped] == [f"{tmp_path}/bad.parquet"]
