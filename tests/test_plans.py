"""Plans and runs: what is shuffled, how large generated methods are, what is observed, read and remembered."""

import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from invoicelines.functions import found, groups, let
from invoicelines.operators import blocks, modern, records, v2018
from invoicelines.patterns import ROW2
from invoicelines.plans.pipeline import COLUMNS, extract, judged, parse
from invoicelines.plans.rendering import render_modern, render_v2018
from invoicelines.sources import output_path, read_documents, read_records, write_records, write_run
from invoicelines.sources.readers import broken_files
from invoicelines.streaming import MERGE, _parts, records_of_stream, rejects_of_stream, stream_extract

from .conftest import SMALL


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    none = spark.createDataFrame([("none", None), ("empty", ""), ("anchors", "Ο λογαριασμός σας συνοπτικά\nΚωδικός Ηλεκτρονικής Πληρωμής")], "doc_id string, text string")
    render_modern(spark, SMALL).union(render_v2018(spark, SMALL)).union(none).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def methods(df):
    text = df.sparkSession._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_methods_stay_small(spark, docs):
    """The JVM never optimises methods of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (v2018.extract_v2018(docs), v2018.extract_v2018(docs, profile="enhanced"), modern.extract_modern(docs)[0], modern.extract_modern(docs)[1], parse(docs), judged(docs)):
            assert methods(df) and max(methods(df)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nothing_is_shuffled_below_the_keys(docs):
    exchanges = lambda df: len(re.findall(r"\bExchange\b", plan(df)))
    assert exchanges(modern.modern_records(docs)) == exchanges(parse(docs)) == exchanges(v2018.extract_v2018(docs)) == 0
    assert exchanges(modern.extract_modern(docs)[0]) == 1
    assert exchanges(judged(docs)) == 2
    for df in (*modern.extract_modern(docs), judged(docs), *extract(docs)):
        assert plan(df).count("FileScan") == 1


def test_first_rows_are_matched_twice_at_most(docs):
    text = modern.modern_records(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(r"\d{10,11})\s+(\d{9,12}") <= 2


def test_parse_keeps_reasons(spark, docs, tmp_path):
    reasons = {r.doc_id: r.reject_reason for r in judged(docs).where("doc_id IN ('none', 'empty', 'anchors')").collect()}
    assert reasons == {"none": "no text", "anchors": "no supply number"}
    lazy, stored = extract(docs), extract(docs, store=str(tmp_path / "run"))
    for a, b in zip(lazy, stored, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert set(lazy[0].columns) == set(COLUMNS)


def test_context_is_filled(docs):
    n = parse(docs).where("layout = 'modern'").agg(F.count("store").alias("s"), F.count("receipt_no").alias("r")).first()
    assert n.s > 0 and n.r > 0


def test_groups_and_found(spark):
    df = spark.createDataFrame([("Γ21 Τιμολόγιο x",), ("none",), (None,), ("ΦΟΠ Επαγγελματικό",)], "t string")
    assert [r[0] for r in df.select(groups(F.col("t"), ROW2, 2)).collect()] == [["Γ21", "Τιμολόγιο"], None, None, ["ΦΟΠ", "Επαγγελματικό"]]
    assert [r[0] for r in df.select(found(F.col("t"), r"(\d+)")).collect()] == ["21", None, None, None]
    assert [r[0] for r in df.select(let(F.length("t"), lambda n: n * n)).collect()][1:3] == [16, None]


def test_greedy_runs(spark):
    cases = [[], [0], [0, 2], [0, 2, 4], [1, 3, 6, 8, 10, 15], list(range(0, 4000, 2)), [5, 8, 11]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>")
    for r in df.select("c", blocks.greedy(F.col("c")).alias("g")).collect():
        want, last = [], -3
        for x in r.c:
            if x >= last + 3:
                want.append(x)
                last = x
        assert r.g == want


def test_repeated_rows_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 5003).alias("place"), F.lit(1).alias("salt"))
    got = records.flag_repeated(df, ["k"], ["place"])
    assert got.columns == ["k", "place", "salt", "repeated"]
    first = {(r.k, r.place) for r in got.where("NOT repeated").collect()}
    assert first == {(r.k, r.p) for r in df.groupBy("k").agg(F.min("place").alias("p")).collect()} and got.count() == 5000
    some = records.flag_repeated(df, ["k"], ["place"], when=F.col("k") == 3)
    assert {r.k for r in some.where("repeated").collect()} == {3} and some.where("NOT repeated AND k = 3").count() == 1
    assert records.duplicates(df, ["k"], ["place"]).count() == 5000 - len(first)
    ties = spark.createDataFrame([(1, 1)] * 4, "k int, place int")
    assert records.duplicates(ties, ["k"], ["place"]).count() == 3


def jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_run_is_written_once_and_counted_meanwhile(spark, docs, tmp_path):
    rows = judged(docs)
    summary = write_run(rows, str(tmp_path / "run"))
    kept = rows.where("reject_reason IS NULL")
    want = records.run_summary(kept, rows.where("reject_reason = 'duplicate'").select("doc_id")).first().asDict()
    spark.sparkContext.setJobGroup("summary", "")
    got = summary.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0].asDict() == want and want["n_store"] > 0 and jobs(spark, "summary") == 0
    back = spark.read.parquet(str(tmp_path / "run"))
    assert {r.output: r["count"] for r in back.groupBy("output").count().collect()}["rejected"] == rows.where("reject_reason IS NOT NULL").count()
    ids = [r.supply_no for r in spark.read.parquet(output_path(str(tmp_path / "run"), "residential")).select("supply_no").coalesce(1).collect()]
    assert len(ids) == kept.where("category = 'ΦΟΠ'").count()


def test_written_records_are_sorted_in_every_file(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    names = write_records(parse(docs).where("reject_reason IS NULL"), path)
    assert names == ["all", "commercial", "residential"]
    for f in (tmp_path / "out").rglob("*.parquet"):
        ids = pq.ParquetFile(f).read(columns=["supply_no"])["supply_no"].to_pylist()
        assert ids == sorted(ids)
    assert write_records(parse(docs).limit(0), str(tmp_path / "none")) == []
    assert write_records(parse(docs).limit(0).drop("category"), str(tmp_path / "none2")) == []


def test_pages_of_a_split_file(spark, tmp_path):
    pages = [f"page {i} " + "x" * (i % 97) for i in range(4000)]
    (tmp_path / "big.txt").write_text("\f".join(pages) + "\f")
    (tmp_path / "small.txt").write_text("one\n\f\ftwo")
    (tmp_path / "none.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_documents(spark, str(tmp_path))
        found = {(r.doc_id.rpartition("/")[2], r.page_no): r.text for r in df.collect()}
        assert df.select("text").rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {**{("big.txt", i): p for i, p in enumerate(pages)}, ("small.txt", 0): "one\n", ("small.txt", 1): "", ("small.txt", 2): "two"}


def test_broken_row_group(spark, tmp_path):
    path = tmp_path / "a.parquet"
    path.mkdir()
    pq.write_table(pa.table({"id": [str(i) for i in range(1000)], "v": [f"value {i * i}" for i in range(1000)]}), path / "good.parquet", row_group_size=500)
    pq.write_table(pa.table({"id": [str(i) for i in range(1000)], "v": [f"value {i * i}" for i in range(1000)]}), path / "bad.parquet", row_group_size=500)
    meta, data = pq.ParquetFile(path / "bad.parquet").metadata, bytearray((path / "bad.parquet").read_bytes())
    column = meta.row_group(1).column(1)
    start = column.dictionary_page_offset or column.data_page_offset
    data[start : start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    (path / "bad.parquet").write_bytes(bytes(data))
    rows = spark.read.parquet(str(path))
    assert [b.rpartition("/")[2] for b in broken_files(spark, str(path), rows)] == ["bad.parquet"]
    got, skipped = read_records(spark, [str(path)], verify=True)
    assert got.count() == 1000 and len(got.collect()) == 1000 and [(p.rpartition("/")[2], why) for p, why in skipped] == [("bad.parquet", "broken")]
    assert read_records(spark, [str(path / "good.parquet")], verify=True)[1] == []


def test_stream_remembers_keys_without_its_output(spark, docs, tmp_path):
    drops = [docs.where("doc_id LIKE 'm1%'"), docs.where("doc_id LIKE 'm%' OR doc_id = 'none'"), docs.where("doc_id LIKE 'm%' OR doc_id LIKE 'v1%'")]
    place = {k: str(tmp_path / k) for k in ("in", "out", "state", "aside")}
    seen = {}
    for i, drop in enumerate(drops):
        drop.write.mode("append").parquet(place["in"])
        run = stream_extract(spark, place["in"], place["out"], place["state"])
        run.awaitTermination()
        run.stop()
        for f in (tmp_path / "out" / "rows").iterdir():  # what is written is not read again
            if f.name.startswith("batch="):
                seen[f.name] = i
                shutil.copytree(f, f"{place['aside']}/rows/{f.name}", dirs_exist_ok=True)
                shutil.rmtree(f)
    keys = records_of_stream(spark, place["aside"]).where("layout = 'modern'")
    want = modern.extract_modern(docs.where("doc_id LIKE 'm%'").withColumn("text", F.regexp_replace("text", r"(?s)(.)\1", "$1")))[0]
    assert keys.count() == keys.select(*modern.KEY).distinct().count() == want.count()
    rejects = {(r.batch, r.reject_reason): r["count"] for r in rejects_of_stream(spark, place["aside"]).groupBy("batch", "reject_reason").count().collect()}
    assert rejects[(1, "no text")] == 1 and rejects[(2, "duplicate")] >= want.count() and len(seen) == 3


def test_merged_parts_of_keys(spark, tmp_path):
    for name in ("b0", "b1", f"b{MERGE}", f"m{MERGE - 1}", f"b{MERGE - 1}", "b5"):
        at = tmp_path / f"part={name}"
        at.mkdir()
        if name != "b5":
            (at / "_SUCCESS").touch()
    names = lambda before: [p.rpartition("=")[2] for p in _parts(spark, str(tmp_path), before)]
    assert names(1) == ["b0"] and names(MERGE) == [f"m{MERGE - 1}"] and names(MERGE + 1) == [f"m{MERGE - 1}", f"b{MERGE}"] and names(0) == []
    assert _parts(spark, str(tmp_path / "none"), 3) == []


V2018 = "Ο λογαριασμός σας συνοπτικά\nΚωδικός Ηλεκτρονικής Πληρωμής\n555035070018\nΕΚΚΑΘΑΡΙΣΤΙΚΟΣ\n"


def test_v2018_fallbacks(spark):
    texts = ["Ημερομηνία Έκδοσης\nστις\n24/01/2019", "24-01-2019 25/01/2019", "720 52 ΚΑΤΩ ΑΘΗΝΑ", "ΑΓ. ΓΕΩΡΓΙΟΣ ", "ΑΝΩ ΛΑΣ", "1074310000743 x", "10743 10000 743", "ΔΗΜΟΣ ΤΡΙΠΟΛΗΣ ΦΟΠ"]
    df = spark.createDataFrame([(i, V2018 + t) for i, t in enumerate(texts)], "doc_id int, text string")
    r = {x.doc_id: x for x in v2018.extract_v2018(df).collect()}
    assert [r[0].issue_date, r[1].issue_date, r[2].issue_date] == ["24/01/2019", "25/01/2019", None]
    assert r[2].name_address == "Ο λογαριασμός - 720 52 ΚΑΤΩ ΑΘΗΝΑ" and r[2].city == "720 52 ΚΑΤΩ ΑΘΗΝΑ"
    assert r[3].name_address == "Ο λογαριασμός - ΑΓ. ΓΕΩΡΓΙΟΣ" and r[4].name_address.endswith("ΑΝΩ ΛΑΣ")
    assert [(r[i].last_reading, r[i].prev_reading, r[i].reading_diff) for i in (5, 6)] == [(10743, 10000, 743)] * 2
    assert r[7].name_address == "ΔΗΜΟΣ ΤΡΙΠΟΛΗΣ"
