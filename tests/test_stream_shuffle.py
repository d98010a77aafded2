"""A stream shuffles only the rows that can repeat."""

from invoicelines import streaming
from invoicelines.streaming import records_of_stream, rejects_of_stream, stream_extract


def test_stream_shuffles_only_modern_rows(spark, tmp_path, monkeypatch):
    shuffled, plain = [], streaming.flag_repeated
    monkeypatch.setattr(streaming, "flag_repeated", lambda df, *a: shuffled.append({r.layout for r in df.select("layout").distinct().collect()}) or plain(df, *a))
    block = "1000000001 000000002 01/02/2020 02.01.2020-01.02.2020  ANNA  STREET  ATHENS\nΦΟΠ Τιμολόγιο\n5 4 1 1"
    pair = "".join(c * 2 for c in f"{block}\n{block}")
    whole = "Ο λογαριασμός σας συνοπτικά\nΚατανάλωση Ηλεκτρικής Ενέργειας\n"
    for drop in ([("m1", pair), ("v1", whole + "123456789012"), ("v2", whole), ("u1", None)], [("m2", pair), ("v3", whole + "123456789012"), ("u2", None)]):
        spark.createDataFrame(drop, "doc_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_extract(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted((r.doc_id, r.block_no) for r in records_of_stream(spark, f"{tmp_path}/out").collect() if r.layout == "modern") == [("m1", 1)]
    assert sorted(r.doc_id for r in records_of_stream(spark, f"{tmp_path}/out").where("layout <> 'modern'").collect()) == ["v1", "v3"]
    rejects = sorted((r.batch, r.doc_id, r.block_no or 0, r.reject_reason) for r in rejects_of_stream(spark, f"{tmp_path}/out").collect())
    assert rejects == [(0, "m1", 2, "duplicate"), (0, "u1", 0, "no text"), (0, "v2", 0, "no supply number"), (1, "m2", 1, "duplicate"), (1, "m2", 2, "duplicate"), (1, "u2", 0, "no text")]
    assert shuffled == [{"modern"}, {"modern"}]
