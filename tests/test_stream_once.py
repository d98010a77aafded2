"""A stream's batch meets its own duplicates and the earlier keys by one shuffle; frequent keys are split and give the same."""

import pytest

from invoicelines import streaming
from invoicelines.streaming import records_of_stream, rejects_of_stream, stream_extract


@pytest.mark.parametrize("frequent, shuffles", [(50_000, 1), (2, 2)])
def test_earlier_keys_and_duplicates_meet_once(spark, tmp_path, monkeypatch, frequent, shuffles):
    plans, plain = [], streaming.flag_repeated

    def flagged(df, *a):
        out = plain(df, *a)
        plans.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return out

    monkeypatch.setattr(streaming, "flag_repeated", flagged)
    monkeypatch.setattr(streaming, "FREQUENT", frequent)
    block = lambda k: f"1000000001 00000000{k} 01/02/2020 02.01.2020-01.02.2020  ANNA  STREET  ATHENS\nΦΟΠ Τιμολόγιο\n5 4 1 1"
    text = lambda *ks: "".join(c * 2 for c in "\n".join(map(block, ks)))
    drops = [[("a", text(2, 2, 3)), ("b", text(3, 2)), ("u", None)], [("c", text(2, 4, 2, 4)), ("d", text(4, 5))], [("e", None)]]
    for drop in drops:
        spark.createDataFrame(drop, "doc_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_extract(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted((r.doc_id, r.block_no, r.account_no[-1]) for r in records_of_stream(spark, f"{tmp_path}/out").collect()) == [("a", 1, "2"), ("a", 3, "3"), ("c", 2, "4"), ("d", 2, "5")]
    rejects = sorted((r.batch, r.doc_id, r.block_no or 0, r.reject_reason) for r in rejects_of_stream(spark, f"{tmp_path}/out").collect())
    duplicates = [(0, "a", 2), (0, "b", 1), (0, "b", 2), (1, "c", 1), (1, "c", 3), (1, "c", 4), (1, "d", 1)]
    assert rejects == sorted([(*d, "duplicate") for d in duplicates] + [(0, "u", 0, "no text"), (2, "e", 0, "no text")])
    assert plans[:2] == [shuffles, shuffles]


def test_rows_that_cannot_repeat_are_written_once(spark, tmp_path):
    whole = "Ο λογαριασμός σας συνοπτικά\nΚατανάλωση Ηλεκτρικής Ενέργειας\n"
    spark.createDataFrame([("v", whole + "123456789012"), ("w", whole), ("m", "x")], "doc_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    block = "1000000001 000000002 01/02/2020 02.01.2020-01.02.2020  ANNA  STREET  ATHENS\nΦΟΠ Τιμολόγιο\n5 4 1 1"
    for text in (None, "".join(c * 2 for c in block)):
        if text:
            spark.createDataFrame([("n", text)], "doc_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_extract(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert not (tmp_path / "out/work").exists()  # parsed rows go to the stream's own table at once
    assert sorted(r.doc_id for r in records_of_stream(spark, f"{tmp_path}/out").collect()) == ["n", "v"]
    assert [(r.doc_id, r.reject_reason) for r in rejects_of_stream(spark, f"{tmp_path}/out").collect()] == [("w", "no supply number")]
    assert not list(tmp_path.glob("out/rows/*/output=open"))
