import pytest

from laplake.sources import messages
from laplake.streaming.features import run_available
from laplake.streaming.polls import END, PolledFeed, run_to_marker

SCHEMA = "session_key int, kind string, driver_number int, lap_number int, offset long, note string"


def _outcomes(job):
    return sorted((r["session_key"], r["kind"], r["driver_number"], r["offset"], r["outcome"]) for r in job.outcomes().collect())


def _batch(spark, *rows):
    return spark.createDataFrame([(*row, f"n{row[4]}") for row in rows], SCHEMA)


def test_every_message_is_a_row_a_repeat_or_late(spark, tmp_path):
    job = PolledFeed(spark, str(tmp_path / "out"))
    first = _batch(spark, (1, "pit", 4, 10, 1), (1, "pit", 4, 10, 2), (1, "lap", 4, 10, 3), (2, "pit", 4, 10, 4), (1, "pit", None, 1, 5))
    second = _batch(spark, (1, "pit", 4, 10, 6), (1, "pit", 5, 11, 7), (1, END, None, None, 8), (1, "pit", 5, 12, 9), (1, "pit", None, 1, 10))
    third = _batch(spark, (1, "pit", 6, 13, 11), (1, "pit", 4, 10, 12), (2, "pit", 4, 10, 13), (2, "pit", 6, 10, 14), (1, "lap", 9, 1, None))
    want = [(1, "lap", 4, 3, "row"), (1, "pit", 4, 1, "row"), (1, "pit", 4, 2, "repeat"), (1, "pit", 4, 6, "repeat"),
            (1, "pit", 5, 7, "row"), (1, "pit", 5, 9, "late"), (1, "pit", 4, 12, "late"), (1, "pit", 6, 11, "late"),
            (2, "pit", 4, 4, "row"), (2, "pit", 4, 13, "repeat"), (2, "pit", 6, 14, "row"), (1, "pit", None, 5, "row"),
            (1, "pit", None, 10, "late"), (1, "lap", 9, None, "row")]
    for number, batch in enumerate((first, second, third)):
        job.process(batch, number)
        job.process(batch, number)  # a retry replaces what it wrote
    found = [tuple(r[c] for c in ("session_key", "kind", "driver_number", "offset", "outcome")) for r in job.outcomes().collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    again = PolledFeed(spark, str(tmp_path / "out"))
    again.process(third, 2)
    assert again.rows.all().count() + again.side.all().count() == len(want)


def test_batches_without_rows(spark, tmp_path):
    job = PolledFeed(spark, str(tmp_path / "out"))
    job.process(_batch(spark, (1, "pit", 4, 10, 1)).limit(0), 0)
    job.process(_batch(spark, (1, END, None, None, 1)), 1)
    job.process(_batch(spark, (1, "pit", 4, 10, 2)), 2)
    assert _outcomes(job) == [(1, "pit", 4, 2, "late")]


def test_a_live_stream_stops_at_its_end_marker(spark, tmp_path):
    path = str(tmp_path / "in")
    job = PolledFeed(spark, str(tmp_path / "out"))
    for at, kind in enumerate(("lap", "pit", END, "lap")):
        _batch(spark, (1, kind, 1, at, at)).coalesce(1).write.mode("append").parquet(path)
    stream = messages.landed_stream(spark, path, _batch(spark, (1, "a", 1, 1, 1)).schema, files_per_trigger=1)
    query = run_to_marker(stream, str(tmp_path / "progress"), job.process, timeout=60)
    assert not query.isActive and query.exception() is None
    rows = len(_outcomes(job))
    assert rows >= 2 and job.ended.all().count() == 1
    run_available(stream, str(tmp_path / "progress"), job.process)
    assert [r[4] for r in _outcomes(job) if r[3] == 3] == ["late"]


def test_a_stream_that_fails_or_never_ends(spark, tmp_path):
    path = str(tmp_path / "in")
    _batch(spark, (1, "lap", 1, 1, 1)).coalesce(1).write.parquet(path)
    stream = messages.landed_stream(spark, path, _batch(spark, (1, "a", 1, 1, 1)).schema)

    def failing(batch, number):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        run_to_marker(stream, str(tmp_path / "p1"), failing, timeout=60)
    assert not run_to_marker(stream, str(tmp_path / "p2"), lambda batch, number: None, timeout=2).isActive
