"""Saves by timer and barrier: table and stream against a plain replay."""

import random

import pytest

from pagegrain.operators import saves
from pagegrain.plans import saves as plans
from pagegrain.streaming.saves import Editor
from pagegrain.streaming.saves import saves as streamed

SF = "/root/testdata/sf0.001"


def replay(log, wait=800, reply=120):
    """One editor after the other, millisecond events in a sorted agenda."""
    out, dirty_at_end = set(), set()
    for editor in {r[0] for r in log}:
        todo = sorted((r[1], 1, r[2], "command", r) for r in log if r[0] == editor)
        dirty, current, sent, timer = {}, {}, set(), None
        while todo or timer is not None:
            if timer is not None and (not todo or (timer[0], 0) < (todo[0][0], todo[0][1])):
                at, rank, seq, what, r = timer[0], 0, timer[1], "timer", None
            else:
                at, rank, seq, what, r = todo.pop(0)
            if what == "answer":
                o, refused = r
                if refused:
                    dirty[o] = current[o]
                continue
            if what == "command" and r[4] is not None:
                current[r[4]] = r
                dirty[r[4]] = r
                timer = (at + wait, seq)
                continue
            page, timer = (None if what == "timer" else r[3]), None
            for o in [o for o, e in dirty.items() if page is None or e[3] == page]:
                e = dirty.pop(o)
                again = e in sent
                refused = e[5] and not again
                sent.add(e)
                out.add((editor, e[3], o, at, "timer" if what == "timer" else "barrier", seq, e[2], again, refused))
                todo.append((at + reply, -1, seq, "answer", (o, refused)))
            todo.sort(key=lambda t: t[:3])
        dirty_at_end |= {(editor, o, e[2]) for o, e in dirty.items()}
    return out, dirty_at_end


@pytest.fixture(scope="module")
def log():
    rng = random.Random(2)
    rows = []
    for editor in range(6):
        at = 0
        for _ in range(150 if editor else 900):  # one editor has most
            at += rng.choice((0, 1, 50, 119, 120, 121, 300, 799, 800, 801, 1500))
            page = rng.randrange(3)
            if rng.random() < 0.2:
                rows.append((editor, at, len(rows), rng.choice((None, page)), None, None))
            else:
                rows.append((editor, at, len(rows), page, page * 10 + rng.randrange(3), rng.random() < 0.3))
    return rows


SCHEMA = "editor long, at long, seq long, page long, object long, refused boolean"


@pytest.mark.parametrize("part", [900, 7_000, 600_000])
def test_saves_equal_replay(spark, log, part):
    odd = [(None, 1, 1, 1, 1, False), (1, None, 2, 1, 1, False), (1, 5, None, 1, 1, False)]
    table = spark.createDataFrame(log + odd, SCHEMA).repartition(5)
    sent, left = replay(log)
    assert any(r[7] for r in sent) and any(r[8] for r in sent) and left
    assert {tuple(r) for r in saves.saves(table, part=part).collect()} == sent
    assert {tuple(r) for r in saves.still_dirty(table, part=part).collect()} == left


def test_barriers(spark, log):
    got = {(r.editor, r.seq): r for r in saves.barriers(spark.createDataFrame(log, SCHEMA), part=9_000).collect()}
    sent, _ = replay(log)
    assert set(got) == {(r[0], r[2]) for r in log if r[4] is None}
    for (editor, seq), r in got.items():
        own = [s for s in sent if s[0] == editor and s[5] == seq and s[4] == "barrier"]
        assert (r.sent, r.refused, r.passed) == (len(own), sum(s[8] for s in own), not any(s[8] for s in own))
        assert r.done_at == r.at + (120 if own else 0)


def test_saves_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert saves.saves(none).count() == saves.barriers(none).count() == saves.still_dirty(none).count() == 0
    with pytest.raises(ValueError):
        saves.saves(none, reply=0)


def test_state_forgets_what_is_saved():
    e = Editor(None, 800, 120)
    assert len(list(e.advance([(0, 1, 1, 7, False)], 10))) == 0 and e.due() == 800
    assert [r[5] for r in e.advance([], 900)] == [1] and e.due() == 920
    list(e.advance([], 1000))
    assert e.held() is None


def test_stream_equals_table(spark, tmp_path):
    rows = plans.log(spark, SF).where("editor < 40")
    src = str(tmp_path / "in")
    ordered = rows.orderBy("at", "seq").collect()
    for i in range(3):  # three files in order of time
        some = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(some, rows.schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(-1, ordered[-1]["at"] + 1_000_000, -1, None, None, False)], rows.schema).coalesce(1).write.mode("append").parquet(src)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = streamed(stream, late="2 seconds").writeStream.format("memory").queryName("edit_saves").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(provider)
    got = [tuple(r) for r in spark.table("edit_saves").collect()]
    want, _ = replay([tuple(r) for r in ordered])
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_in_parts_equal_whole_ones(spark):
    """A key's edits cut into many parts, null keys and times of one among them, give what one part gives."""
    from pyspark.sql import functions as F

    from pagegrain.operators import manifest

    rng = random.Random(3)
    rows = [(rng.choice((1, 1, 1, 2, None)), 1_700_000_000 + i // 2 * rng.choice((0, 1, 50)), i, rng.choice(("a", "b", None)), rng.random()) for i in range(600)]
    edits = spark.createDataFrame(rows, "user_id long, t long, event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
    whole, some = 1 << 60, 40_000_000
    for run in (
        lambda p: manifest.debounced(edits, "user_id", 20_000, p),
        lambda p: manifest.changes_only(edits, "user_id", "event_type", p),
        lambda p: manifest.stale(edits, "user_id", F.unix_micros("ts") - 30_000_000, p),
        lambda p: manifest.accumulated(edits, "user_id", p),
        lambda p: manifest.geometry_saves(edits, "user_id", "t", "event_id", 10, F.col("event_id") % 30, p // 1_000_000),
    ):
        assert sorted(map(tuple, run(some).collect()), key=str) == sorted(map(tuple, run(whole).collect()), key=str)
