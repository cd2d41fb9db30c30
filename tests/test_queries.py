"""Every query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import math
from pathlib import Path

import duckdb
import pytest

from pagegrain.operators import spatial
from pagegrain.plans import views
from pagegrain.plans.queries import ORACLE, QUERIES
from pagegrain.streaming.edits import debounce

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, oracle, name):
    cur = oracle.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert got == want


def test_suppress(spark):
    rows = views.box(spark, SF).collect()
    want = set()
    for page in {r.page_id for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r.page_id == page), key=lambda r: (-r.confidence, r.box_index)):
            size = (r.x2 - r.x1) * (r.y2 - r.y1)
            for k in kept:
                both = max(0, min(r.x2, k.x2) - max(r.x1, k.x1)) * max(0, min(r.y2, k.y2) - max(r.y1, k.y1))
                if both > 0.3 * (size + (k.x2 - k.x1) * (k.y2 - k.y1) - both):
                    break
            else:
                kept.append(r)
        want |= {(page, r.box_index) for r in kept}
    assert {tuple(r) for r in QUERIES["nms"](spark, SF).collect()} == want


def test_heavy_overlap_needs_one_kind(spark):
    rows = spark.createDataFrame([(1, 0, "text", 0, 0, 10, 10), (1, 1, "text", 0, 0, 10, 10), (1, 2, "bubble", 0, 0, 10, 10), (2, 3, "text", 0, 0, 10, 10)], "page_id long, box_index int, kind string, x1 int, y1 int, x2 int, y2 int")
    assert [(r.a_index, r.b_index, r.iou) for r in spatial.heavy_overlaps(rows).collect()] == [(0, 1, 1.0)]


def test_debounced_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id", "value", "event_id")
    last = events.agg({"ts": "max"}).first()[0]
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    spark.createDataFrame([(last.replace(year=last.year + 1), -1, 0.0, -1)], events.schema).coalesce(1).write.mode("append").parquet(src)
    stream = debounce(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src), late="40 days")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("bursts").collect() if r.user_id != -1}
    want = {tuple(r) for r in debounce(events).collect()}
    assert got and got <= want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
