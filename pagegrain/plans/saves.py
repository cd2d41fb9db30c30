"""Queries of saves by timer and barrier: events as commands of editors, a minute of an event's time being a millisecond."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import saves
from .catalog import query
from .views import table

PART = 10_000


def log(k: SparkSession, d: str) -> DataFrame:
    """Purchases are barriers, some of them for all pages; other events edit one of fifteen objects."""
    e, barrier = F.col("event_id"), F.col("event_type") == "purchase"
    page = F.when(~barrier | (e % 4 > 0), e % 3)
    return table(k, d, "events").select(F.col("user_id").alias("editor"), F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("at"), e.alias("seq"), page.alias("page"), F.when(~barrier, e % 3 * 10 + e % 5).alias("object"), (e % 6 == 0).alias("refused"))


SENT = """WITH e AS (SELECT user_id AS editor, epoch_us(ts) // 60000000 AS "at", event_id AS seq, CASE WHEN event_type <> 'purchase' OR event_id % 4 > 0 THEN event_id % 3 END AS page, CASE WHEN event_type <> 'purchase' THEN event_id % 3 * 10 + event_id % 5 END AS object, event_id % 6 = 0 AS refused FROM events),
n AS (SELECT *, lead("at") OVER (PARTITION BY editor ORDER BY "at", seq) AS following FROM e),
f AS (SELECT editor, "at" + 800 AS "at", 0 AS rank, seq, CAST(NULL AS BIGINT) AS page, 'timer' AS cause FROM n WHERE object IS NOT NULL AND (following IS NULL OR following >= "at" + 800) UNION ALL SELECT editor, "at", 1, seq, page, 'barrier' FROM e WHERE object IS NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY editor ORDER BY "at", rank, seq) AS k FROM f),
r AS (SELECT e.editor, e.page, e.object, e.seq, e."at", e.refused, min(g.k) AS k FROM e JOIN g ON e.editor = g.editor AND (g.page IS NULL OR g.page = e.page) AND (g."at" > e."at" OR g."at" = e."at" AND g.rank = 1 AND g.seq > e.seq) WHERE e.object IS NOT NULL GROUP BY ALL),
p AS (SELECT editor, page, object, k, max_by(seq, ("at", seq)) AS edit, max_by(refused, ("at", seq)) AS refused FROM r GROUP BY ALL),
b AS (SELECT p.editor, p.page, p.object, min(t.k) AS k FROM p JOIN g ON p.editor = g.editor AND p.k = g.k JOIN g t ON t.editor = p.editor AND (t.page IS NULL OR t.page = p.page) AND t."at" >= g."at" + 120 WHERE p.refused GROUP BY p.editor, p.page, p.object, p.k),
a AS (SELECT DISTINCT * FROM b ANTI JOIN p USING (editor, page, object, k)),
w AS (SELECT a.editor, a.page, a.object, a.k, max_by(e.seq, (e."at", e.seq)) AS edit FROM a JOIN g ON a.editor = g.editor AND a.k = g.k JOIN e ON e.editor = a.editor AND e.object = a.object AND (e."at" < g."at" OR e."at" = g."at" AND g.rank = 1 AND e.seq < g.seq) GROUP BY ALL),
s AS (SELECT editor, page, object, k, edit, false AS again, refused FROM p UNION ALL SELECT editor, page, object, k, edit, true, false FROM w),
sent AS (SELECT s.editor, s.page, s.object, g."at" AS flush_at, g.rank, g.cause, g.seq AS flush_seq, s.edit, s.again, s.refused FROM s JOIN g ON s.editor = g.editor AND s.k = g.k)
"""
query("edit_saves", lambda k, d: saves.saves(log(k, d), part=PART), SENT + "SELECT * EXCLUDE (rank) FROM sent")
query("edit_barriers", lambda k, d: saves.barriers(log(k, d), part=PART), SENT + """SELECT e.editor, e.seq, e."at", count(s.edit) AS sent, count(*) FILTER (WHERE s.refused) AS refused, count(*) FILTER (WHERE s.refused) = 0 AS passed, e."at" + CASE WHEN count(s.edit) > 0 THEN 120 ELSE 0 END AS done_at
FROM e LEFT JOIN sent s ON s.editor = e.editor AND s.cause = 'barrier' AND s.flush_seq = e.seq WHERE e.object IS NULL GROUP BY e.editor, e.seq, e."at" """)
query("edits_left_dirty", lambda k, d: saves.still_dirty(log(k, d), part=PART), SENT + """SELECT l.editor, l.object, l.edit FROM (SELECT editor, object, max_by(seq, ("at", seq)) AS edit FROM e WHERE object IS NOT NULL GROUP BY ALL) l
LEFT JOIN (SELECT editor, object, max_by(edit, (flush_at, rank, flush_seq)) AS edit, max_by(refused, (flush_at, rank, flush_seq)) AS refused FROM sent GROUP BY ALL) t ON t.editor = l.editor AND t.object = l.object WHERE t.edit IS NULL OR t.edit <> l.edit OR t.refused""")
