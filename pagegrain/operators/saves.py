"""Saves of edited texts: a timer for all of an editor's objects, barriers, and edits that the server refuses.

A log has the commands of editors (editor, at in ms, seq, page, object, refused).  A row with an
object is an edit of it, one without is a barrier: something that first wants a page's edits saved (all pages' if
page is null).

* An edit makes its object dirty and starts the editor's one timer anew.  `wait` after the last
  edit all dirty objects are sent together, each with its latest edit.
* A barrier sends the dirty objects of its page at once and stops the timer: what other pages still hold
  waits for the next edit's timer or another barrier.
* Answers come `reply` after a flush.  The first time an edit is sent it is refused if its
  row says so; its object is dirty again then, with whatever its latest edit is, without a timer.
* At one time answers come first, then the timer, then commands by seq.

Everything an edit needs is the next flush that covers its page, so windows look for that one.  They are cut into
parts of `part` ms, whose first marks are looked up where a part has none left: a busy editor is many groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import held
from .parts import nearest

WAIT, REPLY, PART = 800, 120, 600_000
ANSWER, TIMER, COMMAND = -1, 0, 1  # what comes first at one time


def flushes(log: DataFrame, wait: int = WAIT, part: int = PART) -> DataFrame:
    """editor, at, rank, seq, page, cause: when dirty objects are sent.  A timer's flush has the seq of the edit
    that started it and no page; it doesn't come if another command does within `wait`."""
    rows = log.select("editor", "at", F.lit(COMMAND).alias("rank"), "seq", "page", "object")
    marks = rows.select("editor", "at", "rank", "seq", F.struct("at").alias("mark"))
    timed = nearest(rows.where("object is not null"), marks, ["editor"], part, True)
    timed = timed.where(F.col("mark").isNull() | (F.col("mark.at") >= F.col("at") + wait))
    timed = timed.select("editor", (F.col("at") + wait).alias("at"), F.lit(TIMER).alias("rank"), "seq", F.lit(None).cast(log.schema["page"].dataType).alias("page"), F.lit("timer").alias("cause"))
    return timed.union(rows.where("object is null").select("editor", "at", "rank", "seq", "page", F.lit("barrier").alias("cause")))


def _next_flush(rows: DataFrame, sent: DataFrame, part: int) -> DataFrame:
    """rows (editor, page, place, ..) with `flush`, the next one that covers their page."""
    mark = F.struct("at", "rank", "seq", "cause").alias("mark")
    every = nearest(rows, sent.where("page is null").select("editor", "at", "rank", "seq", mark), ["editor"], part, True).withColumnRenamed("mark", "every")
    own = nearest(held(every), sent.where("page is not null").select("editor", "page", "at", "rank", "seq", mark), ["editor", "page"], part, True)
    return own.withColumn("flush", F.least("every", "mark")).drop("every", "mark")  # structs compare by place; a null one is left out


def saves(log: DataFrame, wait: int = WAIT, reply: int = REPLY, part: int = PART) -> DataFrame:
    """editor, page, object, flush_at, cause, flush_seq, edit, again, refused: each object that a flush sends, with the seq of
    the edit whose text it carries; again: that text was sent before.

    Rows without an editor, time or seq are left out; an object keeps its page; repeated rows
    must differ in seq.  An edit after which no flush covers its page isn't sent."""
    if reply <= 0:
        raise ValueError("answers take a positive time")
    log = log.where("editor is not null and at is not null and seq is not null")
    sent = held(flushes(log, wait, part))
    edits = log.where("object is not null").select("editor", "page", "object", "at", F.lit(COMMAND).alias("rank"), "seq", F.coalesce("refused", F.lit(False)).alias("refused"))
    reached = _next_flush(edits, sent, part).where("flush is not null")
    last = F.struct("at", "seq", "refused")
    first = reached.groupBy("editor", "page", "object", "flush").agg(F.max(last).alias("last"))
    first = held(first.select("editor", "page", "object", "flush", F.col("last.seq").alias("edit"), "last.refused"))
    back = first.where("refused").select("editor", "page", "object", (F.col("flush.at") + reply).alias("at"), F.lit(ANSWER).alias("rank"), F.col("flush.seq").alias("seq"))
    retried = _next_flush(back, sent, part).where("flush is not null").select("editor", "page", "object", "flush").distinct()
    retried = held(retried.join(first, ["editor", "object", "page", "flush"], "left_anti"))
    # the latest edit is the one that the object's latest flush before has sent
    marks = first.select("editor", "object", "flush.at", "flush.rank", "flush.seq", F.struct("edit").alias("mark"))
    retried = nearest(retried.select("editor", "page", "object", "flush", "flush.at", "flush.rank", "flush.seq"), marks, ["editor", "object"], part, False)
    retried = retried.select("editor", "page", "object", "flush", F.col("mark.edit").alias("edit"), F.lit(False).alias("refused"))
    both = first.withColumn("again", F.lit(False)).unionByName(retried.withColumn("again", F.lit(True)))
    return both.select("editor", "page", "object", F.col("flush.at").alias("flush_at"), "flush.cause", F.col("flush.seq").alias("flush_seq"), "edit", "again", "refused")


def barriers(log: DataFrame, wait: int = WAIT, reply: int = REPLY, part: int = PART) -> DataFrame:
    """editor, seq, at, sent, refused, passed, done_at: how many objects a barrier sent and had refused; what waits for it goes on
    only if none was, once the answers are there."""
    tries = saves(log, wait, reply, part).where("cause = 'barrier'").groupBy("editor", F.col("flush_seq").alias("seq")).agg(F.count("*").alias("sent"), F.count_if("refused").alias("refused"))
    found = log.where("editor is not null and at is not null and seq is not null and object is null").select("editor", "seq", "at").join(tries, ["editor", "seq"], "left")
    sent, refused = (F.coalesce(c, F.lit(0).cast("long")) for c in ("sent", "refused"))
    return found.select("editor", "seq", "at", sent.alias("sent"), refused.alias("refused"), (refused == 0).alias("passed"), (F.col("at") + F.when(sent > 0, reply).otherwise(0)).alias("done_at"))


def still_dirty(log: DataFrame, wait: int = WAIT, reply: int = REPLY, part: int = PART) -> DataFrame:
    """editor, object, edit: objects whose latest edit no flush has sent, or which were refused and not sent since."""
    log = log.where("editor is not null and at is not null and seq is not null")
    latest = log.where("object is not null").groupBy("editor", "object").agg(F.max_by("seq", F.struct("at", "seq")).alias("edit"))
    tries = saves(log, wait, reply, part).groupBy("editor", "object").agg(F.max_by(F.struct("edit", "refused"), F.struct("flush_at", "flush_seq")).alias("last"))
    return latest.join(tries, ["editor", "object"], "left").where(F.col("last").isNull() | (F.col("last.edit") != F.col("edit")) | F.col("last.refused")).select("editor", "object", "edit")

