"""Saves of edited texts as a stream: the rules of operators.saves with a timer of Spark's for each editor.

Commands may come late by the watermark; they wait in the state until it has passed them, so that the result is that of
the whole log.  An editor's state holds these, its dirty objects, and those whose answers are on the way: what is saved
is forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.saves import ANSWER, COMMAND, REPLY, TIMER, WAIT

OUT = "editor long, page long, object long, flush_at long, cause string, flush_seq long, edit long, again boolean, refused boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]


class Editor:
    """An editor's dirty objects, timer and answers on the way; `held` is its JSON form."""

    def __init__(self, held: str | None, wait: int, reply: int):
        self.wait, self.reply = wait, reply
        got = json.loads(held) if held else {}
        self.timer = got.get("timer")  # [at, seq]
        self.objects = {int(o): x for o, x in got.get("objects", {}).items()}  # page, edit, dirty, sent, refused
        self.answers = got.get("answers", [])  # [at, seq, object, refused]

    def held(self) -> str | None:
        if not (self.timer or self.objects or self.answers):
            return None
        return json.dumps({"timer": self.timer, "objects": self.objects, "answers": self.answers})

    def due(self) -> int | None:
        return min([a[0] for a in self.answers] + ([self.timer[0]] if self.timer else []), default=None)

    def flush(self, at: int, seq: int, cause: str, page: int | None) -> Iterator[tuple]:
        self.timer = None
        for o in sorted(self.objects):
            x = self.objects[o]
            if x["dirty"] and (page is None or x["page"] == page):
                refused = x["refused"] and not x["sent"]
                yield x["page"], o, at, cause, seq, x["edit"], x["sent"], refused
                x["dirty"], x["sent"] = False, True
                self.answers.append([at + self.reply, seq, o, refused])

    def answer(self, o: int, refused: bool) -> None:
        x = self.objects[o]
        x["dirty"] = x["dirty"] or refused
        if not x["dirty"] and all(a[2] != o for a in self.answers):
            del self.objects[o]

    def advance(self, commands: list[tuple], until: int) -> Iterator[tuple]:
        """What happens before `until`, of commands (at, seq, page, object, refused) in order."""
        commands = commands[::-1]
        while True:
            steps = [(a[0], ANSWER, a[1], a[2]) for a in self.answers]
            steps += [(self.timer[0], TIMER, self.timer[1], 0)] if self.timer else []
            steps += [(commands[-1][0], COMMAND, commands[-1][1], 0)] if commands else []
            if not steps or min(steps)[0] >= until:
                return
            at, rank, seq, o = min(steps)
            if rank == ANSWER:
                one = next(a for a in self.answers if (a[0], a[1], a[2]) == (at, seq, o))
                self.answers.remove(one)
                self.answer(o, one[3])
            elif rank == TIMER:
                yield from self.flush(at, seq, "timer", None)
            else:
                _, _, page, o, refused = commands.pop()
                if o is None:
                    yield from self.flush(at, seq, "barrier", page)
                else:
                    self.objects[o] = {"page": page, "edit": seq, "dirty": True, "sent": False, "refused": refused}
                    self.timer = [at + self.wait, seq]


class Saves(StatefulProcessor):
    def __init__(self, wait: int, reply: int):
        self.wait, self.reply = wait, reply

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at long, seq long, page long, object long, refused boolean")
        self.state = handle.getValueState("editor", "held string")

    def _advance(self, key: tuple, fresh: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted([*self.log.get(), *fresh], key=lambda r: (r[0], r[1])) if self.log.exists() else sorted(fresh, key=lambda r: (r[0], r[1]))
        editor = Editor(self.state.get()[0] if self.state.exists() else None, self.wait, self.reply)
        ripe = [tuple(r) for r in waiting if r[0] < watermark]
        rest = [tuple(r) for r in waiting[len(ripe) :]]
        rows = [(key[0], *r) for r in editor.advance(ripe, watermark)]
        self.log.put(rest) if rest else self.log.clear()
        held = editor.held()
        self.state.update((held,)) if held else self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        due = min([r[0] for r in rest[:1]] + [editor.due()] * (editor.due() is not None), default=None)
        if due is not None:
            self.handle.registerTimer(max(due, watermark) + 1)
        yield pd.DataFrame(rows, columns=NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(r.at), int(r.seq), None if pd.isna(r.page) else int(r.page), None if pd.isna(r.object) else int(r.object), bool(r.refused)) for pdf in rows for r in pdf.itertuples(index=False)]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def saves(log: DataFrame, wait: int = WAIT, reply: int = REPLY, late: str = "10 seconds") -> DataFrame:
    """operators.saves of a stream (editor, at, seq, page, object, refused).  Its state needs the RocksDB provider
    (spark.sql.streaming.stateStore.providerClass); edits later than the watermark are dropped by Spark."""
    timed = log.where("editor is not null and at is not null and seq is not null")
    timed = timed.select(F.col("editor").cast("long"), F.timestamp_millis("at").alias("ts"), *(F.col(c).cast("long") for c in ("at", "seq", "page", "object")), F.coalesce("refused", F.lit(False)).alias("refused"))
    timed = timed.withWatermark("ts", late)
    return timed.groupBy("editor").transformWithStateInPandas(Saves(wait, reply), OUT, "append", "eventtime")
