"""Chapters, pages and edits: selection, overlays, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .held import held
from .parts import before, nearest, running

#: Keys of a style and their defaults.
STYLE = {"color": "auto", "font": "default", "fontSize": "auto", "bold": False, "strokeWidth": "auto", "strokeColor": "auto", "bgColor": "transparent", "cornerRadius": "0", "horizontalAlign": "center", "verticalAlign": "middle"}


def work_selection(pages: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested pages that exist and aren't skipped."""
    return pages.where("not skipped").join(requested, ["chapter_id", "page_index"], "left_semi").select("chapter_id", "page_index", "page_id")


def resume_page(pages: DataFrame) -> DataFrame:
    return pages.where("not skipped").groupBy("chapter_id").agg(F.min("page_index").alias("resume"))


def slice_labels(pages: DataFrame) -> DataFrame:
    total = F.count("*").over(Window.partitionBy("chapter_id"))
    return pages.select("page_id", F.format_string("%d/%d", F.col("page_index") + 1, total).alias("label"), F.format_string("page_%03d.png", F.col("page_index")).alias("file"))


def overlay(base: DataFrame, edits: DataFrame, key: list[str], value: str) -> DataFrame:
    """Upsert: an edit's value wins, rows of either side stay."""
    both = base.withColumnRenamed(value, "_base").join(edits.withColumnRenamed(value, "_edit"), key, "full_outer")
    return both.select(*key, F.coalesce("_edit", "_base").alias(value))


def three_way(snapshot: DataFrame, server: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """A local value wins only if it has changed since the snapshot."""
    rows = current.withColumnRenamed(value, "cur").join(snapshot.withColumnRenamed(value, "snap"), key).join(server.withColumnRenamed(value, "srv"), key)
    return rows.select(key, F.when(F.col("cur").eqNullSafe(F.col("snap")), F.col("srv")).otherwise(F.col("cur")).alias(value))


def fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A digest of the state that a commit must find unchanged."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("state"))


def guarded(snapshot: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, committed): whether work on a snapshot may be committed, since the state is still the same."""
    seen = fingerprint(snapshot, key, columns).withColumnRenamed("state", "seen")
    return seen.join(fingerprint(current, key, columns), key, "left").select(key, F.col("seen").eqNullSafe(F.col("state")).alias("committed"))


def write_back(boxes: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, box_index, written): whether a box still is where its text was read, and not removed."""
    corners = ["x1", "y1", "x2", "y2"]
    read = results.select("page_id", "box_index", *[F.col(c).alias(f"read_{c}") for c in corners])
    same = ~F.col("removed")
    for c in corners:
        same = same & F.col(c).eqNullSafe(F.col(f"read_{c}"))
    return boxes.join(read, ["page_id", "box_index"]).select("page_id", "box_index", same.alias("written"))


def failures(pages: DataFrame) -> DataFrame:
    """chapter_id, failed, message of each chapter with failed pages (page_index, error or null), for
    which all or some pages failed, with the first error."""
    got = pages.groupBy("chapter_id").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page_index", "error")))).alias("e")).where("failed > 0")
    which = F.array_join(F.transform("e", lambda x: x["page_index"].cast("string")), ", ")
    text = F.when(F.col("failed") == F.col("n"), F.concat(F.lit("all pages failed, first: "), F.col("e")[0]["error"])).otherwise(F.concat(F.lit("failed: "), which, F.lit("; first: "), F.col("e")[0]["error"]))
    return got.select("chapter_id", "failed", text.alias("message"))


PART = 86_400_000_000  # microseconds of a key's edits that are one group


def _timed(edits: DataFrame, key: str, *columns: str) -> DataFrame:
    """edits as key, at in microseconds, seq and columns."""
    return edits.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(0).alias("rank"), F.col("event_id").alias("seq"), *columns)


def debounced(edits: DataFrame, key: str, gap_ms: int, part: int = PART) -> DataFrame:
    """The last value of each burst of edits with gaps of under gap_ms."""
    rows = before(_timed(edits, key, "value"), ["key"], F.struct("at"), part)
    new = F.coalesce((F.col("at") - F.col("mark.at") >= gap_ms * 1000).cast("int"), F.lit(1))
    burst = running(rows.select("key", "at", "seq", "value", new.alias("new")), ["key"], F.col("new"), "burst", part)
    return burst.groupBy(F.col("key").alias(key), "burst").agg(F.max_by("value", F.struct("at", "seq")).alias("value"), F.count("*").alias("n"))


def changes_only(edits: DataFrame, key: str, value: str, part: int = PART) -> DataFrame:
    """Checkpoints without those that repeat the one before."""
    rows = before(_timed(edits, key, F.col(value).alias("value")), ["key"], F.struct("value"), part)
    kept = rows.where(~F.col("value").eqNullSafe(F.col("mark.value")) | F.col("mark.value").isNull())
    return kept.select(F.col("key").alias(key), F.col("seq").alias("event_id"), F.col("value").alias(value))


def stale(edits: DataFrame, key: str, began: Column, part: int = PART) -> DataFrame:
    """Optimistic commits: one is stale if the state changed (another edit of its key) after its work began."""
    rows = before(_timed(edits, key, began.alias("began")), ["key"], F.struct("at"), part)
    told = running(rows.select("key", "at", "seq", "began", F.col("mark.at").alias("last")), ["key"], F.lit(1), "version", part)
    return told.select(F.col("key").alias(key), F.col("seq").alias("event_id"), F.col("version").cast("int").alias("version"), F.coalesce(F.col("last") > F.col("began"), F.lit(False)).alias("stale"))


def accumulated(edits: DataFrame, key: str, part: int = PART) -> DataFrame:
    """A running maximum since the last reset; each tenth event resets."""
    rows = running(_timed(edits, key, "value"), ["key"], (F.col("seq") % 10 == 0).cast("int"), "epoch", part)
    told = running(rows, ["key", "epoch"], F.col("value"), "mask", part, F.max)
    return told.select(F.col("key").alias(key), F.col("seq").alias("event_id"), "mask")


def public_view(chapters: DataFrame) -> DataFrame:
    """Chapters as clients see them: links instead of paths, boxes without masks.
    chapters: chapter_id, pages array<struct<original, clean, boxes array<struct<.., mask>>, ..>>."""

    def shown(page, i):
        link = lambda kind: F.concat(F.lit("/api/image/"), F.col("chapter_id").cast("string"), F.lit("/"), i.cast("string"), F.lit(f"/{kind}"))
        clean = F.when(page["clean"].isNotNull(), link("clean"))
        return page.withField("original", link("original")).withField("clean", clean).withField("boxes", F.transform(page["boxes"], lambda b: b.dropFields("mask")))

    return chapters.withColumn("pages", F.transform("pages", shown))


def normal_region(w: int, h: int, least: int = 10) -> dict[str, Column]:
    """Corners cut at the image and put in order; ok says whether both sides are at least so long."""
    cut = {c: F.greatest(F.lit(0), F.least(F.col(c), F.lit(w if c[0] == "x" else h))) for c in ("x1", "y1", "x2", "y2")}
    out = {f"n{c}{i}": f(cut[f"{c}1"], cut[f"{c}2"]) for c in "xy" for i, f in ((1, F.least), (2, F.greatest))}
    return {**out, "ok": (out["nx2"] - out["nx1"] >= least) & (out["ny2"] - out["ny1"] >= least)}


def edit_violation(boxes: DataFrame, w: int, h: int, least: int = 10) -> DataFrame:
    """The first rule that an edited box breaks; boxes that break none are left out."""
    c = F.col
    rule = F.when((c("x1") < 0) | (c("y1") < 0), "negative").when((c("x1") >= c("x2")) | (c("y1") >= c("y2")), "reversed").when((c("x2") > w) | (c("y2") > h), "beyond image").when((c("x2") - c("x1") < least) | (c("y2") - c("y1") < least), "too small")
    return boxes.withColumn("violation", rule).where("violation is not null").select("page_id", "box_index", "violation")


def styles(objects: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Each object's style: the request's value, else the stored one, else the default.  A requested empty
    translation counts as none; other empty values count.  Objects left without a translation are dropped."""
    ask = requested.select(key, F.col("translation").alias("_translation"), *[F.col(c).alias(f"_{c}") for c in STYLE if c in requested.columns])
    both = objects.join(ask, key, "left")
    text = F.coalesce(F.nullif(F.col("_translation"), F.lit("")), F.col("translation"))
    chosen = [F.coalesce(*[F.col(x) for x in (f"_{c}", c) if x in both.columns], F.lit(default)).alias(c) for c, default in STYLE.items()]
    return both.select(key, text.alias("translation"), *chosen).where(F.trim("translation") != "")


def sanitised(objects: DataFrame, key: str) -> DataFrame:
    """A style's known keys over the defaults, with an error where an alignment is none of the allowed ones.
    objects: key, style map<string, string>."""
    known = [F.coalesce(F.col("style")[c], F.lit(str(d).lower() if isinstance(d, bool) else d)).alias(c) for c, d in STYLE.items()]
    strange = F.exists(F.map_keys("style"), lambda k: ~k.isin(*STYLE))
    error = F.when(strange, "unknown key").when(~F.coalesce(F.col("style")["horizontalAlign"], F.lit("center")).isin("left", "center", "right"), "horizontalAlign").when(~F.coalesce(F.col("style")["verticalAlign"], F.lit("middle")).isin("top", "middle", "bottom"), "verticalAlign")
    return objects.select(key, *known, error.alias("error"))


def render_candidates(requested: DataFrame, drafts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes to render: requested ones and those whose draft has a text, if they exist and aren't removed.
    Drafts are keyed by `page_box`; other keys are no boxes."""
    parts = F.split("draft_key", "_")
    of = lambda i: F.expr(f"try_cast(split(draft_key, '_')[{i}] as bigint)")
    drafted = drafts.where((F.size(parts) == 2) & (F.coalesce(F.col("text"), F.lit("")) != "")).select(of(0).alias("page_id"), of(1).alias("box_index"))
    asked = requested.select("page_id", F.expr("try_cast(box_key as bigint)").alias("box_index"))
    keys = asked.union(drafted).dropna().distinct()
    return boxes.where("not removed").select("page_id", "box_index").join(keys, ["page_id", "box_index"], "left_semi")


def page_drafts(drafts: Column, page: Column) -> Column:
    """The entries of a map of drafts that belong to a page."""
    return F.map_filter(drafts, lambda k, v: k.startswith(F.concat(page.cast("string"), F.lit("_"))))


def cached_text(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Whether a text read before, in the same language and not empty, is used again, and the text."""
    both = texts.join(cache.select(key, F.col("ocr_text").alias("_text"), F.col("ocr_lang").alias("_lang")), key, "left")
    hit = F.coalesce((F.col("_lang") == F.col("lang")) & (F.col("_text") != ""), F.lit(False))
    return both.select(key, hit.alias("hit"), F.when(hit, F.col("_text")).otherwise(F.col("text")).alias("text"))


def stage(pages: DataFrame) -> DataFrame:
    """Where a chapter stands if it holds no checkpoint: editor once a page is rendered, review once one is clean."""
    got = pages.groupBy("chapter_id").agg(F.bool_or("rendered").alias("r"), F.bool_or(F.col("clean").isNotNull()).alias("c"))
    return got.select("chapter_id", F.when(F.col("r"), "editor").when(F.col("c"), "review").otherwise("preview").alias("stage"))


def save_status(states: DataFrame, key: str) -> DataFrame:
    return states.groupBy(key).agg(F.when(F.bool_or("error"), "error").when(F.sum("saving") > 0, "saving").when(F.sum("dirty") > 0, "dirty").otherwise("saved").alias("status"))


def served_file(kind: Column, original: Column, clean: Column, rendered: Column) -> Column:
    """The file behind a request; a rendered page falls back to the clean and the original one."""
    return F.when(kind == "original", original).when(kind == "clean", clean).when(kind == "rendered", F.coalesce(rendered, clean, original))


def synced_file(rendered: Column, clean: Column, original: Column) -> Column:
    """What is copied to the output folder: nothing for a rendered page, else the clean file or the original."""
    return F.when(~F.coalesce(rendered, F.lit(False)), F.coalesce(clean, original))


def without(boxes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deleted boxes stay as tombstones, so that indices don't move."""
    gone = deleted.select("page_id", "box_index", F.lit(True).alias("_gone")).distinct()
    return boxes.join(gone, ["page_id", "box_index"], "left").withColumn("removed", F.col("removed") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def is_rendered(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """A page stays rendered only if nothing on it was edited after rendering."""
    last = edits.groupBy("page_id").agg(F.max("at").alias("_last"))
    return pages.join(last, "page_id", "left").select("page_id", (F.col("rendered_at").isNotNull() & F.coalesce(F.col("rendered_at") > F.col("_last"), F.lit(True))).alias("rendered"))


def keep_manual(detected: DataFrame, existing: DataFrame) -> DataFrame:
    """New boxes, with those that were drawn by hand before."""
    return detected.unionByName(existing.where("manual").select(*detected.columns))


def accept_uploads(files: DataFrame, most: int = 300, total: int = 500 << 20) -> DataFrame:
    """(chapter_id, refused): the request guard: at least one file, not too many, not too large together."""
    got = files.groupBy("chapter_id").agg(F.count("name").alias("n"), F.sum("size").alias("bytes"))
    return got.select("chapter_id", F.when(F.col("n") == 0, "no file").when(F.col("n") > most, "too many files").when(F.col("bytes") > total, "too large").alias("refused"))


def geometry_saves(edits: DataFrame, key: str, at: str, order: str, wait: int = 300, reply: Column | int = 0, part: int = PART // 1000) -> DataFrame:
    """The saves of a debounced geometry: (key, order, generation, aborted, cleared).

    A save is sent once no edit has come for `wait` after an edit, and answered `reply` later.  It is
    aborted if the next save is sent before that, and clears the object's dirty mark only if no
    edit came since, that is, if its generation (number of edits so far) is still the last."""
    rows = edits.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(0).alias("rank"), F.col(order).alias("seq"), (F.col(at) + wait + reply).alias("answered"))
    seen = nearest(rows, rows.select("key", "at", "rank", "seq", F.struct("at").alias("mark")), ["key"], part, True)
    seen = running(seen.select("key", "at", "rank", "seq", "answered", F.col("mark.at").alias("following")), ["key"], F.lit(1), "generation", part)
    sent = held(seen.where(F.col("following").isNull() | (F.col("following") - F.col("at") > wait)))
    told = nearest(sent, sent.select("key", "at", "rank", "seq", F.struct("at").alias("mark")), ["key"], part, True)
    told = told.withColumn("aborted", F.coalesce(F.col("mark.at") + wait < F.col("answered"), F.lit(False)))
    cleared = ~F.col("aborted") & (F.col("following").isNull() | (F.col("following") > F.col("answered")))
    return told.select(F.col("key").alias(key), F.col("seq").alias(order), F.col("generation").cast("int").alias("generation"), "aborted", cleared.alias("cleared"))


def insert_object(pages: DataFrame, requests: DataFrame, least: int = 10) -> DataFrame:
    """(page_id, width, height, rendered, text_objects, refused): pages with the text objects asked for.

    pages: page_id, image_width, image_height, width, height, rendered, text_objects (array of id, shape, x1, y1, x2, y2,
    ocr_text, translation, style); requests: page_id, id, shape, x1, y1, x2, y2.  A region is cut at its image and put in order; one under
    `least` on a side is refused (its id is in `refused`).  Objects are appended by id, empty and with the default style; a
    page that gets one takes the image's size unless it has one, and isn't rendered any more.  Requests for pages that don't exist are dropped."""
    style = F.create_map(*(F.lit(x) for k, v in STYLE.items() for x in (k, str(v).lower() if isinstance(v, bool) else v)))
    asked = requests.join(pages.select("page_id", "image_width", "image_height"), "page_id")
    cut = {c: F.greatest(F.lit(0), F.least(F.col(c), F.col("image_width" if c[0] == "x" else "image_height"))) for c in ("x1", "y1", "x2", "y2")}
    corner = {f"{c}{i}": f(cut[f"{c}1"], cut[f"{c}2"]) for c in "xy" for i, f in ((1, F.least), (2, F.greatest))}
    good = (corner["x2"] - corner["x1"] >= least) & (corner["y2"] - corner["y1"] >= least)
    made = F.struct("id", "shape", *(corner[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit("").alias("ocr_text"), F.lit("").alias("translation"), style.alias("style"))
    listed = asked.groupBy("page_id").agg(F.array_compact(F.collect_list(F.when(good, made))).alias("new"), F.sort_array(F.collect_list(F.when(~good, F.col("id")))).alias("refused"))
    listed = listed.withColumn("new", F.array_sort("new", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    both = pages.join(listed, "page_id", "left")
    some = F.coalesce(F.size("new") > 0, F.lit(False))
    held = F.coalesce("text_objects", F.array().cast(pages.schema["text_objects"].dataType))
    return both.select(
        "page_id",
        F.when(some, F.coalesce("width", "image_width")).otherwise(F.col("width")).alias("width"),
        F.when(some, F.coalesce("height", "image_height")).otherwise(F.col("height")).alias("height"),
        (F.coalesce("rendered", F.lit(False)) & ~some).alias("rendered"),
        F.when(some, F.concat(held, F.col("new").cast(pages.schema["text_objects"].dataType))).otherwise(F.col("text_objects")).alias("text_objects"),
        F.coalesce("refused", F.array().cast("array<string>")).alias("refused"),
    )


def render_limits(requests: DataFrame, key: str, most: int = 100, longest: int = 5000) -> DataFrame:
    """(key, error) of render requests (translations map<string, string>, horizontal and vertical alignments, as maps): too many entries of
    one of them, a text that is too long, or an alignment that isn't allowed; the first of these, null if there is none."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = lambda c: F.coalesce(F.map_values(c), F.array().cast("array<string>"))
    error = (
        F.when(size("translations") > most, "too many translations")
        .when(F.exists(held("translations"), lambda t: F.char_length(t) > longest), "text too long")
        .when(size("horizontal") > most, "too many horizontal alignments")
        .when(F.exists(held("horizontal"), lambda a: ~a.isin("left", "center", "right")), "horizontal alignment")
        .when(size("vertical") > most, "too many vertical alignments")
        .when(F.exists(held("vertical"), lambda a: ~a.isin("top", "middle", "bottom")), "vertical alignment")
    )
    return requests.select(key, error.alias("error"))


#: Suffixes of files that may be uploaded.
UPLOADS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".zip", ".cbz")


def upload_order(files: DataFrame, natural: Column) -> DataFrame:
    """(chapter_id, name, place) of the files (chapter_id, name) that may be uploaded, by their suffix in any case: in the order of a natural
    key of their names, ties by name."""
    allowed = F.lower("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in UPLOADS) + ")$")
    order = Window.partitionBy("chapter_id").orderBy(natural, "name")
    return files.where(allowed).select("chapter_id", "name", (F.row_number().over(order) - 1).alias("place"))
