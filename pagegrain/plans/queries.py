"""Every query with its Spark plan and, where SQL expresses it, the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import bench, manifest, profile, spatial
from ..sources import links as link_source
from . import views
from .catalog import ORACLE, QUERIES, query
from .views import PAGE_H, PAGE_W, sql, table

__all__ = ["ORACLE", "QUERIES"]

INSIDE = """((t.x1 + t.x2) / 2.0 BETWEEN b.x1 AND b.x2 AND (t.y1 + t.y2) / 2.0 BETWEEN b.y1 AND b.y2
  OR greatest(least(t.x2, b.x2) - greatest(t.x1, b.x1), 0) * greatest(least(t.y2, b.y2) - greatest(t.y1, b.y1), 0) >= 0.5 * (t.x2 - t.x1) * (t.y2 - t.y1))"""
GAP = {c: f"greatest(a.{c}1 - b.{c}2, b.{c}1 - a.{c}2, 0)" for c in "xy"}

query("filter_valid_boxes", lambda k, d: spatial.valid_boxes(views.box(k, d), PAGE_W, PAGE_H).select("page_id", "box_index", "kind"), sql("SELECT page_id, box_index, kind FROM box WHERE x2 > x1 AND y2 > y1 AND x2 - x1 <= 388 AND (x2 - x1) * (y2 - y1) <= 84000 AND x2 - x1 <= 25 * (y2 - y1) AND y2 - y1 <= 25 * (x2 - x1)", "box"))
query("text_in_bubble", lambda k, d: spatial.text_in_bubble(views.box(k, d)), sql(f"SELECT t.page_id, t.box_index AS text_index, b.box_index AS bubble_index FROM box t JOIN box b ON t.page_id = b.page_id AND t.kind = 'text' AND b.kind = 'bubble' AND {INSIDE}", "box"))
query("bubble_without_text", lambda k, d: spatial.bubbles_without_text(views.box(k, d)), sql(f"""SELECT page_id, box_index, x1 + mx AS x1, y1 + my AS y1, x2 - mx AS x2, y2 - my AS y2 FROM (
  SELECT *, greatest(2, ((x2 - x1) * 3) // 100) AS mx, greatest(2, ((y2 - y1) * 3) // 100) AS my FROM box b WHERE kind = 'bubble' AND NOT EXISTS (SELECT 1 FROM box t WHERE t.page_id = b.page_id AND t.kind = 'text' AND {INSIDE}))""", "box"))
query("standalone_text", lambda k, d: spatial.standalone_text(views.box(k, d)), sql(f"SELECT page_id, box_index FROM box t WHERE kind = 'text' AND NOT EXISTS (SELECT 1 FROM box b WHERE b.page_id = t.page_id AND b.kind = 'bubble' AND {INSIDE})", "box"))
query("excluded_anti", lambda k, d: spatial.outside_excluded(views.box(k, d), views.excluded(k, d)), sql("SELECT page_id, box_index FROM box a WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.page_id = a.page_id AND (a.x1 + a.x2) / 2.0 BETWEEN least(ax, bx) AND greatest(ax, bx) AND (a.y1 + a.y2) / 2.0 BETWEEN least(ay, cy) AND greatest(ay, cy))", "page", "box", "excluded"))
query("free_text_edges", lambda k, d: spatial.free_text_edges(views.box(k, d)), EDGES := sql(f"SELECT a.page_id, a.box_index AS a_index, b.box_index AS b_index FROM box a JOIN box b ON a.page_id = b.page_id AND a.box_index < b.box_index AND a.kind = 'text' AND b.kind = 'text' AND {GAP['x']} <= 35 AND (abs(a.y1 - b.y1) < 45 OR abs(a.y2 - b.y2) < 45 OR {GAP['y']} <= 40)", "box"))
query("inpaint_edges", lambda k, d: spatial.close_edges(views.box(k, d)), sql(f"SELECT a.page_id, a.box_index AS a_index, b.box_index AS b_index FROM box a JOIN box b ON a.page_id = b.page_id AND a.box_index < b.box_index AND {GAP['x']} <= 35 AND {GAP['y']} <= 35", "box"))
query("heavy_overlaps", lambda k, d: spatial.heavy_overlaps(views.box(k, d)), sql("""SELECT page_id, a_index, b_index, round(o / (u - o), 6) AS iou FROM (SELECT a.page_id, a.box_index AS a_index, b.box_index AS b_index,
  CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS DOUBLE) AS o, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u
  FROM box a JOIN box b ON a.page_id = b.page_id AND a.kind = b.kind AND a.box_index < b.box_index) WHERE o > 0 AND o / (u - o) > 0.3""", "box"))
query("cluster_hull", lambda k, d: spatial.cluster_hulls(views.box(k, d), PAGE_W, PAGE_H), sql("""SELECT page_id, greatest(min(x1) - 20, 0) AS x1, greatest(min(y1) - 8, 0) AS y1, least(max(x2) + 20, 400) AS x2, least(max(y2) + 8, 600) AS y2, max(confidence) AS confidence,
  count(*) > 3 OR max(y2) - min(y1) > 4 * avg(y2 - y1) AS split FROM box WHERE kind = 'text' GROUP BY page_id""", "box"))
query("best_box", lambda k, d: spatial.best_box(views.box(k, d)), sql("SELECT page_id, kind, arg_min(box_index, (-confidence, box_index)) AS box_index, max(confidence) AS confidence FROM box GROUP BY ALL", "box"))
query("reading_order", lambda k, d: spatial.reading_order(views.box(k, d)), sql("SELECT page_id, string_agg(CAST(box_index AS VARCHAR), ',' ORDER BY y1, x1, box_index) AS reading FROM box GROUP BY page_id", "box"))
query("nms", lambda k, d: spatial.suppress(views.box(k, d)))
query("free_text_components", lambda k, d: spatial.near_texts(views.box(k, d)), sql(f"""+ edge AS (SELECT a.page_id, a.box_index AS p, b.box_index AS q FROM box a JOIN box b ON a.page_id = b.page_id AND a.box_index <> b.box_index AND a.kind = 'text' AND b.kind = 'text' AND {GAP['x']} <= 35 AND (abs(a.y1 - b.y1) < 45 OR abs(a.y2 - b.y2) < 45 OR {GAP['y']} <= 40)),
reach AS (SELECT page_id, box_index, box_index AS r FROM box WHERE kind = 'text' UNION SELECT reach.page_id, reach.box_index, q FROM reach JOIN edge ON edge.page_id = reach.page_id AND p = r)
SELECT page_id, CAST(box_index AS INTEGER) AS box_index, CAST(min(r) AS INTEGER) AS cluster FROM reach GROUP BY ALL""", "box", recursive=True).replace("GROUP BY ALL", "GROUP BY page_id, box_index"))
query("crop_region", lambda k, d: views.box(k, d).select("page_id", "box_index", *[c.alias(n) for n, c in g.crop(PAGE_W, PAGE_H).items()]), sql("""+ p AS (SELECT page_id, box_index, x1 - 35 AS lx, x2 + 35 AS hx, y1 - 35 AS ly, y2 + 35 AS hy, greatest(x2 - x1, y2 - y1) + 70 AS side FROM box),
q AS (SELECT *, greatest((hx - lx) / greatest(1, hy - ly), (hy - ly) / greatest(1, hx - lx)) > 1.8::DOUBLE AS long, (lx + hx - side) / 2 AS ax, (lx + hx + side) / 2 AS bx, (ly + hy - side) / 2 AS ay, (ly + hy + side) / 2 AS b_y FROM p)
SELECT page_id, box_index, CAST(floor(CASE WHEN long THEN greatest(lx, 0) WHEN ax < 0 THEN 0 WHEN bx > 400 THEN greatest(0, ax - (bx - 400)) ELSE ax END) AS BIGINT) AS cx1, CAST(floor(CASE WHEN long THEN greatest(ly, 0) WHEN ay < 0 THEN 0 WHEN b_y > 600 THEN greatest(0, ay - (b_y - 600)) ELSE ay END) AS BIGINT) AS cy1,
  CAST(floor(CASE WHEN long THEN least(hx, 400) WHEN ax < 0 THEN least(400, bx - ax) WHEN bx > 400 THEN 400 ELSE bx END) AS BIGINT) AS cx2, CAST(floor(CASE WHEN long THEN least(hy, 600) WHEN ay < 0 THEN least(600, b_y - ay) WHEN b_y > 600 THEN 600 ELSE b_y END) AS BIGINT) AS cy2 FROM q""", "box"))
query("move_clamp", lambda k, d: views.box(k, d).select("page_id", "box_index", *s.moved(("x1", "y1", "x2", "y2"), F.col("box_index") * 30 - 60, F.lit(24), PAGE_W, PAGE_H)), sql("SELECT page_id, box_index, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2 FROM (SELECT *, greatest(-x1, least(box_index * 30 - 60, 400 - x2)) AS dx, greatest(-y1, least(24, 600 - y2)) AS dy FROM box)", "box"))
query("branch_union", lambda k, d: (b := views.box(k, d)).where("kind = 'bubble'").select("page_id", "box_index").unionByName(b.where("kind = 'text' and not removed").select("page_id", "box_index")), sql("SELECT page_id, box_index FROM box WHERE kind = 'bubble' UNION ALL SELECT page_id, box_index FROM box WHERE kind = 'text' AND NOT removed", "box"))

query("bench_timing_stats", lambda k, d: bench.timing_stats(views.invocation(k, d)), sql("SELECT case_id, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms, round(min(latency_ms), 4) AS min_ms, round(max(latency_ms), 4) AS max_ms, round(stddev_pop(latency_ms), 4) AS stddev_ms FROM invocation GROUP BY case_id", "invocation"))
query("invariant_calls", lambda k, d: bench.invariant_calls(views.invocation(k, d)), sql("SELECT case_id, CAST(sum(model_calls) AS BIGINT) AS total, CASE WHEN min(model_calls) = max(model_calls) THEN min(model_calls) END AS per_invocation FROM invocation GROUP BY case_id", "invocation"))
query("duplicate_ids", lambda k, d: bench.duplicates(views.invocation(k, d), "user_id"), sql("SELECT user_id, count(*) AS n FROM invocation GROUP BY user_id HAVING count(*) > 1", "invocation"))


def _half(k: SparkSession, d: str, odd: int) -> DataFrame:
    rows = views.invocation(k, d).where(F.expr(f"(event_id div 2) % 2 = {odd} and not (case_id like 'click%' and {odd} = 1 and user_id % 20 < 3)"))
    same = F.min("model_calls") == F.max("model_calls")
    return rows.groupBy("case_id").agg(F.percentile("latency_ms", 0.5).alias("p50_ms"), F.when(same, F.min("model_calls")).alias("calls"), F.round(F.avg("model_calls"), 2).alias("mean_calls"))


query("bench_compare", lambda k, d: bench.compare(_half(k, d, 0), _half(k, d, 1)), sql("""+ half AS (SELECT case_id, (event_id // 2) % 2 AS o, quantile_cont(latency_ms, 0.5) AS p, CASE WHEN min(model_calls) = max(model_calls) THEN min(model_calls) END AS c, round(avg(model_calls), 2) AS m FROM invocation WHERE NOT (case_id LIKE 'click%' AND (event_id // 2) % 2 = 1 AND user_id % 20 < 3) GROUP BY 1, 2),
both_sides AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, a.p AS ap, b.p AS bp, coalesce(b.c - a.c > 0, round(b.m - a.m, 2) > 0) AS more, round(CAST(round(CAST(b.p - a.p AS DECIMAL(18, 6)), 2) AS DOUBLE) / greatest(0.0001, a.p) * 100, 2) AS p50_change
FROM (SELECT * FROM half WHERE o = 0) a FULL JOIN (SELECT * FROM half WHERE o = 1) b ON a.case_id = b.case_id)
SELECT case_id, CASE WHEN ap IS NULL OR bp IS NULL THEN 'incompatible' WHEN p50_change > 5 OR more THEN 'regression' ELSE 'ok' END AS status, p50_change FROM both_sides""", "invocation"))

MEANS = "mean AS (SELECT img, y, avg(v) AS m FROM px GROUP BY 1, 2), flagged AS (SELECT img, y, m < quantile_cont(m, 0.9) OVER (PARTITION BY img) - 2 AS is_text FROM mean)"
SCORE = "score AS (SELECT img, y, round(stddev_pop(v) + 2 * count(*) FILTER (WHERE abs(255 - v) > 18 AND abs(v) > 18), 4) AS score FROM px GROUP BY 1, 2)"
SAFE = f"{SCORE}, safe AS (SELECT * FROM (SELECT img, y, score, count(*) OVER w = 3 AND max(score) OVER w <= 34 AS ok FROM score WINDOW w AS (PARTITION BY img ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE ok)"
query("row_profile", lambda k, d: profile.row_profile(views.pixel(k, d)), sql(f"+ {SCORE} SELECT img, y, score FROM score", "px"))
query("row_text_flag", lambda k, d: profile.text_rows(views.pixel(k, d)), sql(f"+ {MEANS} SELECT img, y, is_text FROM flagged", "px"))
query("text_runs", lambda k, d: profile.runs(views.pixel(k, d), 2), sql(f"""+ {MEANS}, island AS (SELECT img, min(y) AS first, max(y) AS last FROM (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS g FROM flagged WHERE is_text) GROUP BY img, g HAVING max(y) - min(y) + 1 >= 2)
SELECT img, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(least(3, greatest(1, (first - coalesce(lag(last) OVER (PARTITION BY img ORDER BY first) + 1, 0)) // 2)) AS INTEGER) AS pad_top FROM island""", "px"))
query("safe_band", lambda k, d: profile.safe_rows(views.pixel(k, d), 1), sql(f"+ {SAFE} SELECT img, y, score FROM safe", "px"))
query("nearest_cut", lambda k, d: profile.nearest_cut(views.pixel(k, d), 4, 1), sql(f"+ {SAFE} SELECT img, arg_min(y, (abs(y - 4), score, y)) AS cut FROM safe GROUP BY img", "px"))
query("fill_class", lambda k, d: profile.fill_class(views.pixel(k, d).withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") + (F.col("img") % 3 - 1) * 150))), F.col("x").isin(3, 4) & F.col("y").isin(3, 4)), sql("""+ q AS (SELECT img, greatest(0, least(255, v + (img % 3 - 1) * 150)) AS v FROM px WHERE NOT (x IN (3, 4) AND y IN (3, 4))),
m AS (SELECT img, avg(CAST(v > 215 AS INTEGER)) AS l, avg(CAST(v < 35 AS INTEGER)) AS k, stddev_pop(v) AS s, quantile_cont(v, 0.5) FILTER (WHERE v > 215) AS ml, quantile_cont(v, 0.5) FILTER (WHERE v < 35) AS mk, quantile_cont(v, 0.5) AS ma FROM q GROUP BY img)
SELECT img, CASE WHEN l >= 0.7 THEN 'white' WHEN k >= 0.7 THEN 'black' WHEN s < 12 THEN 'low_std' ELSE 'model' END AS fill, CAST(floor(CASE WHEN l >= 0.7 THEN ml WHEN k >= 0.7 THEN mk WHEN s < 12 THEN ma END) AS INTEGER) AS value FROM m""", "px"))
query("auto_color", lambda k, d: profile.auto_colour(views.pixel(k, d)), sql("SELECT img, CASE WHEN avg(v) < 135 THEN '#FFFFFF' ELSE '#000000' END AS colour FROM px GROUP BY img", "px"))
query("mask_coverage", lambda k, d: profile.coverage(views.pixel(k, d)), sql("SELECT img, count(*) FILTER (WHERE v > 127) AS pixels, round(count(*) FILTER (WHERE v > 127) / count(*), 4) AS ratio FROM px GROUP BY img", "px"))


def _next_image(k: SparkSession, d: str) -> DataFrame:
    return views.pixel(k, d).withColumn("img", F.col("img") - 1)


query("image_quality", lambda k, d: profile.image_quality(views.pixel(k, d), _next_image(k, d)), sql("""+ s AS (SELECT a.img, avg(abs(a.v - b.v)) AS mae, avg((a.v - b.v) * (a.v - b.v)) AS mse, avg(a.v) AS ma, avg(b.v) AS mb, var_pop(a.v) AS va, var_pop(b.v) AS vb, covar_pop(a.v, b.v) AS c FROM px a JOIN px b ON b.img = a.img + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.img)
SELECT img, round(mae, 4) AS mae, CASE WHEN mse = 0 THEN 100.0 ELSE round(10 * log10(65025.0 / mse), 2) END AS psnr, round((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 4) AS ssim FROM s""", "px"))
query("mask_union", lambda k, d: profile.union_max(views.pixel(k, d), _next_image(k, d)), sql("SELECT img, y, x, max(v) AS v FROM (SELECT img, y, x, v FROM px UNION ALL SELECT img - 1, y, x, v FROM px) GROUP BY 1, 2, 3", "px"))
query("tile_starts", lambda k, d: profile.tiles(table(k, d, "orders").select((F.col("o_orderkey") % 3000).alias("length")).distinct()), sql("+ l AS (SELECT DISTINCT o_orderkey % 3000 AS length FROM orders) SELECT DISTINCT length, CASE WHEN length <= 512 THEN 0 ELSE least(s, length - 512) END AS start FROM (SELECT length, unnest(range(0, greatest(1, length - 512 + 448), 448)) AS s FROM l)", "page"))

query("work_selection", lambda k, d: manifest.work_selection(views.page(k, d), table(k, d, "customer").select(F.col("c_custkey").alias("chapter_id"), F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("page_index"))), sql("SELECT chapter_id, page_index, page_id FROM page WHERE NOT skipped AND page_index IN (0, 2, 5) AND chapter_id IN (SELECT c_custkey FROM customer)", "page"))
query("resume_page", lambda k, d: manifest.resume_page(views.page(k, d)), sql("SELECT chapter_id, min(page_index) AS resume FROM page WHERE NOT skipped GROUP BY chapter_id", "page"))
query("slice_label", lambda k, d: manifest.slice_labels(views.page(k, d)), sql("SELECT page_id, (page_index + 1) || '/' || count(*) OVER (PARTITION BY chapter_id) AS label, 'page_' || lpad(CAST(page_index AS VARCHAR), 3, '0') || '.png' AS file FROM page", "page"))
query("recent_chapters", lambda k, d: views.page(k, d).groupBy("chapter_id").agg(F.max("page_id").alias("updated")).orderBy(F.desc("updated")), sql("SELECT chapter_id, max(page_id) AS updated FROM page GROUP BY chapter_id ORDER BY 2 DESC", "page"))
query("draft_upsert", lambda k, d: manifest.overlay(views.page(k, d).select("page_id", "price"), views.page(k, d).where("page_id % 3 = 0").select((F.col("page_id") + 1).alias("page_id"), (-F.col("price")).alias("price")), ["page_id"], "price"), sql("SELECT page_id, coalesce(e.price, p.price) AS price FROM page p FULL JOIN (SELECT page_id + 1 AS page_id, -price AS price FROM page WHERE page_id % 3 = 0) e USING (page_id)", "page"))
query("three_way_merge", lambda k, d: manifest.three_way(*[(p := views.page(k, d)).select("page_id", F.when(F.col("page_id") % m == 0, F.lit(x)).otherwise(F.col("price")).alias("price")) for m, x in ((1 << 40, 0), (2, -1), (3, -2))], "page_id", "price"), sql("SELECT page_id, CASE WHEN page_id % 3 = 0 AND price <> -2 THEN -2 WHEN page_id % 2 = 0 THEN -1 ELSE price END AS price FROM page", "page"))
query("debounce_text", lambda k, d: manifest.debounced(table(k, d, "events"), "user_id", 3_600_000), """WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000 AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e) SELECT user_id, CAST(burst AS BIGINT) AS burst, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM b GROUP BY 1, 2""")
query("checkpoint_dedupe", lambda k, d: manifest.changes_only(table(k, d, "events"), "user_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR event_type IS DISTINCT FROM before")
query("mask_accumulate", lambda k, d: manifest.accumulated(table(k, d, "events"), "user_id"), "WITH e AS (SELECT *, sum(CAST(event_id % 10 = 0 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events) SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS mask FROM e")

ANY = """(?:"[^"]*"|''[^'']*''|[^\\s>"'']+)"""
GROUPS = """(?i)\\shref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))"""
HREF = f"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>', '', 'g'), '(?is)<[a-z][^>]*?\\shref\\s*=\\s*{ANY}') AS h FROM pages), e AS (SELECT page_id, unnest(h) AS tag, unnest(range(len(h))) AS place FROM t),
l AS (SELECT page_id, place, trim(regexp_extract(tag, '{GROUPS}', 1) || regexp_extract(tag, '{GROUPS}', 2) || regexp_extract(tag, '{GROUPS}', 3)) AS link FROM e) """
query("html_links", lambda k, d: link_source.links(table(k, d, "pages")), HREF + "SELECT page_id, CAST(place AS INTEGER) AS place, link FROM l")
query("url_dedupe", lambda k, d: link_source.first_of_each(link_source.links(table(k, d, "pages")), "page_id", "link", "place"), HREF + "SELECT page_id, CAST(min(place) AS INTEGER) AS place, link FROM l GROUP BY page_id, link")
query("ext_guess", lambda k, d: table(k, d, "pages").select("page_id", s.extension(F.col("url")).alias("ext")), "SELECT page_id, CASE WHEN u LIKE '%.jpg' THEN '.jpg' WHEN u LIKE '%.jpeg' THEN '.jpeg' WHEN u LIKE '%.png' THEN '.png' WHEN u LIKE '%.webp' THEN '.webp' ELSE '.jpg' END AS ext FROM (SELECT page_id, lower(regexp_extract(url, '^[^?#]*')) AS u FROM pages)")
query("lang_alias", lambda k, d: table(k, d, "documents").select("doc_id", s.language_name(F.col("lang")).alias("name")), "SELECT doc_id, CASE lower(lang) WHEN 'ko' THEN 'korean' WHEN 'korean' THEN 'korean' WHEN 'zh' THEN 'ch' WHEN 'ch' THEN 'ch' WHEN 'en' THEN 'en' WHEN 'ja' THEN 'japan' WHEN 'japan' THEN 'japan' ELSE lang END AS name FROM documents")
query("worker_clamp", lambda k, d: views.page(k, d).select("page_id", s.clamp(F.nullif(F.col("page_index"), F.lit(0)), 1, 8, 2).alias("workers")), sql("SELECT page_id, greatest(1, least(8, coalesce(nullif(page_index, 0), 2))) AS workers FROM page", "page"))
query("page_number_parse", lambda k, d: views.page(k, d).select("page_id", s.page_number(F.concat(F.when(F.col("price") % 5 == 0, "x").otherwise(""), F.col("page_index").cast("string")), F.lit(9)).alias("number")), sql("SELECT page_id, CAST(CASE WHEN price % 5 <> 0 AND page_index BETWEEN 1 AND 9 THEN page_index - 1 END AS BIGINT) AS number FROM page", "page"))
query("ssrf_ipv4", lambda k, d: views.page(k, d).select("page_id", s.address_blocked(s.ipv4(F.concat_ws(".", F.col("price") % 256, F.col("page_id") % 300, F.col("chapter_id") % 256, F.lit(1)))).alias("blocked")), sql("""SELECT page_id, CASE WHEN b <= 255 THEN a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) END AS blocked
FROM (SELECT page_id, price % 256 AS a, page_id % 300 AS b, chapter_id % 256 AS c FROM page)""", "page"))
query("ocr_join", lambda k, d: table(k, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("t"), "role"))), lambda r: r["t"]), "\n").alias("text")), "SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn, trim(text), role) AS text FROM conversations GROUP BY conv_id")
query("letterbox", lambda k, d: views.box(k, d).select("page_id", "box_index", *[c.alias(n) for n, c in zip(("scale", "pad_x", "pad_y"), g.letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), strict=True)]), sql("SELECT page_id, box_index, sc AS scale, CAST(floor((1024 - round(w * sc)) / 2) AS BIGINT) AS pad_x, CAST(floor((1024 - round(h * sc)) / 2) AS BIGINT) AS pad_y FROM (SELECT *, least(1024 / w, 1024 / h) AS sc FROM (SELECT page_id, box_index, x2 - x1 AS w, y2 - y1 AS h FROM box))", "box"))
query("line_height", lambda k, d: views.box(k, d).select("page_id", "box_index", s.line_height(F.col("x1") % 40, F.col("y1") % 20, F.lit(2)).alias("line_height")), sql("SELECT page_id, box_index, CAST(floor(greatest(x1 % 40 + y1 % 20, 8) * 1.18::DOUBLE) AS BIGINT) + 4 AS line_height FROM box", "box"))

from . import canvas, checks, detection, editing, grouped, masks, media, processing, saves, screen  # noqa: E402, F401  (they enter their queries)
