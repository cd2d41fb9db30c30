"""Benchmark invocations: statistics, validation and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shortcut types, levels, names of baseline files by rank, counters of an invocation.
SHORTCUTS = ["white", "black", "low_std"]
LEVELS = ["level1_model", "level2_pipeline", "level3_e2e"]
BASELINES = ["benchmark_result.json", "results.json", "baseline.json", "result.json"]
COUNTS = ("model_calls", "cluster_count", "tile_count", "active_tile_count", "shortcut_count")
#: Sizes and mask types of the synthetic corpus.
SIZES = [(128, 128), (256, 256), (384, 384), (512, 512), (640, 640), (768, 768), (1024, 1024), (1536, 1024), (1000, 300), (300, 1000), (1600, 300), (300, 1600)]
MASKS = ["M1_bubble_10pct", "M2_bubble_25pct", "M3_bubble_50pct", "M4_thin_horizontal", "M5_thin_vertical", "M6_irregular_blob", "M7_disconnected_multi", "M8_clustered_multi"]


def timing_stats(runs: DataFrame) -> DataFrame:
    """Count, mean, p50 and p95 (linear interpolation), extremes and population deviation of each case."""
    v = "latency_ms"
    p = [F.percentile(v, q).alias(n) for q, n in ((0.5, "p50_ms"), (0.95, "p95_ms"))]
    got = runs.groupBy("case_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean_ms"), *p, F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.stddev_pop(v).alias("stddev_ms"))
    return got.select("case_id", "n", *[F.round(c, 4).alias(c) for c in got.columns[2:]])


def telemetry_summary(runs: DataFrame, metrics: tuple[str, ...] = ("model_calls", "cluster_count", "tile_count", "active_tile_count", "shortcut_count")) -> DataFrame:
    """Least, most, mean and whether it never changes, for each metric of a case."""
    long = runs.select("case_id", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    return long.groupBy("case_id", "metric").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 2).alias("mean"), (F.min("v") == F.max("v")).alias("invariant"))


def invariant_calls(runs: DataFrame) -> DataFrame:
    same = F.min("model_calls") == F.max("model_calls")
    return runs.groupBy("case_id").agg(F.sum("model_calls").alias("total"), F.when(same, F.min("model_calls")).alias("per_invocation"))


def set_difference(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """case_id, side of the cases that only one of two runs has."""
    only = lambda a, b, side: a.select("case_id").exceptAll(b.select("case_id")).withColumn("side", F.lit(side))
    return only(baseline, candidate, "baseline").union(only(candidate, baseline, "candidate"))


def quality_gate(pairs: DataFrame) -> DataFrame:
    """img, status of image pairs (psnr, ssim, mae; base_psnr, base_ssim, base_mae or null) against the
    floors and the recorded baseline; a pair without a golden image (null psnr) is incompatible."""
    drop = F.round(F.coalesce("base_psnr", F.lit(100.0)) - F.col("psnr"), 2), F.round(F.coalesce("base_ssim", F.lit(1.0)) - F.col("ssim"), 4), F.round(F.col("mae") - F.coalesce("base_mae", F.lit(0.0)), 4)
    bad = (F.col("psnr") < 30) | (F.col("ssim") < 0.85) | (F.col("mae") > 5) | (drop[0] > 2) | (drop[1] > 0.05) | (drop[2] > 2)
    return pairs.select("img", F.when(F.col("psnr").isNull(), "incompatible").when(bad, "regression").otherwise("ok").alias("status"))


def tampered(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, state of every expected file: ok, changed or missing, by the SHA-256 of its content."""
    found = files.select("name", F.sha2("content", 256).alias("sha256"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("changed")
    return expected.join(found, "name", "left").select("name", state.alias("state"))


def first_of(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition (a violation) holds, else null."""
    return reduce(lambda rest, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def first_violation(runs: DataFrame) -> DataFrame:
    """The first execution rule that each invocation breaks; rows that break none are left out.

    model_required: no expected type, at least one call, no shortcuts, at most as many active
    tiles as tiles, as many calls as active tiles where tiled, as many calls and crops as
    clusters where clustered, crops within the image.  shortcut: a known expected
    type, no call, exactly one shortcut, of that type."""
    c = F.col
    model, short = c("expected_execution") == "model_required", c("expected_execution") == "shortcut"
    known = F.coalesce(c("expected_type").isin(*SHORTCUTS), F.lit(False))
    many = model & (c("cluster_count") > 1)
    rules = [
        ("unknown execution", ~F.coalesce(model | short, F.lit(False))),
        ("type not expected", model & c("expected_type").isNotNull()),
        ("no call", model & (c("model_calls") < 1)),
        ("shortcut taken", model & ((c("shortcut_count") > 0) | (F.size("shortcut_types") > 0))),
        ("more active tiles than tiles", model & (c("tile_count") > 0) & (c("active_tile_count") > c("tile_count"))),
        ("calls differ from active tiles", model & (c("tile_count") > 1) & (c("active_tile_count") >= 1) & (c("model_calls") != c("active_tile_count"))),
        ("calls or crops differ from clusters", many & ((F.size("crops") != c("cluster_count")) | (c("model_calls") != c("cluster_count")))),
        ("crop beyond image", many & (c("image_width") > 0) & F.exists("crops", lambda d: (d["w"] > c("image_width")) | (d["h"] > c("image_height")))),
        ("unknown expected type", short & ~known),
        ("call in shortcut", short & (c("model_calls") != 0)),
        ("not one shortcut", short & (c("shortcut_count") != 1)),
        ("other shortcut type", short & ~c("shortcut_types").eqNullSafe(F.array("expected_type"))),
    ]
    return runs.withColumn("violation", first_of(rules)).where("violation is not null").select("case_id", "invocation_index", "violation")


def payload_violation(cases: DataFrame, runs: DataFrame, metrics: tuple[str, ...] = COUNTS) -> DataFrame:
    """(case_id, violation): the first rule that a stored case breaks against its own invocations.

    cases: case_id, status, level, timing_count, model_calls_total, per_invocation and for each metric
    {metric}_min, _max, _mean, _invariant.  A contiguous index means that the invocations, in order, count from 0."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("invocation_index")) - 1
    numbered = runs.withColumn("place", place)
    finite = F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.abs("latency_ms") < float("inf")) & (F.col("latency_ms") >= 0)
    sums = [e for m in metrics for e in (F.min(m).alias(f"a_{m}_min"), F.max(m).alias(f"a_{m}_max"), F.round(F.avg(m), 2).alias(f"a_{m}_mean"))]
    actual = numbered.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_and(F.col("place") == F.col("invocation_index")).alias("contiguous"), F.bool_and(finite).alias("finite"), F.sum("model_calls").alias("total"), F.bool_and(reduce(lambda x, y: x & y, [F.coalesce(F.col(m) >= 0, F.lit(False)) for m in metrics])).alias("counted"), *sums)
    c, both = F.col, cases.join(actual, "case_id", "left")
    rules = [
        ("case_id", F.trim("case_id") == ""), ("status", ~c("status").eqNullSafe("ok")), ("level", ~F.coalesce(c("level").isin(*LEVELS), F.lit(False))),
        ("invocations", c("n").isNull()), ("timing.count", ~c("timing_count").eqNullSafe(c("n"))), ("invocation_index", ~c("contiguous")), ("latency", ~c("finite")), ("counts", ~c("counted")),
        ("model_calls_total", c("model_calls_total") != c("total")),
        *[(f"summary.{m}", ~(c(f"{m}_min").eqNullSafe(c(f"a_{m}_min")) & c(f"{m}_max").eqNullSafe(c(f"a_{m}_max")) & c(f"{m}_invariant").eqNullSafe(c(f"a_{m}_min") == c(f"a_{m}_max")) & (F.abs(c(f"{m}_mean") - c(f"a_{m}_mean")) <= 0.0101))) for m in metrics],
        ("per_invocation", ~c("per_invocation").eqNullSafe(F.when(c("model_calls_invariant"), c("model_calls_min")))),
    ]
    return both.withColumn("violation", first_of(rules)).where("violation is not null").select("case_id", "violation")


def run_violation(runs: DataFrame, cases: DataFrame, version: str) -> DataFrame:
    """(run_id, violation): the first rule that a stored run (run_id, schema_version, total_cases, ok_cases,
    error_cases) breaks against its cases (run_id, case_id, status); runs that break none are left out."""
    per_id = cases.groupBy("run_id", "case_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("bad"))
    actual = per_id.groupBy("run_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("bad").alias("bad"), F.max("n").alias("most"), F.bool_or(F.coalesce(F.trim("case_id") == "", F.lit(True))).alias("nameless"))
    c = F.col
    rules = [("schema_version", ~c("schema_version").eqNullSafe(version)), ("cases", c("n").isNull()), ("total_cases", ~c("total_cases").eqNullSafe(c("n"))), ("ok_cases", ~c("ok_cases").eqNullSafe(c("ok"))), ("error_cases", ~c("error_cases").eqNullSafe(c("bad"))), ("case_id", c("nameless")), ("duplicate case_id", c("most") > 1)]
    return runs.join(actual, "run_id", "left").withColumn("violation", first_of(rules)).where("violation is not null").select("run_id", "violation")


def run_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run_id").agg(F.count("*").alias("total_cases"), F.count_if(F.col("status") == "ok").alias("ok_cases"), F.count_if(F.col("status") == "error").alias("error_cases"))


def ordered_types(runs: DataFrame) -> DataFrame:
    """Shortcut types of a case in the order in which they first appear."""
    first = runs.select("case_id", "invocation_index", F.posexplode("shortcut_types").alias("place", "type")).groupBy("case_id", "type").agg(F.min(F.struct("invocation_index", "place")).alias("at"))
    return first.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "type"))), lambda r: r["type"]), ",").alias("types"))


def top_cases(stats: DataFrame, group: str, order: str, k: int = 16) -> DataFrame:
    """The first k rows of each group and how many are left out."""
    w = Window.partitionBy(group)
    rows = stats.withColumn("place", F.row_number().over(w.orderBy(F.desc(order), "case_id"))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - k))
    return rows.where(F.col("place") <= k)


def sweep(sides: dict[int, DataFrame]) -> DataFrame:
    """Runs with different thread counts as one table, case ids marked by the count."""
    return reduce(DataFrame.unionByName, [rows.withColumn("case_id", F.concat(F.lit(f"[{n}T] "), "case_id")) for n, rows in sides.items()])


def baseline_file(listing: DataFrame) -> DataFrame:
    """(folder, name, error): the baseline among a folder's files: the first canonical name, else the only JSON file."""
    json = listing.where(F.lower("name").endswith(".json"))
    order = F.coalesce(*[F.when(F.col("name") == n, i) for i, n in enumerate(BASELINES)])
    got = json.groupBy("folder").agg(F.min(F.struct(order.alias("o"), F.col("name").alias("name"))).alias("any"), F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), F.col("name").alias("name")))).alias("best"), F.count("*").alias("n"))
    every = listing.select("folder").distinct().join(got, "folder", "left")
    name = F.coalesce(F.col("best.name"), F.when(F.col("n") == 1, F.col("any.name")))
    return every.select("folder", name.alias("name"), F.when(F.col("n").isNull(), "none").when(name.isNull(), "ambiguous").alias("error"))


def corpus_matrix(spark: SparkSession) -> DataFrame:
    """The synthetic cases: each size with each mask type, and three shortcut cases; with their seeds."""
    sizes = spark.createDataFrame(SIZES, "width int, height int")
    masks = spark.createDataFrame([(m,) for m in MASKS], "mask_type string")
    seed = 42 + F.col("width") * 1000 + F.col("height") * 10 + F.length("mask_type")
    cases = sizes.join(masks, how="cross").select("width", "height", "mask_type", seed.alias("seed"), F.lit("model_required").alias("expected_execution"))  # 12 x 8 rows
    short = spark.createDataFrame([(256, 256, t) for t in SHORTCUTS], "width int, height int, mask_type string")
    return cases.unionByName(short.select("width", "height", "mask_type", seed.alias("seed"), F.lit("shortcut").alias("expected_execution")))


def compare(baseline: DataFrame, candidate: DataFrame, slower: float = 5.0) -> DataFrame:
    """Full outer join of two runs' statistics (case_id, p50_ms, calls, mean_calls).

    A case on one side only is incompatible.  Else a regression is a p50 over 5 % slower, more calls for
    each invocation or, where their number isn't the same in all of them (calls null), a larger mean.  With
    columns workload and execution, cases whose values differ are incompatible, too; with columns psnr,
    ssim and mae (of the candidate against the golden image), see quality_regression."""
    extra = [c for c in ("workload", "execution") if c in baseline.columns]
    a, b = (side.select("case_id", *[F.col(c).alias(f"{x}_{c}") for c in side.columns if c != "case_id"], F.lit(True).alias(f"{x}_here")) for side, x in ((baseline, "base"), (candidate, "cand")))
    c, both = F.col, a.join(b, "case_id", "full_outer")
    change = F.round(F.round(F.round(c("cand_p50_ms") - c("base_p50_ms"), 6), 2) / F.greatest(F.lit(1e-4), c("base_p50_ms")) * 100, 2)
    apart = c("base_here").isNull() | c("cand_here").isNull()
    for x in extra:
        apart = apart | (c(f"base_{x}") != c(f"cand_{x}"))
    more = F.coalesce(c("cand_calls") - c("base_calls") > 0, F.round(c("cand_mean_calls") - c("base_mean_calls"), 2) > 0, F.lit(False))
    worse = (change > slower) | more
    if "psnr" in candidate.columns:
        worse = worse | quality_regression(c("cand_psnr"), c("cand_ssim"), c("cand_mae"))
    return both.select("case_id", F.when(F.coalesce(apart, F.lit(False)), "incompatible").when(worse, "regression").otherwise("ok").alias("status"), change.alias("p50_change"))


def quality_regression(psnr: Column, ssim: Column, mae: Column, base: tuple[float, float, float] = (100.0, 1.0, 0.0)) -> Column:
    """Under a floor of PSNR 30 or SSIM .85 or over an MAE of 5, or worse than recorded by over 2, .05 or 2."""
    return F.coalesce((psnr < 30) | (ssim < 0.85) | (mae > 5) | (F.round(base[0] - psnr, 2) > 2) | (F.round(base[1] - ssim, 4) > 0.05) | (F.round(mae - base[2], 4) > 2), F.lit(False))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def golden_pairs(cases: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, state) of each case's pair of images, given as (case_id, digest) by run; a missing baseline is told first."""
    both = cases.join(baseline.select("case_id", F.col("digest").alias("b")), "case_id", "left").join(candidate.select("case_id", F.col("digest").alias("c")), "case_id", "left")
    state = F.when(F.col("b").isNull(), "missing baseline").when(F.col("c").isNull(), "missing candidate").when(F.col("b") == F.col("c"), "identical").otherwise("differs")
    return both.select("case_id", state.alias("state"))
