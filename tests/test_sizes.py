"""What grows with pixels stays out of the driver, and out of a task's memory: plans and batches."""

import re

from pagegrain.operators import canvas, processing
from pagegrain.plans import detection
from pagegrain.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def broadcast(df):
    """The steps of a plan whose rows are sent to the driver and from there to all executors."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = [next((i for i, c in enumerate(line) if c.isalpha()), 0) for line in lines]
    out = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(n + 1, len(lines)) if deep[m] <= deep[n]), len(lines))
            out += lines[n + 1 : end]
    return "\n".join(out)


def test_pages_that_are_cut_are_not_broadcast(spark):
    assert "gray" not in broadcast(QUERIES["slice_files"](spark, SF))


def test_rows_of_pages_are_not_broadcast(spark):
    made = detection.page_boxes(spark, SF).where("kind = 'text'")
    boxes = spark.createDataFrame(made.rdd, made.schema)  # of unknown size: the planner takes the other side for the smaller one
    assert "row" not in re.findall(r"\w+", broadcast(canvas.split_rows(detection.page_rows(spark, SF), boxes)))
    found = boxes.select("page_id", "box_index", "x1", "y1", "x2", "y2")
    assert not {"row", "gray"} & set(re.findall(r"\w+", broadcast(processing.page_plan(detection.page_rows(spark, SF), found))))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_made_after_the_join(spark):
    text = plan(QUERIES["empty_bubbles"](spark, SF))
    assert text.count("Join") == 1 and "array_repeat" not in text[text.index("Join") :]


def test_boxes_keep_their_columns_through_python(spark):
    assert "Join" not in plan(QUERIES["passes_merged"](spark, SF))
    assert plan(QUERIES["free_texts"](spark, SF)).count("Join") == 1  # texts against bubbles
    assert plan(QUERIES["detect"](spark, SF)).count("Join") <= 4


def test_an_address_is_read_once(spark):
    assert plan(QUERIES["ssrf_ipv4"](spark, SF)).count("split(") == 1


def test_pages_of_a_batch_are_few_objects_at_once(spark):
    text = plan(QUERIES["tall_lines"](spark, SF))
    assert "MapInArrow" in text and "MapInPandas" not in text
