"""Plans in which the costly steps stand once, so that the work of a row stays small."""

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_a_dialect_is_parsed_few_times(spark):
    text = plan(spark, "map_dialect_c")
    assert text.count("get_json_object") + text.count("from_json") <= 30


def test_a_line_is_searched_for_pairs_once(spark):
    assert plan(spark, "log_lines").count("regexp_extract_all") == 1


def test_names_are_worked_out_for_parts_and_not_for_lines(spark):
    """The patterns of labels and names stand below the join of lines and parts, and nowhere above it."""
    for name in ("keyword_decide_render", "single_keyword_per_photo"):
        text = plan(spark, name)
        above = text[: text.rindex("Join Inner")]
        assert "regexp_replace" not in above and "regexp_replace" in text, name
