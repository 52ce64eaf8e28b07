"""Line dedup of lines too short for edits: equal bytes repeat, near ones do not."""

from fauntrack.llm import line_dedup


def test_equal_short_lines_are_dropped(spark):
    rows = [(2, "All rights reserved.\n\n x \nbody two"), (1, "body one\nAll rights reserved."), (3, "All rights reserved!\nx\n\né\n \né"), (4, "the longer line that is met twice\nx")]
    out = line_dedup.dedup_lines(spark.createDataFrame([*rows, (5, "the longer line that is met twicE")], "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()} == {
        1: ("body one\nAll rights reserved.", 0), 2: ("\n x \nbody two", 1), 3: ("All rights reserved!\n\né\n ", 2), 4: ("the longer line that is met twice", 1), 5: ("", 1),
    }
