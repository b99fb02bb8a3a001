"""Lines out of glyphs: pages over several batches, ties, long characters, and what is shuffled."""

import pyarrow as pa

from tonguemill.operators import layout
from tonguemill.plans import catalogue

GLYPH = "doc_id long, page int, item_idx int, str string, x double, y double, width double, font_size double, font_name string"


def test_glyphs_are_not_shuffled(spark, data):
    """The pages' texts are, once; their glyphs are made after that."""
    plan = catalogue.line_style(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate posexplode(split(line") < plan.index("Exchange")


def test_pages_over_batches(spark):
    rows = [(d, p, i, f"w{d}{p}{i}", 50.0 + 30 * (i % 4), 700.0 - 20 * (i // 4), 10.0, 11.0, "A" if i % 5 else "B-Bold") for d in (1, 2) for p in (0, 1) for i in range(11)]
    rows += [(None, 0, 0, "null", 1.0, 1.0, 1.0, 11.0, "A")]
    df = spark.createDataFrame(rows, GLYPH)
    told = lambda: sorted(map(repr, layout.cluster_lines(df).collect()))
    want = told()
    assert len(want) == 13
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert told() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_and_style():
    g = [(1, 0, 5, "b", 60.0, 700.0, 5.0, 12.0, "X"), (1, 0, 5, "a", 60.0, 700.0, 5.0, 11.0, "X"), (1, 0, 1, "🙂", 50.0, 701.0, 4.0, 10.0, "Y"), (1, 0, 2, " \t", 90.0, 700.0, 1.0, 11.0, "Z"), (1, 0, 3, "ny", 50.0, 650.0, 4.0, 11.0, "Y")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.string()]
    names = [c.split()[0] for c in GLYPH.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*g, strict=True), kinds, strict=True)], names=names)
    first, second = next(layout._lines_of([batch])).to_pylist()
    assert (first["text"], first["y"], first["n_items"], first["font_size"], first["font_name"], first["x"], first["x_end"]) == ("🙂 ab", 701.0, 4, 11.0, "Y", 50.0, 91.0)
    assert set(first["names"].split()) == {"X", "Y", "Z"} and (second["line_idx"], second["text"], second["names"]) == (1, "ny", "Y")
