import pytest
from pyspark.sql import functions as F

from tonguemill.functions import scalars as s


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_blank_and_length(spark):
    texts = ["", " \t\n", " ", "﻿ ", "a", None, "a\U0001f600"]
    assert values(spark, texts, "t string", s.is_blank(F.col("t"))) == [True] * 4 + [False, True, False]
    assert values(spark, texts, "t string", s.js_length(F.col("t"))) == [0, 3, 1, 2, 1, None, 3]
    assert values(spark, [" a b﻿"], "t string", s.js_trim(F.col("t"))) == ["a b"]


def test_numeric(spark):
    yes, no = ["", "12", "NOK 5", "5 kr", "=A1+B2", "-B7", "1 000,50 €", "12:30 %"], ["esker", "5 esker", "=", "kr", "A1"]
    assert values(spark, yes + no, "t string", s.looks_numeric(F.col("t"))) == [True] * len(yes) + [False] * len(no)


def test_entities(spark):
    texts = ["&lt;b&gt; &quot;x&quot; &apos;", "&amp;lt;", "&#65;&#x42;", "&#8364;", "&#65601;", "&#55357;", "a & b", "&#38;#x41;"]
    assert values(spark, texts, "t string", s.decode_xml_entities(F.col("t"))) == ["<b> \"x\" '", "&lt;", "AB", "€", "A", "�", "a & b", "A"]
    assert values(spark, ["<a & \"b\" 'c'>"], "t string", s.escape_xml(F.col("t"))) == ["&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"]


def test_tagged(spark):
    xml = ['<t>a</t><t k="1">b &amp; c</t><t xml:space="preserve">d</t>']
    assert values(spark, xml, "t string", s.extract_tagged_text(F.col("t"), "t")) == [["a", "b & c", "d"]]
    new = s.replace_tagged_text(F.col("t"), "t", F.array(F.lit("<x>"), F.lit(None).cast("string"), F.lit("y")))
    assert values(spark, xml, "t string", new) == ['<t xml:space="preserve">&lt;x&gt;</t><t k="1">b &amp; c</t><t xml:space="preserve">y</t>']


@pytest.mark.parametrize("name,want", [("ABCDEF+TimesNewRomanPS-BoldMT", "Times New Roman"), ("Helvetica-Oblique", "Arial"), ("Foo-BoldItalic", "Foo"), ("Foo", "Foo"), ("", "Calibri"), (None, "Calibri"), ("Bold", "Calibri")])
def test_fonts(spark, name, want):
    assert values(spark, [name], "t string", s.map_font(F.col("t"))) == [want]


def test_sizes(spark):
    assert values(spark, [11.0, None, 0.0, 2.0, 200.0, 10.25], "t double", s.half_points(F.col("t"))) == [22, 22, 22, 16, 192, 21]
    assert values(spark, [-2.5, 2.5], "t double", s.js_round(F.col("t"))) == [-2, 3]
    assert values(spark, [(3.0, 4.0, 1.0, 0.0), (0.0, 0.0, 6.0, 8.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double", s.font_size_of(*map(F.col, "abcd"))) == [5.0, 10.0, 11.0]


def test_names(spark):
    paths = ["/a/b.TXT", "/a/.hidden", "/a.b/c", "/a/x.tar.gz", "/a/y."]
    assert values(spark, paths, "t string", s.ext_of(F.col("t"))) == [".txt", "", "", ".gz", "."]
    assert values(spark, ["A.DOCX", "a.b-c", "x"], "t string", s.upload_ext_of(F.col("t"))) == [".docx", "", ""]
    assert values(spark, ["a.b.pdf", "x"], "t string", s.output_name(F.col("t"), F.lit(".docx"))) == ["a.b.docx", "x.docx"]
    inside = s.is_inside(F.col("a"), F.col("b"))
    assert values(spark, [("/a", "/a/b"), ("/a", "/ab"), ("/a", "/a"), ("/a/", "/a/")], "a string, b string", inside) == [True, False, False, False]
