"""Predicates and scalar functions, all JVM-side.

Lengths count UTF-16 code units and blanks are the white space that a JavaScript trim removes; Spark's own functions count code
points and trim only spaces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\s\p{Z}\x{FEFF}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def overlay(texts: Column, new: Column) -> Column:
    """A list of texts with those of `new`, structs of (i, t), at their places. By sorting, so long lists cost no more than that."""
    mine = F.transform(new, lambda x: F.struct(x["i"].alias("i"), F.lit(0).alias("k"), x["t"].alias("t")))
    both = F.sort_array(F.concat(mine, F.transform(texts, lambda t, i: F.struct(i.alias("i"), F.lit(1).alias("k"), t.alias("t")))))
    first = let(both, lambda own: F.filter(own, lambda x, k: (k == 0) | (F.get(own, F.greatest(k - 1, F.lit(0)))["i"] != x["i"])))
    return F.transform(first, lambda x: x["t"])


def js_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + F.lit(0.5))


# The patterns of blanks, letters, numbers and cell references below.
def is_blank(c: Column) -> Column:
    """Null counts as the empty string."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{BLANK}]")


def has_letter(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[A-Za-zÀ-ÿ]")


def looks_numeric(c: Column) -> Column:
    """Blank, a formula-like string with a cell reference, or digits with only separators and currency letters."""
    t = js_trim(F.coalesce(c, F.lit("")))
    formula = t.rlike(r"\A[=+\-/*]") & t.rlike(r"(?i)[A-Z]+[0-9]+")
    return (t == "") | formula | (t.rlike(rf"\A[0-9{BLANK}.,:%€$krNOK\-]+\z") & t.rlike("[0-9]"))


# Names of the container parts that hold text.
TEXT_PARTS = {"docx": r"\Aword/(?:document|header[0-9]*|footer[0-9]*|footnotes|endnotes)\.xml\z", "pptx": r"\Appt/(?:slides|notesSlides)/.+\.xml\z"}


def is_text_part(name: Column, dialect: str) -> Column:
    return name.rlike(TEXT_PARTS[dialect])


def is_inside(parent: Column, child: Column) -> Column:
    """child is strictly inside parent; both are normalized paths."""
    return child.startswith(F.concat(F.regexp_replace(parent, r"/+\z", ""), F.lit("/"))) & (F.length(child) > F.length(F.regexp_replace(parent, r"/+\z", "")) + 1)


# XML's five entities, in the order in which they are escaped.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def _replace_all(c: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_xml(c: Column) -> Column:
    return _replace_all(c, ENTITIES)


def _numeric(c: Column, entity: str, code) -> Column:
    """Each numeric entity becomes the UTF-16 code unit of its number modulo 65536; half a surrogate pair becomes U+FFFD."""

    def one(token: Column) -> Column:
        n = code(F.regexp_extract(token, entity, 1)) % 65536
        unit = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")
        return F.when(~token.rlike(rf"\A{entity}\z"), token).when(n.between(0xD800, 0xDFFF), "\ufffd").otherwise(unit)

    plain = entity.replace("(", "(?:")
    joined = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"({plain}|[^&]+|&)"), F.lit(1)), one), "")
    return F.when(c.rlike(entity), joined).otherwise(c)


def decode_xml_entities(c: Column) -> Column:
    """Named entities, then decimal, then hexadecimal ones, and `&amp;` last."""
    named = _replace_all(c, [(e, t) for t, e in ENTITIES[1:]])
    decimal = _numeric(named, "&#([0-9]+);", lambda d: F.try_to_number(F.lpad(F.substring(d, -30, 30), 30, "0"), F.lit("9" * 30)).cast("decimal(38,0)"))
    hexed = _numeric(decimal, "&#x([0-9a-fA-F]+);", lambda d: F.conv(F.substring(d, -4, 4), 16, 10).cast("long"))
    return F.replace(hexed, F.lit("&amp;"), F.lit("&"))


def tag_pattern(tag: str) -> str:
    return rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"


def extract_tagged_text(xml: Column, tag: str) -> Column:
    """Decoded text of every element of that name."""
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), decode_xml_entities)


def replace_tagged_text(xml: Column, tag: str, values: Column) -> Column:
    """The i-th element gets the i-th value, escaped; null or missing values keep it. Rewritten tags preserve spaces."""
    found = F.regexp_extract_all(xml, F.lit(f"({tag_pattern(tag)})".replace("((?s)", "(?s)(")), F.lit(1))
    gaps = F.split(xml, tag_pattern(tag), -1)

    def one(element: Column, i: Column) -> Column:
        attrs = F.regexp_extract(element, rf"\A<{tag}(\s[^>]*)?>", 1)
        attrs = F.when(attrs.contains("xml:space"), attrs).otherwise(F.concat(attrs, F.lit(' xml:space="preserve"')))
        value = F.get(values, i)
        return F.when(value.isNull(), element).otherwise(F.concat(F.lit(f"<{tag}"), attrs, F.lit(">"), escape_xml(value), F.lit(f"</{tag}>")))

    return F.array_join(F.zip_with(gaps, F.transform(found, one), lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")


# Words in a font's name and the family they stand for; the first that fits counts.
FONTS = (
    ("times", "Times New Roman"),
    ("courier", "Courier New"),
    ("helvetica", "Arial"),
    ("arial", "Arial"),
    ("georgia", "Georgia"),
    ("garamond", "Garamond"),
    ("calibri", "Calibri"),
    ("cambria", "Cambria"),
    ("verdana", "Verdana"),
    ("tahoma", "Tahoma"),
    ("trebuchet", "Trebuchet MS"),
    ("palatino", "Palatino Linotype"),
    ("bookman", "Bookman Old Style"),
    ("century", "Century Schoolbook"),
)
STYLES = "Bold|Italic|Oblique|Regular|Medium|Light|Roman|Black|SemiBold"


def map_font(name: Column) -> Column:
    raw = F.regexp_replace(F.coalesce(name, F.lit("")), r"\A[A-Z]{6}\+", "")
    known = reduce(lambda acc, f: acc.when(F.lower(raw).contains(f[0]), f[1]), FONTS[1:], F.when(F.lower(raw).contains(FONTS[0][0]), FONTS[0][1]))
    plain = js_trim(F.regexp_replace(raw, rf"(?i)[-,]?(?:{STYLES}).*\z", ""))
    return known.otherwise(F.when(plain == "", "Calibri").otherwise(plain))


def half_points(pt: Column) -> Column:
    size = F.when(pt.isNull() | F.isnan(pt.cast("double")) | (pt == 0), F.lit(11.0)).otherwise(pt.cast("double"))
    return F.least(F.greatest(js_round(2 * size), F.lit(16)), F.lit(192)).cast("int")


def pt_to_twips(pt: Column) -> Column:
    return js_round(20 * pt.cast("double")).cast("int")


def font_size_of(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of the matrix's first pair, else of its second, else 11."""
    return F.coalesce(F.nullif(F.hypot(a, b), F.lit(0.0)), F.nullif(F.hypot(c, d), F.lit(0.0)), F.lit(11.0))


def ext_of(path: Column) -> Column:
    """From the last dot of the last name, unless that dot begins it; lower case, else empty."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def upload_ext_of(name: Column) -> Column:
    """The variant for uploads: only letters and digits count."""
    return F.regexp_extract(F.lower(name), r"(\.[a-z0-9]+)\z", 1)


def output_name(name: Column, out_ext: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+\z", ""), out_ext)
