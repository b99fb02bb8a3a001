"""Quality rules as a bitmask ledger: every rule is evaluated once; policies and ablations are bit operations on the stored failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import table

BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters that are not blanks; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the list.

    Hashes tell the texts without an equal pair of windows; in the others equal windows meet by sorting, never by comparing pairs.
    """
    n = F.size(ws) - 2
    three = [F.slice(ws, k, n) for k in (1, 2, 3)]
    hashes = F.transform(F.arrays_zip(*three), lambda z: F.xxhash64(z))
    windows = F.sort_array(F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(three)], F.sequence(F.lit(1), n).alias("i")))

    def twice(s: Column) -> Column:
        named = s.cast("array<struct<a:string,b:string,c:string,i:int>>")
        equal = lambda x, y: (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"])
        pairs = lambda t: F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda x, y: F.when(equal(x, y), F.array(x["i"], y["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(_let(named, pairs), lambda p: p.isNotNull()))))

    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda starts: F.aggregate(starts, zero, lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"), s.alias("last")), lambda acc: acc["n"])
    return F.when(n < 2, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(covered(twice(windows)))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    m = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.struct(n_symbols.cast("long").alias("n_symbols"), dup_lines(text).cast("long").alias("n_dup_lines"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    # a row exploded from itself: filters on a measurement stay above, so nothing is measured twice
    told = docs.withColumn("__m", F.explode(F.array(F.struct(m.alias("w"), lines.alias("l")))))
    for name, at in (("n_words", "w"), ("word_chars", "w"), ("n_symbols", "l"), ("n_lines", "l"), ("n_dup_lines", "l"), ("n_repeat_words", "w")):
        told = told.withColumn(name, F.col(f"__m.{at}.{name}"))
    return told.drop("__m")


#: Bit, name, failure. Bits never change their meaning; a new rule takes the next bit. Bits 0 and 1 are the contract's base rules.
RULES = (
    (0, "few_words", lambda: F.col("n_words") < 50),
    (1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    (2, "symbols", lambda: 100 * F.col("n_symbols") > 15 * F.col("word_chars")),
    (3, "repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    (4, "long_words", lambda: F.col("word_chars") > 40 * F.col("n_words")),
    (5, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
)
#: Version: rules whose failure removes a document. Versions stay as they are; a change is a new version.
POLICIES = {"base": 0b000011, "v1": 0b111111}


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and `failures`, one bit for each rule.

    Null and empty texts have no words and fail few_words; an empty table gives none. Each row is judged by its own text alone, so ties, repeats and hot
    sources need no shuffle. Columns of the input with the result's names are replaced.
    """
    m = measure(docs, text_col)
    bits = [F.when(fails(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, fails in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return m.withColumn("failures", failures)


def apply_policy(led: DataFrame, version: str = "v1") -> DataFrame:
    """ledger with base_failed and kept under the policy's version."""
    failed = lambda mask: F.col("failures").bitwiseAND(F.lit(mask)) != 0
    return led.withColumn("base_failed", failed(POLICIES["base"])).withColumn("kept", ~failed(POLICIES[version] | POLICIES["base"]))


def ablations(led: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, documents only it removes, and documents kept without it.

    One aggregation to a row for each distinct bitmask; the rules are then applied to those few rows.
    """
    mask = POLICIES[version]
    masks = led.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(1 << b).alias("bit"), F.lit(name).alias("rule")) for b, name, _ in RULES if mask >> b & 1]))
    one = masks.withColumn("r", rules)
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    bit, f = F.col("r.bit"), F.col("f")
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        add(f.bitwiseAND(bit) != 0).alias("n_failed"), add(f == bit).alias("n_only"), add(f.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without")
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, what each of them removes: one pass over documents, then bits of the distinct masks."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, len(string_split(text, chr(10))) AS n_lines FROM d),
m AS (SELECT w.doc_id, w.rid, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_lines
      FROM w JOIN l USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 15 * word_chars)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
            + 16 * (word_chars > 40 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT AS INTEGER) AS failures,
       NOT (base_failed OR 100 * n_symbols > 15 * word_chars OR 2 * n_dup_lines > n_lines OR word_chars > 40 * n_words OR word_chars < 2 * n_words) AS kept
FROM f
"""
ABLATION_SQL = f"""
WITH led AS ({SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << bit})" for bit, name, _ in RULES)})
SELECT rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failures = bit) AS BIGINT) AS n_only,
       CAST(count(*) FILTER (failures & ~bit = 0) AS BIGINT) AS n_kept_without
FROM led, r GROUP BY rule
"""
