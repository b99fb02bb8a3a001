"""The translation core: batches, prompts, answers, retry, scatter and checks.

Segments are (doc_id, part, seg_idx, text). Folds collect indexes and lengths, never text; a batch holds at most max_items texts, so
what is grouped is bounded however long a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.core.config import LANGUAGES, JobConfig
from tonguemill.functions.scalars import is_blank, js_length, js_trim, let, overlay

KEY = ("doc_id", "part")
#: Indexes of segments of a document that one row holds the lengths of, and starts of batches that are copied when one is added.
STRETCH, NEAR = 4096, 256
RESPONSE = "struct<output_text:string,output:array<struct<text:string,content:array<string>>>,choices:array<struct<message:struct<content:string>>>>"


def split_blank(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to translate, blank): blank strings are never sent; null is the empty string."""
    rows = segments.withColumn("text", F.coalesce("text", F.lit("")))
    blank = is_blank(F.col("text"))
    return rows.where(~blank), rows.where(blank)


def _batch_fold(lens: Column, max_chars: int, max_items: int, keep: bool) -> Column:
    """The greedy rule over a list of lengths: struct(i, n, chars, batches, near, far), where n texts of chars in all are in the last batch.

    With keep, batches' starts are in far, a list of lists, and near, the last of them, so none is copied often.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("batches"), none.alias("near"), F.array().cast("array<array<int>>").alias("far"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] == 0) | (acc["chars"] + x > max_chars) | (acc["n"] >= max_items)
        full = F.size(acc["near"]) >= NEAR
        near = F.when(~new, acc["near"]).when(full, F.array(acc["i"])).otherwise(F.array_append(acc["near"], acc["i"])) if keep else acc["near"]
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, x).otherwise(acc["chars"] + x).cast("long").alias("chars"),
            (acc["batches"] + new.cast("int")).alias("batches"),
            near.alias("near"),
            (F.when(new & full, F.array_append(acc["far"], acc["near"])).otherwise(acc["far"]) if keep else acc["far"]).alias("far"),
        )

    return F.aggregate(lens, zero, step)


def batch_starts(lens: Column, max_chars: int = 7000, max_items: int = 28) -> Column:
    """Where batches begin in a list of lengths, by the greedy rule: one closes when the next text would pass max_chars or it has max_items."""
    return let(_batch_fold(lens, max_chars, max_items, keep=True), lambda r: F.flatten(F.array_append(r["far"], r["near"])))


def cut_at(items: Column, starts: Column) -> Column:
    """The stretches of a list that begin at `starts`."""
    return let(items, lambda own: let(starts, lambda s: F.transform(s, lambda a, k: F.slice(own, a + 1, F.coalesce(F.get(s, k + 1), F.size(own)) - a))))


def _stretch_entries(stretches: DataFrame, max_chars: int, max_items: int) -> DataFrame:
    """(doc_id, part, stretch, skip, before) for documents of several stretches: how many of a stretch's first texts still go to the batch
    that is open when it begins, and that batch's number.

    Whatever stands before, a stretch's first own batch begins at one of its first max_items texts. So every stretch tells, for each of
    those, how many batches it would have and what would be in the last one; a document's stretches are then gone through in order, a
    step for each, from the texts at its head and what it has told.
    """
    lens = F.col("s")["len"]
    skips = F.when(F.col("stretch") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.least(F.lit(max_items), F.size("s")) - 1))

    def told(skip: Column) -> Column:
        end = _batch_fold(F.slice(lens, skip + 1, F.size(lens)), max_chars, max_items, keep=False)
        return let(end, lambda e: F.struct(e["batches"].alias("batches"), e["n"].alias("n"), e["chars"].alias("chars")))

    total = F.aggregate(lens, F.lit(0).cast("long"), lambda acc, x: acc + x)
    summary = F.struct("stretch", F.size("s").alias("m"), total.alias("total"), F.slice(lens, 1, max_items).alias("head"), F.transform(skips, told).alias("told"))
    # the filter is above the aggregation, so both uses of the stretches share one shuffle
    docs = stretches.select(*KEY, summary.alias("x")).groupBy(*KEY).agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    entry = "array<struct<stretch:int,skip:int,before:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(-1).alias("batch"), F.array().cast(entry).alias("out"))

    def fits(acc: Column, x: Column) -> Column:
        """How many texts of the head the open batch still takes."""
        first = F.struct(F.lit(0).alias("i"), acc["chars"].alias("chars"), F.lit(True).alias("open"))

        def one(a: Column, length: Column) -> Column:
            more = a["open"] & (acc["n"] + a["i"] < max_items) & (a["chars"] + length <= max_chars)
            return F.struct((a["i"] + more.cast("int")).alias("i"), (a["chars"] + F.when(more, length).otherwise(0)).alias("chars"), more.alias("open"))

        return F.when(acc["n"] == 0, F.lit(0)).otherwise(F.aggregate(x["head"], first, one, lambda a: a["i"]))

    def step(acc: Column, x: Column) -> Column:
        def placed(skip: Column) -> Column:
            inside = skip < x["m"]
            after = F.get(x["told"], skip)
            return F.struct(
                F.when(inside, after["n"]).otherwise(acc["n"] + x["m"]).alias("n"),
                F.when(inside, after["chars"]).otherwise(acc["chars"] + x["total"]).alias("chars"),
                (acc["batch"] + F.when(inside, after["batches"]).otherwise(0)).alias("batch"),
                F.array_append(acc["out"], F.struct(x["stretch"].alias("stretch"), skip.alias("skip"), acc["batch"].alias("before"))).alias("out"),
            )

        return let(fits(acc, x), placed)

    return docs.select(*KEY, F.explode(F.aggregate("xs", zero, step, lambda acc: acc["out"])).alias("e")).select(*KEY, "e.*")


def assign_batches(segments: DataFrame, max_chars: int = 7000, max_items: int = 28, overhead: int = 8, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, part, batch_id, seg_idx) by the greedy rule, for documents of any length.

    One shuffle of lengths, by stretches of `stretch` indexes of a document, so no task gets a document whole; a document of several has
    a small row for each of them met in one place. Folds keep only where batches begin, and each batch is cut out of its stretch by position.
    """
    by = (*KEY, "stretch")
    length = F.struct("seg_idx", (js_length(F.col("text")) + overhead).alias("len"))
    rows = segments.withColumn("stretch", F.expr(f"seg_idx div {stretch}").cast("int"))
    stretches = rows.groupBy(*by).agg(F.sort_array(F.collect_list(length)).alias("s"))
    known = stretches.join(_stretch_entries(stretches, max_chars, max_items), list(by), "left")
    skip, before = F.coalesce("skip", F.lit(0)), F.coalesce("before", F.lit(-1))
    own = let(F.slice(F.col("s"), skip + 1, F.size("s")), lambda s: cut_at(s["seg_idx"], batch_starts(s["len"], max_chars, max_items)))
    # the first list is what goes to the batch that was open
    cut = F.concat(F.array(F.slice(F.col("s")["seg_idx"], F.lit(1), skip)), own)
    return known.select(*KEY, before.alias("before"), F.posexplode(cut).alias("k", "own")).select(*KEY, (F.col("before") + F.col("k")).alias("batch_id"), F.explode("own").alias("seg_idx"))


def gather_batches(segments: DataFrame, assigned: DataFrame) -> DataFrame:
    """batches (doc_id, part, batch_id, items): the texts of each batch in order."""
    # saved ids take 1.5 bytes a row as Parquet and 140 in a hash table; unhinted, Spark goes by the file and broadcasts them
    rows = segments.select(*KEY, "seg_idx", "text").join(assigned.hint("merge"), [*KEY, "seg_idx"])
    return rows.groupBy(*KEY, "batch_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))).alias("items"))


def batch_progress(assigned: DataFrame) -> DataFrame:
    """(doc_id, part, batch_id, size, done, total) after each batch."""
    sizes = assigned.groupBy(*KEY, "batch_id").agg(F.count("*").alias("size"))
    part = Window.partitionBy(*KEY)
    return sizes.select(*KEY, "batch_id", "size", F.sum("size").over(part.orderBy("batch_id")).alias("done"), F.sum("size").over(part).alias("total"))


def language_label(target: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[target], F.lit(LANGUAGES["bokmal"]))


# The instructions; {label} and {n} are filled in.
INSTRUCTIONS = (
    "Du er en profesjonell oversetter til {label}.",
    "Oversett hvert element i JSON-arrayen til naturlig, idiomatisk norsk.",
    "Behold layouten: samme antall linjeskift, tomme linjer, tabulatorer og innrykk som i kilden.",
    "Direkte oversettelse. Ikke omskriv, ikke forkort, ikke utvid, og ikke endre typografi.",
    "Ikke slå sammen avsnitt eller linjer. Ikke legg til markdown, punktlister eller overskrifter som ikke finnes i kilden.",
    "Behold tall, egennavn, e-postadresser, URL-er, koder og markup uendret når de ikke er vanlig språk.",
    "Ikke legg til forklaringer. Ikke hopp over elementer.",
    "Returner KUN et JSON-array med nøyaktig {n} strenger, i samme rekkefølge.",
)
RETRY = "\n\nSvar kun med gyldig JSON-array. Ingen annen tekst."
# Messages of the job's errors.
NO_JSON, NO_LIST, WRONG_COUNT = "Kunne ikke lese oversettelsen som JSON.", "Oversettelsen var ikke en liste.", "Forventet {} oversettelser, fikk {}."
EMPTY_ANSWER, NO_PROMPT, LONG_PROMPT, STATUS = "Tomt svar.", "Mangler tekst å oversette.", "Tekstbiten er for stor.", "{v}-feil {s}"
BAD_ANSWER = "Ugyldig svar fra {v} ({s})"


def _filled(template: str, **values: Column) -> Column:
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def json_list(texts: Column) -> Column:
    """A JSON array of strings, one on each line, indented by two."""
    quoted = F.transform(texts, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"(?s)\A\[|\]\z", ""))
    return F.concat(F.lit("[\n  "), F.array_join(quoted, ",\n  "), F.lit("\n]"))


def build_prompt(batches: DataFrame, target: Column | str = "bokmal") -> DataFrame:
    """batches with prompt: the instructions with label and count, an empty line, the texts as JSON."""
    label = language_label(F.lit(target) if isinstance(target, str) else target)
    lines = [_filled(x, label=label, n=F.size("items")) for x in INSTRUCTIONS]
    return batches.withColumn("prompt", F.concat_ws("\n", *lines, F.lit(""), json_list(F.transform("items", lambda i: i["text"]))))


def guard_prompt(df: DataFrame, max_prompt: int = 80_000) -> DataFrame:
    """df with status and error: a prompt must not be blank, nor longer than max_prompt."""
    error = F.when(is_blank(F.col("prompt")), NO_PROMPT).when(js_length(F.col("prompt")) > max_prompt, LONG_PROMPT)
    return df.withColumn("error", error).withColumn("status", F.when(error.isNull(), "ok").otherwise("error"))


def response_text(body: Column, proxy: bool = False) -> Column:
    """The answer's text: output_text, else the texts of output joined by lines, else the first choice's message, else empty.

    The proxy variant ignores bare strings in an output's content.
    """
    return let(F.from_json(body, RESPONSE), lambda r: _text_of(r, proxy))


def _text_of(r: Column, proxy: bool) -> Column:
    def content(c: Column) -> Column:
        inner = F.get_json_object(c, "$.text")
        return inner if proxy else F.when(c.rlike(r"(?s)\A\s*\{.*\}\s*\z"), inner).otherwise(c)

    parts = F.flatten(F.transform(F.coalesce(r["output"], F.array()), lambda o: F.concat(F.array(o["text"]), F.transform(F.coalesce(o["content"], F.array()), content))))
    joined = let(F.filter(parts, lambda t: t.isNotNull()), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n")))
    return F.coalesce(F.when(~is_blank(r["output_text"]), r["output_text"]), joined, F.get(r["choices"], F.lit(0))["message"]["content"], F.lit(""))


def response_error(body: Column, status: Column, proxy: bool = False, vendor: str = "API") -> Column:
    """Null for a good answer with text; else its error, message, first 240 characters (no JSON), or the status with the vendor's name.

    The proxy variant gives no part of an answer that isn't JSON, only its status.
    """
    bad_json = F.from_json(body, "map<string,string>").isNull()
    fallback = _filled(STATUS, v=F.lit(vendor), s=status)
    flat, inner, message = F.get_json_object(body, "$.error"), F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message")
    plain = F.when(~is_blank(flat) & ~flat.startswith("{"), flat)
    said = F.coalesce(plain, inner, F.when(~is_blank(message), message), fallback)
    failed = F.when(bad_json, F.when(is_blank(body), fallback).otherwise(F.substring(body, 1, 240))).otherwise(said)
    if proxy:
        failed = F.when(bad_json, _filled(BAD_ANSWER, v=F.lit(vendor), s=status)).when(status == 401, F.lit("Logg inn på nytt.")).otherwise(failed)
    return F.when(~status.between(200, 299) | bad_json, failed).when(is_blank(response_text(body, proxy)), EMPTY_ANSWER)


def parse_translation_array(text: Column, expected: Column) -> Column:
    """struct(items, error): the list between the first `[` and the last `]`, without code fences; it must have `expected` items."""
    bare = js_trim(F.regexp_replace(F.regexp_replace(text, r"\A(?i)```(?:json)?\s*", ""), r"\s*```\z", ""))
    return let(bare, lambda b: _list_of(b, expected))


def _list_of(bare: Column, expected: Column) -> Column:
    first, last = F.instr(bare, "["), F.length(bare) - F.instr(F.reverse(bare), "]") + 1
    missing = (first == 0) | (F.instr(bare, "]") == 0) | (last <= first)
    found = F.from_json(F.when(~missing, F.substring(bare, first, last - first + 1)), "array<string>")
    return let(F.struct(missing.alias("m"), found.alias("i")), lambda x: _counted(x["m"], x["i"], expected))


def _counted(missing: Column, items: Column, expected: Column) -> Column:
    count = _filled(WRONG_COUNT.replace("{}", "{e}", 1).replace("{}", "{g}"), e=expected, g=F.size(items))
    error = F.when(missing | items.isNull(), NO_JSON).when(F.size(items) != expected, count)
    return F.struct(F.when(error.isNull(), F.transform(items, lambda x: F.coalesce(x, F.lit("")))).alias("items"), error.alias("error"))


def read_responses(responses: DataFrame, proxy: bool = False, vendor: str = "API") -> DataFrame:
    """responses (..., http_status, expected, body) with translations and error."""
    failed = response_error(F.col("body"), F.col("http_status"), proxy, vendor)
    parsed = parse_translation_array(js_trim(response_text(F.col("body"), proxy)), F.col("expected"))
    # a row exploded from itself: filters on the error stay above, so no answer is parsed twice
    told = responses.withColumn("__r", F.explode(F.array(F.struct(failed.alias("e"), parsed.alias("p")))))
    return told.withColumn("translations", F.when(F.col("__r.e").isNull(), F.col("__r.p.items"))).withColumn("error", F.coalesce("__r.e", "__r.p.error")).drop("__r")


def retry_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per batch from two attempts: the first good answer; if both failed, the first attempt's error."""
    both = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    good = F.col("error").isNull()
    return both.groupBy(*KEY, "batch_id").agg(F.min_by(F.when(good, F.col("translations")), F.when(good, F.col("attempt"))).alias("translations"), F.min_by("error", "attempt").alias("first_error"), F.max(good).alias("ok")).select(
        *KEY, "batch_id", "translations", F.when(~F.col("ok"), F.col("first_error")).alias("error")
    )


def scatter(segments: DataFrame, batches: DataFrame, answers: DataFrame) -> DataFrame:
    """segments with translated texts at their places; what has no answer keeps its text."""
    done = batches.join(answers, [*KEY, "batch_id"]).where("translations is not null")
    pairs = F.arrays_zip(F.transform("items", lambda i: i["seg_idx"]).alias("seg_idx"), F.col("translations").alias("t"))
    placed = done.select(*KEY, F.explode(pairs).alias("p")).select(*KEY, "p.seg_idx", F.col("p.t").alias("translated"))
    return segments.join(placed, [*KEY, "seg_idx"], "left").withColumn("text", F.coalesce("translated", "text", F.lit(""))).drop("translated")


def document_status(answers: DataFrame) -> DataFrame:
    """(doc_id, n_batches, ok, error): a document is good if all of its batches are; its error is that of its first bad batch."""
    bad = F.col("error").isNotNull()
    return answers.groupBy("doc_id").agg(F.count("*").alias("n_batches"), F.bool_and(~bad).alias("ok"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.struct("part", "batch_id"))).alias("error"))


# What the instructions ask to keep unchanged.
KEPT = r"https?://[^\s<>\"]+|[\w.+-]+@[\w-]+\.[\w.-]+|[0-9]+(?:[.,:][0-9]+)*"


def layout_check(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """pairs with the counts that must agree, the tokens lost, and whether the layout was kept."""
    count = lambda c, s: F.size(F.split(F.coalesce(F.col(c), F.lit("")), s, -1)) - 1
    tokens = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({KEPT})"), F.lit(1))
    out = pairs
    for name, mark in (("lines", "\n"), ("gaps", "\n\n"), ("tabs", "\t")):
        out = out.withColumn(f"d_{name}", count(target, mark) - count(source, mark))
    out = out.withColumn("lost", F.array_sort(F.array_except(tokens(source), tokens(target))))
    return out.withColumn("kept", (F.col("d_lines") == 0) & (F.col("d_gaps") == 0) & (F.col("d_tabs") == 0) & (F.size("lost") == 0))


def layout_losses(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """pairs with lost and added, arrays of (token, n), and in_order: whether the same tokens stand in the same order.

    Tokens are counted as often as they stand: a number that stood three times and stands once is lost twice. The source's and the target's
    are sorted together, and each run of equal ones is summed, so long texts cost a sort.
    """
    tokens = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({KEPT})"), F.lit(1))
    signed = lambda of, d: F.transform(of, lambda t: F.struct(t.alias("token"), F.lit(d).alias("n")))

    def runs(all_: Column) -> Column:
        begins = F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | (F.get(all_, F.greatest(i - 1, F.lit(0)))["token"] != x["token"]), i)), lambda i: i.isNotNull())
        total = lambda a, b: F.aggregate(F.slice(all_, a + 1, b - a), F.lit(0), lambda acc, x: acc + x["n"])
        return let(begins, lambda own: F.transform(own, lambda a, k: F.struct(F.get(all_, a)["token"].alias("token"), total(a, F.coalesce(F.get(own, k + 1), F.size(all_))).alias("n"))))

    told = pairs.withColumn("__t", F.struct(tokens(source).alias("s"), tokens(target).alias("t")))
    told = told.withColumn("__r", let(F.sort_array(F.concat(signed(F.col("__t.s"), 1), signed(F.col("__t.t"), -1))), runs))
    turned = lambda x: F.struct(x["token"].alias("token"), (-x["n"]).alias("n"))
    out = told.withColumn("lost", F.filter("__r", lambda x: x["n"] > 0)).withColumn("added", F.transform(F.filter("__r", lambda x: x["n"] < 0), turned))
    return out.withColumn("in_order", F.col("__t.s") == F.col("__t.t")).drop("__t", "__r")


def translate_rows(rows: DataFrame, translator, config: JobConfig | None = None) -> DataFrame:
    """rows (doc_id, part, texts, ...), a document's part each with its texts in order, with the texts translated and n_batches, n_texts
    and answers (batch_id, error) added. Null becomes the empty text; blank ones are never sent; those without an answer stay.

    Batches are cut within the row, so nothing is shuffled before the translator. One that has a `column` works in the row itself; for
    others the batches become rows, and their answers are gathered by part and meet the rows again: two shuffles.
    """
    c = config or JobConfig("", "")
    texts = F.transform("texts", lambda t: F.coalesce(t, F.lit("")))
    items = lambda own: F.filter(F.transform(own, lambda t, i: F.struct(i.alias("seg_idx"), t.alias("text"))), lambda x: ~is_blank(x["text"]))
    starts = lambda own: batch_starts(F.transform(own, lambda x: js_length(x["text"]) + c.overhead), c.max_chars, c.max_items)
    cut = rows.withColumn("texts", texts).withColumn("batches", let(items(F.col("texts")), lambda own: cut_at(own, starts(own))))
    state = lambda k, items, error: F.struct(k.alias("batch_id"), items.alias("translations"), error.alias("error"))
    if hasattr(translator, "column"):
        told = cut.withColumn("answers", F.transform("batches", lambda b, k: state(k, translator.column(b, c), F.lit(None).cast("string"))))
    else:
        answers = translator(cut.select(*KEY, F.posexplode("batches").alias("batch_id", "items")), c)
        gathered = answers.groupBy(*KEY).agg(F.sort_array(F.collect_list(state(F.col("batch_id"), F.col("translations"), F.col("error")))).alias("answers"))
        told = cut.join(gathered, [*KEY], "left").withColumn("answers", F.coalesce("answers", F.array()))
    new = F.flatten(F.transform("answers", lambda a: F.coalesce(F.zip_with(F.get("batches", a["batch_id"]), a["translations"], lambda x, t: F.struct(x["seg_idx"].alias("i"), t.alias("t"))), F.array())))
    told = told.withColumn("texts", overlay(F.col("texts"), new)).withColumn("n_batches", F.size("batches")).withColumn("n_texts", F.size(F.flatten("batches")))
    return told.withColumn("answers", F.transform("answers", lambda a: F.struct(a["batch_id"].alias("batch_id"), a["error"].alias("error")))).drop("batches")


def row_status(rows: DataFrame) -> DataFrame:
    """(doc_id, n_batches, ok, error) of translated rows; those without a text to send have no state."""
    some = rows.where(F.size("answers") > 0)
    return document_status(some.select("doc_id", "part", F.explode("answers").alias("a")).select("doc_id", "part", "a.batch_id", "a.error"))


def translate_segments(segments: DataFrame, translator, config: JobConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments with translations, batches with their state) by a translator (see translators.py)."""
    c = config or JobConfig("", "")
    work, _ = split_blank(segments)
    batches = gather_batches(work, assign_batches(work, c.max_chars, c.max_items, c.overhead))
    answers = translator(batches, c)
    return scatter(segments, batches, answers), answers
