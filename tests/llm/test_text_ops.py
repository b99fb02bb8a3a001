"""Row-by-row operators: brute force, and nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re

import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonguemill.llm import bpe, langid, licenses, packing, quality, registry, urls

ODD = "abAB  \n\n\t\0\r\x0b\x1c\x85\u00a0 'sreé9²Ⅳß中文😀#-=.,!<|>"


def docs(spark, texts, extra=""):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra or 'lang'} long")


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return [None, "", " ", "a", "\0", "x" * 50_000, *["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(2000)]]


def test_bpe_is_exact(spark, odd_texts):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode_ids(bpe.encode_texts(docs(spark, odd_texts, "ids"), path), path).orderBy("doc_id").collect()
    assert len(out) == len(odd_texts)
    for r, t in zip(out, odd_texts):
        assert r.ids == want.encode_ordinary(t or "") and r.decoded == (t or "").encode()


def test_bpe_empty_table(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.decode_ids(bpe.encode_texts(docs(spark, []), path), path).count() == 0


def test_bpe_ids_of_odd_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1]), (3, [0, 1])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode_ids(rows, path).orderBy("doc_id").collect()] == [b"", b"", b'!"', b'!"']


def test_bpe_query_digests(spark, data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op2_byte_bpe"](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_text_ids_are_exact(odd_texts):
    path = P.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), [t or "" for t in odd_texts] + ["a <|endoftext|> b", "the cat sat\non the mat", "it's\n'tis 's\nx 42\n42", "\nx", "x\n", "a\n\nb"] * 2
    got = packing.TextIds(path).encode(texts)
    assert packing.TextIds(path).fast and not packing.TextIds(P.path("word_bpe_49k.json")).fast
    assert [list(memoryview(g).cast("i")) for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_license_base_places_and_edits(spark):
    texts = ["MIT License. mit license", "CC-BY 4.0; cc by", None, "", "permit license", "Relaesed under the MIT Licence", "GNU Genral Public License", "Émit license", "gnu general public license " * 3000]
    out = licenses.scan_licenses(docs(spark, texts, "n_words")).orderBy("doc_id").collect()
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r, t in zip(out, texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [i for p in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert [r.labels for r in out[:8]] == ["mit", "cc-by", "", "", "", "mit", "gpl", ""]
    assert out[5].n_base == 0 and 0 < out[5].score < 1 and out[5].spans[0].edits == 3


@pytest.mark.parametrize("notice", licenses.METHOD_NOTICES, ids=lambda n: n.text[:24])
def test_license_seeds_miss_nothing(notice):
    """Every place with few enough edits holds a seed: compared with fuzzy matching of the whole text, up to the bound and beyond."""
    rng = random.Random(len(notice.text))
    for k in range(60):
        s = list(notice.text)
        for _ in range(k % (notice.edits + 3)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], ["q"], [s[at], "z"]])
        norm = licenses.normal_form("foo " + "".join(s) + " bar")
        found = licenses.find_notices(norm, (notice,))
        assert bool(found) == bool(notice.pattern.search(norm))
        assert all(f[3] <= notice.edits for f in found)


def test_license_columns_and_rows(spark):
    rows = docs(spark, ["mit license", "mit license", ""], "labels")
    assert [r.labels for r in licenses.scan_licenses(rows).orderBy("doc_id").collect()] == ["mit", "mit", ""]
    assert licenses.scan_licenses(rows.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError, match="labels"):
        licenses.scan_licenses(rows, keep=("doc_id", "labels"))


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://EXAMPLE.org/es/x?q#f": ("example.org", "/es/x", "example.org/es/", "block"),
        "http://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://a.example.org/en/21": ("a.example.org", "/en/21", "org/", "allow"),
        "https://casino.com/x": ("casino.com", "/x", None, "block"),
        "https://casino.com/fr/": ("casino.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "x://b.com/DE/": ("b.com", "/DE/", None, "allow"),
        "http://org?x": ("org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = urls.judge_urls(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())
    assert urls.judge_urls(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("most", [urls.INDEX_BYTES, 0])
def test_urls_with_many_rules(spark, most):
    """20,000 rules, as a constant and as a table, against trying each; with long, repeated and null URLs, and rules of one length."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    hosts = sorted({f"{word(3)}.{word(5)}.com" for _ in range(10_000)})
    rules = [urls.host_rule(rng.choice(["allow", "block"]), h, rng.choice(["/", "/a/", "/b"])) for h in hosts]
    words = sorted({word(6) for _ in range(10_000)})
    rules += [urls.word_rule(w) for w in words]
    own = [f"http://{rng.choice(['', 'www.', 'x'])}{rng.choice(hosts)}{rng.choice(['/', '/a/1', '/b2', ''])}" for _ in range(150)] + [f"http://{rng.choice(words)}-{rng.choice(words)}.net/{word(4)}" for _ in range(50)]
    own += [own[0]] * 3 + [None, "http://" + "a." * 20_000 + hosts[0] + "/" + "a/" * 20_000]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(own)], "page_id long, url string, key string")
    got = {r.page_id: r for r in urls.judge_urls(df, rules=tuple(rules), index_bytes=most).collect()}
    base = {r.name: r for r in rules if r.base}
    blocked = set(words)
    for i, u in enumerate(own):
        host, _, rest = (u or "").partition("://")[2].partition("/")
        path = "/" + rest if rest or (u or "").endswith("/") else ""
        labels = host.split(".")
        fits = [n for k in range(max(0, len(labels) - 3), len(labels)) for h in [".".join(labels[k:])] for p in ("/", "/a/", "/b", "/x") if (n := h + p) in base and path.startswith(p)]
        rule = max(fits, key=lambda n: (len(n), n), default=None)
        words_fit = sorted({w for w in re.findall("[a-z0-9]+", host) if w in blocked})
        assert (got[i].rule, got[i].key) == (rule, "k") and got[i].method_rules == words_fit
        assert got[i].verdict == (base[rule].action if rule else "block" if words_fit else "allow")


def test_urls_ties(spark):
    """Two base rules of one length that fit: the last by name decides."""
    rules = (urls.UrlRule("b-rule", "block", r"\Aa\.com/.*", ("com",), True), urls.UrlRule("a-rule", "allow", r"\Aa\.com/.*", ("a",), True))
    got = urls.judge_urls(spark.createDataFrame([("http://a.com/",)], "url string"), rules=rules).first()
    assert (got.rule, got.verdict) == ("b-rule", "block")


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a", "a b c a b c", "x\nx\n\ny\nx", "# $$ a<b>", *[" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 90))) for _ in range(60)], "w " * 20_000]
    got = quality.apply_policy(quality.ledger(docs(spark, texts, "kept"))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x in set(win) if len(w) < 1000 and win.count(x) > 1} if len(w) < 1000 else set(win)
        covered = {j for i, x in enumerate(win) if x in many for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_ablations(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (0,), (4,)], "failures int")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(df).collect()}
    assert got["few_words"] == (3, 2, 3) and got["repeated_windows"] == (1, 0, 1) and got["symbols"] == (1, 1, 2)


def test_language(spark, data):
    src = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(src)
    odd = docs(spark, [None, "", "12 34", "the", "x" * 100_000], "score")
    out = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out) and out[3].lang_pred in model.langs
    named = langid.identify(src, model).where(langid.is_held_out(F.col("doc_id")))
    assert named.where("lang = lang_pred").count() > 0.95 * named.count()
    none = langid.fit(docs(spark, []).select("doc_id", "text", F.col("lang").cast("string")))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 9, 20):
        c = langid.codewords(n)
        assert min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) >= 2


def test_bpe_keeps_no_long_words():
    """A worker's cache is bounded in bytes too: words without end are encoded, but not kept."""
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, texts = bpe.encoder(path), ["x" * 3000 + " short " + "ab" * 4000, "q" * 64 + "\nshort"]
    first, again = own.encode_packed(texts), own.encode_packed(texts)
    assert first == again and [list(memoryview(x).cast("i")) for x in first] == [want.encode_ordinary(t) for t in texts]
    assert max(map(len, [*own.inner, *own.first, *own.old, *own.pieces])) < bpe.LONG and "short" in own.inner
