"""Personal data: base forms against the contract's expressions, discovered ones in texts whose contexts tell them."""

import hashlib
import random
import re
import time

from tonguemill.llm import personal, registry
from tonguemill.llm.common import Scratch

SCHEMA = "doc_id long, text string, base string, found int, instance string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """Base spans by the expressions as they stand."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in odd) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_forms_match_their_expressions():
    rng = random.Random(8)
    for alphabet, n in (("a.@-", 20_000), ("0123.@ ", 20_000), ("4 -+()", 10_000), ("0123456789 -+.", 20_000), ("aé😀@.b1 \n+", 10_000)):
        for _ in range(n // 10):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert personal.base_spans(text) == plain(text), text
    for text in ("1.2.3.4.5.6.7.8", "a@b@c.d", "x 999.1.1.1 0001.002.3.255", "4111 1111 1111 1111", "+1 (523) 555-1055.", "++12345678 +1 2"):
        assert personal.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 " * 150_000 + "x", ("x" * 100 + " at ") * 3000, "a:" * 150_000):
        base = personal.base_spans(text)
        personal.candidates(text, base)
    assert time.time() - began < 60


def test_candidates_keep_off_base_spans():
    text = "mail a@b.example or b (at) c dot example, 4111 1111 1111 1111, 22 33 44 55, 1[.]2[.]3[.]4, 1:2:3:4:5:6:7:8, 12345"
    base = personal.base_spans(text)
    got = [(personal.KINDS[k], text[a:b]) for k, a, b in personal.candidates(text, base)]
    assert got == [("email", "b (at) c dot example"), ("ip", "1[.]2[.]3[.]4"), ("ip", "1:2:3:4:5:6:7:8"), ("phone", "22 33 44 55")]
    assert personal.instance(0, "b (at) c dot Example") == "b@c.example" and personal.instance(1, "1[.]2[.]3[.]4") == "1.2.3.4"


def test_contexts_are_words_of_the_line():
    text = "skip\nRing (oss) på Tel: 5"
    assert personal.context(text, text.index("5")) == ["oss".encode(), "på".encode(), b"tel:"]
    assert personal.context("Tel: 5", 5) == [b"^", b"tel:"] and personal.context("5", 0) == [b"^"]
    assert personal.context("a\n" + "x" * 50 + " b 5", 55) == [b"b"] and personal.context("y " * 300 + "5", 600) == [b"y"] * 3
    assert [w for w, _ in personal.patterns("Tel: 5", 5)] == [b"tel:", b"^ tel:"]


def corpus():
    rows = [f"Kontakt oss på tel: +47 22 33 44 {i:02}." for i in range(10, 16)]  # seeds
    rows += ["Ring tel: 99 88 77 66 nå", "Ring tel: 99 88 77 66 igjen"]  # told by `tel:`
    rows += ["Kundenummer: 99 88 77 66 og kundenummer: 55 44 33 22", "Kundenummer: 11 22 33 44"]  # one told instance isn't enough for a pattern
    rows += [f"sett den +47 22 33 45 {i:02}" for i in range(10, 14)] + ["legg den 12 34 56 78 ned"] + ["så den gamle boka"] * 20  # `den` says nothing
    rows += [f"epost ola.{i}@post.example" for i in range(4)] + ["epost kari (at) post dot example"]
    return rows + [None, "", "intet her", "x" * 60_000 + " tel: 44 55 66 77"]


def test_contexts_discover_identifiers(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "b", 1, "i") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in personal.find_personal_data(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert [tuple(s) for s in got[i].base] == plain(t)
    told = {i: [(personal.KINDS[s.kind], rows[i][s.start : s.end]) for s in r.discovered] for i, r in got.items() if r.discovered}
    last = len(rows) - 1
    assert told == {6: [("phone", "99 88 77 66")], 7: [("phone", "99 88 77 66")], rows.index("epost kari (at) post dot example"): [("email", "kari (at) post dot example")], last: [("phone", "44 55 66 77")]}
    scores = {(r.kind, r.words): r for r in personal.learn_patterns(docs, personal.find_base(docs), Scratch(spark, "t")).collect()}
    assert scores[3, "tel:"].score > 0.95 and scores[3, "tel:"].instances == 8 and scores[3, "tel:"].places == 9
    assert scores[3, "den"].places == 25 and scores[3, "den"].score < 0.2


def test_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "", 0, "")] * 3 + [(None, "ring +4712345678", "", 0, "")], SCHEMA)
    got = personal.find_personal_data(docs).collect()
    assert sorted((r.doc_id or 0, len(r.base)) for r in got) == [(0, 1), (1, 1), (1, 1), (1, 1)]
    assert personal.find_personal_data(docs.limit(0)).collect() == []


def test_personal_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op11_personal_data"](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        told = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(",")) and r.n_discovered == (len(r.spans.split(",")) if r.spans else 0) - len(base)
