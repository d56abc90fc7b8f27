import hashlib
import random
import re
import time

from duploscope.llm import pii
from duploscope.llm.queries import QUERIES
from tests.llm.odd import empty_documents, odd_documents

# The patterns that the base kinds are to follow.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if right(kind, m[0])
    ]


def check(spark, rows):
    got = pii.span_report(odd_documents(spark, rows)).collect()
    texts = {}
    for doc_id, text in rows:
        texts[doc_id] = text
    assert len(got) == len(rows)
    for r in got:
        expected = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), (texts[r.doc_id], r.spans, expected)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in expected) for k in PLAIN]
        assert r.spans.split(",")[: len(expected)] == (expected or r.spans.split(",")[:0])
    return {r.doc_id: r.spans for r in got}


def test_odd_tables(spark):
    check(spark, [(r.doc_id, r.text) for r in odd_documents(spark).collect()])
    assert pii.span_report(empty_documents(spark)).count() == 0


def test_random_texts(spark):
    rng = random.Random(4)
    bits = ["@", ".", "-", "+", " ", "a", "Zb", "1", "23", "4.5.6.7", "255", "300", "é😀", "_", "%", "(", ")", "\n", "a@b.cc", "4222222222222", "+1 (555) 010-9999", "::", "01"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(3_000)]
    check(spark, rows)


def long_runs(n):
    texts = [
        "a" * n, "1" * n, "1 " * n, "1." * n, "a@b." * n, "+1" + "(" * n, "a@b.cc " * (n // 5), "+1234567890 " * (n // 10), "A1" * n,
        "é1.2.3.4" * (n // 10),
    ]
    return list(enumerate(texts))


def test_long_runs(spark):
    check(spark, long_runs(5_000))  # the plain patterns take quadratic time on them


def test_long_runs_take_linear_time_and_no_stack(spark):
    started = time.time()
    got = {r.doc_id: r for r in pii.span_report(odd_documents(spark, long_runs(200_000))).collect()}
    assert got[6].n_email == 40_000 and got[7].n_phone == 20_000
    assert time.time() - started < 60


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spans = check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.spans for r in QUERIES["op10_pii"](spark, "/root/testdata/sf0.01").collect()}
    assert got == spans and sum(bool(s) for s in spans.values()) > 20


def test_added_kinds_need_checksum_and_context(spark):
    rows = [
        (1, "my bank account: GB82 WEST 1234 5698 7654 32 thanks"), (2, "IBAN DE89370400440532013000."), (3, "IBAN DE88370400440532013000."),
        (4, "code GB82 WEST 1234 5698 7654 32"), (5, "ssn 123-45-6789"), (6, "no. 123-45-6789"), (7, "ssn 000-45-6789"),
    ]
    spans = check(spark, rows)
    assert spans[1] == "iban:17:44" and spans[2] == "iban:5:27" and spans[5] == "ssn:4:15"
    assert spans[4] == "iban:5:32"  # the checksum alone reaches the score
    assert not any(spans[n] for n in (3, 6, 7))


def test_accounts_before_capitals_and_numbers_in_lists(spark):
    listed = ", ".join(f"123-45-{n}" for n in range(1001, 1101))
    rows = [
        (1, "DE89370400440532013000 BIC"), (2, "DE89 3704 0044 0532 0130 00 EUR 500"), (3, "SSN: 123-45-6789, 234-56-7891"),
        (4, "123-45-6789 and 234-56-7891 (SSN)"), (5, "SSN: " + listed), (6, listed + " are social security numbers"),
        (7, "ssn 123-45-6789 (Bob), 234-56-7891 (Al)"), (8, "ssn" + " x" * 30 + " 123-45-6789, 234-56-7891" + " x" * 30 + " ssn"),
    ]
    spans = check(spark, rows)
    assert spans[1] == "iban:0:22" and spans[2] == "iban:0:27" and spans[3] == "ssn:5:16,ssn:18:29" and spans[4] == "ssn:0:11,ssn:16:27"
    assert [spans[n].count("ssn") for n in (5, 6, 7, 8)] == [100, 100, 2, 0]


def test_context_raises_the_score(spark):
    rows = [(1, "call me: +1 555 010 9999"), (2, "xxxx: +1 555 010 9999")]
    got = {r.doc_id: r._phone[0].score for r in pii.find_spans(odd_documents(spark, rows)).select("doc_id", "_phone").collect()}
    assert got == {1: 0.8, 2: 0.6}


def test_words_on_both_sides_decide(spark):
    rows = [
        (1, "+1 555 010 9999 is my phone, 1.2.3.4 my server"), (2, "write to a@b.cc, c@d.ee"), (3, "XY41 1234 5678 9012 345"),
        (4, "bank account XY41 1234 5678 9012 345"), (5, "4222222222222 (visa)"),
    ]
    plain = "XY00" + "123456789012345"
    rest = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97
    number = f"XY{98 - rest:02d}123456789012345"
    rows = [(n, t.replace("XY41 1234 5678 9012 345", number)) for n, t in rows]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.span_report(odd_documents(spark, rows)).collect()}
    assert got[1] == ("ip:29:36,phone:0:15", "80,80") and got[2][1] == "100,100" and got[5][1] == "100"
    assert got[3] == ("", "") and got[4] == (f"iban:13:{13 + len(number)}", "70")  # a country that is not known needs the word


def test_added_spans_that_overlap_base_ones(spark):
    rng = random.Random(6)
    bits = ["ssn ", "123-45-6789", "+1 ", "123-45-6789", "GB82WEST12345698765432", "@b.cc", "x.", "4222222222222", " ", "iban ", "1.2.3.4", ", "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 300)))) for i in range(200)]
    alone = odd_documents(spark, rows)
    for kind in (*pii.BASE, *pii.ADDED):
        alone = pii._with_spans(alone, "text", kind, f"_{kind.name}")
    whole = {r.doc_id: r for r in pii.find_spans(odd_documents(spark, rows)).collect()}
    dropped = 0
    for r in alone.collect():
        base = [s for kind in pii.BASE for s in r[f"_{kind.name}"]]
        for kind in pii.ADDED:
            kept = [s for s in r[f"_{kind.name}"] if not any(b.start < s.end and s.start < b.end for b in base)]
            assert whole[r.doc_id][f"_{kind.name}"] == kept
            dropped += len(r[f"_{kind.name}"]) - len(kept)
    assert dropped > 100


def test_many_spans_of_base_and_added_kinds(spark):
    started = time.time()
    text = "a@b.cc, IBAN DE89370400440532013000; " * 50_000
    got = pii.span_report(odd_documents(spark, [(1, text)])).first()
    assert got.n_email == 50_000 and got.spans.count("iban") == 50_000
    assert time.time() - started < 60


def test_names_of_the_results_are_replaced(spark):
    rows = odd_documents(spark).withColumnRenamed("source", "_email").withColumnRenamed("shard", "_ssn")
    got = pii.find_spans(rows)
    assert len(got.columns) == len(set(got.columns)) and got.count() == rows.count()


def test_redact(spark):
    rows = [(1, "a@b.cc and 1.2.3.4 or 999.1.1.1, card 4222222222222, +1 (555) 010-9999, GB82WEST12345698765432é"), (2, None), (3, ""), (4, "nothing")]
    df = odd_documents(spark, rows)
    got = pii.redact(df)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts == {1: "[EMAIL] and [IP] or 999.1.1.1, card [CARD], [PHONE], [IBAN]é", 2: None, 3: "", 4: "nothing"}


def test_redact_masks_what_find_spans_confirms(spark):
    rows = [
        (1, "my ssn 123-45-6789, mail a@b.cc"), (2, "no. 123-45-6789"), (3, "x.GB82WEST12345698765432@b.cc!"),
        (4, "é😀 ssn +1 123-45-6789 é"), (5, "a@b.cc " * 200 + "end"),
    ]
    texts = {r.doc_id: r.text for r in pii.redact(odd_documents(spark, rows)).collect()}
    assert texts == {
        1: "my ssn [SSN], mail [EMAIL]", 2: "no. 123-45-6789", 3: "[EMAIL]!", 4: "é😀 ssn [PHONE] é", 5: "[EMAIL] " * 200 + "end",
    }


def test_no_python_in_the_plan(spark):
    plan = pii.span_report(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))
