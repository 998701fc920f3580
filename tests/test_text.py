"""Addresses, redaction, URLs and answers against the Python standard library."""

import json
import re
from email.utils import parseaddr

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions import address as ad
from tamarisk.functions import redact as rd
from tamarisk.functions import text as tx
from tamarisk.functions import urls as ur
from tamarisk.operators.answers import parse_answers, score_of

NAMES = [
    "PayPal Security <a@gmail.com>", '"Quoted, Name" <a@b.com>', "a@b.com", "<a@b.com>", "a@b.com (Ann Lee)",
    "Doe, John <j@x.com>", "ceo@company.com <x@gmail.com>", '"ceo@company.com" <x@gmail.com>', "", "  ",
    'O\'Neil "Bo" Smith <a@b.com>', "Name   With  Spaces <a@b.com>", "Ann (Sales) <a@b.com>", "Jürgen <j@x.de>",
    '"A \\"B\\" C" <a@b.com>', "A.B. Smith <a@b.com>", "תמיכה <a@b.com>", "Team: x@y.com;", "Name <a@b.com> tail",
]


def values(spark, items, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    got = dict(df.select("i", rule(F.col("v"))).collect())
    return [got[i] for i in range(len(items))]


def test_display_names(spark):
    got = values(spark, NAMES, ad.display_name)
    want = [parseaddr(n)[0].strip().lower() for n in NAMES]
    assert got == want
    assert values(spark, [None], ad.display_name) == [""]


def test_domains_and_addresses(spark):
    heads = ["A <a@B.com>", "a@b.com ", "A <a@b@C.com>", "none", "", None, '"x" <"q"@d.com">']
    assert values(spark, heads, ad.mailbox_domain) == ["b.com", "b.com", "b@c.com", None, None, None, "d.com"]
    assert values(spark, heads[:2] + [None], ad.mailbox_address) == ["a@B.com", "a@b.com", None]


def test_routable(spark):
    ips = ["10.1.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "0.1.2.3", "169.254.1.1",
           "255.1.1.1", "8.8.8.8", "100.1.1.1", "", None]
    want = [False, False, True, False, False, False, False, False, True, True, False, False]
    assert values(spark, ips, ad.is_routable) == want


def test_sender_ip_order(spark):
    df = spark.createDataFrame(
        [("ip 10.0.0.1", ["from 9.9.9.9"], "8.8.8.8"), (None, None, "raw 10.0.0.2 8.8.8.8"), ("ip 1.2.3.4", None, None),
         ("ip 10.0.0.1", None, "8.8.8.8"), ("v 999.1.1.1", None, None)],
        "a string, r array<string>, raw string",
    )
    got = [r[0] for r in df.select(ad.sender_ip(F.col("a"), F.col("r"), F.col("raw"))).collect()]
    assert got == ["9.9.9.9", "8.8.8.8", "1.2.3.4", None, None]


def python_redact(text):
    strip = lambda p: p.replace("(?U)", "")
    if not text:
        return ""
    for pattern, mark in (
        (fv.EMAIL_PATTERN, "[EMAIL]"), (fv.IBAN_PATTERN, "[IBAN]"), (fv.ID_NUMBER_PATTERN, "[ID_NUMBER]"),
        (fv.CARD_PATTERN, "[CARD]"), (fv.URL_TOKEN_PATTERN, r"\1[TOKEN]"),
    ):
        text = re.sub(strip(pattern), mark, text)
    phone = lambda m: "[PHONE]" if 7 <= len(re.sub(r"\D", "", m.group(0))) <= 15 else m.group(0)
    return re.sub(strip(fv.PHONE_PATTERN), phone, text)


SAMPLES = [
    "mail ann.lee+x@mail.example.com now", "GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268 19",
    "id 123-45-6789", "card 1234-5678-9012-3456", "https://x.y/?t=" + "aB3_" * 9 + "&z=1", "+1 (555) 123-4567",
    "12345 6", "١٢٣٤٥٦٧٨٩", "éa@b.co", "no digits at all", "", None, "a 123456 b 1234567 c 1234567890123456",
    "line\n555-123-4567\nnext", "x=1 2 3", "tel 0123456789012345678901234567890",
]


def test_redaction(spark):
    assert values(spark, SAMPLES, rd.redact) == [python_redact(s) for s in SAMPLES]


def test_redaction_random(spark):
    alphabet = "ab1290 -.+()@=?&GB\n٣é"
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet=alphabet, max_size=40))
    def draw(t):
        seen.append(t)

    draw()
    assert values(spark, seen, rd.redact) == [python_redact(s) for s in seen]


def test_local_part(spark):
    heads = ["a@b.com", "A <a@b>", "none", None, "a@b@c"]
    assert values(spark, heads, rd.redact_local_part) == ["[REDACTED]@b.com", "[REDACTED]@b>", "none", None, "[REDACTED]@c"]


def test_cut_and_escape(spark):
    assert values(spark, ["abcdef", "abc", None], lambda c: tx.cut(c, 3, "…")) == ["abc…", "abc", ""]
    assert values(spark, ["<a & b>", None], tx.escape_html) == ["&lt;a &amp; b&gt;", ""]


def test_hosts(spark):
    urls = ["https://WWW.A.com/x", "http://u:p@b.com:80/", "https://", "ftp://a", "https://a b.com/", None, "https://c.com:x/", "https://d.com?q=@e"]
    assert values(spark, urls, ur.url_host) == ["a.com", "b.com", None, None, None, None, None, "d.com"]


def test_anchor_text(spark):
    html = '<a href="https://a.com">Buy &amp;lt; <b>x</b>\n &nbsp;y</a><a href="mailto:q@x">m</a><A HREF=\'HTTP://b.com\'> </A>'
    got = values(spark, [html], lambda c: F.to_json(ur.web_anchors(c)))[0]
    assert json.loads(got) == [{"url": "https://a.com", "visible_text": "Buy < x y"}, {"url": "HTTP://b.com"}]


def test_dedupe_modes(spark):
    html = '<a href="https://a.com">one</a><a href="https://a.com">two</a> https://b.com'
    client = values(spark, [html], lambda c: F.to_json(ur.message_urls(F.lit("see https://a.com"), c)))[0]
    assert [(u["url"], u.get("visible_text")) for u in json.loads(client)] == [("https://a.com", "one"), ("https://b.com", None)]
    server = values(spark, [html], lambda c: F.to_json(ur.message_urls(F.lit("see https://a.com)"), c, "server")))[0]
    assert [(u["url"], u.get("visible_text")) for u in json.loads(server)] == [("https://a.com", None)]


def test_answers(spark):
    texts = [
        '{"claude_score": 87.9, "threat_category": "BEC", "main_findings": ["a", "", null, 0, false, true, 1.5, [], {}]}',
        '```json\n{"claude_score": true}\n```', '{"claude_score": -3.9}', '{"claude_score": "12", "potential_damage": 0}',
        "[1]", "", "no", '{"claude_score": 1e9, "what_to_do": []}', '{"claude_score": null, "main_findings": {"a": 1}}',
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "message_id string, raw_text string")
    got = {int(r[0]): r[1] for r in parse_answers(df).collect()}
    assert [got[i]["score"] for i in range(9)] == [87, 1, 0, 12, 0, 0, 0, 100, 0]
    assert [got[i]["available"] for i in range(9)] == [True, True, True, True, False, False, False, True, True]
    assert got[0]["main_findings"] == ["a", "True", "1.5"] and got[0]["threat_category"] == "BEC"
    assert got[3]["potential_damage"] == "" and got[8]["main_findings"] == []


def test_scores_beyond_int(spark):
    given = {"5000000000": 100, "-5000000000": 0, "1e30": 100, "99.9": 99, "12345678901234567890123": 100, "true": 1,
             "null": 0, '"50"': 50, '"x"': 0, "[1]": 0}
    df = spark.createDataFrame([(k, '{"claude_score": %s}' % k) for k in given], "k string, j string")
    got = df.select("k", score_of(F.try_parse_json("j")).alias("score")).collect()
    assert {r.k: r.score for r in got} == given


def test_quick_starts_match_the_same(spark):
    odd = [
        "(050) 123 4567", "x+1 212-555-0101y", "((020)123456789", "1 2 3 4 5 6 7 8 9 0 1 2 3", "a1234567890123 b", "٠١٢٣٤٥٦٧٨٩٠١٢",
        "DE89 3704 0044 0532 0130 00", "éDE89370400440532013000", "١٢٣-٤٥-٦٧٨٩", "123-45-6789-", "0123-45-6789", "+(12", "", "12\n345\t6789",
    ]
    assert rd._STARTS
    for pattern, start in rd._STARTS.items():
        plain = values(spark, odd, lambda v: F.regexp_replace(v, pattern, "#"))
        assert values(spark, odd, lambda v: F.regexp_replace(v, start + pattern, "#")) == plain
    kept = ["no mark at all\n", "", None]
    assert values(spark, kept, rd.redact) == ["no mark at all\n", "", ""]
