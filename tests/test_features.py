"""Truth tables of the single flags."""

import pytest
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk import schemas
from tamarisk.operators import features as ft

AUTH = [
    ("spf=fail", True), ("SPF = FAIL", True), ("spf=softfail", False), ("spf=failed", True),
    ("spf\t=\n fail", True), ("spf=pass", False), ("", False), (None, False),
    ("spf = fail", True),
]
SENDER = [
    ("login-verify.net", True), ("LOGIN.net", False), ("evilsecuritygoogle.com", False),
    ("security.microsoft.com", False), ("a.xn--p1ai", True), ("A.XN--P1AI", True),
    ("deals.XYZ", True), ("x.support", True), ("fine.example", False), ("", False), (None, False),
]
BRAND = [
    ("paypal security", "gmail.com", True), ("paypal", "paypal.com", False),
    ("paypal", "mail.PayPal.com", False), ("paypal", "notpaypal.com", True),
    ("our groups", "x.com", True), ("google", "youtube.com", False), ("", "x.com", False),
    ("paypal", None, False), ("microsoft apple", "icloud.com", True),
]
FOREIGN = [
    ("ceo@company.com", "gmail.com", True), ("ceo@gmail.com", "gmail.com", False),
    ("ceo@gmail.com.", "GMAIL.com", False), ("ceo", "gmail.com", False),
    ("a@x.com b@gmail.com", "gmail.com", True), ("é@größe.de", "größe.de", False),
]
LINKS = [
    ("paypal.com", "evil.ru", True), ("paypal.com", "www.paypal.com", False),
    ("www.paypal.com", "paypal.com", False), ("Click here", "evil.ru", False),
    ("see PayPal.com.", "paypal.com", False), ("https://a.example/x and b.example", "a.example", True),
    ("a.b", "evil.ru", False), ("paypal.com", ".paypal.com", False), (None, "x.y", False),
    ("paypal.com", None, False), ("paypal.com", "", False),
]
DOUBLE = [
    ("Invoice.pdf.exe", True), ("a.PDF.ZIP", True), ("a.exe.pdf", False), ("b.tar.gz", False),
    ("x.pdf", False), (".pdf.exe", True), ("a.pdf.", False), ("", False), (None, False),
    ("a.b.jpg.scr", True),
]
MIME = [
    ("a.pdf", "application/pdf", False), ("a.exe", "application/pdf", True),
    ("noext", "application/pdf", True), ("a.docx", "application/x-unknown", False),
    ("y.zip", " APPLICATION/ZIP ", False), ("a.jpeg", "image/jpeg", False), ("a.", "image/png", True),
    ("a.pdf", None, False), ("", "application/pdf", False), ("a.pdf", "", False),
]


def check(spark, cases, ddl, rule):
    df = spark.createDataFrame([(*c[:-1], i) for i, c in enumerate(cases)], ddl + ", i int")
    got = {r["i"]: r["v"] for r in df.select("i", rule.alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_auth(spark):
    check(spark, AUTH, "h string", ft.auth_failed(F.col("h"), "spf"))


def test_brand(spark):
    check(spark, BRAND, "n string, d string", ft.brand_spoofed("n", "d", fv.BRAND_DOMAINS))


def test_foreign_address(spark):
    check(spark, FOREIGN, "n string, d string", ft.foreign_address_in_name(F.col("n"), F.col("d")))


def test_links(spark):
    check(spark, LINKS, "t string, d string", ft.link_text_mismatch(F.col("t"), F.col("d")))


def test_double_extension(spark):
    check(spark, DOUBLE, "f string", F.coalesce(ft.double_extension(F.col("f")), F.lit(False)))


def test_mime(spark):
    check(spark, MIME, "f string, m string", ft.mime_mismatch(F.col("f"), F.col("m")))


def one_message(spark, **fields):
    given = {"message_id": "1", **fields}
    names = [f.strip().split(" ")[0] for f in schemas.MESSAGE.split(",") if " " in f.strip()]
    schema = spark.createDataFrame([], schemas.MESSAGE).schema
    assert set(given) <= set(schema.names), names
    return spark.createDataFrame([tuple(given.get(n) for n in schema.names)], schema)


def test_suspicious_domain(spark):
    for domain, want in SENDER:
        row = ft.with_body_flags(one_message(spark, from_domain=domain)).first()
        assert row["suspicious_sender_domain"] is want, domain


@pytest.mark.parametrize(
    "subject,body,html,flag,want",
    [
        ("Your verification", "code inside", None, "credential_request_language", True),
        ("verification", " code", None, "credential_request_language", False),
        ("x", "", "<b>verification</b> code", "credential_request_language", False),
        ("x", "", "verification<br>code", "credential_request_language", True),
        ("x", "", "<style>otp</style>", "credential_request_language", True),
        ("דחוף", None, None, "urgent_language", True),
        (None, None, None, "urgent_language", False),
        ("DEAR Customer", None, None, "generic_greeting", True),
        ("x", "payment", None, "financial_request_language", True),
    ],
)
def test_language(spark, subject, body, html, flag, want):
    m = one_message(spark, subject=subject, body_text=body, body_html=html)
    assert ft.with_body_flags(m).first()[flag] is want


def test_all_flags_are_boolean_and_never_null(spark):
    row = ft.with_body_flags(one_message(spark)).first()
    assert [row[f] for f in ft.BODY_FLAGS] == [False] * len(ft.BODY_FLAGS)


@pytest.mark.parametrize(
    "total,spam,trash,available,want",
    [
        (10, 3, 0, True, True), (0, 2, 0, True, False), (10, 2, 0, True, False), (10, 1, 2, True, True),
        (3, 1, 0, True, True), (4, 1, 0, True, False), (10, 0, 0, True, False), (10, 5, 0, False, False),
        (1, 2, 0, True, True),
    ],
)
def test_spam_history(spark, total, spam, trash, available, want):
    history = (total, total == 0, True, None, spam, trash, available)
    df = spark.createDataFrame([("1", history)], f"message_id string, sender_history {schemas.SENDER_HISTORY}")
    row = ft.with_history_flags(df).first()
    assert row["sender_has_spam_history"] is want
    assert row["has_user_replied_to_sender"] is available
    assert row["is_first_time_sender"] is (available and total == 0)


def test_large_dictionary_against_brute_force(spark):
    """Brands of one letter and more, names without any, own domains and their subdomains; no job while planning."""
    import random

    from tamarisk.operators.features import brand_spoofed_by_table

    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    brands = [(word(rnd.choice([1, 2, 3, 4, 6])), f"{word(3)}.com") for _ in range(60)] + [("", "x.com"), (None, "x.com"), ("zzzz", "z.com")]
    brands += [("own", "own.com"), ("own", "own.net")]
    sent = [(str(i), f"{word(rnd.randrange(1, 9))} <a@b.c>", rnd.choice([d for _, d in brands] + ["mail.own.com", "own.net.ru"])) for i in range(150)]
    sent += [("n1", "the own shop <x@y>", "mail.own.com"), ("n2", "the own shop <x@y>", "own.org"), ("n3", None, "own.org"), ("n4", "own <x@y>", None),
             ("n5", "zz <x@y>", "other.org")]
    messages = spark.createDataFrame(sent, "message_id string, from_email string, from_domain string")
    table = spark.createDataFrame(brands, "brand string, domain string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    df = brand_spoofed_by_table(messages, table)
    assert not tracker.getJobIdsForGroup("plan")
    own = {}
    for b, d in brands:
        own.setdefault(b, []).append(d)
    want = {}
    for i, sender, host in sent:
        name = sender.rsplit(" <", 1)[0] if sender else ""
        want[i] = bool(name and host) and any(
            b in name and not any(host == d or host.endswith("." + d) for d in ds) for b, ds in own.items() if b)
    assert {r.message_id: r.brand_spoofing for r in df.collect()} == want
    assert want["n2"] and not want["n1"] and 20 < sum(want.values()) < 150
    assert brand_spoofed_by_table(messages, table.limit(0)).filter("brand_spoofing").count() == 0
