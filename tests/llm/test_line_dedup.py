"""Lines that documents share, against plain Python."""

import hashlib

from tamarisk.llm.line_dedup import LineParams, drop_shared_lines
from tamarisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(docs, chars=20, least=3):
    low = float("-inf")
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark, sf_docs):
    rows = QUERIES["op12_line_dedup"](spark, SF).collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(sf_docs)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert any(d for _, _, d, _ in want)


def test_odd(make, odd_docs):
    shared = "This line stands in very many documents."
    docs = odd_docs + [(100 + i, f"own {i}\n {shared}\t\r\n{shared.upper()}\nend") for i in range(60)]
    docs += [(5000, f"{shared}\n{shared}"), (5001, "é" * 19 + "\nx"), (5002, "é" * 19), (5003, "é" * 19),
             (5004, "É" * 20 + "\n\n"), (5005, "é" * 20), (5006, "É" * 20), (5007, "É" * 20),
             (5008, " " + "a" * 20), (5009, "a" * 20), (5010, " " + "A" * 20), (5011, "a" * 20 + "\x0b"),
             (5012, "\n" * 50), (5013, "one\r\ntwo"), (5014, ("a" * 20 + "\n") * 3000)]
    assert got(drop_shared_lines(make(docs))) == brute(docs)


def test_repeated_and_null_ids(make):
    line, other = "a line of more than twenty letters", "another line of more than twenty letters"
    docs = [(1, line), (1, line), (1, line + "\n" + other), (2, line), (None, line), (None, line), (None, other + "\n" + line),
            (7, other), (7, other + "\n" + other), (-3, other)]
    assert got(drop_shared_lines(make(docs))) == brute(docs)
    same = [(4, line)] * 6
    assert got(drop_shared_lines(make(same))) == brute(same) == [(4, 1, 0, line)] * 6
    nulls = [(None, line)] * 4 + [(None, None), (None, "")]
    assert got(drop_shared_lines(make(nulls))) == brute(nulls)


def test_parameters_and_empty(make):
    assert got(drop_shared_lines(make([]))) == []
    docs = [(i, "abc\nd") for i in range(5)]
    params = LineParams(least_chars=3, least_docs=5)
    assert got(drop_shared_lines(make(docs), params)) == brute(docs, 3, 5)


def test_other_names(make):
    df = make([(3, "x")], "id").withColumnRenamed("text", "row")
    out = drop_shared_lines(df, id_col="id", text_col="row")
    assert [tuple(r) for r in out.collect()] == [(3, 1, 0, "x")] and out.columns[0] == "id"
