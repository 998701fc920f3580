"""Repeated strings against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tamarisk.llm import suffix_dedup, suffix_sorting
from tamarisk.llm.suffix_dedup import RepeatParams, remove_repeats


def brute(rows, length=50):
    least = defaultdict(lambda: 1 << 62)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                least[b[k : k + length]] = min(least[b[k : k + length]], i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abé ü\0") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(20) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 30) :], text(rng.randint(0, 9))]
        rows.append((i * 3 % 61, "".join(parts)))
    long_one = text(400)
    rows += [(100 + i, long_one[:700] + str(i % 5) + long_one[700:]) for i in range(20)]
    rows += [(7, long_one), (7, long_one), (7, "q" * 49), (200, "a" * 5000), (201, "a" * 300), (202, "q" * 49),
             (203, ""), (204, None), (None, long_one), (None, None), (205, "z" * 50), (206, "yz" * 40 + "z" * 50)]
    return rows


@pytest.mark.parametrize("group", [8192, 2])
def test_same_as_brute_force(make, group):
    rows = corpus()
    got = remove_repeats(make(rows), with_kept=True, params=RepeatParams(group_fragments=group, array_bytes=2000))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=repr) == brute(rows)


@pytest.fixture
def steps(monkeypatch):
    """Rows of each written step."""
    rows, plain = {}, suffix_dedup.written

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    return rows


def test_same_as_brute_force_over_many_blocks(make, steps):
    rows = corpus()
    got = remove_repeats(make(rows), with_kept=True, params=RepeatParams(block_bytes=900, bucket_bytes=3000))
    assert sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=repr) == brute(rows)
    assert steps["repeat-names"] > 20


def test_fragments_of_one_text_alone_do_not_become_rows(make, steps):
    rng = random.Random(3)
    alone = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(alone)] + [(90, alone[7][:300] + "x" * 200)]
    assert sorted((tuple(r) for r in remove_repeats(make(rows)).collect()), key=repr) == [r[:5] for r in brute(rows)]
    # of 120,500 bytes two copies of 300 move, not some 8,000 fragments
    assert 2 <= steps["repeat-occurrences"] < 100
    # the table that holds all marks is written before texts are moved again
    assert steps["repeat-marks"] == 1


def test_empty_table(make):
    assert remove_repeats(make([])).collect() == []


@pytest.mark.parametrize("few", [1024, 0])
def test_suffix_array(monkeypatch, few):
    monkeypatch.setattr(suffix_sorting, "_FEW", few)
    rng = np.random.default_rng(1)
    for _ in range(300):
        k = int(rng.integers(1, 5))
        s = rng.integers(0, k, rng.integers(0, 60))
        row = s.tolist()
        sa = suffix_sorting.suffix_array(s, k)
        assert sa.tolist() == sorted(range(len(row)), key=lambda i: row[i:])
        if len(row) > 1:
            common = suffix_sorting.permuted_prefixes(s, sa)
            for a, b in zip(sa[:-1], sa[1:]):
                n = 0
                while max(a, b) + n < len(row) and row[a + n] == row[b + n]:
                    n += 1
                assert common[b] == n
