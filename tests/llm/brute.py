"""Plain-Python versions of what the queries promise; slow, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def lm_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    seen = Counter()
    for d, text in docs:
        if not held[d]:
            seen.update(word_list(text) + [None])
    total, distinct = sum(seen.values()), len(seen)
    out = {}
    for d, text in docs:
        tokens = word_list(text) + [None]
        base = sum(math.log10((seen[t] + 1) / (total + distinct + 1)) for t in tokens)
        out[d] = (held[d], len(tokens), sum(seen[t] > 0 for t in tokens), total, base)
    return out


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256, spans) of the fixed patterns."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    named = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], hashlib.sha256(",".join(named).encode()).hexdigest(), named


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    found = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i : i + 8]), []).append(i)
    again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    n = len(found)
    return (n, sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(again), n < 20 or 100 * len(again) > 30 * n)


def shingles(text):
    w = word_list(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(docs, percent):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in ids}


def url(address):
    """(host, path, rule) by the rules of the query."""
    rules = ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"]
    host = path = ""
    if address is not None and "://" in address:
        rest = address.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
    fit = [r for r in rules
           if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=len) if fit else None
