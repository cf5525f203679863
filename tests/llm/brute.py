"""Plain-Python definitions that the tests hold the operators against."""

import hashlib
import html as html_lib
import math
import re
from collections import Counter

import xxhash

KINDS = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(text):
    text = text or ""
    found = [(m.start(), i, kind, m.end()) for i, (kind, pattern, ok) in enumerate(KINDS) for m in pattern.finditer(text) if ok(m)]
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    counts = [sum(k == kind for _, _, k, _ in found) for kind, _, _ in KINDS]
    return (*counts, hashlib.sha256(said.encode()).hexdigest())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    places = {}
    for i, x in enumerate(windows):
        places.setdefault(x, []).append(i)
    inside = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return (len(w), sum(map(len, w)), symbols, dup, len(inside), failed)


def shingles(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = words(w)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows, percent=85):
    """rows: (doc_id, text) -> doc_id: smallest reachable doc_id."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = root(a), root(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {d: root(d) for d, _ in sets}


def mixed(x):
    """The 64-bit finalizer, on one integer."""
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % 2**64
    return x ^ (x >> 32)


def ngram_buckets(text, buckets):
    """Number of each bucket's single tokens and pairs."""
    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", (text or "").encode())
    h = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
    return Counter(mixed(x) % buckets for x in [*h, *pairs])


def importance(rows, good, bad, folds, buckets, prior):
    """rows: (doc_id, text); good, bad: labelled doc_ids; folds: doc_id -> fold. Log weights of rows, and the best cut's two sides."""
    grams = [ngram_buckets(t, buckets) for _, t in rows]
    raw = sum(grams, Counter())
    total = sum(raw.values())
    p = lambda b: (raw[b] + 1) / (total + buckets)

    def log_weight(i, without=None):
        target = sum((grams[j] for j, (d, _) in enumerate(rows) if d in good and folds[d] != without), Counter())
        size = sum(target.values())
        return sum(n * math.log((target[b] + prior * p(b)) / (size + prior) / p(b)) for b, n in grams[i].items())

    held = [(log_weight(i, folds[d]), d in good) for i, (d, _) in enumerate(rows) if d in good or d in bad]
    n_good, n_bad = sum(g for _, g in held), sum(not g for _, g in held)
    share = lambda cut: sum(g and w >= cut for w, g in held) / n_good + sum(not g and w < cut for w, g in held) / n_bad
    best = max(share(w) for w, _ in held)
    return [log_weight(i) for i in range(len(rows))], share, best


def gumbel(doc, text, seed):
    u = ((xxhash.xxh3_64_intdigest(f"{doc}\0{text or ''}", seed=seed) >> 11) + 0.5) / 2**53
    return -math.log(-math.log(u))


def paragraphs(text):
    """Lines as tuples of words, cut after each word whose hash ends in three zero bits."""
    out = []
    for line in text.encode().split(b"\n"):
        part = []
        for word in line.split():
            part.append(word)
            if xxhash.xxh3_64_intdigest(word) % 8 == 0:
                out.append(tuple(part))
                part = []
        if part:
            out.append(tuple(part))
    return out


HIDDEN = re.compile(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def text_grams(text, buckets):
    data = (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode()
    return [mixed(int.from_bytes(data[i : i + 4], "little")) % buckets for i in range(len(data) - 3)]


def languages(pages, docs, buckets, evidence, strength):
    """pages: (page_id, url, html); docs: (lang, text). [(page_id, language, its probability)] of each page."""
    langs = sorted({lang for lang, _ in docs})
    counts = [Counter(g for lang2, t in docs if lang2 == lang for g in text_grams(t, buckets)) for lang in langs]
    size = [sum(c.values()) for c in counts]

    def soft(ll):
        e = [math.exp(x - max(ll)) for x in ll]
        return [x / sum(e) for x in e]

    rows = []
    for page, url, html in pages:
        found = text_grams(html_lib.unescape(HIDDEN.sub(" ", html or "")), buckets)
        scale = min(1, evidence / max(1, len(found)))
        ll = [scale * sum(math.log((c[g] + 0.5) / (n + 0.5 * buckets)) for g in found) for c, n in zip(counts, size, strict=True)]
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        parts = host.split(".")
        said = re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", html or "")
        at = {"host": host, "domain": ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else "", "suffix": parts[-1], "declared": said[1].lower() if said else ""}
        rows.append((page, ll, soft(ll), at))
    out = []
    for i, (page, ll, _, at) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i]
        total = lambda by, value: [sum(r[2][k] for r in others if by is None or r[3][by] == value) for k in range(len(langs))]  # noqa: B023, E731
        every = total(None, None)
        prior = [(x + 1) / (sum(every) + len(langs)) for x in every]
        for by in ("suffix", "domain", "host"):
            if at[by]:
                n = total(by, at[by])
                prior = [(x + strength * q) / (sum(n) + strength) for x, q in zip(n, prior, strict=True)]
        fused = [x + math.log(q) for x, q in zip(ll, prior, strict=True)]
        if at["declared"]:
            n = total("declared", at["declared"])
            fused = [x + math.log((a + 0.5) / (b + 1)) for x, a, b in zip(fused, n, every, strict=True)]
        p = soft(fused)
        out.append((page, langs[p.index(max(p))], round(max(p), 6)))
    return out
