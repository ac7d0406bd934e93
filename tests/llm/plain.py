"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def targets(sizes):
    """source -> target, by sharing again and again."""
    by = Counter()
    for source, n in sizes:
        by[source] += n
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, sum(by.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * by[s]]
        if not over:
            return by, {**capped, **share}
        capped |= {s: 3 * by[s] for s in over}


def exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(f"[{SPACE}]", "", text or ""), []).append((-len(text or ""), doc_id))
    return {norm: (min(g)[1], len(g)) for norm, g in groups.items()}


def base_quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    in_window = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(in_window) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(in_window), failed


def shingles(text, width):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near(rows, width=4, percent=80):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(shingles(text, width))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def join(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(t):
    t = t or ""
    assign = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def personal_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    out += [(m.start(), 1, m.end(), "ip") for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
    return out + [(m.start(), 3, m.end(), "phone") for m in phones if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def unigrams(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*words(lower(t)), None]
    counts = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    score = lambda t: sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))
    return [(d, held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, score(t)) for d, t in rows]


def upper_off(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def page_parts(url):
    _, found, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0]
    return (upper_off(host), re.split("[?#]", rest[len(host) :])[0]) if found else ("", "")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def url_verdicts(pages, rounds=20):
    """page_id, host, path, rule, verdict, trust, distrust by plain iteration over the link graph."""
    parts = [(p, *page_parts(u), h) for p, u, h in pages]
    seen, edges = {}, set()
    for _, host, path, html in parts:
        if host:
            seen.setdefault(host, []).append(rule_of(host, path)[1])
            for link in re.findall(r"""(?i:\bhref)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:(?i:https?):)?//([^/?#"'<>\x20\x09-\x0D]+)""", html or ""):
                if upper_off(link) != host:
                    edges.add((host, upper_off(link)))

    def ranks(kind, edges):
        seeds = [h for h, v in seen.items() if 2 * v.count(kind) > len(v)]
        seed = {h: 15 * 10**13 // len(seeds) if h in seeds else 0 for h in seen}
        degree, mass = Counter(a for a, _ in edges), dict(seed)
        for _ in range(rounds):
            new = dict(seed)
            for a, b in edges:
                if a in mass and b in new:
                    new[b] += mass[a] * 85 // (100 * degree[a])
            mass = new
        return mass

    trust, distrust = ranks("allow", edges), ranks("block", {(b, a) for a, b in edges})
    out = []
    for p, host, path, _ in parts:
        rule, verdict = rule_of(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        out.append((p, host, path, rule, verdict or ("block" if d > t else "allow"), t, d))
    return out


def vector_codes(rows, parts=8, entries=16, rounds=6):
    from math import floor, inf, isfinite

    kept = [(v, [floor(4096 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and isfinite(x) for x in e)]
    kept.sort(key=lambda r: (inf if r[0] is None else r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[x[k * w : (k + 1) * w] for k in range(parts)] for _, x, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda c: [min((far(c[k], e), i) for i, e in enumerate(books[k])) for k in range(parts)]
    for _ in range(rounds):
        codes = [assign(c) for c in cut]
        for k in range(parts):
            for e in range(len(books[k])):
                own = [c[k] for c, code in zip(cut, codes, strict=True) if code[k][1] == e]
                if own:
                    books[k][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(v, "".join(f"{i:02x}" for _, i in a), min(sum(d for d, _ in a), 2**63 - 1), label) for (v, _, label), a in zip(kept, map(assign, cut), strict=True)]
    by = Counter()
    for _, _, e, label in out:
        by[label] += e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(v, c, e, min(by[label], 2**63 - 1), digest) for v, c, e, label in out]


def collocations(rows, longest=3, least=10, contained=50, top=2000):
    """rows of (lang, text): lang, rank, phrase, a, l, r, n, score."""
    out, by = [], {}
    for lang, text in rows:
        counts = by.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", upper_off(text or "")):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            for n in range(1, longest + 1):
                counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < contained * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out
