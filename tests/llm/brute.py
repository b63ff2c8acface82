"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    counts = Counter(f[2] for f in found)
    spans = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(spans.encode()).hexdigest()


def statistics(text):
    text = text or ""
    w, at = WORD.findall(text), defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *out, out[0] < 10 or 100 * out[4] > 20 * out[0]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """rows: (doc_id, text) -> doc_id: (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_dedup(rows, least=50):
    """rows sorted by (id, ...): [(key, text)] -> key: lines that go."""
    seen, gone = set(), defaultdict(set)
    for key, text in rows:
        lines = [(k, x.strip(" \t\r\x0b\x0c"), len(WORD.findall(x))) for k, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= least:
                    run = tuple(x[1] for x in lines[a : b + 1])
                    if run in seen:
                        gone[key] |= {x[0] for x in lines[a : b + 1]}
                    seen.add(run)
    return gone


def unigrams(rows):
    """rows: [(doc_id, text)] -> per row (held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(c.values()), len(c)
    return [(h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for own, h in zip(tokens, held)]


def quality(rows, labels, buckets, threshold):
    """rows: [(doc_id, text)], labels: [(doc_id, quality, toxic)] -> per row (llr, kept); hashes are XXH64 with seed 42, longs as 8 bytes."""
    h64 = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)

    def grams(text):
        h = [h64(w.encode()) for w in WORD.findall(text or "")]
        pairs = [h64(b.to_bytes(8, "little"), h64(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:])]
        return [x % buckets for x in h + pairs]

    good = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, target = [0] * buckets, [0] * buckets
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    share = lambda c, g: (c[g] + 1) / (sum(c) + buckets)
    out = []
    for _, t in rows:
        own = grams(t)
        llr = sum(math.log(share(target, g) / share(raw, g)) for g in own) / len(own) if own and sum(target) else 0.0
        out.append((llr, not statistics(t)[-1] and llr >= threshold))
    return out
