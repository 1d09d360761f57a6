"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_duplicates(docs):
    sets = {}
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    by, parent = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in by[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def targets(sizes):
    """{source: target} by repeated capping, from {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


FOLD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items):
    patterns = {}
    for i, text in items:
        w = FOLD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(p) for p in patterns}
    out = []
    for d, text in docs:
        w = FOLD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := patterns.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    data = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    for d, b in data:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
    return out


def tokens(docs, path):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(str(path)), 0, {}
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out[d] = at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        at += len(ids)
    return out
