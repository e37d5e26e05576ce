"""Brute-force versions, in plain Python, of what the operators compute."""

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_statistics(text):
    ws, text = words(text), text or ""
    seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def spark_xx(n, seed):
    """Spark's xxhash64 of a long."""
    return xxhash.xxh64_intdigest((n & (1 << 64) - 1).to_bytes(8, "little"), seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def gram_buckets(text, buckets):
    ones = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
    twos = [spark_xx(b, spark_xx(a, 42)) for a, b in zip(ones, ones[1:])]
    return [h % buckets for h in ones] + [h % buckets for h in twos]


def quality(docs, labels, buckets):
    """{doc_id: (score, kept)}; docs: {doc_id: text}, labels: {doc_id: (quality, toxic)}."""
    grams = {i: gram_buckets(t, buckets) for i, t in docs.items()}
    half = {i: signed(spark_xx(i, 42)) % 2 == 0 for i in labels}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        if labels.get(i) == (1, 0) and half[i]:
            trusted.update(g)
    n_raw, n_trusted = sum(raw.values()), sum(trusted.values())
    weight = lambda b: math.log((trusted[b] + 1) / (n_trusted + buckets)) - math.log((raw[b] + 1) / (n_raw + buckets))
    score = {i: sum(map(weight, g)) / len(g) if g else 0.0 for i, g in grams.items()}
    good = sorted(round(score[i], 3) for i in docs if i in labels and labels[i] == (1, 0) and not half[i])
    junk = sorted(round(score[i], 3) for i in docs if i in labels and labels[i][0] == 0 and not half[i])
    pick = lambda x, q: x[math.ceil(q * len(x)) - 1] if x else None
    g, j = pick(good, 0.01), pick(junk, 0.9)
    least = -1e300 if g is None else g if j is None else min(g, (g + j) / 2)
    return {i: (score[i], not base_statistics(t)[-1] and score[i] >= least) for i, t in docs.items()}


def fingerprint(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = words(ws)
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, threshold=2):
    """{id: smallest id reachable}; fps: [(id, fingerprint)]."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(fps)}


def mix(rows, weights=(1, 2, 3), most=3):
    """[(doc_id, size, source_size, target, taken)]; rows: [(doc_id, source, text)]."""
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in order if s not in capped)
        target = {s: float(most * sizes[s]) if s in capped else left / share * w[s] for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}/{hashlib.md5((r[2] or '').encode()).hexdigest()}".encode()).hexdigest()
    out = []
    for s in order:
        at = 0
        for r in sorted((r for r in rows if r[1] == s), key=key):
            n = len(words(r[2]))
            taken = sum(max(0, min(at + n + e * sizes[s], math.floor(target[s])) - at - e * sizes[s]) for e in range(most))
            out.append((r[0], n, sizes[s], target[s], taken))
            at += n
    return out


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))
