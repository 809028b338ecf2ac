"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, n=3):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in spans)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def base_lm(docs):
    """docs: (doc_id, text) -> {doc_id: (held_out, n_tokens, n_known, N, base_score)}"""
    from collections import Counter

    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, float(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))) for i, ws in tokens.items()}


def winnow(text, k, window, word_hash):
    """Marks (hash, position) by sliding each window by hand."""
    prime, base = (1 << 31) - 1, 1_000_003
    h = [word_hash(w) % prime for w in WORD.findall((text or "").lower())]
    if not h:
        return []
    grams = []
    for i in range(max(1, len(h) - k + 1)):
        acc = 0
        for w in h[i : i + k]:
            acc = (acc * base + w) % prime
        grams.append(acc)
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        j = max(j for j, g in enumerate(part) if g == min(part))
        if (part[j], i + j) not in out:
            out.append((part[j], i + j))
    return out


def signed(h):
    return h - (1 << 64) * (h >> 63)


def lm_scores(docs):
    """The maximum-entropy model by loops over tokens: (doc_id, text) -> {doc_id: score}. Hashing alone is shared."""
    from collections import Counter

    from tessera.llm import lm

    tokens = {i: [w.encode() for w in [*WORD.findall(lower(t)), "\n"]] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    part = {i: signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) % lm.ROUNDS for i, t in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    top = sorted(c, key=lambda w: (-c[w], signed(xxhash.xxh64_intdigest(w, 42))))[: lm.OWN]
    look = lambda w: 0 if w == b"\n" else zlib.crc32(w[-2:]) % (lm.LEAVES - lm.OWN)
    own = {w: k for k, w in enumerate(top)}
    leaf = lambda w: own[w] if w in own else lm.OWN + look(w)
    n, v = np.zeros(lm.LEAVES), np.zeros(lm.LEAVES)
    for w, k in c.items():
        n[leaf(w)] += k
        v[leaf(w)] += 1
    seqs = {i: [leaf(w) for w in ws] for i, ws in tokens.items()}
    pairs = np.zeros((lm.LEAVES, lm.BEFORE))
    for i, xs in seqs.items():
        for a, b in zip([lm.LEAVES, *xs], xs, strict=False):
            pairs[b, a % lm.BEFORE] += not held[i]
    klass = lm.classes_of(pairs)
    members = [[x for x in range(lm.LEAVES) if klass[x] == k] for k in range(lm.CLASSES)]
    slot = {x: m.index(x) for m in members for x in m}
    mass = [sum(n[x] for x in m) for m in members]
    bias1 = np.log([(x + 1) / (sum(n) + lm.CLASSES) for x in mass])
    bias2 = np.log([[(n[x] + 0.5) / (mass[k] + 0.5 * lm.SLOTS) for x in m] for k, m in enumerate(members)])
    one, two = (r.bit_length() - 1 for r in lm.ROWS)
    row = lambda bits, *xs: int(lm._hash(bits, *[np.array([x]) for x in xs])[0])

    def rows(xs, t):
        w1, w2, w3 = (xs[t - k] if t >= k else lm.LEAVES for k in (1, 2, 3))
        c1, c2, c3 = (klass[w] if w < lm.LEAVES else lm.CLASSES for w in (w1, w2, w3))
        y = klass[xs[t]]
        return [row(one, 1, w1), row(one, 2, w1, w2), row(one, 3, w2), row(one, 4, c1, c2, c3)], [row(two, 5, w1, y), row(two, 7, w2, y)]

    def soft(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    w = [{}, {}]
    get = lambda k, r: w[k].get(r, np.zeros(lm.CLASSES))
    for r in range(lm.ROUNDS):
        expected, seen = [{}, {}], [{}, {}]
        for i, xs in seqs.items():
            for t in range(len(xs) if not held[i] and part[i] == r else 0):
                both, y, s = rows(xs, t), klass[xs[t]], slot[xs[t]]
                for k, (b, choice) in enumerate(((bias1, y), (bias2[y], s))):
                    p = soft(b + sum(get(k, q) for q in both[k]))
                    for q in both[k]:
                        expected[k].setdefault(q, np.zeros(lm.CLASSES))[:] += p
                        seen[k].setdefault(q, np.zeros(lm.CLASSES))[choice] += 1
        for k in (0, 1):
            for q, e in expected[k].items():
                w[k][q] = get(k, q) + lm.RATE * np.clip((seen[k][q] - e) / (e + lm.HOLD), -1, 2)
    out = {}
    for i, xs in seqs.items():
        out[i] = 0.0
        for t, x in enumerate(xs):
            a, b = rows(xs, t)
            y, s = klass[x], slot[x]
            word = tokens[i][t]
            out[i] += np.log10(soft(bias1 + sum(get(0, q) for q in a))[y]) + np.log10(soft(bias2[y] + sum(get(1, q) for q in b))[s])
            out[i] += np.log10((c[word] + 0.1) / (n[x] + 0.1 * (v[x] + (x >= lm.OWN))))
    return out
