"""Plain versions of the operators, to hold them against."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if fold else text)


def repeats(docs, width):
    """id -> (words, kept words)."""
    seen = Counter(tuple(w[i : i + width]) for _, t in docs for w in [words(t)] for i in range(len(w) - width + 1))
    out = {}
    for k, t in docs:
        w = words(t)
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[k] = (len(w), [x for j, x in enumerate(w) if j not in gone])
    return out


def shingles(text, width):
    w = words(text, True)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(docs, width, percent):
    """id -> (set size, smallest id reachable)."""
    sets = {k: shingles(t, width) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def interpolated(docs, role, level, weights=None):
    """id -> (tokens, known, base, score) and the weights by EM, all by dictionaries."""
    toks = {k: words(t, True) + [None] for k, t in docs}

    def counts(ids):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for k in ids:
            uni.update(toks[k])
            prev = ["^", *toks[k][:-1]]
            bi.update(zip(prev, toks[k]))
            ctx.update(prev)
        return uni, bi, ctx

    ret = counts([k for k in toks if role(k) == 0])
    every = counts([k for k in toks if role(k) < 2])
    n_ret, v_ret = sum(ret[0].values()), len(ret[0])
    if weights is None:
        weights = {lv: (1 / 3, 1 / 3, 1 / 3) for lv in range(25)} | {0: (0, 0.5, 0.5)}
        events = []
        for k in toks:
            if role(k) == 1:
                for h, w in zip(["^", *toks[k][:-1]], toks[k]):
                    p2 = ret[1][h, w] / ret[2][h] if ret[2][h] else 0
                    events.append((level(ret[2][h]), p2, ret[0][w] / max(1, n_ret), 1 / (v_ret + 1)))
        for _ in range(60):
            sums = {lv: [0.0 if (lv, i) == (0, 0) else 1e-3 for i in range(3)] for lv in weights}
            for lv, *p in events:
                share = [a * b for a, b in zip(weights[lv], p)]
                for i in range(3):
                    sums[lv][i] += share[i] / sum(share)
            weights = {lv: tuple(x / sum(s) for x in s) for lv, s in sums.items()}
    uni, bi, ctx = every
    n, v = sum(uni.values()), len(uni)
    out = {}
    for k, t in toks.items():
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip(["^", *t[:-1]], t):
            a, b, c = weights[level(ctx[h])]
            score += math.log10(a * (bi[h, w] / ctx[h] if ctx[h] else 0) + b * uni[w] / max(1, n) + c / (v + 1))
        out[k] = (len(t), sum(uni[w] > 0 for w in t), base, score)
    return out, weights, n


def mixed(docs, mixing):
    """id -> (source, lang, topic, probability, kept) of (id, text, lang, source), with the constants of ``mixing``."""
    label = lambda v: "?" if v is None else "?" * v.startswith("?") + v
    x, weight = {}, {}
    for k, t, _, _ in docs:
        t = t or ""
        weight[k] = len(words(t))
        x[k] = [len(re.findall(p, t)) / max(1, len(t)) for p in mixing.FORMS.values()] + [weight[k] / max(1, len(t))]
    n = len(mixing.FORMS) + 1
    mean = [round(sum(v[j] for v in x.values()) / len(x), 6) for j in range(n)]
    dev = [round((sum((v[j] - sum(u[j] for u in x.values()) / len(x)) ** 2 for v in x.values()) / len(x)) ** 0.5, 6) or 1.0 for j in range(n)]
    x = {k: [(v[j] - mean[j]) / dev[j] for j in range(n)] for k, v in x.items()}
    centers = [[2.0 if k == j + 1 else 0.0 for j in range(n)] for k in range(n + 1)]

    def nearest(v):
        return min(range(n + 1), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centers[c])), c))

    for _ in range(mixing.TOPIC_ROUNDS):
        own = defaultdict(list)
        for v in x.values():
            own[nearest(v)].append(v)
        for c, vs in own.items():
            centers[c] = [round(sum(v[j] for v in vs) / len(vs), 6) for j in range(n)]
    cell = {k: (label(s), label(g), "none" if t is None else mixing.TOPICS[nearest(x[k])]) for k, t, g, s in docs}
    mass = Counter()
    for k, c in cell.items():
        mass[c] += weight[k]
    mass = {c: m for c, m in mass.items() if m}
    targets = []
    for a in range(3):
        shares = Counter()
        for c, m in mass.items():
            shares[c[a]] += m
        total = sum(v**mixing.TEMPERATURE for v in shares.values())
        targets.append({v: m**mixing.TEMPERATURE / total for v, m in shares.items()})
    fitted = dict(mass)
    for _ in range(400):
        for a in range(3):
            sums = Counter()
            for c, f in fitted.items():
                sums[c[a]] += f
            fitted = {c: f * targets[a][c[a]] / sums[c[a]] for c, f in fitted.items()}
    scale = top = max(mass[c] / fitted[c] for c in mass)
    for k in range(mixing.SCALES):
        scale = top * mixing.STEP**k
        given = {c: min(mass[c], scale * fitted[c]) for c in mass}
        off = 0.0
        for a in range(3):
            sums = Counter()
            for c, g in given.items():
                sums[c[a]] += g
            off = max(off, *(abs(s / sum(given.values()) - targets[a][v]) for v, s in sums.items()))
        if round(off, 9) <= mixing.BOUND:
            break
    p = {c: min(1.0, scale * fitted[c] / mass[c]) for c in mass}
    chance = lambda k: int(hashlib.md5(f"{k}:0".encode()).hexdigest()[:13], 16) / 2**52
    return {k: (*c, p.get(c, 1.0), chance(k) < p.get(c, 1.0)) for k, c in cell.items()}


def languages(train, texts):
    """(language, share of its words) of each text, by dictionaries of trigrams and words of (text, language) rows."""
    from ocellus.llm import hashing, langid

    @functools.cache
    def bucket(word):
        h = langid._HASHER.words(np.frombuffer(word + b" ", np.uint8), np.array([0]), np.array([len(word)]))
        return int(hashing.mix(h)[0]) >> 48

    @functools.cache
    def script(word):
        return max(int(langid.script_numbers(np.array([ord(c)]))[0]) for c in word.decode())

    def words(text):
        data = bytearray(b" " + (text or "").encode() + b" ")
        for i, b in enumerate(data):
            if 65 <= b <= 90 or (i and data[i - 1] == 0xC3 and 0x80 <= b <= 0x9E):
                data[i] = b + 32
            elif b in b"\t\n\x0b\x0c\r":
                data[i] = 32
        out, at = [], 0
        for w in bytes(data).split(b" "):
            if w:
                grams = [((a * 2654435761 + b * 40503 * 65599 + c * 2246822519) % 2**32) >> 16 for a, b, c in zip(data[at - 1 :], w, data[at + 1 :])]
                out.append((grams, bucket(w), script(w)))
            at += len(w) + 1
        return out

    grams, names, scripts = {}, {}, {}
    for text, lang in train:
        for g, w, s in words(text):
            grams.setdefault(lang, Counter()).update(g)
            names.setdefault(lang, Counter())[w] += 1
            scripts.setdefault(lang, Counter())[s] += 1
    langs = sorted(grams)
    share = {lang: {s: n / max(1, sum(c for k, c in scripts[lang].items() if k)) for s, n in scripts[lang].items()} for lang in langs}
    total = {id(c): sum(c.values()) for kind in (grams, names) for c in kind.values()}
    log = lambda counts, key, size: math.log((counts[key] + langid.SMOOTH) / (total[id(counts)] + langid.SMOOTH * size))
    known = {}

    def scores(g, w, s):
        if (tuple(g), w, s) not in known:
            fits = [lang for lang in langs if share[lang].get(s, 0) >= langid.SCRIPT_SHARE] or langs
            known[tuple(g), w, s] = {lang: 0.0 if s == 0 else sum(log(grams[lang], x, langid.GRAMS) for x in g) + log(names[lang], w, langid.WORDS) + (0 if lang in fits else langid.OFF_SCRIPT) for lang in langs}
        return known[tuple(g), w, s]

    out = []
    for text in texts:
        path, best, tags = [], None, words(text)
        for g, w, s in tags:
            own = scores(g, w, s)
            step = {}
            for lang in langs:
                before = (0.0, None) if best is None else max(((best[o] - (0 if o == lang else langid.SWITCH)), o) for o in langs)
                step[lang] = (before[0] + own[lang], before[1])
            best = {lang: v for lang, (v, _) in step.items()}
            path.append({lang: o for lang, (_, o) in step.items()})
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        at, votes = max(langs, key=lambda lang: best[lang]), Counter()
        for (_, _, s), came in zip(reversed(tags), reversed(path)):
            votes[at] += s > 0
            at = came[at]
        top = max(langs, key=lambda lang: votes[lang])
        out.append((top, votes[top] / sum(votes.values())))
    return out
