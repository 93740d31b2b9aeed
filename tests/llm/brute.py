"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingle_components(rows):
    """doc_id -> (set size, least doc_id reachable); doc_ids must be distinct."""
    sets, by_shingle = {}, defaultdict(list)
    for d, text in rows:
        w = words(lowered(text))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for s in sets[d]:
            by_shingle[s].append(d)
    parent = {d: d for d in sets}
    for met in by_shingle.values():
        for i, a in enumerate(met):
            for b in met[i + 1 :]:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = find(parent, a), find(parent, b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(parent, d)) for d in sets}


def removed_repeats(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, mask, strict=True) if not y)
        spans = sum(1 for i, x in enumerate(mask) if x and (i == 0 or not mask[i - 1]))
        out[d] = (len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def water(total, children):
    """Shares of children {name: (weight, cap)}."""
    share, open_, full = dict.fromkeys(children, 0.0), {k for k, (w, _) in children.items() if w > 0}, set()
    while open_:
        weights, rest = sum(children[k][0] for k in open_), total - sum(children[k][1] for k in full)
        new = {k for k in open_ if rest * children[k][0] / weights >= children[k][1] - 1e-9}
        if not new:
            return share | {k: rest * children[k][0] / weights for k in open_}
        share |= {k: children[k][1] for k in new}
        full |= new
        open_ -= new
    return share


def mixed(rows, plan, domain):
    """doc_id -> copies chosen, for rows (doc_id, text, lang, source)."""
    leaves = defaultdict(list)
    for d, t, lang, source in rows:
        leaves[domain(source), lang, source].append((d, t))
    tokens = {k: sum(len(words(t)) for _, t in v) for k, v in leaves.items()}
    given = {(): min(plan.budget_share, plan.max_epochs) * sum(tokens.values())}
    for depth, weights in enumerate((plan.domain_weights, plan.lang_weights, plan.source_weights)):
        below = {}
        for above, amount in given.items():
            children = {}
            for k in leaves:
                if k[:depth] == above:
                    w, cap = children.get(k[: depth + 1], (weights.get(k[depth], 1.0), 0))
                    children[k[: depth + 1]] = (w, cap + tokens[k] * plan.max_epochs)
            below |= water(amount, children)
        given = below
    out = Counter()
    for k, docs in leaves.items():
        if not tokens[k]:
            continue
        budget = math.floor(given[k] + 1e-9)
        epochs, used = budget // tokens[k], 0
        rest = budget - epochs * tokens[k]
        place = lambda d, t: hashlib.md5(f"{plan.seed}|{epochs}|{d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        for d, _ in docs:
            out[d] += epochs
        for _, d, t in sorted((place(d, t), d, t) for d, t in docs):
            used += len(words(t))
            if used > rest:
                break
            out[d] += 1
    return {d: n for d, n in out.items() if n}


def statistics(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _estimate(x, keep, sampling, consistency, start):
    """(determinant, documents kept, mean, spread) of least determinant over the concentration steps from one start."""
    mean, cov, best = *start, (math.inf, 0, None, None)
    while True:
        c = x - mean
        d = np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov + np.diag(sampling**2)), c)
        bins = np.floor(np.log2(d + 1) * 32)
        near = x[bins <= np.sort(bins)[math.ceil(keep * len(x)) - 1]].astype(float)
        mean, cov = near.mean(axis=0), consistency * np.cov(near.T, bias=True)
        det = math.sqrt(np.linalg.det(cov + np.diag(sampling**2)))
        if det >= best[0] * (1 - 1e-9):
            return best
        best = det, len(near), mean, cov


def robust_distances(rows, sampling, keep, consistency, prior):
    """key -> squared distance, for rows (key, lang, source, vector of whole numbers)."""
    above, out = {}, {}
    for depth in range(3):
        groups, now = defaultdict(list), {}
        for key, *place, x in rows:
            groups[tuple(place[:depth])].append((key, x))
        for g, members in groups.items():
            x = np.array([v for _, v in members])
            q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
            starts = [(q2, np.diag(np.maximum((q3 - q1) / 1.349, sampling) ** 2 - sampling**2)), (q2, np.zeros((4, 4))), (x.mean(axis=0), np.cov(x.T, bias=True))]
            _, n, mean, cov = min((_estimate(x, keep, sampling, consistency, s) for s in starts), key=lambda e: e[0])
            if depth:
                up, w = above[g[:-1]], prior / (n + prior)
                off = mean - up[0]
                mean, cov = (1 - w) * mean + w * up[0], (1 - w) * cov + w * up[1] + w * (1 - w) * np.outer(off, off)
            now[g] = mean, cov
            if depth == 2:
                c, inverse = x - mean, np.linalg.inv(cov + np.diag(sampling**2))
                out |= dict(zip((k for k, _ in members), np.einsum("ij,jk,ik->i", c, inverse, c), strict=True))
        above = now
    return out


def cased_like_words(candidate):
    capitals, small = (len(re.findall(p, candidate)) for p in ("[A-Z]", "[a-z]"))
    return not re.search("[0-9]", candidate) and (4 * capitals <= len(candidate) or 8 * small <= len(candidate))


def secret_spans(text, classes, assign, kinds, allowed):
    """Base spans and all spans as strings."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    every = list(base)
    for c in classes:
        for m in re.finditer(c.pattern, text):
            if cased_like_words(m[0]) or any(re.search(r, m[0]) for r in allowed[: len(allowed) - (c.kind == "entropy_hex")]):
                continue
            hot = []
            for i in range(len(m[0]) - 19):
                counts = Counter(m[0][i : i + 20]).values()
                if -sum(n / 20 * math.log2(n / 20) for n in counts) >= c.bits - 1e-9:
                    hot.append(i)
            if hot:
                every.append((m.start() + hot[0], kinds.index(c.kind), m.start() + hot[-1] + 20))
    joined = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return joined(base), joined(every)
