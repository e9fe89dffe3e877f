"""Plain Python versions of the pipeline's stages, for rows as dictionaries."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

from pathloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lettered(rows):
    return [r for r in rows if regex.search(r"\p{L}", r["text"] or "")]


def without_boilerplate(rows, sites=10):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    spread, first, out = defaultdict(set), {}, []
    for r in sorted(rows, key=key):
        for k, line in enumerate((r["text"] or "").split("\n")):
            spread[line.strip(" ")].add(r["source"])
            first.setdefault(line.strip(" "), (r["doc_id"], k))
    for r in rows:
        stays = lambda k, x, r=r: not x or len(spread[x]) < sites or first[x] == (r["doc_id"], k)
        text = r["text"] if r["text"] is None else "\n".join(x for k, x in enumerate(r["text"].split("\n")) if stays(k, x.strip(" ")))
        out.append(r | {"text": text})
    return out


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(words)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def one_of_each(rows, likeness=0.8):
    """The smallest id of each component of texts that are alike; rows without an id stay."""
    own, parent = [r for r in rows if r["doc_id"] is not None], {}
    sets = [shingles(r["text"]) for r in own]

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= likeness * len(a | b) - 1e-9:
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(own):
        root = find(i)
        best[root] = min(best.get(root, r["doc_id"]), r["doc_id"])
    return Counter(best.values())


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] >= most * sizes[s]]
        if not over:
            return {s: (stopped | part)[s] for s in names}
        stopped |= {s: most * sizes[s] for s in over}


def mixed(rows):
    """How often each (id, text) is taken when blocks are single words, so for small tables."""
    rows = [r | {"size": len(WORD.findall(r["text"] or "")), "key": int(hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:15], 16)} for r in rows]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    quota = {s: round(t) for s, t in targets(sizes).items()}
    whole, ends, up = sum(quota.values()), [], 0
    for s, n in quota.items():
        up += n
        ends.append((up / whole if whole else 0, s))
    got = Counter(next(s for hi, s in ends if (t + 1) * mixing.GOLDEN - math.floor((t + 1) * mixing.GOLDEN) < hi) for t in range(whole))
    times = Counter()
    for s in sizes:
        at, limit = 0, min(got[s], 2 * sizes[s])
        seen = set()
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        for read in (0, 1):
            at = read * sizes[s]
            for r in own:
                if r["size"] and min(r["size"], limit - at) * 2 >= r["size"]:
                    seen.add((r["key"], read, r["doc_id"], r["text"]))
                at += r["size"]
        for _, _, i, t in seen:
            times[i, t] += sum(r["doc_id"] == i and r["text"] == t for r in rows)
    return +times
