"""Fill-in-middle, embedding near-dedup and the divergence audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from pathloom.llm import audit, middle, vectors

TRICKY = ["<P>", "a<S", "<<M>", "<P", "é<é>P>", "<\U0001f600M>", "x" * 5000 + "<S>", "日本" * 3000, "<" * 4097, "P>S>M>", "a\x00b", "<\nP>"]


def drawn(doc_id):
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]


def made(doc_id, text):
    t, h = text or "", drawn(doc_id)
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_scan_and_cuts_of_blocks(block):
    r = random.Random(block)
    for t in [*TRICKY, *("".join(r.choice("<PSM>aé日\U0001f600") for _ in range(r.randrange(60))) for _ in range(300))]:
        raw = t.encode()
        counts, marked = middle.scan(raw, block)
        assert counts.sum() == len(t) and marked == bool(re.search("<[PSM]>", t))
        for k in {0, 1, len(t) // 2, len(t)} & set(range(len(t) + 1)):
            assert middle.place(raw, counts, k, block) == len(t[:k].encode())


def test_fill_in_middle(spark):
    more = spark.createDataFrame([(1000 + i, t, None, None, len(t)) for i, t in enumerate(TRICKY * 4)], documents(spark).schema)
    docs = documents(spark).unionByName(more).selectExpr("*", "1 AS N", "source AS output", "doc_id AS _raw")
    got = middle.fill_in_middle(docs).withColumn("again", middle.restored(F.col("output_"), F.col("form")))
    assert got.columns == [*docs.columns, "n_", "form", "prefix_chars", "middle_chars", "output_", "again"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["n_"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_"]) for r in rows) == Counter((r["doc_id"], *made(r["doc_id"], r["text"])) for r in docs.collect())
    assert all(r["again"] == (r["text"] or "") for r in rows) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(empty(spark)).count() == 0


def near(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept of rows (vec_id, vector, label), by all pairs."""
    units = [None if label is None else vectors.unit(v) for _, v, label in rows]
    links, parent = defaultdict(set), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (v, *_) in enumerate(rows):
        least[find(i)] += [v] if v is not None else []
    out = []
    for i, (v, *_) in enumerate(rows):
        root = min(least[find(i)], default=None)
        out.append((v, len(links[i]), root, v is not None and v == root))
    return Counter(out)


def awkward_vectors():
    r = np.random.default_rng(1)
    base, rows = r.normal(size=(40, 12)), []
    for i in range(260):
        centre, spread = (base[0], 0.02) if i % 3 == 0 else (base[i % 40], r.choice([0.0, 0.1, 0.35]))
        rows.append((i, [float(x) for x in (centre + spread * r.normal(size=12)) * r.choice([1.0, 3.0, 1e200])], None if i % 29 == 0 else i % 2))
    rows += [rows[3], rows[3], (None, rows[6][1], 0), (None, rows[1][1], 7), (300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [0.0] * 12, 1), (304, [float("nan"), *[1.0] * 11], 1), (305, [float("inf")] * 12, 1), (306, [None, *[1.0] * 11], 1), (307, rows[1][1][:5], 1), (308, rows[1][1][:5], 1)]
    return rows


@pytest.mark.parametrize("options", [{"slack": 1.0, "tile": 16, "sample": 200}, {}])
def test_near_vectors(spark, options, monkeypatch):
    monkeypatch.setattr(vectors, "LISTS", 1)
    rows = awkward_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS row", "vec_id AS core", "'x' AS x")
    assert Counter(tuple(r) for r in vectors.near_vectors(df, **options).collect()) == near(rows)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_large_cells_are_joined_and_probes_suffice(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LISTS", 2)
    monkeypatch.setattr(vectors, "FEW_CELLS", 0)
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 64))
    rows = [(i, [float(x) for x in base[i % 300] + (i >= 300) * 0.28 * r.normal(size=64)], 0) for i in range(900)]
    got = Counter({tuple(x): 1 for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()})
    want = near(rows)
    assert sum(x[1] for x in want) > 200 and sum(x[1] for x in got) >= 0.98 * sum(x[1] for x in want)
    assert all(g <= w for g, w in zip((x[1] for x in sorted(got)), (x[1] for x in sorted(want)), strict=True))


def test_codes_stand_for_their_vectors():
    x = np.random.default_rng(2).normal(size=(500, 10))
    book = vectors.Codebooks(x, 9)
    own, far, codes, missed = book.encode(x)
    meant = np.concatenate([book.words[i][codes[:, i]] for i in range(len(book.spaces))], axis=1) + book.coarse[own]
    assert np.allclose(np.sqrt(((x - meant) ** 2).sum(axis=1)), missed) and (far.argmin(axis=1) == own).all()
    tables = book.tables(x[:5], 3)
    mine = codes[own == 3]
    assert np.allclose(sum(t[:, mine[:, j]] for j, t in enumerate(tables)), ((x[:5, None] - meant[own == 3]) ** 2).sum(axis=2))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        docs[lang or ""].update(set(terms))
        groups[lang or "", source or ""].update(terms)
    out = []
    for lang, df in docs.items():
        kept = [t for t, n in df.items() if n >= least]
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms[:top])) for k, (v, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("unit_bytes", [64, 1 << 20])
def test_divergence(spark, unit_bytes, monkeypatch):
    monkeypatch.setattr(audit, "HELD", 5)
    monkeypatch.setattr(audit, "BLOCK", 8)
    monkeypatch.setattr(audit, "FEW_GROUPS", 0 if unit_bytes == 64 else 100)
    docs = documents(spark, extra=True).selectExpr("*", "1 AS n", "'p' AS term", "2 AS block")
    got = audit.divergence(docs, least=3, top=4, unit_bytes=unit_bytes)
    want = audited([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 3, 4)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 100
    few = docs.where("source = 's1'").limit(1)
    assert Counter(tuple(r) for r in audit.divergence(few).collect()) == audited([(r["text"], r["lang"], r["source"]) for r in few.collect()], 10, 10)
    assert audit.divergence(empty(spark)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    rows = [(10**15 + 7, 3 * 10**15 + 1), (0, 4), (5, 9 * 10**17)]
    got = spark.createDataFrame(rows, "n long, total long").select(audit._share("n", "total").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 2) // t for n, t in rows]
