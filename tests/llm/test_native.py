"""Line dedup, sharding, mixing and winnowing against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from fixtures import documents, empty
from pyspark.sql import functions as F

from pathloom.llm import lines, mixing, sharding, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_line_dedup(spark):
    docs = documents(spark, extra=True).withColumn("source", F.concat(F.lit("s"), (F.coalesce("doc_id", F.lit(99)) % 5).cast("string")))
    got = lines.drop_boilerplate(docs, min_sites=3)
    assert got.columns == [*docs.columns, "lines_removed"]
    rows, sites, first = [r.asDict() for r in docs.collect()], defaultdict(set), {}
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    for r in sorted((r for r in rows if r["text"] is not None), key=key):
        for k, line in enumerate(r["text"].split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(r["source"])
                first.setdefault(line.strip(" "), (r["doc_id"], k))
    want = Counter()
    for r in rows:
        text = r["text"]
        if text is not None:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip(" ") or len(sites[x.strip(" ")]) < 3 or first[x.strip(" ")] == (r["doc_id"], k))
        want[r["doc_id"], text] += 1
    found = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == want and sum(r["lines_removed"] for r in found) > 3
    assert lines.drop_boilerplate(empty(spark)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    sites = [(i, "\n".join(f"line {k}" for k in range(60, 141) if i < k), None, f"site {i}", 0) for i in range(140)]
    docs = spark.createDataFrame(sites, "doc_id long, text string, lang string, source string, n_chars long")
    flagged = lines.boilerplate_lines(lines._lines(docs, "doc_id", "text", "source"), 100, lg_k=4)
    lit = {r["h"] for r in spark.createDataFrame([(f"line {k}",) for k in range(100, 141)], "t string").select(F.xxhash64("t").alias("h")).collect()}
    assert {r["h"] for r in flagged.collect()} == lit


def test_ring_shards(spark):
    docs = documents(spark, extra=True)
    rows = [tuple(r) for r in sharding.ring_shards(docs).collect()]
    said = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter(r[:3] for r in rows) == said
    slots = defaultdict(list)
    for r in rows:
        slots[r[3]].append(r[4])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    assert sharding.ring_shards(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.ring_shards(docs, load_factor=0.9)


def test_ring_shards_moves_little_and_bounds_loads(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(docs, 8, load_factor=1.2).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(docs, 9, load_factor=1.2).collect()}
    for got, n in ((a, 8), (b, 9)):
        assert max(Counter(got.values()).values()) <= math.ceil(1.2 * 2000 / n) and len(got) == 2000
    assert sum(a[i] != b[i] for i in a) < 2000 * 0.45


def xx(*values):
    """xxhash64 of Spark: each value's hash is the seed of the next."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(h):
    return h - 2**64 if h >> 63 else h


def walk(ids, shards, vnodes, cells, caps):
    """(id, shard, slot) by hand: arcs fill their own shard in ring order, the rest queues for the rooms on its way."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(xx("vnode", (s,), v) % cells, []).append((signed(xx(v, (s,))), s, v))
    at = sorted(points)
    home = [min(points[c])[1] for c in at]
    arcs = [[] for _ in at]
    for i in sorted(ids, key=lambda i: ((at[0] - 1 - xx(i)) % cells, 0)):
        c = xx(i) % cells
        arcs[next((k for k, p in enumerate(at) if p >= c), 0)].append((-((at[next((k for k, p in enumerate(at) if p >= c), 0)] - c) % cells), signed(xx(i)), i))
    load, out, over = [0] * shards, [], []
    for k, own in enumerate(arcs):
        own.sort()
        stay = min(len(own), caps[home[k]] - load[home[k]])
        out += [(x[2], home[k], load[home[k]] + n) for n, x in enumerate(own[:stay])]
        load[home[k]] += stay
        over.append([x[2] for x in own[stay:]])
    room, n = [], Counter(home)
    for k, s in enumerate(home):
        nth, left = sum(x == s for x in home[:k]), caps[s] - load[s]
        room.append(left // n[s] + (nth < left % n[s]))
    for start in range(len(at)):
        queue, more, fill = [], [], list(load)
        for k in [*range(start, len(at)), *range(start)]:
            queue += over[k]
            for i in queue[: room[k]]:
                more.append((i, home[k], fill[home[k]]))
                fill[home[k]] += 1
            queue = queue[room[k] :]
        if not queue:
            return sorted(out + more)


@pytest.mark.parametrize("n,shards,vnodes,factor", [(500, 8, 4, None), (300, 5, 2, 1.1), (7, 8, 4, None), (400, 6, 8, 3.0)])
def test_every_placement_on_the_ring(spark, n, shards, vnodes, factor):
    docs = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.lit("t").alias("text"))
    got = sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.ring_shards(docs, shards, vnodes=vnodes, load_factor=factor, cells=256).collect())
    caps = [n // shards + (s < n % shards) for s in range(shards)] if factor is None else [math.ceil(factor * n / shards)] * shards
    assert got == walk([7 * i for i in range(n)], shards, vnodes, 256, caps)


def test_many_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = Counter(r["shard"] for r in sharding.ring_shards(docs, 1000).collect())
    assert len(counts) == 1000 and set(counts.values()) == {3}


def mix_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    docs = documents(spark, extra=True)
    got = mixing.mix(docs)
    rows, again = got.collect(), got.collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == docs.count()
    said = [r.asDict() | {"size": len(WORD.findall(r["text"] or ""))} for r in docs.collect()]
    sizes = Counter()
    for r in said:
        sizes[r["source"]] += r["size"]
    targets = mix_targets(sizes)
    by_key = defaultdict(list)
    for r in said:
        by_key[r["doc_id"], r["size"]].append(r["source"])
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        source = by_key[r["doc_id"], r["size"]][0]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        taken[source] += r["taken"]
    # Blocks are single words here, so totals are off by the points' discrepancy.
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)
    assert {r["slot"] is None for r in rows if not r["taken"]} <= {True} and len({r["slot"] for r in rows if r["taken"]}) == sum(r["taken"] > 0 for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_the_mix_follows_its_points(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 5 + int(id % 9)) AS text", "concat('s', id % 4) AS source")
    placed, reads = mixing.placements(docs, block=4)
    total = math.ceil(sum(t for t in {r["source_no"]: round(r["target"]) for r in placed.collect()}.values()) / 4)
    quota = {r["source_no"]: round(r["target"]) for r in placed.collect()}
    size = {r["source_no"]: r["source_size"] for r in placed.collect()}
    ends, up = [], 0
    for no in sorted(quota):
        up += quota[no]
        ends.append((up / sum(quota.values()), no))
    slots = defaultdict(list)
    for t in range(total):
        x = (t + 1) * mixing.GOLDEN
        slots[next(no for hi, no in ends if x - math.floor(x) < hi)].append(t)
    streams = defaultdict(list)
    for r in placed.collect():
        streams[r["source_no"]].append((r["start"], r["size"], r["row_key"]))
    want = Counter()
    for no, own in streams.items():
        assert [a for a, _, _ in sorted(own)] == [sum(n for _, n, _ in sorted(own)[:k]) for k in range(len(own))] and sorted(own) == sorted(own, key=lambda x: (x[2], x[0]))
        limit = min(4 * len(slots[no]), 2 * size[no])
        for read in (0, 1):
            for start, n, key in own:
                a = read * size[no] + start
                if a < limit:
                    want[key, read, slots[no][a // 4], min(n, limit - a)] += 1
    assert Counter((r["row_key"], r["read"], r["slot"], r["words"]) for r in reads.collect()) == want
    other = mixing.schedule(placed.select("source_no", "target").distinct(), 4, golden=0.7320508075688772)
    assert Counter(r["source_no"] for r in other.collect()) != Counter({no: len(x) for no, x in slots.items()}) or sorted((r["slot"], r["source_no"]) for r in other.collect()) != sorted((t, no) for no, x in slots.items() for t in x)


def test_mixed_documents(spark):
    docs = documents(spark).selectExpr("*", "1 AS slot", "'x' AS `_mx_key`", "2 AS row_key")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    _, reads = mixing.placements(docs)
    times = Counter()
    for r in {(r["row_key"], r["read"]) for r in reads.where("words * 2 >= size").collect()}:
        times[r[0]] += 1
    key = docs.select("doc_id", "text", mixing.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()
    want = Counter()
    for r in key:
        want[r["doc_id"], r["text"]] += times[r["k"]]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 0, 9000.0), ("b", 1, 900.0), ("c", 2, 100.0), ("d", 3, 3.0)], "source string, source_no int, target double")
    slots = sorted(mixing.schedule(targets, 10).collect(), key=lambda r: r["slot"])
    total = Counter(r["source_no"] for r in slots)
    assert all(abs(total[no] - n / 10) <= 2 for no, n in enumerate((9000, 900, 100, 3))) and len(slots) == 1001
    for no in range(4):
        assert [r["number"] for r in slots if r["source_no"] == no] == list(range(total[no]))
    early = Counter(r["source_no"] for r in slots[: len(slots) // 3])
    assert abs(early[0] - 300) < 12 and abs(early[1] - 30) < 6


def test_winnowing(spark):
    docs = documents(spark, extra=True)
    spans = winnowing.fingerprint_edits(docs)
    rows = spans.collect()
    said = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(rows) == len(said)
    hash_of = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in said], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(said, key=lambda x: (x[0] is None, -(x[0] or 0), hash_of[x[1]]))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        want[i, len(t), t[: len(t) - len(t) // 3] + u[: len(t) // 3]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in rows) == want
    assert all(0 <= r[k] <= 1 for r in rows for k in ("near_edited", "near_next"))
    assert winnowing.fingerprint_edits(empty(spark)).count() == 0
    one = winnowing.fingerprint_edits(docs.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def gram_hash(words):
    """xxhash64 of three numbers; nulls keep the seed."""
    return xx(*words)


def room(text):
    return min(10, max(1, len(text) // 32 - 2))


def by_hand(grams, window):
    """Of every window the least hash, rightmost where it ties: (hash, position), each once, in order."""
    picks = []
    for j in range(max(1, len(grams) - window + 1)):
        least = min(grams[j : j + window])
        at = max(i for i in range(j, min(len(grams), j + window)) if grams[i] == least)
        if not picks or picks[-1][1] != at:
            picks.append((least, at))
    return picks


def brute_fingerprint(text):
    """The whole fingerprint of a text of words of up to 16 letters and digits between single blanks."""
    words = [signed(xx(w)) for w in text.split()]
    if not words:
        return []
    found = by_hand([signed(gram_hash(words[i : i + 3])) for i in range(max(1, len(words) - 2))], room(text))
    if len(text) < 128:
        window = min(4, max(1, len(text) // 2 - 1))
        found += by_hand([signed(xx("characters", text[i : i + 3])) for i in range(max(1, len(text) - 2))], window)
    return found


def test_fingerprints_and_likeness_by_hand(spark):
    r = random.Random(11)
    said = [" ".join(r.choice(["aa", "b", "ccc", "d1", "longer"]) for _ in range(n)) for n in (1, 2, 3, 7, 20, 60, 90, 200)] + ["x " * 300, "", "ab"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for row in winnowing.fingerprint_edits(docs).collect():
        t, u = said[row["doc_id"]], said[row["doc_id"] - 1]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = ([(h, p) for h, p in brute_fingerprint(x)] for x in (t, edited, u))
        assert [(x["h"], -x["p"]) for x in row["chosen"]] == a
        if not edited.strip() or edited.split(" ") == edited.split():
            assert [(x["h"], -x["p"]) for x in row["edited_chosen"]] == b
            x, y = {h for h, _ in a}, {h for h, _ in b}
            assert row["near_edited"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1)
        x, y = {h for h, _ in a}, {h for h, _ in c}
        assert row["near_next"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1)


def test_winnowing_chooses_rightmost_least_and_keeps_its_promise(spark):
    r = random.Random(3)
    said = [" ".join(r.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 11, 12, 13, 80)] + ["q " * 40 + " ".join(f"w{i}" for i in range(14)) + " y" * 50, "zz " * 9 + " ".join(f"w{i}" for i in range(14))]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    hashes = F.transform(F.split("t", " "), lambda x: F.xxhash64(x))
    got = df.select("t", winnowing.winnow(F.col("t")).alias("c"), hashes.alias("ws")).collect()
    for row in got:
        ws = row["ws"] if row["t"] else []
        if not ws or not row["t"].split():
            assert row["c"] == []
            continue
        ws = [x for x, t in zip(ws, row["t"].split(" "), strict=True) if t]
        grams = [tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
        assert [(c["h"], -c["p"]) for c in row["c"]] == by_hand([signed(gram_hash(g)) for g in grams], room(row["t"]))
    shared = {c["h"] for c in got[-1]["c"]} & {c["h"] for c in got[-2]["c"]}
    assert shared  # 14 words in common, 12 suffice


def test_sha_of_query_columns(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    row = winnowing.op6_winnowing(spark, str(tmp_path)).where("doc_id = 2").first()
    full = winnowing.fingerprint_edits(docs).where("doc_id = 2").first()
    assert row["edited_sha256"] == hashlib.sha256(full["edited"].encode()).hexdigest() and len(row["fingerprint"].split()) == len(full["chosen"])
