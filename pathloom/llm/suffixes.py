"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts anywhere else.

1. Anchors. Of each window of `length` bytes the 64-byte gram with the smallest hash is an anchor, so equal windows hold the same
   anchor at the same place. An anchor's context is all the bytes that windows around it can reach.
2. Anchors meet by hash in one shuffle and are told apart in sorted order, as a stream. One that occurs once cannot matter. A context that
   occurs again whole is covered whole. Other contexts of an anchor, each distinct one once, are marked.
3. Marked contexts meet in blocks. Aligned at their anchors, a block's contexts have a Burrows-Wheeler transform in layers: layer x
   lists the suffixes that start x bytes before the anchor in sorted order, with the symbols before them; its LF mapping leads to
   layer x + 1. Breadth-first backward extension derives common prefixes in increasing value: the intervals of suffixes that share l
   bytes, each extended by the preceding symbol, are the intervals that share l + 1 one layer on. It stops at `length`. Suffixes in one
   interval there are windows that repeat.
4. An anchor with more than `hot` marked contexts would make a block too large for a task. Its suffixes are extended by all symbols at once: in each layer a
   digest of the whole window names the interval, and intervals are counted by aggregation. The spans are the same.
5. Spans are united per text. Rows of equal text cover each other, like any other repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.filters import among, bits_for, key_filter
from pathloom.functions.lineage import checkpointed

LENGTH = 200
GRAM = 64
#: Contexts of an anchor that fit a task's block: about 100 MB with its transform.
HOT = 50_000
#: Bytes of text that one pass over anchors takes at most (or one text), and contexts in one transform (or one anchor's).
CHUNK = 1 << 21
BLOCK = 1 << 12
#: Keys of texts that a task remembers before it starts anew.
REMEMBERED = 1 << 16
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
COVERED, SINGLE, SEVERAL = 0, 1, 2


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` neighbours, by doubling."""
    span, s = 1, x
    while span * 2 <= width:
        s = op(s[:-span], s[span:])
        span *= 2
    rest = width - span
    return op(s[: len(s) - rest], s[rest:]) if rest else s


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, position and gram hash of each anchor. Texts shorter than `length` have none."""
    own = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.zeros(0, dtype=np.int64)
    if not own:
        return none, none, none.astype(np.uint64)
    sizes = np.array([len(texts[i]) for i in own])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = b"".join(texts[i] for i in own)
    grams, width = len(raw) - GRAM + 1, length - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = np.zeros(grams, dtype=np.uint64)
    for k in range(GRAM // 8):
        part = words[8 * k : 8 * k + grams] * MIX[k % 4]
        h = h * MIX[4] + (part ^ (part >> np.uint64(31)))
    h ^= h >> np.uint64(32)
    h *= MIX[4]
    h ^= h >> np.uint64(29)
    least = _slide(h, width, np.minimum)
    # A window that crosses the end of a text counts for nothing.
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + sizes - length + 1] -= 1
    least[np.cumsum(edge)[: len(least)] == 0] = 0
    none_left = np.zeros(width - 1, dtype=np.uint64)
    best = _slide(np.concatenate([none_left, least, none_left]), width, np.maximum)
    at = np.nonzero((h == best) & (h != 0))[0]
    text = np.searchsorted(starts, at, side="right") - 1
    return np.array(own, dtype=np.int64)[text], at - starts[text], h[at]


def _context(text: bytes, pos: int, length: int) -> tuple[int, bytes]:
    lo = max(0, pos - (length - GRAM))
    return lo, text[lo : pos + length]


def repeated_windows(contexts: list[bytes], lefts: list[int], groups: list[int], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each context the span covered by windows that another context of its group has at the same distance from the anchor, or None.

    contexts are sorted by (group, bytes from the anchor on). Layer x of the transform lists the suffixes that start x bytes before the anchor in
    sorted order. A suffix of layer x - 1 and the symbol before it are a suffix of layer x, so a stable sort by (interval, symbol), the LF
    mapping, leads there, and every interval of suffixes that share l bytes becomes intervals that share l + 1. What shares `length` bytes in layer x
    comes from the intervals of layer 0 that share length - x: mappings keep the order, so both boundaries still part neighbours there.
    A suffix that is alone in its interval stays alone, and leaves. All windows of a context hold its anchor, so together they are one span.
    """
    m, most = len(contexts), length - GRAM
    left = np.array(lefts)
    sizes = np.array([len(c) for c in contexts]) - left
    right = np.frombuffer(b"".join(c[x : x + length].ljust(length, b"\0") for c, x in zip(contexts, lefts, strict=True)), dtype=np.uint8).reshape(m, length)
    before = np.frombuffer(b"".join(c[max(0, x - most) : x].rjust(most, b"\0") for c, x in zip(contexts, lefts, strict=True)), dtype=np.uint8).reshape(m, most)
    group = np.cumsum([0] + [a != b for a, b in zip(groups, groups[1:], strict=False)])
    # Common prefixes of neighbours from the anchor on; a suffix shares no more than it has.
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(np.minimum(common, sizes[1:]), sizes[:-1])
    common[group[1:] != group[:-1]] = 0
    common = np.concatenate([[0], common])
    least, last = np.full(m, most + 1), np.full(m, -1)
    order, interval = np.arange(m), group
    for x in range(most + 1):
        if x:
            deep = left[order] >= x
            order, interval = order[deep], interval[deep]
            key = (interval << 8) | before[order, most - x]
            lf = np.argsort(key, kind="stable")
            order, interval = order[lf], key[lf]
        if len(order) < 2:
            break
        same = interval[1:] == interval[:-1]
        near = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, interval = order[near], np.cumsum(np.concatenate([[True], ~same]))[near]
        part = np.cumsum(common < length - x)[order]
        same = (interval[1:] == interval[:-1]) & (part[1:] == part[:-1])
        again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        least[again] = np.minimum(least[again], x)
        last[again] = x
    return [(at - z, at - a + length) if z >= 0 else None for at, a, z in zip(left.tolist(), least.tolist(), last.tolist(), strict=True)]


def _anchor_rows(length: int):
    """One row per anchor: hash, context's digest, text's key, check << 32 | position, and how far a run of the same anchor and context goes on in the text.

    Runs step by less than `length`, so their contexts overlap. A text that a task has again gives its rows once more, and no more: two occurrences tell what more would.
    """

    def run(batches):
        times: dict[tuple[int, int], int] = {}
        for b in batches:
            keys, texts = [], []
            for t, k, c in zip(b.column("text").to_pylist(), b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True):
                times[k, c] = times.get((k, c), 0) + 1
                if times[k, c] <= 2:
                    keys.append((k, c))
                    texts.append(t.encode())
            if len(times) > REMEMBERED:
                times.clear()
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                no, pos, h = anchors(texts[first:last], length)
                x = np.empty(len(no), dtype=np.uint64)
                for i, (t, p) in enumerate(zip(no.tolist(), pos.tolist(), strict=True)):
                    lo, ctx = _context(texts[first + t], p, length)
                    x[i] = xxhash.xxh3_64_intdigest(ctx, p - lo)
                begins = np.ones(len(no), dtype=bool)
                begins[1:] = (no[1:] != no[:-1]) | (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (pos[1:] - pos[:-1] > length)
                at = np.nonzero(begins)[0]
                end = np.append(at[1:], len(no))[: len(at)] - 1
                own = np.array(keys[first:last], dtype=np.int64).reshape(-1, 2)[no[at]]
                cols = (h[at].view(np.int64), x[at].view(np.int64), own[:, 0], (own[:, 1] << 32) | pos[at], (pos[end] - pos[at]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["h", "x", "k", "cp", "more"])
                first = last

    return run


def _told_apart(batches):
    """Anchor rows sorted by (h, x) -> (kind, h, k, cp, more) of those that matter. Holds one row of a hash and one of a context."""
    h0 = x0 = first = held = None
    run, runs = 0, 0
    out: list[tuple] = []

    def end_run():
        nonlocal held, runs
        mark = (SEVERAL if run > 1 else SINGLE, h0, *first[:2], 0)
        runs += 1
        if runs == 1:
            held = mark
            return
        if runs == 2:
            out.append(held)
        out.append(mark)

    def batch():
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        made = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names=["kind", "h", "k", "cp", "more"])

    for b in batches:
        for h, x, k, cp, more in zip(*(b.column(n).to_pylist() for n in ("h", "x", "k", "cp", "more")), strict=True):
            if h == h0 and x == x0:
                run += 1
                if run == 2:
                    out.append((COVERED, h, *first))
                out.append((COVERED, h, k, cp, more))
                continue
            if first is not None:
                end_run()
            if h != h0:
                runs = 0
            h0, x0, first, run = h, x, (k, cp, more), 1
            if more:  # a run in one text: twice already
                run = 2
                out.append((COVERED, h, *first))
        yield batch()
    if first is not None:
        end_run()
    yield batch()


def _context_rows(length: int):
    kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        out: list[tuple] = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["h", "n", "k", "c", "lo", "left", "ctx"])
            out.clear()
            return made

        for b in batches:
            for k, c, text, marks in zip(*(b.column(n) for n in ("k", "c", "text", "marks")), strict=True):
                raw, k, c = text.as_py().encode(), k.as_py(), c.as_py()
                for m in marks.as_py():
                    lo, ctx = _context(raw, m["pos"], length)
                    out.append((m["h"], 1 if m["kind"] == SINGLE else 2, k, c, lo, m["pos"] - lo, ctx))
                    if len(out) == BLOCK:
                        yield batch()
        yield batch()

    return run


def _block_rows(length: int):
    """Rows of contexts sorted by h -> spans. A block ends with a hash once it has BLOCK contexts; a hash has at most `hot`."""
    names, kinds = ("h", "n", "k", "c", "lo", "left", "ctx"), [pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def spans(rows):
        rows.sort(key=lambda r: (r[0], r[6][r[5] :]))
        found = repeated_windows([r[6] for r in rows], [r[5] for r in rows], [r[0] for r in rows], length)
        out = [(r[2], r[3], r[4] + s[0], r[4] + s[1]) for r, s in zip(rows, found, strict=True) if s is not None and r[1] == 1]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["k", "c", "lo", "hi"])

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if len(rows) >= BLOCK and r[0] != rows[-1][0]:
                    yield spans(rows)
                rows.append(r)
        if rows:
            yield spans(rows)

    return run


def _window_rows(length: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(part, 256).to_pylist():
                    for p in range(max(0, r["left"] - (length - GRAM)), min(r["left"], len(r["ctx"]) - length) + 1):
                        out.append((r["h"], r["left"] - p, xxhash.xxh3_64_intdigest(r["ctx"][p : p + length]), r["n"], r["k"], r["c"], r["lo"] + p))
                cols = [np.array([r[2] for r in out], dtype=np.uint64).view(np.int64) if i == 2 else [r[i] for r in out] for i in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "r", "d", "n", "k", "c", "at"])

    return run


def _cut(raw: bytes, spans: list) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the kept bytes."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return sum(hi - lo for lo, hi in runs), len(runs), b"".join(kept)


def _kept_rows(with_kept: bool):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                out.append((*_cut(raw, spans or []), len(raw)))
            cols = [b.column("k"), b.column("c"), pa.array([r[3] for r in out], pa.int64()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in out], pa.string())]
            if with_kept:
                cols.append(pa.array([r[2] for r in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["k2", "c2", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept)

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for): one row per row of docs.

    A null text is an empty one. Texts count once per row: two rows of equal text of `length` bytes or more remove each other.
    length is at least 128. Ids are carried only; they may be null or repeated. Other columns of docs are not read. An empty table gives no rows.

    Texts are read where they lie. Only those that a filter of bounded size lets pass move: once to be cut into contexts, if they have marked anchors, and
    once to be cut, if they have spans. All other rows are hashed in place.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("k", F.xxhash64("text")).withColumn("c", F.hash("text"))
    long = F.octet_length("text") >= length

    def moved(wanted: DataFrame, side: DataFrame) -> DataFrame:
        """Each distinct text of the keys in wanted once, with the columns of side(k, c, ...)."""
        bits = bits_for(wanted.count())
        passed = among(keyed.where(long), F.col("k"), key_filter(wanted, F.col("k"), bits), "_in", bits).where("_in").select("k", "c", "text")
        once = passed.groupBy("k", "c").agg(F.any_value("text").alias("text"))
        return once.join(side.withColumnsRenamed({"k": "k2", "c": "c2"}), (F.col("k") == F.col("k2")) & (F.col("c") == F.col("c2"))).drop("k2", "c2")

    marked = keyed.where(long).select("k", "c", "text").mapInArrow(_anchor_rows(length), "h long, x long, k long, cp long, more int")
    told = marked.repartition("h").sortWithinPartitions("h", "x").mapInArrow(_told_apart, "kind byte, h long, k long, cp long, more int")
    row = F.struct("kind", "h", F.col("cp").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("pos"), "more")
    found = checkpointed(told.groupBy("k", F.shiftright("cp", 32).cast("int").alias("c")).agg(F.collect_set(row).alias("rows")))
    marks = found.select("k", "c", F.filter("rows", lambda m: m["kind"] != COVERED).alias("marks")).where(F.size("marks") > 0)
    around = moved(marks, marks).mapInArrow(_context_rows(length), "h long, n byte, k long, c int, lo int, left int, ctx binary")
    often = checkpointed(marks.select(F.explode("marks.h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("h").alias("hot_h")))
    blocks = "k long, c int, lo int, hi int"
    if often.isEmpty():
        repeats = around.repartition("h").sortWithinPartitions("h").mapInArrow(_block_rows(length), blocks)
    else:
        # Contexts are cut out once; those of an anchor that is too frequent for a block are extended to the end at once, a digest per layer and window.
        around = checkpointed(around.join(often, F.col("h") == F.col("hot_h"), "left"))
        repeats = around.where("hot_h IS NULL").drop("hot_h").repartition("h").sortWithinPartitions("h").mapInArrow(_block_rows(length), blocks)
        windows = around.where("hot_h IS NOT NULL").drop("hot_h").mapInArrow(_window_rows(length), "h long, r int, d long, n byte, k long, c int, at int")
        twice = windows.groupBy("h", "r", "d").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("h").alias("h2"), F.col("r").alias("r2"), F.col("d").alias("d2"))
        counted = windows.where("n = 1").join(twice, (F.col("h") == F.col("h2")) & (F.col("r") == F.col("r2")) & (F.col("d") == F.col("d2")))
        repeats = repeats.unionByName(counted.groupBy("k", "c", "h", F.col("at") + F.col("r")).agg(F.min("at").alias("lo"), (F.max("at") + length).alias("hi")).select("k", "c", "lo", "hi"))
    spread = F.explode(F.filter("rows", lambda m: m["kind"] == COVERED)).alias("m")
    # A context may end with its text; spans beyond it are cut off below.
    covered = found.select("k", "c", spread).select("k", "c", F.greatest(F.col("m.pos") - (length - GRAM), F.lit(0)).alias("lo"), (F.col("m.pos") + F.col("m.more") + length).alias("hi"))
    spans = checkpointed(covered.unionByName(repeats).groupBy("k", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    inside = F.transform("spans", lambda s: F.struct(s["lo"].alias("lo"), F.least(s["hi"], F.octet_length("text")).alias("hi")))
    cut = moved(spans, spans).select("k", "c", "text", inside.alias("spans"))
    result = cut.mapInArrow(_kept_rows(with_kept), "k2 long, c2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    extra = ["kept"] * with_kept
    bits = bits_for(spans.count())
    checked = among(keyed, F.col("k"), key_filter(spans, F.col("k"), bits), "_in", bits).withColumn("_in", F.col("_in") & long)
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *[F.col("text").cast("binary").alias(x) for x in extra]]
    untouched = checked.where("NOT _in").select("doc_id", *whole)
    # What the filter lets pass in vain keeps its own hash.
    asked = checked.where("_in").select("doc_id", "k", "c", F.octet_length("text").cast("long").alias("n0"), F.sha2(F.col("text").cast("binary"), 256).alias("sha0"), *[F.col("text").cast("binary").alias(f"{x}0") for x in extra])
    met = asked.join(result, (F.col("k") == F.col("k2")) & (F.col("c") == F.col("c2")), "left")
    done = met.select("doc_id", F.col("n0").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha0").alias("kept_sha256"), *[F.coalesce(x, f"{x}0").alias(x) for x in extra])
    return done.unionByName(untouched)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
