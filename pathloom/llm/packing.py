"""Packing token sequences by cutting-stock column generation.

Documents are tokenised once and cut at every `capacity` ids; what is packed is a table of pieces. The histogram of piece
lengths (those over `fine` ids rounded up to multiples of `grain`, so at most fine + capacity / grain numbers) defines a cutting-stock linear program. Its
columns are patterns, the multisets of lengths that fit one sequence; a knapsack dynamic program over the dual prices
finds the next column until none improves. Patterns are used as often as the rounded-down solution says, what remains is
filled from the largest piece down, each sequence as full as it gets. Pieces, ranked within their length, take the places of the patterns in order.
"""

from __future__ import annotations

import json
import os
import warnings
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.lineage import checkpointed
from pathloom.functions.ranking import buckets_for, dense_rank_in

CAPACITY = 1024
#: Lengths of at most FINE ids are packed as they are, longer ones rounded up to the next multiple of GRAIN.
GRAIN = 4
FINE = 64
END = 0
#: Fixed value: the pattern of pre-tokens of byte-level BPE.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes: those of tokenizers with add_special_tokens=False, so the string of an added token has its id.

    The file is a `tokenizers` JSON file. If it is plain byte-level BPE whose ids ascend as its merges do, its own vocabulary runs in
    tiktoken, which merges the same pairs in the same order, faster. Texts with an added token's string, and any other file, run in tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        special = {x["content"] for x in spec["added_tokens"]}
        self.path, self.special, self.whole = path, tuple(special), None
        letters = _byte_letters()
        merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "", 1) for x in model.get("merges", ())]
        ids = [model["vocab"].get(x, -1) for x in merged]
        same = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"] and ids == sorted(ids)
        same = same and all(x is None or x is False or x == "" for x in (model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        if same:
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = lambda text: self.slow(text) if any(x in text for x in self.special) else fast(text)
        else:
            self.ids = self.slow

    def slow(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u4").tobytes()


@cache
def tokens(path: str) -> Tokens:
    """One per worker process."""
    return Tokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids: every text and a final id 0, cut at every `capacity` ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    closing = np.array([END], dtype="<u4").tobytes()

    def run(batches):
        own = tokens(tokenizer or default_tokenizer())
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                raw = own.encode(t or "") + closing
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    piece = raw[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity with the highest price, by dynamic programming over the capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, paid = sizes[order], prices[order]
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        k = int(np.searchsorted(small, c, side="right"))
        if k:
            gain = paid[:k] + value[c - small[:k]]
            i = int(gain.argmax())
            if gain[i] > value[c] + 1e-12:
                value[c], choice[c] = gain[i], order[i]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), pattern


def _fullest(size: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest piece that is left and, with it, pieces that fill the sequence most, as far as pieces are left."""
    order = [int(i) for i in np.argsort(-size) if left[i] > 0]
    column = np.zeros(len(size), dtype=np.int64)
    column[order[0]] = 1
    room = capacity - int(size[order[0]])
    mask, sums = (1 << (room + 1)) - 1, [1]  # bit k: a sum of k can be reached with the sizes so far
    for i in order:
        reached, k = sums[-1], min(int(left[i]) - int(column[i]), room // int(size[i]))
        step = 1
        while k > 0:
            reached |= reached << (int(size[i]) * min(step, k)) & mask
            k -= step
            step *= 2
        sums.append(reached)
    total = sums[-1].bit_length() - 1
    for at in range(len(order), 0, -1):
        i = order[at - 1]
        while not sums[at - 1] >> total & 1:
            total -= int(size[i])
            column[i] += 1
    return column


def cutting_stock(sizes: list[int], counts: list[int], capacity: int, gap: float = 5e-4, most: int = 5_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each size) and how often each is used; together they hold exactly counts[i] pieces of sizes[i].

    Column generation with a dense basis inverse. It ends at the optimum, when the price bound shows that the
    solution is within `gap` of it; the result is whole in each case. Should `most` columns not do, it says so in a warning and uses what it has.
    """
    if not sizes:
        return []
    size, need = np.array(sizes, dtype=np.int64), np.array(counts, dtype=np.int64)
    m = len(size)
    # The first basis: the fullest pattern around the largest length that is left, as often as its scarcest length
    # allows. Each pattern uses one length up, which later ones lack, so the basis is triangular.
    columns, x = [np.where(np.arange(m) == i, capacity // size[i], 0) for i in range(m)], np.zeros(m)
    rest, order = need.astype(float), []
    while (rest > 0).any():
        column = _fullest(size, np.where(rest > 0, capacity // size, 0), capacity)
        ratio = np.where(column > 0, rest / np.maximum(column, 1), np.inf)
        out = int(ratio.argmin())
        columns[out], x[out] = column, ratio[out]
        rest = np.maximum(rest - ratio[out] * column, 0)
        rest[out] = 0
        order.append(out)
    order += sorted(set(range(m)) - set(order))
    basis, inverse = np.array(columns, dtype=float).T, np.zeros((m, m))
    for j, row in enumerate(order):
        unit = (np.arange(m) == row) - basis[row, order[:j]] @ inverse[order[:j]]
        inverse[row] = unit / basis[row, row]
    floor = float((size * need).sum()) / capacity
    for _ in range(most):
        prices = inverse.sum(axis=0)
        best, pattern = _best_pattern(size, prices, capacity)
        total = x.sum()
        if best <= 1 + 1e-9 or total - max(total / best, floor) <= gap * total:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out] if np.isfinite(ratio[out]) else 0
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out] = pattern
    else:
        warnings.warn(f"{most} columns leave the packing within {1 - floor / x.sum():.4f} of the least number of sequences", stacklevel=2)
    left, used = need.copy(), []
    for column, times in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        held = column > 0
        times = min(int(times + 1e-6), int((left[held] // column[held]).min()))
        if times > 0:
            used.append((column, times))
            left = left - times * column
    while left.any():
        column = _fullest(size, left, capacity)
        held = column > 0
        times = int((left[held] // column[held]).min())
        used.append((column, times))
        left = left - times * column
    return used


def _places(sizes: list[int], used: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Blocks of ranks of a bin: key = bin << 40 | first rank, and the sequences that the block's pieces go to."""
    rows, first, seq = [], dict.fromkeys(sizes, 0), 0
    for column, times in used:
        place = 0
        for i in np.nonzero(column)[0]:
            b, per = sizes[i], int(column[i])
            rows.append((b << 40 | first[b], seq, per, place))
            first[b] += per * times
            place += per
        seq += times
    rows.sort()
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(("key", "seq", "per", "place"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, fine: int = FINE) -> DataFrame:
    """All columns of pieces(doc_id, start, length, ...) plus sequence_id, offset: no sequence holds more than `capacity` ids.

    length is 1 to capacity. Pieces alike in doc_id and start are interchangeable. The plan has a row per pattern and length, a
    number bounded by the bins, and is broadcast. An empty table gives no rows.
    """
    sc = pieces.sparkSession.sparkContext
    size = F.when(F.col("length") <= fine, F.col("length")).otherwise(F.least(F.ceil(F.col("length") / grain) * grain, F.lit(capacity)))
    binned = checkpointed(pieces.withColumn("_bin", size.cast("int")))
    histogram = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = sorted(histogram)
    names = list(pieces.columns)
    plan = sc.broadcast(_places(sizes, cutting_stock(sizes, [histogram[b] for b in sizes], capacity)))

    def run(batches):
        p = plan.value
        for b in batches:
            rank = b.column("_rank").to_numpy()
            key = (b.column("_bin").to_numpy().astype(np.int64) << 40) | rank
            i = np.searchsorted(p["key"], key, side="right") - 1
            nth = key - p["key"][i]
            extra = [pa.array(p["seq"][i] + nth // p["per"][i]), pa.array(p["place"][i] + nth % p["per"][i])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *extra], names=[*names, "sequence_id", "_place"])

    ranked = dense_rank_in(binned, ["_bin"], F.xxhash64("doc_id", "start"), ["doc_id", "start"], "_rank", buckets_for(max(histogram.values(), default=0)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.select(*names, "_bin", "_rank").mapInArrow(run, f"{kept}, sequence_id long, _place long")
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_place")


def op4_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
