"""Fill-in-middle: texts cut at two units and written with sentinels, found by a byte automaton.

The automaton's state is how far a sentinel has come (`<`, `<P`, ...) and how many continuation bytes a character still lacks. In valid UTF-8
the state after a byte depends on the last four bytes alone, so a table of transitions is applied to all bytes of a batch at once: four look-ups from
the start state give the state before and after each byte. The scan counts transitions by block: those that begin a unit (a code point), and those that
complete a sentinel. The second pass finds the block that holds a cut by the counts of the blocks before it, and looks for the unit in that block alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches, unused

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block of the scan.
BLOCK = 4096
#: Bytes that decide a state.
REACH = 4


def _classes() -> np.ndarray:
    """The class of each byte: 0 other ASCII, 1 `<`, 2 `P`, `S` or `M`, 3 `>`, 4 continuation, 5 to 7 the first of two to four bytes."""
    out = np.zeros(256, dtype=np.uint8)
    out[ord("<")], out[ord(">")] = 1, 3
    out[[ord(c) for c in "PSM"]] = 2
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 4, 5, 6, 7
    return out


#: States: 0 nothing, 1 after `<`, 2 after `<` and a letter, 3 after a sentinel, 3 + k: k continuation bytes are missing.
STATES, KINDS, FOUND = 7, 8, 3


def _table() -> np.ndarray:
    """State x class -> state."""
    to = np.zeros((STATES, KINDS), dtype=np.uint8)
    for s in range(STATES):
        to[s, 1] = 1
        to[s, 2] = 2 if s == 1 else 0
        to[s, 3] = FOUND if s == 2 else 0
        to[s, 4] = s - 1 if s > 4 else 0
        to[s, 5:8] = 4, 5, 6
    return to


CLASS, TABLE = _classes(), _table()
#: Transitions are numbered state * KINDS + class; every byte but a continuation begins a unit.
BEGINS = np.tile(np.arange(KINDS) != 4, STATES)
COMPLETES = (TABLE == FOUND).ravel()


def transitions(data: np.ndarray) -> np.ndarray:
    """The number of the transition that each byte takes; data starts in state 0."""
    kind = CLASS[np.concatenate([np.full(REACH, ord(" "), dtype=np.uint8), data])]
    state = np.zeros(len(data), dtype=np.uint8)
    for back in range(REACH, 0, -1):
        state = TABLE[state, kind[REACH - back : len(kind) - back]]
    return state * np.uint8(KINDS) + kind[REACH:]


def scan(raw: bytes, block: int = BLOCK) -> tuple[np.ndarray, bool]:
    """The number of units that begin in each block of bytes, and whether there is a sentinel. One pass; a block starts from the bytes before it."""
    counts, marked = np.zeros(-(-len(raw) // block), dtype=np.int64), False
    data, step = np.frombuffer(raw, dtype=np.uint8), block * 256
    for at in range(0, len(raw), step):
        lead = min(at, REACH)
        taken = transitions(data[at - lead : at + step])[lead:]
        table = taken.astype(np.int64) + np.arange(len(taken)) // block * BEGINS.size
        by = np.bincount(table, minlength=-(-len(taken) // block) * BEGINS.size).reshape(-1, BEGINS.size)
        counts[at // block : at // block + len(by)] = by[:, BEGINS].sum(axis=1)
        marked = marked or bool(by[:, COMPLETES].any())
    return counts, marked


def place(raw: bytes, counts: np.ndarray, unit: int, block: int = BLOCK) -> int:
    """The byte where that unit begins, the end for the number of units; reads the block that holds it."""
    upto = counts.cumsum()
    if not len(upto) or unit >= upto[-1]:
        return len(raw)
    b = int(upto.searchsorted(unit, "right"))
    own = np.frombuffer(raw[b * block : (b + 1) * block], dtype=np.uint8)
    return b * block + int(np.flatnonzero(CLASS[own] != 4)[unit - (int(upto[b - 1]) if b else 0)])


def cut(raw: bytes, draws: tuple[int, int, int, int], made: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text: draws are four numbers that decide cuts and form."""
    counts, marked = scan(raw)
    n = int(counts.sum())
    if not raw or marked or draws[2] % 100 >= made:
        return n, "plain", None, None, raw
    one, two = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = place(raw, counts, one), place(raw, counts, two)
    parts = {PREFIX: raw[:a], MIDDLE: raw[a:b], SUFFIX: raw[b:]}
    spm = draws[3] % 100 < suffix_first
    order = (SUFFIX, PREFIX, MIDDLE) if spm else (PREFIX, SUFFIX, MIDDLE)
    return n, "spm" if spm else "psm", one, two - one, b"".join(x for mark in order for x in (mark, parts[mark]))


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's id, by SHA-256; rows without an id share one draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, made: int = 90, suffix_first: int = 20) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output; one row per row, no shuffle.

    `made` of 100 texts are cut, `suffix_first` of 100 of them with the suffix in front. Texts that hold a sentinel stay plain, so that every output can be
    undone; null texts count as empty and stay plain. Repeated rows get the same result. A row with a null id draws like any other row without one. Columns that
    docs has already keep their names; the new ones get underscores. An empty table gives no rows.
    """
    named = unused(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    raw, *h = unused([*docs.columns, *named], "_raw", "_h1", "_h2", "_h3", "_h4")
    kinds = [(k, k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64())] + [(pa.binary(), pa.string())]

    def run(batches):
        for b in batches:
            drawn = zip(*(b.column(x).to_pylist() for x in h), strict=True)
            rows = [cut(t, d, made, suffix_first) for t, d in zip(b.column(raw).to_pylist(), drawn, strict=True)]
            new = [pa.array([r[i] for r in rows], k).cast(as_, safe=False) for i, (k, as_) in enumerate(kinds)]
            kept = [x for x in b.schema.names if x != raw and x not in h]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *new], names=[*kept, *named])

    bound_batches(docs.sparkSession)
    rows = docs.withColumn(raw, F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).withColumns(dict(zip(h, draws(id_col, seed), strict=True)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} {t}" for n, t in zip(named, ("long", "string", "long", "long", "string"), strict=True))])
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: a text that was cut holds no sentinel of its own, so the three there are part it."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).withColumn("again", restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("again").cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
