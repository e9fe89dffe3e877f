"""Source divergence audit: how differently the sources of a language use its vocabulary.

Pass one counts exactly in how many documents of its language each term occurs, and keeps frequent terms. Pass two recounts their occurrences with
Aho-Corasick automata over terms padded with a delimiter on both sides, so that only whole terms match. An automaton holds a unit of the vocabulary of bounded size; a
document is read once for each unit that has terms of its language. Counts stay sparse: a pair of sources needs, beyond the terms that both have, only
how many terms a source has of each count. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.lineage import checkpointed
from pathloom.functions.ranking import buckets_for, running_total

#: Entries that a task holds before it hands its partial counts on.
HELD = 400_000
#: Matches that a task holds, at 4 bytes each, before it counts them and hands the counts on.
HELD_MATCHES = 1 << 22
#: Rows of a batch of them.
SENT = 1 << 17
#: Bytes of terms, 16 for each term besides, in one automaton.
UNIT_BYTES = 8 << 20
#: Postings of a block of terms whose pairs of sources are counted together.
BLOCK = 1 << 15
SCALE = 1_000_000_000
#: Bytes to term bytes: ASCII letters in lower case, bytes of other characters as they are, anything else a blank.
TERMS = bytes(c if c > 0x7F or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))


def _grouped(batch: pa.RecordBatch, keys: tuple[str, ...]) -> dict[tuple, list[bytes]]:
    """The texts of a batch in term bytes, by group."""
    out = defaultdict(list)
    for *key, raw in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("raw").to_pylist(), strict=True):
        out[tuple(key)].append(raw.translate(TERMS))
    return out


def _handed(held: dict[tuple, Counter], names: tuple[str, ...]) -> pa.RecordBatch:
    """One row for each key and term with its count; the held counts are emptied."""
    columns = [[] for _ in names]
    for key, counts in held.items():
        for i, k in enumerate(key):
            columns[i] += [k] * len(counts)
        columns[-2] += [t.decode("utf-8", "replace") for t in counts]
        columns[-1] += counts.values()
    held.clear()
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.int64())], names=list(names))


def document_frequencies(texts: DataFrame, least: int) -> DataFrame:
    """lang, term, df: terms in at least `least` documents of the language, counted exactly; partial counts come from the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)
        for b in batches:
            for key, said in _grouped(b, ("lang",)).items():
                for text in said:
                    held[key].update(set(text.split()))
            if sum(map(len, held.values())) > HELD:
                yield _handed(held, ("lang", "term", "n"))
        yield _handed(held, ("lang", "term", "n"))

    bound_batches(texts.sparkSession)
    return texts.select("lang", "raw").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def _units(kept: DataFrame, rows: int, size: int) -> DataFrame:
    """kept(lang, term, df) with `unit`: consecutive units of at most `size` bytes and one term, a language's terms in as few units as that allows."""
    order = F.shiftleft(F.hash("lang").cast("long"), 32).bitwiseOR(F.hash("term").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    placed = running_total(kept.withColumn("_all", F.lit(0)), ["_all"], order, ["lang", "term"], F.octet_length("term") + 16, "_at", buckets_for(rows))
    return placed.select("lang", "term", "df", F.floor(F.col("_at") / size).cast("long").alias("unit"))


_automata: dict = {}


def _automaton(terms: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """Matches each term between blanks, whose number is the value. A node tries its branches in the order of the list, so frequent terms come first."""
    made = ahocorasick.Automaton()
    for t, i in terms:
        made.add_word(f" {t} ", i)
    made.make_automaton()
    return made


def occurrences(texts: DataFrame, kept: DataFrame, size: int = UNIT_BYTES) -> DataFrame:
    """lang, source, term, n: how often each kept(lang, term) occurs in each group, where it does. One pass over the texts of a unit's languages per unit of the vocabulary.

    Tasks count a unit's terms by their numbers, which name the language too; the terms are joined to the sums.
    """
    spark, rows = texts.sparkSession, kept.count()
    # A unit's terms are ranked in one task, which holds no more of them than an automaton does.
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("lang", F.desc("df"), "term"))
    units = checkpointed(_units(kept, rows, size).withColumn("_i", nth - 1))
    last = units.agg(F.max("unit")).first()[0]
    found = [spark.createDataFrame([], "lang string, source string, term string, n long")]
    for u in range(0 if last is None else last + 1):
        # At most `size` bytes: what one automaton holds.
        terms = units.where(F.col("unit") == u).select("lang", "term", "_i").orderBy("_i").collect()
        if not terms:
            continue
        vocabulary: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for r in terms:
            vocabulary[r["lang"]].append((r["term"], r["_i"]))
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, dict(vocabulary)))
        one = texts.where(F.col("lang").isin(list(vocabulary))).mapInArrow(_recount(sent), "source string, i int, k long")
        # Tasks have combined their counts, so rows move as they are, and the terms meet the sums where these lie.
        summed = one.repartition("i").groupBy("source", "i").agg(F.sum("k").alias("n"))
        named = units.where(F.col("unit") == u).select("lang", "term", "_i").hint("merge")
        found.append(checkpointed(summed.join(named, F.col("i") == F.col("_i")).select("lang", "source", "term", "n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _recount(sent):
    """Partial counts of a task: source, number of a term, count. A Python worker builds a unit's automata once and forgets those of other units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, vocabulary = sent.value
        if _automata.get("unit") != unit:
            _automata.clear()
            _automata["unit"] = unit
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            sources, numbers, counts = [pa.array([], pa.string())], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for source, met in held.items():
                i, k = np.unique(np.concatenate(met), return_counts=True)
                sources.append(pa.repeat(pa.scalar(source, pa.string()), len(i)))
                numbers.append(i)
                counts.append(k)
            held.clear()
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays(sources), pa.array(np.concatenate(numbers)), pa.array(np.concatenate(counts))], names=["source", "i", "k"])
            for at in range(0, rows.num_rows, SENT):
                yield rows.slice(at, SENT)

        for b in batches:
            for (lang, source), said in _grouped(b, ("lang", "source")).items():
                if lang not in _automata:
                    _automata[lang] = _automaton(vocabulary[lang])
                # A blank between any two terms and at the ends; terms hold none, so nothing matches across documents.
                text = b" ".join([b"", *said, b""]).decode("utf-8", "replace")
                met = np.fromiter(map(itemgetter(1), _automata[lang].iter(text)), np.int32)
                held[source].append(met)
                size += len(met)
            if size > HELD_MATCHES:
                yield from handed()
                size = 0
        yield from handed()

    return run


def _share(count: str, total: str) -> Column:
    """1 + the whole part of SCALE * (count + 2) / total, by whole-number division of decimals, so counts of any size stay exact."""
    return F.expr(f"1 + ((cast({count} AS decimal(19, 0)) + 2) * {SCALE}) div cast({total} AS decimal(19, 0))")


def _distance(p: str, q: str) -> Column:
    """The whole part of (p - q)^2 / (p + q); shares are at most SCALE + 1, so squares fit a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _meetings(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block of terms (source, term, p, none): for each pair of sources a < b that share terms their number, and what the shared terms add to the sums that count each
    source's terms against none of the other's. Terms are runs; a posting meets the later ones of its run, so many at a time."""
    names, s = np.unique(rows["source"].to_numpy(dtype=object), return_inverse=True)
    term = pd.factorize(rows["term"])[0]
    order = np.lexsort((s, term))
    s, term, p, none = s[order], term[order], rows["p"].to_numpy()[order], rows["none"].to_numpy()[order]
    mates = term.searchsorted(term, "right") - np.arange(len(term)) - 1
    upto, at, out = mates.cumsum(), 0, []
    far = lambda x, y: (x - y) * (x - y) // (x + y)
    while at < len(term):
        end = max(at + 1, int(upto.searchsorted((upto[at - 1] if at else 0) + (1 << 20), "right")))
        n = mates[at:end]
        a = np.repeat(np.arange(at, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(n.cumsum() - n, n)
        more = far(p[a], p[b]) - far(p[a], none[b]) - far(none[a], p[b])
        out.append(pd.DataFrame({"x": s[a], "y": s[b], "shared": 1, "more": more}).groupby(["x", "y"], as_index=False).sum())
        at = end
    met = pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "shared": [], "more": []}, dtype="int64")
    return pd.DataFrame({"lang": key[0], "a": names[met["x"].to_numpy(dtype="int64")], "b": names[met["y"].to_numpy(dtype="int64")], "shared": met["shared"], "more": met["more"]})


#: Groups of which a table may be broadcast.
FEW_GROUPS = 20_000


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from every other one (part pair), and its `top` terms above the language's share (part term).

    Terms are runs of ASCII letters and characters beyond ASCII, in lower case for A to Z. A language keeps the V terms of at least `least` of its documents. A group (lang, source) and a
    language give each kept term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Two shares are floor((p - q)^2 / (p + q)) apart; a pair's value is the sum over
    all kept terms, 0 where there are none. Ranks go by value, the largest first, then by item. Null texts, languages and sources count as empty ones. A repeated row counts each
    time, as a document of its own. A source alone in its language has no pairs; an empty table gives no rows. Other columns do not matter.
    """
    texts = _texts(docs, text_col, lang_col, source_col)
    kept = checkpointed(document_frequencies(texts, least))
    counts = checkpointed(occurrences(texts, kept, unit_bytes))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    said = counts.groupBy("lang", "source").agg(F.sum("n").alias("said"), F.count(F.lit(1)).alias("own"))
    groups = texts.select("lang", "source").distinct().join(said, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("said", "own", "v")])
    groups = checkpointed(groups.withColumn("total", F.col("said") + 2 * F.col("v")).withColumn("none", F.when(F.col("v") > 0, _share("0", "total")).otherwise(F.lit(1))))
    few = groups.count() <= FEW_GROUPS
    near = lambda t: F.broadcast(t) if few else t
    shares = checkpointed(counts.join(near(groups.select("lang", "source", "total", "none")), ["lang", "source"]).withColumn("p", _share("n", "total")).drop("total"))
    blocks = buckets_for(shares.count(), BLOCK)

    met = shares.withColumn("block", F.pmod(F.hash("term"), F.lit(blocks))).groupBy("lang", "block").applyInPandas(_meetings, "lang string, a string, b string, shared long, more long").groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"), F.sum("more").alias("more"))
    # A source's terms against none of another's: terms with the same share count together.
    alike = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q"))
    alone = alike.join(near(other), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _distance("p", "q")).alias("sum"))
    pairs = groups.alias("g").join(near(groups).alias("h"), "lang").where("g.source < h.source").select("lang", F.col("g.source").alias("a"), F.col("h.source").alias("b"), F.expr("g.v - g.own - h.own").alias("rest"), F.col("g.none").alias("p"), F.col("h.none").alias("q"))
    both = alone.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), "sum").groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = zero("sum") + zero("more") + (F.col("rest") + zero("shared")) * _distance("p", "q")
    valued = pairs.join(both, ["lang", "a", "b"], "left").join(met, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value"))
    sides = valued.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value").withColumn("part", F.lit("pair"))

    by_term = Window.partitionBy("lang", "term")
    whole = groups.groupBy("lang").agg(F.sum("said").alias("all_said"), F.max("v").alias("v")).select("lang", (F.col("all_said") + 2 * F.col("v")).alias("all_total"))
    told = shares.withColumn("all_n", F.sum("n").over(by_term)).join(near(whole), "lang").withColumn("q", _share("all_n", "all_total")).where("p > q")
    terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    best = terms.withColumn("rank", place).where(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return sides.withColumn("rank", place).select(*columns).unionByName(best.select(*columns))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY lang, term),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10"""
