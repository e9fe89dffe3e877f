"""Language identification by words first, backing off to shorter character n-grams.

The model holds, per language, log frequencies of the words and of the character n-grams of length 4 to 1 in a sample of labelled
rows. A word of a text that any language knows scores by its log frequency in each; any other word scores by its longest n-grams
that are known, or nothing. A text's language has the largest sum; the score is its share after a softmax.

What the languages know is kept sparse: an entry's row names only the languages that have it, all others score the floor of its table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches, unused
from pathloom.functions.lineage import checkpointed

LETTERS = regex.compile(r"\p{L}+")
LONGEST = 4
#: Labelled rows of a language that train, about, and entries (each in each language that has it) that a model has at most.
SAMPLE = 3_000
ENTRIES = 2_000_000
#: Bytes of scores, and words, that a worker remembers before it starts anew; words that are scored or added at a time.
REMEMBERED, WORDS = 8 << 20, 100_000
STEP = 4_096
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_keys(words: list[str]) -> np.ndarray:
    """Keys of words: XXH64 with seed 42, as xxhash64 gives it."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words), dtype=np.uint64, count=len(words))


def gram_keys(text: str, n: int) -> np.ndarray:
    """Keys of the n-grams at every place of a text, from their code points; they differ from n to n."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    count = max(0, len(codes) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ codes[k : k + count]) * MIX
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """langs; keys, ascending, whose entry i has the languages lang[first[i] : first[i + 1]] with the gains there; floor: of each table and language."""

    langs: list[str]
    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray
    _seen: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    @classmethod
    def of(cls, langs: list[str], keys: np.ndarray, lang: np.ndarray, gain: np.ndarray, floor: np.ndarray) -> Model:
        """From one row per entry and language, in any order."""
        order = np.lexsort((lang, keys))
        keys = keys[order]
        own, first = np.unique(keys, return_index=True)
        return cls(langs, own, np.append(first, len(keys)).astype(np.int64), lang[order].astype(np.int32), gain[order].astype(np.float32), floor)

    def _add(self, out: np.ndarray, to: np.ndarray, at: np.ndarray) -> None:
        """Adds the gains of the entries `at` to the rows `to`."""
        size = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        np.add.at(out, (np.repeat(to, size), self.lang[place]), self.gain[place])

    def _find(self, asked: np.ndarray) -> np.ndarray:
        """Places of the entries, -1 where there is none."""
        if not len(self.keys) or not len(asked):
            return np.full(len(asked), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores per word: its own where it is known, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        at = self._find(word_keys(words))
        known = np.nonzero(at >= 0)[0]
        out[known] = self.floor[0]
        self._add(out, known, at[known])
        left = np.nonzero(at < 0)[0]
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            padded = [f" {words[i]} " for i in left.tolist()]
            sizes = np.array([len(w) for w in padded])
            # Places whose n-gram lies within one word.
            owner = np.repeat(left, sizes)
            inside = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner)) >= n
            distinct, place = np.unique(gram_keys("".join(padded), n)[inside[: len(owner) - n + 1]], return_inverse=True)
            owner, at = owner[: len(owner) - n + 1][inside[: len(owner) - n + 1]], self._find(distinct)[place]
            owner, at = owner[at >= 0], at[at >= 0]
            size = np.bincount(owner, minlength=len(words))
            self._add(out, owner, at)
            hit = np.nonzero(size)[0]
            out[hit] = out[hit] / size[hit, None] + self.floor[n]
            left = left[size[left] == 0]
        return out

    def _learn(self, tokens: set[str]) -> None:
        """Scores the tokens that are not remembered yet: a token's score is that of its words, and nan if it has none."""
        if self._rows is None or len(self._seen) > WORDS or len(self._seen) * 8 * len(self.langs) > REMEMBERED:
            self._seen, self._rows = {}, np.zeros((STEP, len(self.langs)))
        new = [t for t in tokens if t not in self._seen]
        start, end = len(self._seen), len(self._seen) + len(new)
        if end > len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros((max(end - len(self._rows), len(self._rows)), len(self.langs)))])
        for at in range(0, len(new), STEP):
            part = new[at : at + STEP]
            words = [[x] if (x := t.lower()).isalpha() else LETTERS.findall(x) for t in part]
            owner = np.repeat(np.arange(len(part)), [len(x) for x in words])
            sums = np.zeros((len(part), len(self.langs)))
            np.add.at(sums, owner, self.score([w for own in words for w in own]))
            self._rows[start + at : start + at + len(part)] = np.where(np.bincount(owner, minlength=len(part))[:, None] > 0, sums, np.nan)
        self._seen.update(zip(new, range(start, end), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. No word crosses a blank, so blanks cut a text into tokens that are remembered."""
        said = [(t or "").split() for t in texts]
        if self.langs:
            self._learn({t for own in said for t in own})
        return [self._predict(own) for own in said]

    def _predict(self, tokens: list[str]) -> tuple[str, float]:
        sums, lettered = np.zeros(len(self.langs)), False
        at = np.fromiter(map(self._seen.__getitem__, tokens), dtype=np.int64, count=len(tokens)) if self.langs else sums
        for k in range(0, len(at), STEP):
            rows = self._rows[at[k : k + STEP]]
            has = ~np.isnan(rows[:, 0])
            lettered = lettered or bool(has.any())
            sums += rows[has].sum(axis=0)
        if not lettered:
            return "und", 0.0
        best = int(sums.argmax())
        return self.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def _ngrams(n: int):
    return F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, F.lit(n)))


def _counted(drawn: DataFrame) -> DataFrame:
    """lang, k (0: words, else the n-gram's length), g, n of drawn(lang, text)."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = checkpointed(drawn.select("lang", word).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    grams = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    pieces = [_ngrams(k) for k in range(1, LONGEST)]
    longest = F.when(F.length("w") >= LONGEST, _ngrams(LONGEST)).otherwise(F.array().cast("array<string>"))
    grams = grams.select("lang", "n", F.explode(F.concat(*pieces, longest)).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("k"), F.col("word").alias("g"), "n").unionByName(grams.select("lang", F.length("g").alias("k"), "g", "n"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model from about `sample` labelled rows of each language (all, if there are no more), drawn by a hash of id and text.

    Rows with a null text or language train nothing. All words, however long, and all n-grams of the drawn rows count. The model is bounded by `entries`,
    at 16 bytes each: if the drawn rows have more, half of them are drawn, and so on. No labelled rows: a model that answers "und" alone.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # A row per language; the model has a column for each.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model.of([], np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros((LONGEST + 1, 0)))
    place = F.pmod(F.xxhash64(F.lit("lang"), "id", "text"), F.lit(1 << 30))
    while True:
        shares = labelled.sparkSession.createDataFrame([(x, i, min(1 << 30, -(-(sample << 30) // sizes[x]))) for i, x in enumerate(langs)], "lang string, no int, share long")
        drawn = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select(F.col("no").alias("lang"), "text")
        both = checkpointed(_counted(drawn))
        totals = {(r["lang"], r["k"]): (r["t"], r["d"]) for r in both.groupBy("lang", "k").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).collect()}
        if sum(d for _, d in totals.values()) <= entries or sample == 1:
            break
        sample = max(1, sample // 2)
    found = both.select("k", F.when(F.col("k") > 0, F.col("g")).alias("g"), F.xxhash64("g").alias("key"), "lang", "n").toArrow()
    kind, key, lang, n = (found.column(c).to_numpy() for c in ("k", "key", "lang", "n"))
    key = key.view(np.uint64).copy()
    for k in range(1, LONGEST + 1):
        own = kind == k
        key[own] = gram_keys("".join(found.column("g").filter(pa.array(own)).to_pylist()), k)[::k]
    # Add-a-half smoothing; a missing entry has the frequency of a half.
    parts = np.array([[totals.get((i, k), (0, 0)) for i in range(len(langs))] for k in range(LONGEST + 1)], dtype=float)
    floor = np.log(0.5 / (parts[..., 0] + 0.5 * parts[..., 1] + 1))
    return Model.of(langs, key, lang, np.log(2 * n.astype(np.float64) + 1), floor)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, and under `names` the language and its score (0 to 1), for every row of docs, from its whole text alone.

    A text that is null or has no letter is "und" with score 0. The model, of bounded size, is broadcast. Columns of `keep` may have any
    name; where one has a name of `names`, the new column's name gets an underscore.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.keys, model.first, model.lang, model.gain, model.floor))
    carried = [f"_k{i}" for i in range(len(keep))]

    def run(batches):
        own = Model(*sent.value)
        for b in batches:
            said = own.predict(b.column("_text").to_pylist())
            new = [pa.array([x for x, _ in said], pa.string()), pa.array([min(1.0, x) for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *new], names=[*carried, "_lang", "_score"])

    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, carried, strict=True)], F.col(text_col).alias("_text"))
    kept = "".join(f"`{x}` {rows.schema[x].dataType.simpleString()}, " for x in carried)
    return rows.mapInArrow(run, f"{kept}_lang string, _score double").toDF(*keep, *unused(keep, *names))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
