"""The pipeline's stages and the whole of it against brute force on small tables, with columns whose names clash."""

from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from fixtures import documents, empty

from pathloom.llm import packing


def table(spark):
    docs = documents(spark, extra=True)
    near = spark.createDataFrame([(500 + i, " ".join(f"word{k}" for k in range(60) if k != 59 * i), "en", f"site{i}", 0) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    near = near.selectExpr("*", "doc_id AS shard", "text AS score", "1 AS h", "source AS pos")
    return docs.unionByName(near).selectExpr("*", "'kept' AS lang_pred", "7 AS lines_removed", "8 AS `_nd_id`", "9 AS size", "'a' AS root", "'b' AS slot", "'c' AS `_mx_key`")


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def said(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "pack_sequences"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        old, new = rows_of(before), rows_of(after)
        assert all(r["lang_pred"] == "kept" and r["lines_removed"] == 7 and r["_mx_key"] == "c" and r["shard"] == r["doc_id"] for r in new)
        if name == "language_id":
            assert said(new) == said(brute.lettered(old))
            given = {(r["doc_id"], r["text"]): r["lang"] for r in old}
            assert all(r["lang"] == (given[r["doc_id"], r["text"]] or r["lang"]) and r["lang"] in ("en", "fr") for r in new)
        if name == "line_dedup":
            assert said(new) == said(brute.without_boilerplate(old)) and said(new) != said(old)
        if name == "simhash_near_dedup":
            assert Counter(r["doc_id"] for r in new if r["doc_id"] is not None) == brute.one_of_each(old)
            assert sum(r["doc_id"] is None for r in new) == sum(r["doc_id"] is None for r in old) and len(new) < len(old) - 3
        if name == "mix_sources":
            assert said(new) == brute.mixed(old)
        before = after
    pieces = corpus_pipeline.pack_sequences(spark, before, str(tmp_path)).collect()
    lengths = Counter()
    for r in before.collect():
        lengths[r["doc_id"]] += len(packing.tokens(packing.default_tokenizer()).encode(r["text"] or "")) // 4 + 1
    got, places = Counter(), {}
    for r in pieces:
        got[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == lengths
    for own in places.values():
        at, n = np.array(sorted(own)).T
        assert at[0] == 0 and (at[1:] == np.cumsum(n)[:-1]).all() and n.sum() <= 1024
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(tuple(r)[:5] for r in pieces)


def test_without_labels_no_text_with_letters_goes(spark, tmp_path):
    docs = documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    found = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and said(rows_of(found)) == said(brute.lettered(rows_of(docs)))


def test_empty(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
