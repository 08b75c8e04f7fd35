"""The pipeline over a small folder: stages take effect, clean documents stay."""

from __future__ import annotations

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n)) + "."
    item = prose(30)
    clean = ["\n".join(prose(40) for _ in range(3)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(80).split()) for _ in range(30)]
    near = clean[0].replace(clean[0].split()[5], "zz")
    texts = clean + junk + [clean[1], near, prose(40) + " " + item[: len(item) // 2], clean[2].split("\n")[0] + "\n" + prose(50)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= kept, "clean documents stay"
    assert not kept & {90, 91, 92}, "the copy, the near copy and the contaminated document go"
    assert 93 in kept and len(kept & set(range(60, 90))) <= 2
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_with_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, clashing columns, empty tables: each stage gives its columns."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n)) + "."
    text, other = prose(60), prose(60)
    rows = [(1, text), (1, text), (1, other), (2, text), (None, prose(40)), (None, None), (3, None), (4, ""), (5, " \n\n "), (6, "x" * 30000), (7, other + "\n" + prose(30))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, text_hash string, n_removed string, again string"
    docs = spark.createDataFrame([(k, t, None, None, None, "c", "c", "c", "c") for k, t in rows], schema)
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, prose(30)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == corpus_pipeline.COLUMNS, name
        kept = got.collect()
        assert sum(r["doc_id"] is None for r in kept) == 2 and {3, 4} <= {r["doc_id"] for r in kept}, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).where("doc_id < 3").collect())
    assert kept == sorted([(1, text), (1, other)]), "one of the equal rows, and the other text of the same id"
