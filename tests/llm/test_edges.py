"""Nulls, empty tables, repeated rows, very long texts, clashing names and odd settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isolayers.llm import common, embedding_dedup, mixing, near_copies, packing, quality_classifier, simhash_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(120_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd_docs(spark):
    return docs_of(spark, [(1, LONG, "a"), (2, None, None), (None, "one two", "a"), (3, "", "b"), (3, "", "b"), (4, "same words here", "b"), (5, "same words here", "b")])


def test_huge_and_tiny_components(spark):
    rows = [[1e200, 0.0], [2e200, 0.0], [1e-200, 0.0], [2e-310, 0.0], [0.0, 1e308], [0.0, 3e-320], [float("inf"), 0.0], [1e308, 1e308]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_embeddings_empty_repeated_and_floats(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [2.0, 4.0]), (8, None), (9, [])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_components(df).collect())
    assert got == [(0, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Thousands of pairs whose cosines lie close around 0.95."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((150, 64)), 12, axis=0) + rng.standard_normal((1800, 64)) * 0.05**0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = embedding_dedup.embedding_components(df).toPandas().set_index("vec_id")["n_links"].reindex(range(1800)).to_numpy()
    assert want.sum() > 5000 and (got <= want).all() and (want - got).sum() <= 1e-4 * want.sum() + 2


def test_near_copies_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(200))
    docs = docs_of(spark, [(3, a, "s"), (5, a, "s"), (5, b, "s"), (6, b + " end", "s"), (None, a, "s"), (5, b, "s")])
    got = sorted((r.doc_id or 0, r.text[0]) for r in near_copies.keep_one_of_each_group(docs).collect())
    assert got == [(0, "a"), (3, "a"), (5, "b"), (5, "b")]
    assert near_copies.keep_one_of_each_group(docs.limit(0)).count() == 0


def test_odd_rows_come_back_once_each(spark):
    docs = odd_docs(spark)
    assert mixing.mixed(docs, {"a": 0.5}).count() == packing.packed(docs).count() == simhash_dedup.simhash_components(docs).count() == 7
    assert substring_dedup.remove_repeats(docs).count() == quality_classifier.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 7
    places = [(r.bucket, r.batch, r.place) for r in packing.packed(docs).collect()]
    assert len(set(places)) == 7 and {r.n_tokens for r in packing.packed(docs).collect()} == {0, 2, 3, 120_000}
    got = {r.doc_id: r for r in simhash_dedup.simhash_components(docs).collect()}
    assert got[2].component_id == got[3].component_id == 2 and got[4].component_id == got[5].component_id == 4 and got[None].component_id is None
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}[1] == 0


def test_clashing_names_are_kept(spark):
    clash = {"n_words": -1, "n_removed": -2, "score": -7, "predicted": -3, "held_out": -4, "slot": -5, "block": -6, "_source": -8, "key": -9, "row": -10, "first_out": -11, "a.b": -12}
    docs = docs_of(spark, [(i, f"text number {i} " * 20, "s") for i in range(4)]).withColumns({k: F.lit(v) for k, v in clash.items() if "." not in k}).withColumn("a.b", F.lit(-12))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for found, new in (
        (mixing.mixed(docs, {"s": 0.5}), {"block", "place", "slot", "first_out"}),
        (quality_classifier.scored(docs, labels), {"held_out", "score", "predicted"}),
        (substring_dedup.remove_repeats(docs), {"n_words", "n_removed", "kept_sha256"}),
    ):
        rows = [r.asDict() for r in found.collect()]
        assert len(rows) == 4
        for r in rows:
            for k, v in clash.items():
                assert r[k + "_input" if k in new else k] == v
            assert all(r[k] != clash.get(k) for k in new)
        assert common.as_given(found, docs).columns == docs.columns
    got = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert {r.score for r in got.collect()} <= {-7} and got.columns == docs.columns
    assert {r.slot for r in corpus_pipeline.mixing(spark, docs, "").collect()} == {-5}
    assert {r.n_words for r in corpus_pipeline.substrings(spark, docs, "").collect()} <= {-1}
    assert {r.slot for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {-5}


def test_repeated_labels_and_rows_give_one_fit(spark):
    docs = docs_of(spark, [(i, f"good words {i} " * 5 if i % 2 else "BAD 123 $$$ " * 5, "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in quality_classifier.scored(docs, labels).collect()}
    twice = quality_classifier.scored(docs.union(docs).repartition(5), labels.union(labels).repartition(3)).collect()
    assert len(twice) == 80 and all(r.score == once[r.doc_id] for r in twice)


def test_pipeline_on_empty_and_odd_documents(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", [(1, LONG, "a"), (2, None, None), (None, "one two", "a"), (3, "", "b"), (3, "", "b")])):
        d = tmp_path / name
        docs_of(spark, rows).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(d)).collect()]
        # the two empty texts are copies of the null one; all scores are 0.5
        assert sorted(got, key=str) == ([1, 2, None] if rows else [])


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.hot_join(rows, facts, "k", "n", F.col("id"), 3000)
    assert got.count() == got.select("id").distinct().count() == 3000 and got.where("k = 'hot' AND n != 1000").count() == 0
    assert sorted(got.columns) == ["id", "k", "n"]


def test_folder_must_be_shared_off_local_mode(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session())


@pytest.mark.parametrize("piece", [" ", "a  ", "<", "<!--", "<script>", "<a ", "&a"])
def test_ten_million_odd_characters_take_seconds(spark, piece):
    import time

    from isolayers.llm import language_id, url_filter

    text = piece * (10_000_000 // len(piece))
    df = spark.createDataFrame([(1, "x" + text + "y")], "doc_id long, text string")
    start = time.time()
    want = len([w for w in ("x" + text + "y").replace("\t", " ").split(" ") if w])
    assert df.select(packing.n_words("text").alias("n")).first().n == want
    df.select(F.length(F.regexp_replace("text", url_filter.MARKUP, " "))).collect()
    language_id._MARKUP.sub(b" ", text.encode())
    assert time.time() - start < 20


def test_trigrams_of_a_long_page_in_stretches():
    from isolayers.llm import language_id

    text = ("Über words " * 100_000).encode()
    parts = list(language_id.stretches(text))
    assert len(parts) > 3 and max(map(len, parts)) <= language_id.STRETCH
    step, language_id.STRETCH = language_id.STRETCH, 1 << 30
    try:
        whole = np.concatenate(list(language_id.stretches(text)))
    finally:
        language_id.STRETCH = step
    assert (np.concatenate(parts) == whole).all()


def test_planted_copies_at_graded_similarity(spark):
    """400 texts, each with a copy of which up to 6 % of the words are changed: by exact Jaccard, what reaches 0.8 goes and the rest stays."""
    rng = np.random.default_rng(23)
    texts, similarity = {}, {}
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 20_000, rng.integers(60, 400))]
        edited = [f"e{rng.integers(0, 20_000)}" if rng.random() < i / 400 * 0.06 else w for w in words]
        a, b = shingles(words), shingles(edited)
        texts[2 * i], texts[2 * i + 1], similarity[2 * i + 1] = " ".join(words), " ".join(edited), len(a & b) / len(a | b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.keep_one_of_each_group(docs).select("doc_id").collect()}
    near = {d for d, s in similarity.items() if s >= 0.8}
    edge = {d for d in near if similarity[d] < 0.9}
    print("near", len(near), "caught", len(near - kept), "0.8 to 0.9", len(edge), "caught", len(edge - kept), "below", 400 - len(near))
    assert len(edge) > 60 and 400 - len(near) > 60
    assert len(near - kept) >= 0.98 * len(near)
    assert kept >= set(texts) - near
