import corpus_pipeline


def test_stages_keep_what_they_promise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = corpus_pipeline.checkpointed(docs)
        seen.append(docs.count())
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert seen[0] >= seen[1] == seen[2] >= seen[3] <= seen[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    last = max(by)
    for sequence, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or sequence == last


def test_quality_agrees_with_its_operator(spark, sf):
    from tesela.llm import crf

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in crf.quality_scores(docs, crf.fit(docs, labels)).filter("score >= 0.5").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == want


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_near_copies_from_a_similarity_of_eight_tenths_on_go(spark, sf):
    """Before, the stage's threshold was 0.85."""
    base = [f"word{i}" for i in range(54)]
    other = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(base))
    # 50 shingles each: one word changed leaves 45 of 55 (0.818), two apart leave 40 of 60.
    rows = [(1, other(), "en", "a", 1), (2, other(27), "en", "b", 1), (3, other(10, 40), "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3]


def test_odd_rows_have_defined_results(spark, sf):
    """Nulls, repeats, several texts of one doc_id, very long texts and clashing names in every stage."""
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (1, text, "de", "b", 8), (1, "quite another text of that id, with words.", "en", "a", 1), (2, text, "en", "c", 9), (None, text, None, None, None), (3, None, None, "a", None), (4, "", "en", None, 0), (5, "long line of words here. " * 40_000, "en", "a", 1), (6, " \n ", "en", "a", 3)]
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        if name == "line_dedup":
            assert ids == sorted((r[0] for r in rows), key=str)
        if name == "near_dedup":
            assert ids == [1, 1, 3, 4, 5, 6, None] and out.filter(f"doc_id = 1 and lang = 'de'").count() == 1
        if name == "mixing":
            assert set(ids) == {r[0] for r in rows} and len(ids) >= len(rows)
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}
