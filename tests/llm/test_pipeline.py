import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("aeioubcdfg") for _ in range(draw.randrange(2, 7)))
    vocabulary = [word() for _ in range(3000)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage = text(70)
    rows = []
    for i in range(240):
        body = text(draw.randrange(60, 120)).split()
        if i % 6 == 0:
            for _ in range(6):
                body[draw.randrange(len(body))] = "vilebad"
        rows.append([i, " ".join(body), "en", f"src{i % 3}"])
    rows[31][1] = rows[1][1]
    rows[32][1] = rows[2][1].rsplit(" ", 1)[0] + " other"
    rows[33][1], rows[34][1] = rows[33][1] + " " + passage, rows[34][1] + "\n" + passage
    frame = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows, passage


def test_stages(spark, tables):
    top, rows, passage = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, top).cache()
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == columns
    assert sum(i in ids for i in range(240) if i % 6 == 0) <= 2 and sum(i in ids for i in range(240) if i % 6) >= 195
    one = corpus_pipeline.drop_near_copies(spark, docs, top)
    assert one.columns == columns
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r[0] for r in rows} - {31, 32}
    cut = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, top).collect()}
    assert len(cut) == len(rows) and cut[1] == cut[31] == "" and passage not in cut[33] and passage[10:] not in cut[34]
    assert cut[7] == rows[7][1]
    mixed = corpus_pipeline.mix(spark, docs, top).collect()
    assert set(mixed[0].asDict()) == set(columns)
    size = lambda t: len(t.split())
    total = sum(size(r[1]) for r in rows)
    assert abs(sum(size(r.text) for r in mixed) - 1.5 * total) <= 3
    assert all(r.n_chars == len(r.text) for r in mixed)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0]).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_one_row_of_a_group_stays(spark, tables):
    """Repeated rows, null ids and ids shared by different texts, through both stages that remove copies."""
    texts = [r[1] for r in tables[1][7:12]]
    near = [t.rsplit(" ", 1)[0] + " other" for t in texts]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (None, texts[1]), (None, near[1]), (None, texts[1])]
    rows += [(5, texts[2]), (7, near[2]), (7, texts[3]), (9, texts[4]), (None, near[4]), (11, ""), (11, "")]
    docs = spark.createDataFrame([(*r, "en", "src", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "")
    assert one.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    (none,) = [t for i, t in got if i is None]
    assert none in (texts[1], near[1])
    assert got == sorted([(1, texts[0]), (None, none), (5, texts[2]), (7, texts[3]), (9, texts[4]), (11, ""), (11, "")], key=str)
    cut = corpus_pipeline.drop_repeated_passages(spark, one, "").collect()
    assert sorted(((r.doc_id, r.text) for r in cut), key=str) == got


def test_clashing_columns(spark, tables):
    """Further columns with names that the operators use come through every stage as they were."""
    names = ["score", "kept", "size", "n_removed", "spans", "start", "component_id", "cls", "text_digest", "digest", "rid", "marked_id", "repeated"]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").filter("doc_id < 40")
    docs = docs.union(docs.filter("doc_id % 3 = 1"))  # repeated rows
    for k, n in enumerate(names):
        docs = docs.withColumn(n, docs["doc_id"] + k)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id + k for r in rows for k, n in enumerate(names))


def test_empty_null_and_long(spark, tables):
    schema = spark.read.parquet(f"{tables[0]}/documents.parquet").schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), tables[0]).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 60_000, "en", None, None), (None, "x", "en", "s", 1)]
    for _, stage in corpus_pipeline.STAGES:
        assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, schema), tables[0]).collect()} >= {1, 2}
