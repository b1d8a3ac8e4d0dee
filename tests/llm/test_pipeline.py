"""The pipeline against plain Python versions of its stages, and against their SQL."""

import corpus_pipeline
import plain

from chainframe.llm import pii, queries

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "Null ids come after all others and their texts are read like any other text of ten words.", "en", "a", 1),
    (9000, None, "en", "a", 0),
    (9001, "", "de", None, 0),
    (9002, " \n\t ", None, "b", 3),
    (9003, "Some words of a document that stands here two times, with one id and one text.", "en", "b", 9),
    (9003, "Some words of a document that stands here two times, with one id and one text.", "en", "b", 9),
    (9004, "some WORDS of a document that stands here two times, with one id and one text.", "en", None, 9),
    (9005, " ".join(f"word{i}" for i in range(30_000)), "en", "very long", 9),
    (9006, "Write to jane@mail.org, call +1 (212) 555-0147, card 4111 1111 1111 1111, from 10.0.0.1 or not at all.", "en", "b", 9),
]


def folder(spark, tmp_path, extra=()):
    """The small tables with odd rows, and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(list(ODD) if extra is not None else [], docs.schema)
    own = (docs if extra is not None else docs.limit(0)).union(more)
    if extra:
        own = own.selectExpr("*", *(f"doc_id AS `{c}`" for c in extra))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def by_hand(docs, items):
    """(id, taken, text) of what is left of (id, source, text)."""
    rows = [r for r in docs if plain.good(r[2])]
    last = 1 << 63
    label = plain.classes([(last if i is None else i, t) for i, _, t in rows])
    rows = [r for r in rows if label[last if r[0] is None else r[0]] == (last if r[0] is None else r[0])]
    rows = [r for r in rows if not plain.hits(r[2], items)[1]]
    rows = [(i, s, plain.redacted(t, pii)) for i, s, t in rows]
    taken, _ = plain.mixed(rows)
    return sorted(((r[0], n, r[2]) for r, n in zip(rows, taken, strict=True) if n), key=str)


def test_pipeline_equals_plain_python(spark, tmp_path):
    extra = ("key", "size", "row", "taken", "_n", "n_words", "comp", "base", "threshold")
    sf = folder(spark, tmp_path, extra)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    got = sorted(((r["doc_id"], r["taken"], r["text"]) for r in rows), key=str)
    want = by_hand([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], items)
    assert got == want and 0 < len(want) < docs.count()
    assert all(r["key"] == r["doc_id"] == r["comp"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    if 9006 in texts:
        assert texts[9006] == "Write to [EMAIL], call [PHONE], card [CARD], from [IP] or not at all."


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, None)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.count() == 0 and corpus_pipeline.run(spark, sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "mixing"]


def test_pipeline_equals_the_sql_of_its_stages(spark):
    import duckdb

    sql = queries.oracle_sql()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    for name, keep in (("op6_quality_rules", "kept"), ("op3_near_dedup", "kept"), ("op2_decontamination", "NOT contaminated")):
        con.execute(f"CREATE TABLE stays AS SELECT doc_id FROM ({sql[name]}) WHERE {keep}")
        con.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM stays)")
        con.execute("DROP TABLE stays")
    left = con.execute("SELECT doc_id, text FROM documents").fetchall()
    for i, t in left:
        con.execute("UPDATE documents SET text = ? WHERE doc_id = ?", [plain.redacted(t, pii), i])
    want = set(con.execute(f"SELECT doc_id, taken FROM ({sql['op5_mixing']}) WHERE taken > 0").fetchall())
    assert left and {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_added_spans_equal_plain_python(spark):
    from labelled_pii import PRIVATE, PUBLIC

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([x for x, _ in PRIVATE] + PUBLIC)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.digest(docs).collect():
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, k, e in plain.all_spans(texts[r["doc_id"]] or "", pii)), r["doc_id"]
