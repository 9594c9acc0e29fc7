"""Sources, sinks, versioned stores, streams, the HTML spine and the structural chunkers on small hand-made inputs."""

import pytest
from lodestone.operators import graph, hierarchy, html, search, structure
from lodestone.sources import sinks, tables
from lodestone.streaming import events
from pyspark.sql import functions as F


def test_files_pages_and_scripts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("# One\n[[two]]", encoding="utf-8")
    (tmp_path / "two.md").write_text("two", encoding="utf-8")
    (tmp_path / "x.cypher").write_text("// head\nCREATE (a);\nMATCH (b) WHERE b.t = ';x'\nRETURN b;\n// end\n", encoding="utf-8")
    assert {r.path.split("/")[-1]: r.text for r in tables.whole_texts(spark, str(tmp_path)).collect()} == {"one.md": "# One\n[[two]]", "two.md": "two"}
    listed = tables.files(spark, str(tmp_path), "*.md")
    assert {(r.name, r.length) for r in listed.collect()} == {("one.md", 13), ("two.md", 3)}
    assert [r.name for r in tables.files(spark, str(tmp_path), "*.md", ["two.md"]).collect()] == ["two.md"]
    scripts = tables.whole_texts(spark, str(tmp_path), "*.cypher")
    assert [r.statement for r in tables.script_statements(scripts).orderBy("n").collect()] == ["CREATE (a)", "MATCH (b) WHERE b.t = ';x'\nRETURN b"]
    before = {r.path: r.md5 for r in tables.fingerprints(spark, str(tmp_path / "two.md")).collect()}
    (tmp_path / "two.md").write_text("too", encoding="utf-8")
    assert {r.path: r.md5 for r in tables.fingerprints(spark, str(tmp_path / "two.md")).collect()} != before


def test_csv_strings_and_the_secure_corpus(spark, tmp_path):
    (tmp_path / "c.csv").write_text('\ufeffchunk_id,text,allowed_roles\n007,"a ""b""\nc","Admin, HR"\n2,,Admin\n', encoding="utf-8")
    df = tables.csv_strings(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["chunk_id", "text", "allowed_roles"] and [r.chunk_id for r in df.collect()] == ["007", "2"] and df.first().text == 'a "b"\nc'
    assert tables.secure_corpus(spark, str(tmp_path / "c.csv")).first().allowed_roles == ["Admin", "HR"]
    (tmp_path / "d.csv").write_text("chunk_id,allowed_roles\n1,A\n1,B\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("chunk_id,text\n1,A\n", encoding="utf-8")
    for bad in ("d.csv", "e.csv"):
        with pytest.raises(ValueError):
            tables.secure_corpus(spark, str(tmp_path / bad)).count()


def test_json_csv_and_sql_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "Điều", None), (2, 'a "q", b', 3.5)], "id int, name string, x double")
    sinks.json_out(df, str(tmp_path / "j"))
    assert sorted(map(str, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(str, df.collect()))
    assert "Điều" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("*.json"))
    sinks.csv_out(df, ["name", "id"], str(tmp_path / "k"))
    back = tables.csv_strings(spark, str(tmp_path / "k"))
    assert back.columns == ["name", "id"] and {r.name for r in back.collect()} == {"Điều", 'a "q", b'}
    store = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "dbtable": "T"}
    sinks.jdbc_out(df, **store)
    held = sinks.jdbc(spark, **store)
    new = spark.createDataFrame([(2, "new", 4.0), (5, "five", None)], "id int, name string, x double")
    merged = tables.settled(sinks.upsert(held.toDF("id", "name", "x"), new, ["id"], "id"))
    sinks.jdbc_out(merged, "overwrite", **store, truncate="true")
    assert {tuple(r) for r in sinks.jdbc(spark, **store).collect()} == {(1, "Điều", None), (2, "new", 4.0), (5, "five", None)}


def test_staged_tables_survive_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.staged(spark.range(3), path)
    sinks.staged(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")  # cut off after the old table moved aside
    assert sinks.recovered(spark, path) and spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")
    sinks.staged(spark.range(7), path)  # the next write recovers by itself
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "t.old").exists()


def test_rows_are_reused_and_sources_watched(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(4)
    assert [sinks.reused(spark, str(tmp_path / "g"), n, make).count() for n in (4, 4, 5)] == [4, 4, 4] and len(made) == 2
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    before = tables.settled(tables.fingerprints(spark, str(tmp_path / "*.txt")))
    assert tables.changes(before, tables.fingerprints(spark, str(tmp_path / "*.txt"))).count() == 0
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "d.txt").write_text("d")
    after = tables.fingerprints(spark, str(tmp_path / "*.txt"))
    assert {(r.path.split("/")[-1], r.change) for r in tables.changes(before, after).collect()} == {("a.txt", "changed"), ("b.txt", "removed"), ("d.txt", "added")}


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "v")
    assert sinks.current(spark, path) is None
    for n in (2, 4):
        with sinks.Version(spark, path) as at:
            spark.range(n).write.parquet(f"{at}/a")
    with pytest.raises(RuntimeError), sinks.Version(spark, path) as at:
        spark.range(9).write.parquet(f"{at}/a")
        raise RuntimeError
    assert spark.read.parquet(sinks.current(spark, path) + "/a").count() == 4


def chunks(spark, rows):
    ddl = "chunk_id string, strategy string, source string, page_start int, page_end int, text string, structure struct<chapter: string, article: string, clause: string, point: string>, record_no int"
    return spark.createDataFrame([(f"c{i}", "hierarchical", "s.pdf", i, i, t, m, i) for i, (t, m) in enumerate(rows, 1)], ddl)


def test_hierarchy_store(spark, tmp_path):
    rows = [("Mở đầu", None), ("Chương II QUY ĐỊNH", None), ("Điều 5. Phạm vi", None), ("1. Khoản một", None), ("b) Điểm", {"chapter": "III", "article": "6", "clause": None, "point": None}), ("Điều 7. Khác", {"chapter": None, "article": "8", "clause": None, "point": None}), ("như Điều 9 nói", None)]
    made, path = chunks(spark, rows), str(tmp_path / "h")
    assert hierarchy.status(spark, path) == (hierarchy.NOT_READY, ["missing_hierarchy_store_files"])
    hierarchy.build(spark, made, path, "f1", 30)
    assert hierarchy.status(spark, path, "f1", 30) == (hierarchy.READY, [])
    assert hierarchy.status(spark, path, "f2", 31)[1] == ["stale_hierarchy_input_fingerprint", "stale_hierarchy_config: parent_max_chars"]
    kids = {r.chunk_id: r for r in hierarchy.store(spark, path)["children"].collect()}
    said = {k: (r.method, r.path.chapter, r.path.article) for k, r in kids.items()}
    assert said == {"c1": ("document_fallback", None, None), "c2": ("heading_inferred", "II", None), "c3": ("heading_inferred", None, "5"), "c4": ("carried_forward", "II", "5"), "c5": ("metadata", "III", "6"), "c6": ("metadata", None, "8"), "c7": ("carried_forward", "III", "8")}
    assert kids["c6"].ambiguous and kids["c6"].warnings == ["metadata_heading_conflict"] and kids["c4"].path.clause == "1" and "inline_article_reference_ignored" in kids["c7"].warnings
    parents = {tuple(r.child_ids): r for r in hierarchy.store(spark, path)["parents"].collect()}
    assert set(parents) == {("c1", "c2"), ("c3", "c4"), ("c5",), ("c6", "c7")} and parents["c3", "c4"].text == "Điều 5. Phạm vi\n\n1. Khoản một"
    with pytest.raises(ValueError):
        hierarchy.build(spark, made.unionByName(made), path, "f", 30)
    with pytest.raises(ValueError):
        hierarchy.store(spark, path, fingerprint="f2")


def test_stored_embeddings_and_questions(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    sinks.embeddings_out(v, str(tmp_path / "e"), "m", 0.18)
    assert sinks.embeddings_in(spark, str(tmp_path / "e"), "m", v.select("vec_id")).count() == 9
    assert sinks.embeddings_in(spark, str(tmp_path / "e"), "other", v) is None and sinks.embeddings_in(spark, str(tmp_path / "e"), "m", v.where("vec_id > 0")) is None
    (tmp_path / "q.json").write_text('[{"question_id": "q", "question": "x", "question_type": "exact", "relevant_parent_ids": ["p1"]}]', encoding="utf-8")
    known = spark.createDataFrame([("p1",)], "parent_id string")
    assert tables.questions(spark, str(tmp_path / "q.json"), known).count() == 1
    with pytest.raises(ValueError, match="stale ids: p1"):
        tables.questions(spark, str(tmp_path / "q.json"), known.limit(0))


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', 1, 'view', 2.0D), (2, timestamp'2024-01-01 10:10:00', 1, 'view', 3.0D), (3, timestamp'2024-01-02 12:00:00', 1, 'click', 1.0D) as t(event_id, ts, user_id, event_type, value)")
    rows.write.parquet(str(tmp_path / "in" / "events.parquet"))
    folder = str(tmp_path / "in" / "events.parquet")
    stream = events.event_stream(spark, folder, "*.parquet")
    for name, f in (("w", events.windowed), ("s", events.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"got_{name}").outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("got_w").collect()} == {("view", 2, 5.0), ("click", 1, 1.0)} == {(r.event_type, r.n, r.total) for r in events.windowed(rows).collect()}
    assert sorted(r.n for r in events.sessions(rows).collect()) == [1, 2]


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for k, batch in enumerate(([(1, 1), (2, 1), (3, 1)], [(2, 2)], [(2, 1), (9, 3)])):
        folder = tmp_path / f"in{k}"
        spark.createDataFrame(batch, "id long, v long").write.parquet(str(folder))
        stream = spark.readStream.schema("id long, v long").parquet(str(folder))
        events.upsert_batches(stream, path, ["id"], "v", str(tmp_path / f"c{k}"), buckets=8).awaitTermination()
    like = spark.createDataFrame([], "id long, v long")
    assert {tuple(r) for r in events.merged(spark, path, like).collect()} == {(1, 1), (2, 2), (3, 1), (9, 3)}
    folders = {f.split("/")[-3] for f in events._where(spark, path).values()}
    assert len(folders) > 1  # buckets that later batches did not touch are where they were


PAGE = """<html><head><title>T</title><script>x<y</script></head><body><nav><p>menu</p></nav><h1>THÔNG TƯ 02</h1><p class="a" lang="vi">Mở  đầu<p>12</p>
<div><h2>Chương I</h2><h2>QUY ĐỊNH CHUNG</h2><h3>Điều 1. Phạm vi</h3><p>Một <b>hai</b>&amp;</p><ul><li>x<li>y</ul></div><h2>Chương II. Khác</h2><h3>Điều 2</h3><table><tr><td>a</td><td>b</td></tr></table></body></html>"""


def test_html_spine_and_chunks(spark):
    got = html.cleaned(spark.createDataFrame([("a", PAGE), ("b", None)], "source string, html string")).orderBy("source").collect()
    assert got[0].removed == "nav:1,script:1" and "menu" not in got[0].cleaned and "12" not in got[0].cleaned and '<p lang="vi">Mở đầu</p>' in got[0].cleaned and "&amp;" in got[0].cleaned and got[1].cleaned == ""
    rows = html.chunked(spark.createDataFrame([("a", PAGE), ("b", None)], "source string, html string")).orderBy("source", "ord").collect()
    tree = [(r.kind, r.title, r.parent_id) for r in rows if r.source == "a"]
    assert tree == [("document", "THÔNG TƯ 02", None), ("paragraph", "T", "c0001"), ("paragraph", "Mở đầu", "c0001"), ("chapter", "Chương I - QUY ĐỊNH CHUNG", "c0001"), ("article", "Điều 1 - Phạm vi", "c0004"), ("paragraph", "Một\nhai\n&", "c0005"), ("list", "x\ny", "c0005"), ("chapter", "Chương II - Khác", "c0001"), ("article", "Điều 2", "c0008"), ("table", "a\nb", "c0009")]
    by = {r.id: r for r in rows if r.source == "a"}
    assert by["c0006"].heading_path == ["THÔNG TƯ 02", "Chương I - QUY ĐỊNH CHUNG", "Điều 1 - Phạm vi", "Một\nhai\n&"]
    assert [by[k].next_id for k in ("c0001", "c0002", "c0009", "c0010")] == ["c0002", "c0003", "c0010", "c0001"]
    assert [(r.kind, r.title, r.next_id) for r in rows if r.source == "b"] == [("document", html.UNTITLED, None)]


def test_markdown_is_rendered():
    made = html.markdown_html("# A *b*\n\none\ntwo **x** <y>\n\n- p\n- q\n1. r\n\n| a | b |\n|---|---|\n| c | d |")
    assert made == "<h1>A <em>b</em></h1>\n<p>one<br/>\ntwo <strong>x</strong> &lt;y&gt;</p>\n<ul><li>p</li><li>q</li></ul>\n<ol><li>r</li></ol>\n<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"


def test_structural_chunks_on_small_pages(spark):
    pages = [(1, "Lời đầu\nChương I\nĐiều 1. Một\n1. Khoản\na) Điểm"), (2, "b) Hai\nĐiều 2. " + "x" * 60)]
    df = spark.createDataFrame([("s", pages), ("e", [(1, None)]), ("n", [])], "source string, pages array<struct<page: int, text: string>>")
    rows = df.select("source", F.posexplode(structure.hierarchical_chunks(F.col("pages"), 50)).alias("n", "c")).select("source", "n", "c.*").orderBy("n").collect()
    assert {r.source for r in rows} == {"s"}
    assert [(r.level, r.page_start, r.page_end, r.boundary) for r in rows] == [(None, 1, 1, "new_chapter"), ("chapter", 1, 1, "new_article"), ("article", 1, 1, "new_clause"), ("clause", 1, 1, "new_point"), ("point", 1, 1, "new_point"), ("point", 2, 2, "new_article"), ("article", 2, 2, "max_size_guard_inside_structure")]
    assert rows[5].path == "Chương I > Điều 1. Một > 1. Khoản > b) Hai" and rows[6].path.startswith("Chương I > Điều 2. x")
    parts = lambda t, most: spark.createDataFrame([(t,)], "t string").select(structure.split_large(F.col("t"), most).alias("p")).first().p
    assert parts("One two. Three four? " + "y" * 25 + " end", 20) == ["One two. Three four?", "y" * 20, "y" * 5 + " end"] and parts("  ", 9) == [] and parts("short", 9) == ["short"]


def test_chains_seeds_and_texts_holding(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", None)], "id string, next_id string")
    assert {(r.id, r.head, r.hops) for r in graph.chain(links, 8).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", None, None), ("y", None, None), ("z", "z", 0)}
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "a quick brown dog"), (3, None), (4, "thequick brown fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "he quick brown f"), (2, "quick"), (3, ""), (4, None), (5, "wn do")], "query_id long, text string")
    assert {tuple(r) for r in search.texts_holding(docs, items).collect()} == {(1, 1), (2, 1), (2, 2), (2, 4), (5, 2)}


def test_retriever_by_role_and_name(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", ["A"]), (2, "alpha gamma", ["B"]), (3, None, ["A"])], "doc_id long, text string, allowed_roles array<string>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, "gamma alpha", [0.1, 1.0]), (8, " ", [1.0, 0.0])], "query_id long, text string, q array<double>")
    seen = search.Retriever(corpus, vectors, roles=["a"], known={"a": "A"})
    assert {(r.query_id, r.doc_id, r.note) for r in seen.retrieve("dense", asked).collect()} == {(7, 1, None), (8, None, "empty query")}
    assert [r.doc_id for r in search.Retriever(corpus, vectors).dense(asked, 1).where("query_id = 7").collect()] == [2]
    with pytest.raises(ValueError):
        search.Retriever(corpus, vectors, roles=["x"], known={"a": "A"})
    for name in ("nothing", "hybrid_rerank"):
        with pytest.raises(ValueError):
            seen.retrieve(name, asked).count()


def test_dense_in_blocks_equals_one_block(spark):
    import numpy as np

    g = np.random.default_rng(4)
    rows = [(i, g.integers(-3, 4, 6).astype(float).tolist()) for i in range(60)] + [(60, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, many = (sorted(map(tuple, search.dense(v, q, 4, block=b).collect())) for b in (4096, 2))
    unit = {i: np.array(e) / max(np.linalg.norm(e), 1e-12) for i, e in rows if e}
    want = sorted((i, j, s, k + 1) for i in unit if i % 7 == 0 for k, (s, j) in enumerate(sorted(((round(float(unit[i] @ unit[j]), 6), j) for j in unit if j != i), key=lambda x: (-x[0], x[1]))[:4]))
    assert one == many and [(a, b, round(s + 0.0, 6), r) for a, b, s, r in one] == [(a, b, s + 0.0, r) for a, b, s, r in want]


def test_whole_results_are_numbered_by_ranges(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(7)
    got = {r.id: r["rank"] for r in search.numbered(df, [F.desc("a"), F.asc("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (-(i * 37 % 101), i)) and sorted(got.values()) == list(range(1, 501))
