"""Each registered query of the engine against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    said = lambda v: "" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(said(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_paths_without_names_are_null(spark, duck):
    got = [tuple(r) for r in registry.queries()["z22_vector_paths"](spark, SF).collect()]
    want = duck.sql(registry.oracle_sql()["z22_vector_paths"]).fetchall()
    assert any(r[4] is None for r in want) and any(r[5] is None and r[4] for r in want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_paths_keep_equal_hits(spark, tmp_path):
    c = duckdb.connect()
    twice = {"documents": "doc_id % 5 = 0", "embeddings": "vec_id % 7 = 0", "orders": "o_orderkey % 2 = 0", "customer": "c_custkey % 3 = 0"}
    odd = {"customer": "replace (CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '' ELSE c_name END AS c_name)"}
    for t in ("nation", "benchmark", *twice):
        c.sql(f"copy (select * exclude (i) {odd.get(t, '')} from '{SF}/{t}.parquet', range(2) r(i) where i = 0 or {twice.get(t, 'false')}) to '{tmp_path}/{t}.parquet'")
        c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in registry.queries()["z22_vector_paths"](spark, str(tmp_path)).collect()]
    want = c.sql(registry.oracle_sql()["z22_vector_paths"]).fetchall()
    assert len({r[:4] for r in want}) < len(want) and any(r[4] == "" for r in want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_context_budget_is_greedy(spark):
    from lodestone.operators.search import within_budget

    items = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40), (1, 4, 10), (2, 1, 500)], "q int, o int, n int")
    got = {r.q: (r.used, r.kept) for r in within_budget(items, "q", "o", "n", 100).collect()}
    assert got == {1: (100, "1,3,4"), 2: (500, "1")}


def test_matrix_has_all_items(spark, duck):
    found = registry.queries()["a30_query_child_matrix"](spark, SF).collect()
    items = {int(c.split(":")[0]) for r in found for c in r.ranks.split(",")}
    assert items == {i for i, in duck.sql("select item_id from benchmark").fetchall()} and all(r.n_queries == len(r.ranks.split(",")) for r in found)


def test_rare_entities_stay(spark):
    found = registry.queries()["a14_entity_canonicalise"](spark, SF).collect()
    assert len({(r.kind, r.key) for r in found}) == len(found) and any(r.mentions <= 5 for r in found)


def test_packing_closes_windows(spark):
    from lodestone.operators.chunking import packed

    items = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 20, 1])], "q int, o int, n int")
    assert [(r.window, r["items"], r.chars) for r in packed(items, "q", "o", "n", 10).orderBy("window").collect()] == [(0, 2, 10), (1, 1, 4), (2, 1, 20), (3, 1, 1)]


def test_parent_score_is_capped(spark):
    from lodestone.operators.search import parents

    hits = spark.createDataFrame([(1, "p", 1), (2, "p", 2), (3, "p", 3), (4, "q", 4)], "doc_id long, parent_id string, rank int")
    got = {r.parent_id: r.score for r in parents(hits, 2).collect()}
    assert got["p"] == round(1 / 61 + 1 / 62, 9) and got["q"] == round(1 / 64, 9)


def test_html_matches_parser(spark):
    from html.parser import HTMLParser

    from lodestone.functions.text import strip_html
    from lodestone.sources.tables import table
    from pyspark.sql import functions as F

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            self.parts += [] if self.skip else [data]

    for r in table(spark, SF, "pages").select("html", strip_html(F.col("html"), " ").alias("t")).collect():
        p = Text()
        p.feed(r.html)
        assert "".join(r.t.split()) == "".join("".join(p.parts).split())


def test_quality_warnings(spark):
    from lodestone.functions.text import text_faults
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), (None,), ("a�b",), ("1 " * 60,), ("fine words here",)], "t string")
    want = ["text_layer_empty", "text_layer_empty", "replacement_character_found", "too_few_letters_for_text_page,possible_broken_glyph_spacing", ""]
    assert [r.f for r in df.select(F.array_join(text_faults(F.col("t")), ",").alias("f")).collect()] == want


def test_json_sources(spark, tmp_path):
    from lodestone.sources import tables

    (tmp_path / "a.json").write_text('{"chunks": [{"chunk_id": "a", "strategy": "s", "source": "x", "page_start": 1, "page_end": 2, "text": "t"}, {"chunk_id": "b", "strategy": "s", "source": "x", "page_start": 1, "page_end": 2, "text": " "}]}')
    assert [r.chunk_id for r in tables.json_chunks(spark, str(tmp_path)).collect()] == ["a"]
    assert [r.text for r in tables.loose_json(spark, str(tmp_path / "a.json")).collect()] == ["t", " "]
    (tmp_path / "a.json").write_text('[{"chunk_id": "a", "strategy": "s", "source": "x", "page_start": 3, "page_end": 2, "text": "t"}]')
    with pytest.raises(ValueError):
        tables.json_chunks(spark, str(tmp_path))


def test_stream_upsert_equals_batch(spark, tmp_path):
    from lodestone.sources import sinks
    from lodestone.sources.tables import table
    from lodestone.streaming import events

    keys = ["user_id", "event_type"]
    stream = events.event_stream(spark, SF).select(*keys, "event_id", "ts")
    events.upsert_batches(stream, str(tmp_path / "t"), keys, "ts", str(tmp_path / "c")).awaitTermination()
    rows_ = table(spark, SF, "events").select(*keys, "event_id", "ts")
    want = sinks.upsert(rows_.limit(0), rows_, keys, "ts")
    got = events.merged(spark, str(tmp_path / "t"), rows_)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
