"""Nulls, empties, long texts, repeated rows, empty tables and clashing columns of every operator and stage."""

import collections

import pytest
from pyspark.sql import functions as F
from test_pairs_and_spans import DOCS, brute, sets_of, space_words

import corpus_pipeline as C
from cartoframe.llm import decontaminate, jaccard_join, span_dedup, token_counts, url_filter

LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ROWS = [(1, "one two three four five six. Seven eight nine ten eleven twelve.", "en", "a", 3), (1, "one two three four five six. Seven eight nine ten eleven twelve.", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "b", 9), (5, LONG + " tail", "en", "b", 9), (None, "no id. But text, all the same, here it is.", "de", None, 1), (None, "no id. But text, all the same, here it is.", "de", None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def test_jaccard_edges(spark, docs):
    want, _, sets = brute(ROWS, 5, 80, 100)
    noisy = clash(docs, "N_Shingles", "component_id", "rep", "x", "h", "block", "k1")
    got = jaccard_join.ngram_jaccard_components(noisy, 5, 80, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    by = {r.doc_id: (r.component_id, r.n_shingles) for r in got.collect()}
    assert by == {i: (want[i], len(sets[i])) for i in want} | {None: (None, by[None][1])} and by[5][0] == 4
    assert len(sets_of(ROWS, 5)[4]) == len(space_words(LONG)) - 4
    members, pairs = jaccard_join.ngram_jaccard_join(noisy, 5, 80, 100)
    assert members.count() == len(ROWS) and [(r.u, r.v) for r in pairs.collect()] == [(4, 5)]
    members, pairs = jaccard_join.ngram_jaccard_join(docs.limit(0))
    assert members.collect() == pairs.collect() == []


def test_thue_morse_words_and_sentences_differ(spark):
    """Texts that collide under any polynomial modulo 2**64."""
    a = [0]
    for _ in range(12):
        a += [1 - x for x in a]
    one, other = ("".join("xy"[b ^ c] for b in a) for c in (0, 1))
    docs = spark.createDataFrame([(1, f"p q r {one} s t u"), (2, f"p q r {other} s t u"), (3, " ".join(["ab", "cd"][b] for b in a) + ". End of it."), (4, " ".join(["ab", "cd"][1 - b] for b in a) + ". End of it.")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.ngram_jaccard_components(docs.where("doc_id < 3"), 99, 90, 100).collect()} == {1: 1, 2: 2}
    assert {r.n_removed for r in span_dedup.remove_repeated_spans(docs, tails=True).collect()} == {0}


def test_span_edges(spark, docs):
    noisy = clash(docs, "N_Removed", "removed", "__at", "__hash", "places")
    got = span_dedup.remove_repeated_spans(noisy, tails=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "places", "n_sentences", "n_removed", "removed"]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter((r[0], r[1]) for r in ROWS)
    many = spark.createDataFrame([(None, f"Unlike others number {i % 50} here. But this is the same for all of them, always.") for i in range(300)], "doc_id long, text string").repartition(5)
    left = collections.Counter(r.text for r in span_dedup.remove_repeated_spans(many, 2, 5, tails=True).collect())
    assert sum(left.values()) == 300 and len(left) == 50  # repeated rows are one document, others differ in their first sentence
    shared = spark.createDataFrame([(None, f"A{i}. One two three four five. Six seven eight nine ten.") for i in range(40)], "doc_id long, text string").repartition(5)
    assert sorted(r.n_removed for r in span_dedup.remove_repeated_spans(shared, 2, 10, tails=True).collect()) == [0] + [2] * 39


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(7, LONG[:200], "x"), (None, "But text all the same", "x"), (8, None, "x"), (9, "...", "x")], "item_id long, text string, hits string")
    noisy = clash(docs, "Hits", "n_words", "item_ids")
    got = decontaminate.find_contamination(noisy, items, 10).collect()
    assert collections.Counter((r.doc_id, r.n_hit > 0, len(r.item_ids)) for r in got) == collections.Counter([(1, False, 0)] * 2 + [(2, False, 0), (3, False, 0), (4, True, 1), (5, True, 1)] + [(None, True, 0)] * 2 + [(None, False, 0)])
    kept = decontaminate.decontaminate(docs, items, 10)
    assert kept.columns == docs.columns and kept.count() == 5
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, 10, "spans").collect()}
    assert len(space_words(cut[4])) < 60_000 and cut[1] == ROWS[0][1]
    assert decontaminate.find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_token_edges(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.count_tokens(clash(docs, "N_TOKENS", "over_limit", "n_bytes"), path)
    texts = {r[0]: r[1] for r in ROWS}
    assert got.count() == len(ROWS) and all((r.n_tokens == 0) == (r.n_bytes == 0) for r in got.collect())
    assert sorted(str(r.doc_id) for r in got.collect() if r.n_tokens == 0) == ["2", "3", "None"] and max(r.n_bytes for r in got.collect()) == len(texts[5])
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []


def test_url_edges(spark):
    rows = [(1, "http://a.test/" + "x" * 50_000, "<a href='http://b.test/'>" * 3000), (1, "http://a.test/" + "x" * 50_000, "<a href='http://b.test/'>" * 3000), (2, "http://b.test", None), (3, "http://com/en/x", '<a href="http://a.test">'), (None, None, None)]
    pages = spark.createDataFrame([(*r, "mine", "mine", 7) for r in rows], "page_id long, url string, html string, Host string, verdict string, extra int").repartition(3)
    got = url_filter.filter_urls(pages)
    assert got.columns == ["page_id", "url", "html", "extra", "host", "path", "rule", "verdict", "trust", "distrust"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert len(by[1].path) == 50_001 and (by[2].path, by[3].verdict, by[None].host) == ("", "block", "")
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_repeated_pages_count_alike_in_sql(spark, tmp_path):
    import duckdb

    html = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(1, "http://com/en/1", html("b.test")), (1, "http://com/en/1", html("b.test")), (2, "http://b.test/", html("com", "c.test", "com", "C.test")), (2, "http://b.test/", html("com", "c.test", "com")), (3, "http://c.test/", html("net")), (4, "http://net/de/1", html("c.test", "b.test")), (5, "http://net/x", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op9_url_filters(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    settled = con.sql(url_filter.sql(200)).fetchall()  # rounds until no rank changes
    assert sorted(map(tuple, got)) == sorted(settled) and {r.verdict for r in got} == {"allow", "block"}


def test_stages_on_empty_tables_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is there at all in any of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    for name, stage in C.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
        gone = {5} if name == "ngram_jaccard_join" else set()
        assert {k: n for k, n in kept.items() if k[1]} == {k: n for k, n in collections.Counter((r[0], r[1]) for r in ROWS if r[0] not in gone).items() if k[1]}, name
    taken = C.STAGES[-1][1](spark, docs, str(tmp_path))
    assert all(n == 1 or (i, t) in {(r[0], r[1]) for r in ROWS} for (i, t, _), n in collections.Counter((r.doc_id, r.text, r.epoch) for r in taken.collect()).items())
    assert max(collections.Counter((r.doc_id, r.text, r.epoch) for r in taken.collect()).values()) <= 2
