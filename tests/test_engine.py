"""Golden values and properties of the operators that SQL doesn't express, streams against tables, stores."""

import numpy as np
import pytest

from weftline.config import EngineConfig
from weftline.functions import text
from weftline.operators import graph, overlap, placing
from weftline.operators.store import KeyedTable
from weftline.plans import more, site
from weftline.plans.dialect import Spark
from weftline.sources import keywords
from weftline.streaming import incremental

DATA = "/root/testdata/sf0.001"


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS x").first()["x"]


@pytest.mark.parametrize(("p", "rate"), [(0, 0.28), (1, 0.28), (3, 0.11), (10, 0.025), (20, 0.008), (50, 0.005)])
def test_click_rate(spark, p, rate):
    assert value(spark, site.click_rate(f"CAST({p} AS DOUBLE)")) == pytest.approx(rate, abs=1e-4)


@pytest.mark.parametrize(("p", "worth"), [(1, 0), (3, 0), (5, 50), (10, 85), (20, 102), (40, 52.5)])
def test_opportunity(spark, p, worth):
    assert value(spark, site.opportunity("1000", f"CAST({p} AS DOUBLE)")) == pytest.approx(worth, abs=0.1)


def test_naturalness(spark):
    assert value(spark, site.naturalness("'three words of twenty chars'", Spark())) == pytest.approx(0.55 + 0.15 - 0.15)
    assert value(spark, site.naturalness("'indian national congress'", Spark())) == pytest.approx(0.9)
    assert value(spark, site.naturalness("''", Spark())) == 0


def test_settings_are_held_to_their_limits():
    assert EngineConfig(max_links_per_1000=99, min_relevance=-1).max_links_per_1000 == 20
    assert EngineConfig(min_anchor_words=3, max_anchor_words=1).max_anchor_words == 3


def test_sentences():
    assert text.sentences("It has divisions.A zone is one. Done") == ["It has divisions.", "A zone is one.", "Done"]
    assert text.sentences("Mr. V. P. Menon came. He left.") == ["Mr. V. P. Menon came.", "He left."]
    assert text.sentences(None) == []


def test_overlap_and_furniture():
    assert text.overlap({"a"}, {"a"}) == 1 and text.overlap({"a"}, {"b"}) == 0 and text.overlap({"a"}, {"a", "b"}) == 1 and text.overlap(set(), {"a"}) == 0
    assert text.furniture_ratio(["a", "b"], {"a"}) == 0.5 and text.furniture_ratio([], {"a"}) == 0
    assert text.trim_to_words("a b c d e", 3) == "a b c…"


@pytest.mark.parametrize("page", ["<h2>good anchor</h2>", '<a href="/x">good anchor</a>', "<pre>good anchor</pre>", "<p>good anchorage</p>", '<p title="good anchor">x</p>'])
def test_links_are_refused(page):
    assert text.insert_link(page, "good anchor", "/t") == page


def test_link_is_set_once_and_text_stays():
    page = "<h1>good anchor</h1><p>A good anchor, a good anchor.</p>"
    new = text.insert_link(page, "good anchor", "/t")
    assert new.count('<a href="/t">') == 1 and text.visible(new) == text.visible(page) and text.insert_link(page, "", "/t") == page


def test_summaries_keep_to_the_budget(spark):
    for row in more.summaries(spark, DATA).collect():
        assert len(row["summary"].split()) <= 45


def test_summaries_pass_over_questions_and_site_wide_wording(spark):
    plain = "Copper pipes carry water through every old house here."
    for other in ("Copper pipes with reference to brass carry water through houses.", "Do copper pipes carry warm houses\uff1f they asked.", "Home contact privacy terms copper pipes carry water about."):
        pages = spark.createDataFrame([(1, f"{other} {plain}")], "post_id long, parsed_text string")
        words = [*{w for s in (plain, other) for w in map(text.normal_word, s.split())}]
        common = frozenset("home contact privacy terms about".split())
        terms = spark.createDataFrame([(1, w, 3 if w not in plain.lower() else 2) for w in words if w not in common], "post_id long, term string, tf int")
        assert text.summaries(pages, terms, 9, site_wide=common).first()["summary"] == plain


def test_summaries_query_knows_the_site_wide_terms(spark, monkeypatch):
    seen, view = {}, more._view
    common = spark.createDataFrame([("home", 9), ("contact", 8)], "term string, df long")
    monkeypatch.setattr(more, "_view", lambda spark, sf_dir, name: common if name == "site_wide" else view(spark, sf_dir, name))
    monkeypatch.setattr(text, "summaries", lambda pages, postings, **given: seen.update(given))
    more.summaries(spark, DATA)
    assert seen["site_wide"] == {"home", "contact"}


@pytest.mark.parametrize("small", [10**6, 0])
def test_pagerank_by_either_way(spark, small):
    edges = [(1, 2), (2, 3), (3, 1), (3, 1), (4, 4), (1, 9), (8, 1)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "source long, target long"), 12, small=small).collect()}
    inner = [(a, b) for a, b in edges if a <= 5 and b <= 5]
    rank = np.full(6, 0.2)
    for _ in range(12):
        new = np.full(6, 0.03)
        for a, b in inner:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in inner)
        new += 0.85 * sum(rank[k] for k in range(1, 6) if not any(a == k for a, _ in inner)) / 5
        rank = new
    assert sum(got.values()) == pytest.approx(1) and all(got[k] == pytest.approx(rank[k]) for k in range(1, 6))


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "source long, target long")
    assert graph.pagerank(spark.createDataFrame([], "node long"), empty).count() == 0


def test_suggestions_are_within_limits(spark):
    rows = site.view(spark, "/root/testdata/sf0.01", "suggestions").collect()
    pairs = [(r["source_id"], r["target_id"]) for r in rows]
    assert len(pairs) == len(set(pairs)) and all(0 <= r["confidence"] <= 1 and r["source_id"] != r["target_id"] for r in rows)
    assert max((sum(s == x for s, _ in pairs) for x, _ in pairs), default=0) <= EngineConfig().max_suggestions


def test_keyword_csv(spark, tmp_path):
    file = tmp_path / "k.csv"
    file.write_text('﻿Top queries,Clicks,Impressions,CTR,Position\n"Blue, Car","1,200",3000,5.2%,4.5\nred car,,x,,\n')
    rows = keywords.read_csv(spark, str(file)).orderBy("keyword").collect()
    assert [(r["keyword_norm"], r["clicks"], r["impressions"], round(r["ctr"], 4), r["position"]) for r in rows] == [("blue, car", 1200, 3000, 0.052, 4.5), ("red car", 0, 0, 0.0, 0.0)]
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="keyword"):
        keywords.read_csv(spark, str(tmp_path / "n.csv"))


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"])
    assert table.read() is None
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2)], "k long, v string, seq int"), newest="seq")
    table.upsert(spark.createDataFrame([(1, "d", 3)], "k long, v string, seq int"))
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, "d"), (2, "c")}
    table.delete(spark.createDataFrame([(2,)], "k long"))
    assert [r["k"] for r in table.read().collect()] == [1]
    table.truncate()
    assert table.read().count() == 0


def test_stream_indexes_like_a_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["post_id"])
    schema = "post_id long, parsed_text string, deleted boolean"
    for rows in ([(1, "a", False), (2, "b", False)], [(1, "c", False), (2, "b", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.index_pages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/check").awaitTermination()
    assert {(r["post_id"], r["parsed_text"]) for r in table.read().collect()} == {(1, "c")}


def test_stream_sets_pages_aside_that_fail(spark, tmp_path):
    table, failed = KeyedTable(spark, f"file://{tmp_path}/t", ["post_id"]), KeyedTable(spark, f"file://{tmp_path}/f", ["post_id"])
    schema = "post_id long, parsed_text string, deleted boolean"

    def make(page):
        return page.upper() if page != "bad" else 1 / 0

    seen = []
    for rows in ([(1, "a", False), (2, "bad", False), (3, "c", False)], [(1, "bad", False), (2, "b", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.index_pages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/check", make, failed).awaitTermination()
        seen.append(({r["post_id"]: r["parsed_text"] for r in table.read().collect()}, [(r["post_id"], r["error"][:5]) for r in failed.read().collect()]))
    assert seen == [({1: "A", 3: "C"}, [(2, "ZeroD")]), ({1: "A", 2: "B", 3: "C"}, [(1, "ZeroD")])]


def test_streamed_usage_is_the_table_s(spark, tmp_path):
    log = more._view(spark, DATA, "v_spend_log")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = incremental.usage(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"))
    stream.writeStream.format("memory").queryName("usage_out").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    columns = ["window", "provider", "model", "requests", "tokens_in", "tokens_out"]
    got, want = (sorted(map(tuple, df.select(*columns).collect()), key=repr) for df in (spark.table("usage_out"), incremental.usage(log)))
    assert got == want and got


@pytest.mark.parametrize("small", [10**6, 0])
def test_click_depth_by_either_way(spark, small):
    edges = [(k, k + 1) for k in range(1, 30)] + [(1, 5), (5, 99), (40, 41), (7, 7)]
    nodes = spark.createDataFrame([(k,) for k in (1, 4, 5, 8, 30, 40, 41, 77)], "node long")
    got = {r["node"]: r["depth"] for r in graph.click_depth(nodes, spark.createDataFrame(edges, "source long, target long"), 1, small=small).collect()}
    assert got == {1: 0, 4: 3, 5: 1, 8: 4, 30: 26, 40: -1, 41: -1, 77: -1}


def test_overlaps_of_small_blocks(spark, monkeypatch):
    draw = np.random.default_rng(31)
    rows = sorted({(int(p), "ab"[p % 2], f"t{t}", int(draw.integers(1, 4))) for p in range(30) for t in draw.integers(0, 12, 8)})
    tf = {(p, t): n for p, _, t, n in rows}
    idf = {f"t{k}": 1 + k / 8 for k in range(12)}
    sources = spark.createDataFrame([(p, a, t, tf[p, t], idf[t]) for p, t in tf for a in "ab"[p % 2]], "post_id long, lang_code string, term string, tf int, idf double")
    weights = spark.createDataFrame([(t, k + 1) for k, t in enumerate(idf)], "term string, number long")
    want = {}
    for a in range(30):
        own = {t: n for (p, t), n in tf.items() if p == a}
        found = []
        for b in range(a % 2, 30, 2):
            both = [t for t in own if (b, t) in tf]
            if a != b and len(both) >= 2:
                found.append((-np.floor(min(1, sum(idf[t] * min(own[t], tf[b, t]) for t in both) / sum(idf[t] * n for t, n in own.items())) * 1e4 + 0.5) / 1e4, b, len(both)))
        want |= {(a, b): (n, -s, k) for k, (s, b, n) in enumerate(sorted(found)[:5], 1)}
    for block in (1000, 4):
        monkeypatch.setattr(overlap, "SOURCES", block)
        monkeypatch.setattr(overlap, "TARGETS", block)
        got = overlap.best_overlaps(sources, sources.drop("idf"), weights, 5).collect()
        assert {(r["source_id"], r["target_id"]): (r["shared"], pytest.approx(r["score"], abs=1.1e-4), r["rank"]) for r in got} == want


def test_overlaps_write_a_block_of_targets_once(spark, monkeypatch):
    """However many groups of sources there are, and with the same result as brute force where bounds leave targets out."""
    draw = np.random.default_rng(5)
    pages = {p: {int(t): int(n) for t, n in zip(np.minimum(draw.zipf(1.3, 25), 400), draw.integers(1, 5, 25), strict=True)} for p in range(1500)}
    pages |= {p: dict(pages[7]) for p in range(1500, 1600)}  # a group of copies, larger than k
    df = {t: sum(t in x for x in pages.values()) for t in range(401)}
    idf = {t: float(np.log(1 + len(pages) / n)) for t, n in df.items() if n}
    sources = spark.createDataFrame([(p, "a", t * (df[t] > 1), n, idf[t]) for p, x in pages.items() if p % 13 == 0 or p >= 1590 for t, n in x.items()], "post_id long, lang_code string, number long, tf long, idf double")
    targets = spark.createDataFrame([(p, "a", list(x), list(x.values())) for p, x in pages.items()], "post_id long, lang_code string, numbers array<long>, tfs array<long>").coalesce(1)
    want = {}
    for a in (r["post_id"] for r in sources.select("post_id").distinct().collect()):
        norm = sum(idf[t] * n for t, n in pages[a].items())
        found = [(-np.floor(min(1, sum(idf[t] * min(n, x[t]) for t, n in pages[a].items() if t in x) / norm) * 1e4 + 0.5) / 1e4, b) for b, x in pages.items() if b != a and len(pages[a].keys() & x.keys()) >= 2]
        want[a] = sorted(found)[:6]
    written, write = [], overlap._blocks
    monkeypatch.setattr(overlap, "_blocks", lambda *a: written.append(write(*a)) or written[-1])
    monkeypatch.setattr(overlap, "TARGETS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    for group in (1000, 10):
        monkeypatch.setattr(overlap, "SOURCES", group)
        got = {}
        for r in overlap.best_of_pages(sources, targets, 6).orderBy("source_id", "rank").collect():
            got.setdefault(r["source_id"], []).append((-r["score"], r["target_id"]))
        assert got.keys() == {a for a, x in want.items() if x}
        for a, x in got.items():
            assert [s for s, _ in x] == pytest.approx([s for s, _ in want[a]], abs=1.1e-4)
            assert sum(b not in [i for _, i in want[a]] for _, b in x) <= sum(abs(s - want[a][-1][0]) < 1.1e-4 for s, _ in want[a])
        assert [b for _, b in got[1599]] == [7, 1500, 1501, 1502, 1503, 1504]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [len(x) for x in written] == [4, 4]


def test_phrases_of_targets_are_written_once(spark, monkeypatch):
    """The first phrase that stands in a text as whole words, by blocks of any size."""
    pairs = spark.createDataFrame([(s, t, 0.5, 1) for s in range(1, 9) for t in range(11, 18) if s != 5], "source_id long, target_id long, score double, rank int")
    texts = {1: " a copper pipe ", 2: " copper  pipe ", 3: " coppers pipe by the ¦ old house ", 4: " the old house ", 6: None, 7: " ", 8: " pipe by the "}
    bodies = spark.createDataFrame(list(texts.items()), "post_id long, body string")
    lists = spark.createDataFrame([(t, ["Old House", "Copper Pipe", "Pipe by the"][t % 3 :], ["old house", "copper pipe", "pipe by the"][t % 3 :]) for t in range(11, 17)], "post_id long, phrases array<string>, spelled array<string>").coalesce(1)
    want = {(s, t): next((p for p in ["Old House", "Copper Pipe", "Pipe by the"][t % 3 :] if f" {p.lower()} " in (texts.get(s) or "")), None) for s in range(1, 9) for t in range(11, 17)}
    written, write = [], placing._blocks
    monkeypatch.setattr(placing, "_blocks", lambda *a: written.append(write(*a)) or written[-1])
    for sources in (100, 1):
        monkeypatch.setattr(placing, "SOURCES", sources)
        got = {(r["source_id"], r["target_id"]): r["phrase"] for r in placing.first_placed(pairs, bodies, lists, range(2, 5)).collect()}
        assert got == {k: p for k, p in want.items() if p}
    assert [len(x) for x in written] == [1, 1]


def test_terms_of_pages_as_the_plan_has_them(spark, tmp_path):
    """Rows that share an id or have none, empty and odd texts: the lists, counted where they lie, are the plan's rows."""
    odd = [(1, "One one two's ÉTÉ été the"), (2, None), (3, ""), (4, "x" * 90 + " " + "é" * 60 + " 'quoted-' don't-"), (5, " ".join(f"w{k % 700}z" for k in range(2000))), (6, "same id"), (7, "plain text of words")]
    for name, rows in (("a", odd), ("b", [*odd, (6, "same other id"), (None, "nobody knows"), (None, "nobody")])):
        spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        plan = spark.sql(site.render("postings", site.Spark(spark), f"{tmp_path}/{name}", whole=True))
        lists = site.view(spark, f"{tmp_path}/{name}", "postings")
        columns = ["post_id", "lang_code", "in_scope", "term", "tf"]
        got, want = (sorted(map(tuple, x.select(columns).collect()), key=repr) for x in (lists, plan))
        assert got == want and got
        assert lists.filter("is_own AND post_id = 6").count() == 40
        assert lists.select("post_id").distinct().count() == plan.select("post_id").distinct().count()


def test_weights_meet_terms_without_a_shuffle(spark, monkeypatch):
    """Sources as rows of pages, weights in files of any size: as with a row for each term; terms that don't count are left out."""
    draw = np.random.default_rng(11)
    pages = {p: {int(t): int(n) for t, n in zip(draw.integers(1, 60, 20), draw.integers(1, 5, 20), strict=True)} | {1000 + p: 2} for p in range(120)}
    idf = {t: None if t == 3 else 0.5 + t / 60 for t in range(1, 60)}
    schema = "post_id long, lang_code string, numbers array<long>, tfs array<long>"
    lists = spark.createDataFrame([(p, "ab"[p % 2], list(x), list(x.values())) for p, x in pages.items()] + [(500, "a", [3], [1]), (501, None, [5, 6], [1, 1]), (502, "a", [], [])], schema)
    rows = [(p, "ab"[p % 2], t * (t < 1000), n, idf.get(t, 2.0)) for p, x in pages.items() for t, n in x.items() if t != 3]
    terms = spark.createDataFrame(rows, "post_id long, lang_code string, number long, tf long, idf double")
    weights = spark.createDataFrame(list(idf.items()), "number long, idf double").repartition(3)
    want = sorted(map(tuple, overlap.best_of_pages(terms, lists, 5).collect()))
    for size in (1_000_000, 7):
        monkeypatch.setattr(overlap, "WEIGHTS", size)
        assert sorted(map(tuple, overlap.best_of_lists(lists, lists, weights, 2.0, 5).collect())) == want and len(want) > 500
    assert overlap.best_of_lists(lists.filter("post_id = 500"), lists, weights, None, 5).count() == 0


def test_top_terms_as_the_plan_has_them(spark, tmp_path):
    """Rows that share an id are one page; terms on most pages are left out; no posting goes through a window."""
    texts = [(k, f"common words here number{k} " + " ".join(f"t{k}x{j} " * (j % 4 + 1) for j in range(15))) for k in range(8)] + [(3, "same id other text number3 t3x3"), (None, "nobody knows"), (90, "common words here")]
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan, got = spark.sql(site.render("top_terms", site.Spark(spark), str(tmp_path), whole=True)), site.view(spark, str(tmp_path), "top_terms")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plan.collect()), key=repr) and got.count() > 8
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_needles_stand_in_texts_as_the_plan_has_it(spark, tmp_path):
    """Each row that holds a keyword counts once, rows that share an id too, and nothing but keywords is sent."""
    texts = [(1, "en", " blue car ¦  red house "), (1, "en", " a blue car and a blue car "), (2, "en", " blue ¦  car "), (3, "en", " bluer car "), (4, "de", " blue car "), (5, "en", None), (6, "en", " "), (7, "en", " house "), (None, "en", " blue car ")]
    bodies = spark.createDataFrame(texts, "post_id long, lang_code string, body string").repartition(3)
    needles = [" blue car ", " car ¦  red ", " house ", " nowhere to be seen "]
    want = sorted(((p, a, n) for p, a, b in texts for n in needles if b and n in b), key=repr)
    assert sorted(map(tuple, placing.standing(bodies, needles).collect()), key=repr) == want and len(want) == 7
    assert placing.standing(bodies, []).count() == 0
    rows = [(k, f"some words that number{k} has and others want", "en", "s") for k in (0, 0, 2, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, "the words that number2 has") for k in range(4)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    plan, got = spark.sql(site.render("held", Spark(spark), str(tmp_path), whole=True)), site.view(spark, str(tmp_path), "held")
    assert got.columns == plan.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plan.collect()), key=repr) and got.count()


def test_texts_stay_where_they_lie(spark, monkeypatch):
    """Phrases by brute force, in groups of any size; rows that share an id are one page, wherever they are."""
    draw = np.random.default_rng(17)
    word = lambda: "abcdefgh"[draw.integers(0, 8)]
    texts = [(int(p), f" {' '.join(word() for _ in range(int(draw.integers(0, 12))))} ") for p in [*range(40), 3, 3, 5]]
    phrases = {t: list(dict.fromkeys(" ".join(word() for _ in range(int(draw.integers(2, 5)))) for _ in range(6))) for t in range(100, 130)}
    pairs = [(s, t, 0.5, t - 99) for s in range(40) for t in range(100, 132)]
    want = {(s, t): next((p for p in phrases.get(t, []) if any(f" {p} " in b for k, b in texts if k == s)), None) for s, t, _, _ in pairs}
    schemas = ("source_id long, target_id long, score double, rank int", "post_id long, body string", "post_id long, phrases array<string>, spelled array<string>")
    frames = [spark.createDataFrame(x, y).repartition(3) for x, y in zip((pairs, texts, [(t, [p.upper() for p in x], x) for t, x in phrases.items()]), schemas, strict=True)]
    for sources, targets in ((4000, 50_000), (1, 4)):
        monkeypatch.setattr(placing, "SOURCES", sources)
        monkeypatch.setattr(placing, "TARGETS", targets)
        found = placing.first_placed(*frames, range(2, 5))
        got = {(r["source_id"], r["target_id"]): r["phrase"] for r in found.collect()}
        assert got == {k: p.upper() for k, p in want.items() if p} and found.count() == len(got) > 100
        assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
