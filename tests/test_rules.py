"""Golden values of the rules, builder pages, search source, logs and jobs."""

import hashlib
import json
from datetime import date

import pytest

from weftline.functions import builders, text
from weftline.operators import index, jobs
from weftline.operators.store import KeyedTable
from weftline.plans import rules, site
from weftline.plans.dialect import Spark
from weftline.sources import logs, search

D = Spark()


def values(spark, *expressions):
    return list(spark.sql("SELECT " + ", ".join(f"{x} AS x{k}" for k, x in enumerate(expressions))).first())


def test_counts_and_costs_as_shown(spark):
    counts = [site.format_tokens(f"CAST({n} AS BIGINT)", D) for n in (0, 999, 12480, 1000000, -5)]
    costs = [site.format_cost(f"CAST({x} AS DOUBLE)", D) for x in (0, 0.0234, 1.5, -3)]
    assert values(spark, *counts, *costs) == ["0", "999", "12.5k", "1.00M", "0", "$0.00", "$0.0234", "$1.50", "$0.00"]


def test_keyword_relevance(spark):
    rows = [(False, 0, 0, 0.5), (True, 0, 0, 0.7), (False, 5, 10, 0.64), (True, 10, 10, 0.98), (True, 999, 10, 0.98)]
    for striking, worth, top, want in rows:
        assert spark.sql(f"SELECT {site.keyword_relevance(D)} AS r FROM (SELECT {striking} AS is_striking, CAST({worth} AS DOUBLE) AS opportunity, CAST({top} AS DOUBLE) AS top) t").first()["r"] == pytest.approx(want)


def test_confidence_is_of_clamped_parts(spark):
    for a, b, want in ((0.5, 0.85, 0.64), (1, 0, 0.6), (0, 1, 0.4), (2, -1, 0.6)):
        clamped = [f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST({x} AS DOUBLE)))" for x in (a, b)]
        assert values(spark, f"round(0.6 * {clamped[0]} + 0.4 * {clamped[1]}, 4)")[0] == pytest.approx(want)


def test_settings(spark):
    pages = [rules.clamp(str(n), 500, 20000, 1000) for n in (100, 0, 999999, 700)]
    assert values(spark, *pages) == [500, 1000, 20000, 700]
    assert values(spark, *[rules.fetch_count(str(n)) for n in (15, 10, 200, 400)]) == [29, 21, 306, 400]
    assert values(spark, rules.estimate_tokens("1000", "15", "10")) == [2135]
    assert values(spark, rules.percent("0", "0"), rules.percent("1", "3"), rules.percent("9", "3")) == [100, 33, 100]


@pytest.mark.parametrize(("status", "body", "kind", "action"), [
    (0, "", "network", "failover"), (429, "", "rate_limit", "failover"), (401, "", "auth", "failover"), (402, "", "quota_exceeded", "failover"), (400, "insufficient_quota", "quota_exceeded", "failover"),
    (400, "", "invalid_request", "stop"), (529, "", "overloaded", "retry"), (418, "Overloaded", "overloaded", "retry"), (503, "", "server", "retry"), (404, "", "unknown", "stop"),
])
def test_errors(spark, status, body, kind, action):
    kinds = rules.error_class(str(status), f"'{body}'", D)
    assert values(spark, kinds, rules.next_action(f"({kinds})")) == [kind, action]


def test_provider_details(spark):
    assert values(spark, *[rules.retry_after(f"'{x}'", D) for x in ("120", "-4", "soon", "2.5")]) == [120, 0, None, 2]
    assert values(spark, rules.cooldown("'rate_limit'", "CAST(NULL AS INT)"), rules.cooldown("'rate_limit'", "2"), rules.cooldown("'rate_limit'", "900"), rules.cooldown("'server'", "900"), rules.cooldown("'auth'", "1")) == [30, 5, 300, 10, 0]
    assert values(spark, *[rules.key_state(f"'{k}'") for k in ("rate_limit", "quota_exceeded", "auth", "ok")]) == ["cooling", "exhausted", "errored", "active"]
    assert values(spark, rules.temperature_error("400", "'Temperature is deprecated'", D), rules.temperature_error("500", "'temperature is deprecated'", D), rules.temperature_error("400", "'temperature'", D)) == [True, False, False]
    bodies = [{"error": {"message": "a"}}, {"error": "b"}, {"message": "c"}, {"z": 1}]
    assert values(spark, *[rules.error_message(f"'{json.dumps(b)}'", D) for b in bodies]) == ["a", "b", "c", "Request failed"]
    assert values(spark, rules.reason_label("'bad_status'"), rules.reason_label("'something else'")) == ["applied already, or just being", "something else"]


def test_urls(spark):
    home = "'x.test'"
    own = [rules.is_internal(f"'{u}'", home, D) for u in ("/a", "//y.test/a", "//X.test", "https://X.TEST/b", "https://y.test", "a/b", "")]
    assert values(spark, *own) == [True, False, True, True, False, False, False]
    norm = [rules.normalised(f"'{u}'", home, D) for u in ("/A/b/", "https://X.Test/A/?q=1#z", "http://x.test", "No/Host/")]
    assert values(spark, *norm) == ["x.test/A/b", "x.test/A", "x.test/", "no/host"]


def test_terms_are_cut_by_bytes(spark):
    assert values(spark, site.cut_bytes("'" + "é" * 50 + "'", 80, D), site.cut_bytes("'abc'", 80, D)) == ["é" * 40, "abc"]


def test_phrases_stand_as_whole_words(spark):
    body = site.spelled("'The party, Art class (new) is on.'", D)
    assert values(spark, *[f"contains({body}, ' {p} ')" for p in ("art class", "art", "party", "party art", "class new", "is on")]) == [True, True, True, False, False, True]


def test_contexts_and_cuts(spark):
    long = "x" * 200 + " some anchor " + "y" * 200
    assert values(spark, rules.context(f"'{long}'", "'Some Anchor'", D), rules.context("'a b'", "'b'", D), rules.context("'a b'", "'q'", D)) == ["…" + "x" * 89 + " some anchor " + "y" * 89 + "…", "a b", ""]
    assert values(spark, rules.truncated("' a b  c '", "2", D), rules.truncated("'a b'", "0", D)) == ["a b", "a"]


SECRETS = ["sk-ant-" + "a1" * 12, "sk-" + "b2" * 12, "AIza" + "c3" * 15, "gsk_" + "d4" * 12, "xai-" + "e5" * 12, "pplx-" + "f6" * 12, "hf_" + "g7" * 12, "r8_" + "h8" * 12, "Bearer " + "i9" * 12, "Z" * 48]


@pytest.mark.parametrize("secret", SECRETS)
def test_secrets_are_masked(spark, secret):
    assert values(spark, site._scrubbed(f"'key {secret} end'", D)) == ["key [redacted] end"]


def test_what_is_no_secret_stays(spark):
    for plain in ("123e4567-e89b-12d3-a456-426614174000", "sk-short", "an ordinary message"):
        assert values(spark, site._scrubbed(f"'{plain}'", D)) == [plain]


def test_builder_pages():
    tree = json.dumps([{"elements": [{"settings": {"title": "Head", "color": "red"}}, {"settings": {"editor": "<p>Body</p>"}, "elements": [{"settings": {"text": "deep"}}]}]}])
    assert builders.page_html("elementor", None, tree) == "Head\n<p>Body</p>\ndeep" and builders.tree_html("{no") == ""
    assert builders.page_html("divi", "[et_pb_text a=1]Words[/et_pb_text]") == " Words " and builders.page_html("classic", None) == ""
    assert builders.page_html("gutenberg", '<!-- wp:paragraph {"a":1} --><p>x</p><!-- /wp:paragraph --><!-- wp:spacer /-->') == "<p>x</p>"


def test_links_by_content_system():
    blocks = '<!-- wp:group --><div>good anchor<!-- wp:code --><pre>good anchor</pre><!-- /wp:code --><!-- wp:paragraph --><p>A good anchor.</p><!-- /wp:paragraph --></div><!-- /wp:group -->'
    new, reason = builders.place("gutenberg", blocks, "good anchor", "/t")
    assert reason == "ok" and '<p>A <a href="/t">good anchor</a>.</p>' in new and new.count("<a ") == 1
    assert builders.place("classic", "<p>no</p>", "good anchor", "/t") == ("<p>no</p>", "anchor_not_found") and builders.place("divi", "good anchor", "good anchor", "/t")[1] == "suggest_only"
    assert builders.can_place("elementor", "", "x") and not builders.can_place("classic", "<h2>good anchor</h2>", "good anchor")
    assert builders.place("classic", "x", "", "/t")[1] == "empty_anchor"
    page = 'a <a href="/t" data-link="7">b</a> c'
    assert builders.unwrap(page, "7") == "a b c" and builders.unwrap(page, "8") is None and builders.unwrap(page + page, "7") is None


def test_placements_of_a_table(spark):
    rows = [(1, "classic", "<p>good anchor</p>", "good anchor", "/t"), (2, "divi", None, "x", "/t"), (3, "classic", None, None, None)]
    got = {r["id"]: r["reason"] for r in builders.placements(spark.createDataFrame(rows, "id long, system string, content string, anchor string, href string")).collect()}
    assert got == {1: "ok", 2: "suggest_only", 3: "empty_anchor"}


def test_search_source(spark):
    def client(site, start_date, end_date, start_row, row_limit):
        n = max(0, min(row_limit, 7000 - start_row))
        return json.dumps({"rows": [{"keys": [f"q{start_row + k}", "/p"], "clicks": k, "impressions": 2 * k, "ctr": 0.5, "position": 3.5} for k in range(n)]})

    search.register(spark, client, "fake_search")
    rows = spark.read.format("fake_search").option("site", "s").option("start", "2024-01-01").option("end", "2024-03-31").load()
    assert rows.count() == 7000 and rows.select("query").distinct().count() == 7000
    assert search.sites(json.dumps({"siteEntry": [{"siteUrl": "a", "permissionLevel": "siteOwner"}, {"siteUrl": "b", "permissionLevel": "siteUnverifiedUser"}]})) == ["a"]
    assert search.envelope(200, "{}") == {"ok": True, "body": {}, "error": None} and search.envelope(500, "oops")["error"] == "HTTP 500"
    assert search.envelope(403, '{"error":{"message":"no"}}')["error"] == "no" and search.window(date(2024, 4, 1), 0) == (date(2024, 1, 2), date(2024, 4, 1))


def test_logs(spark, tmp_path):
    line = "[{d}-Jan-2024 10:00:00 UTC] PHP {k}:  object {n} is null in /srv/wp-content/plugins/{p}/a.php on line 3\n"
    (tmp_path / "e.log").write_text("".join(line.format(d=f"{k:02d}", k="Fatal error" if k % 2 else "Warning", n=k, p="one" if k < 7 else "two") for k in range(1, 10)) + "#0 a trace line\n")
    log = logs.read_log(spark, str(tmp_path / "e.log"))
    assert logs.fatals(log).collect()[0][:] == ("2024-01", 5) and [tuple(r) for r in logs.most(log, "culprit").collect()] == [("one", 6), ("two", 3)]
    assert logs.most(log, "signature").first()[1] == 6 or logs.most(log, "signature").count() == 2


def test_summary_store(spark, tmp_path):
    table, made = KeyedTable(spark, f"file://{tmp_path}/s", ["post_id", "words"]), []

    def make(pages):
        made.append(sorted(r["post_id"] for r in pages.collect()))
        return pages.selectExpr("post_id", "upper(content_hash) AS summary")

    pages = lambda rows: spark.createDataFrame(rows, "post_id long, content_hash string")
    for rows, words in (([(1, "a"), (2, "b")], 40), ([(1, "a"), (2, "c")], 40), ([(1, "a"), (2, "c")], 40), ([(1, "a")], 60)):
        jobs.refresh_summaries(table, pages(rows), make, words)
    assert made == [[1, 2], [2], [1]] and {(r["post_id"], r["summary"], r["words"]) for r in table.read().collect()} == {(1, "A", 40), (2, "C", 40), (1, "A", 60)}


def test_states_and_ledger(spark):
    proposals = spark.createDataFrame([(1, "pending"), (2, "applied"), (3, "rejected"), (4, "pending")], "id long, status string")
    events = spark.createDataFrame([(1, 1, "claim"), (1, 2, "apply"), (1, 3, "reject"), (2, 1, "undo"), (2, 2, "reject"), (3, 1, "claim"), (3, 2, "release"), (1, 4, "undo")], "id long, seq int, move string")
    assert {r["id"]: r["status"] for r in jobs.fold_states(proposals, events).collect()} == {1: "approved", 2: "rejected", 3: "rejected", 4: "pending"}
    ledger = spark.createDataFrame([(1, 10, 1, "first", hashlib.md5(b"now").hexdigest(), None), (2, 10, 2, "second", "x", None), (3, 11, 3, "gone", "y", "2024"), (4, 12, 1, "z", "q", None)], "id long, post_id long, seq int, value_before string, value_after_hash string, removed_at string")
    pages = spark.createDataFrame([(10, "now"), (11, "kept")], "post_id long, content string")
    assert {r["post_id"]: r["content"] for r in jobs.restore(pages, ledger).collect()} == {10: "first", 11: "kept"}
    assert {r["id"]: r["outcome"] for r in jobs.undo(ledger, pages).collect()} == {1: "removed", 2: "modified_since", 3: "already_removed", 4: "source_missing"}
    assert {r["id"]: r["outcome"] for r in jobs.undo(ledger, pages, force=True).collect()}[2] == "removed"


def test_definitions_and_recomputing(spark):
    ddl = "CREATE TABLE t (\n id bigint(20) NOT NULL,\n title text,\n PRIMARY KEY (id),\n KEY title (title)\n) x;"
    assert jobs.columns_of(ddl) == ["id", "title"] and jobs.missing_columns(spark.range(1), ddl) == ["title"]
    nodes, edges = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 2), (2, 9)], "source long, target long")
    index._STORED["x", "related"] = "nowhere"
    out = jobs.recompute(nodes, edges, nodes, 1)
    assert not index._STORED and out["broken"].count() == 1 and {r["node"]: r["depth"] for r in out["depth"].collect()} == {1: 0, 2: 1}
    jobs.drop_retired(spark, ["no_such_table"])


def test_stored_tables_follow_their_files(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/a")
    first = index.stored(spark, "t", [f"file://{tmp_path}/a"], lambda: make(1))
    assert index.stored(spark, "t", [f"file://{tmp_path}/a"], lambda: make(2)) == first and made == [1]
    index.forget("t")
    assert index.stored(spark, "t", [f"file://{tmp_path}/a"], lambda: make(3)) != first and made == [1, 3]


def test_marks_of_questions():
    assert all(text.is_question(x) for x in ("Is it?", "Which of the following is right", "Choose the correct one", "？"))
    assert not text.is_question("It is so.")
