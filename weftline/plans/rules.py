"""Plans of the rules around the analytics: eligibility, keys, providers' errors, proposals' states, links of pages, logs.

As in site.py, each plan is stated once. Where a rule's input is no table of the data (a provider's
answer, a log line, a setting), a view makes it from rows that there are.
"""

from __future__ import annotations

from weftline.config import EDGE_STOPWORDS, GENERIC_WORDS, REASONS, EngineConfig
from weftline.plans.dialect import Duck, Spark

C = EngineConfig()
SCOPE = "NOT is_excluded AND NOT is_woo_system AND post_status = 'publish'"
L, N = r"\p{L}", r"\p{Nd}"


def cases(x: str, pairs) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {x} END"


# -- scalar rules ---------------------------------------------------------------------------------


def error_class(status: str, body: str, d: Spark) -> str:
    """Class of a failed call, by status and (lower-case) body, in order of precedence."""
    return (
        f"CASE WHEN {status} = 0 THEN 'network' WHEN {status} = 429 THEN 'rate_limit' WHEN {status} IN (401, 403) THEN 'auth' WHEN {status} = 402 OR {d.has(f'lower({body})', repr('quota'))} THEN 'quota_exceeded'"
        f" WHEN {status} IN (400, 422) THEN 'invalid_request' WHEN {status} = 529 OR {d.has(f'lower({body})', repr('overloaded'))} THEN 'overloaded' WHEN {status} >= 500 THEN 'server' ELSE 'unknown' END"
    )


def retryable(kind: str) -> str:
    return f"({kind} IN ('network', 'rate_limit', 'overloaded', 'server'))"


def fails_over(kind: str) -> str:
    return f"({kind} IN ('network', 'rate_limit', 'auth', 'quota_exceeded'))"


def next_action(kind: str) -> str:
    return f"(CASE WHEN {fails_over(kind)} THEN 'failover' WHEN {retryable(kind)} THEN 'retry' ELSE 'stop' END)"


def error_message(body: str, d: Spark) -> str:
    return f"coalesce({d.json(body, 'error.message')}, CASE WHEN {d.json(body, 'error')} NOT LIKE '{{%' THEN {d.json(body, 'error')} END, {d.json(body, 'message')}, 'Request failed')"


def temperature_error(status: str, message: str, d: Spark) -> str:
    words = " OR ".join(d.has(f"lower({message})", repr(w)) for w in ("deprecated", "not supported", "unsupported", "unexpected", "not permitted", "cannot be"))
    return f"({status} = 400 AND {d.has(f'lower({message})', repr('temperature'))} AND ({words}))"


def retry_after(header: str, d: Spark) -> str:
    """Seconds of a numeric header, 0 at least; else null."""
    return f"CASE WHEN {d.like(header, '^ *-?[0-9]+([.][0-9]+)? *$')} THEN greatest(0, CAST(floor({d.try_double(f'trim({header})')}) AS INT)) END"


def cooldown(kind: str, after: str) -> str:
    return f"(CASE WHEN {kind} = 'rate_limit' THEN least(300, greatest(5, coalesce({after}, 30))) WHEN {kind} IN ('server', 'overloaded', 'network') THEN 10 ELSE 0 END)"


def key_state(kind: str) -> str:
    return f"(CASE WHEN {kind} IN ('rate_limit', 'server', 'overloaded', 'network') THEN 'cooling' WHEN {kind} = 'quota_exceeded' THEN 'exhausted' WHEN {kind} = 'auth' THEN 'errored' ELSE 'active' END)"


def fetch_count(n: str) -> str:
    return f"CAST(least(400, ceil(CAST(1.5 AS DOUBLE) * {n}) + 6) AS INT)"


def estimate_tokens(page: str, candidates: str, words: str) -> str:
    return f"CAST(floor(420 + ({page} + {candidates} * (8 + {words})) * CAST(1.35 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT)"


def percent(done: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN 100 ELSE CAST(least(100, floor(100 * {done} / CAST({total} AS DOUBLE) + CAST(0.5 AS DOUBLE))) AS INT) END)"


def truncated(x: str, n: str, d: Spark) -> str:
    """The first n words (one at least)."""
    return d.join_words(d.slice(d.split(f"trim({x})", r"\s+"), "1", f"greatest(1, {n})"))


def is_internal(url: str, home: str, d: Spark) -> str:
    """A path, or a URL of the home's host; //host counts by its host."""
    host = f"lower({d.match(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)', 1)})"
    return f"(CASE WHEN {url} LIKE '//%' THEN {host} = {home} WHEN {url} LIKE '/%' THEN true ELSE {host} <> '' AND {host} = {home} END)"


def normalised(url: str, home: str, d: Spark) -> str:
    """Host and path: absolute, host in lower case, path as written without slashes at its end, no query; without a host the URL in lower case."""
    whole = f"(CASE WHEN {url} LIKE '/%' AND {url} NOT LIKE '//%' THEN concat('https://', {home}, {url}) ELSE {url} END)"
    host = f"lower({d.match(whole, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)', 1)})"
    path = d.replace(d.match(whole, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), "/+$", "")
    return f"(CASE WHEN {host} = '' THEN lower({d.replace(url, '/+$', '')}) ELSE concat({host}, CASE WHEN {path} = '' THEN '/' ELSE {path} END) END)"


def reason_label(x: str) -> str:
    return cases(x, REASONS)


def clamp(x: str, low: int, high: int, default: int) -> str:
    """A setting within its limits; what isn't positive is the default."""
    return f"(CASE WHEN {x} <= 0 THEN {default} ELSE least({high}, greatest({low}, {x})) END)"


def context(text: str, anchor: str, d: Spark) -> str:
    """The anchor's first place with 90 characters on either side, and dots where text was left out."""
    at = f"instr(lower({text}), lower({anchor}))"
    begin, n = f"greatest(1, {at} - 90)", f"length({anchor})"
    end = f"least(length({text}), {at} + {n} - 1 + 90)"
    return f"(CASE WHEN {at} = 0 THEN '' ELSE concat(CASE WHEN {begin} > 1 THEN '…' ELSE '' END, trim(substring({text}, CAST({begin} AS INT), CAST({end} - {begin} + 1 AS INT))), CASE WHEN {end} < length({text}) THEN '…' ELSE '' END) END)"


# -- views ----------------------------------------------------------------------------------------

VIEWS = {
    "v_answers": (
        ("events",),
        lambda d: f"""SELECT event_id AS id, user_id % 7 + 1 AS key_id, CASE event_id % 12 WHEN 0 THEN 0 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 402 WHEN 5 THEN 400 WHEN 6 THEN 422 WHEN 7 THEN 529 WHEN 8 THEN 503 WHEN 9 THEN 418 WHEN 10 THEN 500 ELSE 200 END AS status,
            CASE event_id % 5 WHEN 0 THEN '{{"error":{{"message":"Insufficient_Quota left"}}}}' WHEN 1 THEN '{{"error":"Overloaded, try later"}}' WHEN 2 THEN '{{"message":"temperature is not supported"}}' WHEN 3 THEN '{{"error":{{"message":"temperature cannot be set"}}}}' ELSE '{{"x":1}}' END AS body,
            CASE user_id % 5 WHEN 0 THEN '120' WHEN 1 THEN 'Wed, 21 Oct' WHEN 2 THEN '-4' WHEN 3 THEN '2' END AS retry_header FROM events""",
    ),
    "answers": (
        ("v_answers",),
        lambda d: f"SELECT *, {retryable('kind')} AS retryable, {fails_over('kind')} AS fails_over, {next_action('kind')} AS next_action, {error_message('body', d)} AS message, {retry_after('retry_header', d)} AS retry_after FROM (SELECT *, {error_class('status', 'body', d)} AS kind FROM v_answers WHERE status <> 200) t",
    ),
    "v_applied": (
        ("v_suggestions",),
        lambda d: "SELECT id, source_post_id, target_post_id, status, CASE id % 7 WHEN 0 THEN 'suggest_only' WHEN 1 THEN 'modified_since' WHEN 2 THEN 'anchor_not_found' WHEN 3 THEN '' WHEN 4 THEN 'odd_code' ELSE 'bad_status' END AS reason, id % 3 = 0 AS ok FROM v_suggestions",
    ),
    "anchors": (
        ("pages",),
        lambda d: f"SELECT page_id, url, k, {d.item('links', 'k')} AS tag FROM (SELECT page_id, url, links, {d.explode}({d.numbers('1', f'CAST({d.size('links')} AS INT)')}) AS k FROM (SELECT page_id, url, {d.all_matches('html', r'(?is)<a [^>]*>.*?</a>')} AS links FROM pages) a) b",
    ),
    "links": (
        ("anchors",),
        lambda d: f"""SELECT page_id, url, k, href, trim({d.replace(d.replace('inner_html', '<[^>]*>', ''), '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+', ' ')}) AS anchor FROM (SELECT page_id, url, k, trim(replace(replace({d.match('tag', '(?is)^<a [^>]*?href=([^> ]*)', 1)}, '"', ''), '''', '')) AS href, {d.match('tag', '(?is)^<a [^>]*>(.*)</a>', 1)} AS inner_html FROM anchors) t
            WHERE href <> '' AND NOT {d.like('lower(href)', '^(#|javascript:|mailto:|tel:)')}""",
    ),
    "homes": (("pages",), lambda d: f"SELECT page_id, url, lower({d.match('url', '^[a-z]+://([^/?#:]*)', 1)}) AS home FROM pages"),
    "edges": (
        ("links", "homes"),
        lambda d: f"""SELECT l.page_id AS source_id, l.k, l.href, l.anchor, {normalised('l.href', 'h.home', d)} AS target_norm, CASE WHEN l.href LIKE '/%' THEN concat({d.match('h.url', '^[a-z]+://[^/?#]*')}, l.href) ELSE l.href END AS target_url
            FROM links l JOIN homes h ON h.page_id = l.page_id WHERE {is_internal('l.href', 'h.home', d)}""",
    ),
    "log_lines": (
        ("events",),
        lambda d: f"""SELECT event_id AS id, concat('[', substring(CAST(ts AS {d.text}), 1, 10), '] ', CASE WHEN event_type = 'error' THEN 'PHP Fatal error: ' ELSE 'PHP Notice: ' END, 'no object ', CAST(user_id AS {d.text}), ' in /srv/plugins/', event_type, CAST(user_id % 5 AS {d.text}), '/main.php on line ', CAST(event_id % 90 AS {d.text})) AS line FROM events""",
    ),
    "picks": (
        ("v_index",),
        lambda d: f"""SELECT post_id AS id, post_id, concat(CASE post_id % 3 WHEN 0 THEN '```json ' WHEN 1 THEN 'Here: ' ELSE '' END, CASE WHEN post_id % 2 = 0 THEN '{{"links":' ELSE '' END, '[{{"n":', CAST(post_id % 7 AS {d.text}), ',"anchor":"', {d.match('parsed_text', '[a-z]{3,} [a-z]{3,}')}, '"}},{{"n":', CAST(post_id % 4 + 1 AS {d.text}),
            ',"anchor":"one more","confidence":1.7}},{{"n":', CAST(post_id % 7 AS {d.text}), ',"anchor":"', {d.match('parsed_text', '[a-z]{3,} [a-z]{3,}')}, '"}}]', CASE WHEN post_id % 2 = 0 THEN '}}' ELSE '' END, CASE WHEN post_id % 3 = 0 THEN ' ```' ELSE '' END) AS reply FROM v_index""",
    ),
    "parsed_picks": (
        ("picks",),
        lambda d: f"""SELECT id, post_id, k, CAST({d.json('item', 'n')} AS INT) AS n, {d.json('item', 'anchor')} AS anchor, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce({d.try_double(d.json('item', 'confidence'))}, CAST(0.7 AS DOUBLE)))) AS confidence
            FROM (SELECT id, post_id, k, {d.item('items', 'k')} AS item FROM (SELECT id, post_id, items, {d.explode}({d.numbers('1', 'CAST(' + d.size('items') + ' AS INT)')}) AS k FROM (SELECT id, post_id, {d.all_matches(d.match('reply', '(?s)' + chr(92) + '[.*' + chr(92) + ']'), '[{][^{}]*[}]')} AS items FROM picks) a) b) c""",
    ),
}

# -- plans ----------------------------------------------------------------------------------------

PLANS = {
    "eligibility": (
        ("v_index", "postings", "v_keywords"),
        lambda d: f"""SELECT a.*, b.corpus, c.keyword_targets FROM (SELECT count(*) AS pages, sum(CASE WHEN {SCOPE} THEN 1 ELSE 0 END) AS in_scope, sum(CASE WHEN NOT is_excluded AND post_status = 'publish' THEN 1 ELSE 0 END) AS scan_sources,
            sum(CASE WHEN {SCOPE} AND post_type IN ('post', 'page') THEN 1 ELSE 0 END) AS targets, sum(CASE WHEN NOT is_excluded AND post_status = 'publish' THEN 1 ELSE 0 END) AS rank_listed FROM v_index) a, (SELECT count(DISTINCT post_id) AS corpus FROM postings) b,
            (SELECT count(*) AS keyword_targets FROM v_keywords k JOIN (SELECT post_id FROM v_index WHERE {SCOPE}) i ON i.post_id = k.post_id WHERE k.post_id > 0) c""",
    ),
    "keyset_page": (("v_index",), lambda d: "SELECT post_id, title FROM v_index WHERE NOT is_excluded AND post_status = 'publish' AND post_id > 60 ORDER BY post_id LIMIT 15"),
    "keyset_ledger": (("v_suggestions",), lambda d: "SELECT id, source_post_id, target_post_id FROM (SELECT id, source_post_id, target_post_id, row_number() OVER (PARTITION BY id ORDER BY source_post_id, target_post_id) AS rn FROM v_suggestions WHERE status = 'applied') t WHERE rn = 1 AND id > 1000 ORDER BY id LIMIT 100"),
    "filter_ids": (("rescored",), lambda d: "SELECT id, source_post_id, target_post_id, row_number() OVER (ORDER BY confidence DESC, id DESC, source_post_id, target_post_id) AS place FROM rescored WHERE status = 'pending' AND engine = 'tfidf'"),
    "source_labels": (("v_suggestions",), lambda d: f"SELECT {cases('engine', (('llm', 'ai'), ('keyword', 'gsc'), ('tfidf', 'content')))} AS label, count(*) AS n FROM v_suggestions GROUP BY engine"),
    "orphan_list": (("scope", "v_link_graph"), lambda d: f"SELECT s.post_id FROM scope s {d.anti()} v_link_graph g ON g.target_post_id = s.post_id AND g.location = 'content' ORDER BY s.post_id LIMIT 50"),
    "dead_end_list": (("scope", "outgoing"), lambda d: f"SELECT s.post_id FROM scope s {d.anti()} outgoing o ON o.post_id = s.post_id ORDER BY s.post_id LIMIT 50"),
    "broken_list": (("v_link_graph", "v_index"), lambda d: f"SELECT g.source_post_id, g.id, g.target_post_id FROM v_link_graph g {d.anti()} (SELECT post_id FROM v_index WHERE post_status = 'publish') i ON i.post_id = g.target_post_id ORDER BY g.source_post_id, g.id, g.target_post_id LIMIT 50"),
    "broken_count": (("v_link_graph", "v_index"), lambda d: f"SELECT count(*) AS broken FROM v_link_graph g {d.anti()} (SELECT post_id FROM v_index WHERE post_status = 'publish') i ON i.post_id = g.target_post_id"),
    "bulk_dropped": (("events",), lambda d: "SELECT least(50, count(*)) AS kept, greatest(0, count(*) - 50) AS dropped FROM (SELECT DISTINCT user_id - 3 AS id FROM events WHERE user_id - 3 > 0) t"),
    "bulk_batches": (("v_suggestions",), lambda d: f"SELECT {d.intdiv('place - 1', '10')} AS batch, min(id) AS first_id, count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM v_suggestions WHERE status = 'applied') a) t GROUP BY {d.intdiv('place - 1', '10')}"),
    "apply_reasons": (("v_applied",), lambda d: f"SELECT reason, {reason_label('reason')} AS label, count(*) AS n FROM (SELECT CASE WHEN reason = '' THEN 'unknown' ELSE reason END AS reason FROM v_applied WHERE NOT ok) t GROUP BY reason ORDER BY n DESC, reason"),
    "apply_summary": (("v_applied",), lambda d: "SELECT sum(CASE WHEN ok THEN 1 ELSE 0 END) AS applied, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS failed FROM v_applied"),
    "keyword_reload": (("v_keywords",), lambda d: "SELECT source, count(*) AS n, sum(impressions) AS impressions FROM (SELECT source, impressions FROM v_keywords WHERE source <> 'csv' UNION ALL SELECT 'csv' AS source, impressions * 3 AS impressions FROM v_keywords WHERE source = 'csv' AND id % 2 = 0) t GROUP BY source"),
    "key_leases": (
        ("v_provider_keys",),
        lambda d: """SELECT id, provider, state, by_use, by_priority FROM (SELECT id, provider, CASE WHEN state = 'cooling' THEN 'active' ELSE state END AS state, row_number() OVER (PARTITION BY provider ORDER BY last_used_seq ASC NULLS FIRST, id) AS by_use,
            row_number() OVER (PARTITION BY provider ORDER BY priority, last_used_seq ASC NULLS FIRST, id) AS by_priority FROM v_provider_keys WHERE enabled AND capability = 'chat' AND (state = 'active' OR (state = 'cooling' AND id % 2 = 0)) AND id NOT IN (3, 17)) t""",
    ),
    "key_listing": (("v_provider_keys",), lambda d: "SELECT provider, id, state, enabled, (enabled AND state = 'active') AS healthy FROM v_provider_keys ORDER BY provider, id"),
    "key_toggles": (("v_provider_keys",), lambda d: "SELECT id, provider, CASE WHEN id % 3 = 0 THEN NOT enabled ELSE enabled END AS enabled, CASE WHEN id % 3 = 0 THEN 'active' ELSE state END AS state FROM v_provider_keys WHERE id % 11 <> 0 UNION ALL SELECT max(id) + 1 AS id, 'openai' AS provider, true AS enabled, 'active' AS state FROM v_provider_keys"),
    "key_fold": (
        ("answers",),
        lambda d: f"SELECT key_id, kind, state, cooldown, next_action FROM (SELECT key_id, kind, {key_state('kind')} AS state, {cooldown('kind', 'retry_after')} AS cooldown, next_action, row_number() OVER (PARTITION BY key_id ORDER BY id DESC) AS rn FROM answers) t WHERE rn = 1",
    ),
    "answer_classes": (("answers",), lambda d: "SELECT status, kind, retryable, fails_over, next_action, message, retry_after, count(*) AS n FROM answers GROUP BY status, kind, retryable, fails_over, next_action, message, retry_after"),
    "temperature_errors": (("answers",), lambda d: f"SELECT id, {temperature_error('status', 'message', d)} AS about_temperature FROM answers"),
    "preflight_estimates": (("v_index",), lambda d: f"SELECT post_id, CAST(ceil(length(parsed_text) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens_in, 1024 AS tokens_out, {fetch_count('post_id % 300 + 1')} AS fetched, {estimate_tokens('least(1000, length(title))', '15', '10')} AS estimate FROM v_index"),
    "setting_clamps": (("v_index",), lambda d: f"SELECT post_id, {clamp('post_id * 40 - 100', 500, 20000, 1000)} AS page_words, {clamp('post_id - 3', 5, 200, 15)} AS candidates, least(30, greatest(0, post_id - 5)) AS candidate_words, {clamp('post_id - 9', 25, 200, 40)} AS summary_words FROM v_index"),
    "model_choice": (
        ("v_provider_keys",),
        lambda d: "SELECT id, coalesce(nullif(trim(CASE WHEN id % 4 = 0 THEN ' own-model ' ELSE '' END), ''), nullif(CASE WHEN id % 3 = 0 THEN 'configured' ELSE '' END, ''), CASE provider WHEN 'openai' THEN 'gpt-4o-mini' WHEN 'anthropic' THEN 'claude-haiku' ELSE 'gemini-1.5-flash' END) AS model, trim(CASE WHEN id % 2 = 0 THEN ' typed ' ELSE 'listed' END) AS chosen FROM v_provider_keys",
    ),
    "spend_by_scope": (("spend",), lambda d: f"SELECT scope, CAST(ceil(round(sum(cents), 3)) AS BIGINT) AS cents FROM (SELECT 'all' AS scope, cents FROM spend UNION ALL SELECT provider AS scope, cents FROM spend UNION ALL SELECT concat('key ', CAST(key_id AS {d.text})) AS scope, cents FROM spend) t GROUP BY scope"),
    "usage_ticker": (("spend",), lambda d: f"SELECT concat(CAST(count(*) AS {d.text}), ' requests, ', CAST(sum(tokens_in + tokens_out) AS {d.text}), ' tokens') AS ticker FROM spend WHERE operation <> 'error'"),
    "usage_ordered": (("spend",), lambda d: "SELECT provider, model, operation, count(*) AS requests, round(sum(cents), 2) AS cents FROM spend GROUP BY provider, model, operation ORDER BY cents DESC, requests DESC, provider, operation"),
    "claims": (("v_suggestions",), lambda d: "SELECT id, source_post_id, target_post_id, status AS before, CASE WHEN status IN ('pending', 'approved') THEN 'applying' ELSE status END AS after FROM v_suggestions WHERE id % 5 = 0"),
    "status_guarded": (
        ("v_suggestions",),
        lambda d: "SELECT id, source_post_id, target_post_id, CASE WHEN wanted IN ('approved', 'rejected', 'pending') AND status IN ('applied', 'applying') THEN status WHEN wanted = 'undo' THEN CASE WHEN status = 'applied' THEN 'approved' ELSE status END WHEN wanted = 'release' THEN CASE WHEN status = 'applying' THEN 'approved' ELSE status END ELSE wanted END AS status FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'undo' WHEN 3 THEN 'release' ELSE 'pending' END AS wanted FROM v_suggestions) t",
    ),
    "ledger_restored": (
        ("v_index", "v_suggestions"),
        lambda d: "SELECT i.post_id, md5(coalesce(l.value_before, i.parsed_text)) AS content_hash, (l.value_before IS NOT NULL) AS restored FROM v_index i LEFT JOIN (SELECT source_post_id, concat('before ', min(anchor_text)) AS value_before FROM v_suggestions WHERE status = 'applied' GROUP BY source_post_id) l ON l.source_post_id = i.post_id",
    ),
    "forgotten_postings": (("postings",), lambda d: "SELECT post_id, count(*) AS terms FROM postings WHERE post_id NOT IN (3, 5, 8) GROUP BY post_id"),
    "write_safety": (("pages",), lambda d: f"SELECT page_id, content_system, CASE WHEN content_system IN ('gutenberg', 'classic') THEN 'auto' ELSE 'suggest_only' END AS write_safety FROM (SELECT page_id, CASE WHEN {d.has('html', repr('[et_pb_'))} THEN 'divi' WHEN {d.has('html', repr('[vc_row'))} THEN 'wpbakery' WHEN {d.has('html', repr('<!-- wp:'))} THEN 'gutenberg' ELSE 'classic' END AS content_system FROM pages) t"),
    "languages": (("documents",), lambda d: "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR lang IS NULL OR lang = '' THEN 'und' ELSE substring(concat(lang, '-regional-variant'), 1, 10) END AS lang_code FROM documents"),
    "single_words": (
        ("v_index",),
        lambda d: f"SELECT post_id, word, row_number() OVER (PARTITION BY post_id ORDER BY {d.octets('word')} DESC, word) AS place FROM (SELECT DISTINCT post_id, {d.explode}({d.all_matches('title', '[' + chr(92) + 'p{L}]{6,}')}) AS word FROM v_index) t WHERE lower(word) NOT IN ({', '.join(repr(w) for w in (*EDGE_STOPWORDS, *GENERIC_WORDS))})",
    ),
    "anchor_contexts": (("placed", "v_index"), lambda d: f"SELECT p.source_id, p.target_id, md5({context('i.parsed_text', 'p.phrase', d)}) AS context_hash, length({context('i.parsed_text', 'p.phrase', d)}) AS n FROM (SELECT * FROM placed WHERE rank <= 5) p JOIN v_index i ON i.post_id = p.source_id"),
    "truncated_words": (("v_index",), lambda d: f"SELECT post_id, md5({truncated('parsed_text', '30', d)}) AS head_hash, substring(title, 1, 255) AS title FROM v_index WHERE parsed_text <> ''"),
    "prompt_lines": (
        ("related", "v_index", "top_terms"),
        lambda d: f"SELECT r.source_id, r.rank AS n, concat(CAST(r.rank AS {d.text}), '. ', i.title, CASE WHEN t.words IS NULL THEN '' ELSE concat(' (', t.words, ')') END) AS line FROM (SELECT * FROM related WHERE rank <= 15) r JOIN (SELECT post_id, title FROM v_index) i ON i.post_id = r.target_id LEFT JOIN top_terms t ON t.post_id = r.target_id",
    ),
    "system_prompts": (("v_index",), lambda d: f"SELECT post_id, concat('Choose at most ', CAST(post_id % 8 + 1 AS {d.text}), ' anchors of {C.min_anchor_words} to {C.max_anchor_words} words that stand in the text as written.') AS prompt FROM v_index"),
    "pick_validation": (
        ("parsed_picks", "related", "bodies"),
        lambda d: f"""SELECT id, post_id, n, target_id, anchor, confidence FROM (SELECT p.*, r.target_id, row_number() OVER (PARTITION BY p.id, r.target_id ORDER BY p.k) AS nth, b.body FROM parsed_picks p JOIN (SELECT * FROM related WHERE rank <= 15) r ON r.source_id = p.post_id AND r.rank = p.n JOIN bodies b ON b.post_id = p.post_id
            WHERE p.n >= 1 AND {d.octets('p.anchor')} >= 4) t WHERE nth = 1 AND contains(body, concat(' ', lower(anchor), ' '))"""
        if isinstance(d, Duck)  # in Spark no text goes through the window
        else f"""SELECT id, post_id, n, target_id, anchor, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, target_id ORDER BY k) AS nth FROM (SELECT p.*, r.target_id, contains(b.body, concat(' ', lower(p.anchor), ' ')) AS holds FROM parsed_picks p
            JOIN (SELECT * FROM related WHERE rank <= 15) r ON r.source_id = p.post_id AND r.rank = p.n JOIN bodies b ON b.post_id = p.post_id WHERE p.n >= 1 AND {d.octets('p.anchor')} >= 4) j) t WHERE nth = 1 AND holds""",
    ),
    "reply_picks": (("parsed_picks",), lambda d: "SELECT id, k, n, anchor, confidence FROM parsed_picks"),
    "extract_links": (("links",), lambda d: "SELECT page_id, k, href, anchor FROM links"),
    "internal_links": (("edges",), lambda d: "SELECT source_id, k, target_norm FROM edges"),
    "link_graph_rebuild": (
        ("edges", "pages"),
        lambda d: """SELECT source_id, k, target_id, target_norm, anchor, CASE WHEN row_number() OVER (PARTITION BY source_id, CASE WHEN target_id > 0 THEN 'p' ELSE 'u' END, target_id, CASE WHEN target_id > 0 THEN '' ELSE target_norm END ORDER BY k) = 1 THEN 1 ELSE 0 END AS is_first_link, (target_id = 0) AS is_broken FROM
            (SELECT e.source_id, e.k, e.target_norm, e.anchor, coalesce(a.page_id, b.page_id, 0) AS target_id FROM edges e LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) a ON a.url = e.target_url LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) b ON b.url = concat(e.target_url, '/')) t""",
    ),
    "links_hash": (("links",), lambda d: f"SELECT page_id, md5(concat('|', {d.join_list('href', 'k')})) AS links_hash, count(*) AS n FROM links GROUP BY page_id"),
    "shortcode_text": (("pages",), lambda d: f"SELECT page_id, md5({d.replace('html', chr(92) + '[/?[^' + chr(92) + ']]+' + chr(92) + ']', ' ')}) AS text_hash FROM pages"),
    "log_fatals": (("log_lines",), lambda d: f"SELECT {d.match('line', '[0-9]{4}-[0-9]{2}')} AS month, count(*) AS fatals FROM log_lines WHERE {d.has('line', repr('Fatal error'))} GROUP BY {d.match('line', '[0-9]{4}-[0-9]{2}')}"),
    "log_culprits": (("log_lines",), lambda d: f"SELECT culprit, count(*) AS n FROM (SELECT {d.match('line', 'plugins/([^/]+)/', 1)} AS culprit FROM log_lines WHERE {d.has('line', repr('Fatal error'))}) t GROUP BY culprit ORDER BY n DESC, culprit LIMIT 15"),
    "log_messages": (("log_lines",), lambda d: f"SELECT signature, count(*) AS n FROM (SELECT {d.replace(d.match('line', 'error: (.*)$', 1), '[0-9]+', 'N')} AS signature FROM log_lines WHERE {d.has('line', repr('Fatal error'))}) t GROUP BY signature ORDER BY n DESC, signature LIMIT 15"),
    "table_inventory": (
        ("v_index",),
        lambda d: "SELECT name, CASE WHEN wanted AND NOT present THEN 'missing' WHEN present AND retired THEN 'retired' WHEN present AND NOT wanted THEN 'unknown' ELSE 'fine' END AS verdict FROM (SELECT name, max(wanted) AS wanted, max(present) AS present, max(retired) AS retired FROM (SELECT 'index' AS name, true AS wanted, (SELECT count(*) FROM v_index) > 0 AS present, false AS retired UNION ALL SELECT 'suggestions', true, false, false UNION ALL SELECT 'embeddings', false, true, true UNION ALL SELECT 'other', false, true, false) t GROUP BY name) u",
    ),
    "prefixed_settings": (("part",), lambda d: "SELECT p_name FROM part WHERE p_name LIKE 's%'"),
    "type_scope": (("v_index",), lambda d: f"SELECT post_type, count(*) AS n FROM v_index WHERE {SCOPE} AND post_type IN ('post', 'page') GROUP BY post_type"),
    "progress": (("v_index", "v_link_graph"), lambda d: f"SELECT total, done, {percent('done', 'total')} AS percent, CASE WHEN done >= total THEN 'complete' ELSE 'running' END AS state FROM (SELECT count(*) AS total, count(o.post_id) AS done FROM v_index i LEFT JOIN (SELECT DISTINCT source_post_id AS post_id FROM v_link_graph) o ON o.post_id = i.post_id) t"),
    "known_secrets": (("documents",), lambda d: f"SELECT doc_id, {d.octets('clean')} AS n, md5(clean) AS text_hash FROM (SELECT doc_id, replace(text, substring(text, 11, 12), '[redacted]') AS clean FROM documents WHERE length(text) > 40 AND trim(substring(text, 11, 12)) = substring(text, 11, 12)) t"),
}
VIEWS["top_terms"] = (
    ("postings", "site_wide"),
    lambda d: f"SELECT post_id, {d.join_list('term', 'place', ', ')} AS words FROM (SELECT {'' if isinstance(d, Duck) else '/*+ BROADCAST(s) */ '}p.post_id, p.term, row_number() OVER (PARTITION BY p.post_id ORDER BY p.tf DESC, p.term) AS place FROM postings p {d.anti()} site_wide s ON s.term = p.term) t WHERE place <= 10 GROUP BY post_id",
)
