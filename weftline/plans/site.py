"""Site analytics as declarative plans: each is stated once and rendered for Spark SQL or DuckDB.

A plan is a function of a dialect; it names what it stands on (tables and views below), its own steps
and its result. Everything is left to Catalyst: filters and columns reach the scans, aggregates
combine before they shuffle, per-group limits become window group limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import CLICK_RATES, DEFAULT_PRICE, EDGE_STOPWORDS, GENERIC_ANCHORS, NOISE_WORDS, PRICES, SECRET_SHAPES, STOPWORDS, EngineConfig
from weftline.functions import text
from weftline.operators import graph, index, overlap, placing
from weftline.plans import rules
from weftline.plans.dialect import Duck, Spark

C = EngineConfig()
#: Related pages that are kept for each page: as many as any query takes.
RELATED = max(50, 4 * C.max_suggestions + 10)
TABLES = ("documents", "lineitem", "part", "supplier", "events", "benchmark", "pages")
View = tuple[tuple[str, ...], Callable[[Spark], str]]


def words_in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def spaced(d: Spark, x: str = "text") -> str:
    return f"trim({d.replace(x, chr(92) + 's+', ' ')})"


def click_rate(p: str) -> str:
    """Click-through rate at a rank: a table, a slope to rank 20, a floor."""
    i = f"greatest(1, CAST(floor({p} + 0.5) AS INT))"
    table = " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in enumerate(CLICK_RATES, 1))
    return f"(CASE {i} {table} ELSE CASE WHEN {i} <= 20 THEN greatest(CAST(0.008 AS DOUBLE), CAST(0.025 AS DOUBLE) - ({i} - 10) * CAST(0.0017 AS DOUBLE)) ELSE CAST(0.005 AS DOUBLE) END END)"


def opportunity(impressions: str, p: str) -> str:
    return f"({impressions} * greatest(CAST(0 AS DOUBLE), CAST({CLICK_RATES[2]} AS DOUBLE) - {click_rate(p)}) * CASE WHEN {p} <= 20 THEN CAST(1 AS DOUBLE) ELSE 20 / {p} END)"


def naturalness(a: str, d: Spark) -> str:
    n, c = d.size(d.split(f"trim({a})", r"\s+")), f"length({a})"
    return (
        f"(CASE WHEN trim({a}) = '' THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.55 AS DOUBLE) + CASE WHEN {n} BETWEEN 2 AND 4 THEN 0.20 WHEN {n} >= 5 THEN -0.15 ELSE 0 END"
        f" + CASE WHEN {c} BETWEEN 8 AND 60 THEN 0.15 ELSE 0 END + CASE WHEN {c} < 5 THEN -0.30 ELSE 0 END + CASE WHEN {c} > 70 THEN -0.25 ELSE 0 END)), 4) END)"
    )


def price(side: int, full: str, model: str, d: Spark) -> str:
    """The first entry that the full name contains, or that contains the model."""
    cases = " ".join(f"WHEN {d.has(full, repr(k))} OR ({model} <> '' AND {d.has(repr(k), model)}) THEN CAST({v[side]} AS DOUBLE)" for k, *v in PRICES)
    return f"(CASE {cases} ELSE CAST({DEFAULT_PRICE[side]} AS DOUBLE) END)"


def anchor_type(a: str, d: Spark) -> str:
    x = f"trim(lower({a}))"
    return f"(CASE WHEN {x} = '' THEN 'generic' WHEN {d.like(x, '^https?://')} OR {d.has(x, repr('www.'))} THEN 'naked' WHEN {x} IN ({words_in(GENERIC_ANCHORS)}) THEN 'generic' ELSE 'partial' END)"


def cut_bytes(x: str, n: int, d: Spark) -> str:
    """The longest beginning of whole characters that n bytes hold."""
    fits = d.filter(d.numbers("1", str(n)), "k", f"{d.octets(f'left({x}, CAST(k AS INT))')} <= {n}")
    return f"(CASE WHEN {d.octets(x)} <= {n} THEN {x} ELSE left({x}, CAST({d.greatest_of(fits)} AS INT)) END)"


def spelled(x: str, d: Spark) -> str:
    """Lower-case text in which a phrase, so spelled, stands between spaces only where it stands as whole words, as written."""
    return f"concat(' ', {d.replace(f'lower({x})', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd} ]+', ' ¦ ')}, ' ')"


def keyword_relevance(d: Spark) -> str:
    """Of a keyword with is_striking and opportunity, among which top is the highest."""
    share = "CASE WHEN top > 0 THEN CAST(0.28 AS DOUBLE) * least(CAST(1 AS DOUBLE), opportunity / top) ELSE 0 END"
    return f"round(least(CAST(0.98 AS DOUBLE), CAST(0.5 AS DOUBLE) + CASE WHEN is_striking THEN CAST(0.2 AS DOUBLE) ELSE 0 END + {share}), 4)"


def format_tokens(n: str, d: Spark) -> str:
    """Counts as 999, 12.5k or 1.00M; none is negative."""
    return f"(CASE WHEN {n} < 1000 THEN CAST(greatest(0, {n}) AS {d.text}) WHEN {n} < 1000000 THEN concat({d.decimals(f'{n} / CAST(1000 AS DOUBLE)', 1)}, 'k') ELSE concat({d.decimals(f'{n} / CAST(1000000 AS DOUBLE)', 2)}, 'M') END)"


def format_cost(x: str, d: Spark) -> str:
    """Dollars with two places, or four under a dollar; none are negative."""
    return f"concat('$', CASE WHEN {x} > 0 AND {x} < 1 THEN {d.decimals(x, 4)} ELSE {d.decimals(f'greatest(CAST(0 AS DOUBLE), {x})', 2)} END)"


SCOPE = "NOT is_excluded AND NOT is_woo_system AND post_status = 'publish'"

#: Views: what each stands on, and its query.
VIEWS: dict[str, View] = {
    "v_index": (
        ("documents",),
        lambda d: f"""SELECT doc_id + 1 AS post_id, CASE WHEN doc_id % 10 < 7 THEN 'post' WHEN doc_id % 10 < 9 THEN 'page' ELSE 'product' END AS post_type,
            CASE WHEN doc_id % 23 = 0 THEN 'draft' ELSE 'publish' END AS post_status, trim({d.match(spaced(d), '^([^ ]+ ?){1,6}')}) AS title,
            concat('https://site.test/', source, '/', CAST(doc_id AS {d.text}), '/') AS url, {spaced(d)} AS parsed_text, lang AS lang_code,
            (doc_id % 97 = 0) AS is_excluded, (doc_id % 89 = 1) AS is_woo_system FROM documents""",
    ),
    "v_size": (("documents",), lambda d: "SELECT count(*) AS n FROM documents"),
    "v_link_graph": (
        ("lineitem", "v_size"),
        lambda d: f"""SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey % s.n + 1 AS source_post_id,
            CASE WHEN l.l_tax >= 0.08 THEN 0 ELSE l.l_partkey % (s.n + {d.intdiv('s.n', '10')}) + 1 END AS target_post_id, concat('anchor ', CAST(l.l_partkey % 37 AS {d.text})) AS anchor_text,
            CASE l.l_returnflag WHEN 'A' THEN 'exact' WHEN 'R' THEN 'generic' ELSE 'partial' END AS anchor_type, 'content' AS location FROM lineitem l, v_size s WHERE l.l_quantity <= 2""",
    ),
    "v_keywords": (
        ("benchmark", "v_size"),
        lambda d: f"""SELECT b.item_id + 1 AS id, {d.match('b.text', '^[^ ]+ ([^ ]+ [^ ]+ [^ ]+)', 1)} AS keyword, lower({d.match('b.text', '^[^ ]+ ([^ ]+ [^ ]+ [^ ]+)', 1)}) AS keyword_norm,
            CASE WHEN b.item_id % 2 = 0 THEN 'gsc' ELSE 'csv' END AS source, b.item_id * 37 % s.n + 1 AS post_id, b.item_id % 17 AS clicks, 100 * (b.item_id % 13 + 1) AS impressions,
            CAST(b.item_id * 7 % 60 AS DOUBLE) + 1.5 AS position FROM benchmark b, v_size s""",
    ),
    "v_spend_log": (
        ("events",),
        lambda d: f"""SELECT event_id + 1 AS id, user_id % 7 + 1 AS key_id, CASE user_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider,
            CASE user_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-haiku' ELSE 'gemini-1.5-flash' END AS model, CASE WHEN event_type = 'error' THEN 'error' ELSE 'chat' END AS operation,
            CAST(floor(value * 10) AS BIGINT) AS tokens_in, CAST(floor(value * 3) AS BIGINT) AS tokens_out, {d.months_later('ts', 'event_id % 3')} AS created_at FROM events""",
    ),
    "v_suggestions": (
        ("lineitem", "part", "v_size"),
        lambda d: """SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey % s.n + 1 AS source_post_id, l.l_partkey % s.n + 1 AS target_post_id, p.p_name AS anchor_text,
            CAST(l.l_discount * 5 AS DOUBLE) AS relevance_score, CASE l.l_linenumber % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'llm' ELSE 'tfidf' END AS engine,
            CASE WHEN l.l_returnflag = 'A' THEN 'approved' WHEN l.l_returnflag = 'R' THEN 'rejected' WHEN l.l_linestatus = 'O' THEN 'pending' ELSE 'applied' END AS status
            FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey, v_size s WHERE l.l_quantity >= 49""",
    ),
    "v_provider_keys": (
        ("supplier",),
        lambda d: """SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider, 'chat' AS capability, s_nationkey AS priority,
            (s_acctbal > 0) AS enabled, CASE s_suppkey % 5 WHEN 0 THEN 'cooling' WHEN 1 THEN 'exhausted' WHEN 2 THEN 'errored' ELSE 'active' END AS state,
            CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 7919 % 1000 END AS last_used_seq FROM supplier""",
    ),
    "tokens": (
        ("v_index",),
        lambda d: f"""SELECT post_id, lang_code, in_scope, {d.trim_both('raw', chr(39) + '-')} AS term FROM (SELECT post_id, lang_code, ({SCOPE}) AS in_scope, {d.explode}({d.all_matches('lower(parsed_text)', chr(92) + 'p{L}[' + chr(92) + 'p{L}' + chr(92) + "p{Nd}'-]{2,}")}) AS raw FROM v_index) t""",
    ),
    "frequencies": (
        ("tokens",),
        lambda d: f"SELECT post_id, lang_code, in_scope, term, count(*) AS tf FROM (SELECT post_id, lang_code, in_scope, {cut_bytes('term', 80, d)} AS term FROM tokens WHERE {d.octets('term')} >= 3 AND term NOT IN ({words_in(STOPWORDS)})) t GROUP BY post_id, lang_code, in_scope, term",
    ),
    "postings": (("frequencies",), lambda d: f"SELECT post_id, lang_code, in_scope, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY tf DESC, term) AS rn FROM frequencies) t WHERE rn <= {C.stored_terms}"),
    "corpus": (("postings",), lambda d: "SELECT count(DISTINCT post_id) AS n FROM postings"),
    "document_frequency": (("postings",), lambda d: "SELECT term, count(*) AS df FROM postings GROUP BY term"),
    "site_wide": (("document_frequency", "corpus"), lambda d: f"SELECT term, df FROM document_frequency, corpus WHERE df > floor(CAST({C.df_ceiling} AS DOUBLE) * n)"),
    "weights": (("document_frequency", "corpus"), lambda d: f"SELECT term, ln(1 + CAST(n AS DOUBLE) / df) AS idf FROM document_frequency, corpus WHERE df <= CAST({C.df_ceiling} AS DOUBLE) * n"),
    "source_terms": (
        ("postings", "weights"),
        lambda d: f"SELECT s.post_id, s.lang_code, s.term, s.tf, w.idf FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY tf DESC, term) AS rn FROM postings) s JOIN weights w ON w.term = s.term WHERE rn <= {C.source_terms}"
        if isinstance(d, Duck)
        else "SELECT s.post_id, s.lang_code, s.term, s.tf, w.idf FROM postings s JOIN weights w ON w.term = s.term WHERE s.is_own",
    ),
    "norms": (("source_terms",), lambda d: "SELECT post_id, sum(idf * tf) AS norm FROM source_terms GROUP BY post_id"),
    "shared_terms": (
        ("source_terms", "postings"),
        lambda d: f"SELECT s.post_id AS source_id, p.post_id AS target_id, count(*) AS shared, sum(s.idf * least(s.tf, p.tf)) AS overlap FROM source_terms s JOIN (SELECT * FROM postings WHERE in_scope) p ON p.term = s.term AND p.lang_code = s.lang_code AND p.post_id <> s.post_id GROUP BY s.post_id, p.post_id HAVING count(*) >= {C.min_shared}",
    ),
    "related": (
        ("shared_terms", "norms"),
        lambda d: f"""SELECT source_id, target_id, shared, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM
            (SELECT o.source_id, o.target_id, o.shared, round(least(CAST(1 AS DOUBLE), o.overlap / n.norm), 4) AS score FROM shared_terms o JOIN norms n ON n.post_id = o.source_id) s) t WHERE rank <= {RELATED}""",
    ),
    "scope": (("v_index",), lambda d: f"SELECT post_id, post_type, lang_code, {d.size(d.all_matches('parsed_text', chr(92) + 'p{L}+'))} AS word_count FROM v_index WHERE {SCOPE}"),
    "outgoing": (("v_link_graph",), lambda d: "SELECT source_post_id AS post_id, count(*) AS links FROM v_link_graph WHERE location = 'content' AND target_post_id > 0 GROUP BY source_post_id"),
    "density": (("scope", "outgoing"), lambda d: f"SELECT s.post_id, s.word_count, coalesce(o.links, 0) AS links, CAST(greatest(1, ceil(s.word_count / CAST(1000 AS DOUBLE) * {C.max_links_per_1000})) AS BIGINT) AS ceiling FROM scope s LEFT JOIN outgoing o ON o.post_id = s.post_id"),
    "scored": (
        ("v_keywords",),
        lambda d: f"SELECT id, keyword, keyword_norm, source, post_id, clicks, impressions, position, {click_rate('position')} AS expected_ctr, (position >= 5 AND position <= 20) AS is_striking, round({opportunity('impressions', 'position')}, 4) AS opportunity FROM v_keywords",
    ),
    "pool": (
        ("scored", "v_index"),
        lambda d: f"""SELECT id, keyword, keyword_norm, post_id, is_striking, opportunity, rank FROM (SELECT *, row_number() OVER (PARTITION BY keyword_norm, post_id ORDER BY rank) AS rn FROM
            (SELECT k.*, row_number() OVER (ORDER BY k.opportunity DESC, k.id) AS rank FROM scored k JOIN (SELECT post_id FROM v_index WHERE {SCOPE}) i ON i.post_id = k.post_id WHERE k.post_id > 0) a WHERE rank <= {C.keyword_pool}) b WHERE rn = 1""",
    ),
    "spend": (
        ("v_spend_log",),
        lambda d: f"SELECT *, (tokens_in * {price(0, d.join3(), 'model', d)} + tokens_out * {price(1, d.join3(), 'model', d)}) / 1000000 AS cents FROM v_spend_log",
    ),
    "rescored": (
        ("v_suggestions",),
        lambda d: f"SELECT *, round(CAST(0.6 AS DOUBLE) * least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), relevance_score)) + CAST(0.4 AS DOUBLE) * naturalness, 4) AS confidence FROM (SELECT *, {naturalness('anchor_text', d)} AS naturalness FROM v_suggestions) t",
    ),
}
Spark.join3 = lambda self: "concat(provider, '/', model)"


def _month(where: str) -> str:
    return f"SELECT count(*) AS requests, coalesce(sum(tokens_in), 0) AS tokens_in, coalesce(sum(tokens_out), 0) AS tokens_out FROM spend WHERE operation <> 'error'{where}"


# Character references that occur in text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(x: str, d: Spark) -> str:
    """Text of a page without scripts, styles and headings; tags go without a trace, white space collapses."""
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<h[1-6][ >].*?</h[1-6]>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        x = d.replace(x, p, "")
    for a, b in ENTITIES:
        x = d.plain(x, a, b)
    return spaced(d, x)


VIEWS["bodies"] = (("v_index",), lambda d: f"SELECT post_id, lang_code, {spelled('parsed_text', d)} AS body FROM v_index WHERE {SCOPE}")
VIEWS["needles"] = (
    ("pool", "v_index"),
    lambda d: f"""SELECT * FROM (SELECT p.id, p.keyword, p.post_id, p.is_striking, p.opportunity, p.rank, v.lang_code, {spelled('p.keyword_norm', d)} AS needle, {d.item(d.all_matches('p.keyword_norm', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]+'), '1')} AS word
        FROM pool p JOIN (SELECT post_id, lang_code FROM v_index) v ON v.post_id = p.post_id WHERE {d.octets('p.keyword_norm')} >= 4 AND {d.size(d.all_matches('p.keyword_norm', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]+'))} >= 1) k""",
)
VIEWS["held"] = (
    ("bodies", "needles"),
    lambda d: """SELECT i.post_id AS source_id, k.* FROM bodies i JOIN needles k ON k.post_id <> i.post_id AND k.lang_code = i.lang_code AND contains(i.body, k.needle)""",
)
VIEWS["saturated"] = (
    ("v_link_graph", "v_suggestions"),
    lambda d: """SELECT target_post_id, anchor, count(*) AS uses FROM (SELECT target_post_id, lower(anchor_text) AS anchor FROM v_link_graph WHERE location = 'content'
        UNION ALL SELECT target_post_id, lower(anchor_text) AS anchor FROM v_suggestions WHERE status IN ('pending', 'approved')) t GROUP BY target_post_id, anchor HAVING count(*) >= 3""",
)
VIEWS["mentions"] = (
    ("held", "saturated", "linked"),
    lambda d: f"""SELECT source_id, target_id, anchor, is_striking, opportunity, rank FROM (SELECT h.source_id, h.post_id AS target_id, h.keyword AS anchor, h.is_striking, h.opportunity, h.rank, row_number() OVER (PARTITION BY h.source_id, h.post_id ORDER BY h.rank) AS rn
        FROM held h {d.anti()} saturated s ON s.target_post_id = h.post_id AND s.anchor = lower(h.keyword) WHERE {d.size(d.all_matches('h.keyword', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]+'))} BETWEEN {C.min_anchor_words} AND {C.max_anchor_words}) t WHERE rn = 1""",
)
#: Targets that a page links to, or that were suggested for it.
VIEWS["linked"] = (
    ("v_link_graph", "v_suggestions"),
    lambda d: """SELECT DISTINCT source_id, target_id FROM (SELECT source_post_id AS source_id, target_post_id AS target_id FROM v_link_graph WHERE target_post_id > 0
        UNION ALL SELECT source_post_id, target_post_id FROM v_suggestions WHERE status IN ('pending', 'approved', 'applied', 'rejected')) t""",
)
VIEWS["capacity"] = (
    ("density",),
    lambda d: f"SELECT post_id, least({C.max_suggestions}, greatest(0, CAST(greatest(2, ceil(greatest(1, word_count) / CAST(1000 AS DOUBLE) * {C.max_links_per_1000})) AS BIGINT) - links)) AS room FROM density",
)
VIEWS["keyword_pass"] = (
    ("mentions", "linked", "capacity", "pool"),
    lambda d: f"""SELECT source_id, target_id, anchor, relevance, room, place FROM (SELECT m.*, c.room, {keyword_relevance(d)} AS relevance, row_number() OVER (PARTITION BY m.source_id ORDER BY m.rank, m.target_id) AS place
        FROM mentions m JOIN capacity c ON c.post_id = m.source_id {d.anti()} linked l ON l.source_id = m.source_id AND l.target_id = m.target_id, (SELECT max(opportunity) AS top FROM pool) p) t WHERE place <= room""",
)
#: Anchors for a page: two to four words of its title, longest first; none over a punctuation mark, with a number or structural word, or a stop word at its edge.
VIEWS["phrases"] = (
    ("v_index",),
    lambda d: f"""SELECT post_id, phrase, size, row_number() OVER (PARTITION BY post_id ORDER BY size DESC, {d.octets('phrase')} DESC, phrase) AS place FROM (SELECT DISTINCT post_id, size, phrase FROM
        (SELECT post_id, w, n AS size, {d.slice('w', 'pos', 'pos + n - 1')} AS own, {d.join_words(d.slice('w', 'pos', 'pos + n - 1'))} AS phrase FROM
        (SELECT post_id, w, n, {d.explode}({d.numbers('1', f'CAST({d.size(chr(119))} AS INT) - n + 1')}) AS pos FROM (SELECT post_id, w, {d.explode}({d.numbers(str(max(2, C.min_anchor_words)), f'least({C.max_anchor_words}, CAST({d.size(chr(119))} AS INT))')}) AS n FROM
        (SELECT post_id, {d.all_matches('part', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]+')} AS w FROM (SELECT post_id, {d.explode}({d.split('title', '[:;,|()' + chr(92) + '[' + chr(92) + ']/–—-]+')}) AS part FROM v_index) x) a) b) c) e
        WHERE {d.octets('phrase')} >= 6 AND lower({d.item('own', '1')}) NOT IN ({words_in(EDGE_STOPWORDS)}) AND lower({d.item('own', 'size')}) NOT IN ({words_in(EDGE_STOPWORDS)})
        AND {d.size(d.filter('own', 'x', f"lower(x) IN ({words_in(NOISE_WORDS)}) OR {d.like('x', '^' + chr(92) + 'p{Nd}+$')}"))} = 0) f""",
)
#: The first phrase of a target's title that stands in a source's text, as whole words, for each pair that may be proposed.
VIEWS["placed"] = (
    ("related", "bodies", "phrases"),
    lambda d: f"""SELECT source_id, target_id, score, rank, phrase FROM (SELECT r.source_id, r.target_id, r.score, r.rank, p.phrase, row_number() OVER (PARTITION BY r.source_id, r.target_id ORDER BY p.place) AS rn
        FROM related r JOIN phrases p ON p.post_id = r.target_id AND p.place <= 60 JOIN bodies s ON s.post_id = r.source_id WHERE r.score >= {C.min_relevance} AND contains(s.body, concat(' ', lower(p.phrase), ' '))) t WHERE rn = 1""",
)
VIEWS["text_pass"] = (
    ("placed", "linked", "capacity", "keyword_pass"),
    lambda d: f"""SELECT source_id, target_id, anchor, relevance, place FROM (SELECT r.source_id, r.target_id, r.phrase AS anchor, r.score AS relevance, c.room - coalesce(k.taken, 0) AS room, row_number() OVER (PARTITION BY r.source_id ORDER BY r.score DESC, r.target_id) AS place
        FROM placed r JOIN capacity c ON c.post_id = r.source_id {d.anti()} linked l ON l.source_id = r.source_id AND l.target_id = r.target_id {d.anti()} keyword_pass p ON p.source_id = r.source_id AND p.target_id = r.target_id
        LEFT JOIN (SELECT source_id, count(*) AS taken FROM keyword_pass GROUP BY source_id) k ON k.source_id = r.source_id WHERE r.rank <= 4 * c.room + 10) u WHERE place <= room""",
)

#: Queries: what each stands on, and its result.
PLANS: dict[str, View] = {
    "related_pages": (("related",), lambda d: "SELECT source_id, target_id, shared, score, rank FROM related WHERE rank <= 30"),
    "term_frequencies": (("postings",), lambda d: "SELECT post_id, term, tf FROM postings"),
    "document_frequency": (("document_frequency",), lambda d: "SELECT term, df FROM document_frequency"),
    "corpus_size": (("corpus",), lambda d: "SELECT n FROM corpus"),
    "site_wide_terms": (("site_wide",), lambda d: "SELECT term, df FROM site_wide"),
    "source_norms": (("norms",), lambda d: "SELECT post_id, round(norm, 3) AS norm FROM norms"),
    "top_terms_per_page": (
        ("postings", "site_wide"),
        lambda d: """SELECT post_id, term, tf, k FROM (SELECT t.post_id, t.term, t.tf, row_number() OVER (PARTITION BY t.post_id ORDER BY t.tf DESC, t.term) AS k FROM
            (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY tf DESC, term) AS rn FROM postings) t LEFT JOIN site_wide s ON s.term = t.term WHERE t.rn <= 50 AND s.term IS NULL) u WHERE k <= 10""",
    ),
    "eligible_pages": (("scope",), lambda d: "SELECT post_type, lang_code, count(*) AS pages, sum(word_count) AS words FROM scope GROUP BY post_type, lang_code"),
    "orphans": (("scope", "v_link_graph"), lambda d: f"SELECT s.post_id FROM scope s {d.anti()} v_link_graph g ON g.target_post_id = s.post_id AND g.location = 'content'"),
    "dead_ends": (("scope", "outgoing"), lambda d: f"SELECT s.post_id FROM scope s {d.anti()} outgoing o ON o.post_id = s.post_id"),
    "over_linked": (("density",), lambda d: "SELECT post_id, word_count, links, ceiling FROM density WHERE links > ceiling ORDER BY links DESC, post_id LIMIT 50"),
    "under_linked": (("density",), lambda d: "SELECT post_id, word_count FROM density WHERE links = 0 AND word_count >= 300"),
    "broken_links": (
        ("v_link_graph", "v_index"),
        lambda d: "SELECT g.id, g.source_post_id, g.target_post_id, (g.target_post_id = 0 OR i.post_id IS NULL) AS is_broken FROM v_link_graph g LEFT JOIN (SELECT post_id FROM v_index WHERE post_status = 'publish') i ON i.post_id = g.target_post_id",
    ),
    "link_out_degree": (("outgoing",), lambda d: "SELECT post_id, links FROM outgoing"),
    "first_links": (("v_link_graph",), lambda d: "SELECT source_post_id, target_post_id, min(id) AS first_id, count(*) AS occurrences FROM v_link_graph WHERE target_post_id > 0 GROUP BY source_post_id, target_post_id"),
    "anchor_type_distribution": (("v_link_graph",), lambda d: "SELECT anchor_type, count(*) AS links FROM v_link_graph WHERE target_post_id > 0 GROUP BY anchor_type"),
    "over_optimized_targets": (
        ("v_link_graph",),
        lambda d: """SELECT target_post_id, total, exacts, round(exacts / CAST(total AS DOUBLE), 4) AS ratio FROM (SELECT target_post_id, count(*) AS total, sum(CASE WHEN anchor_type = 'exact' THEN 1 ELSE 0 END) AS exacts
            FROM v_link_graph WHERE target_post_id > 0 GROUP BY target_post_id) t WHERE total >= 3 AND exacts / CAST(total AS DOUBLE) > 0.40 ORDER BY ratio DESC, target_post_id LIMIT 50""",
    ),
    "audit_summary": (
        ("scope", "density", "v_link_graph", "v_index", "v_suggestions", "click_depths"),
        lambda d: f"""SELECT * FROM (SELECT count(*) AS indexed, sum(CASE WHEN links = 0 THEN 1 ELSE 0 END) AS dead_ends, sum(CASE WHEN links > ceiling THEN 1 ELSE 0 END) AS over_linked, sum(CASE WHEN links = 0 AND word_count >= 300 THEN 1 ELSE 0 END) AS under_linked FROM density) a,
            (SELECT count(*) AS orphans FROM scope s {d.anti()} v_link_graph g ON g.target_post_id = s.post_id AND g.location = 'content') b, (SELECT count(*) AS applied_links FROM v_suggestions WHERE status = 'applied') c,
            (SELECT count(*) AS broken FROM v_link_graph g {d.anti()} (SELECT post_id FROM v_index WHERE post_status = 'publish') i ON i.post_id = g.target_post_id) e,
            (SELECT count(*) AS over_optimized FROM (SELECT target_post_id FROM v_link_graph WHERE target_post_id > 0 AND location = 'content' GROUP BY target_post_id HAVING count(*) >= 3 AND sum(CASE WHEN anchor_type = 'exact' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) > 0.40) o) f,
            (SELECT max(depth) AS deepest, sum(CASE WHEN depth < 0 THEN 1 ELSE 0 END) AS unreached, sum(CASE WHEN depth >= 4 THEN 1 ELSE 0 END) AS deep FROM click_depths) g""",
    ),
    "keyword_scores": (("scored",), lambda d: "SELECT id, keyword_norm, position, expected_ctr, is_striking, opportunity FROM scored"),
    "keyword_upsert": (
        ("v_keywords",),
        lambda d: """SELECT keyword_norm, post_id, source, clicks, impressions, position FROM (SELECT *, row_number() OVER (PARTITION BY keyword_norm, post_id, source ORDER BY seq DESC) AS rn FROM
            (SELECT *, id AS seq FROM v_keywords UNION ALL SELECT *, id + 1000000 AS seq FROM (SELECT id, keyword, keyword_norm, source, post_id, clicks + 1 AS clicks, impressions * 2 AS impressions, position FROM v_keywords WHERE id % 3 = 0) n) a) b WHERE rn = 1""",
    ),
    "keyword_dedupe": (("v_keywords",), lambda d: "SELECT keyword_norm, post_id, source, min(id) AS id FROM v_keywords GROUP BY keyword_norm, post_id, source"),
    "keyword_pool": (("pool",), lambda d: "SELECT rank, id, keyword_norm, post_id, opportunity FROM pool"),
    "striking_keywords": (("scored",), lambda d: "SELECT id, keyword, position, opportunity FROM scored WHERE is_striking ORDER BY opportunity DESC, id LIMIT 50"),
    "keyword_relevance": (
        ("pool",),
        lambda d: f"SELECT id, {keyword_relevance(d)} AS relevance FROM pool, (SELECT max(opportunity) AS top FROM pool) m",
    ),
    "usage_totals": (("spend",), lambda d: _month("")),
    "usage_month": (("spend",), lambda d: f"SELECT {d.day('created_at')} AS month, count(*) AS requests, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out FROM spend WHERE operation <> 'error' GROUP BY {d.day('created_at')}"),
    "usage_by_key": (("spend",), lambda d: "SELECT key_id, count(*) AS requests, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, round(sum(cents), 2) AS cents FROM spend WHERE operation <> 'error' GROUP BY key_id"),
    "usage_breakdown": (("spend",), lambda d: "SELECT provider, model, operation, count(*) AS requests, sum(tokens_in + tokens_out) AS tokens, round(sum(cents), 2) AS cents FROM spend GROUP BY provider, model, operation"),
    "usage_since": (("spend",), lambda d: _month(" AND id > 500")),
    "spend_cents": (("spend",), lambda d: f"SELECT {d.day('created_at')} AS month, provider, CAST(ceil(round(sum(cents), 3)) AS BIGINT) AS cents FROM spend GROUP BY {d.day('created_at')}, provider"),
    "model_pricing": (("spend",), lambda d: "SELECT provider, model, round(max(CASE WHEN tokens_in > 0 THEN cents / (tokens_in + tokens_out) * 1000000 END), 3) AS highest_rate FROM spend GROUP BY provider, model"),
    "error_classes": (
        ("events",),
        lambda d: """SELECT status, class, class IN ('network', 'rate_limit', 'overloaded', 'server') AS retryable, count(*) AS n FROM (SELECT status, CASE WHEN status = 0 THEN 'network' WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN 'auth'
            WHEN status = 402 THEN 'quota' WHEN status IN (400, 422) THEN 'bad_request' WHEN status = 529 THEN 'overloaded' WHEN status >= 500 THEN 'server' ELSE 'unknown' END AS class FROM
            (SELECT CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 402 WHEN 5 THEN 400 WHEN 6 THEN 422 WHEN 7 THEN 529 WHEN 8 THEN 503 ELSE 418 END AS status FROM events) a) b GROUP BY status, class""",
    ),
    "url_normalize": (
        ("pages",),
        lambda d: f"""SELECT page_id, concat(lower({d.match('url', '^[a-z]+://([^/?#]*)', 1)}), CASE WHEN path = '' THEN '/' ELSE path END) AS url_norm, lower({d.match('url', '^[a-z]+://([^/?#:]*)', 1)}) = 'www.therea.example.com' AS is_internal
            FROM (SELECT page_id, url, {d.replace(d.match('url', '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')} AS path FROM pages) t""",
    ),
    "word_counts": (("v_index",), lambda d: f"SELECT post_id, {d.size(d.all_matches('parsed_text', chr(92) + 'p{L}+'))} AS words, {d.size(d.all_matches('parsed_text', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]+'))} AS keyword_words FROM v_index"),
    "content_hash": (("v_index",), lambda d: "SELECT post_id, md5(concat(parsed_text, '|', url)) AS content_hash FROM v_index"),
    "anchor_classify": (("v_link_graph", "part"), lambda d: f"SELECT anchor, {anchor_type('anchor', d)} AS anchor_type FROM (SELECT DISTINCT anchor_text AS anchor FROM v_link_graph UNION SELECT p_name FROM part UNION SELECT 'Read More' UNION SELECT 'https://x.test' UNION SELECT '' UNION SELECT 'see www.x.test') t"),
    "naturalness_scores": (("rescored",), lambda d: "SELECT id, source_post_id, target_post_id, naturalness, confidence FROM rescored"),
    "density_capacity": (
        ("density",),
        lambda d: f"SELECT post_id, least({C.max_suggestions}, greatest(0, CAST(greatest(2, ceil(word_count / CAST(1000 AS DOUBLE) * {C.max_links_per_1000})) AS BIGINT) - links)) AS capacity FROM density",
    ),
    "inbox_counts": (("v_suggestions",), lambda d: "SELECT status, engine, count(*) AS n FROM v_suggestions GROUP BY GROUPING SETS ((status, engine), (status))"),
    "inbox_page": (("rescored",), lambda d: "SELECT id, source_post_id, target_post_id, confidence FROM rescored WHERE status = 'pending' ORDER BY confidence DESC, id DESC, source_post_id, target_post_id LIMIT 30 OFFSET 30"),
    "key_lease_order": (("v_provider_keys",), lambda d: "SELECT provider, id, rank FROM (SELECT provider, id, row_number() OVER (PARTITION BY provider ORDER BY last_used_seq ASC NULLS FIRST, id) AS rank FROM v_provider_keys WHERE enabled AND capability = 'chat' AND state IN ('active', 'cooling')) t"),
    "key_health": (("v_provider_keys",), lambda d: "SELECT provider, state, count(*) AS n, sum(CASE WHEN enabled AND state = 'active' THEN 1 ELSE 0 END) AS healthy FROM v_provider_keys GROUP BY provider, state"),
    "bulk_sanitize": (("events",), lambda d: "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY first) AS place FROM (SELECT user_id - 3 AS id, min(event_id) AS first FROM events GROUP BY user_id - 3) a WHERE id > 0) b WHERE place <= 50"),
    "table_diff": (("v_index", "v_link_graph"), lambda d: "SELECT target_post_id AS id FROM v_link_graph WHERE target_post_id > 0 EXCEPT SELECT post_id FROM v_index"),
    "log_signatures": (("events",), lambda d: f"SELECT signature, count(*) AS n FROM (SELECT {d.replace('concat(event_type, ' + chr(39) + ' of user ' + chr(39) + f', CAST(user_id AS {d.text}))', '[0-9]+', 'N')} AS signature FROM events) t GROUP BY signature ORDER BY n DESC, signature LIMIT 15"),
    "token_estimates": (("v_index",), lambda d: f"SELECT post_id, CAST(floor(420 + (least(1000, {d.size(d.all_matches('parsed_text', '[^ ]+'))}) + 15 * (8 + 10)) * CAST(1.35 AS DOUBLE) + 0.5) AS BIGINT) AS tokens_in, 260 AS tokens_out FROM v_index"),
    "title_phrases": (("phrases",), lambda d: "SELECT post_id, place, phrase, size FROM phrases WHERE place <= 60"),
    "keyword_mentions": (("held",), lambda d: "SELECT source_id AS post_id, id, post_id AS target_id FROM held"),
    "anchor_saturation": (("saturated",), lambda d: "SELECT target_post_id, anchor, uses FROM saturated"),
    "status_cards": (("v_suggestions",), lambda d: "SELECT sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS approved, sum(CASE WHEN status = 'applied' THEN 1 ELSE 0 END) AS applied, sum(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) AS rejected FROM v_suggestions"),
    "anchor_matches": (("placed",), lambda d: "SELECT source_id, target_id, phrase AS anchor FROM placed"),
}

PLANS |= {
    "graph_nodes": (("scope",), lambda d: "SELECT post_id AS node FROM scope"),
    "graph_edges": (("v_link_graph",), lambda d: "SELECT source_post_id AS source, target_post_id AS target FROM v_link_graph WHERE location = 'content' AND target_post_id > 0"),
    "page_text": (("pages",), lambda d: f"SELECT page_id, md5(body) AS text_hash, length(body) AS n FROM (SELECT page_id, {html_text('html', d)} AS body FROM pages) t"),
    "page_links": (
        ("pages",),
        lambda d: f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, {d.explode}({d.groups('html', '(?is)<a[^>]*href=[^a-zA-Z0-9/#:]([^>]*)[^a-zA-Z0-9/#:.,]>', 1)}) AS href FROM pages) t WHERE href <> '' AND NOT {d.like('href', '^(#|javascript:|mailto:|tel:)')} GROUP BY page_id, href",
    ),
    "redacted": (("documents",), lambda d: "SELECT doc_id, md5(clean) AS text_hash, " + d.size(d.all_matches("clean", r"\[redacted\]")) + " AS masks FROM (SELECT doc_id, " + _scrubbed("text", d) + " AS clean FROM documents) t"),
    "suggestions": (
        ("keyword_pass", "text_pass"),
        lambda d: f"SELECT source_id, target_id, engine, anchor, relevance, round(CAST(0.6 AS DOUBLE) * relevance + CAST(0.4 AS DOUBLE) * {naturalness('anchor', d)}, 4) AS confidence FROM (SELECT source_id, target_id, 'keyword' AS engine, anchor, relevance FROM keyword_pass UNION ALL SELECT source_id, target_id, 'tfidf' AS engine, anchor, relevance FROM text_pass) t",
    ),
}

#: A call log by key: outcome classes in order of time.
VIEWS["calls"] = (
    ("events",),
    lambda d: "SELECT event_id AS id, user_id % 7 + 1 AS key_id, CASE WHEN event_type = 'error' THEN CASE user_id % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'quota' WHEN 2 THEN 'auth' ELSE 'server' END ELSE 'ok' END AS outcome FROM events",
)
VIEWS["status_events"] = (("v_suggestions",), lambda d: "SELECT source_post_id, target_post_id, status, max(id) AS seq FROM v_suggestions GROUP BY source_post_id, target_post_id, status")
VIEWS["targets"] = (
    ("v_index",),
    lambda d: "SELECT post_id AS source_id, CASE post_id % 3 WHEN 0 THEN rtrim(url, '/') WHEN 1 THEN url ELSE concat(url, 'gone') END AS target_url FROM v_index" if isinstance(d, Duck) else "SELECT post_id AS source_id, CASE post_id % 3 WHEN 0 THEN rtrim('/', url) WHEN 1 THEN url ELSE concat(url, 'gone') END AS target_url FROM v_index",
)
VIEWS["replies"] = (
    ("events",),
    lambda d: "SELECT event_id AS id, concat(CASE WHEN event_id % 2 = 0 THEN '```json ' ELSE 'Here you are: ' END, '{\"links\":[{\"n\":', CAST(event_id % 5 AS " + d.text + "), ',\"anchor\":\"two words\",\"confidence\":', CAST(event_id % 3 AS " + d.text + "), '}]}', CASE WHEN event_id % 2 = 0 THEN ' ```' ELSE '' END) AS reply FROM events",
)
PLANS |= {
    "key_states": (
        ("calls",),
        lambda d: """SELECT key_id, outcome, CASE outcome WHEN 'rate_limit' THEN 'cooling' WHEN 'server' THEN 'cooling' WHEN 'quota' THEN 'exhausted' WHEN 'auth' THEN 'errored' ELSE 'active' END AS state, CASE outcome WHEN 'rate_limit' THEN 30 WHEN 'server' THEN 10 ELSE 0 END AS cooldown,
            CASE WHEN outcome IN ('rate_limit', 'quota', 'auth') THEN 'failover' WHEN outcome = 'server' THEN 'retry' ELSE 'stop' END AS next_action FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY id DESC) AS rn FROM calls) t WHERE rn = 1""",
    ),
    "status_fold": (("status_events",), lambda d: "SELECT source_post_id, target_post_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_post_id, target_post_id ORDER BY seq DESC, status) AS rn FROM status_events) t WHERE rn = 1"),
    "ledger_active": (
        ("status_events",),
        lambda d: "SELECT a.source_post_id, count(*) AS active FROM (SELECT * FROM status_events WHERE status = 'applied') a LEFT JOIN (SELECT * FROM status_events WHERE status = 'rejected') r ON r.source_post_id = a.source_post_id AND r.target_post_id = a.target_post_id AND r.seq > a.seq WHERE r.seq IS NULL GROUP BY a.source_post_id",
    ),
    "url_resolve": (
        ("targets", "v_index"),
        lambda d: "SELECT t.source_id, coalesce(a.post_id, b.post_id, 0) AS target_id FROM targets t LEFT JOIN (SELECT post_id, url FROM v_index) a ON a.url = t.target_url LEFT JOIN (SELECT post_id, url FROM v_index) b ON b.url = concat(t.target_url, '/')",
    ),
    "llm_reply_parse": (
        ("replies",),
        lambda d: f"SELECT id, CAST({d.json('body', 'links[0].n')} AS INT) AS n, {d.json('body', 'links[0].anchor')} AS anchor, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(CAST({d.json('body', 'links[0].confidence')} AS DOUBLE), CAST(0.7 AS DOUBLE)))) AS confidence FROM (SELECT id, {d.match('reply', '[{].*[}]')} AS body FROM replies) t WHERE CAST({d.json('body', 'links[0].n')} AS INT) BETWEEN 1 AND 15",
    ),
    "reason_histogram": (("calls",), lambda d: "SELECT outcome, count(*) AS n FROM calls WHERE outcome <> 'ok' GROUP BY outcome ORDER BY n DESC, outcome"),
    "usage_formatted": (
        ("spend",),
        lambda d: f"SELECT key_id, {format_tokens('n', d)} AS tokens, {format_cost('dollars', d)} AS cost FROM (SELECT key_id, sum(tokens_in + tokens_out) AS n, round(sum(cents) / 100, 6) AS dollars FROM spend GROUP BY key_id) t",
    ),
    "scan_progress": (("v_index",), lambda d: "SELECT post_type, count(*) AS total, CAST(least(100, floor(100.0 * sum(CASE WHEN post_id % 4 > 0 THEN 1 ELSE 0 END) / count(*) + 0.5)) AS BIGINT) AS percent FROM v_index GROUP BY post_type"),
    "content_systems": (
        ("pages",),
        lambda d: f"SELECT page_id, CASE WHEN {d.has('html', repr('elementor'))} THEN 'elementor' WHEN {d.has('html', repr('fl-builder'))} THEN 'beaver' WHEN {d.has('html', repr('[et_pb'))} THEN 'divi' WHEN {d.has('html', repr('[vc_'))} THEN 'wpbakery' WHEN {d.has('html', repr('<!-- wp:'))} THEN 'gutenberg' ELSE 'classic' END AS content_system FROM pages",
    ),
}


def _scrubbed(x: str, d: Spark) -> str:
    for p in SECRET_SHAPES:
        x = d.replace(x, p, "[redacted]")
    return x


VIEWS |= rules.VIEWS
PLANS |= rules.PLANS

#: Views that Spark writes once for all queries that stand on them. Texts are read from their table: a copy would take as much disk as they do.
SHARED = ("page_terms", "document_frequency", "related", "scope", "pool", "needles", "held", "placed", "keyword_pass", "click_depths")
#: Views that Spark reads out of another that is stored.
PARTS = {
    "postings": ("page_terms", "post_id, lang_code, in_scope, item.terms AS term, item.tfs AS tf, place < own AS is_own FROM (SELECT post_id, lang_code, in_scope, own, posexplode(arrays_zip(terms, tfs)) AS (place, item) FROM {stored}) t"),
    "corpus": ("page_terms", "count(DISTINCT post_id) AS n FROM {stored}"),
    "top_terms": (
        "page_terms",
        """post_id, array_join(transform(slice(array_sort(flatten(collect_list(first))), 1, 10), x -> x.term), ', ') AS words FROM (SELECT post_id,
        transform(slice(filter(slice(arrays_zip(terms, tfs), 1, 10 + size(common)), x -> NOT array_contains(common, x.terms)), 1, 10), x -> struct(-x.tfs AS k, x.terms AS term)) AS first FROM {stored}, (SELECT collect_set(term) AS common FROM ({site_wide})) s) t WHERE size(first) > 0 GROUP BY post_id""",
    ),
}


def _tables(name: str) -> list[str]:
    """The tables under a view."""
    return [name] if name in TABLES else sorted({t for x in VIEWS[name][0] for t in _tables(x)}) if name in VIEWS else []


def render(name: str, d: Spark, folder: str = "", read: Callable[[str], str | None] = lambda name: None, whole: bool = False) -> str:
    """SQL of a plan (or, if whole, of a view) with the scans and views that it stands on, each once.

    read gives the query that reads a view that is stored, or None.
    """
    needs, body = ((name,), lambda d: f"SELECT * FROM {name}") if whole else PLANS[name]
    steps: dict[str, str] = {}

    def need(one: str, top: bool) -> None:
        if one in steps:
            return
        if one in TABLES:
            if scan := d.scan(folder, one):
                steps[one] = scan
        elif not top and (found := read(one)):
            steps[one] = f"{one} AS ({found})"
        else:
            below, query = VIEWS[one]
            for x in below:
                need(x, False)
            steps[one] = f"{one} AS ({query(d)})"

    for x in needs:
        need(x, whole)
    recursive = "RECURSIVE " if any("UNION SELECT" in s for s in steps.values()) and isinstance(d, Duck) else ""
    return (f"WITH {recursive}{', '.join(steps.values())} " if steps else "") + body(d)


def _reader(spark: SparkSession, sf_dir: str) -> Callable[[str], str | None]:
    def read(name: str) -> str | None:
        if name in PARTS:
            whole, query = PARTS[name]
            common = render("site_wide", Spark(spark), sf_dir, read, whole=True) if "{site_wide}" in query else ""  # each in over df_ceiling of the pages: 750 terms at most
            return "SELECT " + query.format(stored=f"({read(whole)})", site_wide=common)
        if name not in SHARED:
            return None
        make = (lambda: MADE[name](spark, sf_dir)) if name in MADE else (lambda: spark.sql(render(name, Spark(spark), sf_dir, read, whole=True)))
        return f"SELECT * FROM parquet.`{index.stored(spark, name, [f'{sf_dir}/{t}.parquet' for t in _tables(name)], make)}`"

    return read


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plan's or a view's rows."""
    read, d = _reader(spark, sf_dir), Spark(spark)
    return spark.sql(render(name, d, sf_dir, read) if name in PLANS else read(name) or render(name, d, sf_dir, read, whole=True))


def _click_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.click_depth(view(spark, sf_dir, "graph_nodes"), view(spark, sf_dir, "graph_edges"), seed=1)


def _page_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page with its stored terms. Pages of one row are counted where they lie; rows that share an id, or have none, are one page and go by the plan."""
    pages = view(spark, sf_dir, "v_index").selectExpr("post_id", "lang_code", f"({SCOPE}) AS in_scope", "parsed_text")
    again = pages.groupBy("post_id").count().filter("count > 1 OR post_id IS NULL").select(F.col("post_id").alias("id"))
    if again.isEmpty():
        return text.term_lists(pages, C.stored_terms, C.source_terms)
    same = F.col("post_id").eqNullSafe(F.col("id"))
    rows = spark.sql(render("postings", Spark(spark), sf_dir, whole=True)).join(again, same, "left_semi")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("tf"), "term")))
    lists = rows.groupBy("post_id", "lang_code", "in_scope").agg(F.sort_array(F.collect_list(F.struct("rn", "term", "tf"))).alias("list"), F.count_if(F.col("rn") <= C.source_terms).cast("int").alias("own"))  # stored terms of a page are bounded
    return text.term_lists(pages.join(again, same, "left_anti"), C.stored_terms, C.source_terms).unionByName(lists.selectExpr("post_id", "lang_code", "in_scope", "list.term AS terms", "list.tf AS tfs", "own"))


def _document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "page_terms").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "corpus").first()["n"]
    idf = f"if({{df}} <= CAST({C.df_ceiling} AS DOUBLE) * {n}, ln(1 + CAST({n} AS DOUBLE) / {{df}}), NULL) AS idf"  # as the view weights has it
    weights = view(spark, sf_dir, "document_frequency").filter("df > 1").selectExpr("xxhash64(term) AS number", idf.format(df="df"))
    pages = view(spark, sf_dir, "page_terms")
    sources = pages.selectExpr("post_id", "lang_code", "transform(slice(terms, 1, own), x -> xxhash64(x)) AS numbers", "slice(tfs, 1, own) AS tfs")
    targets = pages.filter("in_scope").selectExpr("post_id", "lang_code", "transform(terms, x -> xxhash64(x)) AS numbers", "tfs")
    return overlap.best_of_lists(sources, targets, weights, spark.range(1).selectExpr(idf.format(df="1")).first()["idf"], RELATED, C.min_shared)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = view(spark, sf_dir, "needles")
    found = placing.standing(view(spark, sf_dir, "bodies"), [r["needle"] for r in needles.select("needle").distinct().collect()])  # keyword_pool at most
    same = [needles[c] == found[c] for c in ("needle", "lang_code")]
    return found.join(F.broadcast(needles), [*same, needles["post_id"] != found["source_id"]]).select(found["source_id"], needles["*"])


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "related").filter(f"score >= {C.min_relevance}")
    lists = view(spark, sf_dir, "phrases").filter("place <= 60").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("place", "phrase"))).alias("list"))
    lists = lists.selectExpr("post_id", "list.phrase AS phrases", "transform(list.phrase, x -> lower(x)) AS spelled")
    return placing.first_placed(pairs, view(spark, sf_dir, "bodies"), lists, range(max(2, C.min_anchor_words), C.max_anchor_words + 1))


#: Views that Spark makes by operators; their text is the other engine's.
MADE = {"click_depths": _click_depths, "document_frequency": _document_frequency, "related": _related, "held": _held, "placed": _placed, "page_terms": _page_terms}
VIEWS["page_terms"] = VIEWS["postings"]  # its rows, by page; the other engine has no use for it
VIEWS["click_depths"] = (
    ("scope", "v_link_graph"),
    lambda d: """SELECT s.post_id AS node, coalesce(x.depth, -1) AS depth FROM scope s LEFT JOIN (SELECT node, min(depth) AS depth FROM (WITH RECURSIVE steps AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.target_post_id, depth + 1
        FROM steps JOIN v_link_graph e ON e.source_post_id = steps.node AND e.location = 'content' AND e.target_post_id > 0 WHERE depth < 100) SELECT * FROM steps) y GROUP BY node) x ON x.node = s.post_id""",
)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, name)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: render(name, Duck()) for name in PLANS}
