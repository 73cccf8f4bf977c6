"""URL filter by rules, and by a tree of path templates per host for what no rule decides.

A URL's template is its host and all segments of its path, with runs of digits turned into wildcards;
a node of the tree that has more than WIDE different children has one wildcard child instead. Each node
counts its URLs that rules decide, and how many of those they block: these are the labelled examples.

Purity is backed off down the tree: at each node the share of blocked examples is smoothed towards that
of the node above (the host's towards a half), with PRIOR examples' weight. Branches of a node whose
share doesn't differ significantly from the node's (two standard deviations; branches without examples
never do) are merged: each takes the examples of all of them together. A template is rejected if its
share is over REJECT.

Only DataFrame operations: URLs are counted by template before anything is joined, so that a host with
most of the URLs is some rows among others. Nothing goes to the driver.

Odd rows: a null url, or one without ://, has an empty host and path; such urls share one template.
Paths of any length have all their segments in their template. Repeated rows give a row each; empty
tables give empty results; other columns than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children from which a node has one wildcard child.
WIDE = 16
#: Weight of the share above in a node's share, and the share from which a template is rejected.
PRIOR, REJECT = 4.0, 0.75
Rule = tuple[str, str]  # "allow" or "block", and host with path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and whether it blocks (null without one)."""
    rule, blocks = F.lit(None).cast("string"), F.lit(None).cast("int")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, blocks = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(int(verdict == "block"))).otherwise(blocks)
    return rule, blocks


def _prefix(segments: str, depth: str) -> Column:
    return F.expr(f"concat_ws('/', host, slice({segments}, 1, {depth}))")


def purity(urls: DataFrame) -> DataFrame:
    """raw, template and share of blocked for each different raw path; urls: host, raw (segments joined by /), blocked (1, 0 or null)."""
    paths = urls.groupBy("host", "raw").agg(F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    paths = paths.withColumn("segments", F.expr("CASE WHEN raw = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(raw, '/') END"))

    # wildcards: which nodes have many children
    steps = paths.select("host", "raw", "segments", F.posexplode("segments").alias("depth", "segment")).withColumn("node", _prefix("segments", "depth"))
    wide = steps.groupBy("node").agg(F.count_distinct("segment").alias("children")).filter(F.col("children") > WIDE).select("node", F.lit(True).alias("wide"))
    generalised = steps.join(wide, "node", "left").groupBy("host", "raw").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", F.when(F.col("wide"), F.lit("*")).otherwise(F.col("segment")).alias("segment")))), lambda x: x["segment"]).alias("general")
    )  # fmt: skip  # a URL's own segments
    paths = paths.join(generalised, ["host", "raw"], "left").withColumn("general", F.coalesce("general", F.expr("CAST(array() AS ARRAY<STRING>)")))

    # the tree, with the examples of each node and of those of its children that are like it
    templates = paths.groupBy("host", "general").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    levels = templates.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("general")))).withColumn("node", _prefix("general", "depth"))
    nodes = levels.groupBy("host", "node", "depth", F.when(F.col("depth") > 0, _prefix("general", "depth - 1")).alias("above")).agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    parents = nodes.select(F.col("node").alias("above"), F.col("known").cast("double").alias("all_known"), F.col("bad").cast("double").alias("all_bad"))
    apart = F.col("bad") * F.col("all_known") - F.col("known") * F.col("all_bad")
    tested = nodes.join(parents, "above", "left").withColumn("alike", F.coalesce(apart * apart <= 4.0 * F.col("known") * F.col("all_bad") * (F.col("all_known") - F.col("all_bad")), F.lit(False)))
    pools = tested.filter("alike").groupBy("above").agg(F.sum("known").alias("pool_known"), F.sum("bad").alias("pool_bad"))
    counted = tested.join(pools, "above", "left").select("node", *[F.when(F.col("alike"), F.col(f"pool_{c}")).otherwise(F.col(c)).cast("double").alias(f"{c}_here") for c in ("known", "bad")])

    # down each template's path, the share above is the next one's prior
    ways = levels.select("host", "general", "depth", "node").join(counted, "node")
    ways = ways.groupBy("host", "general").agg(F.array_sort(F.collect_list(F.struct("depth", "known_here", "bad_here"))).alias("way"))
    share = F.aggregate("way", F.lit(0.5), lambda above, x: (x["bad_here"] + PRIOR * above) / (x["known_here"] + PRIOR))
    shares = ways.select("host", "general", share.alias("share"))
    return paths.join(shares, ["host", "general"]).select("host", "raw", F.concat_ws("/", "host", "general").alias("template"), "share")


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path and raw: the path's segments, digits turned into wildcards."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    return urls.withColumn("raw", F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "[0-9]+", "*"), "/+", "/"), "^/|/$", ""))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule (or null), template, share of blocked examples, and verdict (allow or block) of each page."""
    rule, blocks = fitting_rule(rules)
    urls = split_urls(pages).select("*", rule.alias("rule"), blocks.alias("blocked"))
    out = urls.join(purity(urls), ["host", "raw"])
    blocked = F.coalesce(F.col("blocked") == 1, F.col("share") > REJECT)
    return out.select("page_id", "host", "path", "rule", "template", F.round("share", 9).alias("share"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def judge_sql(rules: Sequence[Rule]) -> str:
    """The same for DuckDB, over a view pages; shares are worked out level by level."""
    lower = f"translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rule, blocks = "NULL", "NULL"
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        rule, blocks = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN {int(verdict == 'block')} ELSE {blocks} END"
    return f"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
u0 AS (SELECT page_id, {lower} AS host, path FROM h),
u AS (SELECT *, CAST({rule} AS VARCHAR) AS rule, CAST({blocks} AS INTEGER) AS blocked,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') AS segs FROM u0),
places AS (SELECT DISTINCT host, segs, unnest(range(len(segs))) AS d FROM u),
wide AS (SELECT host, segs[1:d] AS up, count(DISTINCT segs[d + 1]) AS n FROM places GROUP BY ALL HAVING n > {WIDE}),
stars AS (SELECT p.host, p.segs, list(CASE WHEN w.n IS NULL THEN p.segs[p.d + 1] ELSE '*' END ORDER BY p.d) AS gen
    FROM places p LEFT JOIN wide w ON w.host = p.host AND w.up = p.segs[1:p.d] GROUP BY p.host, p.segs),
g AS MATERIALIZED (SELECT u.*, coalesce(s.gen, []) AS gen FROM u LEFT JOIN stars s ON s.host = u.host AND s.segs = u.segs),
prefixes AS (SELECT host, gen, blocked, unnest(range(len(gen) + 1)) AS d FROM g),
tree AS MATERIALIZED (SELECT host, gen[1:d] AS node, count(blocked)::DOUBLE AS k, coalesce(sum(blocked), 0)::DOUBLE AS b FROM prefixes GROUP BY ALL),
child AS (SELECT c.host, c.node, c.k, c.b, c.node[1:len(c.node) - 1] AS up,
    power(c.b * p.k - c.k * p.b, 2) <= 4.0 * c.k * p.b * (p.k - p.b) AS alike FROM tree c JOIN tree p ON p.host = c.host AND p.node = c.node[1:len(c.node) - 1] AND len(c.node) > 0),
pool AS (SELECT host, up, sum(k) AS k, sum(b) AS b FROM child WHERE alike GROUP BY ALL),
evidence AS MATERIALIZED (SELECT c.host, c.node, c.up, CASE WHEN c.alike THEN pool.k ELSE c.k END AS k, CASE WHEN c.alike THEN pool.b ELSE c.b END AS b FROM child c LEFT JOIN pool ON pool.host = c.host AND pool.up = c.up),
shares AS (SELECT host, node, (b + CAST({PRIOR} AS DOUBLE) * CAST(0.5 AS DOUBLE)) / (k + CAST({PRIOR} AS DOUBLE)) AS share FROM tree WHERE len(node) = 0
    UNION ALL SELECT e.host, e.node, (e.b + CAST({PRIOR} AS DOUBLE) * s.share) / (e.k + CAST({PRIOR} AS DOUBLE)) FROM shares s JOIN evidence e ON e.host = s.host AND e.up = s.node)
SELECT g.page_id, g.host, g.path, g.rule, array_to_string(list_concat([g.host], g.gen), '/') AS template, round(s.share, 9) AS share,
    CASE WHEN coalesce(g.blocked = 1, s.share > CAST({REJECT} AS DOUBLE)) THEN 'block' ELSE 'allow' END AS verdict
FROM g JOIN shares s ON s.host = g.host AND s.node = g.gen
"""
