"""More registered queries and their DuckDB counterparts: links, health, views, retrieval, extraction, shards and streams.

Where an operator needs a graph or a source tree that the tables lack, its rows are made from all rows of a table by their values, and the SQL states what must
come of them without repeating how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog
from .catalog import _DEGREE, _DEPS, ORACLE_SQL, QUERIES, graph_query, query  # noqa: F401  (both tables are filled here too)
from .functions import scalars
from .operators import annindex, ask, embed, fleet, graph, health, links, render, search, text, textindex, traverse, views
from .plans.view import VIEW_SQL, dealt, edges, nodes, read
from .plans.work import shared_folder, tasks_for, work_table
from .sources import extract, files, shards, sinks, web, xmlread
from .streaming import incremental


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- projections and links


@graph_query("SELECT node_id AS id, repo_id AS repo, kind, name, file || ':' || line_start AS cite, NULL::VARCHAR AS signature, NULL::VARCHAR AS doc FROM nodes")
def node_projection(spark, sf):
    return links.project_nodes(nodes(spark, sf))


@graph_query("SELECT src, dst, relation, confidence, CASE confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS conf_rank, source_line AS line FROM edges")
def edge_projection(spark, sf):
    return links.project_edges(edges(spark, sf))


_RW = """, rw AS (SELECT src, dst, CASE confidence WHEN 'EXTRACTED' THEN 'reads' WHEN 'INFERRED' THEN 'writes' ELSE 'calls' END AS relation, repo_id FROM edges WHERE relation = 'calls')
"""


@graph_query(_RW + """, f AS (SELECT src, relation, dst, name, kind, count(*) OVER () AS n, row_number() OVER (ORDER BY name, relation, src) AS r FROM rw JOIN nodes ON dst = node_id WHERE rw.repo_id = 'AFRICA/NATION_0' AND relation <> 'calls')
SELECT name, relation, src, kind, n > 40 AS truncated FROM f WHERE r <= 40""")
def data_flow(spark, sf):
    relation = F.when(F.col("confidence") == "EXTRACTED", "reads").when(F.col("confidence") == "INFERRED", "writes").otherwise("calls")
    rw = edges(spark, sf).where("relation = 'calls'").withColumn("relation", relation)
    return links.data_flow(nodes(spark, sf), rw, "AFRICA/NATION_0", 40).select("name", "relation", "src", "kind", "truncated")


@query("""WITH d AS (SELECT DISTINCT 'repo_' || source AS src, CASE lang WHEN 'en' THEN 'documented_by' WHEN 'fr' THEN 'discussed_in' ELSE 'mentions' END AS relation, lang || '-' || n_chars % 1000 AS name FROM documents)
SELECT src, relation, count(*) AS n_links, array_to_string(list_sort(list(name)), ',') AS names FROM d WHERE relation <> 'mentions' GROUP BY 1, 2""")
def external_links(spark, sf):
    rows = read(spark, sf, "documents").select(F.concat(F.lit("repo_"), "source").alias("src"), F.when(F.col("lang") == "en", "documented_by").when(F.col("lang") == "fr", "discussed_in").otherwise("mentions").alias("relation"), F.concat_ws("-", "lang", (F.col("n_chars") % 1000).cast("string")).alias("dst")).distinct()
    return links.external_links(rows.select(F.col("dst").alias("node_id"), F.col("dst").alias("name")).distinct(), rows, F.col("src").startswith("repo_"))


@query("""WITH s AS (SELECT 'w_' || item_id AS node_id, regexp_extract(text, '([A-Za-z]{4,})', 1) AS name FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([\\p{L}\\p{N}_]+)', 1))) AS name FROM documents)
SELECT DISTINCT node_id AS src, 'doc_' || doc_id AS dst, 'documented_by' AS relation, 'AMBIGUOUS' AS confidence FROM d JOIN s USING (name) UNION ALL SELECT 'repo_' || source, 'doc_' || doc_id, 'documented_by', 'INFERRED' FROM documents""")
def link_documents(spark, sf):
    docs = read(spark, sf, "documents")
    words = read(spark, sf, "benchmark").select(F.concat(F.lit("w_"), F.col("item_id").cast("string")).alias("node_id"), F.regexp_extract("text", "([A-Za-z]{4,})", 1).alias("name"))
    found = text.symbol_mentions(docs, words).withColumn("confidence", F.lit("AMBIGUOUS"))
    return links.link_documents(found, docs.select("doc_id", F.col("source").alias("repo_id")), "documented_by")


@query("""WITH f AS (SELECT DISTINCT c_nationkey AS repo_id, 'src/' || lower(c_mktsegment) || '.py' AS path FROM customer)
SELECT DISTINCT o_orderkey AS change_id, 'file_' || o.c_nationkey || '_' || path AS node_id, 'EXTRACTED' AS confidence FROM (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O') o JOIN f ON f.repo_id = o.c_nationkey AND f.path = 'src/' || lower(o.c_mktsegment) || '.py'""")
def match_files(spark, sf):
    c = read(spark, sf, "customer").withColumn("path", F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit(".py")))
    own = c.select(F.concat_ws("_", F.lit("file"), F.col("c_nationkey").cast("string"), "path").alias("node_id"), F.col("c_nationkey").alias("repo_id"), F.lit("file").alias("kind"), F.col("path").alias("name")).distinct()
    changes = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("change_id"), F.col("c_nationkey").alias("repo_id"), F.when(F.col("o_orderstatus") == "O", "docs/none.md").otherwise(F.col("path")).alias("path"))
    return links.match_files(changes, own)


@graph_query("SELECT DISTINCT f.p_brand || ' ' || f.p_name AS frame_id, node_id, 'AMBIGUOUS' AS confidence FROM part f JOIN nodes n ON n.kind = 'package' AND lower(n.name) = lower(f.p_name || ' ' || f.p_brand)")
def match_names(spark, sf):
    frames = read(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("frame_id"), F.lit("(packages)").alias("repo_id"), F.concat(F.lit(" "), F.upper(F.concat_ws(" ", "p_name", "p_brand")), F.lit("  ")).alias("name"))
    return links.match_names(frames, nodes(spark, sf), ["package", "class"])


@graph_query("""SELECT dst, count(*) AS n_sites, count(DISTINCT n.node_id) AS n_callers, count(*) - count(n.node_id) AS n_unattributed, min({'file': coalesce(file, ''), 'line': source_line}).file AS first_file, min({'file': coalesce(file, ''), 'line': source_line}).line AS first_line
FROM edges LEFT JOIN nodes n ON src = node_id WHERE relation = 'calls' GROUP BY 1""")
def call_site_table(spark, sf):
    return links.call_site_table(nodes(spark, sf), edges(spark, sf))


@graph_query("""SELECT node_id, name, file, n_sites, rank, (SELECT count(*) FROM s WHERE n_sites = least) - (SELECT count(*) FROM s WHERE n_sites = least AND rank <= 100) AS tied_out FROM (SELECT *, min(n_sites) OVER () AS least FROM s WHERE rank <= 100)""".replace("SELECT node_id", """, c AS (SELECT dst, count(*) AS n FROM edges WHERE relation = 'calls' GROUP BY 1),
s AS (SELECT node_id, name, file, coalesce(n, 0) AS n_sites, row_number() OVER (ORDER BY coalesce(n, 0) DESC, file NULLS FIRST, name, node_id)::INT AS rank FROM nodes LEFT JOIN c ON dst = node_id WHERE kind = 'package')
SELECT node_id""", 1))
def api_symbols(spark, sf):
    return links.api_symbols(nodes(spark, sf), edges(spark, sf), ["package"], 100)


@query("""WITH d AS (SELECT source AS repo_id, doc_id, lang AS title, substr(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '), 1, 300) AS snippet FROM documents)
SELECT repo_id, repo_id AS source, title, snippet, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id, title, snippet)::INT AS rank FROM d WHERE title <> '' OR snippet <> '' QUALIFY rank <= 8""")
def external_context(spark, sf):
    return links.external_context(read(spark, sf, "documents").select(F.col("source").alias("repo_id"), "doc_id", "source", F.col("lang").alias("title"), "text"))


@graph_query(_DEGREE + """, r AS (SELECT repo_id, name, degree FROM deg JOIN nodes USING (node_id) WHERE kind = 'class'),
t AS (SELECT DISTINCT repo_id, string_split(repo_id, '/')[-1] AS term, 1 AS own, NULL AS d FROM r UNION ALL SELECT repo_id, name, 0, degree FROM r),
o AS (SELECT repo_id, term, max(own) AS own, max(d) AS d FROM t WHERE length(term) >= 3 GROUP BY 1, 2)
SELECT repo_id, term, row_number() OVER (PARTITION BY repo_id ORDER BY own DESC, d DESC NULLS LAST, term)::INT AS rank FROM o QUALIFY rank <= 8""")
def build_terms(spark, sf):
    rows = graph.distinct_degree(edges(spark, sf)).join(nodes(spark, sf).where("kind = 'class'"), "node_id").select("repo_id", "name", "degree")
    return links.build_terms(dealt(spark, sf, rows, "degrees"))


@graph_query(_DEPS + """, h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS repo, url, html FROM pages),
hc AS (SELECT DISTINCT repo, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS e FROM h), he AS (SELECT DISTINCT repo, regexp_extract(url, '://[^/]*(/[^/?#]*)', 1) AS e FROM h),
t AS (SELECT user_id % 10 AS repo, event_type IN ('click', 'view') AS pub, event_type = 'purchase' AS con, json_extract_string(props, '$.k') AS topic FROM events)
SELECT src_repo, dst_repo, weight, 'package' AS flavour FROM deps
UNION ALL SELECT a.repo, b.repo, count(DISTINCT e), 'http' FROM hc a JOIN he b USING (e) WHERE a.repo <> b.repo GROUP BY 1, 2
UNION ALL SELECT a.repo::VARCHAR, b.repo::VARCHAR, count(DISTINCT a.topic), 'event' FROM (SELECT DISTINCT repo, topic FROM t WHERE pub) a JOIN (SELECT DISTINCT repo, topic FROM t WHERE con) b ON a.topic = b.topic AND a.repo <> b.repo GROUP BY 1, 2""")
def repo_edge_union(spark, sf):
    event = catalog.QUERIES["event_flow"](spark, sf)
    event = event.select(F.col("src_repo").cast("string").alias("src_repo"), F.col("dst_repo").cast("string").alias("dst_repo"), "weight")
    return links.repo_edge_union(catalog._deps(spark, sf), catalog.QUERIES["http_flow"](spark, sf), event)


@graph_query("""SELECT repo_id, string_split(repo_id, '/')[1] AS host, sum(n)::BIGINT AS n_nodes, string_agg(lang || '=' || n, ',' ORDER BY n DESC, lang) AS langs FROM (SELECT repo_id, lang, count(*) AS n FROM nodes WHERE NOT regexp_matches(repo_id, '^[(@]') GROUP BY 1, 2) GROUP BY 1""")
def repo_table(spark, sf):
    return graph.repo_table(nodes(spark, sf))


@graph_query("SELECT DISTINCT repo_id, CASE WHEN repo_id = '(packages)' THEN 'sentinel' ELSE 'repository' END AS kind, CASE WHEN repo_id = '(packages)' THEN NULL ELSE repo_id END AS of FROM nodes UNION ALL SELECT DISTINCT '@enrich:' || repo_id, 'enrich', repo_id FROM nodes WHERE kind = 'class'")
def list_partitions(spark, sf):
    n = nodes(spark, sf).select("repo_id", "kind")
    return graph.partitions(n.unionByName(n.where("kind = 'class'").withColumn("repo_id", F.concat(F.lit("@enrich:"), "repo_id"))))


@graph_query("SELECT repo_id, '/src/' || lower(repo_id) AS path FROM (SELECT DISTINCT repo_id FROM nodes) WHERE repo_id LIKE 'ASIA/%' OR lower(repo_id) LIKE 'africa/nation_1_'")
def repo_patterns(spark, sf):
    repos = nodes(spark, sf).select("repo_id").distinct().withColumn("path", F.concat(F.lit("/src/"), F.lower("repo_id")))
    return graph.repos_of_patterns(repos, ["asia/*", "./africa/nation_1?"])


@graph_query("SELECT CASE WHEN len(string_split(repo_id, '/')) > 1 THEN string_split(repo_id, '/')[1] ELSE '(ungrouped)' END AS grp, lang, count(*) AS n_nodes FROM nodes WHERE NOT regexp_matches(repo_id, '^[(@]') GROUP BY 1, 2")
def language_map(spark, sf):
    return graph.language_map(nodes(spark, sf))


@graph_query(_DEPS + """, w AS (SELECT repo_id, sum(weight)::BIGINT AS weight FROM (SELECT src_repo AS repo_id, weight FROM deps UNION ALL SELECT dst_repo, weight FROM deps) GROUP BY 1), k AS (SELECT repo_id, kind, count(*) AS n FROM nodes GROUP BY 1, 2),
o AS (SELECT repo_id, weight, sum(n)::BIGINT AS n_nodes, list(kind ORDER BY n DESC, kind)[1] AS main_kind FROM k JOIN w USING (repo_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY weight DESC, n_nodes DESC, repo_id)::INT AS rank FROM o QUALIFY rank <= 10""")
def ranked_overview(spark, sf):
    return graph.ranked_overview(catalog._deps(spark, sf), nodes(spark, sf), 10)


@graph_query(ORACLE_SQL["repo_edge_union"].split("SELECT src_repo, dst_repo, weight, 'package' AS flavour")[0][len(catalog.VIEW_SQL):] + ", u AS (SELECT src_repo, dst_repo, weight, 'package' AS flavour" + ORACLE_SQL["repo_edge_union"].split("SELECT src_repo, dst_repo, weight, 'package' AS flavour")[1] + """)
SELECT flavour, string_split(src_repo, '/')[1] AS src_ns, string_split(dst_repo, '/')[1] AS dst_ns, sum(weight)::BIGINT AS weight, count(*) AS n_edges FROM u GROUP BY 1, 2, 3""")
def c4_flavours(spark, sf):
    return graph.c4_flavours(QUERIES["repo_edge_union"](spark, sf))


@query(f"""SELECT repo AS ns, host AS system, sum(n_calls)::BIGINT AS n_calls FROM ({ORACLE_SQL["external_systems"]}) GROUP BY 1, 2""")
def system_context(spark, sf):
    return graph.system_context(QUERIES["external_systems"](spark, sf))


@graph_query("SELECT node_id, total, total > 500 AS truncated FROM (SELECT node_id, count(*) OVER () AS total FROM nodes) ORDER BY node_id LIMIT 500")
def clamped_listing(spark, sf):
    return graph.listing(nodes(spark, sf).select("node_id"), 10_000, "node_id")


@query("""WITH s AS (SELECT 'b_' || item_id AS node_id, regexp_extract(text, '([A-Za-z]{4,})', 1) AS name FROM benchmark UNION ALL SELECT 'c_' || item_id, regexp_extract(text, '([A-Za-z]{4,})', 1) || '-v' || item_id FROM benchmark),
n AS (SELECT name, count(*) AS n FROM s GROUP BY 1), t AS (SELECT doc_id, text || ' see ' || (SELECT max(name) FROM s WHERE node_id = 'c_' || doc_id % 40) AS text FROM documents),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([\\p{L}\\p{N}_]+)', 1))) AS name FROM t), e AS (SELECT doc_id, regexp_extract(text, ' see (.*)$', 1) AS name FROM t)
SELECT DISTINCT doc_id, node_id, CASE n WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM (FROM d UNION FROM e) JOIN s USING (name) JOIN n USING (name) WHERE length(name) >= 3""")
def compound_mentions(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("i"), F.regexp_extract("text", "([A-Za-z]{4,})", 1).alias("w"))
    compound = b.select(F.concat(F.lit("c_"), "i").alias("node_id"), F.concat("w", F.lit("-v"), "i").alias("name"))
    docs = read(spark, sf, "documents").withColumn("c", F.concat(F.lit("c_"), (F.col("doc_id") % 40).cast("string")))
    said = docs.join(compound.withColumnRenamed("node_id", "c"), "c").select("doc_id", F.concat("text", F.lit(" see "), "name").alias("text"))
    return text.mentions(said, b.select(F.concat(F.lit("b_"), "i").alias("node_id"), F.col("w").alias("name")).unionByName(compound))


# ---- resolution


_REFS = """WITH f AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) || p_size AS name, CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'SMALL' THEN 'javascript' WHEN 'MEDIUM' THEN 'typescript' WHEN 'PROMO' THEN 'java' WHEN 'LARGE' THEN 'c' END AS lang,
 CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'SMALL' THEN 'js' WHEN 'MEDIUM' THEN 'js' WHEN 'PROMO' THEN 'jvm' WHEN 'LARGE' THEN 'c' END AS fam, p_brand AS file, p_name LIKE 'old %' AS internal FROM part),
c AS (SELECT r.id AS src, r.name, r.file, d.id AS dst, (NOT d.internal OR d.file = r.file) AS seen FROM f r JOIN f d ON r.name = d.name AND (r.fam IS NULL OR d.fam IS NULL OR r.fam = d.fam)),
p AS (SELECT * FROM c QUALIFY seen OR NOT bool_or(seen) OVER (PARTITION BY src)),
q AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM p)
"""


def _refs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf, "part")
    lang = F.when(F.col("p_type") == "ECONOMY", "python").when(F.col("p_type") == "SMALL", "javascript").when(F.col("p_type") == "MEDIUM", "typescript").when(F.col("p_type") == "PROMO", "java").when(F.col("p_type") == "LARGE", "c")
    rows = p.select(F.col("p_partkey").alias("node_id"), F.concat(F.split("p_name", " ")[1], F.col("p_size").cast("string")).alias("name"), lang.alias("lang"), F.col("p_brand").alias("file"), F.col("p_name").startswith("old ").alias("internal"), F.lit("function").alias("kind"))
    return rows.select(F.col("node_id").alias("src"), "name", "lang", "file", F.lit(1).alias("line")), rows


@query(_REFS + "SELECT src, dst, 'calls' AS relation, CASE n WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, n::INT AS candidates FROM q WHERE n <= 6 AND src <> dst")
def reference_resolution(spark, sf):
    refs, defs = _refs(spark, sf)
    return graph.resolve_references(refs, defs, "calls", ["function"])[0].select("src", "dst", "relation", "confidence", "candidates")


@query(_REFS + "SELECT CASE WHEN n = 1 THEN 'resolved' WHEN n <= 6 THEN 'ambiguous' ELSE 'dropped' END AS fate, count(DISTINCT src) AS n FROM q GROUP BY 1")
def resolution_counts(spark, sf):
    refs, defs = _refs(spark, sf)
    return graph.resolve_references(refs, defs, "calls", ["function"])[1]


@query("""WITH c AS (SELECT DISTINCT replace(p_name, ' ', '.') || '.' || p_brand AS chain FROM part), q AS (SELECT p_partkey AS node_id, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '.') || '.' || p_brand ELSE split_part(p_name, ' ', 2) || '.' || p_brand END AS qualifier FROM part),
m AS (SELECT node_id, count(*) FILTER (WHERE chain = qualifier) AS w, min(chain) FILTER (WHERE chain = qualifier) AS wid, count(*) AS a, min(chain) AS aid FROM q JOIN c ON chain = qualifier OR ends_with(chain, '.' || qualifier) GROUP BY 1)
SELECT node_id, CASE WHEN w = 1 THEN wid ELSE aid END AS class_id FROM m WHERE w = 1 OR a = 1""")
def method_resolution(spark, sf):
    p = read(spark, sf, "part")
    chain = F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), "p_brand")
    classes = p.select(chain.alias("node_id"), F.col("p_brand").alias("name"), chain.alias("chain")).distinct()
    pending = p.select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 25, chain).otherwise(F.concat_ws(".", F.split("p_name", " ")[1], "p_brand")).alias("qualifier"))
    return graph.resolve_methods(pending, classes)


# ---- health, citations and gates


@graph_query("""SELECT count(*) AS repos, count(*) FILTER (WHERE c_acctbal >= 0 AND (c_nationkey % 5 = 0 OR c_nationkey % 7 = 0)) AS stale, count(*) FILTER (WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS empty, count(*) FILTER (WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY') AS shard,
 count(*) FILTER (WHERE c_acctbal < 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS unreadable, count(*) FILTER (WHERE c_nationkey % 7 = 0) AS parser_stale, (SELECT count(*) FROM edges) AS checked,
 (SELECT count(*) FROM edges WHERE src NOT IN (SELECT node_id FROM nodes) OR dst NOT IN (SELECT node_id FROM nodes)) AS dangling FROM customer""")
def graph_health(spark, sf):
    c = read(spark, sf, "customer")
    head = F.col("c_nationkey").cast("string")
    state = F.when(F.col("c_mktsegment") == "BUILDING", "empty").when(F.col("c_mktsegment") == "MACHINERY", "shard").otherwise("missing")
    repos = c.select(F.col("c_custkey").alias("repo_id"), F.when(F.col("c_acctbal") >= 0, head).alias("head"), F.when(F.col("c_nationkey") % 5 == 0, "old").otherwise(head).alias("indexed_head"), F.when(F.col("c_nationkey") % 7 == 0, "10").otherwise("11").alias("indexed_parser"), state.alias("state"))
    return health.graph_health(repos, nodes(spark, sf), edges(spark, sf), "11")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    lines = docs.select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    word = F.regexp_extract("text", r"([A-Za-z]{3,})", 1)
    kind = F.when(F.col("lang") == "de", "file").otherwise("function")
    at = F.when(F.col("lang") == "es", None).otherwise(F.col("n_chars") % 4).cast("int")
    n = docs.select(F.col("doc_id").alias("node_id"), F.col("source").alias("repo_id"), kind.alias("kind"), F.upper(word).alias("name"), F.when(F.col("n_chars") % 10 > 0, F.col("doc_id").cast("string")).alias("file"), at.alias("line_start"), F.when(F.col("lang") == "en", "sql").otherwise("c").alias("lang"))
    repos = docs.select(F.col("source").alias("repo_id"), (F.col("source") != "src3").alias("checkout")).distinct()
    wanted = docs.select(F.col("doc_id").alias("node_id")).unionByName(docs.select((F.col("doc_id") + 10**9).alias("node_id")).where("node_id % 100 = 0"))
    return health.verify_citations(n, repos, lines, wanted)


_CITED = """WITH l AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
c AS (SELECT doc_id AS node_id, source, lang, CASE WHEN n_chars % 10 > 0 THEN doc_id::VARCHAR END AS file, CASE WHEN lang = 'es' THEN NULL ELSE n_chars % 4 END AS line_start, upper(regexp_extract(text, '([A-Za-z]{3,})', 1)) AS name, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS n,
 (SELECT string_agg(text, chr(1)) FROM l WHERE l.doc_id = d.doc_id AND abs(l.line - n_chars % 4) <= 2) AS near FROM documents d),
k AS (SELECT node_id, CASE WHEN file IS NULL THEN 'no_citation' WHEN source = 'src3' THEN 'checkout_missing' WHEN lang = 'de' THEN '' WHEN coalesce(line_start, 0) = 0 THEN 'no_citation' WHEN line_start > n THEN 'line_out_of_range'
 WHEN NOT coalesce(contains(CASE WHEN lang = 'en' THEN lower(near) ELSE near END, CASE WHEN lang = 'en' THEN lower(name) ELSE name END), FALSE) THEN 'name_absent' ELSE '' END AS reason, CASE WHEN file IS NULL THEN '' WHEN line_start IS NULL THEN file ELSE file || ':' || line_start END AS cite FROM c
 UNION ALL SELECT doc_id + 1000000000, 'node_missing', '' FROM documents WHERE (doc_id + 1000000000) % 100 = 0),
v AS (SELECT node_id, CASE reason WHEN '' THEN 'verified' WHEN 'checkout_missing' THEN 'unverifiable' ELSE 'broken' END AS status, reason, cite FROM k)
"""


@query(_CITED + "SELECT * FROM v")
def verify_citations(spark, sf):
    return _cited(spark, sf)


@query(_CITED + """SELECT count(*) AS checked, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'broken') AS broken, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable,
 round(count(*) FILTER (WHERE status = 'verified') / count(*) FILTER (WHERE status <> 'unverifiable'), 4) AS verified_rate, (SELECT string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason) FROM (SELECT reason, count(*) AS n FROM v WHERE reason <> '' GROUP BY 1)) AS reasons FROM v""")
def citation_summary(spark, sf):
    return health.citation_summary(_cited(spark, sf))


@query("""WITH a AS (SELECT doc_id AS node_id, row_number() OVER (ORDER BY doc_id) AS rank, lang, quality FROM documents JOIN labels USING (doc_id)),
g AS (SELECT *, CASE lang WHEN 'fr' THEN 'unknown' WHEN 'en' THEN 'current' END AS gate FROM a), p AS (SELECT *, sum((gate IS NULL)::INT) OVER (ORDER BY rank) AS probe FROM g)
SELECT node_id, rank::INT AS rank, coalesce(gate, CASE WHEN probe > 32 THEN 'unchecked' WHEN quality = 1 THEN 'confirmed' ELSE 'drifted' END) AS state FROM p""")
def drift(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    answer = rows.select("rank", F.col("doc_id").alias("node_id"), F.lit("r").alias("repo_id"), F.col("doc_id").alias("file"), F.lit(100).alias("indexed_at"))
    there = rows.where("lang <> 'fr'").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("file"), F.when(F.col("lang") == "en", 99).otherwise(101).alias("mtime"))
    checks = rows.select(F.col("doc_id").alias("node_id"), F.when(F.col("quality") == 1, "verified").otherwise("broken").alias("status"))
    return health.drift(answer, there, checks)


@query(f"""WITH lk AS (SELECT DISTINCT doc_id FROM ({ORACLE_SQL["ngram_leak"]})), lp AS (SELECT DISTINCT doc_id FROM ({ORACLE_SQL["repeated_sentence_or_span"]}) WHERE looping)
SELECT DISTINCT doc_id, doc_id NOT IN (FROM lk) AND doc_id NOT IN (FROM lp) AS accepted, CASE WHEN doc_id IN (FROM lk) THEN 'prompt leakage' WHEN doc_id IN (FROM lp) THEN 'degenerate repetition' ELSE '' END AS reason FROM documents""")
def structural_gate(spark, sf):
    return health.structural_gate(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("""SELECT p_partkey AS page_id, p_size > 10 AND p_type <> 'SMALL' AS accepted, CASE WHEN p_size <= 10 THEN 'cites names the graph does not hold' WHEN p_type = 'SMALL' THEN 'less complete than the page' ELSE '' END AS reason,
 CASE WHEN p_size <= 10 THEN 'made up' WHEN p_type = 'SMALL' THEN 'Hubs' ELSE '' END AS names FROM part""")
def replacement_gate(spark, sf):
    p = read(spark, sf, "part")
    page = F.concat(F.lit("# Page\n\n## Size\n- `"), F.col("p_brand"), F.lit("` is large\n\n## Hubs\n- `"), F.col("p_name"), F.lit("`: 3 callers\n"))
    draft = F.concat(F.lit("It holds `"), F.col("p_brand"), F.lit("`"), F.when(F.col("p_type") == "SMALL", ".").otherwise(F.concat(F.lit(" and "), F.col("p_name"), F.lit("."))), F.when(F.col("p_size") <= 10, " See `made up`.").otherwise(""))
    return health.replacement_gate(p.select(F.col("p_partkey").alias("page_id"), draft.alias("draft"), page.alias("page")), ["Size", "Hubs"])


_CAPPED = _DEGREE + """, nd AS (SELECT repo_id, node_id, kind, file, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id)),
b AS (SELECT repo_id, count(*) AS n_nodes, count(DISTINCT file) AS n_files, greatest(15, least(80, count(*) // 1500))::INT AS cap FROM nodes GROUP BY 1),
g AS (SELECT repo_id, cap, file FROM nd JOIN b USING (repo_id) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY degree DESC, node_id) <= cap)
"""


@graph_query(_CAPPED + """SELECT b.repo_id, n_nodes, n_files, (SELECT count(*) FROM edges WHERE edges.repo_id = b.repo_id) AS n_edges, cap, (SELECT count(file) FROM g WHERE g.repo_id = b.repo_id) AS n_grounded,
 (SELECT string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) FROM (SELECT kind, count(*) AS n FROM nodes WHERE nodes.repo_id = b.repo_id GROUP BY 1)) AS kinds FROM b""")
def repo_brief(spark, sf):
    return health.repo_brief(nodes(spark, sf), edges(spark, sf))


# ---- views


_FLOORS = """RECURSIVE_FLOORS k AS (SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*), kind) AS i, count(*) OVER () AS m FROM own GROUP BY 1),
fl AS (SELECT i, kind, least(n, {total} // m) AS floor, {total} - least(n, {total} // m) AS rest FROM k WHERE i = 1 UNION ALL SELECT k.i, k.kind, least(n, rest // (m - k.i + 1)), rest - least(n, rest // (m - k.i + 1)) FROM fl JOIN k ON k.i = fl.i + 1)
"""


def _floors_sql(total: int) -> str:
    return _FLOORS.replace("RECURSIVE_FLOORS ", ", ").format(total=total)


@query(catalog.VIEW_SQL.replace("WITH nat", "WITH RECURSIVE nat") + _DEGREE + """, own AS (SELECT node_id, kind, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id) WHERE repo_id = 'AFRICA/NATION_0'),
outs AS (SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT node_id FROM own)),
away AS (SELECT dst AS node_id, kind, count(*) AS degree FROM outs JOIN nodes ON dst = node_id WHERE repo_id <> 'AFRICA/NATION_0' GROUP BY 1, 2),
room AS (SELECT least(least((SELECT count(*) FROM away), 100), greatest(100 - least((SELECT count(*) FROM own), 100), 20)) AS r)""" + _floors_sql(50) + """, w AS (SELECT own.*, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, node_id) AS q FROM own),
ins AS (SELECT node_id, kind, degree, TRUE AS own FROM w JOIN fl USING (kind) QUALIFY row_number() OVER (ORDER BY q <= floor DESC, degree DESC, node_id) <= 100 - (SELECT r FROM room))
SELECT * FROM ins UNION ALL (SELECT node_id, kind, degree, FALSE FROM away QUALIFY row_number() OVER (ORDER BY degree DESC, node_id) <= (SELECT r FROM room))""")
def repo_subgraph(spark, sf):
    return views.repo_subgraph(nodes(spark, sf), edges(spark, sf), "AFRICA/NATION_0", most=100)[0]


def _kinds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands as classes and tables, types as interfaces and views, the second words of names as methods."""
    p = read(spark, sf, "part")
    brand, kind_ = F.replace("p_brand", F.lit("#"), F.lit("_")), F.col("p_type")
    n = p.select(brand.alias("node_id"), brand.alias("name"), F.lit("class").alias("kind")).union(p.select(kind_, kind_, F.lit("interface"))).union(p.select(F.split("p_name", " ")[1], F.split("p_name", " ")[1], F.lit("method"))).distinct()
    e = p.select(brand.alias("src"), kind_.alias("dst"), F.lit("inherits").alias("relation")).union(p.where("p_size > 45").select(brand, F.split("p_name", " ")[1], F.lit("contains"))).union(p.select(brand, kind_, F.lit("references"))).distinct()
    return n, e


_KINDS = "WITH p AS (SELECT replace(p_brand, '#', '_') AS brand, p_type AS t, split_part(p_name, ' ', 2) AS w, p_size FROM part)"


@query(_KINDS + "SELECT DISTINCT brand AS node_id, 'class' AS kind FROM p")
def subclasses_of_interfaces(spark, sf):
    n, e = _kinds(spark, sf)
    return graph.sources_of(n, e, n.where("kind = 'interface'"), "inherits").select("node_id", "kind")


@query(_KINDS + """, m AS (SELECT brand, string_agg(DISTINCT '    +' || w || '()' || chr(10), '' ORDER BY '    +' || w || '()' || chr(10)) AS b FROM p WHERE p_size > 45 GROUP BY 1),
l AS (SELECT DISTINCT 0 AS part, brand AS key, '  class ' || brand || '["' || brand || '"]' || coalesce(' {' || chr(10) || b || '  }', '') AS line FROM p LEFT JOIN m USING (brand)
 UNION SELECT 0, t, '  class ' || t || '["' || t || '"] {' || chr(10) || '    <<interface>>' || chr(10) || '  }' FROM p UNION SELECT 1, t || '|' || brand, '  ' || t || ' <|.. ' || brand FROM p)
SELECT 'classDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, key) AS mermaid FROM l""")
def class_diagram(spark, sf):
    return views.class_diagram(*_kinds(spark, sf))


@query(_KINDS + """, l AS (SELECT DISTINCT 0 AS part, t || '|' || brand AS key, '  ' || t || ' ||--o{ ' || brand || ' : references' AS line FROM p)
SELECT 'erDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, key) AS mermaid FROM l""")
def er_diagram(spark, sf):
    n, e = _kinds(spark, sf)
    kind = F.when(F.col("kind") == "class", "table").when(F.col("kind") == "interface", "view").otherwise(F.col("kind"))
    return views.er_diagram(n.withColumn("kind", kind), e)


@query("""WITH t AS (SELECT 'chat' AS entity, role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations),
l AS (SELECT DISTINCT source || '|' || target || '|say' AS k, '    ' || source || ' --> ' || target || ' : say' AS line FROM t WHERE target IS NOT NULL)
SELECT 'stateDiagram-v2' || chr(10) || '  state chat {' || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10) || '  }' AS mermaid FROM l""")
def state_diagram(spark, sf):
    following = F.expr("lead(role) over (partition by conv_id order by turn)")
    return views.state_diagram(read(spark, sf, "conversations").select(F.lit("chat").alias("entity"), F.col("role").alias("source"), following.alias("target"), F.lit("say").alias("method")).where("target is not null"))


@query("""WITH r AS (SELECT DISTINCT 'r_' || lower(p_type) || '_' || split_part(p_name, ' ', 2) AS node_id, CASE p_type WHEN 'ECONOMY' THEN 'aws_instance' WHEN 'SMALL' THEN 'aws_s3_bucket' WHEN 'MEDIUM' THEN 'aws_db_proxy' WHEN 'PROMO' THEN 'aws_subnet' WHEN 'STANDARD' THEN 'aws_iam_policy' ELSE 'aws_sns_topic' END || '.' || split_part(p_name, ' ', 2) AS name,
 CASE p_type WHEN 'ECONOMY' THEN 'compute' WHEN 'SMALL' THEN 'storage' WHEN 'MEDIUM' THEN 'database' WHEN 'PROMO' THEN 'network' WHEN 'STANDARD' THEN 'identity' ELSE 'other' END AS category, p_type AS t, split_part(p_name, ' ', 2) AS w FROM part),
b AS (SELECT 0 AS part, category AS key, '  subgraph ' || category || chr(10) || string_agg('    ' || node_id || '["' || name || '"]', chr(10) ORDER BY node_id) || chr(10) || '  end' AS line FROM r GROUP BY category),
a AS (SELECT 1, x.node_id || '|' || y.node_id, '  ' || x.node_id || ' --> ' || y.node_id FROM r x JOIN r y ON x.w = y.w AND x.t = 'ECONOMY' AND y.t = 'SMALL')
SELECT 'flowchart TB' || chr(10) || string_agg(line, chr(10) ORDER BY part, key) AS mermaid FROM (FROM b UNION ALL FROM a)""")
def deployment_diagram(spark, sf):
    kind = {"ECONOMY": "aws_instance", "SMALL": "aws_s3_bucket", "MEDIUM": "aws_db_proxy", "PROMO": "aws_subnet", "STANDARD": "aws_iam_policy", "LARGE": "aws_sns_topic"}
    word = F.split("p_name", " ")[1]
    names = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    r = read(spark, sf, "part").select(F.concat_ws("_", F.lit("r"), F.lower("p_type"), word).alias("node_id"), F.concat_ws(".", F.element_at(names, F.col("p_type")), word).alias("name"), "p_type", word.alias("w")).distinct()
    e = r.where("p_type = 'ECONOMY'").select(F.col("node_id").alias("src"), "w").join(r.where("p_type = 'SMALL'").select(F.col("node_id").alias("dst"), "w"), "w").select("src", "dst", F.lit("depends_on").alias("relation"))
    return views.deployment_diagram(r.select("node_id", "name"), e)


@graph_query("""SELECT 'nodes' AS grp, node_id AS id, '{"id":"' || node_id || '","label":"' || name || '","kind":"' || kind || '","degree":' || (SELECT count(*) FROM (SELECT src AS e FROM edges WHERE relation = 'contains' UNION ALL SELECT dst FROM edges WHERE relation = 'contains') WHERE e = node_id) || '}' AS data FROM nodes WHERE kind <> 'package' AND kind <> 'function'
UNION ALL SELECT 'edges', src || '|contains|' || dst, '{"id":"' || src || '|contains|' || dst || '","source":"' || src || '","target":"' || dst || '","label":"contains"}' FROM edges WHERE relation = 'contains'""")
def cytoscape(spark, sf):
    return views.cytoscape(nodes(spark, sf).where("kind not in ('package', 'function')"), edges(spark, sf).where("relation = 'contains'"))


_C4 = _DEPS + """, c4 AS (SELECT string_split(src_repo, '/')[1] AS s, string_split(dst_repo, '/')[1] AS d, sum(weight)::BIGINT AS w FROM deps GROUP BY 1, 2)
"""


@graph_query(_C4 + """SELECT 'digraph c4 {' || chr(10) || string_agg(line, chr(10) ORDER BY part, key) || chr(10) || '}' AS dot FROM (SELECT DISTINCT 0 AS part, ns AS key, '  "' || ns || '" [shape=box];' AS line FROM (SELECT s AS ns FROM c4 UNION SELECT d FROM c4)
 UNION ALL SELECT 1, s || '|' || d, '  "' || s || '" -> "' || d || '" [label="' || w || '"' || CASE WHEN s <> d THEN ', style=dashed' ELSE '' END || '];' FROM c4)""")
def c4_dot(spark, sf):
    return views.c4_dot(graph.c4_edges(catalog._deps(spark, sf)))


@graph_query(_C4 + """SELECT ns, coalesce((SELECT sum(w) FROM c4 WHERE d = ns AND s <> ns), 0)::BIGINT AS weight_in, coalesce((SELECT sum(w) FROM c4 WHERE s = ns AND d <> ns), 0)::BIGINT AS weight_out, coalesce((SELECT sum(w) FROM c4 WHERE s = ns AND d = ns), 0)::BIGINT AS internal, ns IN ('ASIA', 'EUROPE') AS included
FROM (SELECT s AS ns FROM c4 UNION SELECT d FROM c4)""")
def c4_payload(spark, sf):
    return views.c4_payload(graph.c4_edges(catalog._deps(spark, sf)), ["ASIA", "EUROPE"])


@query("""WITH s AS (SELECT p_brand AS file, p_name AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand, p_name) AS rank FROM part GROUP BY 1, 2 QUALIFY rank <= 60),
f AS (SELECT file, min(rank) AS part, '## ' || file || chr(10) || string_agg('- `' || name || '`: ' || n || ' call sites', chr(10) ORDER BY rank) AS line FROM s GROUP BY 1)
SELECT '# API' || chr(10) || string_agg(line, chr(10) ORDER BY part) AS markdown FROM f""")
def api_reference(spark, sf):
    from pyspark.sql import Window

    order = (F.desc("n_sites"), "file", "name")
    rows = read(spark, sf, "part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n_sites")).orderBy(*order).limit(60)
    return views.api_reference(rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("tied_out", F.lit(0)), "API")


@query("""WITH v AS (SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) AS f FROM part GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p_brand) >= 2), c AS (SELECT p_brand AS package, count(DISTINCT p_type) AS r, count(DISTINCT p_size) > 1 AS dis FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)
SELECT '# Design notes' || chr(10) || '## Load-bearing values' || chr(10) || (SELECT string_agg('- `' || name || '` at ' || n || ' places in ' || f || ' files', chr(10) ORDER BY n DESC, name) FROM v) || chr(10) || '## Shared packages' || chr(10)
 || (SELECT string_agg('- `' || package || '`: ' || r || ' repositories' || CASE WHEN dis THEN ', which disagree' ELSE '' END, chr(10) ORDER BY package) FROM c) AS markdown""")
def design_page(spark, sf):
    p = read(spark, sf, "part")
    values = graph.load_bearing(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.lit("EXTRACTED").alias("confidence")))
    return views.design_page(values, fleet.commitments(p.select(F.col("p_brand").alias("package"), F.col("p_type").alias("repo"), F.lit("m").alias("manifest"), F.col("p_size").cast("string").alias("constraint"))))


def _floored_sql(name: str, n: str, least: str) -> str:
    return f"""{name}_r AS (SELECT repo_id, node_id, kind, name, coalesce({n}, 0) AS n FROM nodes LEFT JOIN deg USING (node_id) WHERE {least}),
{name}_h AS (SELECT x.*, cap, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, node_id) AS r FROM {name}_r x JOIN b USING (repo_id) QUALIFY r <= cap),
{name}_m AS (SELECT repo_id, node_id, kind, name, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, node_id) AS k FROM (SELECT x.*, cap FROM {name}_r x JOIN b USING (repo_id) WHERE (repo_id, kind) NOT IN (SELECT repo_id, kind FROM {name}_h) QUALIFY row_number() OVER (PARTITION BY repo_id, kind ORDER BY n DESC, node_id) = 1) QUALIFY k <= cap // 2),
{name} AS (SELECT repo_id, node_id, name, n, r AS place FROM {name}_h h WHERE r <= cap - (SELECT count(*) FROM {name}_m m WHERE m.repo_id = h.repo_id) UNION ALL SELECT repo_id, node_id, name, n, 1000 + k FROM {name}_m)"""


@graph_query(_CAPPED + ", " + ", ".join(_floored_sql(*x) for x in (("tops", "degree", "TRUE"), ("hubs", "n_in", "n_in > 0"), ("disp", "n_out", "n_out > 0"))) + """,
own AS (SELECT DISTINCT repo_id, dst FROM edges WHERE relation = 'publishes'), need AS (SELECT DISTINCT repo_id, dst FROM edges WHERE relation = 'depends_on' AND (repo_id, dst) NOT IN (SELECT repo_id, dst FROM own)),
pk AS (SELECT 'own' AS side, repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY name, dst) AS r FROM own JOIN nodes n2(node_id, r2, kind, name, file, line_start, lang) ON dst = n2.node_id UNION ALL SELECT 'need', repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY name, dst) FROM need JOIN nodes n3(node_id, r2, kind, name, file, line_start, lang) ON dst = n3.node_id),
fl AS (SELECT repo_id, file, row_number() OVER (PARTITION BY repo_id ORDER BY file) AS r FROM (SELECT DISTINCT repo_id, file FROM nodes WHERE file IS NOT NULL)),
gr AS (SELECT repo_id, count(DISTINCT node_id) AS n FROM (SELECT repo_id, node_id FROM tops UNION SELECT repo_id, node_id FROM hubs UNION SELECT repo_id, node_id FROM disp) WHERE node_id IN (SELECT node_id FROM nodes WHERE file IS NOT NULL) GROUP BY 1)
SELECT b.repo_id, n_nodes, n_files, (SELECT count(file) FROM nodes WHERE nodes.repo_id = b.repo_id) AS coverage_total, (SELECT count(*) FROM edges WHERE edges.repo_id = b.repo_id) AS n_edges, coalesce((SELECT n FROM gr WHERE gr.repo_id = b.repo_id), 0) AS grounded_count, FALSE AS generated,
coalesce((SELECT string_agg(name, ',' ORDER BY place) FROM tops WHERE tops.repo_id = b.repo_id), '') AS top_symbols, coalesce((SELECT string_agg(name || '=' || n, ',' ORDER BY place) FROM hubs WHERE hubs.repo_id = b.repo_id), '') AS hubs, coalesce((SELECT string_agg(name || '=' || n, ',' ORDER BY place) FROM disp WHERE disp.repo_id = b.repo_id), '') AS dispatchers,
(SELECT string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) FROM (SELECT kind, count(*) AS n FROM nodes WHERE nodes.repo_id = b.repo_id GROUP BY 1)) AS kinds, 'py=' || n_nodes AS langs,
coalesce((SELECT string_agg(name, ',' ORDER BY r) FROM pk WHERE side = 'own' AND r <= 20 AND pk.repo_id = b.repo_id), '') AS own_packages, (SELECT count(*) FROM own WHERE own.repo_id = b.repo_id) AS n_own_packages, coalesce((SELECT string_agg(name, ',' ORDER BY r) FROM pk WHERE side = 'need' AND r <= 20 AND pk.repo_id = b.repo_id), '') AS needed_packages, (SELECT count(*) FROM need WHERE need.repo_id = b.repo_id) AS n_needed_packages,
coalesce((SELECT string_agg(file, ',' ORDER BY r) FROM fl WHERE r <= 20 AND fl.repo_id = b.repo_id), '') AS files, '' AS decisions FROM b""")
def whole_brief(spark, sf):
    return health.whole_brief(nodes(spark, sf), edges(spark, sf), tasks_for(spark, read(spark, sf, "lineitem").count()))


@graph_query(_CAPPED + """, hub AS (SELECT repo_id, name, n_in AS n, row_number() OVER (PARTITION BY repo_id ORDER BY n_in DESC, node_id) AS rank FROM nodes JOIN deg USING (node_id) WHERE n_in > 0 QUALIFY rank <= 5),
dis AS (SELECT repo_id, name, n_out AS n, row_number() OVER (PARTITION BY repo_id ORDER BY n_out DESC, node_id) AS rank FROM nodes JOIN deg USING (node_id) WHERE n_out > 0 QUALIFY rank <= 5)
SELECT b.repo_id, '# ' || b.repo_id || chr(10) || chr(10) || '## Size' || chr(10) || n_nodes || ' nodes in ' || n_files || ' files, ' || (SELECT count(*) FROM edges WHERE edges.repo_id = b.repo_id) || ' edges' || chr(10) || chr(10) || '## Kinds' || chr(10)
 || (SELECT string_agg('- `' || kind || '`: ' || n, chr(10) ORDER BY n DESC, kind) FROM (SELECT kind, count(*) AS n FROM nodes WHERE nodes.repo_id = b.repo_id GROUP BY 1))
 || coalesce(chr(10) || chr(10) || '## Hubs' || chr(10) || (SELECT string_agg('- `' || name || '`: ' || n || ' callers', chr(10) ORDER BY rank) FROM hub WHERE hub.repo_id = b.repo_id), '')
 || coalesce(chr(10) || chr(10) || '## Dispatchers' || chr(10) || (SELECT string_agg('- `' || name || '`: ' || n || ' callees', chr(10) ORDER BY rank) FROM dis WHERE dis.repo_id = b.repo_id), '') AS markdown FROM b""")
def structural_page(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    degree = graph.distinct_degree(e).join(n, "node_id")

    def best(by: str) -> DataFrame:
        order = Window.partitionBy("repo_id").orderBy(F.desc(by), "node_id")
        return degree.where(F.col(by) > 0).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("repo_id", "rank", "name", F.col(by).alias("count"))

    return views.structural_page(health.repo_brief(n, e), best("n_in"), best("n_out"))


@query("""SELECT doc_id, substr(sha256(text), 1, 12) AS digest, lang AS head, TRUE AS intact FROM documents""")
def document_stamps(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", views.stamp(F.col("text"), F.col("lang")).alias("d"))
    return rows.select("doc_id", views.read_stamp(F.col("d")).alias("s")).select("doc_id", "s.*")


# ---- traversal


@graph_query("""SELECT dst AS seed, count(DISTINCT src) AS n_hits, count(DISTINCT src) AS n_direct, count(DISTINCT src) FILTER (WHERE confidence = 'EXTRACTED') AS n_sure, 1 AS furthest FROM edges WHERE relation IN ('calls', 'depends_on') AND dst IN (SELECT node_id FROM nodes WHERE kind = 'package' AND name LIKE 'old%') GROUP BY 1""")
def impact_index(spark, sf):
    seeds = nodes(spark, sf).where("kind = 'package' and name like 'old%'").select("node_id")
    return traverse.impact_index(edges(spark, sf), seeds)


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT 'order_' || min(k) FILTER (WHERE r = 1) AS seed, count(*) - 1 AS n_hits, 1::BIGINT AS n_direct, count(*) FILTER (WHERE r > 1 AND s = 'F') AS n_sure, (count(*) - 1)::INT AS furthest FROM o WHERE r <= 4 GROUP BY c HAVING count(*) > 1""")
def impact_depth(spark, sf):
    """Every order calls the one before it of its customer, so what the first one reaches lies one, two and three hops away."""
    o = read(spark, sf, "orders").withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    key = lambda c: F.concat(F.lit("order_"), F.col(c).cast("string"))
    calls = o.where("before is not null").select(key("o_orderkey").alias("src"), key("before").alias("dst"), F.lit("calls").alias("relation"), F.when(F.col("o_orderstatus") == "F", "EXTRACTED").otherwise("INFERRED").alias("confidence"))
    return traverse.impact_index(calls, o.where("before is null").select(key("o_orderkey").alias("node_id")))


_SEQUENCE = """WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS newest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
calls AS (SELECT 'order_' || k AS src, 'order_' || before AS dst, 4 AS line FROM o WHERE before IS NOT NULL UNION ALL SELECT 'order_' || k, 'order_' || newest, NULL FROM o WHERE before IS NULL UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY line NULLS LAST, dst) AS rank FROM calls),
s(start, place, path, src, dst, line) AS (SELECT src, [rank], [src], src, dst, line FROM r WHERE src IN (SELECT 'order_' || newest FROM o)
 UNION ALL SELECT start, list_append(place, r.rank), list_append(path, r.src), r.src, r.dst, r.line FROM s JOIN r ON r.src = s.dst WHERE NOT list_contains(path, s.dst)),
t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY place) AS n FROM s)
"""


@query(_SEQUENCE + "SELECT start, (n - 1)::INT AS step, len(place)::INT AS depth, src, dst, line::INT AS line, list_contains(path, dst) AS back FROM t WHERE n <= 40")
def call_sequences(spark, sf):
    """Every order calls the one before it of its customer, amid its parts, and the oldest calls the newest again: the first 40 calls from each customer's newest order."""
    w = Window.partitionBy("o_custkey")
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w.orderBy("o_orderkey")).alias("before"), F.max("o_orderkey").over(w).alias("newest"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))
    row = lambda df, src, dst, line: df.select(src.alias("src"), dst.alias("dst"), line.cast("int").alias("line"))
    calls = row(o.where("before is not null"), key("order", "o_orderkey"), key("order", "before"), F.lit(4)).unionByName(row(o.where("before is null"), key("order", "o_orderkey"), key("order", "newest"), F.lit(None)))
    calls = calls.unionByName(row(read(spark, sf, "lineitem"), key("order", "l_orderkey"), key("part", "l_partkey"), F.col("l_linenumber")))
    return traverse.call_sequences(calls, o.where("o_orderkey = newest").select(key("order", "newest").alias("node_id")), 40, tasks_for(spark, read(spark, sf, "lineitem").count()))


@graph_query(f""", p AS ({ORACLE_SQL["shortest_path"]}), st AS (SELECT a.step, a.node_id AS f, b.node_id AS t FROM p a JOIN p b ON b.step = a.step + 1),
w AS (SELECT step, f AS from_id, t AS to_id, relation, confidence, source_line AS line, src = f AS forward, row_number() OVER (PARTITION BY step ORDER BY {catalog._RANK}, src <> f, relation, source_line NULLS FIRST) AS r FROM st JOIN edges ON (src = f AND dst = t) OR (src = t AND dst = f))
SELECT step::INT AS step, from_id, to_id, relation, confidence, line, forward FROM w WHERE r = 1""")
def path_citations(spark, sf):
    e = edges(spark, sf)
    return traverse.path_citations(e, traverse.shortest_path(e, "customer_1", "supplier_2"))


# ---- retrieval


@graph_query("SELECT node_id, concat_ws(' ', kind, name, file) AS text FROM nodes")
def node_texts(spark, sf):
    n = nodes(spark, sf)
    return n.select("node_id", embed.node_text(n).alias("text"))


@graph_query(""", w AS (SELECT node_id, name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(coalesce(lower(file), ''), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM nodes),
f AS (SELECT node_id, name, len(a) + len(b) AS len, 10 * len(list_filter(a, lambda x: starts_with(x, 'old'))) + len(list_filter(b, lambda x: starts_with(x, 'old'))) AS f0, 10 * len(list_filter(a, lambda x: starts_with(x, 'brand'))) + len(list_filter(b, lambda x: starts_with(x, 'brand'))) AS f1 FROM w),
t AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM f)
SELECT node_id, name, lower(name) = 'old brand' AS exact, starts_with(lower(name), 'old brand') AS prefix, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)), 4) AS score
FROM f, t WHERE f0 > 0 AND f1 > 0 ORDER BY exact DESC, prefix DESC, score DESC, node_id LIMIT 10""")
def fts_bm25(spark, sf):
    return search.fts_bm25(nodes(spark, sf), "old brand")


@graph_query(ORACLE_SQL["fts_bm25"].removeprefix(VIEW_SQL))
def fts_index(spark, sf):
    """The same from a stored index."""
    index = textindex.TextIndex(spark, _folder(spark, "text-index"))
    index.build(nodes(spark, sf))
    return index.search("old brand")


@graph_query(ORACLE_SQL["fts_bm25"].removeprefix(VIEW_SQL).replace("'old brand'", "'order 1'").replace("'old'", "'order'").replace("'brand'", "'1'"))
def fts_index_refreshed(spark, sf):
    """An index of nodes that were named otherwise, and of some that are gone, after both were refreshed."""
    n = nodes(spark, sf)
    changed = n.where(F.crc32("node_id") % 3 == 0)
    before = n.withColumn("name", F.when(F.crc32("node_id") % 3 == 0, F.concat(F.lit("former "), "name")).otherwise(F.col("name")))
    gone = n.where(F.crc32("node_id") % 5 == 0).withColumn("node_id", F.concat(F.lit("gone_"), "node_id"))
    index = textindex.TextIndex(spark, _folder(spark, "text-index"))
    index.build(before.unionByName(gone))
    index.refresh(changed, gone)
    return index.search("order 1")


@graph_query(ORACLE_SQL["fts_bm25"].removeprefix(VIEW_SQL).replace("'old brand'", "'order 1'").replace("'old'", "'order'").replace("'brand'", "'1'").replace("FROM nodes)", "FROM nodes WHERE repo_id LIKE 'ASIA/%')"))
def scoped_search(spark, sf):
    """A search within some repositories: their pattern becomes a scope, and the scope is met by a join before the search."""
    n = nodes(spark, sf)
    return search.fts_bm25(graph.in_scope(n, graph.repos_matching(n, "asia/*")), "order 1")


@query(f"""WITH d AS (SELECT *, manifest % 3 AS depth, min(manifest % 3) OVER (PARTITION BY repo) AS m, CASE manifest % 2 WHEN 0 THEN 'requires' ELSE 'dev_requires' END AS side FROM ({catalog._COMMIT})), own AS (SELECT DISTINCT repo, package FROM d WHERE manifest % 5 = 0),
e AS (SELECT repo, side, package, coalesce(array_to_string(list_sort(list_distinct(list(con) FILTER (WHERE con IS NOT NULL))), ', '), '') AS c FROM d WHERE depth = m AND (repo, package) NOT IN (SELECT repo, package FROM own) GROUP BY 1, 2, 3 UNION ALL SELECT repo, 'publishes', package, '' FROM own),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, side ORDER BY lower(package), package) AS r FROM e)
SELECT repo, side, string_agg(rtrim(package || ' ' || c), '; ' ORDER BY r) FILTER (WHERE r <= 20) AS listed, count(*) AS total FROM r GROUP BY 1, 2""")
def package_lists(spark, sf):
    d = catalog._constraints(spark, sf).withColumn("depth", F.col("manifest") % 3).withColumn("group", F.when(F.col("manifest") % 2 == 0, "runtime").otherwise("dev"))
    return fleet.package_lists(d, d.where("manifest % 5 = 0").select("repo", "package"))


_ASKED = "vec_id % 50 = 0"


@query("SELECT count(*) * 10 AS n_rows, TRUE AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def ann_topk(spark, sf):
    """These vectors lie in all directions, so that most lists are read and more is compared exactly; the neighbours are held against exact search."""
    v = read(spark, sf, "embeddings")
    found = work_table(embed.ann_topk(v, v.where(_ASKED), 10, 0.85, 20), "ann")
    exact = search.knn_edges(v, 10, queries=v.where(_ASKED)).select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"))
    hit = found.join(exact.withColumn("h", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_rows"), (F.coalesce(F.sum("h"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("recalled"))


@query("SELECT count(*) * 10 AS n_rows, TRUE AS recalled, TRUE AS sparing FROM embeddings WHERE vec_id % 50 = 0")
def ann_clustered(spark, sf):
    """The same vectors drawn towards 40 places by their ids: a tenth of them is read, and nine tenths of the neighbours are found."""
    place = F.transform(F.col("embedding"), lambda x, i: (x * 0.15 + (F.pmod(F.xxhash64(F.col("vec_id") % 40, i), F.lit(2001)) / 1000 - 1)).cast("float"))
    v = work_table(read(spark, sf, "embeddings").select("vec_id", place.alias("embedding")), "clustered")
    q = v.where(_ASKED)
    index = annindex.AnnIndex(v)
    found = work_table(index.search(q, 10, 0.1), "ann")
    exact = search.knn_edges(v, 10, queries=q).select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"))
    hit = found.join(exact.withColumn("h", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_rows"), (F.coalesce(F.sum("h"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("recalled"), F.lit(index.read_share(q, 0.1) <= 0.11).alias("sparing"))


@query(f"""WITH m AS ({ORACLE_SQL["eval_metrics"]}), knn AS ({catalog._KNN}), r AS (SELECT src AS query_id, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM knn),
t AS (SELECT query_id, sum(greatest(1, length('vector v' || dst || ' label' || label) // 4)) AS t FROM r JOIN embeddings ON dst = vec_id WHERE rank <= 2 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(hit::INT), 4) AS hit_rate, round(avg(coalesce(t, 0)), 4) AS est_tokens, round(avg(precision) / (avg(coalesce(t, 0)) / 1000), 4) AS precision_per_1k FROM m LEFT JOIN t USING (query_id)""")
def retrieval_summary(spark, sf):
    v = read(spark, sf, "embeddings")
    ranked = search.knn_edges(v, 3).select(F.col("src").alias("query_id"), F.col("dst").alias("node_id"), F.expr("row_number() over (partition by src order by score desc, dst)").alias("rank"))
    n = v.select(F.col("vec_id").alias("node_id"), F.lit("vector").alias("kind"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("file"))
    return search.run_summary(catalog.QUERIES["eval_metrics"](spark, sf), ranked, n, 2)


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'impact' WHEN '2-HIGH' THEN 'callers' WHEN '3-MEDIUM' THEN 'definition' WHEN '4-NOT SPECIFIED' THEN 'dependents' ELSE CASE o_orderstatus WHEN 'F' THEN 'owners' WHEN 'O' THEN 'subclasses' ELSE 'search' END END AS route, 'order_' || o_orderkey AS target FROM orders""")
def question_routes(spark, sf):
    o, key, p = read(spark, sf, "orders"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")
    say = lambda a, b="": F.concat(F.lit(a), key, F.lit(b))
    last = F.when(F.col("o_orderstatus") == "F", say("who owns the ")).when(F.col("o_orderstatus") == "O", say("subclasses of ")).otherwise(say("logic for refunding "))
    q = F.when(p == "1-URGENT", say("what breaks if I change ")).when(p == "2-HIGH", say("Who calls ", "? List every caller.")).when(p == "3-MEDIUM", say("where is `", "` defined")).when(p == "4-NOT SPECIFIED", say("which repos use ")).otherwise(last)
    rows = o.select(F.col("o_orderkey").alias("id"), q.alias("q"))
    return rows.select("id", fleet.route(F.col("q")).alias("route"), fleet.target_of(F.col("q")).alias("target"))


@graph_query("""SELECT n.node_id, name, n.repo_id, confidence, source_line FROM edges e JOIN nodes n ON e.src = n.node_id WHERE relation = 'calls' AND dst = 'part_7'""")
def ask_callers(spark, sf):
    return ask.ask(nodes(spark, sf), edges(spark, sf), "who calls part_7", k=100_000).rows.select("node_id", "name", "repo_id", "confidence", "source_line")


@graph_query("""SELECT node_id, name, (regexp_matches(lower(concat_ws(' ', name, file)), '(^|[^a-z0-9])anvil'))::INT AS score FROM nodes WHERE regexp_matches(lower(concat_ws(' ', name, file)), '(^|[^a-z0-9])anvil') ORDER BY node_id LIMIT 25""")
def ask_search(spark, sf):
    return ask.ask(nodes(spark, sf), edges(spark, sf), "logic for the anvil", k=25).rows


# ---- fleet


@query("""WITH c AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'user' || user_id ELSE 'u' || user_id || '@x.org' END AS author, 'user' || user_id AS name, ts, value AS lines FROM events WHERE value IS NOT NULL), n AS (SELECT max(ts) AS m FROM c),
s AS (SELECT author, any_value(name) AS name, count(*) AS n_commits, sum((lines + 1) * pow(0.5, greatest((epoch_us(m) - epoch_us(ts)) / 1e6 / 86400, 0) / 180)) AS s, strftime(max(ts), '%Y-%m-%d') AS last_active FROM c, n GROUP BY 1)
SELECT author, name, n_commits, round(s, 4) AS score, round(s / (SELECT sum(s) FROM s), 6) AS share, last_active FROM s""")
def owner_table(spark, sf):
    e = read(spark, sf, "events").where("value is not null")
    mail = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.org")))
    return fleet.owner_table(e.select(mail.alias("email"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), "ts", F.col("value").alias("lines")))


_GROUPS = "SELECT o_custkey AS repo, o_orderkey AS manifest, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS package, CASE o_orderstatus WHEN 'F' THEN 'runtime' ELSE 'dev' END AS grp, o_totalprice > 1000 AS readable FROM orders"


@query(f"""SELECT repo, CASE WHEN NOT bool_or(readable) THEN 'unreadable' WHEN count(package) = 0 THEN 'nothing' WHEN count(*) FILTER (WHERE package IS NOT NULL AND grp = 'runtime') = 0 THEN 'dev-only' ELSE 'committed' END AS "class" FROM ({_GROUPS}) GROUP BY 1""")
def commitment_classes(spark, sf):
    o = read(spark, sf, "orders")
    return fleet.commitment_classes(o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("manifest"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("package"), F.when(F.col("o_orderstatus") == "F", "runtime").otherwise("dev").alias("group"), (F.col("o_totalprice") > 1000).alias("readable")))


@query("""WITH d AS (SELECT o_custkey AS repo, o_orderpriority AS package, o_orderstatus AS s FROM orders), own AS (SELECT DISTINCT repo, package FROM d WHERE s = 'P')
SELECT repo, package, 'own' AS side FROM own UNION ALL SELECT repo, package, CASE WHEN bool_or(s = 'F') THEN 'runtime' ELSE 'dev' END FROM d WHERE s <> 'P' AND (repo, package) NOT IN (FROM own) GROUP BY 1, 2""")
def dependency_split(spark, sf):
    o = read(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("package"), F.when(F.col("o_orderstatus") == "P", "publishes").otherwise("depends_on").alias("relation"), F.when(F.col("o_orderstatus") == "F", "runtime").otherwise("dev").alias("group"))
    return fleet.dependency_split(rows)


@query("""WITH r AS (SELECT c_custkey, datediff('day', max(o_orderdate)::DATE, DATE '1999-01-01') AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CASE WHEN d IS NULL THEN 'never' WHEN d <= 30 THEN '<=30' WHEN d <= 90 THEN '<=90' WHEN d <= 180 THEN '<=180' WHEN d <= 365 THEN '<=365' ELSE '>365' END AS bucket, count(*) AS n FROM r GROUP BY 1""")
def age_buckets(spark, sf):
    last = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderdate").alias("last"))
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("repo")).join(last, "repo", "left")
    return fleet.age_buckets(rows, F.lit("1999-01-01").cast("date"))


@query("""SELECT c_custkey AS repo, CASE WHEN row_number() OVER (ORDER BY c_custkey) > 100 THEN 'unchecked' WHEN c_acctbal < 0 THEN 'new' WHEN c_nationkey % 5 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM customer""")
def freshness_within(spark, sf):
    c = read(spark, sf, "customer")
    head = F.col("c_nationkey").cast("string")
    indexed = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_nationkey") % 5 == 0, "old").otherwise(head).alias("indexed_head"), F.lit("10").alias("indexed_parser"))
    return fleet.freshness_within(c.select(F.col("c_custkey").alias("repo"), head.alias("head"), F.lit("10").alias("parser")), indexed, 100)


@query("""WITH b AS (SELECT user_id AS repo, event_type AS branch, count(*) AS commits FROM events GROUP BY 1, 2)
SELECT repo, branch, commits::DOUBLE AS score FROM b QUALIFY row_number() OVER (PARTITION BY repo ORDER BY (branch = 'error' AND repo % 2 = 0) DESC, commits DESC, branch) = 1""")
def pinned_branch(spark, sf):
    e = read(spark, sf, "events")
    rows = e.groupBy(F.col("user_id").alias("repo"), F.col("event_type").alias("branch")).agg(F.count(F.lit(1)).cast("double").alias("commits"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).cast("double").alias("ts"))
    pins = e.where("user_id % 2 = 0").select(F.col("user_id").alias("repo"), F.lit("error").alias("branch")).distinct()
    return fleet.active_branch(rows, "commits", pins)


@query("""WITH u AS (SELECT p_name AS name, p_brand AS file FROM part WHERE p_size > 5), v AS (SELECT name, count(*) AS n_sites, count(DISTINCT file) AS n_files FROM u GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT file) >= 2)
SELECT name, n_sites, n_files, '= 1' AS declaration, round(n_sites / (SELECT count(*) FROM u), 6) AS coverage FROM v WHERE name NOT LIKE 'red %'""")
def load_bearing_declared(spark, sf):
    p = read(spark, sf, "part")
    uses = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.when(F.col("p_size") > 5, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))
    return fleet.load_bearing_declared(uses, p.where("p_name not like 'red %'").select(F.col("p_name").alias("name"), F.lit("= 1").alias("declaration")))


@graph_query("""SELECT '# Fleet' || chr(10) || '## Groups' || chr(10) || (SELECT string_agg('- `' || grp || '`: ' || r || ' repositories, ' || n || ' nodes', chr(10) ORDER BY grp) FROM (SELECT CASE WHEN len(string_split(repo_id, '/')) > 1 THEN string_split(repo_id, '/')[1] ELSE '(ungrouped)' END AS grp, count(DISTINCT repo_id) AS r, count(*) AS n FROM nodes WHERE NOT regexp_matches(repo_id, '^[(@]') GROUP BY 1))
 || chr(10) || '## Shared packages (' || (SELECT count(*) FROM c) || ')' || chr(10) || (SELECT string_agg('- `' || package || '`: ' || r || ', versions disagree', chr(10) ORDER BY r DESC, package) FROM (SELECT * FROM c ORDER BY r DESC, package LIMIT 50)) AS markdown""".replace("SELECT '# Fleet'", """, c AS (SELECT p_brand AS package, count(DISTINCT p_type) AS r FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)
SELECT '# Fleet'""", 1))
def fleet_page(spark, sf):
    p = read(spark, sf, "part")
    return views.fleet_page(graph.fleet_overview(nodes(spark, sf)), fleet.commitments(p.select(F.col("p_brand").alias("package"), F.col("p_type").alias("repo"), F.lit("m").alias("manifest"), F.monotonically_increasing_id().cast("string").alias("constraint"))))


# ---- scalars


@query("""SELECT p_partkey, p_brand || '.' || split_part(p_name, ' ', 1) AS chain, CASE WHEN p_size > 25 THEN p_brand || '.' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) END AS scoped FROM part""")
def scope_names(spark, sf):
    name = F.split("p_name", " ")[0]
    p = read(spark, sf, "part").withColumn("name", name).withColumn("q", F.concat(F.lit("src/a.py::"), F.col("p_brand"), F.lit("."), F.when(F.col("p_size") > 25, name).otherwise(F.lit("other"))))
    chain = F.concat(F.lit("src/a.py::"), F.col("p_brand"), F.lit("."), name)
    return p.select("p_partkey", scalars.scope_chain(chain, F.col("name")).alias("chain"), scalars.scoped_name(F.col("q"), F.col("name")).alias("scoped"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, round((epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 1e6 / 86400, 6) AS age, round(pow(0.5, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 1e6 / 86400 / 180), 6) AS weight FROM events""")
def date_scalars(spark, sf):
    e = read(spark, sf, "events")
    rows = e.join(F.broadcast(e.agg(F.max("ts").alias("newest"))))
    age = scalars.age_days(F.col("newest"), F.col("ts"))
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round(age, 6).alias("age"), F.round(scalars.decay(age), 6).alias("weight"))


@query(f"""SELECT '<workspace>: ' || replace(replace(p_name, 'widget', '{text.digest('widget')}'), 'small', '{text.digest('small')}') || ' smaller small.x' AS told, p_partkey FROM part""")
def redacted(spark, sf):
    said = F.concat(F.lit("/srv/ws: "), "p_name", F.lit(" smaller small.x"))
    return read(spark, sf, "part").select("p_partkey", text.redact(said, ["small", "widget"], {"/srv": "<root>", "/srv/ws": "<workspace>"}).alias("told"))


@query("""SELECT conv_id, turn, '<<<untrusted ' || substr(sha256(text), 1, 8) || '>>>' || chr(10) || text || chr(10) || '<<<end ' || substr(sha256(text), 1, 8) || '>>>' AS block FROM conversations""")
def untrusted_blocks(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.untrusted_block(F.col("text")).alias("block"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, split_part(p_name, ' ', 2) AS w FROM part), f AS (SELECT k, s, w || '/m' || k || '.py' AS file FROM p)
SELECT 'contains' AS relation, file AS src, 'C' || k AS dst FROM f UNION ALL SELECT 'contains', 'C' || k, 'C' || k || '.m' || k FROM f UNION ALL SELECT 'contains', file, 'h' || k FROM f
UNION ALL SELECT 'calls', 'C' || k || '.m' || k, 'h' || k FROM f UNION ALL SELECT 'calls', 'C' || k || '.m' || k, 'h' || (k - 1) FROM f WHERE k > 0 UNION ALL SELECT 'inherits', 'C' || k, 'C' || (k - 1) FROM f WHERE k > 0""")
def indexed_edges(spark, sf):
    """A module for each part: a class with a method that calls the module's function and the one of the module before, whose class it inherits from.  Edges by the names of their ends."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.split("p_name", " ")[1].alias("w"))
    key, last = F.col("k").cast("string"), (F.col("k") - 1).cast("string")
    content = F.lit("class C@k(C@l):\n    def m@k(self):\n        return h@k() + h@l()\n\n\ndef h@k():\n    return 1\n")
    tree = p.select(F.concat("w", F.lit("/m"), key, F.lit(".py")).alias("file"), F.lit("python").alias("lang"), F.replace(F.replace(content, F.lit("@k"), key), F.lit("@l"), last).alias("content"))
    n, e, _ = extract.index_repo(tree, "shop")
    name = lambda at: n.select(F.col("node_id").alias(at), F.col("qualified_name").alias(f"{at}_name"))
    return e.join(name("src"), "src").join(name("dst"), "dst").select("relation", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


@query("""WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 2) AS w, p_size % 3 AS m FROM part)
SELECT 'app/' || w || '/' || k || '/[id]/page.tsx' AS file, 'file' AS how, '/' || w || '/' || k || '/{}' AS route FROM p WHERE m = 0
UNION ALL SELECT 'pages/' || w || k || '/index.jsx', 'file', '/' || w || k FROM p WHERE m = 1
UNION ALL SELECT 'src/router' || k || '.ts', 'table', '/' || w || '/{}' FROM p WHERE m = 2 UNION ALL SELECT 'src/router' || k || '.ts', 'link', '/go/' || w FROM p WHERE m = 2""")
def web_routes(spark, sf):
    """Pages by their folders, by a router's table and by links."""
    p = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), F.split("p_name", " ")[1].alias("w"), (F.col("p_size") % 3).alias("m"))
    file = F.when(F.col("m") == 0, F.concat(F.lit("app/"), "w", F.lit("/"), "k", F.lit("/[id]/page.tsx"))).when(F.col("m") == 1, F.concat(F.lit("pages/"), "w", "k", F.lit("/index.jsx"))).otherwise(F.concat(F.lit("src/router"), "k", F.lit(".ts")))
    table = F.concat(F.lit("const routes = [{ path: '/"), "w", F.lit("/:id', component: P }];\nreturn <Link to=\"/go/"), "w", F.lit("\">x</Link>;\n"))
    tree = p.select(file.alias("file"), F.when(F.col("m") == 1, "javascript").otherwise("typescript").alias("lang"), F.when(F.col("m") == 2, table).otherwise("export default function P() {}\n").alias("content"))
    return extract.flows(tree).where("flow = 'web'").select("file", F.col("relation").alias("how"), F.col("name").alias("route"))


# ---- projects, configuration and scripts


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, split_part(p_name, ' ', 2) AS w, p_type AS t FROM part)
SELECT 'leaf/' || k || '/pom.xml' AS file, 'g:leaf' || k AS project, 'g:' || w AS package, CASE t WHEN 'ECONOMY' THEN s || '.own' ELSE s || '.0' END AS "constraint", 'runtime' AS "group" FROM p
UNION ALL SELECT 'leaf/' || k || '/pom.xml', 'g:leaf' || k, 'g:unknown', NULL, 'dev' FROM p""")
def maven_inherited(spark, sf):
    """A project for each part: its version is managed by its grandparent, in terms of a property that the parent of its size sets; those of one type have their own."""
    p = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"), F.split("p_name", " ")[1].alias("w"), F.col("p_type").alias("t"))
    up = lambda name: F.concat(F.lit("<parent><groupId>g</groupId><artifactId>"), name, F.lit("</artifactId><version>1</version></parent>"))
    dep = lambda name, rest: F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>"), name, F.lit("</artifactId>"), rest, F.lit("</dependency>"))
    pom = lambda file, *parts: (file.alias("file"), F.concat(F.lit("<project>\n"), *parts, F.lit("</project>")).alias("content"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    own = F.when(F.col("t") == "ECONOMY", tag("version", F.lit("${size}.own"))).otherwise("")
    leaf = p.select(*pom(F.concat(F.lit("leaf/"), "k", F.lit("/pom.xml")), up(F.concat(F.lit("size"), "s")), tag("artifactId", F.concat(F.lit("leaf"), "k")), tag("dependencies", F.concat(dep(F.col("w"), own), dep(F.lit("unknown"), F.lit("<scope>test</scope>"))))))
    mid = p.select("s").distinct().select(*pom(F.concat(F.lit("mid/"), "s", F.lit("/pom.xml")), up(F.lit("top")), tag("artifactId", F.concat(F.lit("size"), "s")), tag("version", F.lit("1")), tag("properties", tag("size", F.col("s")))))
    managed = F.array_join(F.array_sort(F.collect_set(dep(F.col("w"), F.lit("<version>${size}.0</version>")))), "")
    top = p.agg(managed.alias("m")).select(*pom(F.lit("top/pom.xml"), F.lit("<groupId>g</groupId><artifactId>top</artifactId><version>1</version><properties><size>none</size></properties>"), tag("dependencyManagement", tag("dependencies", F.col("m")))))
    return xmlread.maven_dependencies(leaf.unionByName(mid).unionByName(top)).select("file", "project", "package", "constraint", "group")


@query("""SELECT c_custkey || '.config' AS file, x.name, x.value, x.hidden, x.line FROM customer, LATERAL (VALUES ('Segment', c_mktsegment, FALSE, 2), ('Owner', NULL, TRUE, 3), ('DbPassword', NULL, TRUE, 4), ('Nation', c_nationkey::VARCHAR, FALSE, 5)) AS x(name, value, hidden, line)""")
def config_keys(spark, sf):
    """A configuration for each customer: one value is plain, one is a leaf's text, one is a secret by its name and one by what it holds."""
    c = read(spark, sf, "customer")
    content = F.concat(F.lit('<configuration>\n<add key="Segment" value="'), "c_mktsegment", F.lit('"/>\n<add key="Owner" value="'), F.concat(F.lit("user=x;pwd="), "c_name"), F.lit('"/>\n<add key="DbPassword" value="'), "c_name", F.lit('"/>\n<Nation>'), F.col("c_nationkey").cast("string"), F.lit("</Nation>\n</configuration>"))
    return xmlread.config(c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".config")).alias("file"), F.lit("xml").alias("lang"), content.alias("content")))


@query("""SELECT 'docs/adr/' || n_nationkey || '.md' AS file, 'Use ' || n_name AS name, CASE n_regionkey % 2 WHEN 0 THEN 'accepted' ELSE 'superseded' END AS status, 3 AS line FROM nation""")
def decision_records(spark, sf):
    n = read(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    status = F.when(F.col("n_regionkey") % 2 == 0, "Accepted").otherwise("Superseded")
    record = n.select(F.concat(F.lit("docs/adr/"), "k", F.lit(".md")).alias("file"), F.concat(F.lit("---\n---\n# "), "k", F.lit(". Use "), "n_name", F.lit("\n\n## Status\n\n"), status, F.lit("\n")).alias("content"))
    other = n.select(F.concat(F.lit("docs/"), "k", F.lit(".md")).alias("file"), F.lit("# Notes\n\nStatus: Accepted\n").alias("content"))
    return extract.decisions(record.unionByName(other).withColumn("lang", F.lit("markdown"))).select("file", "name", "status", "line")


_SCRIPTS = """WITH p AS (SELECT p_partkey AS k, p_size AS s, split_part(p_name, ' ', 2) AS w, CASE p_type WHEN 'ECONOMY' THEN 'rb' WHEN 'SMALL' THEN 'lua' WHEN 'MEDIUM' THEN 'pkb' WHEN 'PROMO' THEN 'php' WHEN 'STANDARD' THEN 'sh' ELSE 'swift' END AS e FROM part), t AS (SELECT k || '.' || e AS file, * FROM p)
"""


@query(_SCRIPTS + """SELECT file, 'class' AS kind, 'C' || k AS name FROM t WHERE e IN ('rb', 'php', 'swift') UNION ALL SELECT file, 'namespace', 'c' || k FROM t WHERE e = 'pkb' UNION ALL
SELECT file, CASE WHEN e IN ('rb', 'php', 'swift') THEN 'method' ELSE 'function' END, CASE e WHEN 'lua' THEN w || k WHEN 'sh' THEN w || k WHEN 'pkb' THEN 'c' || k || '.' || w ELSE 'C' || k || '.' || w END FROM t""")
def script_definitions(spark, sf):
    """Scripts in six languages, with scopes within the bodies that must end before the next definition."""
    return extract.definitions(_scripts(spark, sf)).where("kind <> 'file'").select("file", "kind", F.col("qualified_name").alias("name"))


@query(_SCRIPTS + """SELECT file, CASE e WHEN 'lua' THEN w || k WHEN 'sh' THEN w || k WHEN 'pkb' THEN 'c' || k || '.' || w ELSE 'C' || k || '.' || w END AS src, 'go' || s AS name FROM t""")
def script_calls(spark, sf):
    return extract.references(_scripts(spark, sf)).where("stream = 'calls' and name like 'go%'").select("file", "src", "name")


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    texts = {
        "ECONOMY": ("rb", "ruby", "class C@k < Base\n  def @w(a)\n    return 0 unless a\n    [1].each do |x|\n      if x then go@s(x) end\n    end\n  end\nend\n"),
        "SMALL": ("lua", "lua", "-- function no() end\nlocal function @w@k(a)\n  for i = 1, 3 do if a then go@s(i) end end\nend\n"),
        "MEDIUM": ("pkb", "plsql", "create package body C@k is\n  procedure @w(a number) is\n  begin\n    if a > 1 then GO@s(a); end if;\n  end;\nend;\n"),
        "PROMO": ("php", "php", "<?php\nclass C@k extends Base {\n  function @w($a) { if ($a) { return go@s('}'); } }\n}\n"),
        "STANDARD": ("sh", "shell", "@w@k() {\n  if true; then go@s x; fi\n}\n"),
    }
    key, size, word = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.split("p_name", " ")[1]
    suffix, lang, content = F.lit("swift"), F.lit("swift"), F.lit("class C@k: Base {\n  func @w() { if x { go@s(1) } }\n}\n")
    for kind, (s, name, text_) in texts.items():
        suffix, lang, content = (F.when(F.col("p_type") == kind, new).otherwise(old) for new, old in ((s, suffix), (name, lang), (text_, content)))
    for sign, value in (("@w", word), ("@k", key), ("@s", size)):
        content = F.replace(content, F.lit(sign), value)
    return p.select(F.concat(key, F.lit("."), suffix).alias("file"), lang.alias("lang"), content.alias("content"))


# ---- source trees


def source_tree(spark: SparkSession, sf: str) -> DataFrame:
    """(file, lang, content): a file for each part, in the language its type stands for."""
    p = read(spark, sf, "part")
    word, key = F.split("p_name", " ")[1], F.col("p_partkey").cast("string")
    def of(template: str):
        """@w is the second word of the name, @k the key and @s the size."""
        out = F.lit(template)
        for sign, value in (("@w", word), ("@k", key), ("@s", F.col("p_size").cast("string"))):
            out = F.replace(out, F.lit(sign), value)
        return out

    python = of('import requests\n\n\nclass C@k(Base):\n    def @w(self):\n        if self.order.status == "open":\n            self.order.status = "paid"\n        requests.get("https://api.example.org/v1/@w/@s?x=1")\n        return helper@s()\n')
    js = of('app.get("/v1/@w/:id", handler);\nconsumer.subscribe("Topic-@s");\nkafkaProducer.send("shop/@w");\nfunction f@k(a) { return helper@s(a); }\n')
    sql = of("CREATE TABLE t@k (id int REFERENCES base(id)); -- references nothing\nINSERT INTO log@s SELECT * FROM t@k;\n")
    hcl = of('resource "aws_instance" "i@k" {\n  subnet_id = aws_subnet.@w.id\n  name = "${var.env}-aws_fake.no"\n}\n')
    c = of("#define LIMIT_@s 3\nstatic int g@k(int x) {\n  return helper@s(x) + LIMIT_@s; // helper99(0)\n}\n")
    css = of(".c@k > #@w { color: red }\n")
    kind = F.col("p_type")
    rows = [("ECONOMY", python, "py", "python"), ("SMALL", js, "js", "javascript"), ("MEDIUM", sql, "sql", "sql"), ("PROMO", hcl, "tf", "hcl"), ("STANDARD", c, "c", "c"), ("LARGE", css, "css", "css")]
    pick = lambda i: F.coalesce(*[F.when(kind == r[0], r[i] if i == 1 else F.lit(r[i])) for r in rows])
    return p.select(F.concat(F.lit("src/"), word, F.lit("/"), key, F.lit("."), pick(2)).alias("file"), pick(3).alias("lang"), pick(1).alias("content"))


_TREE = """WITH t AS (SELECT 'src/' || split_part(p_name, ' ', 2) || '/' || p_partkey || '.' || CASE p_type WHEN 'ECONOMY' THEN 'py' WHEN 'SMALL' THEN 'js' WHEN 'MEDIUM' THEN 'sql' WHEN 'PROMO' THEN 'tf' WHEN 'STANDARD' THEN 'c' ELSE 'css' END AS file, p_type AS t, p_partkey AS k, split_part(p_name, ' ', 2) AS w, p_size AS s FROM part)
"""


@query(_TREE + """SELECT file, 'file' AS kind, file AS name, 1 AS line FROM t UNION ALL SELECT file, 'class', 'C' || k, 4 FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'method', w, 5 FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'function', 'f' || k, 4 FROM t WHERE t = 'SMALL'
UNION ALL SELECT file, 'table', 't' || k, 1 FROM t WHERE t = 'MEDIUM' UNION ALL SELECT file, 'resource', 'aws_instance.i' || k, 1 FROM t WHERE t = 'PROMO' UNION ALL SELECT file, 'macro', 'LIMIT_' || s, 1 FROM t WHERE t = 'STANDARD' UNION ALL SELECT file, 'function', 'g' || k, 2 FROM t WHERE t = 'STANDARD'
UNION ALL SELECT file, 'style_class', 'c' || k, 1 FROM t WHERE t = 'LARGE' UNION ALL SELECT file, 'style_id', w, 1 FROM t WHERE t = 'LARGE'""")
def code_definitions(spark, sf):
    return extract.definitions(source_tree(spark, sf)).select("file", "kind", "name", "line")


@query(_TREE + """SELECT file, 'imports' AS stream, 'requests' AS name, 1 AS line FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'inherits', 'Base', 4 FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'calls', 'get', 8 FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'calls', 'helper' || s, 9 FROM t WHERE t = 'ECONOMY'
UNION ALL SELECT file, 'calls', 'get', 1 FROM t WHERE t = 'SMALL' UNION ALL SELECT file, 'calls', 'subscribe', 2 FROM t WHERE t = 'SMALL' UNION ALL SELECT file, 'calls', 'send', 3 FROM t WHERE t = 'SMALL' UNION ALL SELECT file, 'calls', 'helper' || s, 4 FROM t WHERE t = 'SMALL'
UNION ALL SELECT file, 'references', 'base', 1 FROM t WHERE t = 'MEDIUM' UNION ALL SELECT file, 'writes', 'log' || s, 2 FROM t WHERE t = 'MEDIUM' UNION ALL SELECT file, 'reads', 't' || k, 2 FROM t WHERE t = 'MEDIUM'
UNION ALL SELECT file, 'depends_on', 'aws_subnet.' || w, 2 FROM t WHERE t = 'PROMO' UNION ALL SELECT file, 'depends_on', 'var.env', 3 FROM t WHERE t = 'PROMO' UNION ALL SELECT file, 'calls', 'helper' || s, 3 FROM t WHERE t = 'STANDARD' UNION ALL SELECT file, 'uses', 'LIMIT_' || s, 3 FROM t WHERE t = 'STANDARD'""")
def code_references(spark, sf):
    return extract.references(source_tree(spark, sf)).select("file", "stream", "name", "line")


@query(_TREE + """SELECT file, 'http' AS flow, 'calls_http' AS relation, '/v1/' || w || '/{}' AS name, 'api.example.org' AS extra FROM t WHERE t = 'ECONOMY' UNION ALL SELECT file, 'state', 'C' || k, 'open->paid', w FROM t WHERE t = 'ECONOMY'
UNION ALL SELECT file, 'http', 'exposes', '/v1/' || w || '/{}', NULL FROM t WHERE t = 'SMALL' UNION ALL SELECT file, 'event', 'consumes_event', 'topic-' || s, NULL FROM t WHERE t = 'SMALL' UNION ALL SELECT file, 'event', 'publishes_event', w, NULL FROM t WHERE t = 'SMALL' AND length(w) >= 3""")
def code_flows(spark, sf):
    return extract.flows(source_tree(spark, sf)).select("file", "flow", "relation", "name", "extra")


@query(_TREE + """SELECT 'contains' AS relation, count(*) AS n FROM (SELECT 1 FROM t WHERE t IN ('ECONOMY', 'STANDARD', 'LARGE') UNION ALL SELECT 1 FROM t)""")
def index_repo(spark, sf):
    _, e, _ = extract.index_repo(source_tree(spark, sf), "r")
    return e.where("relation = 'contains'").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.min.js' WHEN 'de' THEN '.py' ELSE '.Designer.cs' END AS file, source, lang FROM documents)
SELECT file, CASE lang WHEN 'en' THEN 'document' ELSE 'code' END AS reads FROM d WHERE source <> 'src1' AND lang IN ('en', 'de')""")
def kept_files(spark, sf):
    d = read(spark, sf, "documents")
    end = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".min.js").when(F.col("lang") == "de", ".py").otherwise(".Designer.cs")
    tree = d.select(F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), end).alias("file"), F.col("text").alias("content"))
    return files.kept_files(tree, ["src1/"]).select("file", files.dispatch(F.col("file")).alias("reads"))


@query("""WITH m AS (SELECT p_brand || '/requirements.txt' AS file, replace(p_name, ' ', '-') AS package, max(p_size) AS s FROM part GROUP BY 1, 2)
SELECT file, 'depends_on' AS relation, package, '>=' || s AS "constraint", 'runtime' AS "group" FROM m UNION ALL SELECT DISTINCT p_brand || '/package.json', 'publishes', p_brand, NULL, NULL FROM part UNION ALL SELECT DISTINCT p_brand || '/package.json', 'depends_on', 'left-pad', '^1', 'dev' FROM part""")
def manifest_edges(spark, sf):
    p = read(spark, sf, "part")
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(">="), F.col("s").cast("string"))
    pins = p.groupBy("p_brand", "p_name").agg(F.max("p_size").alias("s")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    own = F.concat(F.lit('{"name": "'), F.col("p_brand"), F.lit('", "devDependencies": {"left-pad": "^1"}}'))
    tree = pins.select(F.concat(F.col("p_brand"), F.lit("/requirements.txt")).alias("file"), "content").union(p.select("p_brand").distinct().select(F.concat(F.col("p_brand"), F.lit("/package.json")), own))
    return files.manifest_edges(tree).select("file", "relation", "package", "constraint", "group")


@query()
def page_text(spark, sf):
    return web.page_texts(read(spark, sf, "pages"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, i AS n FROM events, (SELECT unnest(['a', 'b']) AS i)""")
def json_records(spark, sf):
    e = read(spark, sf, "events")
    item = lambda name: F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(f', "n": "{name}", "at": '), F.col("props"), F.lit("}"))
    raw = e.select(F.concat(F.lit('{"data": {"items": ['), item("a"), F.lit(", "), item("b"), F.lit("]}}")).alias("j"))
    return web.json_records(raw, "j", "data.items", {"event_id": "id", "n": "n", "k": "at.k"}).withColumn("event_id", F.col("event_id").cast("long"))


# ---- shards, snapshots and streams


@graph_query(""", r AS (SELECT DISTINCT repo_id FROM nodes WHERE repo_id LIKE 'ASIA%' AND kind = 'class')
SELECT node_id, kind, repo_id FROM nodes WHERE repo_id NOT IN (SELECT repo_id FROM r) UNION ALL SELECT node_id, 'renewed', repo_id FROM nodes WHERE kind = 'class' AND repo_id IN (SELECT repo_id FROM r)""")
def shard_replace(spark, sf):
    """All shards, of which those of one region are replaced by their classes alone."""
    path = _folder(spark, "shards")
    n = nodes(spark, sf).select("node_id", "kind", "repo_id")
    shards.write_shard(n, path)
    shards.write_shard(n.where("repo_id like 'ASIA%' and kind = 'class'").withColumn("kind", F.lit("renewed")), path)
    return shards.read_shard(spark, path).select("node_id", "kind", "repo_id")


@graph_query("SELECT node_id, repo_id, CASE WHEN length(repo_id) % 2 = 0 THEN name ELSE 'old_' || name END AS name FROM nodes WHERE repo_id <> '(packages)'")
def fleet_as_of(spark, sf):
    """Two snapshots of every repository; the second one comes before the asked time in some of them, and packages come after it."""
    path = _folder(spark, "history")
    n = nodes(spark, sf).select("node_id", "name", "repo_id")
    shards.archive(n.withColumn("name", F.concat(F.lit("old_"), "name")), path, "c1")
    shards.archive(n, path, "c2")
    repos = n.select("repo_id").distinct()
    early = F.when(F.col("repo_id") == "(packages)", "2024-05-01").otherwise("2024-01-01")
    late = F.when((F.length("repo_id") % 2 == 0) & (F.col("repo_id") != "(packages)"), "2024-02-01").otherwise("2024-06-01")
    history = repos.select("repo_id", F.lit("c1").alias("commit"), early.alias("t")).unionByName(repos.select("repo_id", F.lit("c2").alias("commit"), late.alias("t"))).withColumn("indexed_at", F.to_timestamp("t"))
    return shards.snapshots_at(spark, path, history, "2024-03-01 00:00:00").select("node_id", "repo_id", "name")


@graph_query("SELECT node_id, 'old_' || name AS name FROM nodes WHERE kind = 'class' AND repo_id = 'AFRICA/NATION_0'")
def snapshot_as_of(spark, sf):
    path = _folder(spark, "history")
    n = nodes(spark, sf).where("kind = 'class' and repo_id = 'AFRICA/NATION_0'").select("node_id", "name", "repo_id")
    shards.archive(n.withColumn("name", F.concat(F.lit("old_"), "name")), path, "c1")
    shards.archive(n, path, "c2")
    history = spark.createDataFrame([("AFRICA/NATION_0", "c1", "2024-01-01 00:00:00"), ("AFRICA/NATION_0", "c2", "2024-03-01 00:00:00")], "repo_id string, commit string, at string").withColumn("indexed_at", F.to_timestamp("at"))
    return shards.read_as_of(spark, path, history, "AFRICA/NATION_0", "2024-02-01 00:00:00").select("node_id", "name")


@graph_query("SELECT node_id, repo_id FROM nodes WHERE kind = 'class' AND repo_id <> 'AFRICA/NATION_0' AND repo_id <> 'ASIA/NATION_2' UNION ALL SELECT node_id, 'moved/here' FROM nodes WHERE kind = 'class' AND repo_id = 'ASIA/NATION_2' UNION ALL SELECT node_id, '@connect:moved/here' FROM nodes WHERE kind = 'class' AND repo_id = 'ASIA/NATION_2'")
def forget_and_migrate(spark, sf):
    path = _folder(spark, "shards")
    n = nodes(spark, sf).where("kind = 'class'").select("node_id", "repo_id")
    other = n.where("repo_id in ('AFRICA/NATION_0', 'ASIA/NATION_2')").withColumn("repo_id", F.concat(F.lit("@connect:"), "repo_id"))
    shards.write_shard(n.unionByName(other), path)
    shards.forget(spark, [path], "AFRICA/NATION_0")
    shards.migrate(spark, path, "ASIA/NATION_2", "moved/here")
    return shards.read_table(spark, path).select("node_id", "repo_id")


@graph_query("SELECT node_id, CASE WHEN kind = 'class' THEN 'renewed' ELSE kind END AS kind FROM nodes")
def upsert_nodes(spark, sf):
    n = nodes(spark, sf).select("node_id", "kind")
    return shards.upsert(n, n.where("kind = 'class'").withColumn("kind", F.lit("renewed")))


@query("SELECT c_custkey::VARCHAR AS repo_id, c_mktsegment AS head FROM customer WHERE c_acctbal < 0 OR c_nationkey % 5 = 0")
def needs_reindex(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"), F.col("c_mktsegment").alias("head"), F.lit("11").alias("parser"), "c_acctbal", "c_nationkey")
    indexed = c.where("c_acctbal >= 0").select("repo_id", F.when(F.col("c_nationkey") % 5 == 0, "old").otherwise(F.col("head")).alias("head"), "parser")
    return incremental.needs_reindex(c.select("repo_id", "head", "parser"), indexed).select("repo_id", "head")


@query("SELECT user_id::VARCHAR AS repo_id, CASE user_id % 2 WHEN 0 THEN 'h1' ELSE 'h2' END AS head, event_type, event_id FROM events WHERE user_id IS NOT NULL")
def stream_index(spark, sf):
    """Two files of a stream: the second renews the odd repositories and brings the rest of the even ones' shards."""
    place = _folder(spark, "stream")
    e = read(spark, sf, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("repo_id"), "event_type", F.lit("11").alias("parser"), "event_id", "user_id")
    even, half = F.col("user_id") % 2 == 0, F.col("event_id") % 2 == 0
    first = e.where(half).withColumn("head", F.lit("h1")).withColumn("seq", F.lit(1))
    second = e.where(even & ~half).withColumn("head", F.lit("h1")).withColumn("seq", F.lit(1)).unionByName(e.where(~even).withColumn("head", F.lit("h2")).withColumn("seq", F.lit(2)))
    schema = "repo_id string, head string, parser string, seq long, event_id long, event_type string"
    for part in (first, second):
        part.select("repo_id", "head", "parser", F.col("seq").cast("long").alias("seq"), "event_id", "event_type").coalesce(1).write.mode("append").parquet(f"{place}/in")
        incremental.index_stream(spark, f"{place}/in", schema, f"{place}/out", f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return shards.read_table(spark, f"{place}/out").select("repo_id", "head", "event_type", "event_id")


@query("SELECT event_type AS service, event_id // 1000 AS page, event_id::VARCHAR AS id, user_id::VARCHAR AS user FROM events")
def stream_pages(spark, sf):
    """Event types as services, a page for each thousand ids: the first half of the pages, then, from the checkpoint, the rest."""
    place = _folder(spark, "pages")
    sinks.register_sources(spark)
    e = read(spark, sf, "events").select(F.col("event_type").alias("service"), F.expr("event_id div 1000").alias("n"), F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("r"))
    ids = e.select("service", "n").distinct().withColumn("page", F.row_number().over(Window.partitionBy("service").orderBy("n")) - 1)
    pages = work_table(e.join(ids, ["service", "n"]), "page-rows")
    last = pages.agg(F.max("page")).first()[0]
    for part in (F.col("page") <= last / 2, F.col("page") > last / 2):
        pages.where(part).select("service", "page", "n", "r.*").repartition("service", "page").write.mode("append").partitionBy("service", "page").json(f"{place}/in")
        rows = spark.readStream.format("weft_pages").option("path", f"{place}/in").option("fields", "n=n;id=id;user=user.id").option("pages", "3").load()
        rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination(600)
    return spark.read.parquet(f"{place}/out").select("service", F.col("n").cast("long").alias("page"), "id", "user")


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*)::DOUBLE AS line FROM events GROUP BY event_type""")
def prometheus_lines(spark, sf):
    m = read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value", F.lit("events by type").alias("help"))
    return sinks.prometheus_text(m).select(F.explode(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#"))).alias("line"))
