"""Bounded views of a graph, and the diagrams and documents drawn from them.

A view is chosen by DataFrame operators; only its rows, bounded by its caps, are written as text.  Every renderer counts its payload first
and refuses one beyond ``MOST_LINES``, whatever its caller chose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import tasks_for, work_table
from . import graph

#: Rows that a text form may have.
MOST_LINES = 20_000
#: Kinds drawn in class and entity diagrams.
CLASSIFIERS, MEMBERS, ENTITIES = ["class", "interface", "struct", "enum"], ["method", "function"], ["table", "view"]
#: What a resource's type says about where it runs, in the order in which it is asked.
RESOURCES = [("compute", r"instance|lambda|function|ecs|eks|container|vm|cluster"), ("storage", r"bucket|s3|storage|disk|volume"), ("database", r"db|rds|sql|dynamo|redis|cache"), ("network", r"vpc|subnet|route|lb|gateway|dns|security_group"), ("identity", r"iam|role|policy|user")]


def checked(lines: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """``lines`` if they are few enough to be one text; else an error that says how many there are at least."""
    if lines.limit(most + 1).count() > most:
        raise ValueError(f"a view of more than {most} lines is not drawn; narrow it first")
    return lines


def joined(lines: DataFrame, head: str, tail: str, name: str, empty: str | None = None) -> DataFrame:
    """(name): the lines (part, key, line) of a bounded view in order; ``empty`` stands for none."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "line"))), lambda x: x["line"]), "\n")
    told = F.concat(F.lit(head), body, F.lit(tail))
    return checked(lines).agg((F.when(F.count(F.lit(1)) == 0, F.lit(empty)).otherwise(told) if empty is not None else told).alias(name))


def repo_subgraph(nodes: DataFrame, edges: DataFrame, repo: str, most: int = 500, most_edges: int | None = None, fanout: int | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A repository's own nodes by degree, with a floor for each kind, then nodes of others one step out; and the edges among them, (node_id, kind, degree, own) and (src, dst, relation).

    Half of ``most`` is shared out as floors over the kinds.  Nodes one step out, by the number of edges that lead to them, get what the repository's own leave, a fifth of ``most`` at least. At most ``fanout`` edges
    are followed from a node, in order.  Both selections are top-k operators; the driver holds one count for each kind.
    """
    own = nodes.where(F.col("repo_id") == repo)
    own = own.where(graph.in_path(F.col("file"), prefix)) if prefix else own
    mine = lambda at: own.select(F.col("node_id").alias(at))
    rows = edges.select("src", "dst", "relation")
    # Only edges at the repository's nodes count for their degrees; they are made distinct when the others are gone.
    led = rows.join(mine("src"), "src", "left_semi").withColumn("_led", F.lit(True))
    at_own = led.unionByName(rows.join(mine("dst"), "dst", "left_semi").join(mine("src"), "src", "left_anti").withColumn("_led", F.lit(False)))
    at_own = work_table(at_own, "own-edges", tasks=tasks_for(edges.sparkSession, edges.count()))
    out = at_own.where("_led").select("src", "dst", "relation").distinct()
    if fanout is not None:
        out = out.withColumn("_f", F.row_number().over(Window.partitionBy("src").orderBy("relation", "dst"))).where(F.col("_f") <= fanout).drop("_f")
    degree = graph.distinct_degree(at_own.drop("_led")).select("node_id", "degree")
    ranked = own.select("node_id", "kind").join(degree, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    away = nodes.where(F.col("repo_id") != repo).select(F.col("node_id").alias("dst"), "kind")
    steps = out.join(away, "dst").groupBy(F.col("dst").alias("node_id"), "kind").agg(F.count(F.lit(1)).alias("degree"))
    n_own, n_away = ranked.limit(most).count(), steps.limit(most).count()
    room = min(n_away, max(most - n_own, most // 5))
    floors = graph.floors_of(ranked, most // 2)
    inside = graph.evict_tail(ranked, floors, most - room).withColumn("own", F.lit(True))
    outside = steps.orderBy(F.desc("degree"), "node_id").limit(room).select("node_id", "kind", "degree").withColumn("own", F.lit(False))
    kept = inside.unionByName(outside)
    ends = lambda at: F.broadcast(kept.select(F.col("node_id").alias(at)))  # noqa: E731  at most ``most`` rows
    induced = out.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "relation")
    return kept, induced.orderBy("relation", "src", "dst").limit(most_edges) if most_edges is not None else induced


def safe(x: Column) -> Column:
    """A label without the signs that end one."""
    return F.regexp_replace(x, r'["\[\]{}|<>]', " ")


def class_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A Mermaid class diagram: classifiers with the members they contain, and inheritance, dotted where the base is an interface."""
    c = nodes.where(F.col("kind").isin(CLASSIFIERS)).select("node_id", "name", "kind")
    m = nodes.where(F.col("kind").isin(MEMBERS)).select(F.col("node_id").alias("dst"), F.col("name").alias("member"))
    contains = edges.where("relation = 'contains'").select(F.col("src").alias("node_id"), "dst").distinct().join(m, "dst")
    members = contains.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: F.concat(F.lit("    +"), safe(x), F.lit("()\n"))), "").alias("body"))
    mark = F.when(F.col("kind") == "interface", "    <<interface>>\n").otherwise("")
    body = F.concat(mark, F.coalesce("body", F.lit("")))
    line = F.concat(F.lit("  class "), F.col("node_id"), F.lit('["'), safe(F.col("name")), F.lit('"]'), F.when(body == "", "").otherwise(F.concat(F.lit(" {\n"), body, F.lit("  }"))))
    classes = c.join(members, "node_id", "left").select(F.lit(0).alias("part"), F.col("node_id").alias("key"), line.alias("line"))
    ends = edges.where("relation = 'inherits'").select("src", "dst").distinct().join(c.select(F.col("node_id").alias("src")), "src", "left_semi").join(c.select(F.col("node_id").alias("dst"), "kind"), "dst")
    arrow = F.concat(F.lit("  "), F.col("dst"), F.when(F.col("kind") == "interface", " <|.. ").otherwise(" <|-- "), F.col("src"))
    return joined(classes.unionByName(ends.select(F.lit(1).alias("part"), F.concat_ws("|", "dst", "src").alias("key"), arrow.alias("line"))), "classDiagram\n", "", "mermaid", "classDiagram\n  %% no classes or interfaces in this view")


def state_diagram(transitions: DataFrame) -> DataFrame:
    """A Mermaid state diagram of (entity, source, target, method): a block for each entity."""
    one = transitions.select("entity", "source", "target", "method").distinct()
    line = F.concat(F.lit("    "), F.col("source"), F.lit(" --> "), F.col("target"), F.lit(" : "), F.col("method"))
    body = one.select("entity", F.concat_ws("|", "source", "target", "method").alias("k"), line.alias("line"))
    blocks = checked(body).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("b"))
    lines = blocks.select(F.lit(0).alias("part"), F.col("entity").alias("key"), F.concat(F.lit("  state "), F.col("entity"), F.lit(" {\n"), F.col("b"), F.lit("\n  }")).alias("line"))
    return joined(lines, "stateDiagram-v2\n", "", "mermaid", "stateDiagram-v2\n  %% no transitions in this view")


def er_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A Mermaid entity diagram: tables and views, a referring table on the many side; those that nothing touches stand alone."""
    n = nodes.where(F.col("kind").isin(ENTITIES)).select("node_id", "name").distinct()
    side = lambda at: n.select(F.col("node_id").alias(at), F.col("name").alias(f"{at}_name"))
    refs = edges.where("relation = 'references'").select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst")
    line = F.concat(F.lit("  "), F.col("dst_name"), F.lit(" ||--o{ "), F.col("src_name"), F.lit(" : references"))
    touched = refs.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    alone = n.join(touched, "node_id", "left_anti").select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit("  "), F.col("name")).alias("line"))
    return joined(refs.select(F.lit(0).alias("part"), F.concat_ws("|", "dst_name", "src_name").alias("key"), line.alias("line")).unionByName(alone), "erDiagram\n", "", "mermaid", "erDiagram\n  %% no tables or views in this view")


def resource_category(kind: Column) -> Column:
    """Where a resource runs, by the words of its type."""
    out = F.lit("other")
    for name, pattern in reversed(RESOURCES):
        out = F.when(F.lower(kind).rlike(pattern), name).otherwise(out)
    return out


def deployment_diagram(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """A Mermaid flow chart of resources (node_id, name), boxed by category, and what they depend on."""
    r = resources.select("node_id", "name", resource_category(F.substring_index("name", ".", 1)).alias("category"))
    line = F.concat(F.lit("    "), F.col("node_id"), F.lit('["'), safe(F.col("name")), F.lit('"]'))
    boxes = checked(r).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("b"))
    lines = boxes.select(F.lit(0).alias("part"), F.col("category").alias("key"), F.concat(F.lit("  subgraph "), F.col("category"), F.lit("\n"), F.col("b"), F.lit("\n  end")).alias("line"))
    ends = edges.where("relation = 'depends_on'").select("src", "dst").distinct().join(r.select(F.col("node_id").alias("src")), "src", "left_semi").join(r.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    arrows = ends.select(F.lit(1).alias("part"), F.concat_ws("|", "src", "dst").alias("key"), F.concat(F.lit("  "), F.col("src"), F.lit(" --> "), F.col("dst")).alias("line"))
    return joined(lines.unionByName(arrows), "flowchart TB\n", "", "mermaid", "flowchart TB\n  %% no resources in this view")


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, id, data): elements of an interactive view as JSON; a node's degree leaves its self-loops out."""
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.join(ends, "node_id", "left").select(F.lit("nodes").alias("grp"), F.col("node_id").alias("id"), F.to_json(F.struct(F.col("node_id").alias("id"), F.col("name").alias("label"), "kind", F.coalesce("degree", F.lit(0)).alias("degree"))).alias("data"))
    key = F.concat_ws("|", "src", "relation", "dst")
    e = edges.select("src", "dst", "relation").distinct().select(F.lit("edges").alias("grp"), key.alias("id"), F.to_json(F.struct(key.alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label"))).alias("data"))
    return n.unionByName(e)


def c4_dot(spaces: DataFrame) -> DataFrame:
    """DOT of collapsed edges (src_ns, dst_ns, weight, boundary): a box for each namespace, boundary edges dashed."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    names = spaces.select(F.explode(F.array("src_ns", "dst_ns")).alias("ns")).distinct()
    boxes = names.select(F.lit(0).alias("part"), F.col("ns").alias("key"), F.concat(F.lit("  "), quoted("ns"), F.lit(" [shape=box];")).alias("line"))
    style = F.when(F.col("boundary"), ", style=dashed").otherwise("")
    line = F.concat(F.lit("  "), quoted("src_ns"), F.lit(" -> "), quoted("dst_ns"), F.lit(' [label="'), F.col("weight").cast("string"), F.lit('"'), style, F.lit("];"))
    return joined(boxes.unionByName(spaces.select(F.lit(1).alias("part"), F.concat_ws("|", "src_ns", "dst_ns").alias("key"), line.alias("line"))), "digraph c4 {\n", "\n}", "dot")


def c4_payload(spaces: DataFrame, included: list[str] | None = None) -> DataFrame:
    """(ns, weight_in, weight_out, internal, included) of each namespace of collapsed edges; without ``included`` all are."""
    rows = spaces.select(F.explode(F.array(
        F.struct(F.col("src_ns").alias("ns"), F.lit(0).cast("long").alias("i"), F.when(F.col("boundary"), F.col("weight")).otherwise(0).alias("o"), F.when(~F.col("boundary"), F.col("weight")).otherwise(0).alias("w")),
        F.struct(F.col("dst_ns").alias("ns"), F.when(F.col("boundary"), F.col("weight")).otherwise(0).alias("i"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("w")))).alias("x")).select("x.*")
    out = rows.groupBy("ns").agg(F.sum("i").alias("weight_in"), F.sum("o").alias("weight_out"), F.sum("w").alias("internal"))
    return out.withColumn("included", F.col("ns").isin(included) if included is not None else F.lit(True))


def stamp(body: Column, head: Column) -> Column:
    """A document with the commit it tells about and the digest of its body, in a last line."""
    return F.concat(body, F.lit("\n<!-- generated from "), F.coalesce(head, F.lit("unknown")), F.lit(" "), F.substring(F.sha2(body, 256), 1, 12), F.lit(" -->"))


def read_stamp(document: Column) -> Column:
    """(head, digest, intact) of a stamped document; nulls where there is no stamp."""
    pattern = r"(?s)^(.*)\n<!-- generated from (\S+) ([0-9a-f]{12}) -->$"
    part = lambda i: F.nullif(F.regexp_extract(document, pattern, i), F.lit(""))
    return F.struct(part(2).alias("head"), part(3).alias("digest"), (F.substring(F.sha2(F.regexp_extract(document, pattern, 1), 256), 1, 12) == part(3)).alias("intact"))


def api_reference(symbols: DataFrame, title: str) -> DataFrame:
    """Markdown of chosen symbols (name, file, n_sites, rank, tied_out): a section for each file, a line for each symbol, and what the cut left out."""
    rows = checked(symbols)
    line = F.concat(F.lit("- `"), F.col("name"), F.lit("`: "), F.col("n_sites").cast("string"), F.lit(" call sites"))
    files = rows.groupBy(F.coalesce("file", F.lit("(no file)")).alias("key")).agg(F.min("rank").alias("part"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("b"))
    body = files.select("part", "key", F.concat(F.lit("## "), F.col("key"), F.lit("\n"), F.col("b")).alias("line"))
    note = rows.agg(F.max("tied_out").alias("t")).where("t > 0").select(F.lit(1 << 30).alias("part"), F.lit("").alias("key"), F.concat(F.lit("_"), F.col("t").cast("string"), F.lit(" more tie with the last and are left out._")).alias("line"))
    return joined(body.unionByName(note), f"# {title}\n", "", "markdown")


def design_page(values: DataFrame, commitments: DataFrame) -> DataFrame:
    """Markdown design notes: values that bear load (name, n_sites, n_files) and packages that repositories share (package, n_repos, disagreeing)."""
    v = values.select(F.lit(1).alias("part"), F.concat(F.lpad((10**9 - F.col("n_sites")).cast("string"), 10, "0"), F.col("name")).alias("key"), F.concat(F.lit("- `"), F.col("name"), F.lit("` at "), F.col("n_sites").cast("string"), F.lit(" places in "), F.col("n_files").cast("string"), F.lit(" files")).alias("line"))
    c = commitments.where("n_repos > 1").select(F.lit(3).alias("part"), F.col("package").alias("key"), F.concat(F.lit("- `"), F.col("package"), F.lit("`: "), F.col("n_repos").cast("string"), F.lit(" repositories"), F.when(F.col("disagreeing"), ", which disagree").otherwise("")).alias("line"))
    spark = values.sparkSession
    heads = spark.createDataFrame([(0, "", "## Load-bearing values"), (2, "", "## Shared packages")], "part int, key string, line string")
    return joined(heads.unionByName(v).unionByName(c), "# Design notes\n", "", "markdown")


def fleet_page(groups: DataFrame, commitments: DataFrame, most: int = 50) -> DataFrame:
    """Markdown of a fleet: its groups (grp, n_repos, n_nodes) and the packages that most repositories share (package, n_repos, disagreeing), how many there are in all, and how many are left out."""
    spark = groups.sparkSession
    shared = commitments.where("n_repos > 1")
    total = shared.count()
    g = groups.select(F.lit(1).alias("part"), F.col("grp").alias("key"), F.concat(F.lit("- `"), F.col("grp"), F.lit("`: "), F.col("n_repos").cast("string"), F.lit(" repositories, "), F.col("n_nodes").cast("string"), F.lit(" nodes")).alias("line"))
    best = shared.orderBy(F.desc("n_repos"), "package").limit(most)
    p = best.select(F.lit(3).alias("part"), F.concat(F.lpad((10**9 - F.col("n_repos")).cast("string"), 10, "0"), F.col("package")).alias("key"), F.concat(F.lit("- `"), F.col("package"), F.lit("`: "), F.col("n_repos").cast("string"), F.when(F.col("disagreeing"), ", versions disagree").otherwise("")).alias("line"))
    rest = [(4, "", f"_{total - most} more are left out._")] if total > most else []
    heads = spark.createDataFrame([(0, "", "## Groups"), (2, "", f"## Shared packages ({total})"), *rest], "part int, key string, line string")
    return joined(heads.unionByName(g).unionByName(p), "# Fleet\n", "", "markdown")


#: The sections of a structural page, in order.
SECTIONS = ["Size", "Kinds", "Hubs", "Dispatchers"]


def structural_page(brief: DataFrame, hubs: DataFrame, dispatchers: DataFrame) -> DataFrame:
    """(repo_id, markdown): a page for each repository from its brief, its hubs and its dispatchers (repo_id, rank, name, count); sections without a fact are left out."""
    def listed(rows: DataFrame, word: str, name: str) -> DataFrame:
        line = F.concat(F.lit("- `"), F.col("name"), F.lit("`: "), F.col("count").cast("string"), F.lit(f" {word}"))
        return rows.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias(name))

    rows = brief.join(listed(hubs, "callers", "h"), "repo_id", "left").join(listed(dispatchers, "callees", "d"), "repo_id", "left")
    size = F.concat(F.col("n_nodes").cast("string"), F.lit(" nodes in "), F.col("n_files").cast("string"), F.lit(" files, "), F.col("n_edges").cast("string"), F.lit(" edges"))
    kinds = F.array_join(F.transform(F.split("kinds", ","), lambda k: F.concat(F.lit("- `"), F.substring_index(k, "=", 1), F.lit("`: "), F.substring_index(k, "=", -1))), "\n")
    parts = [(SECTIONS[0], size), (SECTIONS[1], kinds), (SECTIONS[2], F.col("h")), (SECTIONS[3], F.col("d"))]
    body = F.array_join(F.array_compact(F.array(*[F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"## {t}\n"), x)) for t, x in parts])), "\n\n")
    return rows.select("repo_id", F.concat(F.lit("# "), F.col("repo_id"), F.lit("\n\n"), body).alias("markdown"))
