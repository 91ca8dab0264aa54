"""Fleet facts: owners, commitments, audits, freshness, verdicts and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 180


def anon_author(email: Column, name: Column) -> Column:
    key = F.coalesce(F.nullif(email, F.lit("")), name, F.lit(""))
    return F.concat(F.lit("Contributor "), F.substring(F.sha2(key, 256), 1, 4))


def owners(commits: DataFrame) -> DataFrame:
    """(author, score, share) from (author, ts, lines): each commit counts its lines and one, halved every 180 days before the newest."""
    newest = commits.agg(F.max("ts").alias("newest"))
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 / 86400
    score = commits.join(F.broadcast(newest)).groupBy("author").agg(F.sum((F.col("lines") + 1) * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / HALF_LIFE_DAYS)).alias("s"), F.count(F.lit(1)).alias("n_commits"))
    total = score.agg(F.sum("s").alias("t"))
    return score.join(F.broadcast(total)).select("author", "n_commits", F.round("s", 4).alias("score"), F.round(F.col("s") / F.col("t"), 6).alias("share"))


def owner_table(commits: DataFrame) -> DataFrame:
    """(author, name, n_commits, score, share, last_active) from (email, name, ts, lines): an author is an e-mail, else a name; the name is that of the latest commit; the day is UTC's."""
    author = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("name"), F.lit(""))
    rows = commits.withColumn("author", author)
    scored = owners(rows.select("author", "ts", "lines"))
    latest = rows.groupBy("author").agg(F.max(F.struct("ts", "name")).alias("m"))
    return scored.join(latest, "author").select("author", F.col("m.name").alias("name"), "n_commits", "score", "share", F.date_format("m.ts", "yyyy-MM-dd").alias("last_active"))


def commitment_classes(deps: DataFrame) -> DataFrame:
    """(repo, class) of repositories from (repo, manifest, package, group, readable): unreadable where no manifest could be read, nothing where they ask for nothing, dev-only where
    they ask for development packages alone, else committed."""
    n = deps.groupBy("repo").agg(F.max(F.col("readable").cast("int")).alias("r"), F.count("package").alias("n"), F.sum((F.col("package").isNotNull() & F.col("group").isin("runtime", "peer")).cast("int")).alias("c"))
    return n.select("repo", F.when(F.col("r") == 0, "unreadable").when(F.col("n") == 0, "nothing").when(F.col("c") == 0, "dev-only").otherwise("committed").alias("class"))


def dependency_split(edges: DataFrame) -> DataFrame:
    """(repo, package, side): what a repository publishes (own), needs to run (runtime) and needs besides (dev), from (repo, package, relation, group); its own packages are no dependencies of it."""
    own = edges.where("relation = 'publishes'").select("repo", "package").distinct()
    needs = edges.where("relation = 'depends_on'").groupBy("repo", "package").agg(F.max(F.col("group").isin("runtime", "peer").cast("int")).alias("r"))
    needs = needs.join(own, ["repo", "package"], "left_anti").select("repo", "package", F.when(F.col("r") == 1, "runtime").otherwise("dev").alias("side"))
    return own.withColumn("side", F.lit("own")).unionByName(needs)


def age_buckets(repos: DataFrame, now: Column) -> DataFrame:
    """(bucket, n): repositories by the days since their last commit (repo, last): 30, 90, 180, 365 days or more, or never."""
    days = F.datediff(now, F.col("last"))
    bucket = F.when(days.isNull(), "never").when(days <= 30, "<=30").when(days <= 90, "<=90").when(days <= 180, "<=180").when(days <= 365, "<=365").otherwise(">365")
    return repos.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def commitments(deps: DataFrame) -> DataFrame:
    """(package, n_repos, n_constraints, n_manifests, shared, disagreeing) from (package, repo, manifest, constraint): repositories, not manifests, are counted."""
    out = deps.groupBy("package").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct(F.coalesce("constraint", F.lit("unpinned"))).alias("n_constraints"), F.count_distinct("repo", "manifest").alias("n_manifests"))
    return out.withColumn("shared", F.col("n_repos") > 1).withColumn("disagreeing", (F.col("n_repos") > 1) & (F.col("n_constraints") > 1))


def package_facts(deps: DataFrame) -> DataFrame:
    """(repo, package, constraints) from the repository's shallowest manifests, distinct constraints merged in order."""
    least = deps.groupBy("repo").agg(F.min("depth").alias("depth"))
    shallow = deps.join(least, ["repo", "depth"])
    return shallow.groupBy("repo", "package").agg(F.array_join(F.array_sort(F.collect_set("constraint")), ",").alias("constraints"))


#: Fixed value: packages of a list; what is left out is told by its total.
LISTED = 20


def package_lists(deps: DataFrame, published: DataFrame) -> DataFrame:
    """(repo, side, listed, total) of each repository with packages: what it requires, what development requires (dev_requires) and what it publishes, as package or package constraint, constraint; by lower-cased name,
    the first LISTED of them, and how many there are.  ``deps`` (repo, package, constraint, group, depth) count from the shallowest manifests alone; a package may stand on both
    sides; what a repository publishes (repo, package) it does not require."""
    own = published.select("repo", "package").distinct()
    least = deps.groupBy("repo").agg(F.min("depth").alias("depth"))
    rows = deps.join(least, ["repo", "depth"]).join(own, ["repo", "package"], "left_anti").withColumn("constraint", F.coalesce("constraint", F.lit("")))
    side = F.when(F.col("group").isin("runtime", "peer"), "requires").otherwise("dev_requires")
    each = rows.groupBy("repo", side.alias("side"), "package").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("constraint") != "", F.col("constraint")))), ", ").alias("c"))
    each = each.unionByName(own.select("repo", F.lit("publishes").alias("side"), "package", F.lit("").alias("c")))
    named = each.withColumn("told", F.rtrim(F.concat_ws(" ", "package", "c"))).withColumn("r", F.row_number().over(Window.partitionBy("repo", "side").orderBy(F.lower("package"), "package")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= LISTED, F.struct("r", "told"))))  # nothing is gathered beyond LISTED
    return named.groupBy("repo", "side").agg(F.array_join(F.transform(first, lambda x: x["told"]), "; ").alias("listed"), F.count(F.lit(1)).alias("total"))


def audit(files: DataFrame, meta: str = r"(?i)(^|/)(license|\.gitignore|\.editorconfig|codeowners)[^/]*$", readme: str = r"(?i)(^|/)readme[^/]*$") -> DataFrame:
    """(repo, class): content, readme-only, boilerplate or empty, from (repo, file)."""
    is_readme, is_meta = F.col("file").rlike(readme), F.col("file").rlike(meta)
    n = files.groupBy("repo").agg(F.count("file").alias("n"), F.sum(is_readme.cast("int")).alias("r"), F.sum((~is_readme & ~is_meta).cast("int")).alias("c"))
    return n.select("repo", F.when(F.col("n") == 0, "empty").when(F.col("c") > 0, "content").when((F.col("r") == 1) & (F.col("n") == 1), "readme-only").otherwise("boilerplate").alias("class"))


def verdicts(reviews: DataFrame, least: float = 0.7) -> DataFrame:
    """(page, score, abstained, accepted): the mean of the scores given; none given rejects."""
    out = reviews.groupBy("page").agg(F.round(F.avg("score"), 3).alias("score"), F.sum(F.col("score").isNull().cast("long")).alias("abstained"))
    return out.withColumn("accepted", F.coalesce(F.col("score") >= least, F.lit(False)))


def freshness(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(repo, state): fresh, stale or new, by head and parser version; both unknown counts as fresh."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = current.join(indexed, "repo", "left")
    return rows.select("repo", F.when(F.col("indexed_head").isNull() & F.col("head").isNotNull(), "new").when(same("head", "indexed_head") & same("parser", "indexed_parser"), "fresh").otherwise("stale").alias("state"))


def active_branch(branches: DataFrame, strategy: str = "hybrid", pins: DataFrame | None = None) -> DataFrame:
    """(repo, branch, score): the branch with most commits, the one with the latest, or by 0.6 of the scaled number of commits and 0.4 of the scaled recency; first of the best by name.
    A branch that ``pins`` (repo, branch) names is taken whatever its score, if the repository has it."""
    least = branches.groupBy("repo").agg(F.min("commits").alias("c0"), F.max("commits").alias("c1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    scaled = lambda c, lo, hi: F.when(F.col(hi) == F.col(lo), 1.0).otherwise((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    scores = {"commits": F.col("commits").cast("double"), "recency": F.col("ts").cast("double"), "hybrid": F.round(0.6 * scaled("commits", "c0", "c1") + 0.4 * scaled("ts", "t0", "t1"), 6)}
    if strategy not in scores:
        raise ValueError(f"strategy must be one of {', '.join(scores)}")
    rows = branches.join(least, "repo").withColumn("score", scores[strategy])
    pinned = F.lit(1)
    if pins is not None:
        rows = rows.join(pins.select("repo", "branch", F.lit(0).alias("_pin")), ["repo", "branch"], "left")
        pinned = F.coalesce("_pin", F.lit(1))
    best = rows.groupBy("repo").agg(F.min(F.struct(pinned.alias("p"), (-F.col("score")).alias("s"), "branch")).alias("m"))
    return best.select("repo", "m.branch", (-F.col("m.s")).alias("score"))


def freshness_within(current: DataFrame, indexed: DataFrame, budget: int) -> DataFrame:
    """(repo, state) as ``freshness`` says for the first ``budget`` repositories by name, unchecked beyond: asking for a head costs a call each."""
    first = current.select("repo").orderBy("repo").limit(budget).withColumn("_in", F.lit(True))
    rows = freshness(current, indexed).join(first, "repo", "left")
    return rows.select("repo", F.when(F.col("_in"), F.col("state")).otherwise("unchecked").alias("state"))


def load_bearing_declared(uses: DataFrame, declarations: DataFrame, sites: int = 3, files: int = 2) -> DataFrame:
    """(name, n_sites, n_files, declaration, coverage) of declared values (name, declaration) used surely at several places in several files; coverage is the share of all sure uses that they stand for."""
    sure = uses.where(F.col("confidence") != "AMBIGUOUS")
    total = sure.agg(F.count(F.lit(1)).alias("t"))
    own = declarations.groupBy("name").agg(F.min("declaration").alias("declaration"))
    found = sure.groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct("file").alias("n_files")).where((F.col("n_sites") >= sites) & (F.col("n_files") >= files))
    return found.join(own, "name").join(F.broadcast(total)).select("name", "n_sites", "n_files", "declaration", F.round(F.col("n_sites") / F.col("t"), 6).alias("coverage"))


#: Routes in the order in which they are tried, each with the pattern that asks for it.
ROUTES = [
    ("impact", r"\b(blast\s*radius|what\s+breaks|breaks?\s+if|impact\s+of|affected\s+by|safe\s+to\s+(change|remove|delete|rename)|if\s+i\s+(change|remove|delete|rename|modify)|ripple)\b"),
    ("owners", r"\b(who\s+(owns|knows|wrote|maintains|should\s+i\s+ask)|owner\s+of|maintainer|\bsme\b|subject\s+matter|expert\s+(on|in|for))\b"),
    ("subclasses", r"\b(subclasses?\s+of|subtypes?\s+of|what\s+(extends|implements|subclasses)|who\s+(extends|implements)|classes?\s+that\s+(extend|implement)|implementations?\s+of|derived\s+(from|classes)|extended\s+by)\b"),
    ("dependents", r"\b(what\s+depends\s+on|who\s+depends\s+on|depends?\s+on|dependents?\s+of|which\s+repos?\s+(use|depend)|reverse\s+depend|consumers?\s+of\s+the\s+package)\b"),
    ("callers", r"\b(who\s+calls|what\s+calls|callers?\s+of|called\s+by|call\s+sites?|usages?\s+of|who\s+uses|where\s+is\s+\S+\s+used)\b"),
    ("definition", r"\b(where\s+is\s+\S+\s+defined|where(?:'s|\s+is)\b|defined|definition\s+of|declar(?:e|ed|ation)|find\s+the\s+definition|locate)\b"),
    ("explain", r"\b(explain|how\s+does\b|how\s+do(?:es)?\s+\S+\s+work|what\s+is\b|what'?s\b|overview\s+of|describe|tell\s+me\s+about|architecture\s+of|walk\s+me\s+through|summar(?:y|ize|ise))\b"),
]
#: Words of a question that are never what it asks about.
SCAFFOLD = (
    "a an the is are was were be to of in on for with and or not it this that where who what how why which does do did defined definition calls call caller callers used uses use depends depend dependents owns owner knows know "
    "wrote maintainer maintains explain describe about work works breaks summarise summarize summary overview break if i change remove delete rename modify impact blast radius safe package repo repository function class method "
    "module symbol code you me please can could would should extends extend implements implement subclass subclasses subtype subtypes derived implementations"
).split()


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def route(question: Column) -> Column:
    out = F.lit("search")
    for name, pattern in reversed(ROUTES):
        out = F.when(_matches(question, pattern), name).otherwise(out)
    return out


def _subject(text: Column) -> Column:
    """What a text is about: its first quoted span, else the last of its tokens that look like code, else the last that may be a name; null if there is none."""
    quoted = F.regexp_extract(text, r"[`\"']([^`\"']+)[`\"']", 1)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_./-]*)"), F.lit(1)), lambda t: F.regexp_replace(t, r"[./_-]+$", ""))
    code = lambda t: t.rlike(r"[._/-]|[a-z][A-Z]|^[A-Z]")
    names = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(SCAFFOLD) & (code(t) | ((F.length(t) >= 3) & (t == F.lower(t)) & t.rlike("[a-z]"))))
    last = F.coalesce(F.try_element_at(F.filter(names, code), F.lit(-1)), F.try_element_at(names, F.lit(-1)))
    return F.when(quoted != "", F.trim(quoted)).otherwise(last)


def target_of(question: Column) -> Column:
    """What a question asks about, taken from the first sentence that both asks for the route and names something, if it has several, else from all of it."""
    parts = F.filter(F.split(F.trim(question), r"(?<=[.?!])\s+"), lambda s: F.trim(s) != "")
    asking = F.lit(None).cast("string")

    def first(pattern: str) -> Column:
        return F.get(F.filter(parts, lambda s: _matches(s, pattern) & _subject(s).isNotNull()), 0)

    for name, pattern in ROUTES:
        asking = F.when(route(question) == name, first(pattern)).otherwise(asking)
    return _subject(F.when(F.size(parts) > 1, F.coalesce(asking, question)).otherwise(question))


#: Words that say nothing about what a question asks for.
GENERIC = (
    "a an the is are was were be been being am do does did doing have has had having to of in on at for with and or not it its this that these those there here what which who whom whose when where why how can could would should "
    "may might will shall must me my we our you your they their he she him her his hers about into over under from by as if then than so such all any both each few more most other some only own same too very just also i no nor but "
    "give list show tell find get make use used using name explain describe summarise summarize summary overview walk through work works working defined define definition declared declaration call calls called caller callers "
    "depend depends dependent dependents own owns owner owners know knows wrote maintain maintains maintainer extend extends implement implements repository repo repos service services component components system file files line "
    "lines code function class method module package symbol main every please thanks"
).split()


def content_terms(text: Column) -> Column:
    """The words worth looking for, each once whatever its case, as it stands first."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(GENERIC))

    def first(w: Column) -> Column:
        low = F.transform(w, lambda t: F.lower(t))
        return F.transform(F.array(low), lambda n: F.transform(F.array_distinct(n), lambda t: F.element_at(w, F.array_position(n, t).cast("int"))))[0]

    return F.transform(F.array(words), first)[0]
