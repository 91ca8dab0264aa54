"""Source trees: which files are read, and what SQL and manifests declare."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of generated files in their first 2,048 bytes, ends of their names, and whole names.
GENERATED = ["<auto-generated", "@generated", "do not edit", "code generated by"]
GENERATED_ENDS = [".designer.cs", ".generated.cs", ".g.cs", ".g.i.cs", ".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js"]
GENERATED_NAMES = ["assemblyinfo.cs"]
#: Languages by suffix.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "cpp", "hpp": "cpp", "cc": "cpp",
    "cpp": "cpp", "cxx": "cpp", "pc": "c", "cs": "csharp", "sql": "sql", "tf": "hcl", "xsd": "xsd", "xsl": "xsl", "xslt": "xsl", "xml": "xml", "config": "xml", "html": "html", "css": "css", "scss": "css", "less": "css", "md": "markdown",
    "markdown": "markdown", "mdx": "markdown", "rst": "text", "txt": "text",
    "rb": "ruby", "lua": "lua", "sh": "shell", "bash": "shell", "scala": "scala", "php": "php", "swift": "swift", "pks": "plsql", "pkb": "plsql", "plb": "plsql", "prc": "plsql", "fnc": "plsql", "trg": "plsql", "pls": "plsql",
}
#: Files that are manifests whatever their suffix.
MANIFESTS = r"(^|/)(pyproject\.toml|package\.json|pom\.xml|[^/]*requirements[^/]*\.txt|[^/]*\.csproj)$"


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(file, content, lang) of a tree, by Spark's binary source, so any store works."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    file = F.col("path")
    return raw.select(file.alias("file"), F.decode("content", "utf-8").alias("content"), language(file).alias("lang"))


def language(file: Column) -> Column:
    suffix = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for s, lang in LANGUAGES.items():
        out = F.when(suffix == s, lang).otherwise(out)
    return out


def ignore_pattern(glob: str) -> str:
    """A glob over paths as a regular expression; ** crosses folders, a trailing / means all below."""
    glob = glob + "**" if glob.endswith("/") else glob
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "^(?:.*/)?" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def dispatch(file: Column) -> Column:
    """What reads a file: manifest, adr, document, code or other; by whole names and folders before suffixes."""
    lang = language(file)
    return (
        F.when(file.rlike("(?i)" + MANIFESTS), "manifest").when(file.rlike(r"(?i)(^|/)(adrs?|decisions?)/[^/]*\.md$"), "adr").when(lang.isin("markdown", "text", "html"), "document").when(lang.isNotNull(), "code").otherwise("other")
    )


def is_generated(file: Column, content: Column) -> Column:
    """Whether a file's name or its first bytes say that it was generated."""
    name = F.lower(F.substring_index(file, "/", -1))
    head = F.lower(F.substring(content, 1, 2048))
    out = name.isin(GENERATED_NAMES)
    for end in GENERATED_ENDS:
        out = out | name.endswith(end)
    for mark in GENERATED:
        out = out | head.contains(mark)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, text) of a tree's documents: Markdown's first heading, HTML's title, else the file's name; blank ones are left out."""
    from .web import html_to_text

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for f, lang, c in zip(pdf["file"], pdf["lang"], pdf["content"]):
                title, text = html_to_text(c) if lang == "html" else ("", c)
                heading = re.search(r"^#\s+(.+)$", c, re.M) if lang == "markdown" else None
                if text.strip():
                    rows.append((f, title or (heading[1].strip() if heading else f.rsplit("/", 1)[-1]), text))
            yield pd.DataFrame(rows, columns=["file", "title", "text"])

    tree = read_tree(spark, path)
    return tree.where(dispatch(F.col("file")) == "document").mapInPandas(work, "file string, title string, text string")


def kept_files(files: DataFrame, ignore: list[str]) -> DataFrame:
    """Files that no glob ignores and that were not generated."""
    out = files.where(~is_generated(F.col("file"), F.col("content")))
    for g in ignore:
        out = out.where(~F.col("file").rlike(ignore_pattern(g)))
    return out


def mask_comments(sql: str) -> str:
    """Comments as blanks, so places stay; strings are left alone."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("--", "/*") else m[0]
    return re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?(?:\*/|$)", blank, sql, flags=re.S)


def parse_ddl(sql: str) -> tuple[list[dict], list[dict]]:
    """Tables and views with their lines, and the tables that foreign keys and views refer to."""
    text = mask_comments(sql)
    defs, refs = [], []
    starts = list(re.finditer(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", text, re.I))
    for i, m in enumerate(starts):
        end = starts[i + 1].start() if i + 1 < len(starts) else len(text)
        body, name = text[m.end() : end].split(";")[0], m[2].lower().split(".")[-1]
        defs.append({"kind": m[1].lower(), "name": name, "line": text.count("\n", 0, m.start()) + 1})
        pattern = r"\breferences\s+[\"`\[]?([\w.]+)" if m[1].lower() == "table" else r"\b(?:from|join)\s+[\"`\[]?([\w.]+)"
        for r in re.finditer(pattern, body, re.I):
            to = r[1].lower().split(".")[-1]
            if to != name:
                refs.append({"src": name, "dst": to, "line": text.count("\n", 0, m.end() + r.start()) + 1})
    return defs, refs


def parse_manifest(name: str, content: str) -> list[dict]:
    """(package, constraint, group) that a pyproject.toml, package.json or requirements file asks for; a broken file asks for nothing."""
    out: list[dict] = []
    add = lambda spec, group: out.append({"package": re.split(r"[\s<>=!~;\[(@]", spec.strip(), maxsplit=1)[0], "constraint": re.sub(r"^[\w.\-]+(?:\[[^\]]*\])?\s*", "", spec.split(";")[0].strip()) or None, "group": group})
    try:
        if name.endswith("pyproject.toml"):
            project = tomllib.loads(content).get("project", {})
            for spec in project.get("dependencies", []):
                add(spec, "runtime")
            for group, specs in project.get("optional-dependencies", {}).items():
                for spec in specs:
                    add(spec, group)
        elif name.endswith("package.json"):
            data = json.loads(content)
            for key, group in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
                out += [{"package": p, "constraint": c, "group": group} for p, c in (data.get(key) or {}).items()]
        elif name.endswith("pom.xml"):
            out += _maven(content)
        elif name.endswith(".csproj"):
            for m in re.finditer(r"<PackageReference\b([^<>]*?)(?:/>|>(.*?)</PackageReference>)", content, re.S):
                attrs = dict(re.findall(r"(\w+)\s*=\s*\"([^\"]*)\"", m[1]))
                inner = re.search(r"<Version>\s*([^<]+?)\s*</Version>", m[2] or "")
                dev = attrs.get("PrivateAssets", "").lower() == "all" or "<PrivateAssets>all" in (m[2] or "")
                if attrs.get("Include"):
                    out.append({"package": attrs["Include"], "constraint": attrs.get("Version") or (inner[1] if inner else None), "group": "dev" if dev else "runtime"})
        elif re.search(r"requirements[^/]*\.txt$", name):
            for line in content.splitlines():
                if (line := line.split("#")[0].strip()) and not line.startswith("-"):
                    add(line, "runtime")
    except (ValueError, AttributeError, TypeError):
        return []
    return out


def _maven(content: str) -> list[dict]:
    """Dependencies of a Maven project by group:artifact; the scopes test and provided are development."""
    out = []
    for m in re.finditer(r"<dependency>(.*?)</dependency>", content, re.S):
        field = lambda k, block=m[1]: next((x.strip() for x in re.findall(rf"<{k}>([^<]*)</{k}>", block)), None)
        if artifact := field("artifactId"):
            scope = (field("scope") or "compile").lower()
            group = "optional" if (field("optional") or "").lower() == "true" else "dev" if scope in ("test", "provided") else "runtime"
            out.append({"package": ":".join(x for x in (field("groupId"), artifact) if x), "constraint": field("version"), "group": group})
    return out


def published(name: str, content: str) -> str | None:
    """The package that a manifest's own project publishes."""
    try:
        if name.endswith("pyproject.toml"):
            return tomllib.loads(content).get("project", {}).get("name")
        if name.endswith("package.json"):
            return json.loads(content).get("name")
    except (ValueError, AttributeError, TypeError):
        return None
    if name.endswith("pom.xml"):
        own = re.sub(r"(?s)<(dependencies|parent|build|profiles|dependencyManagement|plugins)>.*?</\1>", "", content)
        group = re.search(r"<groupId>([^<]*)</groupId>", own) or re.search(r"(?s)<parent>.*?<groupId>([^<]*)</groupId>", content)
        artifact = re.search(r"<artifactId>([^<]*)</artifactId>", own)
        return ":".join(x[1].strip() for x in (group, artifact) if x) if artifact else None
    if name.endswith(".csproj"):
        m = re.search(r"<(?:PackageId|AssemblyName)>([^<]+)<", content)
        return m[1].strip() if m else None
    return None


def manifest_edges(files: DataFrame) -> DataFrame:
    """(file, relation, package, constraint, group, line) of all manifests among files (file, content): what each publishes and depends on, with the first line that names it."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for f, c in zip(pdf["file"], pdf["content"]):
                line = lambda p, c=c: c.count("\n", 0, max(c.find(p.split(":")[-1]), 0)) + 1
                if own := published(f, c):
                    rows.append((f, "publishes", own, None, None, line(own)))
                rows += [(f, "depends_on", d["package"], d["constraint"], d["group"], line(d["package"])) for d in parse_manifest(f, c) if d["package"]]
            yield pd.DataFrame(rows, columns=["file", "relation", "package", "constraint", "group", "line"])

    own = files.where(F.col("file").rlike("(?i)" + MANIFESTS)).select("file", "content")
    return own.mapInPandas(work, "file string, relation string, package string, constraint string, group string, line int")
