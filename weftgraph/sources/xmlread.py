"""XML read as a stream of events: configuration keys, Maven projects, and what versions their dependencies inherit.

A text is scanned once, its line numbers come with the events, and no tree is built.  Reading stops at the first error and keeps what came before; entities are
not expanded, so no document can grow.  Fragments without one root are read as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import small, work_table

#: Parts of a key's name that make its value a secret.
SECRET_NAMES = ["pass", "pwd", "secret", "token", "credential", "apikey", "api_key", "private", "salt", "cert", "connectionstring", "conn_str", "connstr"]
#: Values that are secrets whatever they are called: an assignment of one within, an authorisation header, a long run of key signs.
SECRET_VALUES = [r"(?:password|pass|pwd|secret|token|api[_-]?key|auth)\s*[=:]", r"\b(?:bearer|basic)\s+\S+", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}"]
_NAME, _VALUE = (re.compile("|".join(x), re.I) for x in (SECRET_NAMES, SECRET_VALUES))


@dataclass
class Element:
    """An element at its end: its path of local names from the root on, attributes, own text, line, and whether it had no children."""

    path: tuple[str, ...]
    attrs: dict[str, str]
    line: int
    text: str = ""
    leaf: bool = True
    children: dict[str, str] = field(default_factory=dict)  #: texts of leaf children by name, the first of each


class _Stop(Exception):
    pass


def elements(source: str) -> list[Element]:
    """The elements of a text in the order of their ends; those that an error leaves open are not among them."""
    out: list[Element] = []
    open_: list[Element] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attrs: dict) -> None:
        if open_:
            open_[-1].leaf = False
        local = name.rsplit(":", 1)[-1]
        open_.append(Element((*open_[-1].path, local) if len(open_) > 1 else (local,), attrs, parser.CurrentLineNumber) if open_ else Element((), {}, 1))
        if len(open_) > 500:
            raise _Stop

    def text(data: str) -> None:
        open_[-1].text += data

    def end(_: str) -> None:
        done = open_.pop()
        if open_:
            if done.leaf:
                open_[-1].children.setdefault(done.path[-1], done.text.strip())
            out.append(done)

    def entity(*_) -> None:
        raise _Stop

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, text, entity
    # A root of our own holds fragments; what may only stand before a root is blanked, line ends stay.
    body = re.sub(r"^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*(?:<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)?", lambda m: re.sub(r"[^\n]", " ", m[0]), source, count=1, flags=re.S)
    try:
        parser.Parse(("<_>" + body + "</_>").encode("utf-8", "replace"), True)
    except (expat.ExpatError, _Stop):
        pass
    return out


def config_keys(source: str) -> list[dict]:
    """(name, value, hidden, line) of what a text configures: elements with a key or name and a value, and leaves with a text.  A secret, by its name or by its value, has no value."""
    out = []
    for e in elements(source):
        name = e.attrs.get("key") or e.attrs.get("name")
        value = e.attrs.get("value", e.attrs.get("connectionString"))
        if not name or value is None:
            name, value = (e.path[-1], e.text.strip()) if e.leaf and e.text.strip() else (None, None)
        if name:
            hidden = bool(_NAME.search(name) or _VALUE.search(value) or "connectionString" in e.attrs)
            out.append({"name": name, "value": None if hidden else value, "hidden": hidden, "line": e.line})
    return sorted(out, key=lambda r: r["line"])


def config(files: DataFrame) -> DataFrame:
    """(file, name, value, hidden, line) of all configuration in XML among files (file, lang, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, r["name"], r["value"], r["hidden"], r["line"]) for f, c in zip(pdf["file"], pdf["content"]) for r in config_keys(c or "")]
            yield pd.DataFrame(rows, columns=["file", "name", "value", "hidden", "line"])

    own = files.where((F.col("lang") == "xml") & ~F.col("file").rlike(r"(^|/)pom\.xml$")).select("file", "content")
    return own.mapInPandas(work, "file string, name string, value string, hidden boolean, line int")


# ---- Maven

_DEPENDENCY = "struct<package:string,version:string,scope:string,line:int>"
POM = f"file string, package string, version string, parent string, parent_version string, properties map<string,string>, managed array<{_DEPENDENCY}>, dependencies array<{_DEPENDENCY}>"
#: Names within names that a version may hold, and ancestors that a project may have.
NESTED, ANCESTORS = 8, 64


def pom(source: str) -> dict | None:
    """A project's coordinate, parent, properties, managed and own dependencies; None without an artifact."""
    own, parent, properties, managed, wanted = {}, {}, {}, [], []
    for e in elements(source):
        p = e.path
        if p == ("project",):
            own = e.children
        elif p == ("project", "parent"):
            parent = e.children
        elif p[:2] == ("project", "properties") and len(p) == 3:
            properties[p[2]] = e.text.strip()
        elif p in (("project", "dependencies", "dependency"), ("project", "dependencyManagement", "dependencies", "dependency")) and e.children.get("artifactId"):
            c = e.children
            scope = "optional" if c.get("optional", "").lower() == "true" else c.get("scope", "compile").lower()
            row = (":".join(x for x in (c.get("groupId"), c["artifactId"]) if x), c.get("version") or None, scope, e.line)
            (managed if "dependencyManagement" in p else wanted).append(row)
    if not own.get("artifactId"):
        return None
    group, version = own.get("groupId") or parent.get("groupId"), own.get("version") or parent.get("version")
    up = ":".join(x for x in (parent.get("groupId"), parent.get("artifactId")) if x) or None
    known = {"project.groupId": group, "project.artifactId": own["artifactId"], "project.version": version, "pom.version": version, "version": version, "project.parent.version": parent.get("version")}
    return {"package": ":".join(x for x in (group, own["artifactId"]) if x), "version": version, "parent": up, "parent_version": parent.get("version"), "properties": {**{k: v for k, v in known.items() if v}, **properties}, "managed": managed, "dependencies": wanted}


def poms(files: DataFrame) -> DataFrame:
    """One row, as ``POM`` says, for each pom.xml that has an artifact."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "package", "version", "parent", "parent_version", "properties", "managed", "dependencies"]
        keys = ("package", "version", "scope", "line")
        for pdf in batches:
            rows = [{"file": f, **p} for f, c in zip(pdf["file"], pdf["content"]) if (p := pom(c or ""))]
            rows = [{**r, "managed": [dict(zip(keys, d)) for d in r["managed"]], "dependencies": [dict(zip(keys, d)) for d in r["dependencies"]]} for r in rows]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("file").rlike(r"(^|/)pom\.xml$")).select("file", "content").mapInPandas(work, POM)


def resolved(text: Column, properties: Column) -> Column:
    """A text with ${name} replaced by what ``properties`` say, also within what replaces it, at most NESTED deep; unknown names stay."""

    def once(acc: Column, _: Column) -> Column:
        name = F.regexp_extract(acc, r"\$\{([^{}$]+)\}", 1)
        value = F.element_at(properties, name)
        return F.when((name != "") & value.isNotNull(), F.replace(acc, F.concat(F.lit("${"), name, F.lit("}")), value)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(NESTED)), text, once)


def _over(low: Column, high: Column) -> Column:
    """Both maps in one, ``high`` winning."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def inherited(projects: DataFrame) -> DataFrame:
    """``projects`` with the properties and managed versions (a map) of all their ancestors, the nearest winning.

    Every round joins projects with their next ancestor by its coordinate (the one of the wanted version, else the smallest file); a project that comes by an ancestor again
    goes no further.  Rounds are as many as the longest line of ancestors.
    """
    managed = F.map_from_entries(F.transform(F.array_distinct(F.transform("managed", lambda d: d["package"])), lambda p: F.struct(p, F.element_at(F.filter("managed", lambda d: d["package"] == p), 1)["version"])))
    base = work_table(projects.withColumn("versions", F.map_filter(managed, lambda _, v: v.isNotNull())).drop("managed"), "poms")
    best = F.row_number().over(Window.partitionBy("package", "version").orderBy("file"))
    known = base.withColumn("_r", best).where("_r = 1").select(F.col("package").alias("_p"), F.col("version").alias("_v"), "file", "parent", "parent_version", "properties", "versions")
    any_of = known.groupBy("_p").agg(F.min_by("_v", "file").alias("_any"), F.collect_set("_v").alias("_all"))
    state = base.select("file", "package", "version", "dependencies", "properties", "versions", F.col("parent").alias("_next"), F.col("parent_version").alias("_want"), F.array("file").alias("_seen"))
    done = None
    for _ in range(ANCESTORS):
        ends = any_of if not small(any_of) else F.broadcast(any_of)
        asked = state.join(ends, F.col("_next") == F.col("_p"), "left").drop("_p").withColumn("_v", F.when(F.array_contains("_all", F.col("_want")), F.col("_want")).otherwise(F.col("_any"))).drop("_all", "_any")
        up = known.select(F.col("_p").alias("_next"), F.col("_v"), F.struct("file", "parent", "parent_version", "properties", "versions").alias("u"))
        met = asked.join(up, (asked["_next"] == up["_next"]) & asked["_v"].eqNullSafe(up["_v"]), "left").drop(up["_next"]).drop(up["_v"]).drop("_v")
        goes = F.col("u").isNotNull() & ~F.coalesce(F.array_contains("_seen", F.col("u.file")), F.lit(False))
        met = work_table(met.withColumn("_goes", goes), "ancestors")
        stopped = met.where(~F.col("_goes")).select("file", "package", "version", "dependencies", "properties", "versions")
        done = stopped if done is None else done.unionByName(stopped)
        state = met.where("_goes").select("file", "package", "version", "dependencies", _over(F.col("u.properties"), F.col("properties")).alias("properties"), _over(F.col("u.versions"), F.col("versions")).alias("versions"), F.col("u.parent").alias("_next"), F.col("u.parent_version").alias("_want"), F.concat("_seen", F.array("u.file")).alias("_seen"))
        if state.isEmpty():
            return done
    return done.unionByName(state.select(*done.columns))


def maven_dependencies(files: DataFrame) -> DataFrame:
    """(file, project, package, constraint, group, line) of every dependency of every Maven project among files (file, content): a version of its own, else the managed one of the nearest
    ancestor, with properties replaced, those of a project winning over its ancestors'; null where nothing gives one."""
    d = inherited(poms(files)).select("file", "package", "properties", "versions", F.explode("dependencies").alias("d"))
    name, project = (resolved(F.col(c), F.col("properties")) for c in ("d.package", "package"))
    d = d.select("file", project.alias("project"), name.alias("package"), "properties", "versions", "d")
    version = F.coalesce(F.col("d.version"), F.element_at("versions", F.col("d.package")), F.element_at("versions", F.col("package")))
    group = F.when(F.col("d.scope") == "optional", "optional").when(F.col("d.scope").isin("test", "provided"), "dev").otherwise("runtime")
    return d.select("file", "project", "package", resolved(version, F.col("properties")).alias("constraint"), group.alias("group"), F.col("d.line").alias("line"))
