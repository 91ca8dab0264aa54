"""Definitions and calls of languages whose scopes are told by keywords, from tables.

One scan cuts a text into comments, strings, words and signs; a stack holds the open scopes.  What opens a scope, what closes one and what names a definition
is a row of ``LANGUAGES``; so a language is a table, not a parser.  Time is linear in the text.  Rows are those of ``extract``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_JOINS = (":", ".", "\\")
#: Scopes within each other that full names tell apart.
DEPTH = 100
CLASSES = ("class", "interface", "namespace", "struct", "enum")


@dataclass(frozen=True)
class Language:
    """``defines``: word to kind.  ``opens`` open a scope without a name, those of ``starts`` only where a statement begins; ``closes`` end one.  ``skips`` are words behind
    a closing one that belong to it.  ``braces``: scopes are { }.  ``parents``: what stands before the names of bases.  ``bare``: calls are the first words of commands."""

    comments: str
    strings: str = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
    defines: dict[str, str] = field(default_factory=dict)
    opens: frozenset = frozenset()
    starts: frozenset = frozenset()
    closes: frozenset = frozenset({"end"})
    skips: frozenset = frozenset()
    braces: bool = False
    parents: frozenset = frozenset()
    no_call: frozenset = frozenset()
    bare: bool = False
    any_case: bool = False
    body: frozenset = frozenset()  #: words behind a definition's head that begin its body; without one before ';' it is a declaration


def _words(text: str) -> frozenset:
    return frozenset(text.split())


_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_CONTROL = _words("if for while switch match catch return foreach elseif else do new guard repeat throw unless until and or not function func def fn array isset list echo print")
LANGUAGES = {
    "ruby": Language(r"#[^\n]*|^=begin\b.*?(?:^=end|\Z)", defines={"class": "class", "module": "class", "def": "function"}, opens=_words("do begin case"), starts=_words("if unless while until for"), parents=_words("<"), no_call=_CONTROL | _words("puts require yield super attr_accessor")),
    "lua": Language(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", defines={"function": "function"}, opens=_words("if do repeat"), closes=_words("end until"), no_call=_CONTROL),
    "shell": Language(r"(?:(?<=\s)|^)#[^\n]*", defines={"function": "function"}, braces=True, bare=True, no_call=_words("if then else elif fi for while until do done case esac in function return local export readonly declare set unset echo exit shift true false test cd source eval exec trap read printf")),
    "scala": Language(_C_COMMENTS, r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", defines={"class": "class", "trait": "interface", "object": "class", "def": "function"}, braces=True, parents=_words("extends with"), no_call=_CONTROL),
    "php": Language(_C_COMMENTS + r"|#[^\n\[][^\n]*", defines={"class": "class", "interface": "interface", "trait": "class", "function": "function"}, braces=True, parents=_words("extends implements ,"), no_call=_CONTROL),
    "swift": Language(_C_COMMENTS, r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", defines={"class": "class", "struct": "struct", "protocol": "interface", "enum": "enum", "extension": "class", "func": "function"}, braces=True, parents=_words(": ,"), no_call=_CONTROL),
    "plsql": Language(r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"'(?:''|[^'])*'", defines={"package": "namespace", "procedure": "function", "function": "function", "trigger": "function"}, opens=_words("if loop case begin"), skips=_words("if loop case"), any_case=True, body=_words("is as begin declare"), no_call=_words("if elsif while for in values and or not exists varchar2 number char nvarchar2 raw return is as when into table cursor type")),
}


def tokens(source: str, lang: Language):
    """(text, place) of words and signs; a line end is a token, comments are none and a string is an empty one."""
    for m in re.finditer(rf"(?P<no>{lang.comments})|(?P<text>{lang.strings})|(?P<word>[A-Za-z_$][\w$]*[?!]?)|(?P<other>[^\s\w]|\n)", source, re.S | re.M):
        if m["no"] is None:
            yield ("" if m["text"] is not None else m["word"] or m["other"], m.start())


def parse(source: str, name: str) -> tuple[list[dict], list[dict]]:
    from .extract import _ref, _row, line_of

    lang = LANGUAGES[name]
    seen = [(t.lower() if lang.any_case else t, at, t) for t, at in tokens(source, lang)]
    defs, refs, scope = [], [], []

    def push(own: str, kind: str) -> None:
        """A scope is its name, its kind, its full name and the kind of the innermost scope with a name; beyond DEPTH full names grow no longer."""
        path, inside = scope[-1][2:] if scope else ("", "")
        scope.append((own, kind, (f"{path}.{own}" if path else own) if own and len(scope) < DEPTH else path, kind if own else inside))

    here = lambda: scope[-1][2] if scope else ""
    pending, i, begins, loop_head = None, 0, True, False
    while i < len(seen):
        t, at, raw = seen[i]
        was, begins = begins, t in ("\n", ";", "{", "}", "then", "do", "else") or (begins and t == "")
        if t == "\n":
            loop_head = False
        if t in lang.defines and (i == 0 or seen[i - 1][0] not in (".", "->", ":")) and not (t == "class" and i > 1 and seen[i - 1][0] == "<"):
            found = _head(seen, i, lang, name)
            if found is None:  # a function without a name, or "class << self"
                if not lang.braces and not lang.body:
                    push("", "")
            else:
                own, parents, i, has_body = found
                inside, kind, line = scope[-1][3].rstrip("?") if scope else "", lang.defines[t], line_of(source, at)
                kind = "method" if kind == "function" and inside in CLASSES and name != "plsql" else kind
                full = f"{here()}.{own}" if here() else own
                defs.append(_row(kind, own.split(".")[-1], full, line, here()))
                refs.extend(_ref("inherits", full, p, line) for p in parents)
                if lang.braces:
                    pending = (own, kind)
                elif has_body:
                    push(own, kind + "?" if lang.body else kind)  # with "?" its own begin is still to come
                begins = True
                continue
        elif lang.braces and name == "shell" and was and raw and i + 2 < len(seen) and seen[i + 1][0] == "(" and seen[i + 2][0] == ")":
            defs.append(_row("function", t, f"{here()}.{t}" if here() else t, line_of(source, at), here()))
            pending, i = (t, "function"), i + 2
        elif lang.braces and t == "{":
            push(*(pending or ("", "")))
            pending = None
        elif lang.braces and t in ("}", ";"):
            pending = None  # what has no body by then has none
            if t == "}" and scope:
                scope.pop()
        elif not lang.braces and t in lang.closes:
            if scope:
                scope.pop()
            if i + 1 < len(seen) and seen[i + 1][0] in lang.skips:
                i += 1
        elif lang.body and t == "begin" and scope and scope[-1][1].endswith("?"):
            scope[-1] = (scope[-1][0], scope[-1][1][:-1], *scope[-1][2:])
        elif not lang.braces and t in lang.opens and not (t == "do" and loop_head):
            push("", "")
        elif not lang.braces and t in lang.starts and (was or (i and seen[i - 1][0] in ("=", "("))):
            push("", "")
            loop_head = t in ("while", "until", "for")
        elif re.match(r"[A-Za-z_]", raw) and t not in lang.no_call:
            called = was if lang.bare else i + 1 < len(seen) and seen[i + 1][0] == "("
            if called and (lang.bare is False or not (i + 1 < len(seen) and seen[i + 1][0] == "=")):
                refs.append(_ref("calls", here(), t, line_of(source, at)))
        i += 1
    return defs, refs


def _head(seen: list, i: int, lang: Language, name: str):
    """The name behind a defining word, the names of its bases, where to go on, and whether a body follows; None without a name."""
    j = i + 1
    while j < len(seen) and seen[j][0] in ("body", "&") and name in ("plsql", "php"):
        j += 1
    if j >= len(seen) or not re.match(r"[A-Za-z_$]", seen[j][2]):
        return None
    own = seen[j][0]
    while j + 2 < len(seen) and seen[j + 1][0] in (".", ":") and re.match(r"[A-Za-z_]", seen[j + 2][2]) and name in ("lua", "ruby", "plsql"):
        own, j = (seen[j + 2][0] if own == "self" or name == "plsql" else f"{own}.{seen[j + 2][0]}"), j + 2
    parents, k, depth, has_body = [], j + 1, 0, not lang.body
    while k < len(seen) and lang.defines[seen[i][0]] in CLASSES and not lang.body and seen[k][0] not in ("{", "\n", ";"):
        depth += {"(": 1, ")": -1}.get(seen[k][0], 0)
        if not depth and seen[k][0] in lang.parents and k + 1 < len(seen):
            base, last = k + 1, None
            while base < len(seen) and (seen[base][0] in _JOINS or (last is None or seen[base - 1][0] in _JOINS) and re.match(r"[A-Za-z_]", seen[base][2])):
                last = base if seen[base][0] not in _JOINS else last
                base += 1
            if last:
                parents.append(seen[last][0])
                k = last
        k += 1
    if lang.body:
        k = j + 1
        while k < len(seen) and (depth or seen[k][0] not in lang.body) and not (not depth and seen[k][0] == ";"):
            depth += {"(": 1, ")": -1}.get(seen[k][0], 0)
            k += 1
        has_body = k < len(seen) and seen[k][0] in lang.body
        k += seen[k][0] in ("is", "as", "declare") if k < len(seen) else 0
        return own, parents, k, has_body
    if name == "ruby" and lang.defines[seen[i][0]] == "function":  # "def f(a) = b" has no end
        e = j + 1
        while e < len(seen) and seen[e][0] != "\n" and (depth or e == j + 1 or seen[e - 1][0] != ")"):
            depth += {"(": 1, ")": -1}.get(seen[e][0], 0)
            if not depth and seen[e][0] not in (")",):
                break
            e += 1
        has_body = not (e < len(seen) and seen[e][0] == "=")
    return own, parents, max(j + 1, min(k, len(seen))), has_body
