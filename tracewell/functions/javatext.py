"""Java source text as Column expressions. Only `outline` needs a helper in Python, as brackets nest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.sqltext import _c, _let

#: Names before a bracket that aren't calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "new", "super", "this")
#: Fixed names of mapper methods that read and that write, and service methods that stand for them.
CRUD_READS = ("selectPage", "selectList", "selectOne", "selectById", "selectBatchIds", "selectMaps", "selectCount")
CRUD_WRITES = ("insert", "updateById", "update", "deleteById", "delete", "deleteBatchIds")
SERVICE_CRUD = ("getById", "list", "page", "save", "updateById", "removeById")
WRAPPER_CALLS = ("Result.data", "Result.success", "Result.fail", "Result.error")

#: A text block, string or character of Java.
_QUOTED = r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''


def strip_comments(source: Column | str) -> Column:
    """Without comments; what looks like one within quotes stays."""
    return F.regexp_replace(_c(source), r"(?s)(" + _QUOTED + r")|/\*.*?\*/|//[^\n]*", "$1 ")


def type_name(ref: Column | str) -> Column:
    """A type's simple name: the last name before its generics or array brackets."""
    names = F.regexp_extract_all(F.substring_index(F.substring_index(_c(ref), "<", 1), "[", 1), F.lit(r"[\w$]+"), F.lit(0))
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.trim(_c(ref)))


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " "}


def decode_literal(content: Column | str) -> Column:
    """A string literal's content with Java's escapes undone, and then those that text for a second reader has."""
    pieces = F.regexp_extract_all(_c(content), F.lit(r"(?s)(?:\\u+[0-9a-fA-F]{4})+|\\(?:[0-3][0-7]{2}|[0-7]{1,2})|\\.|[^\\]+"), F.lit(0))
    plain = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in _ESCAPES.items()))

    def undone(x: Column) -> Column:
        code = F.substring(x, F.lit(2), F.length(x))
        return (
            F.when(~x.startswith("\\"), x)
            .when(x.rlike(r"^\\u"), F.decode(F.unhex(F.regexp_replace(x, r"\\u+", "")), "UTF-16BE"))
            .when(x.rlike(r"^\\[0-7]"), F.char(F.conv(code, 8, 10).cast("int")))
            .otherwise(F.coalesce(F.try_element_at(plain, code), code))
        )

    out = F.array_join(F.transform(pieces, undone), "")
    for written, meant in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def service_mapper(extended: Column | str) -> Column:
    """Mapper of a type that extends ServiceImpl<Mapper, ...>, or null."""
    return F.nullif(type_name(F.regexp_extract(F.get(_c(extended), F.lit(0)), r"^ServiceImpl<([\w.]+)", 1)), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\f"))


def string_literals(text: Column | str) -> Column:
    """Contents of double-quoted literals, decoded."""
    quoted = F.filter(F.regexp_extract_all(_c(text), F.lit(r"(?s)" + _QUOTED), F.lit(0)), lambda x: x.startswith('"'))
    return F.transform(quoted, lambda x: decode_literal(F.regexp_replace(x, r'^"(?:"")?|(?:"")?"$', "")))


def sql_literals(text: Column | str) -> Column:
    """Literals that start like a statement, but not directly behind an annotation's bracket."""
    plain = F.regexp_replace(_c(text), r"(?s)@\w+\s*\(\s*(?:" + _QUOTED + ")", "@")
    return F.filter(F.transform(string_literals(plain), trimmed), lambda x: x.rlike(r"(?i)^(?:select|insert|update|delete|create)\b"))


def calls(body: Column | str) -> Column:
    """Distinct calls of a body: receiver.name in order, then names without a receiver, also those behind a bracket's dot."""
    masked = F.regexp_replace(_c(body), r"(?s)" + _QUOTED, '""')
    words = F.regexp_extract_all(masked, F.lit(r"[\p{L}_$][\p{L}\p{N}_$]*|\S"), F.lit(0))

    def found(w: Column) -> Column:
        named = lambda k: F.get(w, k).rlike(r"^[\p{L}_$]")
        places = F.filter(F.sequence(F.lit(0), F.size(w)), lambda k: (F.get(w, k + 1) == "(") & named(k) & F.coalesce(F.get(w, k - 1) != "@", F.lit(True)))
        received = lambda k: F.coalesce((F.get(w, k - 1) == ".") & named(k - 2), F.lit(False))
        pairs = F.transform(F.filter(places, received), lambda k: F.concat(F.get(w, k - 2), F.lit("."), F.get(w, k)))
        alone = F.transform(F.filter(places, lambda k: ~received(k) & ~F.get(w, k).isin(*NOT_CALLS)), lambda k: F.get(w, k))
        return F.array_distinct(F.concat(pairs, alone))

    return _let(words, found)


def bean_class(receiver: Column | str) -> Column:
    """orderRepo as OrderRepo."""
    r = _c(receiver)
    return F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))


def implementation_names(declared: Column | str) -> Column:
    """Conventional class names for a declared type, in order of priority."""
    t = type_name(declared)
    stem = F.substring(t, F.lit(2), F.length(t))
    named = F.array(F.concat(stem, F.lit("Impl")), stem, F.concat(t, F.lit("Impl")), t)
    return F.array_distinct(F.when(t.rlike(r"^I[A-Z]"), named).otherwise(F.array(F.concat(t, F.lit("Impl")), t)))


def route_literal(arguments: Column | str) -> Column:
    return F.regexp_extract(_c(arguments), r'"([^"]+)"', 1)


def join_path(*parts: Column | str) -> Column:
    """/a/b of parts trimmed of blanks and slashes; / if nothing is left."""
    some = F.filter(F.transform(F.array(*[F.trim(F.coalesce(_c(p), F.lit(""))) for p in parts]), lambda x: F.regexp_replace(x, r"^/+|/+$", "")), lambda x: x != "")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(some, "/")), r"/+", "/")


def http_verb(annotation: Column | str, arguments: Column | str) -> Column:
    """GET ... of a mapping annotation; of @RequestMapping only with an explicit method; else null."""
    a = _c(annotation)
    plain = F.upper(F.nullif(F.regexp_extract(a, r"^(Get|Post|Put|Delete|Patch)Mapping$", 1), F.lit("")))
    return F.when(a == "RequestMapping", F.nullif(F.regexp_extract(_c(arguments), r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)", 1), F.lit(""))).otherwise(plain)


_ANNOTATIONS = "array<struct<name:string,args:string>>"
OUTLINE = (
    f"kind string, name string, extended array<string>, implemented array<string>, annotations {_ANNOTATIONS}, "
    f"methods array<struct<name:string,body:string,annotations:{_ANNOTATIONS},start:int>>, fields array<struct<declared:string,receiver:string>>"
)
_TOKEN = re.compile(_QUOTED + r"|[^\W\d][\w$]*|\d[\w.]*|\S")
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "default", "synchronized", "transient", "volatile", "native", "strictfp", "sealed"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class _Reader:
    """A type's tokens, and for each opening bracket the place of its closing one."""

    def __init__(self, source: str):
        self.source = source
        found = list(_TOKEN.finditer(source))
        self.text, self.at = [m[0] for m in found], [m.start() for m in found] + [len(source)]
        self.end, opened = {}, []
        for k, t in enumerate(self.text):
            if t in _CLOSING:
                opened.append(k)
            elif t in ")]}" and opened and _CLOSING[self.text[opened[-1]]] == t:
                self.end[opened.pop()] = k
        self.types: list[dict] = []
        self.methods: list[dict] = []
        self.fields: list[dict] = []

    def between(self, a: int, b: int) -> str:
        """Source from token a up to token b."""
        return self.source[self.at[a] : self.at[b]].strip()

    def head(self, k: int, stop: int) -> tuple[list[dict], int]:
        """Annotations before a declaration, and where modifiers and they end."""
        marks = []
        while k < stop and (self.text[k] in _MODIFIERS or (self.text[k] == "@" and self.text[k + 1 : k + 2] != ["interface"])):
            if self.text[k] != "@":
                k += 1
                continue
            k += 1
            while self.text[k + 1 : k + 2] == ["."]:
                k += 2
            name, args = self.text[k : k + 1], ""
            if self.text[k + 1 : k + 2] == ["("]:
                close = self.end.get(k + 1, stop)
                args, k = self.source[self.at[k + 1] + 1 : self.at[min(close, len(self.text))]], close
            marks += [{"name": n, "args": args} for n in name]
            k += 1
        return marks, k

    def listed(self, k: int, stop: int) -> Iterator[str]:
        """Types between commas that stand in no generic's brackets."""
        depth, start = 0, k
        for j in range(k, stop + 1):
            if j == stop or (self.text[j] == "," and not depth):
                if start < j:
                    yield "".join(self.text[start:j])
                start = j + 1
            else:
                depth += {"<": 1, ">": -1}.get(self.text[j], 0)

    def declared(self, k: int, marks: list[dict]) -> int:
        """A class, interface, enum or record whose keyword is token k; returns where it ends."""
        opens = next((j for j in range(k, len(self.text)) if self.text[j] == "{"), len(self.text))
        parts, cuts, depth = {"extends": [], "implements": [], "permits": []}, [], 0
        for j in range(k, opens):
            depth += {"<": 1, ">": -1}.get(self.text[j], 0)
            if not depth and self.text[j] in parts:
                cuts.append(j)
        for j, stop in zip(cuts, [*cuts[1:], opens], strict=False):
            parts[self.text[j]] += self.listed(j + 1, stop)
        self.types.append({"kind": self.text[k], "name": "".join(self.text[k + 1 : k + 2]), "extended": parts["extends"], "implemented": parts["extends"] if self.text[k] == "interface" else parts["implements"], "annotations": marks})
        close = self.end.get(opens, len(self.text))
        if self.text[k] == "enum":  # its constants come before the first semicolon
            opens = next((j for j in range(opens, close) if self.text[j] == ";"), close)
        self.members(opens + 1, close)
        return close + 1

    def members(self, k: int, stop: int) -> None:
        """Types, methods and fields among tokens k up to stop."""
        while k < stop:
            marks, k = self.head(k, stop)
            if self.text[k : k + 1] == ["@"]:  # @interface
                k += 1
            if k < stop and self.text[k] in ("class", "interface", "enum", "record"):
                k = self.declared(k, marks)
                continue
            start, depth, named, ends = k, 0, None, None
            while k < stop and ends is None:  # up to a bracket for parameters or a block, an assignment, a comma or the end
                t = self.text[k]
                depth += {"<": 1, ">": -1}.get(t, 0)
                if t == "(" and named is None:
                    named, k = k, self.end.get(k, stop)
                elif t in ("{", ";", "=") or (t == "," and not depth and named is None):
                    ends = t
                    break
                k += 1
            k = min(k, stop)  # a bracket may stay open
            if named is not None and ends in ("{", ";"):
                name = self.text[named - 1] if named > start else ""
                close = self.end.get(k, stop) if ends == "{" else k
                if re.match(r"[^\W\d]", name) and name not in NOT_CALLS:
                    body = self.source[self.at[k] + 1 : self.at[min(close, len(self.text))]] if ends == "{" else ""
                    self.methods.append({"name": name, "body": body, "annotations": marks, "start": self.at[named - 1]})
                k = close + 1
            elif ends == "{":  # an initialiser
                k = self.end.get(k, stop) + 1
            else:
                own = [j for j in range(start, k) if self.text[j] not in ("[", "]")]
                if named is None and len(own) > 1 and self.text[start] not in ("package", "import"):
                    self.fields.append({"declared": self.between(start, own[-1]), "receiver": self.text[own[-1]]})
                while k < stop and self.text[k] != ";":  # a value, more names
                    k = self.end.get(k, k) + 1
                k += 1


def _outlined(source: str | None) -> dict:
    """The first type of a file; methods and fields of all, nested ones included."""
    reader = _Reader(source or "")
    reader.members(0, len(reader.text))
    first = reader.types[0] if reader.types else {"kind": None, "name": None, "extended": [], "implemented": [], "annotations": []}
    return first | {"methods": reader.methods, "fields": reader.fields}


def outline(source: Column | str) -> Column:
    """struct(kind, name, extended, implemented, annotations, methods, fields) of a file, whose comments don't count.

    extended and implemented are as written; for an interface, what it extends is both. A method has a name, its body
    (empty without), annotations (name, args) and its place; a field has the declared type and its name.
    """
    columns = [c.split()[0] for c in OUTLINE.split(", ")]
    run = F.pandas_udf(lambda s: pd.DataFrame([_outlined(x) for x in s], columns=columns), OUTLINE)
    return run(strip_comments(source))


def entity_table(annotations: Column | str) -> Column:
    """The last @TableName of a type with a plain name, or null."""
    named = F.filter(_c(annotations), lambda x: (x["name"] == "TableName") & x["args"].rlike(r'^\s*"[^"]+"\s*$'))
    return F.regexp_extract(F.try_element_at(named, F.lit(-1))["args"], r'"([^"]+)"', 1)


def mapper_entity(extended: Column | str) -> Column:
    """Entity of a type that extends BaseMapper<Entity> first, or null."""
    return F.nullif(type_name(F.regexp_extract(F.get(_c(extended), F.lit(0)), r"^(?:\w+\.)*BaseMapper<([^>]+)>$", 1)), F.lit(""))
