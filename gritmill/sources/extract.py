"""Extractors: one text in, one struct out. All but the Java ones are built-in functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gritmill.functions.scalars import clean_doc, fqns, line_count, project_name, simple_class

EXTRACTED = "package_name string, declared_types array<string>, fully_qualified_names array<string>, declared_methods array<string>, declared_fields array<string>, extends_types array<string>, implements_types array<string>, import_statements array<string>, annotations array<string>, type_kind string, visibility string, type_documentation string, method_signatures array<string>, referenced_types array<string>, string_literals array<string>, has_main_method boolean"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _all(text, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(pattern), group))


def strategy(path) -> Column:
    """Which extractor takes a file: by exact name, then extension, else text; all in lower case."""
    name = F.lower(F.element_at(F.split(_c(path), "/", -1), -1))
    extension = F.substring_index(name, ".", -1)
    by_name = F.when(name == "pom.xml", "pom").when(name.isin("plugin.xml", "fragment.xml"), "pluginxml").when(name == "manifest.mf", "manifest")
    return by_name.when(extension == "java", "java").when(extension.isin("xml", "exsd", "xsd", "xhtml", "html"), "xml").when(extension == "properties", "properties").otherwise("text")


def pom(text) -> Column:
    """struct<fqns, types, fields>: group:artifact ids, artifact ids, modules; in order of first sight."""
    groups, artifacts = _all(text, r"<groupId>\s*([^<]+?)\s*</groupId>"), _all(text, r"<artifactId>\s*([^<]+?)\s*</artifactId>")
    return F.struct(F.array_distinct(F.concat(groups, artifacts)).alias("fqns"), artifacts.alias("types"), _all(text, r"<module>\s*([^<]+?)\s*</module>").alias("fields"))


def xml(text) -> Column:
    """struct<fqns, types>: namespaces and element names."""
    return F.struct(_all(text, r"""xmlns(?::\w+)?\s*=\s*["']([^"']+)["']""").alias("fqns"), _all(text, r"<([A-Za-z][\w:.-]*)").alias("types"))


def plugin_xml(text) -> Column:
    return F.struct(_all(text, r"""\bpoint\s*=\s*["']([^"']+)["']""").alias("fqns"), _all(text, r"""\bclass\s*=\s*["']([^"']+)["']""").alias("types"))


def manifest(text) -> Column:
    """struct<bundle, exports, imports, requires>: directives are stripped, continued lines joined."""
    flat = F.regexp_replace(_c(text), r"\r?\n ", "")

    def header(name: str) -> Column:
        value = F.regexp_extract(flat, rf"(?m)^{name}:\s*(.*)$", 1)
        names = F.transform(F.split(F.regexp_replace(value, r'"[^"]*"', ""), ","), lambda x: F.trim(F.substring_index(x, ";", 1)))
        return F.filter(names, lambda x: x != "")

    bundle = F.trim(F.substring_index(F.regexp_extract(flat, r"(?m)^Bundle-SymbolicName:\s*(.*)$", 1), ";", 1))
    return F.struct(bundle.alias("bundle"), header("Export-Package").alias("exports"), header("Import-Package").alias("imports"), header("Require-Bundle").alias("requires"))


def properties(text) -> Column:
    """struct<fields, fqns>: keys, and type names in values."""
    lines = F.filter(F.split(_c(text), r"\r?\n"), lambda x: ~F.rlike(F.trim(x), F.lit("^[#!]")) & F.rlike(x, F.lit("[=:]")))
    keys = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^([^=:]+)[=:]", 1)))
    values = F.array_join(F.transform(lines, lambda x: F.regexp_extract(x, r"^[^=:]+[=:](.*)$", 1)), "\n")
    return F.struct(F.array_distinct(keys).alias("fields"), F.array_distinct(fqns(values)).alias("fqns"))


def plain_text(text) -> Column:
    return F.struct(F.array_distinct(fqns(text)).alias("fqns"))


_KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield".split())
_JAVA = re.compile(r'(?P<COMMENT>/\*.*?\*/|//[^\n]*)|(?P<STRING>"""(?:.*?)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<ANNOTATION>@[A-Za-z_][\w.]*)|(?P<NUMBER>\d[\w.]*)|(?P<IDENTIFIER>[A-Za-z_$][\w$]*)|(?P<OPERATOR>[^\s\w])', re.S)


def scan_java(text: str) -> list[tuple[str, str, int]]:
    """(type, text, start) of each token; quotes are stripped, what is no token is skipped."""
    out = []
    for m in _JAVA.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "IDENTIFIER" and value in _KEYWORDS:
            kind = "KEYWORD"
        out.append((kind, value.strip("\"'") if kind == "STRING" else value, m.start()))
    return out


def search_tokens(text: str, comments: bool = False) -> list[str]:
    """Lower-case search tokens: no operators, comments only if asked for; identifiers also by camel-case part."""
    out = []
    for kind, value, _ in scan_java(text):
        if kind == "OPERATOR" or kind == "COMMENT" and not comments:
            continue
        value = value.lstrip("@")
        parts = re.split(r"(?<=[^\W\d_A-Z])(?=[A-Z])", value) if kind == "IDENTIFIER" else []
        out += [x.lower() for x in ([value, *parts] if len(parts) > 1 else [value])]
    return out


def extract_java(text: str) -> dict:
    """The EXTRACTED fields of one compilation unit, from its tokens. Types are resolved by imports, else by package."""
    tokens = scan_java(text)
    code = [(k, v, s) for k, v, s in tokens if k != "COMMENT"]
    plain = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    bare = re.sub(r'"(?:[^"\\\n]|\\.)*"', '""', plain)
    package = (re.search(r"\bpackage\s+([\w.]+)\s*;", bare) or [None, ""])[1]
    imports = re.findall(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", bare)
    known = {i.rsplit(".", 1)[-1]: i for i in imports}

    def resolve(name: str, annotation: bool = False) -> str:
        name = re.sub(r"<.*", "", name).strip()
        return name if "." in name else known.get(name) or (name if annotation or not package else f"{package}.{name}")

    head = re.compile(r"((?:(?:public|protected|private|abstract|final|static|sealed)\s+)*)(class|interface|enum|record|@interface)\s+(\w+)(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?:extends\s+([\w.<>, ]+?))?\s*(?:implements\s+([\w.<>, ]+?))?\s*\{")
    types = list(head.finditer(bare))
    first = types[0] if types else None
    split = lambda x: [resolve(t) for t in re.split(r",(?![^<]*>)", x or "") if t.strip()]
    kind = {"@interface": "annotation"}.get(first[2], first[2]) if first else None
    modifiers = first[1].split() if first else []
    shown = next((m for m in ("public", "protected", "private") if m in modifiers), "package") + "".join(f" {m}" for m in ("abstract", "final") if m in modifiers)
    method = re.compile(r"(?:^|[;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>]+>\s*)?([\w.<>\[\], ?]+?)\s+(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\s*[{;]", re.M)
    methods = [m for m in method.finditer(bare) if m[2].split()[-1] not in ("return", "new", "throw", "else") and m[3] not in _KEYWORDS]
    names = lambda p: [re.sub(r"\s*\w+\s*$", "", re.sub(r"@\w+\s*|final\s+", "", a)).strip() for a in re.split(r",(?![^<]*>)", p) if a.strip()]
    field = re.compile(r"(?:^|[;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:public|protected|private|static|final|volatile|transient)\s+)+)([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=[^;]*)?;", re.M)
    doc = re.search(r"/\*\*(.*?)\*/\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record|@interface)\s", text, re.S)
    literals = [v for k, v, _ in code if k == "STRING" and len(v) > 3]
    refs = sorted({resolve(v) for k, v, _ in code if k == "IDENTIFIER" and v[:1].isupper() and v not in {t[3] for t in types}})
    return {
        "package_name": package,
        "declared_types": [t[3] for t in types],
        "fully_qualified_names": [f"{package}.{t[3]}" if package else t[3] for t in types],
        "declared_methods": [m[3] for m in methods],
        "declared_fields": [m[3] for m in field.finditer(bare)],
        "extends_types": [x for t in types for x in split(t[4])],
        "implements_types": [x for t in types for x in split(t[5])],
        "import_statements": imports,
        "annotations": list(dict.fromkeys(resolve(v[1:], True) for k, v, _ in code if k == "ANNOTATION" and v != "@interface")),
        "type_kind": kind,
        "visibility": shown if first else None,
        "type_documentation": re.sub(r"\s*\*\s?", " ", doc[1]).strip()[:2000] if doc else None,
        "method_signatures": [f"{m[3]}({','.join(names(m[4]))})" for m in methods],
        "referenced_types": refs,
        "string_literals": literals,
        "has_main_method": any(m[3] == "main" and "static" in m[1] and names(m[4]) in (["String[]"], ["String..."]) for m in methods),
    }


def java(text) -> Column:
    """struct of EXTRACTED, in Arrow batches."""

    @F.pandas_udf(EXTRACTED)
    def run(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_java(t or "") for t in source], columns=[x.split()[0] for x in EXTRACTED.split(", ")])

    return run(text)


def java_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, type, token, start) of every token."""

    @F.pandas_udf("array<struct<type:string,token:string,start:int>>")
    def run(source: pd.Series) -> pd.Series:
        return source.map(lambda t: [{"type": k, "token": v, "start": s} for k, v, s in scan_java(t or "")])

    return df.select(key, F.posexplode(run(text)).alias("position", "t")).select(key, "position", "t.*")


def index_java(files: DataFrame, repository: str, commit: str) -> DataFrame:
    """Index rows of files (path, text) in the order of the filters: binary names, size, repeated content, extraction."""
    from gritmill.functions.scalars import is_binary_name

    rows = files.where(~is_binary_name("path")).where(F.octet_length("text") <= 1 << 20).withColumn("blob_object_id", F.sha1("text"))
    rows = rows.dropDuplicates(["blob_object_id"]).withColumn("x", java("text"))
    return rows.select(
        F.lit(repository).alias("repository_name"), "blob_object_id", F.lit(commit).alias("commit_object_id"), F.lit("java").alias("file_type"), F.col("path").alias("file_path"), "x.*",
        F.substring("text", 1, 65535).alias("source_snippet"), project_name("path").alias("project_name"), simple_class("path").alias("simple_class_name"), line_count("text").alias("line_count"),
    ).withColumn("type_documentation", clean_doc("type_documentation"))
