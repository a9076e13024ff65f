"""Scalar functions as Column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions that are never read as text.
BINARY_EXTENSIONS = (".class", ".jar", ".png", ".jpg", ".jpeg", ".gif", ".zip", ".tar", ".gz", ".bz2", ".pdf", ".so", ".dll", ".exe", ".ico", ".war", ".ear")
FQN_PATTERN = r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*)*\.[A-Z]\w*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def camel_split(c) -> Column:
    """Cuts only where a lower-case letter meets an upper-case one."""
    return F.split(_c(c), r"(?<=\p{Ll})(?=\p{Lu})", -1)


def project_name(path) -> Column:
    """The path segment before /src/, else before /tst/, null if there is none."""
    p = _c(path)

    def before(mark: str) -> Column:
        at = F.instr(p, mark)
        return F.when(at > 1, F.substring_index(F.substring(p, F.lit(1), at - 1), "/", -1))

    return F.coalesce(before("/src/"), before("/tst/"))


def simple_class(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(_c(path), "/", -1), -1), r"\.java$", "")


def line_count(text) -> Column:
    """0 for null or empty, else 1 and the number of line feeds (a trailing one counts)."""
    t = _c(text)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.size(F.split(t, "\n", -1)))


def truncate(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def clean_doc(text) -> Column:
    """A documentation comment without its marks, trimmed, at most 2000 characters."""
    return F.substring(F.trim(F.regexp_replace(_c(text), r"/\*\*|\*/|\*", "")), 1, 2000)


def file_type(path, fallback: str = "unknown") -> Column:
    """Lower-case text after the last dot of the whole path, directories included; else the fallback."""
    p = _c(path)
    return F.when(F.contains(p, F.lit(".")), F.lower(F.substring_index(p, ".", -1))).otherwise(fallback)


def is_binary_name(path) -> Column:
    return F.concat(F.lit("."), file_type(path, "")).isin(*BINARY_EXTENSIONS)


def is_binary(data) -> Column:
    """A NUL byte within the first 8192."""
    return F.instr(F.hex(F.substring(_c(data), 1, 8192)).cast("string"), "00") % 2 == 1


def fqns(text) -> Column:
    """All qualified type names in a text."""
    return F.regexp_extract_all(_c(text), F.lit(FQN_PATTERN), 0)


def visibility(public, protected, private, abstract, final) -> Column:
    word = F.when(_c(public), "public").when(_c(protected), "protected").when(_c(private), "private").otherwise("package")
    return F.concat(word, F.when(_c(abstract), " abstract").otherwise(""), F.when(_c(final), " final").otherwise(""))


def method_signature(name, types) -> Column:
    return F.concat(_c(name), F.lit("("), F.array_join(_c(types), ","), F.lit(")"))


def resolve_type(name, imports, package, annotation: bool = False) -> Column:
    """The import that ends in the simple name, else package.simple (an annotation stays simple); type arguments are erased."""
    simple = F.regexp_replace(_c(name), r"<.*$", "")
    found = F.get(F.filter(_c(imports), lambda i: F.substring_index(i, ".", -1) == simple), 0)
    other = simple if annotation else F.when(F.coalesce(_c(package), F.lit("")) != "", F.concat(_c(package), F.lit("."), simple)).otherwise(simple)
    return F.when(F.contains(simple, F.lit(".")), simple).otherwise(F.coalesce(found, other))


def normalise_rule(text) -> Column:
    """Line feeds alone, lines stripped, blank lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(_c(text), "\r\n?", "\n"), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fingerprint(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normalise_rule(text), 256))


def candidate_id(*parts) -> Column:
    """SHA-256 of five fields joined by line feeds; nulls count as empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), "\n"), 256)


def inline(text, n: int = 80) -> Column:
    """First line, backticks as apostrophes, cut to n characters with an ellipsis."""
    first = F.translate(F.substring_index(_c(text), "\n", 1), "`", "'")
    return F.when(F.length(first) > n, F.concat(F.substring(first, 1, n), F.lit("…"))).otherwise(first)


def markdown_cell(text, n: int) -> Column:
    """One line, cut to n characters, the last three of them dots."""
    flat = F.translate(F.translate(_c(text), "\r", ""), "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def suggest_name(type_name, name) -> Column:
    """Type prefix and capitalised name: int[] gives intArray, List<String> gives stringList. Without a type the name stays."""
    t = _c(type_name)
    argument = F.regexp_extract(t, r"<\s*([A-Za-z_]\w*)", 1)
    plain = F.regexp_replace(t, r"<.*>|\[\]|\s", "")
    low = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    prefix = F.when(F.contains(t, F.lit("[]")), F.concat(low(plain), F.lit("Array"))).when(argument != "", F.concat(low(argument), plain)).otherwise(low(plain))
    given = F.coalesce(_c(name), F.lit(""))
    return F.when(F.coalesce(prefix, F.lit("")) == "", _c(name)).otherwise(F.concat(prefix, F.upper(F.substring(given, 1, 1)), F.substring(given, 2, 1 << 20)))


def dsl_error(text) -> Column:
    """Category of a validation message, the first that applies."""
    low = F.lower(_c(text))
    return F.when(F.rlike(low, F.lit("xml|<trigger|<import|syntax|parse")), "DSL_SYNTAX").when(F.rlike(low, F.lit("istype|guard")), "GUARD_WISSEN").otherwise("INVALID_DSL_RULE")


# Scores and severities by nullness and by what the reason tells; the first that applies holds.
NULL_SCORES = (
    ("NON_NULL", "structural child", 1, "INFO"),
    ("NON_NULL", "", 0, "IGNORE"),
    ("NULLABLE", "after usage", 10, "WARNING"),
    ("NULLABLE", "@Nullable", 10, "CLEANUP"),
    ("NULLABLE", "@CheckForNull", 10, "CLEANUP"),
    ("NULLABLE", "Map.get", 8, "CLEANUP"),
    ("NULLABLE", "", 9, "WARNING"),
    ("POTENTIALLY_NULLABLE", "", 5, "QUICKASSIST"),
    ("UNKNOWN", "parameter", 3, "QUICKASSIST"),
    ("UNKNOWN", "field", 5, "QUICKASSIST"),
    ("UNKNOWN", "getter", 4, "QUICKASSIST"),
    ("UNKNOWN", "", 3, "QUICKASSIST"),
)


def null_score(status, reason) -> Column:
    """struct<score, severity> by the decision table."""
    out = None
    for s, word, score, severity in NULL_SCORES:
        hit = (_c(status) == s) & (F.contains(F.coalesce(_c(reason), F.lit("")), F.lit(word)) if word else F.lit(True))
        value = F.struct(F.lit(score).alias("score"), F.lit(severity).alias("severity"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


# The action suggested for each kind of gap.
GAP_ACTIONS = {
    "MISSED_RELEVANT": "Review prompt relevance criteria",
    "WRONG_TRAFFIC_LIGHT": "Calibrate traffic light scoring in prompt examples",
    "MISSING_DSL_RULE": "Add DSL rule examples to mining-examples.md",
    "INVALID_DSL_RULE": "Add negative DSL examples to dsl-explanation.md",
    "CATEGORY_MISMATCH": "Improve category definitions in prompt",
    "MISSING_API_CONTEXT": "Add API migration patterns to eclipse-api-context.md",
    "MISSING_TYPE_CONTEXT": "Add type hierarchy info to eclipse-api-context.md",
    "TYP_KONTEXT": "Add type information to eclipse-api-context.md",
    "API_VERSION": "Add Java version context to eclipse-api-context.md",
    "GUARD_WISSEN": "Add guard examples to dsl-explanation.md",
    "DSL_SYNTAX": "Add negative examples to dsl-explanation.md",
    "GENERALISIERUNG": "Add generalization examples to mining-examples.md",
    "DUPLIKAT_ERKENNUNG": "Improve existing .sandbox-hint descriptions for better matching",
    "KONTEXT_NUTZUNG": "Extend PromptBuilder context sections",
}


def gap_action(category) -> Column:
    return F.create_map(*(F.lit(x) for k, v in GAP_ACTIONS.items() for x in (k, v)))[_c(category)]


def line_at(source, offset) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(_c(source), F.lit(1), _c(offset)), "\n", -1))


def import_diff(before, after) -> Column:
    """struct<added, removed> of two import lists."""
    return F.struct(F.array_except(_c(after), _c(before)).alias("added"), F.array_except(_c(before), _c(after)).alias("removed"))
