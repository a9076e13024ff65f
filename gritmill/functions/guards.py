"""Guards: three-valued predicates over matches. TRUE, FALSE and NULL stand for match, no match and unknown.

SQL's AND, OR and NOT follow the same truth tables, so guard expressions are plain Columns. A guard reads the match's
bindings (map from placeholder to list of texts), the matched node's columns, and its context columns. Guards that would
need type bindings give NULL. `register_guard` adds a guard of one's own: any function that returns a Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

GUARDS: dict[str, Callable[..., Column]] = {}


def register_guard(name: str, f: Callable[..., Column] | None = None):
    """Adds or replaces a guard; usable as a decorator."""
    if f is None:
        return lambda g: register_guard(name, g)
    GUARDS[name] = f
    return f


def _binding(name) -> Column:
    return F.col("bindings")[str(name)]


def _text(name) -> Column:
    return F.get(_binding(name), 0)


def _plain(x) -> str:
    return str(x).strip("\"'")


def _false() -> Column:
    return F.lit(False)


def _literal(name) -> Column:
    """The content of a string literal, null if it is none."""
    t = _text(name)
    return F.when(F.rlike(t, F.lit(r'(?s)^".*"$')), F.regexp_extract(t, r'(?s)^"(.*)"$', 1))


def _bool(c: Column) -> Column:
    return F.coalesce(c, _false())


register_guard("otherwise", lambda: F.lit(True))
register_guard("matchesAny", lambda p=None, *lit: _false() if p is None else _bool(F.size(_binding(p)) > 0) if not lit else _bool(_text(p).isin(*map(_plain, lit)) | _text(p).isin(*map(str, lit))))
register_guard("matchesNone", lambda p=None, *lit: _false() if p is None else ~GUARDS["matchesAny"](p, *lit))
register_guard("hasNoSideEffect", lambda p=None: F.lit(True) if p is None else ~_bool(F.rlike(_text(p), F.lit(r"(?s)^[\w.$]+\s*\(.*\)$"))))


def _version(text: str) -> float:
    found = re.match(r"1\.(\d+)|(\d+)", _plain(text))
    return float(found[1] or found[2]) if found else 0.0


register_guard("sourceVersionGE", lambda v=None: _false() if v is None else _bool(F.col("source_version") >= _version(v)))
register_guard("sourceVersionLE", lambda v=None: _false() if v is None else _bool(F.col("source_version") <= _version(v)))
register_guard("sourceVersionBetween", lambda a=None, z=None: _false() if z is None else _bool(F.col("source_version").between(_version(a), _version(z))))
register_guard("mode", lambda m=None: _false() if m is None else _bool(F.lower(F.col("mode")) == _plain(m).lower()))
register_guard("contains", lambda *a: _false() if not a else _bool(F.contains(F.col("method_text"), F.lit(_plain(a[-1])))))
register_guard("notContains", lambda *a: _false() if not a else ~GUARDS["contains"](*a))
register_guard("referencedIn", lambda v=None, e=None: _false() if e is None else _bool(F.rlike(_text(e), F.concat(F.lit(r"(?<![\w$])\Q"), _text(v), F.lit(r"\E(?![\w$])")))))
register_guard("isLiteral", lambda p=None: _false() if p is None else _bool(F.rlike(_text(p), F.lit(r"""(?s)^(?:".*"|'.*'|-?\d[\w.]*|true|false|null)$"""))))
register_guard("isNullLiteral", lambda p=None: _false() if p is None else _bool(_text(p) == "null"))
register_guard("isStringLiteral", lambda p=None: _false() if p is None else _bool(_literal(p).isNotNull()))
# The standard charset names.
CHARSETS = ("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "ISO-8859-1", "US-ASCII")
register_guard("isCharsetString", lambda p=None: _false() if p is None else _bool(_literal(p).isin(*CHARSETS)))
register_guard("isSingleCharacter", lambda p=None: _false() if p is None else _bool(F.length(_literal(p)) == 1))
register_guard("isRegexp", lambda p=None: _false() if p is None else _bool(F.rlike(_literal(p), F.lit(r"[\\^$.|?*+()\[\]{}]"))))
# Scores of nullness.
NULL_SCORES = {"NON_NULL": 0, "UNKNOWN": 5, "POTENTIALLY_NULLABLE": 7, "NULLABLE": 10}


def _null_status(p) -> Column:
    return F.coalesce(F.col("null_status")[str(p)], F.lit("UNKNOWN"))


def _nullable(p=None, least=None) -> Column:
    if p is None:
        return _false()
    if least is None:
        return _null_status(p) != "NON_NULL"
    return F.create_map(*(F.lit(x) for k, v in NULL_SCORES.items() for x in (k, v)))[_null_status(p)] >= int(_plain(least))


register_guard("isNullable", _nullable)
register_guard("isNonNull", lambda p=None: _false() if p is None else _null_status(p) == "NON_NULL")
for _name in ("Static", "Final", "Public", "Private", "Protected"):
    register_guard(f"is{_name}", lambda p=None, m=_name.lower(): GUARDS["hasModifier"](p, m))
register_guard("hasModifier", lambda p=None, m=None: _false() if m is None else F.array_contains(F.col("modifiers")[str(p)], _plain(m)))
register_guard("hasAnnotation", lambda p=None, a=None: _false() if a is None else F.array_contains(F.col("annotations")[str(p)], _plain(a)))
register_guard("isDeprecated", lambda p=None: _false() if p is None else F.array_contains(F.col("annotations")[str(p)], "Deprecated"))
register_guard("containsAnnotation", lambda a=None: _false() if a is None else _bool(F.exists(F.col("enclosing_annotations"), lambda x: x == _plain(a))))
register_guard("hasSuppressWarnings", lambda k=None: _false() if k is None else _bool(F.array_contains(F.col("suppressed"), _plain(k))))
register_guard("parentMatches", lambda t=None: _false() if t is None else _bool(F.contains(F.col("parent_text"), F.lit(_plain(t)))))
register_guard("inClass", lambda n=None: _false() if n is None else _bool((F.col("class_name") == _plain(n)) | F.endswith(F.col("class_name"), F.lit("." + _plain(n)))))
register_guard("inPackage", lambda n=None: _false() if n is None else _bool(F.col("package_name") == _plain(n)))
register_guard("isInLoop", lambda: _bool(F.arrays_overlap(F.col("ancestors"), F.array(*map(F.lit, ("FOR", "ENHANCED_FOR", "WHILE", "DO"))))))
register_guard("isInConstructor", lambda: _bool(F.array_contains(F.col("ancestors"), "CONSTRUCTOR_DECLARATION")))
register_guard("isInTryWithResourceBlock", lambda: _bool(F.array_contains(F.col("ancestors"), "TRY_RESOURCES")))
register_guard("isPassedToMethod", lambda *a: _bool(F.col("parent_kind") == "METHOD_CALL"))
register_guard("elementKindMatches", lambda p=None, k=None: _false() if k is None else F.col("element_kinds")[str(p)] == _plain(k))
for _name, _kind in (("isParameter", "PARAMETER"), ("isField", "FIELD"), ("isLocalVariable", "LOCAL_VARIABLE")):
    register_guard(_name, lambda p=None, k=_kind: _false() if p is None else F.col("element_kinds")[str(p)] == k)
register_guard("methodNameMatches", lambda p=None, r=None: _false() if r is None else _bool(F.rlike(F.regexp_extract(_text(p), r"([\w$]+)\s*\(", 1), F.lit(f"^(?:{_plain(r)})$"))))
register_guard("paramCount", lambda n=None: _false() if n is None else _bool(F.size(F.col("parameters")) == int(_plain(n))))
register_guard("argsCount", lambda p=None, n=None: _false() if n is None else _bool(F.size(_binding(p)) == int(_plain(n))))
register_guard("hasReturnType", lambda t=None: _false() if t is None else _bool(F.col("return_type") == _plain(t)))
register_guard("throwsException", lambda t=None: _bool(F.size(F.col("thrown")) > 0) if t is None else _bool(F.array_contains(F.col("thrown"), _plain(t))))
register_guard("hasField", lambda n=None: _false() if n is None else _bool(F.array_contains(F.col("fields"), _plain(n))))
register_guard("classOverrides", lambda n=None: _false() if n is None else _bool(F.array_contains(F.col("methods"), _plain(n))))
register_guard("isAssignedToLocalVariable", lambda *a: _bool(F.col("parent_kind") == "LOCAL_VARIABLE"))
register_guard("isResourceVariable", lambda *a: _bool(F.col("parent_kind") == "TRY_RESOURCES"))


def _supertypes(name: str) -> Column:
    return F.array_contains(F.col("supertypes"), _plain(name))


register_guard("enclosingClassExtends", lambda t=None: _false() if t is None else _supertypes(t))
register_guard("inSerializableClass", lambda: _supertypes("Serializable"))
# These ask for a type binding, which source alone doesn't give: unknown, unless the frame tells types by placeholder.
register_guard("instanceof", lambda p=None, t=None: _false() if t is None else F.array_contains(F.col("types")[str(p)], _plain(t)))
register_guard("subtypeOf", GUARDS["instanceof"])
register_guard("genericTypeIs", lambda p=None, i=None, t=None: F.lit(None).cast("boolean"))
register_guard("isAutoCloseable", lambda p=None: _false() if p is None else F.array_contains(F.col("types")[str(p)], "AutoCloseable"))
# Roles, values and relations that a plan of a wider rewrite gave to nodes.
register_guard("plannedRole", lambda r=None: _false() if r is None else _bool(F.col("planned_role") == _plain(r)))
register_guard("enclosingPlannedRole", lambda r=None: _false() if r is None else _bool(F.array_contains(F.col("enclosing_roles"), _plain(r))))
register_guard("plannedValue", lambda k=None, v=None: _false() if v is None else _bool(F.col("planned_values")[_plain(k)] == _plain(v)))
register_guard("enclosingPlannedValue", lambda k=None, v=None: _false() if v is None else _bool(F.col("enclosing_values")[_plain(k)] == _plain(v)))
register_guard("plannedNodeValue", lambda p=None, k=None, v=None: _false() if v is None else _bool(F.col("planned_values")[_plain(k)] == _plain(v)))
register_guard("plannedListContains", lambda k=None, v=None: _false() if v is None else _bool(F.array_contains(F.split(F.col("planned_values")[_plain(k)], ","), _plain(v))))
register_guard("plannedRelation", lambda k=None: _false() if k is None else _bool(F.exists(F.col("relations"), lambda x: x["kind"] == _plain(k))))
register_guard("plannedRelationValue", lambda k=None, v=None: _false() if v is None else _bool(F.exists(F.col("relations"), lambda x: (x["kind"] == _plain(k)) & (x["value"] == _plain(v)))))
register_guard("plannedOutgoingRelation", lambda k=None: _false() if k is None else _bool(F.exists(F.col("relations"), lambda x: (x["kind"] == _plain(k)) & x["outgoing"])))
register_guard("plannedIncomingRelation", lambda k=None: _false() if k is None else _bool(F.exists(F.col("relations"), lambda x: (x["kind"] == _plain(k)) & ~x["outgoing"])))
register_guard("plannedRelationCount", lambda k=None, n=None: _false() if n is None else _bool(F.size(F.filter(F.col("relations"), lambda x: x["kind"] == _plain(k))) == int(_plain(n))))

_TOKEN = re.compile(r"\s*(?:(&&|\|\||[!(),])|(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s&|!(),\"']+))")


def _tokens(text: str) -> list[str]:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"guard: unexpected text at {at}: {text}")
        tokens.append(m[1] or m[2])
        at = m.end()
    return tokens


def guard_names(text: str) -> list[str]:
    """Names of the guards that an expression calls."""
    tokens = [*_tokens(text), ""]
    return [t if not t.startswith("$") else "instanceof" for i, t in enumerate(tokens) if t in GUARDS and t != "instanceof" or tokens[i + 1 : i + 2] == ["instanceof"]]


def parse_guard(text: str) -> Column:
    """A Column for a guard expression: calls joined by && or `,` (and), || (or), ! (not) and parentheses. Raises ValueError."""
    tokens = [*_tokens(text), ""]
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        got = tokens[pos]
        if not got or want and got != want:
            raise ValueError(f"guard: expected {want or 'a name'}, found {got or 'the end'}: {text}")
        pos += 1
        return got

    def either() -> Column:
        left = both()
        while tokens[pos] == "||":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = single()
        while tokens[pos] in ("&&", ","):
            take()
            left = left & single()
        return left

    def single() -> Column:
        if tokens[pos] == "!":
            take()
            return ~single()
        if tokens[pos] == "(":
            take()
            inner = either()
            take(")")
            return inner
        name, args = take(), []
        if tokens[pos] == "(":
            take()
            while tokens[pos] != ")":
                args.append(take())
                if tokens[pos] == ",":
                    take()
            take(")")
        if name.startswith("$") and tokens[pos] == "instanceof":
            take()
            return GUARDS["instanceof"](name, take())
        if name not in GUARDS:
            raise ValueError(f"guard: no guard named {name}")
        return GUARDS[name](*args)

    out = either()
    if tokens[pos]:
        raise ValueError(f"guard: unexpected {tokens[pos]}: {text}")
    return out


def decide(guard: Column, compatibility: Column, required: bool) -> Column:
    """match, no_match or unknown. Where bindings are not required, unknown falls back to the compatibility value."""
    value = guard if required else F.coalesce(guard, compatibility)
    return F.when(value, "match").when(~value, "no_match").otherwise("unknown")
