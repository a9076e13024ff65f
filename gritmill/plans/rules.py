"""Rule files: parsing, and matching of patterns against source by structure.

A rule has a pattern with placeholders, an optional guard, and alternatives with conditions. `$x` binds one expression and
must be equal wherever it stands again; `$xs$` binds a list of arguments, possibly empty; `$x:StringLiteral` checks a
kind. Patterns and sources are token sequences with balanced brackets; matching is structural on these. Rules are small
and travel with the tasks; source rows are matched in Arrow batches, each file once for all rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gritmill.functions.guards import decide, guard_names, parse_guard
from gritmill.plans.context import FOUND, GIVEN, Context
from gritmill.plans.tokens import CLOSE, OPEN, lex

TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/|\$?[A-Za-z_]\w*\$?(?::[A-Za-z]\w*)?|\d[\w.]*|->|::|&&|\|\||[=!<>+\-*/%&|^]=|\+\+|--|\S', re.S)


@dataclass
class Alternative:
    text: str
    condition: str | None = None


@dataclass
class Rule:
    pattern: str
    name: str = ""
    message: str = ""
    guard: str | None = None
    alternatives: list[Alternative] = field(default_factory=list)
    kind: str = "EXPRESSION"
    metadata: dict[str, str] = field(default_factory=dict)


def infer_kind(pattern: str) -> str:
    """The pattern kind that a pattern's text stands for."""
    p = pattern.strip()
    if p.startswith("import "):
        return "IMPORT"
    if p.startswith("@"):
        return "ANNOTATION"
    if p.startswith("{"):
        return "BLOCK"
    if re.match(r"new\b", p) and not p.endswith(";"):
        return "CONSTRUCTOR"
    if re.match(r"(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\b", p):
        return "TYPE_DECLARATION"
    if re.match(r"(?:(?:public|protected|private|static|final)\s+)*[\w$<>\[\]]+\s+[\w$]+\s*\([^()]*\)\s*(?:throws [\w$, ]+)?\s*(?:\{.*\}|;)?$", p, re.S) and not p.startswith(("return", "throw", "new")):
        return "METHOD_DECLARATION"
    statements = [s for s in split_top(p, ";") if s.strip()]
    if p.endswith(";"):
        if len(statements) > 1:
            return "STATEMENT_SEQUENCE"
        if re.match(r"(?:(?:public|protected|private|static)\s+)+", p):
            return "FIELD"
        return "DECLARATION" if re.match(r"(?:final\s+)?[\w$.]+(?:<[^;]*>)?(?:\[\])*\s+[\w$]+\s*(?:=|;)", p) and not re.match(r"(?:return|throw)\b", p) else "STATEMENT"
    return "METHOD_CALL" if re.search(r"[\w$]\s*\([^;]*\)$", p, re.S) else "EXPRESSION"


def split_top(text: str, mark: str) -> list[str]:
    """Parts between marks outside brackets and quotes."""
    parts, depth, at = [], 0, 0
    for m in TOKEN.finditer(text):
        t = m.group()
        depth += t in OPEN
        depth -= t in CLOSE
        if t == mark and depth == 0:
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


def parse_rules(text: str, name: str = "", load=None, _seen: frozenset = frozenset()) -> list[Rule]:
    """The rules of a file. `load` gives the text of an included file by name; includes are added once, in depth-first order."""
    rules: list[Rule] = []
    metadata: dict[str, str] = {}
    loops: dict[str, list[tuple[str, str]]] = {}
    text = re.sub(r"<\?.*?\?>", "", text, flags=re.S)
    text = re.sub(r"/\*.*?\*/|^\s*//[^\n]*", "", text, flags=re.S | re.M)
    for m in re.finditer(r"<!\s*(foreach)?\s*([\w.]+)\s*:\s*(.*?)>(?=[ \t]*\n)", text + "\n", re.S):
        if m[1]:
            loops[m[2]] = [tuple(x.strip() for x in pair.split("->", 1)) for pair in m[3].split(",") if "->" in pair]
        elif m[2] == "include":
            other = m[3].strip()
            if load and other not in _seen:
                rules += parse_rules(load(other) or "", other, load, _seen | {name, other})
        else:
            metadata[m[2]] = m[3].strip()
    body = re.sub(r"<!\s*(?:foreach)?\s*[\w.]+\s*:.*?>(?=[ \t]*\n)", "", text + "\n", flags=re.S)
    for part in re.split(r"^\s*;;\s*$|;;\s*(?=\n|$)", body, flags=re.M):
        lines = [x.strip() for x in part.strip().splitlines() if x.strip()]
        if not lines:
            continue
        rule = Rule("", metadata=dict(metadata))
        head: list[str] = []
        for line in lines:
            if line.startswith("@id"):
                rule.name = re.sub(r"^@id[:\s]*", "", line).strip()
            elif not head and not rule.alternatives and re.match(r'"(?:[^"\\]|\\.)*"\s*:\s*$', line):
                rule.message = line[1 : line.rindex('"')]
            elif line.startswith("=>"):
                out, _, condition = line[2:].strip().partition(" :: ")
                rule.alternatives.append(Alternative(out.strip(), condition.strip() or None))
            elif rule.alternatives:
                rule.alternatives[-1].text += "\n" + line
            else:
                head.append(line)
        pattern, _, guard = "\n".join(head).partition(" :: ")
        rule.pattern, rule.guard = pattern.strip(), guard.strip() or None
        if not rule.pattern:
            continue
        used = next((v for v in loops if f"${{{v}" in "\n".join(lines)), None)
        for a, b in loops.get(used, [("", "")]):
            def put(x, a=a, b=b):
                return x and x.replace(f"${{{used}.key}}", a).replace(f"${{{used}.value}}", b).replace(f"${{{used}}}", a)

            one = Rule(put(rule.pattern), put(rule.name), rule.message, put(rule.guard), [Alternative(put(x.text), put(x.condition)) for x in rule.alternatives], metadata=rule.metadata)
            one.kind = infer_kind(one.pattern)
            rules.append(one)
    for i, r in enumerate(rules):
        r.name = r.name or r.message or f"{name}{i + 1}"
    return rules


def _fits(kind: str, tokens: list[str]) -> bool:
    one = tokens[0] if len(tokens) == 1 else ""
    return {
        "StringLiteral": one.startswith('"'),
        "CharacterLiteral": one.startswith("'"),
        "NumberLiteral": one[:1].isdigit(),
        "BooleanLiteral": one in ("true", "false"),
        "NullLiteral": one == "null",
        "SimpleName": bool(re.fullmatch(r"[A-Za-z_$][\w$]*", one)) and one not in ("true", "false", "null"),
        "MethodInvocation": len(tokens) > 2 and tokens[-1] == ")",
    }.get(kind, True)


def match_at(pattern: list[str], tokens: list[str], at: int, fold: bool = False) -> tuple[int, dict[str, list[str]]] | None:
    """End of the match of a pattern that starts at a token, with its bindings; None if there is none."""
    same = (lambda a, b: a.lower() == b.lower() if a.startswith('"') else a == b) if fold else (lambda a, b: a == b)

    def span(i: int, stop: set[str]) -> list[int]:
        """Ends of a balanced run from i that doesn't cross a stop token at its own depth; the shortest first."""
        ends, depth = [], 0
        while i < len(tokens):
            t = tokens[i]
            if depth == 0 and (t in stop or t in CLOSE):
                break
            depth += t in OPEN
            depth -= t in CLOSE
            i += 1
            if depth == 0:
                ends.append(i)
        return ends

    def go(k: int, i: int, bound: dict[str, list[str]]):
        if k == len(pattern):
            return i, bound
        p = pattern[k]
        if p.startswith("$") and len(p) > 1:
            name, _, kind = p.partition(":")
            if name.endswith("$") and len(name) > 2:
                for end in [i, *span(i, {";"})]:
                    items = _arguments(tokens[i:end])
                    if end > i and (tokens[end - 1] == "," or tokens[i] == ","):
                        continue
                    if kind and not all(_fits(kind, x) for x in items):
                        continue
                    texts = [" ".join(x) for x in items]
                    if bound.get(name, texts) != texts:
                        continue
                    nxt = k + 1
                    # the comma beside an empty list goes with it
                    if not items and nxt < len(pattern) and pattern[nxt] == ",":
                        nxt += 1
                    found = go(nxt, end, bound | {name: texts})
                    if found:
                        return found
                return None
            for end in span(i, {";", ","}):
                text = tokens[i:end]
                if kind and not _fits(kind, text):
                    continue
                if bound.get(name, [" ".join(text)]) != [" ".join(text)]:
                    continue
                found = go(k + 1, end, bound | {name: [" ".join(text)]})
                if found:
                    return found
            return None
        if i < len(tokens) and same(p, tokens[i]):
            return go(k + 1, i + 1, bound)
        # a list placeholder before may have been empty and left its comma
        if p == "," and k + 1 < len(pattern) and re.fullmatch(r"\$\w+\$(?::\w+)?", pattern[k + 1]) and i < len(tokens) and tokens[i] in CLOSE:
            name = pattern[k + 1].partition(":")[0]
            return go(k + 2, i, bound | {name: []}) if bound.get(name, []) == [] else None
        return None

    return go(0, at, {})


def _arguments(tokens: list[str]) -> list[list[str]]:
    out, depth, part = [], 0, []
    for t in tokens:
        if t == "," and depth == 0:
            out.append(part)
            part = []
            continue
        depth += t in OPEN
        depth -= t in CLOSE
        part.append(t)
    return [*out, part] if part else out


def _compact(text: str) -> str:
    """Source text of tokens: blanks only between words."""
    return re.sub(r"(?<=[\w$\"'])\s+(?=[\w$\"'])|\s*(&&|\|\||[=!<>+\-*/%]=|->|=)\s*", lambda m: f" {m[1]} " if m[1] else " ", re.sub(r"\s+(?![\w$\"'=&|<>!+\-*/%])|(?<![\w$\"'=&|<>!+\-*/%,])\s+", "", text)).strip()


def substitute(template: str, bindings: dict[str, list[str]]) -> str:
    """Replaces $x, $xs$, $xs$[i] (negative from the end) and $xs$.length; lists are joined by ", ". Unbound names stay."""

    def put(m: re.Match) -> str:
        items = bindings.get(m[1])
        if items is None:
            return m[0]
        if m[2]:
            i = int(m[2])
            return items[i] if -len(items) <= i < len(items) else m[0]
        return str(len(items)) if m[3] else ", ".join(items)

    return re.sub(r"(\$\w+\$?)(?:\[(-?\d+)\])?(\.length)?", lambda m: put(m) if m[1].endswith("$") else (", ".join(bindings[m[1]]) if m[1] in bindings else m[1]) + (f"[{m[2]}]" if m[2] else "") + (m[3] or ""), template)


_PLACE = "start int, end int, line int, matched string, bindings map<string,array<string>>"
MATCH = f"rule int, rule_name string, kind string, {_PLACE}"
#: Sources whose matches are held at once.
_SOURCES = 1000


#: Guards that read no more than the match itself.
_PLAIN = set("otherwise matchesAny matchesNone hasNoSideEffect referencedIn isLiteral isNullLiteral isStringLiteral isCharsetString isSingleCharacter isRegexp methodNameMatches argsCount".split())


def needs_context(rules: list[Rule]) -> bool:
    """Whether a guard of the rules asks about a match's surroundings."""
    texts = [x for r in rules for x in (r.guard, *(a.condition for a in r.alternatives)) if x]
    return any(name not in _PLAIN for x in texts for name in guard_names(x))


#: Words that begin statements, never expressions.
_NO_START = set("return throw else case assert yield do goto".split())


def _starts(pattern: list[str], tokens: list[str], places: dict[str, list[int]], anchor: int | None) -> list[int] | range:
    """Tokens where a pattern may begin: where its first word stands; where a run begins that ends at the word after its first placeholder."""
    if anchor == 0:
        return places.get(pattern[0], [])
    if anchor is None:
        return range(len(tokens))
    if anchor > 1 or pattern[0].partition(":")[0].endswith("$"):
        return range(len(tokens)) if pattern[anchor] in places else []
    words = pattern[1 : next((k for k in range(1, len(pattern)) if pattern[k].startswith("$")), len(pattern))]
    out: set[int] = set()
    for j in places.get(words[0], []):
        if len(words) > 1 and tokens[j + 1 : j + 2] != words[1:2]:
            continue
        depth, i = 0, j - 1
        while i >= 0:
            depth += (tokens[i] in CLOSE) - (tokens[i] in OPEN)
            if depth < 0 or depth == 0 and tokens[i] in (";", ","):
                break
            if depth == 0:
                out.add(i)
            i -= 1
    return sorted(out)


Plan = tuple[int, str, str, list[str], str]


def plan(rules: list[Rule], token: re.Pattern = TOKEN) -> list[Plan]:
    """(number, name, kind, pattern's tokens, type) of each rule; once more with a simple name where a pattern qualifies a type.

    The type is the one that such a source must import, by name or by its package's star, or have beside it.
    """
    out: list[Plan] = []
    for i, r in enumerate(rules):
        pattern = [m.group() for m in token.finditer(r.pattern.rstrip(";") if r.kind in ("METHOD_CALL", "EXPRESSION") else r.pattern)]
        out.append((i, r.name, r.kind, pattern, ""))
        at = 1 if pattern[:1] == ["new"] else 0
        end = at
        while end + 2 < len(pattern) and re.fullmatch(r"[a-z]\w*", pattern[end]) and pattern[end + 1] == ".":
            end += 2
        if end > at and re.fullmatch(r"[A-Z]\w*", pattern[end]):
            out.append((i, r.name, r.kind, pattern[:at] + pattern[end:], "".join(pattern[at : end + 1])))
    return out


def sees_type(text: str, name: str) -> bool:
    """Whether a source may call a type by its simple name: imported alone or with its package, or of its own package."""
    package = re.escape(name.rpartition(".")[0])
    return bool(re.search(rf"(?m)^\s*(?:import\s+(?:{re.escape(name)}|{package}\.\*)|package\s+{package})\s*;", text))


def find(text: str, plans: list[Plan], fold: bool = False):
    """(rule, name, kind, start, end, bindings) of all matches in one text; rules with the same pattern share their bindings."""
    lexed = lex(text)
    tokens = [t for t, _, _ in lexed]
    places: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        places.setdefault(t, []).append(i)

    def each(pattern: list[str]):
        anchor = next((k for k, t in enumerate(pattern) if not t.startswith("$")), None)
        starts = _starts(pattern, tokens, places, anchor) if not fold else range(len(tokens))
        last = -1
        for at in starts:
            if anchor != 0 and (at <= last or not re.match(r"[\w$\"'(]", tokens[at]) or tokens[at] in _NO_START or at and tokens[at - 1] in (".", "new")):
                continue
            found = match_at(pattern, tokens, at, fold)
            if found and found[0] > at:
                if anchor != 0:
                    last = found[0] - 1
                yield lexed[at][1], lexed[found[0] - 1][2], {k: [_compact(x) for x in v] for k, v in found[1].items()}

    known: dict[tuple[str, ...], list] = {}
    for i, name, kind, pattern, simple in plans:
        if simple and not sees_type(text, simple):
            continue
        words = tuple(pattern)
        if words not in known:
            known[words] = list(each(pattern))
        for start, end, bindings in known[words]:
            yield i, name, kind, start, end, bindings


def matches(df: DataFrame, source: str, rules: list[Rule], keep: tuple[str, ...] = ("file_path",), fold: bool = False, context: bool | None = None) -> DataFrame:
    """All matches of all rules: the kept columns, MATCH, and with context FOUND, which guards about surroundings read.

    Each source is cut into tokens once; rules are tried where their first word stands. Texts that hold none of the rules'
    words never leave the JVM. Rules with the same pattern come back from Python as one row, dealt out on the JVM. Rows are
    dealt anew before Python, as small files of many sources would make one task. Context is found if a rule's guard asks
    for it, or as told.
    """
    plans = plan(rules)
    context = needs_context(rules) if context is None else context
    extra = FOUND if context else {}
    fields = df.select(*keep).schema.fields
    made = T.StructType.fromDDL(", ".join(["rules array<int>", _PLACE, *(f"{k} {v}" for k, v in extra.items())]))
    types = [f.type for f in to_arrow_schema(made)]
    names = [*(f"keep{k}" for k in range(len(fields))), *made.names]

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _SOURCES):
                part = batch.slice(first, _SOURCES)
                of, rows = [], []
                for k, text in enumerate(part.column(len(fields)).to_pylist()):
                    if text is None:
                        continue
                    around, hits = None, {}
                    for i, _, _, start, end, bindings in find(text, plans, fold):
                        hits.setdefault((start, end, id(bindings)), ([], bindings))[0].append(i)
                    for (start, end, _), (numbers, bindings) in hits.items():
                        if context:
                            around = around or Context(text)
                        of.append(k)
                        rows.append((numbers, start, end, text.count("\n", 0, start) + 1, text[start:end], bindings, *(around.around(start, end, bindings) if context else ())))
                values = zip(*rows, strict=True) if rows else ((),) * len(types)
                arrays = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in v], t) for v, t in zip(values, types, strict=True)]
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(fields))), *arrays], names)

    rows = df.select(*keep, F.col(source).alias("_source"))
    wanted = [[t for t in pattern if not t.startswith("$")] for _, _, _, pattern, _ in plans]
    if all(wanted) and not fold:  # a text without all words of any rule has no match
        hit = [reduce(lambda a, b: a & b, (F.contains("_source", F.lit(t)) for t in dict.fromkeys(words))) for words in wanted]
        rows = rows.where(reduce(lambda a, b: a | b, hit))
    spark = df.sparkSession
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kept = T.StructType([T.StructField(f"keep{k}", f.dataType) for k, f in enumerate(fields)])
    found = rows.mapInArrow(run, T.StructType([*kept.fields, *made.fields]))
    told = F.lit([r.name for r in rules]), F.lit([r.kind for r in rules])
    dealt = found.select(*found.columns[: len(fields)], F.explode("rules").alias("rule"), *found.columns[len(fields) + 1 :])
    head = [F.col(f"keep{k}").alias(f.name) for k, f in enumerate(fields)]
    return dealt.select(*head, "rule", F.get(told[0], F.col("rule")).alias("rule_name"), F.get(told[1], F.col("rule")).alias("kind"), *made.names[1:])


def report(found: DataFrame, rules: list[Rule], required: bool = False, suppress: str | None = None) -> DataFrame:
    """Adds outcome (match, unknown), and the replacement of the first alternative whose condition holds; rows that a guard rejects go.

    Guards read columns of `found`; those that it has not are null, so that guards about them are unknown or don't hold.
    `suppress` names the column whose value silences a match where an enclosing declaration's SuppressWarnings holds it
    (such as rule_name); `found` then needs its context. With required bindings an unknown guard keeps the row, without a replacement.
    """
    if suppress:
        if "suppressed" not in found.columns:
            raise ValueError("matches without context don't tell what is suppressed")
        found = found.where(~F.coalesce(F.array_contains("suppressed", F.col(suppress)), F.lit(False)))
    found = found.withColumns({k: F.lit(None).cast(v) for k, v in (FOUND | GIVEN).items() if k not in found.columns})
    outcome: Column | None = None
    chosen: Column | None = None
    for i, r in enumerate(rules):
        here = F.col("rule") == i
        state = decide(parse_guard(r.guard), F.lit(False), required) if r.guard else F.lit("match")
        outcome = F.when(here, state) if outcome is None else outcome.when(here, state)
        picks = [F.when(F.lit(True) if not a.condition else F.coalesce(parse_guard(a.condition), F.lit(False)), F.lit(a.text)) for a in r.alternatives]
        text = F.coalesce(*picks) if picks else F.lit(None).cast("string")
        chosen = F.when(here, text) if chosen is None else chosen.when(here, text)

    @F.pandas_udf("string")
    def fill(template: pd.Series, bindings: pd.Series) -> pd.Series:
        return pd.Series([substitute(t, {k: list(v) for k, v in dict(b).items()}) if isinstance(t, str) else None for t, b in zip(template, bindings, strict=True)], dtype=object)

    out = found.withColumn("outcome", outcome if outcome is not None else F.lit("match")).where("outcome <> 'no_match'")
    out = out.withColumn("template", F.when(F.col("outcome") == "match", chosen if chosen is not None else F.lit(None).cast("string")))
    # templates without a placeholder need no Python
    filled = F.when(F.contains("template", F.lit("$")), fill("template", "bindings")).otherwise(F.col("template"))
    return out.withColumn("replacement", filled).drop("template")


def windows(statements: DataFrame, block: str, order: str, text: str, n: int) -> DataFrame:
    """Every contiguous window of n statements within a block: block, first position, the statements."""
    from pyspark.sql import Window

    w = Window.partitionBy(block).orderBy(order).rowsBetween(0, n - 1)
    out = statements.select(block, F.col(order).alias("first"), F.collect_list(text).over(w).alias("items"))
    return out.where(F.size("items") == n)
