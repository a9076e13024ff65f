"""Mining analytics: statistics, comparison of evaluations, candidates' life cycle, rule grouping, batches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gritmill.functions.scalars import dsl_error

# Words of commit messages that are worth a look; those with a regex sign are patterns.
KEYWORDS = ("refactor", "cleanup", "clean up", "modernize", "deprecat", "migrate", "replace", "simplif", "convert", "use.*instead", "switch.*to", "update.*api", "remove.*deprecated", "lambda", "stream", "foreach", "encoding", "charset", "nio", "try-with-resource", "diamond", "var ", "pattern matching", "instanceof", "text block", "record")

# Types whose place in the hierarchy helps to judge a change.
TYPE_CONTEXT = {
    "IResource": "IResource -> IAdaptable; subtypes: IFile, IFolder, IProject, IWorkspaceRoot",
    "ICompilationUnit": "ICompilationUnit -> ITypeRoot -> IJavaElement -> IAdaptable",
    "ASTNode": "ASTNode; subtypes: Expression, Statement, Type, BodyDeclaration, etc.",
    "IStatus": "IStatus; impl: Status, MultiStatus. Factory: Status.error(), Status.warning()",
    "IProgressMonitor": "IProgressMonitor; impl: NullProgressMonitor, SubMonitor",
    "Job": "Job -> InternalJob -> PlatformObject -> IAdaptable",
    "IStructuredSelection": "IStructuredSelection -> ISelection; impl: StructuredSelection",
    "IAction": "IAction; impl: Action -> AbstractAction; subtypes: many",
    "IPreferenceStore": "IPreferenceStore; impl: PreferenceStore, ScopedPreferenceStore",
    "Display": "Display -> Device; Display.getDefault(), Display.syncExec(), Display.asyncExec()",
    "Composite": "Composite -> Scrollable -> Control -> Widget -> IAdaptable",
    "Shell": "Shell -> Decorations -> Canvas -> Composite",
}

# The order of a candidate's states, and the states that may follow any that is not final.
LIFE = ("DISCOVERED", "DSL_VALID", "BEHAVIOR_VALID", "READY_FOR_REVIEW", "APPROVED", "PROMOTED")
ENDS = ("REJECTED", "DUPLICATE", "SUPERSEDED")

# The gates of verification, in order.
GATES = ("SCHEMA", "DSL_VALIDATION", "DSL_PARSE", "GUARD_RESOLUTION", "BEFORE_PARSE", "AFTER_PARSE", "BEFORE_MATCH", "AFTER_REWRITE", "NEGATIVE_PARSE", "NEGATIVE_MATCH")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keyword_pattern(keywords=KEYWORDS) -> str:
    """One pattern: plain words quoted, patterns as they are."""
    return "|".join(k if re.search(r"\.\*|\.\+|[\[(]", k) else rf"\Q{k}\E" for k in keywords)


def relevant_message(message, keywords=KEYWORDS) -> Column:
    """Whether a message holds a keyword, whatever its case; null and blank hold none."""
    return F.coalesce((F.trim(_c(message)) != "") & F.rlike(F.lower(_c(message)), F.lit(keyword_pattern(keywords))), F.lit(False))


def classify(message, diff, least: int, most: int, keywords=KEYWORDS) -> Column:
    """SKIP (no keyword, blank or short diff), DEFER (long diff), else EVALUATE."""
    lines = F.size(F.split(_c(diff), "\n", -1))
    skip = ~relevant_message(message, keywords) | (F.coalesce(F.trim(_c(diff)), F.lit("")) == "") | (lines < least)
    return F.when(skip, "SKIP").when(lines > most, "DEFER").otherwise("EVALUATE")


def learned_limit(df: DataFrame, lines: str, current: int) -> DataFrame:
    """After a truncated batch: four fifths of its longest diff, if that is less than the limit now."""
    return df.agg(F.least(F.lit(current), F.floor(F.max(lines) * 0.8)).cast("long").alias("new_limit"))


def statistics(df: DataFrame, *by: str | Column) -> DataFrame:
    """Counts of evaluations in all, relevant, irrelevant, duplicates and by light; over everything or by keys."""
    light = lambda x: F.count_if(F.col("relevant") & (F.col("light") == x))
    aggs = [F.count("*").alias("total"), F.count_if("relevant").alias("n_relevant"), F.count_if(~F.col("relevant")).alias("n_irrelevant"), F.count_if("duplicate").alias("n_duplicate"), light("GREEN").alias("green"), light("YELLOW").alias("yellow"), light("RED").alias("red")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def reasons(df: DataFrame) -> DataFrame:
    return df.where("not relevant and reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def time_window(df: DataFrame, evaluated: str, committed: str) -> DataFrame:
    """First and last instants; no row if none was evaluated."""
    return df.agg(F.min(evaluated).alias("first_evaluated"), F.max(evaluated).alias("last_evaluated"), F.min(committed).alias("first_commit"), F.max(committed).alias("last_commit")).where("first_evaluated is not null")


def grouped(df: DataFrame, key: str, item: str, drop_null: bool = False) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()) if drop_null else df
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))


def compare(reference: DataFrame, mined: DataFrame) -> DataFrame:
    """Gaps (hash, gap, mined_value, reference_value) of columns hash, relevant, light, rule, validation, category.

    Duplicate hashes of `mined` count once, the last by `ord`; each reference row gives its own gaps. A missing or
    irrelevant one stops there; light, rule and category are each judged otherwise, unless null.
    """
    cols = ["relevant", "light", "rule", "validation", "category"]
    m = mined.groupBy("hash").agg(F.max_by(F.struct(*cols), "ord").alias("m"))
    both = reference.join(m, "hash", "left")

    def gap(when: Column, name, mine, ref) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct((F.lit(name) if isinstance(name, str) else name).alias("gap"), mine.cast("string").alias("mined_value"), ref.cast("string").alias("reference_value")))

    none = F.lit(None).cast("string")
    missing, irrelevant = F.col("m").isNull(), F.col("m").isNotNull() & F.col("relevant") & ~F.col("m.relevant")
    go = F.col("m").isNotNull() & ~irrelevant
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    gaps = F.array_compact(
        F.array(
            gap(missing & F.col("relevant"), "MISSED_RELEVANT", none, F.col("light")),
            gap(irrelevant, "MISSED_RELEVANT", F.lit("irrelevant"), F.lit("relevant")),
            gap(go & (F.col("light") != F.col("m.light")), "WRONG_TRAFFIC_LIGHT", F.col("m.light"), F.col("light")),
            gap(go & has("rule") & ~has("m.rule"), "MISSING_DSL_RULE", none, F.col("rule")),
            gap(go & has("rule") & has("m.rule") & (F.col("m.validation") != "VALID"), dsl_error("m.validation"), F.col("m.validation"), F.col("rule")),
            gap(go & (F.col("category") != F.col("m.category")), "CATEGORY_MISMATCH", F.col("m.category"), F.col("category")),
        )
    )
    return both.select("hash", F.explode(gaps).alias("g")).select("hash", "g.*")


def delta(now: DataFrame, before: DataFrame, *key: str) -> DataFrame:
    """Rows with is_new: whether their key was absent before. Nulls in keys are equal."""
    old = before.select(*(F.col(c).alias(f"_{c}") for c in key), F.lit(True).alias("_seen")).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    return now.join(old, same, "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen", *(f"_{c}" for c in key))


def type_context(text, types: dict[str, str] = TYPE_CONTEXT) -> Column:
    """Descriptions of the known types that a text names, by first occurrence. The dictionary is a literal map."""
    table = F.create_map(*(F.lit(x) for k, v in types.items() for x in (k, v)))
    names = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b(" + "|".join(types) + r")\b"), 1))
    return F.transform(names, lambda n: table[n])


def report_filter(df: DataFrame, least: int, severities: list[str], exclude_non_null: bool) -> DataFrame:
    rows = df.where((F.col("trivial_change") >= least) & F.col("severity").isin(severities))
    return rows.where(F.col("null_status") != "NON_NULL") if exclude_non_null else rows


def rule_usage(rules: DataFrame, uses: DataFrame, key: str = "rule_name", promote: int = 5) -> DataFrame:
    """Uses of each rule and what they advise: none REMOVE, many PROMOTE, else KEEP."""
    counted = uses.groupBy(key).agg(F.count("*").alias("uses"))
    out = rules.select(key).distinct().join(counted, key, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return out.withColumn("advice", F.when(F.col("uses") == 0, "REMOVE").when(F.col("uses") >= promote, "PROMOTE").otherwise("KEEP"))


def normalised_pattern(pattern) -> Column:
    """A pattern with its placeholders renamed by first occurrence, whole names only."""
    names = F.array_distinct(F.regexp_extract_all(_c(pattern), F.lit(r"(\$\w+\$?)"), 1))
    numbered = F.transform(names, lambda n, i: F.struct(n.alias("n"), F.concat(F.lit("#"), i.cast("string"), F.lit("#")).alias("to")))
    return F.aggregate(numbered, _c(pattern), lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"\Q"), x["n"], F.lit(r"\E(?![\w$])")), x["to"]))


def rule_groups(df: DataFrame, pattern: str, confidence: str) -> DataFrame:
    """Rules by normalised pattern: size, and confidence min(1, best + min(0.1, 0.02 * (size - 1)))."""
    rows = df.groupBy(normalised_pattern(pattern).alias("pattern")).agg(F.count("*").alias("size"), F.max(confidence).alias("best"))
    return rows.select("pattern", "size", F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.1), 0.02 * (F.col("size") - 1))).alias("confidence"))


def confidence(identical, modified, inserted, deleted, leaf_only, compatible) -> Column:
    """Confidence of an alignment from its counts."""
    n = _c(identical) + _c(modified) + _c(inserted) + _c(deleted)
    r = _c(identical) / n
    surplus = (_c(inserted) + _c(deleted)) > 0
    loose = F.when(surplus, F.greatest(F.lit(0.1), 0.5 * r)).otherwise(0.3)
    return F.when(n == 0, 0.0).when(~_c(compatible), loose).when(_c(identical) == n, 1.0).when(_c(leaf_only), 0.8 + 0.15 * r).otherwise(0.5 + 0.4 * r)


def may_follow(source, target) -> Column:
    """Whether a candidate may go from one state to another."""
    s, t = _c(source), _c(target)
    steps = reduce(lambda a, b: a | b, ((s == a) & (t == b) for a, b in zip(LIFE, LIFE[1:], strict=False)))
    return F.coalesce(steps | (t.isin(*ENDS) & ~s.isin("PROMOTED", *ENDS)), F.lit(False))


def upsert_revisions(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Merges candidates (id, revision, fingerprint, status): a changed fingerprint takes revision max(previous + 1, new) and
    starts anew, the same keeps the higher revision. `error` tells of a change to a promoted one, which stays as it is."""
    cols = ["revision", "fingerprint", "status"]
    old = stored.select(key, F.struct(*cols).alias("o"))
    fresh = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("revision", "fingerprint")).alias("n"))
    both = old.join(fresh, key, "full")
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    frozen = changed & (F.col("o.status") == "PROMOTED")
    pick = F.when(F.col("o").isNull(), F.col("n")).when(F.col("n").isNull() | frozen, F.col("o"))
    pick = pick.when(changed, F.struct(F.greatest(F.col("o.revision") + 1, F.col("n.revision")).alias("revision"), F.col("n.fingerprint").alias("fingerprint"), F.lit("DISCOVERED").alias("status")))
    pick = pick.otherwise(F.struct(F.greatest("o.revision", "n.revision").alias("revision"), F.col("o.fingerprint").alias("fingerprint"), F.col("o.status").alias("status")))
    return both.select(key, pick.alias("x"), F.coalesce(frozen, F.lit(False)).alias("error")).select(key, "x.*", "error")


def first_failure(*passed: Column, gates=GATES) -> Column:
    """The first gate that fails, null if all pass; a gate without a verdict passes."""
    return F.coalesce(*(F.when(~p, F.lit(g)) for g, p in zip(gates, passed, strict=False)))


def stage_candidates(evaluations: DataFrame, stored: DataFrame) -> DataFrame:
    """Green evaluations with a valid rule whose fingerprint is not stored yet, as DSL_VALID candidates."""
    from gritmill.functions.scalars import fingerprint

    good = evaluations.where("light = 'GREEN' and validation = 'VALID' and trim(rule) <> ''").withColumn("fingerprint", fingerprint("rule"))
    return good.join(stored.select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"]).withColumn("status", F.lit("DSL_VALID"))


def partial_batch(batch: DataFrame, order: str, skipped: str, evaluated: str) -> tuple[DataFrame, DataFrame]:
    """(new anchor: last of the leading run of skipped rows, deferred rows: neither skipped nor evaluated)."""
    first = batch.where(~F.col(skipped)).agg(F.min(order).alias("stop"))
    lead = batch.join(F.broadcast(first)).where(F.col("stop").isNull() | (F.col(order) < F.col("stop")))
    return lead.agg(F.max(order).alias("anchor")), batch.where(~F.col(skipped) & ~F.col(evaluated)).withColumn("reason", F.lit("INCOMPLETE_BATCH"))


def defer(state: DataFrame, more: DataFrame, retries: int = 3) -> DataFrame:
    """Deferred commits (hash, tries) with new tries added; `skipped` marks those beyond the retries."""
    out = state.select("hash", "tries").unionByName(more.select("hash", F.lit(1).alias("tries"))).groupBy("hash").agg(F.sum("tries").alias("tries"))
    return out.withColumn("skipped", F.col("tries") > retries)


def ast_diff(before: dict, after: dict) -> list[str]:
    """Alignment kinds of two trees ({"type", "text", "children"}): equal subtrees are IDENTICAL, children align by place."""
    if before == after:
        return ["IDENTICAL"]
    if before["type"] != after["type"]:
        return ["MODIFIED"]
    a, b = before.get("children", []), after.get("children", [])
    if not a and not b:
        return ["MODIFIED"]
    out = [k for x, y in zip(a, b, strict=False) for k in ast_diff(x, y)]
    return out + ["INSERTED"] * (len(b) - len(a)) + ["DELETED"] * (len(a) - len(b))


def generalise(before: str, after: str, same: list[tuple[str, bool]]) -> tuple[str, str] | None:
    """Placeholders for texts that stay the same and are no literals, at their first occurrence on both sides; None without any alignment."""
    if not same:
        return None
    names: dict[str, str] = {}
    for text, literal in same:
        if literal or text in names:
            continue
        names[text] = f"$v{len(names)}" if names else "$v"
        word = re.compile(rf"(?<![\w$]){re.escape(text)}(?![\w$])")
        before, after = word.sub(lambda m, t=text: names[t], before, count=1), word.sub(lambda m, t=text: names[t], after, count=1)
    return before, after
