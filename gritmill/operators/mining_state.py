"""State of a mining run: allow-lists, epochs, enrichment, rule stores, histories, merging of partial reports, verification."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritmill.functions.guards import GUARDS, guard_names
from gritmill.operators.mining import GATES, may_follow
from gritmill.plans.rules import Rule, find, parse_rules, plan, substitute
from gritmill.plans.tokens import CLOSE, OPEN, lex


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def allowed(batch: DataFrame, hashes: DataFrame | None, key: str = "hash") -> DataFrame:
    """Rows of a batch whose key is listed; all of them without a list. Nulls are never listed."""
    return batch if hashes is None else batch.join(hashes.select(key), key, "left_semi")


def merge_reports(counts: DataFrame, errors: DataFrame, repo: str = "repo", order: str = "part") -> DataFrame:
    """(repo, files, error) of partial reports: file counts are summed, of errors the first part's stays."""
    files = counts.groupBy(repo).agg(F.sum("files").alias("files"))
    first = errors.groupBy(repo).agg(F.min_by("error", order).alias("error"))
    return files.join(first, repo, "full").select(repo, "files", "error")


def hash_index(rules: DataFrame, commit: str = "commit", rule: str = "rule", order: str = "ord") -> DataFrame:
    """(commit, rule): the rule that a commit gave, the last one by order; rules without a commit are left out."""
    return rules.where(F.col(commit).isNotNull()).groupBy(commit).agg(F.max_by(rule, order).alias(rule))


def curated_duplicates(candidates: DataFrame, curated: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Candidates with `duplicate_of`: the reference of the first curated rule (by reference) of the same fingerprint, or null."""
    known = curated.groupBy(fingerprint).agg(F.min("reference").alias("duplicate_of"))
    return candidates.join(known, fingerprint, "left")


def behaviour_fingerprint(before, after, negative) -> Column:
    """SHA-256 of the three examples, with line ends alike and outer white space gone; white space within them counts."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\r\n?", "\n"), r"^\s+|\s+$", "")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", plain(before), plain(after), plain(negative)), 256))


def transition(candidates: DataFrame, moves: DataFrame, key: str = "id") -> DataFrame:
    """Candidates (id, status, transitions) after moves (id, target, actor, reason, at), one a candidate.

    An allowed move sets the status and is appended to the history, a rejection also its reason; `error` marks the others,
    whose candidate stays as it is.
    """
    m = moves.select(key, F.struct(*(F.col(c) for c in ("target", "actor", "reason", "at"))).alias("m"))
    both = candidates.join(m, key, "left")
    ok = F.col("m").isNotNull() & may_follow(F.col("status"), F.col("m.target"))
    entry = F.struct(F.col("m.at").alias("at"), F.col("status").alias("source"), F.col("m.target").alias("target"), F.coalesce(F.col("m.actor"), F.lit("")).alias("actor"), F.coalesce(F.col("m.reason"), F.lit("")).alias("reason"))
    rest = [c for c in candidates.columns if c not in ("status", "transitions", "rejection_reason")]
    before = F.col("rejection_reason") if "rejection_reason" in candidates.columns else F.lit(None).cast("string")
    kind = "array<struct<at:string,source:string,target:string,actor:string,reason:string>>"
    history = F.coalesce(F.col("transitions").cast(kind), F.array().cast(kind))
    return both.select(
        *rest,
        F.when(ok, F.col("m.target")).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.concat(history, F.array(entry.cast(kind.removeprefix("array<")[:-1])))).otherwise(history).alias("transitions"),
        F.when(ok & (F.col("m.target") == "REJECTED"), F.col("m.reason")).otherwise(before).alias("rejection_reason"),
        (F.col("m").isNotNull() & ~ok).alias("error"),
    )


def enrich(evaluations: DataFrame, commits: DataFrame, validations: DataFrame, key: str = "hash") -> DataFrame:
    """Evaluations with their commit's date, and with the validation text of a rule that isn't blank (VALID, or the message)."""
    out = evaluations.join(commits.select(key, "commit_date"), key, "left").join(validations.select(key, F.col("message").alias("_v")), key, "left")
    return out.withColumn("validation", F.when(F.coalesce(F.trim("rule"), F.lit("")) != "", F.coalesce("_v", F.lit("VALID")))).drop("_v")


def register_categories(known: DataFrame, evaluations: DataFrame, order: str) -> DataFrame:
    """All categories: the known ones, and new ones of evaluations (category, is_new) that none equals but for case; the first spelling stays."""
    name = F.trim("category")
    old = known.select(name.alias("category"), F.lit(0).alias("_new"), F.lit(None).cast("string").alias("_at"))
    at = F.col(order).cast("string") if dict(evaluations.dtypes)[order] == "string" else F.lpad(F.col(order).cast("string"), 20, "0")
    new = evaluations.where("is_new").where(F.coalesce(name, F.lit("")) != "").select(name.alias("category"), F.lit(1).alias("_new"), at.alias("_at"))
    return old.unionByName(new).groupBy(F.lower("category").alias("k")).agg(F.min_by("category", F.struct("_new", "_at", "category")).alias("category")).select("category")


def epoch_windows(repos: DataFrame, epochs: list[tuple[str, str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """Repositories (repo, epoch) with the window to walk next: their epoch's, or the whole one if there are no epochs.

    Those that have done all epochs are left out.
    """
    if not epochs:
        return repos.withColumn("start", F.lit(start)).withColumn("end", F.lit(end))
    table = repos.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(epochs)], "epoch int, start string, end string")
    return repos.join(F.broadcast(table), "epoch")


def next_epoch(state: DataFrame, finished: DataFrame) -> DataFrame:
    """State (repo, epoch, last_commit, status) where finished repositories go to the next epoch, without a last commit."""
    out = state.join(finished.select("repo", F.lit(True).alias("_done")), "repo", "left")
    done = F.col("_done").isNotNull()
    return out.select("repo", (F.col("epoch") + done.cast("int")).alias("epoch"), F.when(~done, F.col("last_commit")).alias("last_commit"), F.when(done, "EPOCH_COMPLETE").otherwise(F.col("status")).alias("status"))


# How inferred rule files are marked.
INFERRED, MANUAL, TAG = "inferred:", "manual:", "ai-inferred"


def register_inferred(evaluations: DataFrame, source: str | None, order: str) -> DataFrame:
    """(id, rule, tags, severity, description): rule files of relevant evaluations whose rule can be parsed; the last of an id stays."""

    @F.pandas_udf("boolean")
    def parses(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return bool(parse_rules(t))
            except Exception:
                return False

        return text.map(one)

    label = F.lit(source if source and source.strip() else "unknown")
    good = evaluations.where("relevant").where(F.coalesce(F.trim("rule"), F.lit("")) != "").where(parses("rule"))
    commit = F.when(F.coalesce(F.trim("hash"), F.lit("")) != "", F.col("hash")).otherwise(label)
    rows = good.select(F.concat(F.lit(INFERRED), commit).alias("id"), F.struct(F.col("rule"), F.array(F.lit(TAG), label, commit).alias("tags"), F.lit("INFO").alias("severity"), F.col("summary").alias("description")).alias("x"), F.col(order).alias("_at"))
    return rows.groupBy("id").agg(F.max_by("x", "_at").alias("x")).select("id", "x.*")


def promote(store: DataFrame, ids: DataFrame) -> DataFrame:
    """A rule store (id, ...) where the listed inferred files have become manual ones."""
    out = store.join(ids.select("id", F.lit(True).alias("_go")), "id", "left")
    return out.withColumn("id", F.when(F.col("_go"), F.replace("id", F.lit(INFERRED), F.lit(MANUAL))).otherwise(F.col("id"))).drop("_go")


def save_state(state: DataFrame, path: str) -> None:
    """Writes a new version of the state beside the former one, and then names it the latest: a reader sees either whole."""
    spark = state.sparkSession
    try:
        n = spark.read.json(f"{path}/latest").collect()[0]["n"] + 1
    except Exception:  # nothing saved yet
        n = 0
    state.write.mode("overwrite").json(f"{path}/v{n % 2}")
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").json(f"{path}/latest")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state saved last."""
    n = spark.read.json(f"{path}/latest").collect()[0]["n"]
    return spark.read.schema(schema).json(f"{path}/v{n % 2}")


def _balanced(text: str) -> bool:
    stack = []
    for t, _, _ in lex(text):
        if t in OPEN:
            stack.append(OPEN[t])
        elif t in CLOSE and (not stack or stack.pop() != t):
            return False
    return not stack


def verify(rule: str | None, before: str | None, after: str | None, negative: str | None) -> str | None:
    """The first gate that a candidate fails, or None. Sources are read as balanced tokens; guards are known or not, and count as true."""
    if not all(x and x.strip() for x in (rule, before, after, negative)):
        return GATES[0]
    if rule.lstrip().startswith("<") and not rule.lstrip().startswith("<!") or ";;" not in rule:
        return GATES[1]
    try:
        rules = parse_rules(rule)
    except Exception:
        return GATES[2]
    if len(rules) != 1:
        return GATES[2]
    one: Rule = rules[0]
    called = [x for x in (one.guard, *(a.condition for a in one.alternatives)) if x]
    try:
        if any(name not in GUARDS for x in called for name in [*guard_names(x), *re.findall(r"(?<![\w$\"])([A-Za-z_]\w*)\s*\(", x)]):
            return GATES[3]
    except ValueError:
        return GATES[3]
    if not _balanced(before):
        return GATES[4]
    if not _balanced(after):
        return GATES[5]
    plans = plan([one])
    hits = list(find(before, plans))
    if len(hits) != 1 or not one.alternatives:
        return GATES[6]
    _, _, _, a, z, bindings = hits[0]
    made = before[:a] + substitute(one.alternatives[0].text, bindings) + before[z:]
    if [t for t, _, _ in lex(made)] != [t for t, _, _ in lex(after)]:
        return GATES[7]
    if not _balanced(negative):
        return GATES[8]
    return GATES[9] if any(True for _ in find(negative, plans)) else None


def verified(candidates: DataFrame) -> DataFrame:
    """Candidates (rule, before, after, negative) with `failed`: the first of the ten gates that they don't pass, or null."""

    @F.pandas_udf("string")
    def run(rule: pd.Series, before: pd.Series, after: pd.Series, negative: pd.Series) -> pd.Series:
        return pd.Series([verify(*x) for x in zip(rule, before, after, negative, strict=True)], dtype=object)

    return candidates.withColumn("failed", run("rule", "before", "after", "negative"))

