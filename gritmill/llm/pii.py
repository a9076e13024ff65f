"""Personal data by weak supervision, on DataFrame functions alone.

Base finds come from patterns and checks. Looser patterns give candidates; labelers (the strict pattern, a validity check,
a gazetteer, the words before) vote 1, 0 or -1 (abstain) on each. Votes are counted by kind and pattern of votes, at most
a few hundred rows however large the corpus; from those counts expectation-maximisation estimates the labelers'
reliabilities (Dawid and Skene, 1979), and its posteriors train a logistic span classifier, whose weights go back into
the plan as literals. Candidates it accepts are added where they overlap no base find.

Patterns run in Java's engine. Where the given pattern has a repeated group, which that engine matches by recursion, one
separator is first replaced, character for character, so that a character class does instead; offsets stay the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gritmill.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
_MARK, _FREE = "\x01", "\x02"
_LEFT = 40

# Cue words by kind, and gazetteers.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "addr", "from", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone"),
}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "us")
CARD_STARTS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRY_CODES = r"^\+(?:1|7|20|2[78]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _prepared(text: Column) -> Column:
    return F.translate(text, _MARK, _FREE)


_GROUP = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for all its uses in lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, step, zero: int) -> Column:
    """Of an array of ints: step over all elements up to each one (a running sum, or maximum).

    Groups of _GROUP elements first, then within each; a fold over all would copy an array that grows with every element.
    """

    def each(v):
        groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / _GROUP).cast("int") - 1, F.lit(0)))
        part = lambda g: F.slice(v, g * _GROUP + 1, F.lit(_GROUP))
        whole = F.transform(groups, lambda g: F.aggregate(part(g), F.lit(zero), step))
        before = F.aggregate(whole, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        within = lambda g, first: F.slice(F.aggregate(part(g), F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))), 2, _GROUP)
        return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), F.slice(before, F.lit(1), F.size(groups)).alias("b")), lambda x: within(x["g"], x["b"])))

    return _let(values, each)


def _finds(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start, end, found, before>> of the leftmost non-overlapping matches; offsets in code points, end exclusive.

    The pieces between matches come from split(); running sums of their lengths give the offsets.
    """
    kind = "array<struct<start:int,end:int,found:string,before:string>>"
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())

    def placed(found):
        ends = _running(F.transform(found, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, x: a + x, 0)
        one = lambda x, z: F.struct((z - F.length(x["m"])).alias("start"), z.alias("end"), x["m"].alias("found"), F.right(x["p"], F.lit(_LEFT)).alias("before"))
        return F.zip_with(found, ends, one).cast(kind)

    return F.coalesce(F.when(when, _let(pairs, lambda found: F.when(F.size(found) > 0, placed(found)))), F.array().cast(kind))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.zip_with(each, F.sequence(F.lit(0), F.size(each) - 1), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i"))),
        F.lit(0),
        lambda s, x: s + F.when(x["i"] % 2 == 0, x["d"]).otherwise(F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])),
    )
    return total % 10 == 0


def _small(part: Column) -> Column:
    """Whether a run of digits is a number of at most 255."""
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(F.lit(False))


def _good_ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), _small)


def _good_card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


def _good_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(10, 15)


# What each kind's strict and loose patterns are; the loose one runs only where the strict one's finds are masked by overlap.
_STRICT = {
    "email": rf"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x01]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?: ?(?:\[at\]|\(at\)|\{at\}|<at>) ?| at )"
_DOT = r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]|\(\.\)) ?| dot )"
_LOOSE = {
    # spelled-out signs
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}+){{1,4}}",
    # defanged or spaced dots
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\[\.\] ?| ?\(\.\) ?| ?\[dot\] ?| \. )[0-9]{1,3}){3}(?![0-9.])",
    # national forms, and 00 for the plus sign
    "phone": r"(?<![0-9+.-])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ ./-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}[ ./-][0-9]{1,4}(?:[ ./-][0-9]{2,4}){2,4})(?![0-9])(?![.-][0-9])",
    # four groups of four whatever their check digit, and groups parted by dots or slashes
    "card": r"(?<![0-9.-])[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])(?![.-][0-9])",
}


def base_finds(text: str) -> dict[str, Column]:
    """Base finds by kind, from a text column without nulls."""
    plain = F.col(text)
    marked = _prepared(plain)
    dotted = F.regexp_replace(marked, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    joined = F.regexp_replace(marked, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    has_email, has_card = F.instr(plain, "@") > 0, F.rlike(plain, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}"))
    ip = _finds(plain, _STRICT["ip"], F.rlike(plain, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")))
    return {
        "email": _finds(dotted, _STRICT["email"], has_email),
        "ip": F.filter(ip, lambda x: _good_ip(x["found"])),
        "card": F.filter(_finds(joined, _STRICT["card"], has_card), lambda x: _good_card(x["found"])),
        "phone": F.filter(_finds(plain, _STRICT["phone"], F.rlike(plain, F.lit(r"\+[0-9]"))), lambda x: _good_phone(x["found"])),
    }


def loose_finds(text: str) -> dict[str, Column]:
    plain = F.col(text)
    gate = {
        "email": F.rlike(plain, F.lit(r"(?i)[\[({<]at[\])}>]| at [a-z0-9-]{1,63}(?: dot |\.[a-z])|[\[({](?:dot|\.)[\])}]")),
        "ip": F.rlike(plain, F.lit(r"(?i)[0-9](?: ?\[\.\]| ?\(\.\)| ?\[dot\]| \. ?[0-9])")),
        "phone": F.rlike(plain, F.lit(r"[0-9]{3}[ .-][0-9]{4}|(?<![0-9])00[1-9][0-9]{0,2}[ ./-]")),
        "card": F.rlike(plain, F.lit(r"[0-9]{4}[ ./-]?[0-9]{4}[ ./-]?[0-9]{4}")),
    }
    return {k: _finds(plain, f"(?i){p}", gate[k]) for k, p in _LOOSE.items()}


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (out.when(F.coalesce(no, F.lit(False)), 0) if no is not None else out).otherwise(-1)


def votes(kind: str, found: Column, before: Column, strict: bool) -> list[Column]:
    """1, 0 or -1 (abstain) of the pattern, validity, gazetteer and context labelers."""
    digits, cue = _digits(found), "(?i)(?:" + "|".join(CUES[kind]) + r")\W{0,12}(?:\w+\W+){0,2}$"
    context = _vote(F.rlike(before, F.lit(cue)), F.rlike(before, F.lit(r"(?i)(?:version|order|item|page|isbn|vol)\W{0,4}$")))
    if kind == "email":
        last = F.lower(F.regexp_extract(F.regexp_replace(found, _MARK, "."), r"([A-Za-z0-9-]+)$", 1))
        valid, listed = F.rlike(last, F.lit("^[a-z]{2,}$")), last.isin(*TOP_DOMAINS)
    elif kind == "ip":
        valid, listed = ~F.rlike(found, F.lit(r"(?:^|\.)0[0-9]")), ~F.rlike(found, F.lit(r"^(?:0|127|10|255)\."))
    elif kind == "card":
        valid, listed = F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False), F.rlike(digits, F.lit(CARD_STARTS))
    else:
        valid, listed = F.length(digits).between(10, 15), F.rlike(found, F.lit(COUNTRY_CODES)) | F.rlike(found, F.lit(r"^\(?[2-9][0-9]{2}"))
    return [F.lit(1 if strict else 0), _vote(valid, ~valid), _vote(listed, ~listed), context]


def _signed(found: Column, kind: str, strict: bool) -> Column:
    """Finds with their votes as one string, such as "1,1,0,-1"."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.concat_ws(",", *(v.cast("string") for v in votes(kind, x["found"], x["before"], strict))).alias("votes")))


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds pii_base and pii_more: arrays of start, end, kind, votes. A more-find that meets a base find of its kind is left out."""
    clean = docs.withColumn("pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base, more = base_finds("pii_text"), loose_finds("pii_text")
    out = clean.withColumn("pii_base", F.concat(*(_signed(base[k], k, True) for k in KINDS)))
    out = out.withColumn("pii_more", F.concat(*(_signed(more[k], k, False) for k in KINDS if k in more)))
    return out.withColumn("pii_more", F.when(F.size("pii_more") > 0, _apart(F.col("pii_more"), F.col("pii_base"))).otherwise(F.col("pii_more"))).drop("pii_text")


def _apart(more: Column, base: Column) -> Column:
    """More-finds that meet no base find: in order of starts, none before ends later, and none after starts earlier than they end."""
    far = (1 << 31) - 1
    item = lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("more"), x["kind"].alias("kind"), x["votes"].alias("votes"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: item(x, 0)), F.transform(more, lambda x: item(x, 1))))

    def keep(rows):
        ends = _running(F.transform(rows, lambda x: F.when(x["more"] == 0, x["end"]).otherwise(-1)), lambda a, x: F.greatest(a, x), -1)
        starts = F.reverse(_running(F.reverse(F.transform(rows, lambda x: F.when(x["more"] == 0, x["start"]).otherwise(far))), lambda a, x: F.least(a, x), far))
        zipped = F.zip_with(rows, F.arrays_zip(ends.alias("z"), starts.alias("a")), lambda x, y: F.struct(x.alias("x"), y["z"].alias("z"), y["a"].alias("a")))
        free = F.filter(zipped, lambda y: (y["x"]["more"] == 1) & (y["z"] <= y["x"]["start"]) & (y["a"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["kind"].alias("kind"), y["x"]["votes"].alias("votes")))

    return _let(every, keep)


def estimate(counts: dict[tuple[str, str], int], rounds: int = 50) -> tuple[dict, dict]:
    """EM over counted votes: reliabilities {(kind, labeler, vote): (P(vote|not), P(vote|is))} and posteriors {(kind, votes): P(is)}.

    Smoothed so that a labeler starts better than chance and no probability is 0 or 1.
    """
    post = {k: sum(v == "1" for v in k[1].split(",")) / max(1, sum(v != "-1" for v in k[1].split(","))) * 0.8 + 0.1 for k in counts}
    rates: dict = {}
    for _ in range(rounds):
        prior, total, mass = {}, {}, {}
        for (kind, signs), n in counts.items():
            p = post[kind, signs]
            yes, no = prior.get(kind, (1.0, 1.0))
            prior[kind] = yes + n * p, no + n * (1 - p)
            for i, v in enumerate(signs.split(",")):
                a, b = mass.get((kind, i, v), (0.5, 0.5) if v == "-1" else (0.1, 0.4) if v == "1" else (0.4, 0.1))
                mass[kind, i, v] = a + n * (1 - p), b + n * p
        for kind, i, v in mass:
            a, b = total.get((kind, i), (0.0, 0.0))
            total[kind, i] = a + mass[kind, i, v][0], b + mass[kind, i, v][1]
        rates = {(k, i, v): (m[0] / total[k, i][0], m[1] / total[k, i][1]) for (k, i, v), m in mass.items()}
        new = {}
        for kind, signs in counts:
            odds = math.log(prior[kind][0] / prior[kind][1])
            for i, v in enumerate(signs.split(",")):
                a, b = rates[kind, i, v]
                odds += math.log(b / a)
            new[kind, signs] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[k] - post[k]) for k in new), default=0)
        post = new
        if moved < 1e-6:
            break
    return rates, post


def train(counts: dict[tuple[str, str], int], post: dict, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier on "kind" and "kind|labeler=vote" features, from the posteriors."""
    w: dict[str, float] = {}
    total = sum(counts.values()) or 1

    def features(kind: str, signs: str) -> list[str]:
        return [kind, *(f"{kind}|{i}={v}" for i, v in enumerate(signs.split(",")) if v != "-1")]

    for _ in range(rounds):
        step: dict[str, float] = {}
        by_kind: dict[str, int] = {}
        for (kind, _), n in counts.items():
            by_kind[kind] = by_kind.get(kind, 0) + n
        for (kind, signs), n in counts.items():
            f = features(kind, signs)
            p = 1 / (1 + math.exp(-sum(w.get(x, 0.0) for x in f)))
            for x in f:
                step[x] = step.get(x, 0.0) + n * (p - post[kind, signs]) / by_kind[kind]
        for x, g in step.items():
            w[x] = w.get(x, 0.0) - rate * (g + penalty * w.get(x, 0.0))
    return w if total else {}


def fit(found: DataFrame) -> dict[str, float]:
    """Classifier weights from a frame with pii_base and pii_more. Only counts by kind and votes reach the driver (at most 4 * 2 * 3^3 rows)."""
    each = found.select(F.explode(F.concat("pii_base", "pii_more")).alias("x")).groupBy("x.kind", "x.votes").count().collect()
    counts = {(r["kind"], r["votes"]): r["count"] for r in sorted(each, key=lambda r: (r["kind"], r["votes"]))}
    return train(counts, estimate(counts)[1])


def accepted(found: DataFrame, weights: dict[str, float], at: float = 0.5) -> Column:
    """All spans, base ones and accepted ones, by start and then kind."""
    table = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v)))) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def score(x):
        signs = F.split(x["votes"], ",")
        return F.coalesce(table[x["kind"]], F.lit(0.0)) + sum((F.coalesce(table[F.concat(x["kind"], F.lit(f"|{i}="), signs[i])], F.lit(0.0)) for i in range(4)), F.lit(0.0))

    good = F.filter("pii_more", lambda x: score(x) > math.log(at / (1 - at)))
    return in_order(F.concat(F.col("pii_base"), good))


def in_order(spans: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base finds), base_sha256, spans, n_spans.

    Null and empty texts have no finds (base_sha256 of nothing, spans ""). Repeated rows and null doc_ids give a row each;
    other columns are not read; an empty table gives no rows. Time grows with a text's length and number of finds, so a
    very long text is one long row of one task.
    """
    rows = extract(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    found = scratch.save(rows, "pii")
    every = accepted(found, fit(found))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(in_order(F.col("pii_base"))), 256).alias("base_sha256"), written(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The same columns, with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    found = scratch.save(extract(docs, text_col), "pii")
    spans = accepted(found, fit(found))

    def merge(rows):
        # a span that starts where none before reaches begins a new one, which ends where the furthest up to the next such span does
        upto = _running(F.transform(rows, lambda x: x["end"]), lambda a, x: F.greatest(a, x), 0)
        before = F.concat(F.array(F.lit(0)), F.slice(upto, F.lit(1), F.size(rows) - 1))
        heads = F.filter(F.zip_with(rows, before, lambda x, z: F.struct(x.alias("x"), z.alias("z"))), lambda y: y["z"] <= y["x"]["start"])
        last = F.concat(F.transform(F.slice(heads, F.lit(2), F.size(heads)), lambda y: y["z"]), F.array(F.element_at(upto, -1)))
        return F.zip_with(heads, last, lambda y, z: F.struct(y["x"]["start"].alias("start"), z.alias("end"), y["x"]["kind"].alias("kind")))

    merged = F.coalesce(_let(spans, lambda rows: F.when(F.size(rows) > 0, merge(rows))), F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    text = F.col(text_col)
    out = found.withColumn("pii_merged", merged)
    ends = F.concat(F.array(F.lit(0)), F.transform("pii_merged", lambda x: x["end"]))
    # each span with the end of the one before; the text between is cut from a stretch of _GROUP spans, as offsets count from its start
    items = F.zip_with(F.col("pii_merged"), F.slice(ends, 1, F.size("pii_merged")), lambda x, a: F.struct(a.alias("a"), x["start"].alias("s"), x["end"].alias("z"), x["kind"].alias("kind")))

    def pieces(rows):
        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / _GROUP).cast("int") - 1), lambda g: F.slice(rows, g * _GROUP + 1, F.lit(_GROUP)))

        def cut(part):
            first = part[0]["a"]
            stretch = F.substring(text, first + 1, F.element_at(part, -1)["s"] - first)
            return _let(stretch, lambda here: F.array_join(F.transform(part, lambda x: F.concat(F.substring(here, x["a"] - first + 1, x["s"] - x["a"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""))

        return F.array_join(F.transform(groups, cut), "")

    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    new = F.when(F.size("pii_merged") > 0, F.concat(_let(items, pieces), tail)).otherwise(text)
    return out.withColumn(text_col, new).select(*docs.columns)
