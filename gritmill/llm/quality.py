"""Quality rules from repetition: suffix arrays of word sequences and their longest-common-prefix intervals.

The suffix array of a batch of documents is built by prefix doubling in numpy, with ranks kept apart by document; positions
leave the sort once unique. Longest common prefixes of neighbours come from the ranks of each doubling. A suffix lies in
the LCP interval of its longest repeat, whose length is the larger of the LCPs to its two neighbours; those repeats are
the maximal repeated substrings, and the union of their spans (at least `min_repeat` words long) covers what repeats.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import text_bytes
from gritmill.llm.tokens import release

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SYMBOLS_AND_RULE = tuple(bytes([c]) for c in SYMBOLS)
_SPACES = b" \t\n\r\x0b\x0c"
_CHUNK = 400_000


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the key, and in that order the index of each one's first equal."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))


def repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of concatenated documents: length of its longest repeat (0 if under min_repeat), and whether a repeated 3-word window covers it.

    `words` are ids, `doc` document numbers, `ends` the end of each position's document.
    """
    n = len(words)
    longest, triple = np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return longest, triple
    order, first = _groups(doc * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = first
    ranks, step = [(1, rank.copy())], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    base = active if min_repeat <= 1 else None
    while len(active):
        nxt = active + step
        inside = nxt < ends[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        a, s, r = active[order], second[order], rank[active][order]
        new_r = np.ones(len(a), bool)
        new_r[1:] = r[1:] != r[:-1]
        new = new_r.copy()
        # ends of different documents never meet, as ranks are apart by document
        new[1:] |= s[1:] != s[:-1]
        at = np.arange(len(a))
        start_r = np.maximum.accumulate(np.where(new_r, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        updated = r + start - start_r
        if step == 1:  # windows of three words: the pair's rank with the third word's rank
            pair = rank.copy()
            pair[a] = updated
            third = np.where(a + 2 < ends[a], rank[np.minimum(a + 2, n - 1)] + 1, 0)
            ok = third > 0
            b = a[ok]
            if len(b):
                o = np.lexsort((third[ok], pair[b]))
                b, t, p = b[o], third[ok][o], pair[b][o]
                same = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
                hit = np.zeros(len(b), bool)
                hit[1:] |= same
                hit[:-1] |= same
                for k in range(3):
                    triple[b[hit] + k] = True
        rank[a] = updated
        step *= 2
        lone = np.ones(len(a), bool)
        lone[:-1] &= new[1:]
        lone &= new
        active = np.sort(a[~lone])
        ranks.append((step, rank.copy()))
        if step <= min_repeat:
            base = active
    if base is None or not len(base):
        return longest, triple
    # neighbours in suffix order among positions whose prefix of `level` words repeats
    level = max(x for x, _ in ranks if x <= max(min_repeat, 1))
    prefix = next(r for x, r in ranks if x == level)
    sa = base[np.argsort(rank[base], kind="stable")]
    i, j = sa[:-1], sa[1:]
    keep = prefix[i] == prefix[j]
    i, j = i[keep], j[keep]
    lcp = np.zeros(len(i), np.int64)
    for length, r in ranks[::-1]:
        x, y = i + lcp, j + lcp
        ok = (x < ends[i]) & (y < ends[j])
        ok[ok] = r[x[ok]] == r[y[ok]]
        lcp[ok] += length
    lcp = np.minimum(lcp, ends[j] - j)
    lcp = np.minimum(lcp, ends[i] - i)
    lcp[lcp < min_repeat] = 0
    np.maximum.at(longest, i, lcp)
    np.maximum.at(longest, j, lcp)
    return longest, triple


def covered(longest: np.ndarray) -> np.ndarray:
    """Positions in the union of the repeats' spans."""
    n = len(longest)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[bytes], min_repeat: int) -> list[tuple[int, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat) of each text."""
    lines, ids, counts, seen = [], [], [], {}
    for t in texts:
        words = t.split()
        counts.append(len(words))
        setd = seen.setdefault
        ids.append(np.array([setd(w, len(seen)) for w in words], np.int64))
        chars = len(t.decode()) - sum(map(t.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
        dup = 0
        if b"\n" in t:
            parts = [x for x in t.split(b"\n") if x.strip(_SPACES)]
            dup = len(parts) - len(set(parts))
        lines.append((chars, sum(map(t.count, SYMBOLS_AND_RULE)), dup))
    size = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    longest, triple = repeats(np.concatenate(ids) if ids else np.zeros(0, np.int64), doc, np.repeat(np.cumsum(size), size), min_repeat)
    n = len(texts)
    repeat_words = np.bincount(doc[triple], minlength=n)
    cover = np.bincount(doc[covered(longest)], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, longest)
    return [(w, *x, int(r), int(c), int(t)) for w, x, r, c, t in zip(counts, lines, repeat_words, cover, top, strict=True)]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _measurer(min_repeat: int):
    def run(batches):
        release()
        for b in batches:
            out, held, size = [], [], 0
            for t in text_bytes(b.column(b.num_columns - 1)):
                held.append(t)
                size += len(t) // 6
                if size >= _CHUNK:
                    out += measure(held, min_repeat)
                    held, size = [], 0
            if held:
                out += measure(held, min_repeat)
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(COLUMNS)
            rest = b.schema.names[: b.num_columns - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*rest, *COLUMNS])

    return run


def repetition_rules(docs: DataFrame, min_repeat: int = 5, max_covered: float = 0.15, max_longest: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the counts of COLUMNS, base_failed and kept; `keep` names columns of docs to carry.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed, at most
    `max_covered` of the words covered by repeats of `min_repeat` words or more, and no repeat over `max_longest` words.
    Five words and 0.15 are the published limit on text in repeated 5-grams of Rae et al. (2021), here on words; a repeat
    of more than 50 words is a passage, as elsewhere in this subpackage. A very long text is measured whole, by one task,
    with some 100 bytes of working memory a word.
    Null and empty texts have no words and fail. Repeated rows and null doc_ids give a row each; an empty table gives none.
    """
    rest = [c for c in keep if c not in (id_col, text_col)]
    # carried columns get names of their own, so that none clashes with a count
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(rest)), *([F.col(text_col).alias("kept_text")] if text_col in keep else []), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), *(f"{c} long" for c in COLUMNS)])
    out = rows.mapInArrow(_measurer(min_repeat), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
