"""Exact removal of repeated byte strings by distributed prefix doubling over content-picked positions.

A string of `length` bytes (400) is repeated if it starts at two places or more. Steps 1, 3 and 4, on words instead of
bytes, also tell which documents share a passage of over 50 words. Texts that are equal are taken once, with their number.

1. Positions. Every stretch of `window` grams of `gram` symbols picks its least gram (by a hash; the leftmost on ties).
   About one position in 55 bytes is ever picked. The pick that follows a picked position is that of the stretch which
   begins `ahead` symbols later. So the choice depends on content alone: equal strings pick equal positions, and from a
   pick on they have the same following ones. The text from a pick to the end of the next pick's gram is a phrase. (Words
   need no phrases: their stretches fill whole windows, and the gram stands for the phrase.)
2. Doubling. Phrases are sorted and ranked; positions with a phrase of their own are dropped. Then, round by round, each
   position is paired with the position 1, 2, 4, ... phrases ahead: Spark counts and sorts the (rank, rank ahead) pairs,
   gives new ranks in sorted order, and drops positions that have become unique or whose prefix is past the threshold.
3. Runs. Neighbouring windows of the threshold's length with the same first pick form a run. It is judged by the last rank
   that all its windows hold: if that is unique, it never reaches this step, as most of the corpus doesn't. A run whose
   whole content occurs twice has all its windows repeated. That settles the inside of long copies with one row a run.
4. What is left differs near its ends from all runs of its rank. Such runs, one copy of each, are cut into blocks of a few
   windows at fixed offsets from the pick. The symbols common to a block's windows are counted: if unique, none of its
   windows is repeated. A block whose whole content occurs twice has all its windows repeated. In the few blocks between,
   windows are told apart by the rank pair (first half, second half).

Fingerprints of 64 bits stand for contents of phrases, runs, blocks and halves. Counts aggregate on the map side and hits
come back over joins of written tables that Spark may split, so a passage that a third of all documents share falls into no
single task.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gritmill.llm.common import Scratch, text_bytes, tidy


class Unit(NamedTuple):
    """What is counted. Each string of `length` symbols holds a phrase if 2 * window + gram + ahead is at most length + 2, or,
    where `ahead` is 0 and phrases are single grams, if window + gram is at most length + 1."""

    length: int
    gram: int
    window: int
    ahead: int
    step: int  # windows in a block of step 4

    def fits(self) -> bool:
        return 2 * self.window + self.gram + self.ahead <= self.length + 2 if self.ahead else self.window + self.gram <= self.length + 1


#: Bytes, and words: unit 0 and unit 1.
BYTES, WORDS = Unit(400, 60, 110, 30, 16), Unit(51, 13, 39, 0, 8)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 2, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Fingerprints of all strings of one sequence of symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _power(n)
        self.n, self.sums = n, np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def each(self, length: int) -> np.ndarray:
        """Of the strings of this length at every position."""
        d = self.sums[length:] - self.sums[:-length]
        return _mix(d * self.down[: len(d)])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def _hashes(text: bytes) -> list[_Hashes]:
    """Of a text's bytes and of its words."""
    raw = np.frombuffer(text, np.uint8)
    of_bytes = _Hashes(_BYTE[raw])
    edge = np.diff(_BLANK[raw].astype(np.int8), prepend=1, append=1)
    return [of_bytes, _Hashes(_mix(of_bytes.at(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))))]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima (van Herk)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, _MASK, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Picks(NamedTuple):
    """Of each picked position: itself, length and fingerprint of its phrase, first and last window of its run (last before
    first: none), number of phrases that all its windows hold, and the fingerprint of the run."""

    a: np.ndarray
    len: np.ndarray
    g: np.ndarray
    s: np.ndarray
    e: np.ndarray
    m: np.ndarray
    r: np.ndarray


def picks_of(h: _Hashes, unit: Unit, mark: int = 0) -> Picks:
    """The picked positions of a sequence that have a next one; the sequence has a window of the unit's length.

    mark is the lowest bit of all phrases' fingerprints.
    """
    grams = h.each(unit.gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    first = (_sliding_min(order, unit.window) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the pick of the stretch that begins here
    s = np.concatenate(([0], np.flatnonzero(np.diff(first)) + 1))
    a = first[s]
    e = np.minimum(np.append(s[1:], len(first)) - 1, h.n - unit.length)
    if unit.ahead:
        nexts = np.full(len(a) + 1, len(a))  # by index; the last ones have none and lead to one beyond the end
        on = np.flatnonzero(a + unit.ahead < len(first))
        nexts[on] = np.searchsorted(a, first[a[on] + unit.ahead])
        at, here, m = np.append(a, 1 << 60), np.arange(len(a)), np.zeros(len(a), np.int64)
        while True:  # phrases that all windows of the run hold, with the whole stretch that each next pick is taken from
            fits = at[here] + (unit.ahead + unit.window + unit.gram - 1) <= s + unit.length
            if not fits.any():
                break
            here, m = np.where(fits, nexts[here], len(a)), m + fits
        kept = np.flatnonzero(nexts[:-1] < len(a))
        a, s, e, m, to = a[kept], s[kept], e[kept], m[kept], at[nexts[kept]]
    else:
        m, to = np.ones(len(a), np.int64), a
    whole = h.at(s, np.minimum(np.maximum(e, s) + unit.length, h.n))
    shape = ((a - s) << 20 | np.maximum(e - s, 0)).astype(np.uint64)
    g = _mix(h.at(a, to + unit.gram)) & np.uint64(_MASK - 1) | np.uint64(mark)
    return Picks(a, to + unit.gram - a, g.view(np.int64), s, e, np.where(e < s, 0, m), _mix(whole ^ _mix(shape + np.uint64(1))).view(np.int64))


#: u is twice the text's number, plus 1 for words; back and fore are the distances from a back to s and to e.
POSITIONS = "u long, a int, len int, g long, back int, fore int, m int, r long"
_BATCH = 200_000  # rows of one record batch, about


def _batches(batches, schema: pa.Schema, rows_of):
    """Record batches of what `rows_of` gives for each row: lists of tuples of arrays (lists of arrays are list values)."""
    rows, n = [], 0
    for batch in batches:
        for row in rows_of(batch):
            rows.append(row)
            n += len(row[0])
            if n >= _BATCH:
                yield _record(rows, schema)
                rows, n = [], 0
    if rows:
        yield _record(rows, schema)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for x, field in zip(zip(*rows, strict=True), schema, strict=True):
        if pa.types.is_list(field.type):
            sizes, values = np.concatenate([p[0] for p in x]), np.concatenate([p[1] for p in x])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values)))
        else:
            columns.append(pa.array(np.concatenate(x).astype(field.type.to_pandas_dtype(), copy=False)))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _scan(units: tuple[Unit, ...]):
    schema = pa.schema([("u", pa.int64()), ("a", pa.int32()), ("len", pa.int32()), ("g", pa.int64()), ("back", pa.int32()), ("fore", pa.int32()), ("m", pa.int32()), ("r", pa.int64())])

    def rows_of(batch):
        for t, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            for k, (h, unit) in enumerate(zip(_hashes(text) if text else (), units, strict=False)):
                if h.n >= unit.length:
                    p = picks_of(h, unit, k)
                    yield np.full(len(p.a), 2 * t + k), p.a, p.len, p.g, p.a - p.s, p.a - p.e, p.m, p.r

    return lambda batches: _batches(batches, schema, rows_of)


def _ranked(scratch: Scratch, df: DataFrame, *key: str) -> DataFrame:
    """The key's values that occur twice or more, with their rank `new`: a long that grows in sorted order.

    Values are counted on the map side and sorted once each, so a value that very many rows have is one row here.
    """
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return scratch.save(twice.orderBy(*key).withColumn("new", F.monotonically_increasing_id()), "ranks")


def doubled(scratch: Scratch, positions: DataFrame, units: tuple[Unit, ...], rounds: list | None = None) -> DataFrame:
    """Runs (u, a, back, fore, r, g) with a window whose longest doubled prefix occurs elsewhere; g is the first phrase's rank.

    Equal windows have the same first phrase but their runs may hold more or less after it, so g tells which runs are to be
    compared, and the later rounds which are left. `rounds`, if given, gets each round's table, which then stays.
    """
    rest = ["back", "fore", "m", "r", "cls"]
    unit = lambda f: F.when(F.col("u") % 2 == 0, getattr(units[0], f)).otherwise(getattr(units[-1], f))
    ranks = _ranked(scratch, positions, "g")
    # the lowest bit of a class tells bytes from words, as that of a fingerprint does
    live = scratch.save(positions.join(ranks, "g").withColumn("cls", F.col("new") * 2 + F.col("u") % 2).select("u", "a", "len", F.col("new").alias("rank"), *rest), "live")
    scratch.drop(positions, ranks)
    runs, k = [], 0
    while True:
        if rounds is not None:
            rounds.append(live)
        runs.append(scratch.save(live.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k)).select("u", "a", "back", "fore", "r", F.col("cls").alias("g")), "runs"))
        if not live.where(F.col("m") >= 2 << k).head(1):
            break
        chained = live.where(unit("ahead") > 0)
        ahead = chained.select("u", F.col("a").alias("to"), F.col("len").alias("more"), F.col("rank").alias("ahead"))
        pairs = chained.withColumn("to", F.col("a") + F.col("len") - unit("gram")).join(ahead, ["u", "to"])
        pairs = pairs.withColumn("len", F.col("len") + F.col("more") - unit("gram")).where(F.col("len") <= unit("length"))
        pairs = scratch.save(pairs.select("u", "a", "len", "rank", "ahead", *rest), "pairs")
        ranks = _ranked(scratch, pairs, "rank", "ahead")
        after = scratch.save(pairs.join(ranks, ["rank", "ahead"]).select("u", "a", "len", F.col("new").alias("rank"), *rest), "live")
        scratch.drop(pairs, ranks, *([] if rounds is not None else [live]))
        live, k = after, k + 1
    if rounds is None:
        scratch.drop(live)
    out = runs[0]
    for x in runs[1:]:
        out = out.unionByName(x)
    return out


def _blocks(units: tuple[Unit, ...]):
    """Cuts runs into blocks of at most `step` windows, at multiples of it before the pick, each with its windows' rank pairs."""
    schema = pa.schema([("g", pa.int64()), ("b", pa.int32()), ("core", pa.int64()), ("full", pa.int64()), ("u", pa.int64()), ("p", pa.int32()), ("open", pa.bool_()), ("ws", pa.list_(pa.int64()))])

    def rows_of(batch):
        for t, text, runs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            hashes = _hashes(text)
            for k, (h, unit) in enumerate(zip(hashes, units, strict=False)):
                own = [x for x in runs if x["g"] & 1 == k]
                if not own:
                    continue
                pick, back, fore, g = (np.array([x[c] for x in own], np.int64) for c in ("a", "back", "fore", "g"))
                open_ = np.array([x["open"] for x in own])
                length, half, step = unit.length, unit.length // 2, unit.step
                sizes = back - fore + 1
                run = np.repeat(np.arange(len(own)), sizes)
                a = pick[run]
                p = a - back[run] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                b = (a - p) // step
                first = np.flatnonzero((np.diff(b, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
                last = np.append(first[1:], len(p)) - 1
                at = a[first] - b[first] * step  # the last window start that the block may have; all its windows hold the symbols from here
                shape = ((a[first] - p[first]) << 10 | (p[last] - p[first])).astype(np.uint64)
                ranks = _mix(_mix(h.at(p, p + half)) * np.uint64(3) + _mix(h.at(p + half, p + length)))  # the rank pair
                core = _mix(h.at(at, at - step + 1 + length))
                full = _mix(h.at(p[first], p[last] + length) ^ _mix(shape + np.uint64(1)))
                yield g[run[first]], b[first], core.view(np.int64), full.view(np.int64), np.full(len(first), 2 * t + k), p[first], open_[run[first]], (last + 1 - first, ranks.view(np.int64))

    return lambda batches: _batches(batches, schema, rows_of)


def _again(key: str) -> Column:
    """Whether what has been counted (n, and u from `least` to `most`) occurs again: anywhere for bytes, in another text for words."""
    return F.when(F.col(key).bitwiseAND(F.lit(1)) == 0, F.col("n") > 1).otherwise(F.col("least") != F.col("most"))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.min("u").alias("least"), F.max("u").alias("most")]


def repeated_spans(texts: DataFrame, scratch: Scratch, units: tuple[Unit, ...] = (BYTES, WORDS)) -> DataFrame:
    """(u, s, e): windows s to e (inclusive) of text u div 2 start repeated strings, of bytes (u even) or words (u odd).

    All such windows of bytes; of words, at least one in each text that shares a passage with another text. `texts` has t (a
    number of its own for each row), and text; no two texts are equal.
    """
    spark = texts.sparkSession
    left = doubled(scratch, scratch.save(texts.mapInArrow(_scan(units), POSITIONS), "positions"), units)
    tidy(spark)
    distinct = left.groupBy("g", "r").agg(*_counts(), F.min(F.struct("u", "a", "back", "fore")).alias("at"))
    distinct = counted = scratch.save(distinct.withColumn("again", _again("g")).drop("n", "least", "most"), "counted")
    whole = left.join(distinct.where("again").select("g", "r"), ["g", "r"], "left_semi")
    spans = scratch.save(whole.select("u", (F.col("a") - F.col("back")).alias("s"), (F.col("a") - F.col("fore")).alias("e")), "whole")
    scratch.drop(left)
    # of words, a text that has one passage needs no other
    passed = scratch.save(spans.where("u % 2 = 1").select(F.col("u").alias("passed")).distinct(), "passed")
    distinct = distinct.join(passed, F.col("at.u") == F.col("passed"), "left").withColumn("open", ~F.col("again") & F.col("passed").isNull())
    distinct = scratch.save(distinct.select("g", "at", "open"), "distinct")
    # a phrase that has a run not settled yet, and another run to compare it with: one copy of each of its runs
    loose = distinct.groupBy("g").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("g")
    loose = scratch.save(loose, "loose")
    todo = distinct.join(loose, "g", "left_semi").select("at.*", "g", "open")
    todo = scratch.save(todo.groupBy(F.shiftright("u", 1).alias("t")).agg(F.collect_list(F.struct("a", "back", "fore", "g", "open")).alias("runs")), "todo")
    scratch.drop(counted, distinct, loose)
    tidy(spark)
    once = texts.join(todo, "t").select("t", "text", "runs")
    blocks = scratch.save(once.mapInArrow(_blocks(units), "g long, b int, core long, full long, u long, p int, open boolean, ws array<bigint>"), "blocks")
    scratch.drop(todo)
    tidy(spark)
    same = ["g", "b", "core", "full"]
    fulls = blocks.groupBy(*same).agg(*_counts(), F.max("open").alias("open")).withColumn("again", _again("g"))
    fulls = scratch.save(fulls.drop("n", "least", "most"), "fulls")
    settled = blocks.where("open").join(fulls.where("again and open").select(*same), same, "left_semi").select("u", F.col("p").alias("s"), (F.col("p") + F.size("ws") - 1).alias("e"))
    between = fulls.groupBy("g", "b", "core").agg(F.count("*").alias("k"), F.max(F.col("open") & ~F.col("again")).alias("loose")).where("k > 1 and loose").select("g", "b", "core")
    between = scratch.save(between, "between")
    windows = blocks.join(between, ["g", "b", "core"], "left_semi").select("g", "core", "u", "p", "open", F.posexplode("ws").alias("i", "w"))
    windows = scratch.save(windows.select("g", "core", "w", "u", F.col("p").alias("block"), (F.col("p") + F.col("i")).alias("p"), "open"), "windows")
    spans = spans.unionByName(scratch.save(settled, "settled"))
    scratch.drop(blocks, fulls, between)
    tidy(spark)
    key = ["g", "core", "w"]
    twice = windows.groupBy(*key).agg(*_counts(), F.max("open").alias("open")).where(F.col("open") & _again("g")).select(*key)
    twice = scratch.save(twice, "twice")
    single = windows.where("open").join(twice, key, "left_semi")
    edges = scratch.save(single.groupBy("u", "block").agg(F.min("p").alias("a"), F.max("p").alias("z"), F.collect_list("p").alias("ps")), "edges")
    scratch.drop(windows, twice)
    plain = edges.where("z - a + 1 = size(ps)").select("u", F.col("a").alias("s"), F.col("z").alias("e"))
    broken = edges.where("z - a + 1 <> size(ps)").select("u", F.explode("ps").alias("s")).withColumn("e", F.col("s"))
    return spans.unionByName(plain).unionByName(broken)


def _merged(found: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Spans [start, end) that the windows cover, those that touch joined."""
    spans: list[list[int]] = []
    for s, e in sorted(found):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e + length)
        else:
            spans.append([s, e + length])
    return spans


CUT = "th long, tj long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>, has_passage int"


def _cut(units: tuple[Unit, ...]):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string(), span, pa.int32()]
    names = [x.split()[0] for x in CUT.split(", ") if x.split()[0] != "end:"]

    def cut(batches):
        for b in batches:
            copied, found, out = b.column(3).to_pylist(), b.column(4).to_pylist(), []
            for th, tj, text, twice, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), copied, found, strict=True):
                passage = any(x["k"] for x in runs or ())
                if twice:  # a text that is there twice: all its windows are repeated
                    runs = [{"k": 0, "s": 0, "e": len(text) - units[0].length}] if len(text) >= units[0].length else ()
                    passage = len(text.split()) >= units[1].length
                spans = _merged([(x["s"], x["e"]) for x in runs or () if not x["k"]], units[0].length)
                kept, at = hashlib.sha256(), 0
                for a, z in spans:
                    kept.update(text[at:a])
                    at = z
                kept.update(text[at:])
                out.append((th, tj, len(text), sum(z - a for a, z in spans), len(spans), kept.hexdigest(), [{"start": a, "end": z} for a, z in spans], int(passage)))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    return cut


def suffix_dedup(docs: DataFrame, scratch: Scratch, length: int = 400, passage: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (byte offsets), has_passage.

    Every byte covered by a string of `length` bytes that also starts elsewhere, in the same text or another, is removed;
    matches never cross documents and are judged on the input. has_passage is 1 if a run of `passage` words (bytes x20 and
    x09 to x0D part words) is in another row too, else 0; it has no part in what is removed. Null text is empty; shorter texts keep
    all. Equal rows each count as a place, whatever their doc_id, null included. A very long text is one row of one task,
    with some 60 bytes of working memory a byte. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    units = (BYTES._replace(length=length), WORDS._replace(length=passage))
    for u in units:
        if not u.fits():
            raise ValueError(f"strings of {u.length} are too short for stretches of {u.window} grams of {u.gram}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tj")]  # 128 bits tell texts apart
    texts = docs.select(*keys, text.alias("text")).groupBy("th", "tj").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("twice"))
    texts = scratch.save(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    long = texts.where(F.octet_length("text") >= 2 * passage - 1).select("t", "text")
    spans = scratch.save(repeated_spans(long, scratch, units), "spans")
    tidy(spark)
    # of words one span a text is enough
    spans = spans.where("u % 2 = 0").unionByName(spans.where("u % 2 = 1").groupBy("u").agg(F.min("s").alias("s")).withColumn("e", F.col("s")))
    found = spans.groupBy(F.shiftright("u", 1).alias("t")).agg(F.collect_list(F.struct(F.col("u").bitwiseAND(F.lit(1)).alias("k"), "s", "e")).alias("found"))
    done = scratch.save(texts.join(found, "t", "left").select("th", "tj", "text", "twice", "found").mapInArrow(_cut(units), CUT), "done")
    scratch.drop(texts, spans)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys)
    return rows.join(done, ["th", "tj"]).drop("th", "tj")
