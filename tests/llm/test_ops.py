"""Each operator against its plain version, on the driver's smallest table and on rows made to be awkward."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gritmill.llm import ego_join, license_scan, mixing, packing, pii, quality, rans, simhash, suffix_dedup, toxicity
from gritmill.llm.common import Scratch
from gritmill.llm.components import connected_components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, found string, key long"
_RNG = random.Random(7)
_WORDS = ["".join(_RNG.choice("abcdefghij") for _ in range(_RNG.randint(1, 9))) for _ in range(300)]
_LONG = " ".join(_RNG.choice(_WORDS) for _ in range(400))
TEXTS = [
    None, "", " \n\t ", "one", "two words", "three words here", "Three Words HERE", "ÀÉ ß straße İ ſ ﬁ 中文 é  x y \x1c z", "😀 a@b.co 😀 +1 (743) 555-3824 4539578763621486",
    _LONG, _LONG, _LONG + " more", "x" + _LONG[3:], _LONG[:900] + " zz " + _LONG[900:], _LONG[500:1200], "a" * 1500, "ab " * 700, "word " * 400, "line one two\n" * 80,
    "<|endoftext|> mid <|startoftext|>word don't I'LL 12345 ١٢ !!??  \r\n\n x", "1.2.3.4 256.1.1.1 0001.002.3.4.5.6.7.8 1.2.3", "x@y.z%q@w.v a@@b.c a.b@c d@e..f g@-h.-i _@j.k.", "4539 5787-6362 1486 4539578763621486 4539578763621487 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+12345678901 +1 (2) 3 4 +1.2-3 4 5 6 7 8 9 0 +1+2+3+4567890123 + 1", "mail me at joe [at] example [dot] com or call (212) 555-0199 card 1234 5678 9012 3456", "9" * 5000, "1 " * 4000, "a." * 3000 + "@" + "b." * 3000 + "c", "#*$%&|<> \x0b\x0c | |\n|\n|", "Released under the MIT License.\nIt. Licensed under the Apache License, Version 2.0.", "\x01 1\x012 4539\x01578763621486 a@b\x01c.d",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 4}", None, i, i, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids and nulls everywhere."""
    rows = [(None, None, None, None, None, None, None, None, None), (None, _LONG, None, None, None, None, None, None, None), (3, _LONG, None, "s", 1, 1, 1, "", 1), (3, _LONG, None, "s", 1, 1, 1, "", 1), (3, "other text", None, None, 1, 1, 1, "", 1)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    want = brute.components({x for p in pairs for x in p}, pairs)
    assert all(got.get(k, k) == v for k, v in want.items())
    assert not connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect()


@pytest.mark.parametrize("name", ["docs", "table"])
def test_simhash(spark, request, name):
    df = request.getfixturevalue(name)
    want = brute.simhash(texts_of(df).items())
    got = by_id(simhash.simhash_groups(df, Scratch(spark, "t")))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == want


def test_simhash_links_are_all_found(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(12)} | {f ^ 1 << rng.randrange(64) for _ in range(4)}
    fps |= {0, 1 << 63, (1 << 64) - 1, (1 << 64) - 2, 3}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    found = simhash.links(spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, id long"))
    got = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    order = sorted(fps)
    assert got == {(j, i) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 2}


def test_simhash_odd_rows(spark, odd):
    got = simhash.simhash_groups(odd, Scratch(spark, "t")).collect()
    assert len(got) == 5 and all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert not simhash.simhash_groups(odd.limit(0), Scratch(spark, "t")).collect()


@pytest.mark.parametrize("name", ["docs", "table"])
def test_suffix_dedup(spark, request, name):
    df = request.getfixturevalue(name)
    texts = texts_of(df)
    want = dict(zip(texts, brute.repeats([(t or "").encode() for t in texts.values()]), strict=True))
    got = by_id(suffix_dedup.suffix_dedup(df, Scratch(spark, "t")))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want


def test_suffix_dedup_partial_overlaps(spark):
    rng = random.Random(11)
    pool = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(5000)
            parts += [pool[a : a + rng.randint(100, 900)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.repeats([t.encode() for t in texts])
    got = by_id(suffix_dedup.suffix_dedup(df, Scratch(spark, "t")))
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for _, r in sorted(got.items())] == want
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)


def _passage_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
    pool = [word() for _ in range(900)]
    out = []
    for k in range(50):
        a, n = rng.randrange(700), rng.choice([40, 50, 51, 52, 60, 90])
        out.append(" ".join([word() for _ in range(rng.randint(0, 80))] + pool[a : a + n]) + "\n\t " + "  ".join(word() for _ in range(rng.randint(0, 80))))
    own = " ".join(word() for _ in range(60))
    return [*out, own + " x " + own, out[0], "la " * 300, "la " * 60, "la " * 50, None]


def test_suffix_dedup_passages(spark):
    texts = _passage_texts()
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")))
    want = brute.passages([(t or "").encode() for t in texts])
    assert [r["has_passage"] for _, r in sorted(got.items())] == [int(n > 0) for n in want]
    assert 5 < sum(n > 0 for n in want) < len(want) - 5
    assert [r["n_removed"] for _, r in sorted(got.items())] == [r[1] for r in brute.repeats([(t or "").encode() for t in texts])]


def test_suffix_dedup_rounds(spark):
    """Ranks of every round against plain prefixes: equal ranks for equal prefixes, unique ones gone, ranks in sorted order of their pairs."""
    texts = [t.encode() for t in dict.fromkeys(t for t in _passage_texts() if t)]
    unit = suffix_dedup.Unit(60, 6, 12, 2, 4)
    frame = spark.createDataFrame(list(enumerate(t.decode() for t in texts)), "t long, text string")
    scratch, rounds = Scratch(spark, "t"), []
    positions = scratch.save(frame.mapInArrow(suffix_dedup._scan((unit,)), suffix_dedup.POSITIONS), "positions")
    first = {(r.u, r.a): r.len for r in positions.collect()}
    suffix_dedup.doubled(scratch, positions, (unit, unit), rounds)
    assert len(rounds) >= 3
    prefix, before = {p: (n, texts[p[0] // 2][p[1] : p[1] + n]) for p, n in first.items()}, None
    for k, table in enumerate(rounds):
        rows = {(r.u, r.a): r for r in table.collect()}
        if k:
            after = {}
            for (u, a), (n, _) in prefix.items():
                to = (u, a + n - unit.gram)
                if (u, a) in before and to in before and n + prefix[to][0] - unit.gram <= unit.length:
                    after[u, a] = n + prefix[to][0] - unit.gram, texts[u // 2][a : a + n + prefix[to][0] - unit.gram]
            prefix = after
        counted = {}
        for n, text in prefix.values():
            counted[text] = counted.get(text, 0) + 1
        assert set(rows) == {p for p, (n, text) in prefix.items() if counted[text] > 1}
        ranks = {}
        for p, r in rows.items():
            assert r.len == prefix[p][0] and ranks.setdefault(r.rank, prefix[p][1]) == prefix[p][1]
        assert len(ranks) == sum(n > 1 for n in counted.values())
        if k:
            pairs = sorted({(before[p].rank, before[p[0], p[1] + before[p].len - unit.gram].rank, r.rank) for p, r in rows.items()})
            assert [x[2] for x in pairs] == sorted(x[2] for x in pairs)
        before = rows


def test_suffix_dedup_odd_rows(spark, odd):
    got = suffix_dedup.suffix_dedup(odd, Scratch(spark, "t")).collect()
    want = brute.repeats([(r["text"] or "").encode() for r in odd.collect()])
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert not suffix_dedup.suffix_dedup(odd.limit(0), Scratch(spark, "t")).collect()


def test_pii_many_finds_and_overlaps(spark):
    """Offsets, overlaps and redaction over more finds than a group holds, against a plain version."""
    rng = random.Random(3)
    parts = ["joe@a.co", "1.2.3.4", "x@1.2.3.4", "é😀", "+1 743 555 3824", "212 555 0199", "4539 5787 6362 1486", "1234 5678 9012 3456", "at home dot", "ann [at] b [dot] org", "10[.]0[.]0[.]7", "0044 20 7946 0958"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    rows, more = by_id(pii.find_pii(df, scratch)), 0
    plain = by_id(pii.redact(df, scratch))
    for k, t in enumerate(texts):
        base, spans = ([(int(a), int(z), kind) for kind, a, z in (x.split(":") for x in found if x)] for found in (brute.pii(t), rows[k]["spans"].split(",")))
        assert spans == sorted(spans, key=lambda x: (x[0], pii.KINDS.index(x[2]))) and set(base) <= set(spans)
        extra = [x for x in spans if x not in base]
        assert not any(a < y and x < z for a, z, _ in extra for x, y, _ in base)
        more += len(extra)
        want, at, end, name = "", 0, -1, ""
        for a, z, kind in spans:
            if a >= end:
                want += (f"<{name.upper()}>" if name else "") + t[max(at, end) : a]
                end, name, at = z, kind, a
            end = max(end, z)
        want += (f"<{name.upper()}>" if name else "") + t[max(end, 0) :]
        assert plain[k]["text"] == want, k
    assert more


@pytest.mark.parametrize("overlap", [False, True])
def test_mixing_beyond_the_patterns_of_the_driver(spark, overlap):
    """The distributed way gives what the flow gives, with sources that share documents and without."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), None if i % 37 == 0 else f"s{rng.randrange(60):02d}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    members = F.when((F.col("doc_id") % 50 == 1) & F.lit(overlap), F.array(F.col("source"), F.lit("s03"), F.lit("s04"))).otherwise(F.array("source"))
    a = by_id(mixing.mix(df, Scratch(spark, "t"), members=members))
    b = by_id(mixing.mix(df, Scratch(spark, "t"), members=members, max_patterns=40))
    assert a.keys() == b.keys()
    for k, x in a.items():
        y = b[k]
        assert (x["size"], x["source_size"]) == (y["size"], y["source_size"]) and abs(x["target"] - y["target"]) < 1e-6 and y["taken"] <= 2 * y["size"]
    first, second = {}, {}
    for k in a:
        key = tuple(a[k]["sources"])
        first[key] = first.get(key, 0) + a[k]["taken"]
        second[key] = second.get(key, 0) + b[k]["taken"]
    if overlap:
        assert sum(first.values()) == sum(second.values())
    else:
        assert first == second and [a[k]["taken"] for k in sorted(a)] == [b[k]["taken"] for k in sorted(b)]
    with pytest.raises(ValueError):
        mixing.mix(df, Scratch(spark, "t"), members=F.array(F.lit("x"), F.col("doc_id").cast("string")), max_patterns=40)


@pytest.mark.parametrize("name", ["docs", "table"])
def test_quality_base(request, name):
    df = request.getfixturevalue(name)
    got = by_id(quality.repetition_rules(df))
    for k, t in texts_of(df).items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t), k
        assert not (r["base_failed"] and r["kept"])


def test_quality_longest_repeats():
    rng = random.Random(1)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(60)] + [["a"] * 30, []]
    for least in (1, 2, 3, 5, 8):
        for words, got in zip(texts, quality.measure([" ".join(t).encode() for t in texts], least), strict=True):
            n = len(words)
            longest = [0] * n
            for i in range(n):
                for j in range(n):
                    k = 0
                    while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                        k += 1
                    longest[i] = max(longest[i], k if k >= least else 0)
            assert got[5:] == (len({i + k for i in range(n) for k in range(longest[i])}), max(longest, default=0))


def test_quality_verdict(spark, odd):
    once = " ".join(_WORDS[i] + str(i) for i in range(200))
    some = spark.createDataFrame([(1, once), (2, once + " " + " ".join(once.split()[:150])), (3, once + " " + " ".join(once.split()[:30]))], "doc_id long, text string")
    assert {k: (r["base_failed"], r["kept"]) for k, r in by_id(quality.repetition_rules(some, max_covered=0.9)).items()} == {1: (False, True), 2: (True, False), 3: (False, True)}
    carried = quality.repetition_rules(odd, keep=("text", "lang", "size")).collect()
    assert len(carried) == 5 and {"kept_text", "kept_0", "kept_1"} <= set(carried[0].asDict())


def test_ego_join(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, [float(x) for x in (centre + rng.normal(size=16) * s).astype(np.float32)], c % 3) for i, s in enumerate(rng.uniform(0.05, 0.5, 40))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, rows[3][1], rows[3][2]), (n + 9, rows[3][1], rows[3][2]), (n + 10, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ego_join.ego_join(df, Scratch(spark, "t")).collect()}
    assert got == brute.vectors(rows)


def test_ego_join_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in ego_join.ego_join(df, Scratch(spark, "t")).collect())
    assert got == [(-1, 0, None, None), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert not ego_join.ego_join(df.limit(0), Scratch(spark, "t")).collect()


def test_ego_join_oracle(spark):
    from gritmill.llm import queries
    from tests import oracle

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert not oracle.differences(oracle.connect(sf), queries.op1_ego_join(spark, sf), queries.OP1_SQL)


def test_ego_join_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute.vectors([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ego_join.ego_join(df, Scratch(spark, "t")).collect()} == want


@pytest.mark.parametrize("name", ["docs", "table"])
def test_pii_base(spark, request, name):
    import hashlib

    df = request.getfixturevalue(name)
    got = by_id(pii.find_pii(df, Scratch(spark, "t")))
    for k, t in texts_of(df).items():
        want = brute.pii(t)
        r = got[k]
        assert [r[f"n_{x}"] for x in pii.KINDS] == [sum(w.startswith(x) for w in want) for x in pii.KINDS], (k, want, r)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (k, want, r)
        assert set(want) <= {s for s in r["spans"].split(",") if s}


def test_pii_em_and_redaction(spark, docs, odd):
    counts = {("phone", "1,1,1,-1"): 500, ("phone", "1,1,-1,1"): 60, ("phone", "0,1,1,1"): 40, ("phone", "0,0,0,-1"): 300, ("phone", "0,0,-1,0"): 50}
    rates, post = pii.estimate(counts)
    assert post["phone", "1,1,1,-1"] > 0.9 > 0.1 > post["phone", "0,0,0,-1"] and rates["phone", 1, "1"][1] > rates["phone", 1, "1"][0]
    w = pii.train(counts, post)
    assert w["phone|0=1"] > 0 > w["phone|1=0"]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, Scratch(spark, "t")).collect()}
    assert out[8].startswith("😀 <EMAIL> 😀 ") and out[0] is None and out[9] == _LONG
    assert pii.redact(docs, Scratch(spark, "t")).columns == docs.columns
    assert len(pii.find_pii(odd, Scratch(spark, "t")).collect()) == 5 and not pii.find_pii(odd.limit(0), Scratch(spark, "t")).collect()


@pytest.mark.parametrize("name", ["docs", "table", "odd"])
def test_mixing(spark, request, name):
    df = request.getfixturevalue(name)
    rows = mixing.mix(df, Scratch(spark, "t")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(7), Scratch(spark, "t")).collect())) if name == "table" else rows
    size = {s: 0 for s in {r["source"] for r in df.collect()}}
    for r in df.collect():
        size[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    taken = dict.fromkeys(size, 0)
    for r in rows:
        s = r["sources"][0]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and 0 <= r["taken"] <= 2 * r["size"]
    target = {r["sources"][0]: r["target"] for r in rows}
    assert all(abs(taken[s] - target[s]) < 1 for s in size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(target[s] <= 2 * size[s] + 1e-6 for s in size)


def test_mixing_many_equal_documents_and_overlap(spark):
    same = spark.createDataFrame([(i, "a b c", "x" if i % 3 else "y") for i in range(5000)], "doc_id long, text string, source string")
    rows = mixing.mix(same, Scratch(spark, "t")).collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(22500, abs=2)
    flow = mixing.min_cost_flow({"a": (["x"], 10), "ab": (["x", "y"], 10), "b": (["y"], 4)}, {"x": 12, "y": 12})
    assert flow["a", "x"] + flow["ab", "x"] == 12 and flow["ab", "y"] + flow["b", "y"] == 12
    assert flow["ab", "x"] + flow["ab", "y"] <= 10 and flow["b", "y"] <= 4  # nothing is repeated where once is enough
    assert not mixing.mix(same.limit(0), Scratch(spark, "t")).collect()


def test_license(docs, table):
    got = license_scan.license_spans(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(29, "MIT-notice"), (29, "Apache-2.0-notice")}
    t = TEXTS[29].encode()
    assert {t[r["start"] : r["end"]] for r in got} == {b"Released under the MIT License", b"Licensed under the Apache License, Version 2.0"}
    mit = license_scan.TEMPLATES["MIT"].split()
    changed = " ".join(w for i, w in enumerate(mit) if i % 17 != 5)
    found = license_scan.scan(("intro words " * 30 + changed + " tail" * 20).encode(), license_scan.Index(license_scan.TEMPLATES))
    assert [f[0] for f in found if f[0] == "MIT"] == ["MIT"] and 0.8 < found[0][1] < 1
    wanted = {"Released under the MIT License.": "MIT-notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "under the GNU General Public License, version 3.": "GPL-3.0-notice"}
    found = {(r["doc_id"], r["license"]) for r in license_scan.license_spans(table).collect()}
    assert {(i, lic) for i, t in texts_of(table).items() for line, lic in wanted.items() if line in t} <= found


def test_license_every_place():
    index, rng = license_scan.Index(license_scan.TEMPLATES), random.Random(11)

    def found(words, name):
        return [x[1:] for x in license_scan.scan(" ".join(words).encode(), index) if x[0] == name]

    for name, text in license_scan.TEMPLATES.items():
        template = [w.decode() for w in license_scan.tokens(text.encode())[0]]
        m, size = len(template), len(" ".join(template))
        for at in (0, 7, 8, 16, 17, 30, 1000):
            words = ["qq"] * at + template + ["qq"] * 20
            assert found(words, name) == [(1.0, m, 3 * at, 3 * at + size)], (name, at)
            stray = template[: min(6, m - 1)] + ["qq"] * max(0, at - 6) + template
            assert (1.0, m, len(" ".join(stray)) - size, len(" ".join(stray))) in found(stray, name), (name, at)
        # copies in a row, all found
        assert [x[1] for x in found(template * 9, name)] == [m] * 9, name
        # edited copies, against an alignment without bands
        for at in (0, 30):
            edited = ["zz" if rng.random() < 0.05 else w for w in template if rng.random() > 0.03]
            words = ["qq"] * at + edited + ["qq"] * 5
            want = brute.common_words(words, template)
            if want >= 0.8 * m and m > 20:
                assert [x[1] for x in found(words, name)] == [want], (name, at)
    bsd = [w.decode() for w in license_scan.tokens(license_scan.TEMPLATES["BSD-clauses"].encode())[0]]
    # the text begins within the template
    assert found(bsd[12:] + ["qq"] * 9, "BSD-clauses") == [(56 / 68, 56, 0, len(" ".join(bsd[12:])))]


@pytest.mark.parametrize("name", ["docs", "table", "odd"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(df, path).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    if name == "odd":
        assert sum(r["length"] for r in rows) == sum(len(brute.ids(tok, r["text"], 0)) for r in df.collect())
        return
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, t in texts_of(df).items():
        ids, at = brute.ids(tok, t, 0), 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]]), k
            at += r["length"]
        assert at == len(ids)


def test_sum_of_squares_choice():
    rng = random.Random(4)
    bins = packing.SumOfSquares(16)
    for k in range(400):
        n = rng.randint(1, 15)
        levels = [h for h in range(1, 16) if bins.counts[h] and h + n <= 16]

        def squares(h):
            c = bins.counts.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            return int((c * c).sum())

        chosen = bins.level_for(n)
        assert squares(chosen) == min(map(squares, [0, *levels]))
        bins.place((k, 0, n))


@pytest.mark.parametrize("name", ["docs", "table"])
def test_token_files(spark, request, name):
    df = request.getfixturevalue(name)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(rans.token_files(df, Scratch(spark, "t"), path, block_tokens=3000))
    at = 0
    for k, t in sorted(texts_of(df).items()):
        ids = brute.ids(tok, t, 2)
        r = got[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids)), (k, t and t[:50])
        at += len(ids)


def test_rans_round_trip():
    rng = np.random.default_rng(8)
    for n in (1, 2, 100, 2047, 2048, 2049, 30000):
        ids = np.minimum(rng.zipf(1.3, n), 60000).astype(np.uint16)
        table = rans.Table({int(k): int(c) for k, c in zip(*np.unique(ids, return_counts=True), strict=True)})
        states, words = rans.encode(ids, table, min(2048, n))
        assert (rans.decode(states, words, n, table) == ids).all()
    assert len(words) < 2 * n
    with pytest.raises(ValueError):
        rans.decode(states, words + b"\0\0\0\0", n, table)


def test_rans_checkpoints():
    rng = np.random.default_rng(9)
    ids = np.minimum(rng.zipf(1.3, 30001), 60000).astype(np.uint16)
    table = rans.Table({int(k): int(c) for k, c in zip(*np.unique(ids, return_counts=True), strict=True)})
    states, words, marks = rans.encode_marked(ids, table, 2048, 4096)
    assert (states, words) == rans.encode(ids, table) and [m[0] for m in marks] == list(range(4096, 30001, 4096))
    row = {"n_tokens": len(ids), "states": states, "words": words, "mark_ids": [m[0] for m in marks], "mark_words": [m[1] for m in marks], "mark_states": [m[2] for m in marks]}
    parts = rans.segments(row)
    # each part for itself, in any order
    got = {k: rans.decode(*parts[k], table, k == len(parts) - 1) for k in rng.permutation(len(parts))}
    assert (np.concatenate([got[k] for k in sorted(got)]) == ids).all()


def test_token_files_are_read_by_a_fresh_session(spark, docs, tmp_path):
    """Another process, which knows the folder alone, reads the same rows."""
    import json
    import subprocess
    import sys

    path, folder = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "files")
    rans.write_ids(docs, Scratch(spark, "t"), folder, path, 2, block_tokens=3000)
    want = sorted(tuple(r) for r in rans.token_files(docs, Scratch(spark, "t"), path, block_tokens=5000).collect())
    assert sorted(tuple(r) for r in rans.read_ids(spark, folder).collect()) == want
    assert spark.read.parquet(f"{folder}/blocks").where("size(mark_ids) > 0").count() > 0
    code = f"from pyspark.sql import SparkSession\nimport json\nfrom gritmill.llm import rans\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nprint(json.dumps(sorted(tuple(r) for r in rans.read_ids(s, {folder!r}).collect())))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300, env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": os.getcwd()})
    assert [tuple(x) for x in json.loads(out.stdout.strip().splitlines()[-1])] == want


def test_token_files_odd_rows(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = rans.token_files(odd, Scratch(spark, "t"), path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 3, 3, 3] and got[0]["start"] == 0
    assert not rans.token_files(odd.limit(0), Scratch(spark, "t"), path).collect()


def test_toxicity(spark, docs, odd):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(_WORDS) for _ in range(80)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(80)] = rng.choice(["grumblefool", "grumblehead", "snarkle"])
        for k in range(9, 80, 10):
            words[k] += "."
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = by_id(toxicity.score(df, model))
    held = [i for i in got if got[i]["held_out"]]
    assert 100 < len(held) < 200
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    hits = [i for i in held if i % 4 == 0 and got[i]["predicted"]]
    assert np.mean([any(x in rows[i][1][got[i]["sentence_start"] : got[i]["sentence_end"]] for x in ("grumble", "snarkle")) for i in hits]) > 0.95
    assert all(0 <= r["score"] <= 1 for df in (docs, odd) for r in toxicity.score(df, model).collect())
    assert toxicity.train(df, lab.limit(0))[1] == -20.0
    assert not toxicity.score(df.limit(0), model).collect()


def test_toxicity_gradient():
    words, sizes, y = [np.array([1, 2, 3], np.int32)] * 4 + [np.array([2, 3], np.int32)] * 12, [np.array([2, 1], np.int32)] * 4 + [np.array([1, 1], np.int32)] * 12, np.array([1] * 4 + [0] * 12)
    w, b = toxicity.fit(words, sizes, y)
    assert w[1] > 1 and w[2] == 0 and b < -1


def test_pipeline_stages(spark, table):
    import corpus_pipeline

    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        before, after = texts_of(docs), texts_of(out)
        if name == "quality":
            verdict = by_id(quality.repetition_rules(docs))
            assert set(after) == {k for k in before if verdict[k]["kept"]} and all(after[k] == before[k] for k in after)
        elif name == "simhash":
            assert set(after) == {k for k, (_, c) in brute.simhash(before.items()).items() if k == c}
        elif name == "pii":
            assert set(after) == set(before) and not any(brute.pii(t) for t in after.values())
            assert all(after[k] == before[k] for k in after if not brute.pii(before[k]) and "<" not in after[k])
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        else:
            dealt = by_id(mixing.mix(docs, Scratch(spark, "t")))
            words = {}
            for r in out.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
                assert before[r["doc_id"]].startswith(r["text"])
            assert words == {k: r["taken"] for k, r in dealt.items() if r["taken"]}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(brute.ids(tok, r["text"], 0)) for r in docs.collect())


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        docs.count()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.limit(0), "").collect()
        stage(spark, odd, "").collect()


def test_pipeline_near_copies_of_odd_rows(spark, odd):
    import corpus_pipeline

    def kept(df):
        return sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())

    assert kept(odd) == [(-1, ""), (3, _LONG), (3, "other text")]
    near = spark.createDataFrame([(None, _LONG + " more"), (None, _LONG), (None, "alone"), (None, "alone")], "doc_id long, text string")
    groups = {c for _, c in brute.simhash(enumerate([_LONG + " more", _LONG, "alone"])).values()}
    assert len(kept(near)) == len(groups) and kept(near) == kept(near.repartition(3))


class Planned(Scratch):
    """A scratch folder that keeps the plan of each table it writes."""

    plans: list[str] = []

    def save(self, df, name="t"):
        self.plans.append(plan_of(df))
        return super().save(df, name)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_broadcasts_nothing(spark, table):
    fps = spark.createDataFrame([(1, 1), (3, 2), (1 << 40, 3)], "fp long, id long")
    assert "Broadcast" not in plan_of(simhash.links(fps))
    Planned.plans = []
    out = simhash.simhash_groups(table, Planned(spark, "t"))
    assert sum("SortMergeJoin" in p for p in Planned.plans) >= 4 and not any("Broadcast" in p for p in [*Planned.plans, plan_of(out)])


def test_pipeline_broadcasts_no_rows(spark, table, monkeypatch):
    import corpus_pipeline

    Planned.plans = []
    monkeypatch.setattr(corpus_pipeline, "Scratch", Planned)
    near = plan_of(corpus_pipeline.drop_near_copies(spark, table, ""))
    assert near.count("SortMergeJoin") >= 2 and not any("Broadcast" in p for p in [*Planned.plans, near])
