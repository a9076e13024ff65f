"""SimHash near-duplicates within two bits, by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two bits, one of the
segments differs in at most one. The index therefore holds, of a segment, the whole value and each variant with one bit
struck out; two fingerprints that meet in a variant differ in that very bit (the two sides of the equality join hold the
two values of the struck bit), and every pair that meets is verified by its whole distance. To keep buckets bounded
however many fingerprints share a segment, each index key also holds a part of the other segment that must then be equal:
one of its halves when one further bit is allowed, one of three parts when two are. A key leaves at most 22 bits free, and
meetings are between distinct fingerprints, so large groups of copies cost one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import Scratch, sorted_join, text_bytes
from gritmill.llm.components import connected_components
from gritmill.llm.tokens import release

#: Bits 0 to 7 (the least first) of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PARTS = ((0, 11), (11, 11), (22, 10))
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit integer; no words give 0.

    Words are runs without ASCII white space after lowering A-Z; a shingle is `width` words joined by blanks, repeats
    included; fewer words make one shingle. A bit is 1 if it is set in over half of the shingles' XXH64 values.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    release()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([fingerprint(t) for t in text_bytes(b.column(1))], pa.int64())], schema=_FP)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row of `docs`; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(side: int):
    """Index entries of column fp for one side of the join: key bigint, unique by tag; wild entries only where the struck bit equals `side`."""
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))

    def entry(tag: int, whole, part):
        return F.lit(tag << 55).cast("long").bitwiseOR(F.shiftleft(whole, 22)).bitwiseOR(part)

    def part(x, at, bits):
        return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    found, tag = [], 0
    for whole, other in ((high, low), (low, high)):
        for at, bits in _PARTS:
            found.append(entry(tag, whole, part(other, at, bits)))
            tag += 1
    for j in range(32):
        struck = high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j)).cast("long"))
        mine = F.shiftrightunsigned(high, j).bitwiseAND(F.lit(1).cast("long")) == side
        for at in (0, 16):
            found.append(F.when(mine, entry(tag, struck, part(low, at, 16))))
            tag += 1
    return F.array_compact(F.array(*found))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): ids of distinct fingerprints (fp, id) that differ in one or two bits; a pair may come more than once.

    Tags: 0 to 5 one whole segment and a third of the other; from 6 on one bit of the high segment struck, with a half of
    the low one. What is not found here differs in two bits of the low segment (tags 0 to 2) or of the high one (3 to 5).
    """
    left = fps.select(F.col("fp").alias("f"), F.col("id").alias("a"), F.explode(_keys(0)).alias("key"))
    right = fps.select(F.col("fp").alias("g"), F.col("id").alias("b"), F.explode(_keys(1)).alias("key"))
    wild = F.shiftrightunsigned("key", 55) >= 6
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).between(1, 2)
    return left.join(sorted_join(right), "key").where(near & (wild | (F.col("f") < F.col("g")))).select("a", "b")


def simhash_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null text counts as empty (fingerprint zero, which links like any other). A row without doc_id gets its fingerprint
    and component_id null and links nothing. Repeated rows come back as often as they are there. An empty table gives no
    rows; other columns are ignored.
    """
    rows = scratch.save(fingerprints(docs, id_col, text_col), "fp")
    fps = scratch.save(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "fps")
    found = connected_components(links(fps), scratch)
    of = fps.join(sorted_join(found), F.col("id") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "id").alias("component_id"))
    joined = rows.join(sorted_join(of), F.col("fp") == F.col("of_fp"), "left")
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
