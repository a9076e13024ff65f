"""Token-id files coded by a static range asymmetric numeral system (Duda, 2013), in independent interleaved blocks.

One frequency table, counted over all ids, serves all blocks. A block codes its ids in `lanes` interleaved streams whose
64-bit states renormalise by 32-bit words into one word stream, so that each step is a few array operations. A block can
be decoded alone: its row holds the lanes' states (the checkpoint to start from), the documents and their lengths, and
CRC-32s of the payload and of the ids. A long block, such as one of a very long text, has further checkpoints, each with
the ids and words before it and the states there, so that its parts can be decoded side by side.

A folder holds all that reading needs, in Parquet files written by Spark's committer (any store that Spark reaches, and
safe when executors are lost): `format` (one row: version, bits, lanes, ids between checkpoints), `table` (id, frequency)
and `blocks`, in ascending order of (part, block), whose index columns are read without the payload.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gritmill.llm.common import Scratch, text_bytes, tidy
from gritmill.llm.tokens import pieces, release

LANES = 2048
_LOW = np.uint64(1 << 31)


class Table:
    """Frequencies scaled to a sum of 2^bits, at least 1 for every symbol that occurs."""

    def __init__(self, counts: dict[int, int]):
        symbols = np.array(sorted(counts), np.int64)
        raw = np.array([counts[int(s)] for s in symbols], np.float64)
        bits = min(24, max(12, len(symbols).bit_length() + 3))
        total = 1 << bits
        freq = np.maximum(1, np.floor(raw / max(raw.sum(), 1) * (total - len(symbols)))).astype(np.int64)
        if len(freq):
            freq[int(np.argmax(freq))] += total - int(freq.sum())
        self._set(bits, symbols, freq)

    @classmethod
    def of(cls, bits: int, symbols: np.ndarray, freq: np.ndarray) -> Table:
        """A table that was scaled before."""
        table = cls.__new__(cls)
        table._set(bits, symbols, freq)
        return table

    def _set(self, bits: int, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.bits = bits
        self.symbols = symbols.astype(np.uint32)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.index = np.zeros(size, np.int64)
        self.index[symbols] = np.arange(len(symbols))
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(symbols), dtype=np.int32), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES) -> tuple[bytes, bytes]:
    """(states, words) of the ids; lane j codes ids j, j + lanes, ..."""
    return encode_marked(ids, table, lanes, 0)[:2]


def encode_marked(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[bytes, bytes, list[tuple[int, int, bytes]]]:
    """(states, words, checkpoints) of the ids.

    A checkpoint stands before each multiple of `every` ids (a multiple of lanes; 0: none): ids and words before it, states.
    """
    n = len(ids)
    k = table.index[ids]
    freq, start = table.freq[k], table.start[k]
    state = np.full(lanes, _LOW, np.uint64)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    words, marks, written = [], [], 0
    for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        m = min(lanes, n - at)
        f, c, x = freq[at : at + m], start[at : at + m], state[:m]
        full = x >= (f << top)
        words.append(x[full].astype(np.uint32))
        written += len(words[-1])
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:m] = (q << bits) + (x - q * f) + c
        if every and at and at % every == 0:
            marks.append((at, written, state.astype("<u8").tobytes()))
    stream = (np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes()
    return state.astype("<u8").tobytes(), stream, [(at, written - w, s) for at, w, s in marks[::-1]]


def decode(states: bytes, words: bytes, n: int, table: Table, last: bool = True) -> np.ndarray:
    """The n ids that follow a checkpoint, whose words are given from there on; the block ends with them, or goes on."""
    state = np.frombuffer(states, "<u8").copy()
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    lanes, out, used = len(state), np.empty(n, np.uint32), 0
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        x = state[:m]
        slot = x & mask
        k = table.slots[slot.astype(np.int64)]
        out[at : at + m] = table.symbols[k]
        x = table.freq[k] * (x >> bits) + slot - table.start[k]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[used : used + len(low)]
        used += len(low)
        state[:m] = x
    if last and (used != len(stream) or (state != _LOW).any()):
        raise ValueError("a block's words do not end where its ids do")
    return out


def _tokenize(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tok = pieces(path)
        end = int(end_id).to_bytes(tok.width, "little")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tok.ids(t) + end for t in text_bytes(b.column(1))], pa.binary())], schema=schema)

    return run


def _count(width: int):
    def run(batches):
        release()
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in text_bytes(b.column(0)):
                c = np.bincount(np.frombuffer(x, f"<u{width}"))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["id", "n"])

    return run


BLOCK = "part int, block int, inside long, n_tokens long, n_docs int, doc_ids array<bigint>, lengths array<bigint>, states binary, words binary, words_crc32 long, ids_crc32 long, mark_ids array<bigint>, mark_words array<bigint>, mark_states array<binary>"


def _write(table: Table, width: int, block_tokens: int):
    def run(batches):
        release()
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        texts: list[bytes] = []
        size = inside = 0

        def flush():
            ids = np.frombuffer(b"".join(texts), f"<u{width}")
            lanes = min(LANES, max(1, len(ids)))
            states, words, marks = encode_marked(ids, table, lanes, _every(block_tokens) if len(ids) > _every(block_tokens) else 0)
            row = (part, block, inside, len(ids), len(docs), docs, [len(x) // width for x in texts], states, words, zlib.crc32(states + words), zlib.crc32(ids.astype("<u4").tobytes()), *([m[i] for m in marks] for i in range(3)))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                docs.append(doc)
                texts.append(ids)
                size += len(ids) // width
                if size >= block_tokens:
                    yield flush()
                    docs, texts, size, block, inside = [], [], 0, block + 1, inside + size
        if docs:
            yield flush()

    return run


def _every(block_tokens: int) -> int:
    """Ids between checkpoints: about a block's, in whole steps of all lanes."""
    return -(-block_tokens // LANES) * LANES


def segments(row: dict) -> list[tuple[bytes, bytes, int]]:
    """(states, words, ids) of a block's parts between checkpoints; each can be decoded for itself."""
    at, word, states = [0, *row["mark_ids"]], [0, *row["mark_words"]], [row["states"], *row["mark_states"]]
    ends, upto = [*at[1:], row["n_tokens"]], [*word[1:], len(row["words"]) // 4]
    return [(s, row["words"][4 * w : 4 * v], z - a) for s, a, z, w, v in zip(states, at, ends, word, upto, strict=True)]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(table: Table):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in READ.split(", ")])

    def run(batches):
        release()
        for b in batches:
            for row in b.to_pylist():
                if zlib.crc32(row["states"] + row["words"]) != row["words_crc32"]:
                    raise ValueError("a block's payload fails its checksum")
                parts = segments(row)
                ids = np.concatenate([decode(*x, table, k == len(parts) - 1) for k, x in enumerate(parts)]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError("a block's ids fail their checksum")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return run


def write_ids(docs: DataFrame, scratch: Scratch, folder: str, path: str, end_id: int, block_tokens: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files into a folder that doesn't exist yet; `path` is the tokenizer's.

    Texts are tokenized once, into a table of binary ids that is then sorted by doc_id (nulls first) over ranges. Only the
    counts by id, which the vocabulary bounds, reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = scratch.save(rows.mapInArrow(_tokenize(path, end_id), "doc_id long, ids binary"), "ids")
    width = pieces(path).width
    counted = ids.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = Table({r["id"]: r["n"] for r in counted.collect()})
    frequencies = list(zip(table.symbols.tolist(), table.freq.tolist(), strict=True))
    spark.createDataFrame(frequencies, "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    spark.createDataFrame([(1, table.bits, LANES, _every(block_tokens), end_id)], "version int, bits int, lanes int, every long, end_id long").coalesce(1).write.parquet(f"{folder}/format")
    ordered = ids.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", F.length("ids"), F.crc32("ids")).sortWithinPartitions("doc_id", F.length("ids"), F.crc32("ids"))
    ordered.mapInArrow(_write(table, width, block_tokens), BLOCK).write.parquet(f"{folder}/blocks")
    scratch.drop(ids)
    tidy(spark)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from a folder's files alone; start counts the ids of all documents before.

    A block's row has the ids before it in its part; part totals (one number a part) are summed on the driver.
    """
    told = spark.read.parquet(f"{folder}/format").collect()[0]
    if told["version"] != 1:
        raise ValueError(f"files of version {told['version']}")
    found = sorted((r["id"], r["frequency"]) for r in spark.read.schema("id long, frequency long").parquet(f"{folder}/table").collect())
    table = Table.of(told["bits"], np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], np.int64))
    files = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]
    bases = spark.createDataFrame(list(before.items()), "part int, first long")
    within = files.join(F.broadcast(bases), "part").withColumn("base", F.col("first") + F.col("inside"))  # one row of two numbers a part
    return within.select("base", "n_tokens", "doc_ids", "lengths", "states", "words", "words_crc32", "ids_crc32", "mark_ids", "mark_words", "mark_states").mapInArrow(_read(table), READ)


def token_files(docs: DataFrame, scratch: Scratch, path: str, end_id: int = 2, block_tokens: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, read back from files in the scratch folder: doc_id, start, n_tokens, ids_crc32.

    Null or empty text gives the end id alone. Equal doc_ids stand together, null ones first. Other columns are not read;
    an empty table gives no rows. A text is never cut over blocks, so a block is as long as its last text at most; a very
    long one has checkpoints within.
    """
    folder = scratch.folder("rans")
    write_ids(docs, scratch, folder, path, end_id, block_tokens, id_col, text_col)
    return read_ids(docs.sparkSession, folder)
