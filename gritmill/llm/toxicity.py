"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A document is toxic if one of its sentences is: P = 1 - prod(1 - p_s), with p_s logistic in the sentence's words. Only the
documents' labels are known; the gradient of their likelihood reaches the sentences through the noisy-or. The model is
fitted on the driver from at most `max_train` labelled documents of at most `max_words` words in all (a seeded choice);
scoring covers every whole text and names the sentence that is likeliest to offend.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import text_bytes

BITS = 18
_END = re.compile(rb"[.!?\n]+")
_TRIM = b"\"'`,;:()[]{}<>|*#$%&/_-+=~"


def buckets(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its beginnings of four to six characters (stems that take many endings)."""
    w = word.strip(_TRIM).lower()
    text = w.decode(errors="ignore")
    mask = (1 << BITS) - 1
    return (zlib.crc32(w) & mask, *(zlib.crc32(b"%d^" % n + text[:n].encode()) & mask for n in (4, 5, 6) if len(text) > n))


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte spans between sentence ends that hold a word; a text without any gives one empty span."""
    spans, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            spans.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        spans.append((at, len(text)))
    return spans or [(0, 0)]


def _features(batches):
    schema = pa.schema([("toxic", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary())])
    for b in batches:
        words, sizes = [], []
        for t in text_bytes(b.column(1)):
            each = [[x for w in t[a:z].split() for x in buckets(w)] for a, z in sentences(t)]
            words.append(np.array([x for s in each for x in s], np.int32).tobytes())
            sizes.append(np.array([len(s) for s in each], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], schema=schema)


def fit(words: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 2e-5, min_docs: int = 4) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) that maximise the penalised likelihood of the labels under the noisy-or."""
    weights = np.zeros(1 << BITS)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return weights, 20.0 if share == 1 else -20.0
    size = np.concatenate(sizes)
    doc_of = np.repeat(np.arange(len(labels)), [len(s) for s in sizes])
    # buckets in fewer than min_docs documents tell nothing of others; document by document, as all features at once are large
    df, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for w, y in zip(words, labels.tolist(), strict=True):
        seen = np.unique(w)
        df[seen] += 1
        hits[seen] += y
    # a noisy-or lives on evidence for: what occurs in toxic documents no more than by chance stays out
    wanted = (df >= min_docs) & (hits > share * df + 2 * np.sqrt(share * (1 - share) * df))
    tokens, places, first = [], [], 0
    for w, s in zip(words, sizes, strict=True):
        keep = np.flatnonzero(wanted[w])
        tokens.append(w[keep])
        places.append((first + np.searchsorted(np.cumsum(s), keep, side="right")).astype(np.int32))
        first += len(s)
    token, sent = np.concatenate(tokens), np.concatenate(places)
    used, column = np.unique(token, return_inverse=True)
    w, bias = np.zeros(len(used)), float(np.log(share) - np.log(len(size) / len(labels)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    positive = labels == 1
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sent, weights=w[column], minlength=len(size))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels))
        whole = np.maximum(-np.expm1(quiet), 1e-9)
        back = np.where(positive, -(1 - whole) / whole, 1.0)[doc_of] * p
        g = np.bincount(column, weights=back[sent], minlength=len(used)) / len(labels) + penalty * np.sign(w)
        gb = back.sum() / len(labels)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    weights[used] = w
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_words: int = 40_000_000, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Fits on rows of `labels` (0 or 1; null and other values are left out) whose crc32(doc_id) mod 4 is not 2.

    Where a doc_id's labels clash it counts as toxic; repeated rows of a text count each. No labels, or labels of one kind
    alone, give a model that says so of every text. A very long text counts with all its words, up to max_words in all.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_train)  # the documented bound
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, words binary, sizes binary")
    got = sorted(((r["toxic"], bytes(r["words"]), bytes(r["sizes"])) for r in rows.collect()), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    got = got[:: max(1, -(-sum(len(r[1]) // 4 for r in got) // max_words))]
    return fit([np.frombuffer(r[1], np.int32) for r in got], [np.frombuffer(r[2], np.int32) for r in got], np.array([r[0] for r in got], np.int64))


def _scorer(weights: np.ndarray, bias: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence_score", pa.float64())])
    values = weights.astype(np.float32)

    def run(batches):
        known: dict[bytes, float] = {}

        def weigh(word: bytes) -> float:
            if len(known) > 200_000:
                known.clear()
            x = known[word] = float(values[list(buckets(word))].sum())
            return x

        get = known.get
        for b in batches:
            out = []
            for t in text_bytes(b.column(1)):
                spans = sentences(t)
                z = [bias + sum([x if (x := get(w)) is not None else weigh(w) for w in t[a:e].split()]) for a, e in spans]
                p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
                k = int(np.argmax(p))
                out.append((float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), *spans[k], float(p[k])))
            cols = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the byte span and score of its likeliest sentence.

    Null and empty texts are one sentence without words. Repeated rows give rows alike; held_out is null for a null
    doc_id. Only doc_id and text are read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(*model), "doc_id long, score double, start long, end long, sentence_score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.col("start").alias("sentence_start"), F.col("end").alias("sentence_end"), "sentence_score")
