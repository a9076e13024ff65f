"""Plain versions of the operators, for small inputs, written without looking at how the operators work."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def vectors(rows, threshold=0.93):
    """{vec_id: (n_links, component_id, kept)} for rows (vec_id, embedding, label) with distinct ids."""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[i] = (x / np.sqrt(x @ x), label)
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold]
    links = collections.Counter(x for p in pairs for x in p)
    comp = components([i for i, _, _ in rows], pairs)
    return {i: (links[i], comp[i], i == comp[i]) for i, _, _ in rows}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    """Base spans as kind:start:end."""
    found = []
    for rank, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(found)]


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    """{doc_id: (hex, component)} for (doc_id, text)."""
    fp = {i: fingerprint(t) for i, t in rows}
    comp = components(list(fp), [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    return {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def repeats(texts, length=400):
    """[(n_bytes, n_removed, n_spans, sha256)] for byte strings."""
    starts = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append((d, p))
    cover = [np.zeros(len(t) + 1, bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, p in places:
                cover[d][p : p + length] = True
    out = []
    for t, c in zip(texts, cover, strict=True):
        c = c[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        out.append((len(t), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, length=51):
    """Per text: the number of its windows of that many words that another text has too."""
    words = [t.split() for t in texts]
    places = {}
    for i, w in enumerate(words):
        for p in range(len(w) - length + 1):
            places.setdefault(tuple(w[p : p + length]), set()).add(i)
    return [sum(len(places[tuple(w[p : p + length])]) > 1 for p in range(len(w) - length + 1)) for w in words]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if n[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def common_words(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
