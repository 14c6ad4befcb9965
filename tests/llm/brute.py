"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return (text or "").encode().lower().decode()


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def repeat_words(ws, n=5):
    seen = Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    hit = set()
    for i in range(len(ws) - n + 1):
        if seen[tuple(ws[i:i + n])] > 1:
            hit |= set(range(i, i + n))
    return len(hit)


def base_rules(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    n_repeat = repeat_words(ws)
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": n_repeat,
        "base_failed": len(ws) < 10 or 100 * n_repeat > 20 * len(ws),
    }


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    hs = [_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words(text)]
    pairs = []
    for a, b in zip(hs, hs[1:]):
        seed = xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()
        pairs.append(_signed(xxhash.xxh64(struct.pack("<q", b), seed=seed).intdigest()))
    return [h % buckets for h in hs + pairs]


def quality(rows, trusted, buckets, smoothing, threshold):
    """rows: (doc_id, text); returns a list of dicts with the base counts, score and kept."""
    raw, target = Counter(), Counter()
    for doc_id, text in rows:
        own = Counter(grams(text, buckets))
        raw += own
        if doc_id is not None and doc_id in trusted:
            target += own
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + smoothing) / (raw[b] * n_target / n_raw + smoothing)) if n_target else 0.0 for b in raw}
    out = []
    for doc_id, text in rows:
        g = grams(text, buckets)
        row = base_rules(text) | {"doc_id": doc_id, "score": sum(ratio[b] for b in g) / max(1, len(g))}
        out.append(row | {"kept": not row["base_failed"] and row["score"] >= threshold})
    return out


def _ids_last(doc_id):
    return (doc_id is None, doc_id or 0)


def line_windows(rows, n=3):
    """rows: (doc_id, text) with distinct texts per id; returns the texts that are left."""
    seen, out = set(), {}
    for at in sorted(range(len(rows)), key=lambda i: _ids_last(rows[i][0])):
        text = rows[at][1]
        if text is None:
            out[at] = None
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        cut = set()
        for k in range(len(full) - n + 1):
            w = tuple(lines[i] for i in full[k:k + n])
            if w in seen:
                cut |= set(full[k:k + n])
            seen.add(w)
        out[at] = "\n".join(x for i, x in enumerate(lines) if i not in cut)
    return [out[i] for i in range(len(rows))]


def shingles(text, k):
    ws = words(lower(text))
    if not ws:
        return frozenset()
    k = min(k, len(ws))
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))


def near_groups(rows, k, percent):
    """rows: (doc_id, text) with ids; returns the least id of each row's group."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: (True, 0))
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)) if find(i) in least else _ids_last(doc_id), _ids_last(doc_id))
    return [None if least[find(i)][0] else least[find(i)][1] for i in range(len(rows))]


def contamination(text, items, window=10):
    """Hit word places and the ids of the items found."""
    ws = test_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        iw = test_words(item)
        n = min(window, len(iw))
        own = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in own:
                hit |= set(range(i, i + n))
                found.add(item_id)
    return len(ws), hit, found


def substrings(rows, n=13):
    """rows: (doc_id, text); returns (n_words, n_removed, sha256 of the kept words)."""
    least, out = {}, []
    for doc_id, text in rows:
        ws = words(text)
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i:i + n])
            least[w] = min(least.get(w, _ids_last(doc_id)), _ids_last(doc_id))
    for doc_id, text in rows:
        ws, cut = words(text), set()
        for i in range(len(ws) - n + 1):
            if least[tuple(ws[i:i + n])] < _ids_last(doc_id):
                cut |= set(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(ws) if i not in cut)
        out.append((len(ws), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_strings(texts, n):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        cut = [False] * len(r)
        for i in range(len(r) - n + 1):
            if count[r[i:i + n]] > 1:
                cut[i:i + n] = [True] * n
        spans = sum(c and (i == 0 or not cut[i - 1]) for i, c in enumerate(cut))
        kept = bytes(b for b, c in zip(r, cut) if not c)
        out.append((len(r), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out
