"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton reads the words of
a document and knows after each word the longest suffix that occurs in some item. A match of ``window`` words, or of a
whole shorter item, hits its words.

Null and empty texts have no words and no hits; items without words are left out. Items with a null id hit words but
are not listed. Repeated rows are judged one by one, repeated item ids are listed once, an empty table of documents or
items gives an empty result or no hits. Very long texts are read whole, very long
items in overlapping parts. Further columns are kept untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import map_texts, text_slices

WINDOW = 10
#: Bytes of item texts in one automaton; more items are read in further passes over the documents.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TO_SPACE).split()


class ItemAutomaton:
    """Suffix automaton over word ids of all items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            if ids:
                coded.append((item_id, ids))
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._add(last, w)
        self.shortest = min([window, *(len(ids) for _, ids in coded)], default=window)
        self._mark(coded)

    def _add(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, w: int, to: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[to]))
        self.link[clone], self.link[to] = self.link[to], clone
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = clone
            at = self.link[at]
        return clone

    def _holding(self, state: int, n: int) -> int:
        """The state on the suffix path that stands for the last ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """``window_state`` of each state; the items of each window; short texts, each once, with their items.

        ``short_at`` leads to the next state on the suffix path that holds short texts, of which a path meets fewer than
        ``window``.
        """
        n = self.window
        self.items: dict[int, set[str | None]] = {}
        own: dict[int, dict[int, set[str | None]]] = {}
        for item_id, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i >= n - 1:
                    state_n = self._holding(state, n)
                    self.items.setdefault(state_n, set()).add(item_id)
            if len(ids) < n:
                own.setdefault(self._holding(state, len(ids)), {}).setdefault(len(ids), set()).add(item_id)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.window_state = [0] * len(self.link)
        self.short = own
        self.short_at = [0] * len(self.link)
        for s in order:
            up = self.link[s]
            if self.length[s] >= n:
                self.window_state[s] = self.window_state[up] if self.length[up] >= n else s
            self.short_at[s] = s if s in own else self.short_at[up]

    def matches(self, words: list[bytes]) -> tuple[list[int], set[str | None]]:
        """Flat ``start, end`` word spans of the hits, merged, and the ids of the items."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        spans: list[int] = []
        hit: set[tuple[int, int]] = set()
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo >= self.shortest:
                self._read(ids[lo:hi].tolist(), lo, spans, hit)
        found = [self.short[s][size] if size else self.items.get(s, set()) for s, size in hit]
        return merged(spans), set().union(*found)

    def _read(self, ids: list[int], base: int, spans: list[int], hit: set[tuple[int, int]]) -> None:
        """Adds the spans, and the states of the windows (with 0) and short texts (with their length) that occur."""
        state = matched = 0
        following, link, length, n = self.next, self.link, self.length, self.window
        for i, w in enumerate(ids, base + 1):
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(w)
            state, matched = to or 0, matched + 1 if to else 0
            if matched >= n:
                hit.add((self.window_state[state], 0))
                spans += (i - n, i)
            at = self.short_at[state]
            while at:
                for size in self.short[at]:
                    if size <= matched:
                        hit.add((at, size))
                        spans += (i - size, i)
                at = self.short_at[link[at]]


def merged(spans: list[int]) -> list[int]:
    """Union of flat half-open spans."""
    out: list[int] = []
    for lo, hi in sorted(zip(spans[::2], spans[1::2])):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += (lo, hi)
    return out


def without_spans(text: str, spans: list[int], min_words: int) -> str:
    """``text`` without the word spans of at least ``min_words`` words; a line break stands in their place."""
    raw = text.encode()
    placed = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for lo, hi in zip(spans[::2], spans[1::2]):
        if hi - lo >= min_words:
            out.append(raw[at:placed[lo][0]])
            at = placed[hi - 1][1]
    return b"\n".join([*out, raw[at:]]).decode()


def _pass(automaton, last: bool, min_words: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            for part in text_slices(batch):
                yield part_of(own, part)

    def part_of(own: ItemAutomaton, part: pa.RecordBatch) -> pa.RecordBatch:
        cols = {"spans": [], "items": [], "n_words": [], "n_hit": [], "items_sha256": [], "left": []}
        for text, spans, items in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "items"))):
            words = words_of(text or "")
            more, found = own.matches(words)
            spans = merged(spans + more) if spans else more
            items = sorted(found.union(items) - {None})
            cols["spans"].append(spans)
            cols["items"].append(items)
            cols["n_words"].append(len(words))
            cols["n_hit"].append(sum(spans[1::2]) - sum(spans[::2]))
            cols["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest() if last else None)
            cols["left"].append((without_spans(text, spans, min_words) if spans else text) if last and with_text else None)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.string()]
        keep = [i for i, c in enumerate(part.schema.names) if c not in cols]
        return pa.RecordBatch.from_arrays(
            [*(part.column(i) for i in keep), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))],
            names=[*(part.schema.names[i] for i in keep), *cols],
        )

    return run


def item_parts(items: DataFrame, window: int, size: int) -> DataFrame:
    """``item_id, text`` with texts over ``size`` bytes cut into word runs that share ``window - 1`` words: no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = [(i, p) for i, text in zip(*(c.to_pylist() for c in part.columns)) for p in cut_item(text or "", window, size)]
                ids, texts = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    return map_texts(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item_id string, text string")


def cut_item(text: str, window: int, size: int) -> Iterator[str]:
    if len(text.encode()) <= size:
        yield text
        return
    words = words_of(text)
    ends = np.cumsum([len(w) + 1 for w in words])
    at = 0
    while at < len(words):
        begin = int(ends[at]) - len(words[at]) - 1
        stop = max(at + window, int(np.searchsorted(ends, begin + size, "right")))
        yield b" ".join(words[at:stop]).decode()
        if stop >= len(words):
            return
        at = stop - window + 1


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, min_words: int = 0, with_text: bool = True) -> DataFrame:
    """One row per document: ``_doc`` (all its columns), ``n_words``, ``n_hit``, ``items`` (ids as strings),
    ``items_sha256``, ``spans`` (flat word spans) and ``left``, the text without the spans of ``min_words`` words or more.

    An automaton holds about ``block_bytes`` of items, repeated rows once and long texts in parts, which bounds the broadcast. More items make more passes over the
    documents; each pass is written before the next.
    """
    spark = docs.sparkSession
    texts = materialize(item_parts(items, window, max(block_bytes // 16, 64)).distinct())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.select(
        F.struct("*").alias("_doc"), "text",
        F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = "_doc " + out.schema["_doc"].dataType.simpleString() + ", text string, spans array<int>, items array<string>, n_words bigint, n_hit bigint, items_sha256 string, left string"
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in texts.filter(block == b).collect()]
        automaton = spark.sparkContext.broadcast(ItemAutomaton(rows, window))
        last = b == blocks - 1
        out = map_texts(out, _pass(automaton, last, min_words, with_text), schema)
        if not last:
            out = materialize(out).select("_doc", "text", "spans", "items")
    return out


def digest(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the number of words and hits and the digest of the items that occur in it."""
    found = scan(docs.select("doc_id", "text"), items, window, with_text=False)
    return found.select(
        "_doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans; documents with more than ``max_coverage`` of their words hit are dropped.

    ``n_chars``, if there is such a column, follows the text.
    """
    found = scan(docs, items, window).filter(F.col("n_hit") <= F.col("n_words") * max_coverage)
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_hit") > 0, F.length("left").cast("bigint")).otherwise(F.col("_doc.n_chars"))
    return found.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
