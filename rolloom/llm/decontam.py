"""Benchmark decontamination with suffix arrays over shards of the training text.

Words are numbered in the vocabulary of the benchmark, 0 for any other word. The windows
of the benchmark are ranked once a task: ranks of 1, 2, 4, ... words follow from pairs of
ranks of half as many, and the sorted keys of whole windows are the benchmark's suffix
array. Each task turns its documents, some megabytes at a time, into a shard. A suffix of
the shard stays only while its first 1, 2, 4, ... words have a rank in the benchmark;
those that are left are sorted by their key, as the shard's suffix array, and the equal
range of each in the benchmark's is found by binary search. So a shard costs what its own
words cost, whatever the size of the benchmark. Runs of matches along a diagonal give the
longest verbatim match and its place.

The benchmark goes to the tasks in blocks of about ``block_words`` words (an item with
more is parted, with an overlap of a window less one word), one after another: the driver
holds one block at a time. With several blocks, documents are written once with a row
number, each block's findings are written too, and joined by that number. The training
text is never shuffled.

Edge cases: null and empty texts have no words and no hits; null and wordless items
have no window; an item of fewer than ``window`` words is one window; rows of the
benchmark with the same id are one item of several texts, a null id counts as the
empty string; repeated documents are judged alike, one row each; texts of any length are
searched whole; extra columns are passed over by the report and kept by
``decontaminate``, whatever their names; an empty table of either kind gives all
documents no hits. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, hash_words, map_texts, materialize, release

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: In UTF-8 the same words: every byte parts words but digits, letters and those of other scripts.
_CODES = byte_codes([b for b in range(128) if not chr(b).isalnum()])
FIELDS = "n_words long, hits array<int>, items array<string>, longest int, longest_start int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


class Tests:
    """A block of the benchmark: its words as numbers, ranks of 1, 2, 4, ... words, and
    the sorted keys of its windows."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int) -> None:
        self.ids = [i for i, _ in items]
        hashes, sizes = hash_words([t for _, t in items], _CODES)
        self.vocabulary = np.unique(hashes)
        places = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        text[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = np.searchsorted(self.vocabulary, hashes) + 1
        lengths = np.minimum(sizes, window)
        count = np.where(lengths > 0, sizes - lengths + 1, 0)
        self.owners = np.repeat(np.arange(len(sizes)), count)
        self.starts = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + places[self.owners]
        self.lengths = lengths[self.owners]
        #: for each size its sorted pair keys, and by how much a first rank is multiplied
        self.levels: list[tuple[np.ndarray, int]] = []
        ranks, rank, depth = {1: text}, text, 1
        while 2 * depth <= int(self.lengths.max(initial=1)):
            base = int(rank.max(initial=0)) + 1
            follow = np.zeros_like(rank)
            follow[:-depth] = rank[depth:]
            pair = np.where((rank > 0) & (follow > 0), rank * base + follow, 0)
            keys = np.unique(pair[pair > 0])
            rank = np.where(pair > 0, np.searchsorted(keys, pair) + 1, 0)
            depth *= 2
            ranks[depth] = rank
            self.levels.append((keys, base))
        #: for each length of windows the sorted keys, the windows in that order, and the multiplier
        self.windows = {}
        for m in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == m)
            p = 1 << (m.bit_length() - 1)
            base = int(ranks[p].max(initial=0)) + 1
            key = ranks[p][self.starts[own]] * base + ranks[p][self.starts[own] + m - p]
            order = np.argsort(key, kind="stable")
            self.windows[m] = (key[order], own[order], base)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words of the vocabulary from 1 on, 0 for any other."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def search(shard: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's suffixes that begin with a window, by place: place, the window's length,
    and the range low..high of ``tests.windows`` that holds the windows they begin with."""
    found: list[tuple] = []
    rank, alive, depth = shard, np.flatnonzero(shard), 1
    for level in range(len(tests.levels) + 1):
        for m, (keys, _, base) in tests.windows.items():
            if 1 << (m.bit_length() - 1) != depth:
                continue
            places = alive[alive + m <= len(shard)]
            second = rank[places + m - depth]
            places, second = places[second > 0], second[second > 0]
            own = rank[places] * base + second
            order = np.argsort(own, kind="stable")  # the suffix array of what can match
            own, places = own[order], places[order]
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            some = high > low
            found.append((places[some], np.full(int(some.sum()), m), low[some], high[some]))
        if level == len(tests.levels):
            break
        keys, base = tests.levels[level]
        alive = alive[alive + 2 * depth <= len(shard)]
        follow = rank[alive + depth]
        alive, follow = alive[follow > 0], follow[follow > 0]
        pair = rank[alive] * base + follow
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        alive, at = alive[known], at[known]
        rank = np.zeros(len(shard), np.int64)
        rank[alive] = at + 1
        depth *= 2
    if not found:
        return (np.empty(0, np.int64),) * 4
    place, size, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], size[order], low[order], high[order]


#: Matches (a place and a window) that are looked at together, but for those of one document.
MOST_MATCHES = 1_000_000


def _scanner(tests: Tests):
    def scan(texts: list) -> dict:
        hashes, sizes = hash_words(texts, _CODES)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        shard = np.zeros(int((sizes + 1).sum()), np.int64)
        shard[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = tests.numbers(hashes)
        place, size, low, high = search(shard, tests)
        n = len(texts)
        hits, items, longest, first = [[]] * n, [[]] * n, np.zeros(n, np.int32), np.full(n, -1, np.int32)
        mark = np.zeros(len(shard) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + size, -1)
        hit = np.flatnonzero(np.cumsum(mark)[:-1])
        hit_doc = np.searchsorted(starts, hit, "right") - 1
        doc = np.searchsorted(starts, place, "right") - 1
        for d, some in zip(*_runs(hit_doc), strict=True):
            hits[d] = (hit[some] - starts[d]).tolist()
        total = np.cumsum(high - low)
        docs, parts = _runs(doc)
        at = 0
        while at < len(docs):  # documents with about MOST_MATCHES matches
            before = total[parts[at].start - 1] if parts[at].start else 0
            to = at + 1
            while to < len(docs) and total[parts[to].stop - 1] - before <= MOST_MATCHES:
                to += 1
            some = slice(parts[at].start, parts[to - 1].stop)
            count = high[some] - low[some]
            index = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[some], count)
            places, lengths, owner_doc = (np.repeat(x[some], count) for x in (place, size, doc))
            windows = np.empty(len(index), np.int64)
            for m, (_, own, _) in tests.windows.items():
                windows[lengths == m] = own[index[lengths == m]]
            for d, i in np.unique(np.stack([owner_doc, tests.owners[windows]]), axis=1).T:
                if not items[d]:
                    items[d] = []
                items[d].append(tests.ids[i])
            diagonal = tests.starts[windows] - places
            order = np.lexsort((places, diagonal))
            p, g, m, d = places[order], diagonal[order], lengths[order], owner_doc[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(p) != 1)]))
            length = np.maximum.reduceat(p + m, new) - p[new]
            best = np.lexsort((p[new], -length, d[new]))
            own = d[new][best]
            lead = best[np.concatenate([[True], np.diff(own) != 0])]
            longest[d[new][lead]], first[d[new][lead]] = length[lead], p[new][lead] - starts[d[new][lead]]
            at = to
        return {"n_words": sizes, "hits": hits, "items": [sorted(set(x)) for x in items], "longest": pa.array(longest), "longest_start": pa.array(first)}

    return scan


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[slice]]:
    """The distinct values and where each stands."""
    if not len(sorted_values):
        return [], []
    begin = np.flatnonzero(np.concatenate([[True], np.diff(sorted_values) != 0]))
    ends = np.concatenate([begin[1:], [len(sorted_values)]])
    return sorted_values[begin].tolist(), [slice(a, b) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]


def _parted(window: int, block_words: int):
    """Items as texts of at most ``block_words`` words, with all windows."""

    def part(texts: list) -> dict:
        out = []
        for t in texts:
            ws = words(t) if t and len(t) > block_words else None  # a word has a character at least
            if ws is None or len(ws) <= block_words:
                out.append([t])
            else:
                step = max(1, block_words - window + 1)
                out.append([" ".join(ws[k : k + block_words]) for k in range(0, max(1, len(ws) - window + 1), step)])
        return {"parts": out}

    return part


def find_overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000, piece_bytes: int = 4 << 20) -> DataFrame:
    """For each document ``n_words, hits`` (places of hit words)``, items`` (ids, sorted),
    ``longest, longest_start`` (the longest verbatim match in words); ``carry`` as in map_texts."""
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0

    def scanned(items: list, given: DataFrame, kept: Sequence[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)  # a block
        return map_texts(given, text_col, kept, FIELDS, lambda: _scanner(Tests(sent.value, window)), piece_bytes)

    if total <= block_words:  # characters, so there are no more words than that
        return scanned(sorted(tuple(r) for r in named.collect()), docs, carry)
    parts = map_texts(named, "text", ["id"], "parts array<string>", lambda: _parted(window, block_words)).select(F.col("__id").alias("id"), F.explode("parts").alias("text"))
    parts = materialize(parts.withColumn("n", F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))), "overlap-items")
    blocks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_words))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    if blocks == 1:
        return scanned(sorted((r.id, r.text) for r in parts.collect()), docs, carry)
    marked = materialize(docs.select(*carry, F.col(text_col).alias("__text")).withColumn("__row", F.monotonically_increasing_id()), "overlap-documents")
    found = []
    for k in range(blocks):
        items = sorted((r.id, r.text) for r in parts.where(F.col("block") == k).select("id", "text").collect())
        sent = spark.sparkContext.broadcast(items)
        made = map_texts(marked, "__text", ["__row"], FIELDS, lambda sent=sent: _scanner(Tests(sent.value, window)), piece_bytes)
        found.append(materialize(made if k == 0 else made.where("longest > 0"), "overlap-block"))
        sent.destroy()
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    best = F.max(F.struct("longest", (-F.col("longest_start")).alias("back")))
    joined = union.groupBy("____row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),  # a list for each block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("best"),
    )
    kept = marked.select(F.col("__row").alias("____row"), *[F.col(c).alias(f"__{c}") for c in carry])
    out = kept.join(joined, "____row").select(*[f"__{c}" for c in carry], "n_words", "hits", "items", F.col("best.longest").alias("longest"), (-F.col("best.back")).alias("longest_start"))
    result = materialize(out, "overlap-found")
    for f in (*found, marked, parts):
        release(f)
    return result


def overlap_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start``."""
    found = find_overlap(docs, benchmark, carry=[id_col], **options)
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col(f"__{id_col}").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "longest_start",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    names = docs.columns
    found = find_overlap(docs, benchmark, carry=names, **options)
    return found.where(F.size("hits") == 0).select(*[F.col(f"__{c}").alias(c) for c in names])


def brute_force(texts: Sequence[str | None], items: Sequence[tuple[str, str | None]], window: int = 10) -> list[dict]:
    """The same findings by comparing every window with every place (small fixtures)."""
    out = []
    for t in texts:
        ws, hit, got = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            m = min(window, len(iw))
            for j in range(len(iw) - m + 1 if m else 0):
                for k in range(len(ws) - m + 1):
                    if ws[k : k + m] == iw[j : j + m]:
                        hit |= set(range(k, k + m))
                        got.add(i)
        out.append({"n_words": len(ws), "n_hit": len(hit), "n_items": len(got), "items_sha256": hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()})
    return out
