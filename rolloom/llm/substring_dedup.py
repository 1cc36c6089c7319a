"""Near-duplicate passages by compact windows.

Tokens are 5-word shingles. For each of ``hashes`` hash functions the Cartesian tree
over a text's token hashes cuts it into compact windows (l, c, r): every passage
within l..r that holds c has the hash of token c as its min-hash. Only windows as
long as the shortest passage are kept, about two for every such length. Windows of
different texts with the same min-hash are lined up at their centres, and their
intervals are intersected; where ``words`` words remain, the two texts have a
candidate passage. Two passages of similarity s agree under one of the hashes with
probability 1 - (1 - s) ** hashes, and equal ones always do.

Groups of windows are split by the token half a passage after the centre, and once more by
the one before it: whichever place the centre has in a passage of the least length, one of
the two lies within it (``spans``). What is split so is joined as stars: each member with
the one of the smallest document id. So a passage that very
many texts share costs rows in proportion to their number. Members that fail
verification against it, or whose verified passage does not hold their centre, meet again
without it, as long as hubs find somebody. What is left then are members that are not like
their hubs. Two passages that are similar enough share a certain number of tokens within
reach of the centre, so these members meet by a prefix-filter join over just those tokens,
the rarest of the min-hash first: tokens of a line that all have come last and bring
nobody together, and of tokens that the same members have, as around one change of words,
one alone is joined on. Verification aligns the passages token by token.

Equal texts are one class and found without windows. Windows travel packed by range
of min-hash; tokens travel only for classes with a candidate, cut to 32 bits (a chance
agreement of single tokens cannot make a passage, which needs some forty of them).

Edge cases: null and empty texts and texts shorter than a passage have no windows;
equal short texts are not passages and are not reported; equal texts of at least
``words`` words are; repeats inside one text are not reported; repeated rows count as
equal texts; null ids are kept as null, after all others; texts of any length are
searched whole; extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, mix64, pieces
from .jaccard_join import _filter_bits, shingle_rows

SIZE = 5
_SEED = np.uint64(0xA0761D6478BD642F)


def compact_windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the Cartesian trees over the runs begin..end (ends
    excluded) that span ``least`` places. All trees grow level by level; of equal
    values the first is the root."""
    places = max(1, int(len(values)).bit_length())
    low = np.uint64((1 << places) - 1)
    keyed = np.concatenate([(values & ~low) | np.arange(len(values), dtype=np.uint64), [np.uint64(2**64 - 1)]])
    left, centre, right = [], [], []
    keep = end - begin >= least
    begin, end = begin[keep], end[keep]
    while len(begin):
        at = np.stack([begin, end], axis=1).ravel()
        c = (np.minimum.reduceat(keyed, at)[::2] & low).astype(np.int64)
        left.append(begin)
        centre.append(c)
        right.append(end - 1)
        begin, end = np.concatenate([begin, c + 1]), np.concatenate([c, end])
        keep = end - begin >= least
        order = np.argsort(begin[keep], kind="stable")
        begin, end = begin[keep][order], end[keep][order]
    if not left:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(centre), np.concatenate(right)


def _sequences(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Tokens of all texts, where each begins and ends, and the class of each text."""
    tokens, doc, _ = shingle_rows(texts, SIZE)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    ids = [int(np.uint64(xxhash.xxh3_64_intdigest(tokens[a:b].tobytes(), 2)).astype(np.int64)) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return tokens, ends[:-1], ends[1:], ids


def spans(least: int) -> list[tuple[int, int]]:
    """Distances before and after a centre. Of any passage of ``least`` tokens that holds the
    centre, at least one pair lies within the passage."""
    half = (least - 1) // 2
    return [(0, half), (half, 0)]


def _fields(least: int) -> list[tuple[str, type]]:
    return [("key", np.uint64), ("owner", np.uint16), ("centre", np.uint32), ("left", np.uint32), ("right", np.uint32), *[(f"pair{k}", np.uint32) for k in range(len(spans(least)))]]


def _packed(least: int) -> str:
    return "bucket int, classes binary, " + ", ".join(f"{n} binary" for n, _ in _fields(least))


def _packed_windows(docs: DataFrame, text_col: str, least: int, hashes: int, buckets: int) -> DataFrame:
    fields = _fields(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                for at in range(0, len(texts), 30_000):
                    tokens, begin, end, ids = _sequences(texts[at : at + 30_000])
                    fresh = []
                    for i, c in enumerate(ids):
                        if c is not None and c not in seen:  # copies within a task go once
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(c)
                            fresh.append(i)
                    begin, end = begin[fresh], end[fresh]
                    cls = np.array([ids[i] for i in fresh], np.int64)
                    parts = []
                    for f in range(hashes):
                        values = mix64(tokens ^ (np.uint64(int(_SEED) * (2 * f + 1) % (1 << 64))))
                        l, c, r = compact_windows(values, begin, end, least)
                        parts.append((values[c], l, c, r))
                    key, l, c, r = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if not len(key):
                        continue
                    own = np.searchsorted(begin, c, "right") - 1
                    b, e = begin[own], end[own]
                    pairs = []
                    for before, after in spans(least):
                        inside = (c - before >= b) & (c + after < e)
                        both = mix64(tokens[np.maximum(c - before, 0)] + mix64(tokens[np.minimum(c + after, len(tokens) - 1)]))
                        pairs.append(np.where(inside, both.astype(np.uint32) | np.uint32(1), 0))
                    bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                    cols = [key, own, c - b, c - l, r - c, *pairs]
                    order = np.argsort(bucket, kind="stable")
                    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    rows: list[list] = [[] for _ in range(2 + len(fields))]
                    for k in np.flatnonzero(np.diff(ends)):
                        some = order[ends[k] : ends[k + 1]]
                        used, number = np.unique(own[some], return_inverse=True)
                        rows[0].append(int(k))
                        rows[1].append(cls[used].tobytes())
                        for j, ((_, kind), x) in enumerate(zip(fields, cols, strict=True)):
                            rows[2 + j].append((number if j == 1 else x[some]).astype(kind).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["bucket", "classes", *[n for n, _ in fields]])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, _packed(least))


MEMBER = "star long, key long, cls long, centre int, l int, r int"
EMPTY = pa.table({**{n: pa.array([], pa.int64()) for n in ("star", "key", "cls")}, **{n: pa.array([], pa.int32()) for n in ("centre", "l", "r")}})
SLICES = 16


def _stars(least: int):
    """The members of each group of windows in which two classes meet (MEMBER)."""

    def meet(cols: dict, cls: np.ndarray, k: int) -> pa.Table:
        there = np.flatnonzero(cols[f"pair{k}"] != 0)
        star = mix64(cols["key"][there] + mix64(cols[f"pair{k}"][there].astype(np.uint64) * np.uint64(64) + np.uint64(k)))
        order = np.lexsort((cols["centre"][there], cls[there], star))
        some, star = there[order], star[order]
        own = cls[some]
        # all places of a text, once each, in groups with two texts at least
        centre = cols["centre"][some]
        first = np.concatenate([[True], (star[1:] != star[:-1]) | (own[1:] != own[:-1]) | (centre[1:] != centre[:-1])]) if len(star) else np.empty(0, bool)
        some, star, own = some[first], star[first], own[first]
        begin = np.flatnonzero(np.concatenate([[True], star[1:] != star[:-1]])) if len(star) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([begin, [len(star)]]))
        multi = np.repeat(own[begin] != own[begin + size - 1], size)
        some = some[multi]
        return pa.table({"star": star[multi].view(np.int64), "key": cols["key"][some].view(np.int64), "cls": own[multi], "centre": cols["centre"][some].astype(np.int32), "l": cols["left"][some].astype(np.int32), "r": cols["right"][some].astype(np.int32)})

    def find(key, rows):
        cols = {n: np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[n]]) for n, kind in _fields(least)}
        cls = np.concatenate([np.frombuffer(c.as_py(), np.int64)[np.frombuffer(o.as_py(), np.uint16)] for c, o in zip(rows["classes"], rows["owner"], strict=True)])
        out = []
        part = cols["key"] % np.uint64(SLICES)
        for k in range(SLICES):  # so that few entries are sorted at once
            inside = np.flatnonzero(part == k)
            out += [x for j in range(len(spans(least))) if len(x := meet({n: c[inside] for n, c in cols.items()}, cls[inside], j))]
        return pa.concat_tables(out) if out else EMPTY

    return find


def _lined(met: DataFrame) -> DataFrame:
    """Pairs of members x and y (structs of cls, centre, l, r) of a min-hash ``key`` lined up
    at their centres: ``key, a, b, shift`` (place in b less place in a), ``centre`` (in b)
    and ``lo..hi``, the passage in b. Passages may come out too short."""
    return met.distinct().select(
        "key", F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("y.centre").alias("centre"), (F.col("y.centre") - F.col("x.centre")).alias("shift"),
        (F.col("y.centre") - F.least("y.l", "x.l")).alias("lo"), (F.col("y.centre") + F.least("y.r", "x.r")).alias("hi"),
    )


def _star_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of each star lined up with its hub, the member of the smallest id, and
    the hubs (``key, cls, centre``). Of a pair, a is the text of the smaller id."""
    each = F.struct(F.col("head").isNull().alias("null"), "head", "cls", "centre", "l", "r")
    chosen = members.groupBy("star", "key").agg(F.min(each).alias("h"))
    met = members.select("star", "key", each.alias("m")).join(chosen, ["star", "key"]).where("m.cls <> h.cls")
    bare = lambda c: F.struct(*[c[n].alias(n) for n in ("cls", "centre", "l", "r")])
    met = met.select("key", bare(F.least("h", "m")).alias("x"), bare(F.greatest("h", "m")).alias("y"))
    return _lined(met), chosen.select("key", F.col("h.cls").alias("cls"), F.col("h.centre").alias("centre"))


def _open_pairs(members: DataFrame, tokens: DataFrame, least: int, needed: int) -> DataFrame:
    """Pairs of members of the same min-hash that may share ``needed`` tokens within reach of
    their centres, lined up."""
    held = ["key", "cls", "centre", "l", "r"]
    near = members.select(*held).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            number, shown, sizes = [], [], []
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint32)
                c, before, after = int(cols[2][k]), min(int(cols[3][k]), least - 1), min(int(cols[4][k]), least - 1)
                x = np.unique(x[max(c - before, 0) : c + after + 1])
                if len(x) >= needed:
                    same = (cols[0][k], cols[1][k], xxhash.xxh3_64_intdigest(x.tobytes()))
                    if same in seen:  # another place of the same tokens in this text
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(same)
                    number.append(np.full(len(x), k))
                    sizes.append(np.full(len(x), len(x), np.int32))
                    shown.append(x.astype(np.int64))
            at = np.concatenate(number) if number else np.empty(0, np.int64)
            arrays = [pa.array(c[at]) for c in cols]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([*sizes, np.empty(0, np.int32)]).astype(np.int32)), pa.array(np.concatenate([*shown, np.empty(0, np.int64)]))], names=[*held, "size", "token"])

    wide = near.join(tokens, "cls").select(*held, "tokens")
    each = materialize(wide.mapInArrow(run, "key long, cls long, centre int, l int, r int, size int, token long"), "passage-near")
    holders = F.bit_xor(F.xxhash64("cls", "centre", "l", "r"))
    often = each.groupBy("key", "token").agg(F.count("*").alias("df"), holders.alias("holders")).where("df > 1")
    # of tokens that the same members have, the first stands for all: whoever meets on another
    # one has met on it, as it is ranked before it by each of them
    alike = Window.partitionBy("key", "df", "holders")
    often = often.select("key", "token", "df", (F.col("token") == F.min("token").over(alike)).alias("first"))
    # tokens that one member has come first and meet nobody, so only the others are ranked
    shared = each.join(often, ["key", "token"])
    own = Window.partitionBy("key", "cls", "centre")
    ranked = shared.withColumns({"rank": F.row_number().over(own.orderBy("df", "token")), "shared": F.count("*").over(own)})
    prefix = ranked.where((F.col("rank") <= F.col("shared") - needed + 1) & F.col("first"))
    # a pair is made on the first token that both have, and on no later one
    before = F.collect_list("token").over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    prefix = materialize(prefix.select("key", "token", F.struct("cls", "centre", "l", "r").alias("m"), before.alias("before")), "passage-prefixes")
    x, y = (prefix.select("key", "token", F.col("m").alias(s), F.col("before").alias(f"before_{s}")) for s in "xy")
    met = x.join(y, ["key", "token"]).where((F.col("x.cls") < F.col("y.cls")) & ~F.arrays_overlap("before_x", "before_y"))
    return _lined(met.select("key", "x", "y"))


def _tokens_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``cls, tokens`` (4 bytes each) of the classes in ``wanted``."""
    found, bits = _filter_bits(wanted, "cls")
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, filt = set(), sent.value
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                tokens, begin, end, ids = _sequences(texts)
                keep, packed = [], []
                for c, b, e in zip(ids, begin, end, strict=True):
                    if c is not None and c not in seen and filt[(c % bits) >> 3] >> (c % bits & 7) & 1:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(c)
                        keep.append(c)
                        packed.append(tokens[b:e].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "tokens"])

    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cls long, tokens binary")
    return materialize(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "passage-tokens")


def similar(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _aligned(x: np.ndarray, y: np.ndarray, shift: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i in ``x`` and j in ``y`` of equal tokens, both rising: each place of y takes
    the place of its token nearest to the diagonal j - i = ``shift``, at most ``apart`` from
    it; those that go back behind an earlier one, or those that run ahead of a later one,
    are left out, whichever are fewer."""
    keys = np.sort(x.astype(np.uint64) << np.uint64(32) | np.arange(len(x), dtype=np.uint64))
    own = np.arange(len(y))
    wanted = np.minimum(np.maximum(own - shift, 0), len(x) - 1)
    at = np.searchsorted(keys, y.astype(np.uint64) << np.uint64(32) | wanted.astype(np.uint64), "right")
    place, off = np.full(len(y), -1), np.full(len(y), apart + 1)
    for spot in (np.minimum(at, len(keys) - 1), np.maximum(at - 1, 0)):
        near = keys[spot]
        i = (near & np.uint64(0xFFFFFFFF)).astype(np.int64)
        d = np.abs(own - shift - i)
        closer = (near >> np.uint64(32) == y) & (d < off)
        place, off = np.where(closer, i, place), np.where(closer, d, off)
    j = np.flatnonzero(place >= 0)
    i = place[j]
    if not (i[1:] > i[:-1]).all():
        ahead = i > np.concatenate([[-1], np.maximum.accumulate(i)[:-1]])
        behind = i < np.concatenate([np.minimum.accumulate(i[::-1])[::-1][1:], [len(x)]])
        some = ahead if ahead.sum() >= behind.sum() else behind
        i, j = i[some], j[some]
    return i, j


def least_common(least: int, similarity: float) -> int:
    """Fewest tokens that two passages of ``least`` tokens or more share."""
    return max(1, int(np.ceil(2 * similarity * least / (1 + similarity) - 1e-9)))


def verify_passage(x: np.ndarray, y: np.ndarray, shift: int, lo: int, hi: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages ``lo, hi`` of ``y`` (token places, ends included) around lo..hi with the
    similar ``alo, ahi`` of ``x``, and their similarity.

    The whole stretch counts if it is similar enough; else the texts are aligned with
    words put in or left out, and the longest stretches that are similar enough and begin
    and end with agreement count. One that is shorter than ``least`` in one of the texts
    takes the tokens after or before it."""
    needed, apart = least_common(least, similarity), int(least * (1 - similarity) / similarity) + 1
    lo, hi = max(lo, 0), min(hi, len(y) - 1)
    a, b = max(lo, shift), min(hi, len(x) - 1 + shift)
    if b - a + 1 >= least:
        s = similar(x[a - shift : b - shift + 1], y[a : b + 1])
        if s >= similarity:
            return [(a, b, a - shift, b - shift, s)]
    lo, hi = max(lo - apart, 0), min(hi + apart, len(y) - 1)
    xlo, xhi = max(lo - shift - apart, 0), min(hi - shift + apart, len(x) - 1)
    u, v = x[xlo : xhi + 1], y[lo : hi + 1]
    if min(len(u), len(v)) < needed:
        return []
    i, j = _aligned(u, v, shift + xlo - lo, apart)
    out, open_ = [], [(0, len(i))]
    while open_:
        p0, p1 = open_.pop()
        if p1 - p0 < needed:
            continue
        # pairs p..q of the alignment: m(1 + s) >= s(both lengths), split into ends and starts
        m, both = np.arange(p1 - p0), i[p0:p1] + j[p0:p1]
        end = (1 + similarity) * (m + 1) - similarity * (both + 2)
        start = np.minimum.accumulate((1 + similarity) * m - similarity * both)
        first = np.minimum(np.searchsorted(-start, -end - 1e-9, "left"), m)
        q = int(np.argmax(m - first))
        p, q = p0 + int(first[q]), p0 + q
        if q - p + 1 < needed:
            continue
        open_ += [(p0, p), (q + 1, p1)]
        ends = []
        for c, n, before in ((j, len(y), lo), (i, len(x), xlo)):
            e = min(max(int(c[q]), int(c[p]) + least - 1) + before, n - 1)
            ends += [max(min(int(c[p]) + before, e - least + 1), 0), e]
        sizes = ends[1] - ends[0] + 1, ends[3] - ends[2] + 1
        s = (q - p + 1) / (sum(sizes) - (q - p + 1))
        if min(sizes) >= least and s >= similarity:
            out.append((*ends, s))
    return sorted(out)


FOUND = "keys array<long>, centres array<int>, a long, b long, lo int, hi int, alo int, ahi int, similarity double"


def _pair_passages(x: np.ndarray, y: np.ndarray, asked: dict[str, np.ndarray], least: int, similarity: float) -> list[tuple[tuple, np.ndarray]]:
    """Found passages of a pair with the rows of ``asked`` whose centre each holds.

    Diagonals with most centres go first; a centre that a found passage holds is not
    searched again on another diagonal, as of a line that a text repeats. Centres within
    half of the least passage from a found one count as held by it: a passage with a third
    text that reaches farther has its own min-hash there."""
    order = np.lexsort((asked["centre"], asked["shift"]))
    shift, centre = asked["shift"][order], asked["centre"][order]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(shift) != 0]))
    size = np.diff(np.concatenate([begin, [len(shift)]]))
    needed, apart = least_common(least, similarity), int(least * (1 - similarity) / similarity) + 1
    common = np.concatenate([[0], np.cumsum(np.isin(y, x, kind="sort"))])  # tokens of y before a place that x has
    if common[-1] < needed:
        return []
    held, kept = np.zeros(len(y) + 1, bool), []
    for k in np.argsort(-size, kind="stable"):
        some = slice(begin[k], begin[k] + size[k])
        ahead = order[some][~held[centre[some]]]
        if not len(ahead):
            continue
        lo, hi = int(asked["lo"][ahead].min()), int(asked["hi"][ahead].max())
        if common[min(hi + apart + 1, len(y))] - common[max(lo - apart, 0)] < needed:
            continue
        for span in verify_passage(x, y, int(shift[begin[k]]), lo, hi, least, similarity):
            if not any(w[0] <= span[0] and span[1] <= w[1] and w[2] <= span[2] and span[3] <= w[3] for w in kept):
                kept.append(span)
                held[span[0] : span[1] + 1] = True
    out, open_ = [], np.ones(len(order), bool)
    for span in kept:
        inside = open_ & (asked["centre"] >= span[0] - needed // 2) & (asked["centre"] <= span[1] + needed // 2)
        open_ &= ~inside
        out.append((span, np.flatnonzero(inside)))
    return out


def _verify(pairs: DataFrame, tokens: DataFrame, least: int, similarity: float) -> DataFrame:
    """Found passages, with the min-hashes (and their centres in b) that each covers."""
    names = ["key", "shift", "centre", "lo", "hi"]
    left, right = tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    asked = pairs.groupBy("a", "b").agg(F.collect_list(F.struct(*names)).alias("asked")).join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
        for batch in batches:
            rows, lists = [], batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = {n: lists.values.field(n).to_numpy(zero_copy_only=False) for n in names}
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (3, 4))
                own = {n: v[ends[k] : ends[k + 1]] for n, v in flat.items()}
                rows += [(own["key"][at], own["centre"][at], a, b, *span) for span, at in _pair_passages(x, y, own, least, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return asked.select("a", "b", "asked", "x", "y").mapInArrow(run, FOUND)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, similarity: float = 0.8, hashes: int = 3, bucket_entries: int = 1_000_000) -> DataFrame:
    """``doc_id, start_word, end_word`` of passages that ``match_doc_id`` has at
    ``match_start, match_end`` (ends excluded), their ``similarity``, and ``first``.

    Every holder of a passage has a row. Where ``first`` is false the match is the document
    with the smaller id, so dropping the passages of these rows leaves one copy of each.
    Where it is true the row is that of the copy that stays: a passage that has just this
    document as match elsewhere, and the next document that has it."""
    least = words - SIZE + 1

    def make():
        def run(texts: list) -> dict:
            _, begin, end, ids = _sequences(texts)
            return {"n": end - begin, "cls": ids}

        return run

    rows = materialize(map_texts(docs, text_col, [id_col], "n long, cls long", make), "passage-classes")
    ident = f"__{id_col}"
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(96, -(-(total * 2 * hashes // least) // bucket_entries))
    packed = _packed_windows(docs, text_col, least, hashes, buckets)
    heads = rows.where("cls is not null").groupBy("cls").agg(F.min(ident).alias("head"))
    # with the smallest id of each class, so that all others of a star meet the first document
    members = materialize(packed.groupBy("bucket").applyInArrow(_stars(least), MEMBER).join(heads, "cls").select(*[f.split()[0] for f in MEMBER.split(", ")], "head"), "passage-members")
    wanted = materialize(members.select("cls").distinct(), "passage-wanted")
    tokens = _tokens_of(docs, text_col, wanted)
    needed = least_common(least, similarity)
    wide_enough = F.col("hi") - F.col("lo") + 1 >= needed
    found, left, unlike = [], members, None
    while True:  # a round for the members that the hub of the last one has nothing with
        lined, chosen = _star_pairs(left)
        good = materialize(_verify(lined.where(wide_enough), tokens, least, similarity), "passage-checked")
        found.append(good.drop("keys", "centres"))
        done = good.select(F.explode(F.arrays_zip("keys", "centres")).alias("s"), F.col("b").alias("cls")).select(F.col("s.keys").alias("key"), "cls", F.col("s.centres").alias("centre"))
        rest = left.join(done.union(chosen).distinct(), ["key", "cls", "centre"], "left_anti")
        several = rest.groupBy("star").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("star")
        rest = materialize(rest.join(several, "star", "left_semi").join(done.select("key", F.lit(True).alias("met")).distinct(), "key", "left"), "passage-rest")
        over = rest.where("met is null").select(*members.columns)  # of hubs that match nobody
        unlike = over if unlike is None else unlike.unionByName(over)
        left = rest.where("met").select(*members.columns)
        if left.isEmpty():
            break
    pairs = _open_pairs(unlike, tokens, least, needed).where(wide_enough)
    found.append(_verify(pairs, tokens, least, similarity).drop("keys", "centres"))
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    spans = spans.groupBy("a", "b", "lo", "hi", "alo", "ahi").agg(F.max("similarity").alias("similarity"))
    with_heads = spans.join(heads.select(F.col("cls").alias("a"), F.col("head").alias("ia")), "a").join(heads.select(F.col("cls").alias("b"), F.col("head").alias("ib")), "b")
    turned = F.coalesce(F.col("ia") > F.col("ib"), F.lit(False))
    one = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    own = with_heads.select(
        one("a", "b").alias("cls"), one("ia", "ib").alias("id"), one("alo", "lo").alias("lo"), one("ahi", "hi").alias("hi"),
        one("ib", "ia").alias("match_id"), one("lo", "alo").alias("mlo"), one("hi", "ahi").alias("mhi"), "similarity",
    )
    of_docs = rows.where("cls is not null").select(F.col(ident).alias("id"), "cls", "n")
    last = (F.col("n") - 1).cast("int")
    copies = of_docs.where(F.col("n") >= least).join(heads, "cls").where(~F.col("id").eqNullSafe(F.col("head")))
    copies = copies.select("id", F.lit(0).alias("lo"), last.alias("hi"), F.col("head").alias("match_id"), F.lit(0).alias("mlo"), last.alias("mhi"), F.lit(1.0).alias("similarity"))
    near = of_docs.drop("n").join(own.drop("id"), "cls").select(*copies.columns)

    def firsts(later: DataFrame) -> DataFrame:
        next_one = F.struct(F.col("id").isNull().alias("null"), "id", "lo", "hi", "similarity")
        found = later.groupBy("match_id", "mlo", "mhi").agg(F.min(next_one).alias("m"))
        return found.select(F.col("match_id").alias("id"), F.col("mlo").alias("lo"), F.col("mhi").alias("hi"), F.col("m.id").alias("match_id"), F.col("m.lo").alias("mlo"), F.col("m.hi").alias("mhi"), "m.similarity")

    later = near.unionByName(copies).withColumn("first", F.lit(False))
    holders = firsts(own).unionByName(firsts(copies)).withColumn("first", F.lit(True))
    return later.unionByName(holders).select(
        F.col("id").alias(id_col), F.col("lo").alias("start_word"), (F.col("hi") + SIZE).alias("end_word"), F.col("match_id").alias("match_doc_id"), F.col("mlo").alias("match_start"), (F.col("mhi") + SIZE).alias("match_end"), "similarity", "first"
    )
