"""N-gram Jaccard join with PartEnum signatures.

The set of a document is its distinct 5-word shingles. Equal sets are one class and
are never compared. Sizes are cut into bands so that two sets of the wanted
similarity lie in the same band or in neighbouring ones; a class takes part in the
instance of its own band and in that of the next. Two such sets of an instance
differ in at most ``k`` shingles. The shingle domain (hash range) is cut into ``n1``
parts of three pieces each; some part holds at most one difference, so leaving out
one piece after another and hashing the two that remain gives both sets a signature
in common. Signatures over two empty pieces are not made.

Work stays bounded as follows. Frequent shingles (those of passages that many texts
share) are left out of the domain: any fixed set may be, as it takes no difference
away, and which ones are is learned from a sample of the texts, so it steers cost and
never results. A signature with more than ``most`` classes is hot: only its smallest
class is paired with the others. ``n1`` is larger than the pigeonhole asks, and a class
counts the parts it cannot rely on (an empty or a hot signature); while some part is
left for either of two classes, the pair is found by a small group. Classes that have
none left, such as those of a large group of near copies, are weak. Pairs of two weak
classes are found in another way:

* Signatures over the whole domain name a partner for each; what is similar enough to a
  partner (``KIN`` percent) forms clusters, and the class with most partners in one is
  its hub. This too steers cost alone.
* Every class of a cluster is compared with its hub. Of two classes x and y the difference
  of x and y is that of (x less or beyond the hub) and (y less or beyond the hub), so two
  that link either are both near enough to the hub to link with it, or their differences
  from the hub have a number of shingles in common. The latter are found by a prefix-filter
  join over the differences, rare shingles first: what the whole group shares is in no
  difference at all, so the work grows with the group and not with its square.
* Weak classes of different hubs are found by a prefix-filter join over their sets.

All this is after the pairs above have been merged, and for pairs of different components
only. Nothing is dropped: each linked pair either is verified or lies in one component.

Signatures travel packed, by part of the signature range; sets travel for
verification only, for classes with a candidate (a filter of bounded size tells
which). The graph of links is contracted to components as a distributed table.

Edge cases: null and empty texts have no shingles and link with nothing, not even
one another; texts of 1 to 4 words have one shingle; repeated rows fall in one
class; a null doc_id takes part but never names a component that has another id; words
and texts of any length are taken whole; extra columns, whatever their names, are passed
over (``keep_one`` keeps them); an empty table gives an empty result. Words, shingles
and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_codes, drop_ids, hash_words, map_texts, materialize, mix64, pieces, release
from .graph import components

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def split_words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lowered, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


_CODES = byte_codes([9, 10, 11, 12, 13, 32])  # ASCII white space parts words


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, and the number of words of each text."""
    return hash_words(texts, _CODES)


def shingle_rows(texts: list, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles in order: hashes, their text's number, and words of each text.
    A text of fewer than ``size`` words has one shingle, of all its words."""
    flat, sizes = word_hashes(texts)
    return (*shingle_hashes(flat, sizes, size), sizes)


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= size, sizes - size + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    have = np.minimum(sizes, size)[doc]
    acc = have.astype(np.uint64)
    for j in range(size):
        inside = have > j
        word = flat[np.minimum(first + j, max(len(flat) - 1, 0))] if len(flat) else flat
        acc = np.where(inside, (acc ^ (acc >> np.uint64(29))) * _C1 + word, acc)
    return mix64(acc), doc


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashes, doc, _ = shingle_rows(texts)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x = np.sort(hashes[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def class_id(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), 1)).astype(np.int64)) if len(s) else None


def bands(percent: int, most: int) -> np.ndarray:
    """The upper ends of the size bands, up to one that holds ``most``, and two more."""
    ends, low = [], 1
    while len(ends) < 2 or ends[-2] < most:
        ends.append(max(low, low * 100 // percent))
        low = ends[-1] + 1
    ends.append(max(low, low * 100 // percent))
    return np.array(ends, np.int64)


def signatures(s: np.ndarray, doc: np.ndarray, sizes: np.ndarray, upper: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sorted sets (``doc``: the set of each element) in the instance of
    their own band (``upper`` 0) or the next (1).

    Returns signatures, their sets, and for each set how many parts it can rely on
    beyond those the pigeonhole may take away."""
    ends = bands(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(ends, sizes) + upper
    k = 2 * ends[band] * (100 - percent) // (100 + percent)
    n1 = np.where(k > 0, np.ceil(1.15 * (k + 1) / 2).astype(np.int64) + 1, 0)
    base = np.cumsum(n1) - n1
    keep = n1[doc] > 0
    s, doc = s[keep], doc[keep]
    piece = ((s >> np.uint64(32)) * (3 * n1[doc]).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + 3 * base[doc]
    sums = np.zeros(int(3 * n1.sum()), np.uint64)
    if len(s):
        new = np.flatnonzero(np.concatenate([[True], np.diff(piece) != 0]))
        sums[piece[new]] = np.add.reduceat(mix64(s + _C1), new)
    owner = np.repeat(np.arange(len(sizes)), n1)
    part = np.arange(len(owner)) - base[owner]
    p0, p1, p2 = sums[0::3], sums[1::3], sums[2::3]
    tag = mix64((band[owner] << 32 | part).astype(np.uint64) * _C1)
    made, sets, weak = [], [], np.zeros(len(owner), bool)
    for left_out, (x, y) in enumerate(((p1, p2), (p0, p2), (p0, p1))):
        empty = (x == 0) & (y == 0)
        weak |= empty
        sig = mix64(mix64(x + tag) + y * _C2 + np.uint64(left_out))
        made.append(sig[~empty])
        sets.append(owner[~empty])
    slack = np.where(n1 > 0, n1 - k // 2 - np.bincount(owner[weak], minlength=len(sizes)), 1)
    return np.concatenate(made), np.concatenate(sets), slack


def frequent_filter(docs: DataFrame, text_col: str, one_in: int = 8, least: int = 4) -> tuple[np.ndarray, int]:
    """A filter (see ``_filter_bits``) of shingles that ``least`` distinct texts of a sample,
    one in ``one_in`` by hash, have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["shingle"])

    h = F.xxhash64(F.col(text_col))
    some = docs.where(F.pmod(h, F.lit(one_in)) == 0).groupBy(h.alias("h")).agg(F.first(text_col).alias("text")).select("text")
    often = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= least).select("shingle")
    return _filter_bits(materialize(often, "jaccard-frequent"), "shingle")


def outside(flat: np.ndarray, filt: np.ndarray) -> np.ndarray:
    """Which elements the filter does not hold."""
    spot = (flat & np.uint64(8 * len(filt) - 1)).astype(np.int64)
    return (filt[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 0


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int, sent) -> DataFrame:
    """``__id, n, cls, slack`` for every row (cls null without shingles)."""

    def make():
        def run(texts: list) -> dict:
            sets = shingle_sets(texts)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
            rare = outside(flat, sent.value)
            slack = [signatures(flat[rare], doc[rare], sizes, u, percent)[2] for u in (0, 1)]
            return {"n": sizes, "cls": [class_id(s) for s in sets], "slack0": slack[0].astype(np.int32), "slack1": slack[1].astype(np.int32)}

        return run

    return map_texts(docs, text_col, [id_col], "n long, cls long, slack0 int, slack1 int", make)


PACKED = "bucket int, sigs binary, owners binary, classes binary"


def _pack(sets: list[np.ndarray], ids: list[int], percent: int, buckets: int, filt: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Signatures as rows of many: bucket, 5-byte signatures, 2-byte numbers of their
    classes (twice the number, and 1 for the upper instance), the classes."""
    for at in range(0, len(sets), 30_000):
        some, cls = sets[at : at + 30_000], np.array(ids[at : at + 30_000], np.int64)
        sizes = np.array([len(s) for s in some], np.int64)
        flat, doc = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
        if filt is not None:
            rare = outside(flat, filt)
            flat, doc = flat[rare], doc[rare]
        both = [signatures(flat, doc, sizes, u, percent)[:2] for u in (0, 1)]
        sig = np.concatenate([b[0] for b in both])
        own = np.concatenate([b[1] * 2 + u for u, b in enumerate(both)])
        if not len(sig):
            continue
        bucket = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        short = np.ascontiguousarray(sig[order]).view(np.uint8).reshape(-1, 8)[:, :5]
        own = own[order]
        rows: list[list] = [[], [], [], []]
        for b in np.flatnonzero(np.diff(ends)):
            x, y = ends[b], ends[b + 1]
            used, number = np.unique(own[x:y] >> 1, return_inverse=True)
            rows[0].append(int(b))
            rows[1].append(short[x:y].tobytes())
            rows[2].append((number * 2 + (own[x:y] & 1)).astype(np.uint16).tobytes())
            rows[3].append(cls[used].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "sigs", "owners", "classes"])


def _packed_signatures(docs: DataFrame, text_col: str, percent: int, buckets: int, sent) -> DataFrame:
    """Packed signatures of all texts over the shingles that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                fresh, ids = [], []
                for s in shingle_sets(texts):
                    c = class_id(s)
                    if c is not None and c not in seen:  # copies within a task go once
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(c)
                        fresh.append(s)
                        ids.append(c)
                yield from _pack(fresh, ids, percent, buckets, sent.value)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, PACKED)


def _packed_sets(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Packed signatures of packed sets, over the whole domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pack([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)], batch.column(0).to_pylist(), percent, buckets, None)

    return sets.select("cls", "shingles").mapInArrow(run, PACKED)


FOUND = "kind int, a long, b long, n long"


def _search_bucket(most: int):
    """From the packed rows of one bucket: pairs (kind 0: classes, number of signatures)
    and hot signatures of a class (kind 1: class, instance, number). With ``most`` 1 all
    pairs are those of a class and the smallest of a signature, and kind 1 is left out."""

    def find(key, rows):
        sigs, classes, upper = [], [], []
        for s, o, c in zip(rows["sigs"], rows["owners"], rows["classes"], strict=True):
            raw = np.frombuffer(s.as_py(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            own = np.frombuffer(o.as_py(), np.uint16)
            sigs.append(wide.view(np.uint64).reshape(-1))
            classes.append(np.frombuffer(c.as_py(), np.int64)[own >> 1])
            upper.append((own & 1).astype(np.int8))
        sig, cls, up = np.concatenate(sigs), np.concatenate(classes), np.concatenate(upper)
        del sigs, classes, upper
        order = np.argsort(sig)
        sig = sig[order]
        same = np.flatnonzero(np.diff(sig) == 0)
        multi = np.zeros(len(sig), bool)
        multi[same] = multi[same + 1] = True
        order, sig = order[multi], sig[multi]
        cls, up = cls[order], up[order]
        order = np.lexsort((cls, sig))
        sig, cls, up = sig[order], cls[order], up[order]
        keep = np.concatenate([[True], (np.diff(sig.view(np.int64)) != 0) | (np.diff(cls) != 0)]) if len(sig) else np.empty(0, bool)
        sig, cls, up = sig[keep], cls[keep], up[keep]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(sig.view(np.int64)) != 0])) if len(sig) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([begin, [len(sig)]]))
        a_parts, b_parts = [], []
        for m in range(2, most + 1):
            at = begin[size == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                a_parts.append(cls[(at[:, None] + i).ravel()])
                b_parts.append(cls[(at[:, None] + j).ravel()])
        hot = size > most
        inside = np.repeat(hot, size)
        first = np.zeros(len(sig), bool)
        first[begin] = True
        a_parts.append(np.repeat(cls[begin[hot]], size[hot])[~first[inside]] if hot.any() else np.empty(0, np.int64))
        b_parts.append(cls[inside & ~first])
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        out = []
        for kind, x, y in ((0, a, b), (1, cls[inside], up[inside].astype(np.int64)))[: 1 if most == 1 else 2]:
            o = np.lexsort((y, x))
            x, y = x[o], y[o]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])) if len(x) else np.empty(0, np.int64)
            out.append(pa.table({"kind": np.full(len(new), kind, np.int32), "a": x[new], "b": y[new], "n": np.diff(np.concatenate([new, [len(x)]])).astype(np.int64)}))
        return pa.concat_tables(out)

    return find


def _filter_bits(classes: DataFrame, column: str, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A one-hash filter of the values of ``column``: ``most_bits`` bits (16 MB) at most,
    however many there are; false hits cost time only."""
    n = max(1, classes.count())
    bits = min(most_bits, 1 << max(15, (16 * n - 1).bit_length()))
    spot = F.pmod(F.col(column), F.lit(bits))
    rows = classes.groupBy(F.floor(spot / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(spot, F.lit(32768)) + 1)).alias("bits"))
    found = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        found[r[0] * 4096 : r[0] * 4096 + len(r[1])] = np.frombuffer(bytes(r[1]), np.uint8)
    return found, bits


def _sets_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``cls, shingles`` (packed) of the classes in ``wanted`` (column cls)."""
    found, bits = _filter_bits(wanted, "cls")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, filt = set(), sent.value
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                ids, packed = [], []
                for s in shingle_sets(texts):
                    c = class_id(s)
                    if c is None or c in seen:
                        continue
                    spot = c % bits
                    if filt[spot >> 3] >> (spot & 7) & 1:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(c)
                        ids.append(c)
                        packed.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "shingles"])

    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cls long, shingles binary")
    return materialize(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]).withColumn("n", F.length("shingles") / 8), "jaccard-sets")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with the sizes ``na, nb`` of their sets and ``both``, what they share."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").cast("long").alias("na"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").cast("long").alias("nb"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, both long")


def _alike(percent: int):
    """Whether the two sets of a compared pair have at least this similarity."""
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link. Sizes are compared before any set travels."""
    sizes = sets.select("cls", "n")
    near = pairs.select("a", "b").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    near = near.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b")
    return _compare(near, sets).where(_alike(percent)).select("a", "b")


#: Similarity in percent of classes that are put into one cluster.
KIN = 40


def _hubs(kin: DataFrame) -> DataFrame:
    """``cls, hub``: of each cluster (edges ``a, b``) the class with most of the edges."""
    ends = kin.select(F.col("a").alias("node")).unionAll(kin.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    of = components(kin).join(ends, "node")
    hub = of.groupBy("root").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    return of.join(hub, "root").select(F.col("node").alias("cls"), "hub")


def _from_hubs(weak: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """``cls, hub, n, hn, both, apart`` of weak classes with another hub: sizes, what they
    share, and the shingles that only one of the two has, packed."""
    own = weak.join(hubs, "cls").where("cls <> hub").join(sets.select("cls", "n", F.col("shingles").alias("x")), "cls")
    wide = own.join(sets.select(F.col("cls").alias("hub"), F.col("n").alias("hn"), F.col("shingles").alias("y")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, apart = [], []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                diff = np.setxor1d(x, y, assume_unique=True)
                both.append((len(x) + len(y) - len(diff)) // 2)
                apart.append(diff.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64()), pa.array(apart, pa.binary())], names=["cls", "hub", "n", "hn", "both", "apart"])

    return wide.select("cls", "hub", F.col("n").cast("long").alias("n"), F.col("hn").cast("long").alias("hn"), "x", "y").mapInArrow(run, "cls long, hub long, n long, hn long, both long, apart binary")


def _spread(rows: DataFrame, packed: str) -> DataFrame:
    """``cls, hub, n, size, shingle``: a row for each of the packed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3)]
            sizes = np.array([len(x) for x in some], np.int64)
            at = np.repeat(np.arange(len(some)), sizes)
            arrays = [batch.column(k).take(pa.array(at)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes[at]), pa.array(np.concatenate([*some, np.empty(0, np.uint64)]).view(np.int64))], names=["cls", "hub", "n", "size", "shingle"])

    return rows.select("cls", "hub", F.col("n").cast("long").alias("n"), packed).mapInArrow(run, "cls long, hub long, n long, size long, shingle long")


def _ranked(own: DataFrame, within: list[str], *of: str) -> DataFrame:
    """With ``df``, how many rows have the shingle (for each of ``within``), and the ``rank``
    of each of a class's shingles (for each value of ``of``), rare ones first."""
    often = own.groupBy(*within, "shingle").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls", *of).orderBy("df", "shingle"))
    return own.join(often, [*within, "shingle"]).withColumn("rank", rank)


def _sides(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ("cls", "n", "size", "rank", "root", "kin")
    return tuple(prefix.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


#: A group of rows that share a shingle is paired as it stands while that makes at most so
#: many pairs a row; so often are members of larger ones given a nearer hub.
GROUP_PAIRS, LEVELS = 32, 4


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after more links between their nodes, or nodes without a label."""
    if links.isEmpty():
        return labels
    ends = _rooted(_rooted(links.select(F.col("a").alias("cls"), "b"), labels).select(F.col("root").alias("ra"), F.col("b").alias("cls")), labels)
    joined = components(ends.select(F.col("ra").alias("a"), F.col("root").alias("b")))
    to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(fresh), "jaccard-labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes lie in different components, with these (``ra, rb``)."""
    a, b = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rooted = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return rooted.where("ra <> rb")


#: So many times at most each component tries one of its pairs before all that are left are
#: compared; so few pairs are compared at once.
ROUNDS, FEW = 4, 5000


def _joined(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` after all links among ``pairs`` (``a, b``, and ``n``, what they are known to share).

    Most links of a large group join what others have joined, so comparing all its pairs
    grows with its square. Instead each component tries the pair that shares most, and pairs
    within a component go. Once these are few they are compared together."""
    left = pairs.select("a", "b", "n")
    for turn in range(ROUNDS + 1):
        left = materialize(_apart(left, labels), "jaccard-apart")
        if turn == ROUNDS or left.count() <= FEW:
            return _merged(labels, materialize(_verify(left, sets, percent), "jaccard-links"))
        pair = F.struct("n", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        ends = left.select(F.col("ra").alias("root"), pair.alias("p")).unionAll(left.select("rb", pair))
        best = materialize(ends.groupBy("root").agg(F.max("p").alias("p")).select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b")).distinct(), "jaccard-best")
        labels = _merged(labels, materialize(_verify(best, sets, percent), "jaccard-links"))
        left = left.select("a", "b", "n").join(best, ["a", "b"], "left_anti")


def _hub_prefixes(diffs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """A row for each shingle of the differences from a hub that may be the first of those
    a linked pair of different components has in common, and for each band of sizes that
    the other difference of such a pair may lie in: ``hub, shingle, band, other``, ``cls, n,
    size, rank, root``; ``inner``: the class has the hub's root.

    With difference sizes da, db and set sizes na, nb, classes link if and only if
    da + db - 2 common <= (na + nb) k, k = (100 - percent) / (100 + percent): a shingle at some
    rank can be the first in common only if db is not too large. If the other class does not
    link to the hub (hn), db > (nb + hn) k, so more than half of da + (hn - na) k is in common.
    Of two classes of different components one at least does not link to it."""
    less, more = 100 - percent, 100 + percent
    rows = _rooted(diffs, labels).join(labels.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn("inner", F.col("root") == F.coalesce("hub_root", "hub")).drop("hub_root")
    mixed = rows.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hub")
    rows = rows.join(mixed, "hub", "left_semi")
    own = _ranked(_spread(rows, "apart"), ["hub"], "hub").where("df > 1")
    prefix = own.join(rows.select("cls", "hub", "root", "inner", "hn"), ["cls", "hub"])
    limit = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * less / more)  # at most, whatever the other size
    common = F.floor((F.col("size") * more + (F.col("hn") - F.col("n")) * less) / (2 * more))
    prefix = prefix.withColumn("short", F.col("rank") <= F.col("size") - common).where(F.col("short") | ~F.col("inner"))
    width = F.floor(F.col("hn") * less / (3 * more)) + 1
    lowest, highest = F.greatest(F.lit(0), F.col("size") - limit), F.col("size") + limit - 2 * (F.col("rank") - 1)
    prefix = prefix.where(highest >= lowest).withColumn("band", F.floor(F.col("size") / width)).withColumn("other", F.explode(F.sequence(F.floor(lowest / width), F.floor(highest / width))))
    return prefix.drop("df", "hn")


def _walk(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of rows of a hub that meet on a shingle and on each other's band."""
    names = ("cls", "n", "size", "rank", "root")
    left = x.select("hub", "shingle", F.col("band").alias("p"), F.col("other").alias("q"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = y.select("hub", "shingle", F.col("other").alias("p"), F.col("band").alias("q"), *[F.col(c).alias(f"{c}_b") for c in names])
    return left.join(right, ["hub", "shingle", "p", "q"])


def _hub_links(diffs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` after all links between classes of one hub (``diffs``).

    Prefixes of the differences meet on (hub, shingle, bands of their sizes). Where many rows
    meet even so, their classes are alike in what sets them apart from the hub: they get one
    of them as a hub of their own, from which what they share is no difference, and meet
    again there. So pairs grow with the rows. After LEVELS of this what is left is paired as
    it stands."""
    less, more = 100 - percent, 100 + percent
    limit = (F.col("n_a") + F.col("n_b")) * less
    room = 2 * (1 + F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b"))) * more >= (F.col("size_a") + F.col("size_b")) * more - limit
    near = (F.col("root_a") != F.col("root_b")) & (F.abs(F.col("size_a") - F.col("size_b")) * more <= limit) & room
    key = ["hub", "shingle", "lo", "hi"]
    for level in range(LEVELS + 1):
        prefix = _hub_prefixes(diffs, labels, percent).withColumns({"lo": F.least("band", "other"), "hi": F.greatest("band", "other")})
        prefix = materialize(prefix, "jaccard-prefixes")
        if prefix.isEmpty():
            break
        inner = F.col("inner")
        outer, low, high = F.col("short") & ~inner, F.col("band") == F.col("lo"), F.col("band") == F.col("hi")
        many = lambda c: F.count_if(c).cast("double")
        pairs = many(outer & low) * many(outer & high) + many(inner & low) * many(~inner & high) + many(inner & high) * many(~inner & low)
        groups = prefix.groupBy(*key).agg(pairs.alias("pairs"), F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most and pairs > 0")
        groups = materialize(groups.select(*key, ((F.col("pairs") > GROUP_PAIRS * F.col("rows")) & F.lit(level < LEVELS)).alias("hot")), "jaccard-groups")
        met = prefix.join(groups, key)
        cold = met.where("not hot")
        walked = _walk(cold.where(outer & (F.col("band") <= F.col("other"))), cold.where(outer)).where((F.col("p") < F.col("q")) | (F.col("cls_a") < F.col("cls_b")))
        walked = walked.unionByName(_walk(cold.where(inner), cold.where(~inner)))
        found = walked.where(near).groupBy(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).agg(F.count("*").alias("n"))
        labels = _joined(found, labels, sets, percent)
        # of a group, the class that has most of the shingles that many share: so few hubs do
        hot = met.where("hot").select(*key, "cls", "size").distinct()
        often = hot.groupBy("hub", "cls").agg(F.count("*").alias("often"))
        lead = hot.join(often, ["hub", "cls"]).groupBy(*key).agg(F.max_by("cls", F.struct("often", -F.col("size"), -F.col("cls"))).alias("next"))
        again = materialize(hot.join(lead, key).select("cls", F.col("next").alias("hub")).distinct(), "jaccard-nearer")
        if again.isEmpty():
            break
        diffs = materialize(_from_hubs(again.select("cls").distinct(), again, sets), "jaccard-diffs")
        to_hub = diffs.where(F.col("both") * 100 >= (F.col("n") + F.col("hn") - F.col("both")) * percent)
        labels = _merged(labels, materialize(to_hub.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), "jaccard-links"))
        for done in (prefix, groups, again):
            release(done)
    return labels


def _prefix_pairs(weak: DataFrame, hubs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of weak classes of different hubs and components that share a shingle of their
    prefixes: the (1 - similarity) * size + 1 shingles that the fewest weak classes have."""
    rows = sets.join(weak, "cls", "left_semi").join(hubs, "cls", "left")
    own = _ranked(_spread(rows, "shingles"), [])
    prefix = own.where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("df") > 1)).withColumn("kin", F.coalesce("hub", "cls"))
    prefix = materialize(_rooted(prefix.drop("df", "hub"), labels), "jaccard-prefixes")
    # of two hubs one at least is not the one that most classes with a shingle have
    most = prefix.groupBy("shingle", "kin").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("kin", F.struct("c", "kin")).alias("most"), F.count("*").alias("kins")).where("kins > 1")
    x, y = _sides(prefix)
    x = x.join(most.select("shingle", "most"), "shingle").where("kin_a <> most").drop("most")
    # were this the first shingle that a similar pair shares, so many would be left to share;
    # for some shingle it is the first
    sizes = F.col("size_a") + F.col("size_b")
    room = (1 + F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b"))) * (100 + percent) >= sizes * percent
    near = (F.col("size_a") * 100 >= F.col("size_b") * percent) & (F.col("size_b") * 100 >= F.col("size_a") * percent) & room
    return x.join(y, "shingle").where((F.col("kin_a") != F.col("kin_b")) & (F.col("root_a") != F.col("root_b")) & near).groupBy(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).agg(F.count("*").alias("n"))


BLOCK = 256


def _linked(x: list, percent: int) -> np.ndarray:
    """Which of the sets link, as a square of booleans; none with itself."""
    sizes = np.array([len(s) for s in x])
    owner = np.repeat(np.arange(len(x)), sizes)
    _, ids, often = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
    shared = often > 1
    ids, owner = (np.cumsum(shared) - 1)[ids[shared[ids]]], owner[shared[ids]]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    both = np.zeros((len(x), len(x)), np.float64)
    for v in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(ids, [v, v + 4096])
        has = np.zeros((len(x), min(4096, int(shared.sum()) - v)), np.float32)
        has[owner[a:b], ids[a:b] - v] = 1
        both += has @ has.T
    out = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def _link_counts(labels: DataFrame, copies: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``cls, n_links``: the documents of other classes that link to each class of a
    component. All links lie within components, so all pairs of each are compared, in
    squares of BLOCK classes; small components share a group."""
    sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
    parts = max(96, -(-labels.count() // 1000))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    each = labels.join(sizes, "root").withColumnRenamed("node", "cls").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(parts))).otherwise(F.col("root"))
    each = each.select(part.alias("part"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "root", "own", "cls")
    each = each.join(copies, "cls").join(sets.select("cls", "shingles"), "cls")

    def count(rows):
        roots, own, copies = (rows[c].to_numpy() for c in ("root", "own", "copies"))
        x = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["shingles"]]
        n = np.zeros(len(x), np.int64)
        order = np.argsort(roots, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            link = _linked([x[k] for k in some], percent)
            if rows["x"][0].as_py() != rows["y"][0].as_py():  # pairs within a block are counted in its own square
                link &= own[some][:, None] != own[some][None, :]
            n[some] = link @ copies[some]
        return pa.table({"cls": rows["cls"], "n_links": n})

    return each.groupBy("part", "x", "y").applyInArrow(count, "cls long, n_links long").groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, most: int = 24, bucket_entries: int = 1_500_000, count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row, and ``n_links``, the number of
    other documents that link to it (null unless ``count_links``)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_filter(docs, text_col)[0])  # 16 MB at most
    rows = materialize(_classes(docs, id_col, text_col, percent, sent), "jaccard-classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(96, -(-total // bucket_entries))
    search = _search_bucket(most)

    def found_by(packed: DataFrame, slack: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs with their numbers of signatures, and the classes with no part to rely on."""
        found = materialize(packed.groupBy("bucket").applyInArrow(search, FOUND), "jaccard-found")
        pairs = materialize(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "jaccard-pairs")
        hot = found.where("kind = 1").groupBy(F.col("a").alias("cls"), "b").agg(F.sum("n").alias("hot"))
        hot = hot.groupBy("cls").agg(F.sum(F.when(F.col("b") == 0, F.col("hot"))).alias("hot0"), F.sum(F.when(F.col("b") == 1, F.col("hot"))).alias("hot1"))
        weak = slack.join(hot, "cls", "left").where((F.col("slack0") <= F.coalesce("hot0", F.lit(0))) | (F.col("slack1") <= F.coalesce("hot1", F.lit(0))))
        return pairs, materialize(weak.select("cls"), "jaccard-weak")

    each = rows.where("cls is not null").groupBy("cls").agg(F.min("slack0").alias("slack0"), F.min("slack1").alias("slack1"))
    pairs, weak = found_by(_packed_signatures(docs, text_col, percent, buckets, sent), each)
    wanted = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(weak).distinct(), "jaccard-wanted")
    sets = _sets_of(docs, text_col, wanted)
    # partners of weak classes, over the whole domain
    packed = _packed_sets(sets.join(weak, "cls", "left_semi"), percent, buckets)
    stars = packed.groupBy("bucket").applyInArrow(_search_bucket(1), FOUND).groupBy("a", "b").agg(F.sum("n").alias("n"))
    partner = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")

    # first each class with the partner it shares most signatures with, and with the
    # smallest; then with its hub; then what is still apart
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "n").union(pairs.select("b", "a", "n"))
    best = ends.groupBy("u").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).union(least).union(partner).distinct()
    checked = materialize(_compare(tried, sets), "jaccard-tried")
    hubs = materialize(_hubs(checked.where(_alike(KIN))), "jaccard-hubs")
    diffs = materialize(_from_hubs(weak, hubs, sets), "jaccard-diffs")
    to_hub = diffs.where(F.col("both") * 100 >= (F.col("n") + F.col("hn") - F.col("both")) * percent)
    links = materialize(checked.where(_alike(percent)).select("a", "b").union(to_hub.select(F.least("cls", "hub"), F.greatest("cls", "hub"))).distinct(), "jaccard-links")
    labels = components(links)
    labels = _joined(pairs.join(checked, ["a", "b"], "left_anti"), labels, sets, percent)
    labels = _hub_links(diffs, labels, sets, percent)
    labels = _joined(_prefix_pairs(weak, hubs, sets, labels, percent), labels, sets, percent)
    copies = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"))
    if count_links:
        counts = materialize(_link_counts(labels, copies, sets, percent), "jaccard-link-counts")
        degree = copies.join(counts, "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    else:
        degree = copies.withColumn("n_links", F.lit(None).cast("long"))
    named = rows.where("cls is not null").groupBy("cls").agg(F.min("__" + id_col).alias("least_id"))
    named = named.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = materialize(named.join(ids, "root").join(degree, "cls").select("cls", "component_id", "n_links"), "jaccard-components")
    linked = rows.where("cls is not null").join(of_class, "cls").select(F.col("__" + id_col).alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("cls is null").select(F.col("__" + id_col).alias(id_col), F.col("n").alias("n_shingles"), F.col("__" + id_col).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the row with the least id
    stays (one of several rows of that id), and every row without shingles or id."""
    parts = materialize(jaccard_components(docs, id_col, text_col, count_links=False, **options), "jaccard-parts")
    inside = parts.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    out = drop_ids(docs, inside.where(F.col(id_col) != F.col("component_id")).select(id_col), id_col)
    often = inside.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().where("count > 1").select(id_col)
    if often.isEmpty():
        return out
    several = materialize(often, "jaccard-repeated")
    once = out.join(several, id_col, "left_semi").dropDuplicates([id_col])
    return drop_ids(out, several, id_col).unionByName(once)


def brute_force(texts: list, percent: int = 80) -> list[int]:
    """The smallest linked row number of each text, by comparing all pairs (small fixtures)."""
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]
