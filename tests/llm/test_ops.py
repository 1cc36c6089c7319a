"""Each operator against a plain version, on small tables with the odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolloom.llm import decontam, exact_dedup, jaccard_join, mixing, quality, secrets, sharding, substring_dedup, toxicity, url_filter
from rolloom.llm.common import drop_ids, materialize
from rolloom.llm.graph import components

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vi", "za") for b in ("n", "ra", "st", "mo", "le", "pi")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None, lang="en", source=None):
    rows = [(i if ids is None else ids[i], t, lang, source[i] if source else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    other = words(rng, 200)
    out = [base, base, base.replace(" ", "  \n"), " ".join(near), other, None, "", "  \t ", "one", "one", "two words", base.upper(), words(rng, 6000)]
    out += [words(rng, 30) + " " + other[:500] + " " + words(rng, 30) for _ in range(4)]
    return out


# -- exact copies --------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"key_bits": 3}, {"capacity": 2}, {"hot_rows": 1}])
def test_exact_copies(spark, texts, options):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), **options).collect()}
    norm = [re.sub("[ \t-\r]+", " ", t or "") for t in texts]
    assert len(got) == len(texts)
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()


def test_directory_splits_only_full_buckets(spark):
    keys = spark.createDataFrame([(i << 56 if i < 128 else (i - 256) << 56,) for i in [0, 1, 2, 3, 255]], "key long")
    got = {r.slot: (r.bucket, r.depth) for r in exact_dedup.directory(keys, 2, 8).collect()}
    assert len(got) == 256 and got[255] == (128, 1) and got[0] == (0, 7) and got[2] == (2, 7)


def test_exact_nulls_and_repeats(spark):
    got = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b"], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id is None, r.kept) for r in got) == [(False, False, True), (False, False, True), (True, True, True)]


# -- mixing --------------------------------------------------------------------------


def targets_plain(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_its_budgets(spark):
    rng = random.Random(1)
    source = [rng.choice(["a", "b", "b", "b", "c", None, ""]) for _ in range(300)]
    texts = [None if i % 50 == 0 else words(rng, rng.randint(0, 40)) for i in range(300)]
    docs = frame(spark, texts, source=source)
    got = mixing.mix(docs, cell_rows=10).collect()
    sizes = {}
    for t, s in zip(texts, source, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets_plain(sizes)
    by = {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        assert np.isclose(r.target, want[source[r.doc_id]])
        by[source[r.doc_id]] = by.get(source[r.doc_id], 0) + r.taken
    assert all(abs(by[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(7), cell_rows=1000).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    mixed = mixing.mixed_documents(docs, cell_rows=10)
    assert mixed.columns == docs.columns
    held = {}
    for r in mixed.collect():
        held[r.source] = held.get(r.source, 0) + len((r.text or "").split())
    assert held == by


def test_mix_of_nothing(spark):
    empty = frame(spark, ["x"]).where("false")
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0, 0]


def test_first_words_keep_white_space(spark):
    df = spark.createDataFrame([(" a\n b  c ", 2)], "t string, n int")
    assert df.select(mixing.first_words(F.col("t"), F.col("n"))).first()[0] == " a\n b"


# -- sharding ------------------------------------------------------------------------


def test_table_is_even_and_stable():
    names = [f"n{i}" for i in range(10)]
    slots = sharding.prime_from(1000)
    full = sharding.fill_table(names, slots)
    counts = np.bincount(full)
    assert slots == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:9], slots)
    moved = sum(names[a] != names[b] for a, b in zip(full, fewer, strict=True) if names[a] != "n9")
    assert moved < 0.3 * slots


def test_places(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, shard string")
    got = sharding.place(df, ["a", "b"]).collect()
    assert len(got) == 3 and len({r.slot for r in got if r.doc_id == 1}) == 1
    with pytest.raises(ValueError):
        sharding.place(df, ["a", "a"])


# -- url rules -----------------------------------------------------------------------

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/77", "block"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "", "block"), ("a.b.org", "/x", "allow")]
URLS = [None, "", "no scheme/en/", "http://example.com/en/7?x", "https://EXAMPLE.com/en/77", "http://m.example.com/en/1#a", "http://notexample.com/en/71", "ftp://x.net/de/8", "http://example.net/de/81", "http://org", "http://a.b.org/x/y", "http://z.a.b.org/xyz", "http://b.org?x", "://com/en/a", "http://com.evil/en/", "http://example.com/EN/7", "a://b://com/en/"]


def judged_plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


@pytest.mark.parametrize("run_rows", [2, 1000])
def test_url_rules(spark, run_rows):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, url_filter.RULE_SCHEMA), run_rows=run_rows).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged_plain(URLS[r.page_id % len(URLS)])


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    from rolloom.llm import entry

    told = {
        "http://a.net/de/1": "allow", "http://example.net/de/71": "allow", "http://m.example.net/de/8": "block", "http://com/en/7": "block", "http://example.com/en/7": "allow", "http://org/es/": "block", "http://org/de/": "allow",
    }
    spark.createDataFrame([(i, u) for i, u in enumerate(told)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.op9_url_filter(spark, str(tmp_path)).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == list(told.values())
    assert {r.rule for r in got} == {"net/de/", "example.net/de/8", "com/en/", "example.com/en/7", "org/es/", None}


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert [r.verdict for r in url_filter.judge_urls(pages, none).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.where("false"), spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)).collect() == []


# -- near duplicates -----------------------------------------------------------------


def test_components_of_a_graph(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (1, 1)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    assert components(edges.where("false")).collect() == []


def plain_components(texts):
    return {i: r for i, r in enumerate(jaccard_join.brute_force(texts))}


@pytest.mark.parametrize("most", [2, 24])
def test_near_duplicates(spark, texts, most):
    rng = random.Random(9)
    family = words(rng, 150).split()
    more = list(texts)
    for _ in range(40):  # one large group of near copies, some only linked through others
        copy = list(family)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = rng.choice(WORDS)
        more.append(" ".join(copy))
    for n in (4, 5, 6, 7, 8, 9, 11, 14):  # small sets at the edges of bands
        short = words(rng, n)
        more += [short, short + " end", short]
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(frame(spark, more), most=most).collect()}
    want = plain_components(more)
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in enumerate(more):
        w = jaccard_join.split_words(t)
        assert got[i].n_shingles == (len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))


@pytest.mark.parametrize("block", [256, 7])
def test_all_links_are_counted(spark, texts, block, monkeypatch):
    rng = random.Random(15)
    family, more = words(rng, 150).split(), [*texts, texts[0]]
    for _ in range(40):
        copy = list(family)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = rng.choice(WORDS)
        more.append(" ".join(copy))
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_components(frame(spark, more), most=2).collect()}
    sets = []
    for t in more:
        w = jaccard_join.split_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    for i, x in enumerate(sets):
        assert got[i] == sum(bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets) if j != i)


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(2)
    for n in (5, 9, 20, 75, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(n / 9)
            b = np.unique(np.concatenate([rng.permutation(a)[: n - drop], rng.integers(0, 2**63, int(n / 9)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            found, reliable = False, False
            bands = jaccard_join.bands(80, 400)
            for u, v in ((0, 0), (1, 1), (1, 0), (0, 1)):
                if np.searchsorted(bands, len(a)) + u != np.searchsorted(bands, len(b)) + v:
                    continue
                sa, _, ka = jaccard_join.signatures(a, np.zeros(len(a), np.int64), np.array([len(a)]), u, 80)
                sb, _, kb = jaccard_join.signatures(b, np.zeros(len(b), np.int64), np.array([len(b)]), v, 80)
                found |= bool(len(np.intersect1d(sa, sb)))
                reliable |= bool(ka[0] > 0 or kb[0] > 0)
            assert found or not reliable or np.array_equal(a, b)


def test_keep_one(spark, texts):
    docs = frame(spark, [*texts, texts[0]], ids=[*range(len(texts)), 0]).withColumn("cls", F.lit("clash"))
    kept = jaccard_join.keep_one(docs)
    want = plain_components(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in want.items() if i == r)


def test_near_duplicates_of_nothing(spark, texts):
    docs = frame(spark, texts)
    assert jaccard_join.jaccard_components(docs.where("false")).collect() == []
    null_ids = jaccard_join.jaccard_components(frame(spark, ["a b", None], ids=[None, None])).collect()
    assert [r.component_id for r in null_ids] == [None, None]


# -- passages ------------------------------------------------------------------------


def test_windows_are_the_trees_nodes():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 2**63, 60).astype(np.uint64)
    l, c, r = substring_dedup.compact_windows(v, np.array([0, 40]), np.array([40, 60]), 5)
    got = set(zip(l.tolist(), c.tolist(), r.tolist(), strict=True))
    want = set()
    for lo, hi in ((0, 40), (40, 60)):
        for i in range(lo, hi):
            a, b = i, i
            while a > lo and v[a - 1] > v[i]:
                a -= 1
            while b + 1 < hi and v[b + 1] > v[i]:
                b += 1
            if b - a + 1 >= 5:
                want.add((a, i, b))
    assert got == want


def test_passages(spark):
    rng = random.Random(5)
    passage, short = words(rng, 60), words(rng, 44)
    texts = [words(rng, 80) + " " + passage + " " + words(rng, 50), words(rng, 10) + " " + passage, words(rng, 300), passage + " " + words(rng, 90)]
    texts += [words(rng, 70) + " " + short + " " + words(rng, 70) for _ in range(6)]  # too short a passage
    changed = passage.split()
    changed[30] = "other"
    texts += [words(rng, 40) + " " + " ".join(changed) + " " + words(rng, 40), None, "", texts[2], "tiny", "tiny"]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} >= {0, 1, 3}
    assert {r.doc_id for r in rows} & {4, 5, 6, 7, 8, 9, 11, 12, 14, 15} == set()
    whole = [r for r in rows if r.doc_id in (2, 13)]
    assert sorted((r.doc_id, r.match_doc_id, r.start_word, r.end_word, r.first) for r in whole) == [(2, 13, 0, 300, True), (13, 2, 0, 300, False)]
    for r in rows:
        assert (r.match_doc_id > r.doc_id) == r.first
        if r.similarity == 1.0:
            a, b = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.match_doc_id].split()[r.match_start : r.match_end]
            assert a == b and len(a) >= 50


@pytest.mark.parametrize("n", [60, 80, 90, 120])
@pytest.mark.parametrize("edit", ["put in", "left out"])
def test_passages_with_words_put_in_or_left_out(n, edit):
    rng = random.Random(n)
    passage = words(rng, n).split()
    changed = [*passage[: n // 2], "another", *passage[n // 2 :]] if edit == "put in" else passage[: n // 2] + passage[n // 2 + 1 :]
    pair = [" ".join([words(rng, 150), " ".join(p), words(rng, 150)]) for p in (passage, changed)]
    tokens, begin, end, _ = substring_dedup._sequences(pair)
    x, y = (tokens[a:b].astype(np.uint32) for a, b in zip(begin, end, strict=True))
    found = substring_dedup.verify_passage(x, y, 0, 100, 150 + n + 100, 46, 0.8)
    assert len(found) == 1
    lo, hi, alo, ahi, s = found[0]
    assert s >= 0.8 and 45 <= hi - lo + 1 <= n + 12 and min(lo, alo) >= 138 and max(hi, ahi) <= 150 + n + 8
    assert substring_dedup.similar(x[alo : ahi + 1], y[lo : hi + 1]) >= 0.8


def test_every_later_text_has_a_row(spark):
    rng = random.Random(11)
    passage = words(rng, 70)
    texts = [f"{words(rng, 60)} {passage} {words(rng, 60)}" for _ in range(12)]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} == set(range(12))
    assert {r.doc_id for r in rows if r.match_doc_id == 0} == {r.doc_id for r in rows if not r.first} == set(range(1, 12))


def test_all_places_of_a_text_count():
    centres = [[30], [10, 200], [50]]  # of three texts; the last has no partner
    number = {"key": [7, 7, 7, 8], "owner": [0, 1, 1, 2], "centre": sum(centres, []), "left": [9] * 4, "right": [60] * 4}
    packed = {n: np.array(number.get(n, [5] * 4), kind).tobytes() for n, kind in substring_dedup._fields(46)}
    rows = pa.table({"classes": [np.array([1, 2, 3]).tobytes()], **{n: [x] for n, x in packed.items()}})
    got = substring_dedup._stars(46)(None, rows).to_pylist()
    assert {(r["cls"], r["centre"]) for r in got} == {(1, 30), (2, 10), (2, 200)}


@pytest.mark.parametrize("least", [2, 9, 46, 100])
def test_a_pair_lies_within_every_passage(least):
    for before in range(least):
        assert any(a <= before and b <= least - 1 - before for a, b in substring_dedup.spans(least))


def test_passages_of_nothing(spark):
    assert substring_dedup.repeated_passages(frame(spark, ["x"]).where("false")).collect() == []
    assert substring_dedup.repeated_passages(frame(spark, [None, "a b c"])).collect() == []


# -- quality -------------------------------------------------------------------------


def kneser_ney_plain(texts, order=4):
    """Probabilities by the textbook recursion, from dictionaries."""
    counts = [dict() for _ in range(order + 1)]
    for t in texts:
        for g in quality.grams(quality.encode(t)).tolist() if t else []:
            counts[order][g] = counts[order].get(g, 0) + 1
    for size in range(order - 1, 0, -1):
        for g in counts[size + 1]:
            low = g & ((1 << 6 * size) - 1)
            counts[size][low] = counts[size].get(low, 0) + 1
    off = {}
    for size in range(1, order + 1):
        n = [sum(c == k for c in counts[size].values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        off[size] = [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(g, size):
        if size == 0:
            return 1 / 64
        ctx = g >> 6
        rows = [c for h, c in counts[size].items() if h >> 6 == ctx]
        low = p(g & ((1 << 6 * (size - 1)) - 1), size - 1)
        if not rows:
            return low
        c = counts[size].get(g, 0)
        return (max(c - off[size][min(c, 3)], 0) + sum(off[size][min(x, 3)] for x in rows) * low) / sum(rows)

    return lambda t: float(np.exp(-np.mean([np.log(p(g, order)) for g in quality.grams(quality.encode(t)).tolist()])))


def test_perplexity_matches_the_recursion(spark):
    rng = random.Random(6)
    texts = [words(rng, 12) + "." for _ in range(12)] + ["%%% ### @@@ !!!", "Ünïcode ß text", None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(8, 0), (99, 1)], "doc_id long, quality int")
    got = {r["__doc_id"]: r for r in quality.judge_quality(docs, labels, least=2).collect()}
    plain = kneser_ney_plain(texts[:8])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t:
            assert np.isclose(got[i].perplexity, plain(t), rtol=1e-3)
        else:
            assert got[i].perplexity is None and got[i].kept
    assert not got[12].kept and all(got[i].kept for i in range(8)) and got[0].trusted and not got[8].trusted
    kept = quality.keep_good(docs.withColumn("block", F.lit(1)), labels, least=2)
    assert kept.columns == [*docs.columns, "block"] and 12 not in {r.doc_id for r in kept.collect()}


def test_limits_are_quantiles_of_trusted_texts(spark):
    rng = random.Random(14)
    docs = frame(spark, [words(rng, rng.randint(3, 30)) for _ in range(150)])
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    rows = quality.judge_quality(docs, labels).collect()
    trusted = sorted(r.perplexity for r in rows if r.trusted)
    assert {r.threshold for r in rows} == {trusted[int(np.ceil(0.99 * 120)) - 1]}
    assert sum(not r.kept for r in rows if r.trusted) == 1


def test_quality_without_trust_or_rows(spark):
    docs, none = frame(spark, ["a b c", None]), spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge_quality(docs, none).collect())
    assert quality.judge_quality(docs.where("false"), none).collect() == []


# -- benchmark -----------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_benchmark_overlap(spark, block_words):
    rng = random.Random(7)
    items = [(i, words(rng, n)) for i, n in enumerate((25, 10, 9, 3, 1, 40))] + [(6, None), (7, " .,! "), (10, "Zwölf Wörter")]
    texts = [words(rng, 50), f"{words(rng, 5)} {items[0][1].upper()} {words(rng, 5)}", items[1][1].replace(" ", ", ") + "!", "x " + items[2][1], None, "", "zwölf  WÖRTER wörter", words(rng, 3000)]
    texts.append(" ".join(items[5][1].split()[3:15]) + " " + " ".join(items[0][1].split()[:9]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.overlap_report(frame(spark, texts), bench, block_words=block_words).collect()}
    want = decontam.brute_force(texts, [(str(i), t) for i, t in items])
    for i, w in enumerate(want):
        assert {k: got[i][k] for k in w} == w, i
        assert got[i].contaminated == (w["n_hit"] > 0)
    assert got[1].longest >= 25 and got[1].longest_start <= 5
    docs = frame(spark, texts).withColumn("hits", F.lit("clash"))
    clean = decontam.decontaminate(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w["n_hit"]}


def test_benchmark_of_nothing(spark):
    docs, bench = frame(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.overlap_report(docs, bench).collect()] == [False, False]
    assert decontam.overlap_report(docs.where("false"), bench).collect() == []


# -- secrets -------------------------------------------------------------------------

SECRET = "q8Zk3Xv9Lm2Rt5Yw7Bn4"


def test_base_spans_drop_after_matching():
    text = "token=token:abcdefg PASSWD = 'hunter22' api_key:x AKIA" + "A1" * 8 + " AKIA12 " + "0af" * 8 + " deadbeef ſecret=abcdefgh"
    got = [(k, text[a:b]) for a, k, b, _ in secrets.base_spans(text)]
    assert got == [(0, "PASSWD = 'hunter22"), (1, "AKIA" + "A1" * 8), (2, "0af" * 8)]


def test_ownership_decides_about_bare_tokens(spark):
    texts = [f"é {SECRET} here", *[f"copy c0mm0nEx4mpleT0ken99 {i}" for i in range(6)], None, "", "password=abc123def4"]
    docs = frame(spark, texts, source=["me", *[f"o{i}" for i in range(6)], None, "x", "y"])
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert len(got) == len(texts) and got[0].spans == "bare:2:22" and got[0].n_live == 1
    assert all(got[i].spans == "" and got[i].n_example == 1 for i in range(1, 7))
    assert got[7].base_sha256 == hashlib.sha256(b"").hexdigest() and got[9].spans == "assign:0:19" and got[9].n_assign == 1
    assert secrets.scan_secrets(docs.where("false")).collect() == []


# -- toxicity ------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    bad = ["hateful", "vermin", "rubbish", "loathsome"]
    texts, toxic = [], []
    for i in range(600):
        w = words(rng, rng.randint(20, 80)).split()
        toxic.append(int(i % 3 == 0))
        for _ in range(4 * toxic[-1]):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
    docs = frame(spark, [*texts, None, "", "word " * 5000])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r["__doc_id"]: r.score for r in toxicity.score_toxicity(docs, labels, ~held).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(toxic[i]) for i in out)
    assert right / len(out) > 0.9 and all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    assert got[600] == got[601] < 0.5 and got[602] < 0.5


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none, F.lit(True)).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(docs.where("false"), none, F.lit(True)).collect() == []


# -- common --------------------------------------------------------------------------


def test_dropped_ids_and_shared_files(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    assert sorted((r.doc_id or 0) for r in drop_ids(df, spark.createDataFrame([(2,), (None,)], "doc_id long"), "doc_id").collect()) == [0, 1]
    assert materialize(df, "t").count() == 3


def test_exact_of_nothing_and_one_hot_text(spark):
    assert exact_dedup.exact_dedup(frame(spark, ["x"]).where("false")).collect() == []
    docs = frame(spark, ["one  text"] * 40 + ["one text", "other"] + [None] * 3).withColumn("key", F.lit("clash")).withColumn("chain", F.lit(1)).withColumn("n", F.lit(2))
    got = exact_dedup.exact_dedup(docs, hot_rows=10).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(i, 0, 41, i == 0) for i in range(41)] + [(41, 41, 1, True)] + [(i, 42, 3, i == 42) for i in (42, 43, 44)]
    assert exact_dedup.directory_depth(10**6, 4096) == (10, 4096) and exact_dedup.directory_depth(10**12, 4096)[0] <= 20


def test_words_that_fool_polynomial_hashes_differ(spark):
    for n in (1024, 2048):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        assert len(set(jaccard_join.word_hashes([word, other])[0].tolist())) == 2
        got = jaccard_join.jaccard_components(frame(spark, [word, other])).collect()
        assert sorted(r.component_id for r in got) == [0, 1]
