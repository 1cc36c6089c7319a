"""Secret scan with corpus-wide ownership frequency.

A first pass finds candidates in each text: the base kinds (assignments, access
keys, long hex runs) and bare tokens that look random. Their values are hashed, and
for every hash the corpus tells how many distinct repositories and owners show it.
A value of many owners is an example that people copy; one that stays with few and
looks random is taken for a live credential. Base spans are all reported whatever
their class; bare tokens become spans only where they are live. A value shared by
very many rows is counted by (hash, repository, owner) first; the answers for values of
over ``hot_rows`` rows are broadcast (there is at most one for so many candidates), so no
task gets the rows of such a value; only hashes, positions and a digest a document are
shuffled, never text.

Without other columns, ``source`` stands for the owner and ``source/lang`` for the
repository.

Edge cases: a null text is empty and has no spans; null repositories and owners are
one unnamed repository and owner; repeated rows are rows of their own and do not add
owners; an empty table gives an empty result; texts of any length are scanned whole;
extra columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"[A-Za-z0-9+_=-]{16,}")
KINDS = ("assign", "access", "hex", "bare")
FIELDS = "n_assign long, n_access long, n_hex long, base string, candidates array<struct<start:int,kind:int,end:int,hash:long,random:boolean>>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    return sum(c.isdigit() for c in value) >= 3 and any(c.isalpha() for c in value) and entropy(value) >= 2.75


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start, then kind.

    Of access keys and hex runs a match that is too short ends where the run ends, so
    asking for the least length in the pattern finds the same spans; assignments are
    matched at any length and dropped afterwards, as a short one hides what it covers."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _scan(texts: list) -> dict:
    out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "candidates")}
    for text in texts:
        text = text or ""
        base = base_spans(text)
        kinds = Counter(k for _, k, _, _ in base)
        for k, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(kinds[k])
        out["base"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base))
        own = [{"start": a, "kind": k, "end": b, "hash": _hash(v), "random": looks_random(v)} for a, k, b, v in base]
        at, reach = 0, 0  # base spans that begin before the token ends, and how far they reach
        for m in BARE.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                reach, at = max(reach, base[at][2]), at + 1
            if reach <= m.start() and looks_random(m[0]):
                own.append({"start": m.start(), "kind": 3, "end": m.end(), "hash": _hash(m[0]), "random": True})
        out["candidates"].append(own)
    return out


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, repositories, owners, n`` (rows) from rows ``hash, repo, owner``."""
    each = candidates.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.count("*").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, most_owners: int = 2, most_repositories: int = 3, hot_rows: int = 50_000) -> DataFrame:
    """One row a document: counts and digest of the base spans, ``spans`` with the added
    ones, ``n_live`` and ``n_example`` (candidates by class)."""
    repo = F.coalesce(repo if repo is not None else F.concat_ws("/", "source", "lang"), F.lit(""))
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = map_texts(given, "text", ["id", "repo", "owner"], FIELDS, lambda: _scan)
    found = found.withColumn("base", F.sha2("base", 256)).withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "secret-candidates")
    each = found.select("row", F.col("__repo").alias("repo"), F.col("__owner").alias("owner"), F.explode("candidates").alias("c")).withColumn("hash", F.col("c.hash"))
    known = materialize(ownership(each.select("hash", "repo", "owner")), "secret-owners")
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    known = known.select("hash", few.alias("few"), (F.col("n") > hot_rows).alias("hot"))
    hot = known.where("hot").select("hash", F.col("few").alias("hot_few"))
    marked = each.select("row", "c", "hash").join(F.broadcast(hot), "hash", "left")
    judged = marked.where("hot_few is null").drop("hot_few").join(known.where("not hot").select("hash", "few"), "hash")
    judged = judged.unionByName(marked.where("hot_few is not null").withColumnRenamed("hot_few", "few")).withColumn("live", F.col("few") & F.col("c.random"))
    shown = F.when((F.col("c.kind") < 3) | F.col("live"), F.struct("c.start", "c.kind", "c.end"))
    some = judged.groupBy("row").agg(F.sort_array(F.collect_list(shown)).alias("shown"), F.count_if("live").alias("n_live"), F.count_if(~F.col("few")).alias("n_example"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("shown", lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")
    some = some.select(F.col("row").alias("of"), spans.alias("spans"), "n_live", "n_example")
    counts = ("n_assign", "n_access", "n_hex")
    none = found.where(F.size("candidates") == 0).select("__id", *counts, "base", F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    with_some = found.where(F.size("candidates") > 0).select("row", "__id", *counts, "base").join(some, F.col("row") == F.col("of")).select(*none.columns)
    return with_some.unionByName(none).select(F.col("__id").alias(id_col), *counts, F.col("base").alias("base_sha256"), "spans", "n_live", "n_example")
