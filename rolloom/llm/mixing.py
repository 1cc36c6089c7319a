"""Mixing sources to target weights.

Sources share ``share`` times all words by weight, but none gets more than
``most_epochs`` times its own words; what is cut off there goes to the others by
weight, until none is above. Within a source the documents have a hash-random order. A
source's mix is its whole order, as often as the target holds it, and then the order's
beginning up to the exact word.

That word is found by prefix sums in two levels. The range of the hash is cut into cells
of about ``cell_rows`` documents; cells are summed and those sums added up along each
source, which gives the cell that the budget ends in. Only the rows of that cell are
sorted, and give the document that is cut. Every other document knows what is taken of it
by comparing its hash with that of the cut one, so no text is shuffled and no task holds a
source, however large.

Edge cases: null text has no words, is kept and adds nothing; a null source is a source
of its own, after all others; rows with the same id or none have different places if
their texts differ, and equal ones share evenly what falls on them (less than a word each
is lost); texts of any length are counted whole; an empty table gives an empty result; a
source without words has target 0. Reruns agree: the order is a hash of id and text, not
of place. Extra columns are passed over by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

WORD = f"[^{SPACE}]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """``skey, source_size, target`` from ``skey, source_size``: one row for each source.

    With the sources sorted by (limit / weight), those that meet their limit are a
    beginning of that order, which running sums find without iteration."""
    ranked = Window.orderBy("skey")  # one row for each source
    by_ratio = Window.orderBy("ratio", "skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(most_epochs)).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    src = src.withColumns(
        {
            "pool": F.least(F.sum("source_size").over(everything) * share, F.sum("most").over(everything)),
            "before": F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
            "rest_w": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("full", (F.col("pool") - F.coalesce("before", F.lit(0.0))) / F.col("rest_w") >= F.col("ratio"))
    level = (F.max("pool").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return src.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level)).select("skey", "source_size", "target")


#: One row for each source is broadcast up to this number of sources, joined by shuffle beyond.
MOST_BROADCAST_SOURCES = 10_000


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """Columns that a document's place and size follow from."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), text)
    return {
        "__skey": F.when(F.col(source_col).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source_col))),
        "__size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "__order": F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"),
    }


def _with_budgets(rows: DataFrame, placed: DataFrame, id_col: str, weights: Sequence[float], share: float, most_epochs: int, cell_rows: int) -> DataFrame:
    """``rows`` with what is taken of each: ``__source_size, __target, __epochs`` (whole
    copies) and ``__cut`` (words of one more copy, from its start). ``placed`` holds
    id, ``__skey, __size, __order`` of the same rows."""
    sources = materialize(placed.groupBy("__skey").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    total, few = sources.agg(F.sum("n"), F.count("*")).first()
    side = F.broadcast if few <= MOST_BROADCAST_SOURCES else (lambda df: df)
    targets = source_targets(sources.select(F.col("__skey").alias("skey"), "source_size"), weights, share, most_epochs).withColumnRenamed("skey", "__skey")
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    cells = max(1, -(-(total or 0) // cell_rows))
    cell = F.least(F.floor(F.col("__order") / F.lit(2.0**60) * cells), F.lit(cells - 1)).alias("cell")
    along = Window.partitionBy("__skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__skey", cell).agg(F.sum("__size").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0)))
    last = sums.join(side(targets), "__skey").where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size")))
    last = materialize(last.select("__skey", "cell", "start", "rest"), "mix-cells")  # one row a source
    # equal rows are one with their number
    inside = placed.withColumn("cell", cell).join(side(last), ["__skey", "cell"]).groupBy("__skey", "start", "rest", "__order", F.col(id_col).alias("id"), "__size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__skey").orderBy("__order", "id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("__size") * F.col("n")).over(before), F.lit(0)))
    end = inside.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("__size") * F.col("n")))
    end = end.select("__skey", F.struct("__order", "id", "__size").alias("end"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).alias("part"))
    decided = materialize(targets.join(end, "__skey", "left"), "mix-budgets")
    own = F.struct("__order", F.col(id_col).alias("id"), "__size")
    cut = F.when(own < F.col("__end"), F.col("__size")).when(own == F.col("__end"), F.col("__part")).otherwise(F.lit(0))
    decided = decided.select("__skey", *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "end", "part")])  # beside columns of any name
    return rows.join(side(decided), "__skey").withColumn("__cut", cut.cast("long")).drop("__end", "__part")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = 4_000, seed: int = 17) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken``, and
    ``epochs`` (whole copies) and ``cut`` (words of one more copy, from its start)."""
    placed = materialize(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in _placed(docs, id_col, text_col, source_col, seed).items()]), "mix-sizes")
    out = _with_budgets(placed, placed, "doc_id", weights, share, most_epochs, cell_rows)
    taken = F.col("__epochs") * F.col("__size") + F.col("__cut")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"), F.col("__epochs").alias("epochs"), F.col("__cut").alias("cut"))


def first_words(text, n):
    """The text up to the end of its ``n``-th word, white space kept."""
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = 4_000, seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken; where a source's budget ends
    inside a document, its last copy is cut after that word. Documents without words
    are neither here nor there for a budget in words: they stay, once."""
    rows = docs.withColumns(_placed(docs, id_col, text_col, source_col, seed))
    placed = materialize(rows.select(id_col, "__skey", "__size", "__order"), "mix-sizes")
    mixed = _with_budgets(rows, placed, id_col, weights, share, most_epochs, cell_rows)
    size, cut = F.col("__size"), F.col("__cut")
    whole = F.when(size == 0, F.lit(1)).otherwise(F.col("__epochs") + (cut == size).cast("int"))
    part = F.when((cut > 0) & (cut < size), F.array(cut)).otherwise(F.array().cast("array<bigint>"))
    # 0 stands for a whole copy, a positive number for a cut one
    copies = mixed.withColumn("__copy", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), part)))
    text = F.when(F.col("__copy") > 0, first_words(F.col(text_col), F.col("__copy"))).otherwise(F.col(text_col))
    return copies.select(*[text.alias(c) if c == text_col else c for c in docs.columns])
