"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

A document of n distinct shingles gets the partition p = 1 + ceil(log2 n) and a one-permutation
MinHash of 2^p bins: the top p bits of a shingle's hash are its bin, a bin's least hash is
kept. A shingle of a long document thus is its bin's minimum with probability 0.78 or more
however long the document, so a short item inside it meets the item's own sketch of the same
partition in most of its bins; a document and an item that meet in one bin are candidates.
Items under EIGHT shingles use bins so fine that nothing is lost. Candidates are verified by
the share of the item's distinct shingles that the document holds, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, ids_side

SHINGLE = 5
THRESHOLD = 0.8
EIGHT = 8
FINE = 62
#: Documents of up to 2^39 distinct shingles have a partition.
MOST_P = 40
#: Item sketch rows (24 bytes each) and bytes of item shingles that may be broadcast; beyond,
#: both sides are shuffled.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hashes(text: Column, k: int) -> Column:
    """The sorted distinct shingle hashes (fewer words: the whole sequence)."""

    def of(w):
        several = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", w.cast("array<string>")))))
        none = F.array().cast("array<bigint>")
        return F.sort_array(F.array_distinct(F.when(F.size(w) >= k, several).when(F.size(w) > 0, short).otherwise(none)))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _shingles(text: Column, k: int) -> Column:
    def of(w):
        several = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        none = F.array().cast("array<string>")
        return F.array_distinct(F.when(F.size(w) >= k, several).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(none))

    return _let(words(text), of)


def _bin_minima(hashes: Column, p: Column) -> Column:
    """(p, h): of sorted hashes the first in each of the 2^p bins."""

    def bin_of(h):
        return F.call_function("shiftrightunsigned", h, F.lit(64) - p)

    firsts = F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))
    return F.transform(firsts, lambda h: F.struct(p.alias("p"), h.alias("h")))


def _doc_sketch(text: Column, k: int, coarse: bool, fine: bool) -> Column:
    def of(h):
        parts = []
        if coarse:
            size_p = (F.ceil(F.log2(F.greatest(F.size(h), F.lit(1)).cast("double"))) + 1).cast("int")
            parts.append(_let(size_p, lambda p: _bin_minima(h, p)))
        if fine:
            parts.append(_bin_minima(h, F.lit(FINE)))
        return F.concat(*parts)

    return _let(_hashes(text, k), of)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) for every pair at `threshold` or more.

    Null, empty and wordless texts match nothing; a long text is searched whole; an item of
    fewer than `k` words matches a document of the same words alone. Rows with equal id count as one document (of the
    shingles of all); null ids are carried as they are. Empty tables give no rows; columns
    other than the id and text are ignored."""
    thin = docs.selectExpr("doc_id", "text")
    item = items.selectExpr("item_id", "text")
    hashed = item.select("item_id", "text", _hashes(F.col("text"), k).alias("hashes"))
    size = F.size("hashes")
    weight = F.sum(F.when(size < EIGHT, size).otherwise(size * MOST_P))
    facts = hashed.agg(F.coalesce(weight, F.lit(0)).alias("n"), F.max((size > 0) & (size < EIGHT)).alias("fine"), F.max(size >= EIGHT).alias("coarse"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    spread = hashed.select("item_id", "hashes", F.explode(F.when(size < EIGHT, F.array(F.lit(FINE))).otherwise(F.sequence(F.lit(1), F.lit(MOST_P)))).alias("p"))
    item_sketch = spread.select("item_id", F.explode_outer(_bin_minima(F.col("hashes"), F.col("p"))).alias("s")).where("s is not null").select("item_id", "s.p", "s.h")
    if facts.n <= BROADCAST_ROWS:
        item_sketch = F.broadcast(item_sketch)
    sketch = _doc_sketch(F.col("text"), k, bool(facts.coarse) or not facts.fine, bool(facts.fine))
    doc_sketch = thin.select("doc_id", F.explode_outer(sketch).alias("s")).select("doc_id", "s.p", "s.h").where("h is not null")
    candidates = durable(doc_sketch.join(item_sketch, ["p", "h"]).select("doc_id", "item_id").distinct())

    item_shingles = item.select("item_id", _shingles(F.col("text"), k).alias("s")).select(F.col("item_id").alias("of_item"), F.size("s").alias("n_shingles"), F.explode_outer("s").alias("want"))
    found = thin.join(ids_side(candidates.select(F.col("doc_id").alias("c"))), F.expr("doc_id <=> c"), "left_semi")
    found = found.select("doc_id", F.explode_outer(_shingles(F.col("text"), k)).alias("shingle"))
    if facts.bytes * k <= BROADCAST_BYTES:
        # A candidate's shingles meet those of all items where they are made; few are left to shuffle.
        met = found.join(F.broadcast(item_shingles.withColumnRenamed("of_item", "item_id")), F.expr("shingle = want"))
        sought = F.broadcast if candidates.count() <= BROADCAST_ROWS else lambda df: df
        mine = candidates.select(F.col("doc_id").alias("c_doc"), F.col("item_id").alias("c_item"))
        common = met.join(sought(mine), F.expr("doc_id <=> c_doc and item_id <=> c_item"), "left_semi")
    else:
        wanted = candidates.join(item_shingles, F.expr("item_id <=> of_item")).select(F.col("doc_id").alias("want_doc"), "item_id", "n_shingles", "want")
        common = found.join(wanted, F.expr("doc_id <=> want_doc and shingle = want"))
    common = common.select("doc_id", "item_id", "n_shingles", "shingle").distinct()
    best = common.groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_common"))
    out = best.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_common", (F.col("n_common") / F.col("n_shingles")).alias("containment"))
    return out.where(F.col("n_common") >= F.col("n_shingles") * F.lit(threshold))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN its USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_common >= n_shingles * 0.8
"""
