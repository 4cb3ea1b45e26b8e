"""Mixing sources to target weights by Poisson replication and a global shuffle.

A source's mean repetition rate is its target share of `size` documents over the documents it
has. A document's count inverts the Poisson distribution with that mean at a uniform number
hashed from seed and doc_id, so equal runs give equal mixes and sources do not disturb each
other. Copies are exploded and sorted by a hash of (seed, doc_id, copy). No rate is too high:
beyond TABLE_RATE each row sums the terms around its mean, relative to the first of them, as
exp(-rate) would underflow and a table of the source would be long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable

SEED = 17
#: Bytes of rate tables that may be broadcast. Beyond, the tables of sources that hold over one
#: row in HOT are (there are fewer than HOT of those, of 7 KB at most), and the rest is shuffled.
BROADCAST_BYTES = 16 << 20
HOT = 500
#: Rates up to this have their distribution function as a table for the source.
TABLE_RATE = 500.0
#: Copies exploded at once, so that no array grows with the rate.
BLOCK = 65_536


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else F.lit(str(p)) for p in parts]))


def uniform(seed: int, *columns: str) -> Column:
    """[0, 1) from the first 52 bits of a hash."""
    return F.conv(F.substring(_hash(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: str) -> Column:
    """The distribution function at 0, 1, ... as far as doubles tell it from 1."""
    return F.expr(f"""
        aggregate(sequence(1, cast(ceil({rate} + 12 * sqrt({rate}) + 20) as int)),
                  named_struct('cdf', array(exp(-{rate})), 'p', exp(-{rate})),
                  (a, k) -> named_struct('cdf', concat(a.cdf, array(element_at(a.cdf, -1) + a.p * {rate} / k)), 'p', a.p * {rate} / k),
                  a -> a.cdf)""")


def _window(rate: str) -> tuple[str, str]:
    """Bounds of the counts that doubles tell apart: beyond 12 deviations a tail is under 2^-52."""
    return f"cast(greatest(0, floor({rate} - 12 * sqrt({rate}) - 20)) as bigint)", f"cast(ceil({rate} + 12 * sqrt({rate}) + 20) as bigint)"


def window_mass(rate: str) -> Column:
    """The sum of the window's terms, the first of them taken as 1."""
    low, high = _window(rate)
    return F.expr(f"""
        aggregate(sequence({low} + 1, {high}), named_struct('mass', 1d, 'p', 1d),
                  (a, k) -> named_struct('mass', a.mass + a.p * {rate} / k, 'p', a.p * {rate} / k),
                  a -> a.mass)""")


def window_count(rate: str, mass: str, u: str) -> Column:
    """How many values of the distribution function are at most `u`, from the terms of the window."""
    low, high = _window(rate)
    return F.expr(f"""
        {low} + aggregate(sequence({low} + 1, {high}), named_struct('cdf', 1d / {mass}, 'p', 1d / {mass}, 'n', if(1d / {mass} <= {u}, 1L, 0L)),
                  (a, k) -> named_struct('cdf', a.cdf + a.p * {rate} / k, 'p', a.p * {rate} / k, 'n', a.n + if(a.cdf + a.p * {rate} / k <= {u}, 1L, 0L)),
                  a -> a.n)""")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None) -> tuple[DataFrame, int]:
    """((_mix_source, n, rate), number of documents): mean repetition of each source; `weights` None: all sources alike.

    A source that has no weight gets none of the mix; a weight without documents is left out
    and its share goes to the others. `size` None: as many documents as there are."""
    counts = durable(docs.groupBy(F.col("source").alias("_mix_source")).agg(F.count("*").alias("n")))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_mix_source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    facts = counts.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    target = float(facts.total) if size is None else float(size)
    rate = F.col("weight") * F.lit(target) / F.lit(facts.weights) / F.col("n") if facts.weights > 0 else F.lit(0.0)
    return counts.select("_mix_source", "n", rate.alias("rate")), facts.total


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of `docs` with copy (1, 2, ...), n_copies, rate and shuffle_key, in its order.

    Null source is a source of its own that named weights do not reach; null and empty texts
    count like others, a long text is carried whole; rows with equal doc_id (null too) share
    one draw: equal counts and keys; an empty table gives none. Columns of the added names are
    replaced. copy and n_copies are longs."""
    docs = docs.drop("copy", "n_copies", "rate", "shuffle_key", "_mix_source")
    rate, total = rates(docs, weights, size)
    low = F.col("rate") <= TABLE_RATE
    table = rate.select("_mix_source", "n", "rate", F.when(low, poisson_cdf("rate")).alias("_mix_cdf"), F.when(~low, window_mass("rate")).alias("_mix_mass"))
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    size_of = F.coalesce(F.octet_length("_mix_source"), F.lit(0)) + 64 + F.when(low, 8 * (F.col("rate") + 12 * F.sqrt("rate") + 22)).otherwise(0)
    if rate.agg(F.coalesce(F.sum(size_of), F.lit(0.0))).first()[0] <= BROADCAST_BYTES:
        placed = docs.join(F.broadcast(table.drop("n")), same)
    else:
        hot, rest = table.where(F.col("n") * HOT > total).drop("n"), table.where(F.col("n") * HOT <= total).drop("n")
        placed = docs.join(F.broadcast(hot), same).unionByName(docs.join(F.broadcast(hot.select("_mix_source")), same, "left_anti").join(rest, same))
    placed = placed.withColumn("_mix_u", uniform(seed, "doc_id"))
    count = F.when(low, F.expr("size(filter(_mix_cdf, c -> c <= _mix_u))")).otherwise(window_count("rate", "_mix_mass", "_mix_u"))
    placed = placed.withColumn("n_copies", count.cast("long")).where("n_copies > 0").drop("_mix_cdf", "_mix_mass", "_mix_u", "_mix_source")
    blocks = placed.withColumn("_mix_block", F.explode(F.expr(f"sequence(0L, (n_copies - 1) div {BLOCK})")))
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(_mix_block * {BLOCK} + 1, least(n_copies, (_mix_block + 1) * {BLOCK}))"))).drop("_mix_block")
    return copies.withColumn("shuffle_key", _hash(seed, "doc_id", "copy")).orderBy("shuffle_key")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT count(*) AS sources, sum(n) AS total FROM s),
r AS (SELECT source, 1.0::DOUBLE * total::DOUBLE / sources::DOUBLE / n::DOUBLE AS rate FROM s, t),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 60) g(k)),
d AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS UBIGINT)::DOUBLE / {1 << 52}.0::DOUBLE AS u FROM documents),
c AS (SELECT doc_id, d.source, text, CAST(count(*) FILTER (WHERE cdf <= u) AS INTEGER) AS n_copies FROM d JOIN p ON d.source = p.source GROUP BY ALL),
e AS (SELECT doc_id, source, text, n_copies, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM c)
SELECT doc_id, source, text, copy, n_copies, md5('{SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""
