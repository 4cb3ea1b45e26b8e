"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints within three bits are linked. The 64 bits are cut into `segments` parts, of which
three errors leave `segments` - 3 untouched; the remaining bits form two halves, one of which
has one error at most. So a key is (untouched parts, half, codeword index): a fingerprint is
filed under the index its half decodes to and sought under those of the half's one-bit
changes (six at most), which is exact. Found pairs are verified on all 64 bits.

Four parts give keys of 28 bits and 50 rows a fingerprint, five give 38 bits and 126 rows;
beyond FOUR_SEGMENTS distinct fingerprints five are taken, so that keys stay nearly unique.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import golay
from tessella.llm.common import BROADCAST_IDS, durable, shuffle_partitions

MAX_BITS = 3
SEED = 42
#: A key under which more fingerprints are filed goes to the blockwise path.
HEAVY = 16
BLOCK = 2048
HOT = 500
#: A key of fewer than this many rows over HOT is never worth a branch of its own.
HOT_ROWS = 500_000
FOUR_SEGMENTS = 1_000_000_000
#: So many edges (16 bytes each) are contracted in one task; more go by distributed stars.
FEW_EDGES = 250_000


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Majority of the XXH64 bits of all shingles of the A-Z-lowered, blank-split text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        ones += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; null text has no words: 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _layout(segments: int) -> list[tuple[list[int], list[int]]]:
    """(bits that must be equal, bits of one half) for each kind of key."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for exact in combinations(range(segments), segments - MAX_BITS):
        rest = [b for i, p in enumerate(parts) if i not in exact for b in p]
        same = [b for i in exact for b in parts[i]]
        out += [(same, rest[: len(rest) // 2][:23]), (same, rest[len(rest) // 2 :][:23])]
    return out


def _bits(fps: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(places):
        out |= (fps >> b & 1) << k
    return out


def fuzzy_keys(fps: DataFrame, segments: int, probe: bool) -> DataFrame:
    """(key, fp): the keys a fingerprint is filed under, or those it is sought under."""
    layout = _layout(segments)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            whole = batch.column(0).to_numpy()
            for a in range(0, len(whole), 8192):
                part = whole[a : a + 8192]
                for kind, (same, half) in enumerate(layout):
                    exact = (_bits(part, same) * len(layout) + kind) << 12
                    word = _bits(part, half)
                    if probe:
                        index = np.sort(golay.ball_keys(word), axis=1)
                        new = np.concatenate([np.ones((len(part), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
                        row, col = np.nonzero(new)
                        keys, out = exact[row] | index[row, col], part[row]
                    else:
                        keys, out = exact | golay.decode(word), part
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _nearest_labels(of: np.ndarray, to: np.ndarray, labels: np.ndarray, none: int) -> np.ndarray:
    """For each fingerprint of `of` the least label among those of `to` within MAX_BITS."""
    out = np.full(len(of), none, np.int64)
    for a in range(0, len(of), 256):
        near = np.bitwise_count((of[a : a + 256, None] ^ to[None, :]).view(np.uint64)) <= MAX_BITS
        out[a : a + 256] = np.where(near, labels[None, :], none).min(axis=1, initial=none)
    return out


def _block_edges(pdf):
    """Stars over the linked fingerprints of one pair of blocks: as many rows as members."""
    import pandas as pd

    filed, sought = (np.unique(pdf.fp[pdf.probe == p].to_numpy()) for p in (False, True))
    n = len(sought) + len(filed)
    left, right = np.arange(len(sought)), np.arange(len(sought), n)
    while True:
        new_left = np.minimum(left, _nearest_labels(sought, filed, right, n))
        new_right = np.minimum(right, _nearest_labels(filed, sought, new_left, n))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    both = np.concatenate([sought, filed])
    to = both[np.concatenate([left, right])]
    return pd.DataFrame({"a": both[to != both], "b": to[to != both]})


def merged(df: DataFrame) -> DataFrame:
    """For joins whose sides grow with the documents: sorted and merged, never broadcast."""
    return df.hint("merge")


def links(fps: DataFrame, segments: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within three bits of each other.

    Both kinds of keys cross the network once. Keys under which many are filed are counted
    first; their rows, and no others, go blockwise: a block pair holds BLOCK rows of each side.
    Spark takes the expanded rows for as few as the fingerprints they come from and would
    broadcast them whole, so joins of them are merged unless the other side is counted."""
    # The expansion is fifty rows for one, so it starts from evenly dealt fingerprints.
    even = fps.select("fp").repartition(shuffle_partitions(fps.sparkSession), "fp")
    filed, sought = fuzzy_keys(even, segments, False), fuzzy_keys(even, segments, True)
    heavy = durable(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY))
    keys = heavy.count()
    if keys:
        named = heavy.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("filed_blocks"))
        few = F.broadcast if keys <= BROADCAST_IDS else merged
        light = filed.join(few(named.select("key")), "key", "left_anti")
    else:
        light = filed
    pairs = light.withColumnRenamed("fp", "b").join(merged(sought.withColumnRenamed("fp", "a")), "key")
    edges = pairs.where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    if not keys:
        return edges.distinct()
    near = durable(sought.join(few(named), "key"))
    seekers = near.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("sought_blocks"))
    seekers = few(seekers)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    every = F.expr("sequence(0L, others - 1L)")
    mine = filed.join(few(named), "key").join(seekers, "key").withColumnsRenamed({"filed_blocks": "blocks", "sought_blocks": "others"})
    theirs = near.join(seekers, "key").withColumnsRenamed({"sought_blocks": "blocks", "filed_blocks": "others"})
    rows = mine.select("key", "fp", F.lit(False).alias("probe"), block.alias("i"), F.explode(every).alias("j")).unionByName(
        theirs.select("key", "fp", F.lit(True).alias("probe"), F.explode(every).alias("i"), block.alias("j"))
    )
    return edges.unionByName(rows.groupBy("key", "i", "j").applyInPandas(_block_edges, "a long, b long")).distinct()


def _joined(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the one row of `values` (which has n, its rows' number) for their key.

    A key with over 1 row in HOT of the `total` is dealt out by broadcast: there are fewer
    than HOT of them. The others are merged, so that neither side goes through the driver.
    `values` are held, so that the plan stays short where no key is hot."""
    values = durable(values)
    if values.where(F.col("n") * HOT > max(total, HOT_ROWS)).isEmpty():
        return rows.join(merged(values.drop("n")), key)
    hot = F.broadcast(values.where(F.col("n") * HOT > total).drop("n"))
    rest = merged(values.where(F.col("n") * HOT <= total).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each reaches: roots are hooked to their
    least neighbour, then paths are halved; each round leaves half of the roots at most."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        hooked = root.copy()
        np.minimum.at(hooked, root[u], low)
        np.minimum.at(hooked, root[v], low)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        root = hooked
    return nodes, nodes[root]


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, in one task."""

    def run(batches):
        import pyarrow as pa

        held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        if held.num_rows:
            found = _least_reachable(held.column("a").to_numpy(), held.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, by alternating large and small stars.

    Each round of stars is six queries of the driver, so few edges are contracted at once."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root")).distinct()
        if state[0] <= FEW_EDGES:
            return _contracted(edges)
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _joined(both.where("b > a"), least, "a", 2 * state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least, "a", state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = durable(small.distinct())


def near_duplicates(docs: DataFrame, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row.

    Null and empty texts have fingerprint zero and are linked as any other; a long text is
    read whole. Rows with equal doc_id are kept; a null doc_id counts only where its group has
    no other. An empty table gives no rows; columns other than doc_id and text are ignored.
    `segments` None: chosen by the number of distinct fingerprints."""
    fps = durable(fingerprints(docs))
    groups = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    total, distinct = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    roots = durable(components(links(groups, segments or (4 if distinct <= FOUR_SEGMENTS else 5))))
    named = roots.join(merged(groups.withColumnRenamed("fp", "node")), "node")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n"))
    named = _joined(roots, least, "root", distinct).select(F.col("node").alias("fp"), "least_id")
    of_fp = groups.join(merged(named), "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id"))
    return _joined(fps, of_fp, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
