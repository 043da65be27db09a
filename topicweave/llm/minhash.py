"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words. Per register an own hash function is
minimised over the set; the register keeps the minimum's leading-zero count and ten mantissa
bits, 16 bits in all. Documents with equal sets are one node. Four registers make a band; nodes
that agree in one of 32 bands are candidates: at similarity 0.75 a pair agrees in none with
probability 5e-6. A pair's registers then estimate its similarity, corrected for
registers that collide by chance; pairs within five deviations of the threshold are confirmed on
their full sets.

Pairs of a bucket are not sent anywhere. First each node is tried against the bucket's leader,
the node that shares most buckets: one pair per node. What is linked becomes components, and a
bucket that holds one component is done. The members of the others meet in blocks of a fixed
size with wider registers, four times as many; a task estimates the pairs of two blocks in
place, each pair in the first band it shares, confirms those of different components that may
reach the threshold, and hands on one link where it joins two of them. So every pair of a bucket is tried unless its ends are already in
one component. What this costs grows with the square of a family only where its members
share bands and yet no link.

A null text or one without words has an empty set and is linked with nothing. With fewer than
five words the whole sequence is one shingle. Rows with equal texts share a component.
``component_id`` is the smallest id reachable (nulls aside); a row without an id is kept if its
whole component has none. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import hashing
from topicweave.llm.common import shuffle_partitions
from topicweave.session import Scratch

SHINGLE = 5
REGISTERS, BAND = 128, 4
MANTISSA = 10
#: Deviations of the estimate below the threshold that a candidate may have.
SLACK = 5.0
#: Registers of the second estimate, and most members and shingles of a block.
WIDE, BLOCK, BLOCK_SHINGLES = 512, 512, 2_000_000

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)


def shingles(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(hashing.runs(hashing.words(data), SHINGLE))


def registers(members: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """The first compressed registers of a non-empty set."""
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(members), 512):
            values = members[at : at + 512, None] * _FACTORS[:count]
            values += _TERMS[:count]
            np.minimum(least, values.min(axis=0), out=least)
    fraction, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    bits = np.floor((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | bits


def band_keys(packed: np.ndarray) -> np.ndarray:
    """One key per band from the registers of one document."""
    words = packed.view("<u8").astype(np.uint64)  # four registers are 64 bits
    with np.errstate(over="ignore"):
        place = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return hashing.mixed(words * np.uint64(0x9E3779B97F4A7C15) + place).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the registers of pairs (rows) and the sets' sizes.

    Minima of sets without common members fall into one register with probability
    n m / (n + m)^2 / (2 ln 2) / 2^mantissa; the share of equal registers is corrected for it.
    """
    equal = (a == b).mean(axis=1)
    chance = n * m / (n + m) ** 2.0 / (2 * np.log(2)) / (1 << MANTISSA)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


SKETCH = "doc_id long, ta long, tb long, n long, sa long, sb long, registers binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Size, signature and registers of each document's set. Moves no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sig_a, sig_b, packed = [], [], [], []
            for data in hashing.texts(batch.column(3)):
                own = shingles(data)
                sizes.append(len(own))
                with np.errstate(over="ignore"):
                    sig_a.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    sig_b.append(int(hashing.mixed(own + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                packed.append(registers(own).astype("<u2").tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sig_a, pa.int64()),
                 pa.array(sig_b, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "ta", "tb", "n", "sa", "sb", "registers"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ta"),
        F.xxhash64(F.lit(1), F.col("text")).alias("tb"), F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(work, SKETCH)


def bands(nodes: DataFrame) -> DataFrame:
    """``node, key``: one row per band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(r.as_buffer(), dtype="<u2") for r in batch.column(1)]
            if not packed:
                continue
            keys = np.concatenate([band_keys(p) for p in packed])
            ids = np.repeat(batch.column(0).to_numpy(), REGISTERS // BAND)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["node", "key"])

    return nodes.select("node", "registers").mapInArrow(work, "node long, key long")


def in_company(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows whose key occurs twice or more, with the number of its members. The counts are
    written first, so that the join can split a hot key."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counts = scratch.write(counts, f"counts-{name}")
    return rows.join(counts, "key")


def least_estimate(threshold: float, count: int) -> float:
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / count))


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimated similarity may reach the threshold."""
    least = least_estimate(threshold, REGISTERS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
                for i in (4, 5)
            )
            n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            ok = (estimate(a, b, n, m) >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"]
            )

    side = [
        nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
        for c in ("a", "b")
    ]
    both = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "na", "nb", "ra", "rb")
    return both.mapInArrow(work, "a long, b long")


def widened(bodies: DataFrame) -> DataFrame:
    """``node, n, wide, body``: the wider registers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(data) for data in hashing.texts(batch.column(1))]
            wide = [registers(own, WIDE).astype("<u2").tobytes() for own in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(own) for own in sets], pa.int64()), pa.array(wide, pa.binary()),
                 batch.column(1)],
                names=["node", "n", "wide", "body"],
            )

    return bodies.select("node", "body").mapInArrow(work, "node long, n long, wide binary, body binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the threshold."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def links_of_blocks(
    key: int, own: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, wide: np.ndarray,
    bodies: list[bytes], percent: int,
) -> list[tuple[int, int]]:
    """Links of one bucket between two blocks (or inside one) that join components."""
    threshold = percent / 100
    words = np.ascontiguousarray(wide[:, :REGISTERS]).view("<u8")
    keys = np.stack([band_keys(np.ascontiguousarray(w[:REGISTERS])) for w in wide])
    one_block = own.min() == own.max()
    first_block = np.arange(len(own)) if one_block else np.flatnonzero(own == own.min())
    other = first_block if one_block else np.flatnonzero(own != own.min())
    sets: dict[int, np.ndarray] = {}
    joined = {r: r for r in root.tolist()}
    links = []

    def top(r: int) -> int:
        while joined[r] != r:
            joined[r] = r = joined[joined[r]]
        return r

    def members(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(np.frombuffer(bodies[k], dtype=np.uint8))
        return sets[k]

    for at in range(0, len(first_block), 64):
        rows = first_block[at : at + 64]
        able = (root[rows, None] != root[None, other]) & (
            np.minimum(n[rows, None], n[None, other]) >= threshold * np.maximum(n[rows, None], n[None, other])
        )
        if one_block:
            able &= rows[:, None] < other[None, :]
        i, j = np.nonzero(able)
        i, j = rows[i], other[j]
        for part in range(0, len(i), 20_000):
            a, b = i[part : part + 20_000], j[part : part + 20_000]
            # A pair belongs to the bucket of the first band it shares.
            band = (words[a] == words[b]).argmax(axis=1)
            mine = keys[a, band] == key
            a, b = a[mine], b[mine]
            near = estimate(wide[a], wide[b], n[a].astype(float), n[b].astype(float)) >= least_estimate(threshold, WIDE)
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                one, two = top(int(root[x])), top(int(root[y]))
                if one != two and alike(members(x), members(y), percent):
                    joined[one] = two
                    links.append((int(node[x]), int(node[y])))
    return links


def across_components(open_rows: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Links between different components in buckets ``key, node, root, members``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def settled() -> pa.RecordBatch:
            own, node, root, n, raw, bodies = zip(*held, strict=True)
            links = links_of_blocks(
                place[0], np.array(own), np.array(node), np.array(root), np.array(n),
                np.frombuffer(b"".join(raw), dtype="<u2").reshape(len(raw), WIDE), list(bodies), percent,
            )
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != place:
                    if held:
                        yield settled()
                    place, held = row[:3], []
                held.append(row[3:])
        if held:
            yield settled()

    size = open_rows.join(wide.select("node", "n"), "node").groupBy("key").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    rows = open_rows.join(size, "key").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks"))
    )
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root"
    )
    place = ["key", "low", "high"]
    dealt = (
        met.join(wide, "node")
        .select(*place, "own", "node", "root", "n", "wide", "body")
        .repartition(shuffle_partitions(open_rows.sparkSession), *place)
        .sortWithinPartitions(*place)
    )
    return dealt.mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            ok = []
            b_texts = hashing.texts(batch.column(3))
            for k, (a, data) in enumerate(zip(batch.column(0).to_pylist(), b_texts, strict=True)):
                if a != last:
                    last, held = a, shingles(next(hashing.texts(batch.column(2)[k : k + 1])))
                ok.append(alike(held, shingles(data), percent))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"]
            )

    side = [bodies.select(F.col("node").alias(c), F.col("body").alias(f"t{c}")) for c in ("a", "b")]
    both = pairs.join(side[1], "b").join(side[0], "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(work, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node with a link.

    A node's label is a smaller node of its component. Each turn a node looks at its
    neighbours' labels' labels; the smallest is offered to the node and to its present label,
    and the node takes its own label's label if that is smaller. Labels form trees whose
    height halves and whose roots are hooked to smaller ones, so chains of any order take a
    logarithmic number of turns. Labels are written each turn.
    """
    edges = scratch.write(
        links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges"
    )
    labels = scratch.slot(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")),
        f"{name}-labels", 0,
    )
    turn = 0
    while True:
        turn += 1
        above = labels.select(F.col("node").alias("_n"), F.col("root").alias("up"))
        high = labels.join(above, labels["root"] == above["_n"]).select("node", "root", "up")
        near = edges.join(high.select(F.col("node").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("near"))
        seen = high.join(near, high["node"] == near["a"])
        # (node, label offered): to the node itself and to the label it has
        offers = seen.select(
            F.inline(
                F.array(
                    F.struct(F.col("node"), F.least("up", "near").alias("offer"), F.col("root").alias("old")),
                    F.struct(F.col("root").alias("node"), F.col("near").alias("offer"), F.lit(None).cast("long").alias("old")),
                )
            )
        )
        new = offers.groupBy("node").agg(F.min("offer").alias("offer"), F.max("old").alias("old"))
        new = new.select("node", F.least("old", "offer").alias("root"), "old")
        new = scratch.slot(new, f"{name}-labels", turn)
        if new.where("root < old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def leaders(members: DataFrame, popular: DataFrame) -> DataFrame:
    """``key, leader``: of each bucket the node that shares most buckets, then the smallest."""
    ranked = members.join(popular, "node").select("key", F.struct("popularity", -F.col("node")).alias("rank"))
    best = ranked.groupBy("key").agg(F.max("rank").alias("rank"))
    return best.select("key", (-F.col("rank.col2")).alias("leader"))


def link(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, ta, tb, n_shingles, component_id, kept, root`` of every document; ``root`` is one
    number per component, null for documents without words.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    threshold = percent / 100
    sketch = scratch.write(
        sketches(docs).withColumn("_at", F.monotonically_increasing_id()), "sketches"
    )
    nodes = scratch.write(
        sketch.where("n > 0")
        .groupBy("sa", "sb", "n")
        .agg(
            F.min(F.struct("_at", "doc_id", "ta", "tb")).alias("row"),
            F.min("doc_id").alias("first_doc"),
            F.first("registers").alias("registers"),
        )
        .select(
            F.col("row._at").alias("node"), "sa", "sb", "n", "first_doc", "registers",
            F.col("row.doc_id").alias("row_doc"), F.col("row.ta").alias("row_ta"), F.col("row.tb").alias("row_tb"),
        ),
        "nodes",
    )
    members = scratch.write(in_company(bands(nodes), scratch, "bands"), "members")
    popular = scratch.write(
        members.groupBy("node").agg(F.sum("members").alias("popularity")), "popular"
    )
    wanted = nodes.join(popular, "node").select("node", "row_doc", "row_ta", "row_tb")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ta"),
        F.xxhash64(F.lit(1), F.col("text")).alias("tb"), F.col("text").cast("binary").alias("body"),
    )
    # Rows that agree in id and text match alike: one body per node is enough.
    bodies = scratch.write(
        wanted.join(
            keyed,
            wanted["row_doc"].eqNullSafe(keyed["doc_id"])
            & (wanted["row_ta"] == keyed["ta"]) & (wanted["row_tb"] == keyed["tb"]),
        ).select("node", "body"),
        "bodies",
    )

    first = leaders(members, popular)
    stars = members.join(first, "key").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    stars = scratch.write(ordered(stars), "stars")
    near = scratch.write(likely(stars, nodes, threshold), "likely-stars")
    links = scratch.write(confirmed(near, bodies, percent).distinct(), "links-stars")
    roots = components(links, scratch, "stars")

    # Buckets that still hold several components; their leaders have been tried with all.
    rest = members.join(first, "key").where("node <> leader").select("key", "node")
    placed = rest.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")
    ).where("low < high").select("key", "members")
    several = scratch.write(several, "several")
    open_rows = scratch.write(placed.join(several, "key"), "open")
    if not open_rows.isEmpty():
        wanted = open_rows.select("node").distinct()
        wide = scratch.write(widened(bodies.join(wanted, "node")), "wide")
        more = scratch.write(ordered(across_components(open_rows, wide, percent)), "links-rest")
        roots = components(links.union(more), scratch, "all")

    owned = nodes.join(roots, "node", "left").select(
        "sa", "sb", "n", "first_doc", F.coalesce("root", "node").alias("root")
    )
    least = owned.groupBy("root").agg(F.min("first_doc").alias("component"))
    named = owned.join(least, "root").select(
        F.col("sa").alias("_sa"), F.col("sb").alias("_sb"), F.col("n").alias("_n"), "component", "root"
    )
    out = sketch.join(
        named, (sketch["sa"] == named["_sa"]) & (sketch["sb"] == named["_sb"]) & (sketch["n"] == named["_n"]), "left"
    )
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "ta", "tb", F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"), "root",
    )
