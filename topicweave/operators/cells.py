"""Cells placed in blocks, and the two sums every model loop is made of.

Cells are placed once, by document, into blocks that are also Spark partitions.
In a loop only factor rows travel: a word's row goes once to each block that has
the word (``routes``), never once per cell, and the word sums leave a block
already combined. A word that fills a third of all cells therefore costs at most
one row per block. Small factors (checked) are broadcast instead.

The sums of loops read the cells as :class:`Packed`: one row per word of a block.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions.counted import counted_words
from topicweave.functions.vectors import UNROLL, build, dot, joined_slabs, slabs
from topicweave.operators.counts import word_counts
from topicweave.operators.passes import (
    SUMS,
    Rows,
    block_sums,
    cell_values,
    from_keys,
    packed_cells,
    packed_schema,
    squares,
)

# A factor at most this large is broadcast; a larger one is routed.
BROADCAST_BYTES = 64 * 1024 * 1024
# Cells of one document beyond this are spread over several blocks.
DOCUMENT_CELLS = 1_000_000
# Input of a block: texts and cells beyond this get more blocks than the session's partitions.
BLOCK_BYTES = 64 * 1024 * 1024
# Documents of a packed block at most on average, and numbers of their factor rows.
PACKED_DOCS = 131_072
PACKED_VALUES = 2_000_000
# Cells of a packed block that make another one worth its copy of the factor rows.
PACKED_BLOCK_CELLS = 8_000_000


def _block_of(doc_id: Column, part: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, part), F.lit(blocks)).cast("int")


def _word_group(word_groups: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(word_groups)).cast("int")


def _word_key() -> Column:
    return F.concat(F.lit("w"), F.col("word")).alias("key")


def _doc_key() -> Column:
    """Before all words in order."""
    return F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key")


def _first_block(homes: int, joined: int, word_groups: int) -> Column:
    """The packed block of a document's group with the first group of words. A group is ``joined``
    neighbours of ``homes`` places, which are the blocks of the cells unless groups are more: the
    cells of a block then go to one group, and a word's come there in few rows.
    """
    home = _block_of(F.col("doc_id"), F.lit(0), homes)
    return F.floor(home / F.lit(joined)).cast("int") * word_groups


@dataclass
class Packed:
    """The cells by groups of documents and words: a block is one of ``doc_groups`` groups of
    documents and one of ``word_groups`` groups of words.

    ``rows`` has ``key, block, mark, d, n``: mark 0 and the key ``d...`` for a document (``d``
    holds it), mark 1 and the key ``w...`` for a word with arrays of its documents and
    counts; partitioned by block, sorted by key.
    A word's factor row goes to the groups of documents that have it, a document's to the groups
    of words, so fewer rows travel than with as many groups of documents as there are blocks.
    """

    rows: DataFrame
    routes: DataFrame | None  # word, block; kept partitioned by word; None for one group of documents
    doc_groups: int
    word_groups: int
    first: Column  # the block of a document's group with the first group of words

    @property
    def blocks(self) -> int:
        return self.doc_groups * self.word_groups

    def release(self) -> None:
        self.rows.unpersist()
        if self.routes is not None:
            self.routes.unpersist()


@dataclass
class CellBlocks:
    cells: DataFrame  # block, word, doc_id, n; partitioned by block, persisted
    words: DataFrame  # the distinct words, persisted
    blocks: int
    n_docs: int
    n_words: int
    n_cells: int
    total: float
    split_docs: DataFrame | None  # doc_id, parts of the documents in several blocks
    broadcast_bytes: int
    uncounted: int = 0  # cells whose count is null
    _packed: dict[tuple[int, int], Packed] = field(default_factory=dict, repr=False)

    @cached_property
    def routes(self) -> DataFrame:
        """(word, block): which blocks hold a word; kept partitioned by word."""
        routes = self.cells.select("word", "block").distinct()
        return routes.repartition(self.blocks, "word").persist()

    def _fits(self, rows: int, k: int) -> bool:
        # key, array header and hash-map slot come to less than 96 bytes a row
        return rows * (8 * k + 96) <= self.broadcast_bytes

    def _words_to_blocks(self, words: DataFrame) -> DataFrame:
        return self.routes.join(words, "word").repartitionById(self.blocks, F.col("block"))

    def _docs_to_blocks(self, docs: DataFrame) -> DataFrame:
        if self.split_docs is None:
            home = _block_of(F.col("doc_id"), F.lit(0), self.blocks)
            placed = docs.withColumn("block", home)
        else:
            parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
            homes = F.transform(parts, lambda p: _block_of(F.col("doc_id"), p, self.blocks))
            placed = (
                docs.join(self.split_docs, "doc_id", "left")
                .withColumn("block", F.explode(F.array_distinct(homes)))
                .drop("parts")
            )
        return placed.repartitionById(self.blocks, F.col("block"))

    def with_words(self, cells: DataFrame, words: DataFrame, k: int) -> DataFrame:
        """Add the word factor ``a`` (frame ``word, a``) to every cell."""
        if self._fits(self.n_words, k):
            return cells.join(F.broadcast(words), "word")
        routed = self._words_to_blocks(words)
        return cells.join(routed.hint("shuffle_hash"), ["block", "word"])

    def with_docs(self, cells: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        """Add the document factor ``b`` (frame ``doc_id, b``) to every cell."""
        if self._fits(self.n_docs, k):
            return cells.join(F.broadcast(docs), "doc_id")
        routed = self._docs_to_blocks(docs)
        return cells.join(routed.hint("shuffle_hash"), ["block", "doc_id"])

    def joined(self, words: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        """Every cell with both factors."""
        return self.with_docs(self.with_words(self.cells, words, k), docs, k)

    def packed(self, k: int) -> Packed:
        """The cells packed for passes with k topics; kept."""
        held = max(1, min(PACKED_DOCS, PACKED_VALUES // k))
        wanted = max(1, -(-self.n_docs // held))
        homes = max(self.blocks, wanted)
        joined = homes // wanted
        shape = homes, joined
        if shape not in self._packed:
            self._packed[shape] = self._pack(homes, joined)
        return self._packed[shape]

    def _packed_blocks(self) -> int:
        """A document's factor row goes to every group of words, so there are no more blocks than
        tasks and cells ask for.
        """
        tasks = 2 * self.cells.sparkSession.sparkContext.defaultParallelism
        return min(self.blocks, max(tasks, -(-self.n_cells // PACKED_BLOCK_CELLS)))

    def _pack(self, homes: int, joined: int) -> Packed:
        doc_groups = -(-homes // joined)
        word_groups = max(1, -(-self._packed_blocks() // doc_groups))
        first = _first_block(homes, joined, word_groups)
        words = self.cells.where("n is not null and doc_id is not null").select(
            (first + _word_group(word_groups)).alias("block"), F.lit(1).alias("mark"), _word_key(),
            F.col("doc_id").alias("d"), "n",
        )
        keys = ["doc_id"] if self.split_docs is not None else ["block", "doc_id"]
        docs = self.cells.select(*keys).distinct().where("doc_id is not null").select(
            F.explode(F.sequence(first, first + (word_groups - 1))).alias("block"),
            F.lit(0).alias("mark"), _doc_key(), F.col("doc_id").alias("d"), F.lit(0.0).alias("n"),
        )
        # cells of a word are put together before they travel, and lie side by side afterwards
        words = words.mapInArrow(packed_cells, packed_schema(words.schema["d"].dataType))
        docs = docs.select("block", "mark", "key", F.array("d").alias("d"), F.array("n").alias("n"))
        placed = words.unionByName(docs).repartitionById(doc_groups * word_groups, F.col("block"))
        # a word of a block becomes one row, where it came from several blocks of the cells
        pieces = placed.groupBy("block", "mark", "key").agg(F.collect_list(F.struct("d", "n")).alias("c"))
        whole = pieces.select("block", "mark", "key", F.flatten("c.d").alias("d"), F.flatten("c.n").alias("n"))
        # the key first: sorts then compare a prefix of it
        rows = whole.sortWithinPartitions("key", "block").persist()
        rows.count()  # plans know that rows which are there lie in place
        routes = None
        if doc_groups > 1:
            routes = rows.where("mark = 1").select(F.expr("substring(key, 2)").alias("word"), "block").distinct()
            routes = routes.repartition(self.blocks, "word").persist()
        return Packed(rows, routes, doc_groups, word_groups, first)

    def _with_factors(self, words: DataFrame | None, docs: DataFrame | None, k: int) -> DataFrame:
        """The packed rows ``mark, key, d, n`` with the factor row ``f`` of their word or document."""
        packed = self.packed(k)
        rows = (self.n_words if words is not None else 0) + (self.n_docs if docs is not None else 0)
        sent = self._fits(rows, k)
        block = [] if sent else ["block"]
        sides = []
        if words is not None:
            if sent:
                routed = words
            elif packed.routes is None:
                routed = words.withColumn("block", _word_group(packed.word_groups))
            else:
                routed = packed.routes.join(words, "word")
            sides.append(routed.select(_word_key(), *block, F.col("a").alias("f")))
        if docs is not None:
            homes = F.explode(F.sequence(packed.first, packed.first + (packed.word_groups - 1)))
            routed = docs if sent else docs.where("doc_id is not null").withColumn("block", homes)
            sides.append(routed.select(_doc_key(), *block, F.col("b").alias("f")))
        factors = sides[0].unionByName(sides[1]) if len(sides) == 2 else sides[0]
        how = "inner" if len(sides) == 2 else "left"
        # both joins keep the order of the packed rows; the second sorts the factor rows alike
        if sent:
            joined = packed.rows.join(F.broadcast(factors), ["key"], how)
        else:
            factors = factors.repartitionById(packed.blocks, F.col("block"))
            joined = packed.rows.join(factors.hint("merge"), ["key", "block"], how)
        f = F.col("f")
        if how == "left":  # an empty array for none: missing arrays are slow on their way to Arrow
            f = F.coalesce(f, F.array().cast("array<double>")).alias("f")
        return joined.select("mark", "key", "d", "n", f)

    def values(self, words: DataFrame, docs: DataFrame, k: int, shares: bool) -> DataFrame:
        """``word, doc_id, p`` of every cell: ``a . b``, or with ``shares`` ``p[z] = a[z] b[z] / (a . b)``.
        The cells stay in place: neither they nor a factor row per cell travel.
        """
        schema = f"word string, doc_id {self.cells.schema['doc_id'].dataType.simpleString()}, p "
        found = self._with_factors(words, docs, k).mapInArrow(
            cell_values(k, shares), schema + ("array<double>" if shares else "double")
        )
        if not self.uncounted:
            return found
        # cells without a count aren't packed
        rest = self.with_docs(self.with_words(self.cells.where("n is null"), words, k), docs, k)
        rest = rest.withColumn("p", F.expr(dot("a", "b", k)))
        if shares:
            rest = rest.withColumn("p", build(k, lambda z: f"a[{z}] * b[{z}] / p"))
        return found.unionByName(rest.select("word", "doc_id", "p"))

    def _sums(
        self,
        words: DataFrame | Rows | None,
        docs: DataFrame | Rows | None,
        k: int,
        by_words: bool,
        by_docs: bool,
        mass: float | None = None,
        totals: bool = False,
    ) -> DataFrame:
        """``key, s``: the sums of :func:`block_sums`, shared where both factors are given. Both may be
        functions from keys to factor rows: then no factor row travels.
        """
        shared = words is not None and docs is not None
        run = block_sums(k, by_words, by_docs, shared, mass, totals)
        if callable(words):
            rows = self.packed(k).rows.select("mark", "key", "d", "n")
            return self._combined(rows.mapInArrow(from_keys(words, docs, run), SUMS), k)
        return self._combined(self._with_factors(words, docs, k).mapInArrow(run, SUMS), k)

    def _combined(self, sums: DataFrame, k: int) -> DataFrame:
        # a block's sums are combined already; the part spreads keys by another hash than the sums'
        # tables use, whose places would else be crowded
        part = F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int")
        sums = sums.withColumn("part", part).repartitionById(self.blocks, F.col("part"))
        width = slabs(k)[1] if k > UNROLL else k
        parts = [F.sum(F.col("s")[z]).alias(f"s{z}") for z in range(width)]
        if k > UNROLL:
            joined = sums.groupBy("part", "key", "slab").agg(*parts).groupBy("part", "key").agg(joined_slabs(k))
            return joined.select("key", "s")
        found = sums.groupBy("part", "key").agg(*parts)
        return found.select("key", F.array(*[f"s{z}" for z in range(k)]).alias("s"))

    def _word(self) -> Column:
        return F.expr("substring(key, 2)").alias("word")

    def _doc_id(self) -> Column:
        return F.expr("substring(key, 2)").cast(self.cells.schema["doc_id"].dataType).alias("doc_id")

    def _one_side(self, sums: DataFrame, key: str) -> DataFrame:
        return sums.select(self._word() if key == "word" else self._doc_id(), "s")

    def share_sums(self, words: DataFrame | Rows, docs: DataFrame | Rows, k: int, key: str) -> DataFrame:
        """``s[z] = sum n * a[z] b[z] / (a . b)`` over the cells of each key."""
        return self._one_side(self._sums(words, docs, k, key == "word", key != "word"), key)

    def both_share_sums(self, words: DataFrame | Rows, docs: DataFrame | Rows, k: int) -> DataFrame:
        """:meth:`share_sums` of both sides in one pass: ``(side, word, doc_id, s)``."""
        return self._both_sides(self._sums(words, docs, k, True, True))

    def fit_sums(self, words: DataFrame, docs: DataFrame, k: int) -> DataFrame:
        """``(side, word, doc_id, s)`` from one pass, with ``x = n / total`` and ``t = x / (a . b)``:
        ``s`` is ``sum t b`` per word, ``sum t a`` per document; rows of the side ``measures`` hold
        in ``s[0]`` the sums over all cells named by ``word``: ``log_part`` (``x ln t``), ``x`` and
        ``square`` (``x x - 2 x (a . b)``).
        """
        return self._both_sides(self._sums(words, docs, k, True, True, self.total))

    def mass_and_doc_sums(self, words: DataFrame | Rows, docs: DataFrame | Rows, k: int) -> DataFrame:
        """:meth:`both_share_sums`, where the words' sums don't leave their blocks but are added up: a
        row of the side ``measures`` with the word ``mass``.
        """
        return self._both_sides(self._sums(words, docs, k, True, True, totals=True))

    def square_sums(self, docs: DataFrame, k: int) -> DataFrame | None:
        """``(doc_id, s)``: :meth:`product_sums` of documents with the words' sums with ``docs``, in
        one pass; None where a word's cells lie in several blocks.
        """
        if self.packed(k).doc_groups > 1 or k > UNROLL:
            return None
        sums = self._with_factors(None, docs, k).mapInArrow(squares(k), SUMS)
        return self._one_side(self._combined(sums, k), "doc_id")

    def _both_sides(self, sums: DataFrame) -> DataFrame:
        is_word, is_doc = F.col("key").startswith("w"), F.col("key").startswith("d")
        return sums.select(
            F.when(~is_doc, self._word()).alias("word"),
            F.when(is_doc, self._doc_id()).alias("doc_id"),
            "s",
            F.when(is_word, "words").when(is_doc, "docs").otherwise("measures").alias("side"),
        )

    def product_sums(self, factor: DataFrame, k: int, key: str) -> DataFrame:
        """``s[z] = sum n * f[z]`` where f is the factor of the other side."""
        if key == "word":
            return self._one_side(self._sums(None, factor, k, True, False), key)
        return self._one_side(self._sums(factor, None, k, False, True), key)

    def release(self) -> None:
        self.cells.unpersist()
        self.words.unpersist()
        for packed in self._packed.values():
            packed.release()
        self._packed.clear()
        if "routes" in self.__dict__:
            self.routes.unpersist()


def default_blocks(spark: SparkSession) -> int:
    """As many blocks as shuffle partitions; one machine needs only a few per core."""
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        return min(blocks, 2 * spark.sparkContext.defaultParallelism)
    return blocks


def blocks_for(rows: DataFrame) -> int:
    """The default number of blocks, or more where Spark's estimate of the input asks for it.

    Rows whose size Spark can't tell (it then assumes the largest number) get the default.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return max(default_blocks(rows.sparkSession), -(-known // BLOCK_BYTES))


def place_corpus(
    corpus: DataFrame,
    blocks: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    document_cells: int = DOCUMENT_CELLS,
) -> CellBlocks:
    """Count the words of a corpus and place the cells.

    The texts travel, not the (larger) cells: a document goes to its block first
    and is cleaned (unless ``edited_text`` is there) and counted in place. Where a document
    turns out to have more than ``document_cells`` cells, the counted cells are placed anew by
    :func:`place_cells`, which spreads it over several blocks.
    """
    column = "edited_text" if "edited_text" in corpus.columns else "full_text"
    rows = corpus.select("doc_id", column)
    blocks = blocks or blocks_for(rows)
    texts = rows.withColumn("block", _block_of(F.col("doc_id"), F.lit(0), blocks))
    texts = texts.repartitionById(blocks, F.col("block"))
    counted = counted_words if column == "full_text" else word_counts
    placed = texts.select("block", "doc_id", F.inline(counted(F.col(column)))).persist()
    # a document lies in one block, so its cells are counted there
    largest = placed.groupBy("block", "doc_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= document_cells:
        return _measured(placed, blocks, None, broadcast_bytes)
    spread = place_cells(placed.select("word", "doc_id", "n"), blocks, broadcast_bytes, document_cells)
    placed.unpersist()
    return spread


def place_cells(
    cells: DataFrame,
    blocks: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    document_cells: int = DOCUMENT_CELLS,
) -> CellBlocks:
    """Place given ``(word, doc_id, n)`` cells.

    Documents are counted first; the cells of a large one are spread by word over
    several blocks. There are at most ``cells / document_cells`` large ones.
    """
    blocks = blocks or blocks_for(cells)
    sizes = cells.groupBy("doc_id").count().where(F.col("count") > document_cells)
    split_docs = sizes.select(
        "doc_id", F.ceil(F.col("count") / F.lit(document_cells)).cast("int").alias("parts")
    ).persist()
    if split_docs.isEmpty():
        split_docs.unpersist()
        split_docs, part, base = None, F.lit(0), cells
    else:
        part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
        base = cells.join(split_docs, "doc_id", "left")
    placed = base.select(
        _block_of(F.col("doc_id"), part, blocks).alias("block"),
        "doc_id",
        "word",
        F.col("n").cast("double").alias("n"),
    ).repartitionById(blocks, F.col("block"))
    return _measured(placed, blocks, split_docs, broadcast_bytes)


def _measured(
    placed: DataFrame, blocks: int, split_docs: DataFrame | None, broadcast_bytes: int
) -> CellBlocks:
    placed = placed.persist()
    # the first pass fills the storage; sizes are counted from it
    size = placed.agg(F.count("*").alias("cells"), F.sum("n").alias("total"), F.count("n").alias("counted")).first()
    words = placed.select("word").distinct().persist()
    return CellBlocks(
        cells=placed,
        words=words,
        blocks=blocks,
        # an unsplit document lies in one block: counted without a shuffle
        n_docs=placed.select(*(["doc_id"] if split_docs is not None else ["block", "doc_id"])).distinct().count(),
        n_words=words.count(),
        n_cells=size["cells"],
        total=size["total"],
        split_docs=split_docs,
        broadcast_bytes=broadcast_bytes,
        uncounted=size["cells"] - size["counted"],
    )
