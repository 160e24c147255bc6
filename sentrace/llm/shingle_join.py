"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 % or more.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one node from then on.
2. Shingles are ordered from rare to frequent by a count sketch over all documents (any order
   gives right results; this one keeps groups small, the more so the fewer shingles share a slot:
   what an edit alone brought comes first and is in no group). Two linked sets share one of the first
   ``n - ceil(0.8 n) + 1`` shingles in this order, so only those are sent, by hash part.
   Nodes that share one, with sizes that allow a link, form a group.
3. Instead of all pairs of a group, nodes are searched from centres: each node goes to the centre
   it shares most with, then each component found so far to the centre of another, then every
   node to a few centres of each of its groups, if their bitmaps allow a link. Only
   pairs of a group that are still in different components after that are searched one by one,
   and of these (as in the round before) only such whose shared shingle stands so early in both orders that what follows can
   hold the overlap a link needs, and whose parity bitmaps (all shingles of a set, each flips one bit)
   differ in no more bits than linked sets differ in shingles. The number of rare shingles a pair
   shares bounds its overlap too.
4. A search is a T-occurrence search (DivideSkip): the lists of the query's shingles say which
   records of a block have them; short lists are merged and counted, long ones are probed
   by binary search for the records that may still reach their bound.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.llm import words as W
from sentrace.llm.graph import components
from sentrace.llm.session import digest, free_name, keyed, parts_for
from sentrace.storage import materialise

WORDS = 5
#: A link needs ``DEN * shared >= NUM * union``.
NUM, DEN = 4, 5
#: 2 ** this many counts: 32 MB in a task that counts, 16 MB when broadcast, whatever the input.
SKETCH_BITS = 23
#: Counts travel in pieces of 2 ** this many slots.
PIECE_BITS = 16
#: The broadcast bitmap of documents to search has at most 2 ** this many bits (4 MB).
MAX_BITMAP_BITS = 25
BLOCK_SHINGLES = 2_000_000
#: Of longer bitmaps, which only sort out fewer pairs of texts with more than this many shingles.
MAX_PARITY_BITS = 1 << 11
#: Centres of each group in the round that compares bitmaps.
CENTRES = 4
_SET_BYTES = 6  # of each hash that are compared in a search


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; all its words as one if there are fewer."""
    data, offsets = W.buffers(texts)
    data = W.lower(data)
    starts, ends, first = W.bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    windows = W.window_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= width:
            yield np.unique(windows[a : b - width + 1])
        elif n:
            yield W.window_hashes(hashes[a:b], n) + np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits a shingle (at most ``MAX_PARITY_BITS``), in words; each shingle flips one bit.

    Sets differ in at least as many shingles as their bitmaps differ in bits. A bitmap of
    twice the length folds to the shorter one by exclusive or of its halves.
    """
    size = min(MAX_PARITY_BITS, max(256, 2 << (len(shingles) - 1).bit_length()))
    flips = np.bincount((W.mix(shingles) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts below 2 ** 32, byte by byte of equal weight, compressed."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _counts(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _describe(width: int):
    """A row per document, and at the end of each task its counts by sketch slot, packed in pieces."""
    names = ["id", "digest", "n", "node", "bits", "piece", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for table in W.chunks(batches):
            sizes, nodes, bits = [], [], []
            for shingles in shingle_sets(table.column("text").chunk(0), width):
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                bits.append(parity(shingles) if len(shingles) else None)
                np.add.at(counts, _slots(shingles), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").chunk(0),
                    table.column("digest").chunk(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        none, no_bits = pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))
        for piece, own in enumerate(counts.reshape(-1, 1 << PIECE_BITS)):
            if own.any():
                columns = [none, none, none, none, no_bits, pa.array([piece], pa.int32()), pa.array([_packed(own)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed counts of each piece; rows are sorted by piece, one sum is held at a time."""
    last, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([_packed(np.minimum(total, (1 << 32) - 1))], pa.binary())], ["piece", "counts"])

    for batch in batches:
        for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            if piece != last:
                if last is not None:
                    yield row()
                last, total = piece, np.zeros(1 << PIECE_BITS, np.int64)
            total += _counts(packed.as_py())
    if last is not None:
        yield row()


def _sketch(told: DataFrame) -> np.ndarray:
    """Count of each slot over all documents, in units that leave 256 for the mean of a full sketch."""
    pieces = told.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").sortWithinPartitions("piece")
    sketch = np.zeros((1 << SKETCH_BITS - PIECE_BITS, 1 << PIECE_BITS), np.uint32)
    for row in pieces.mapInArrow(_summed, "piece int, counts binary").collect():  # at most 2 ** (SKETCH_BITS - PIECE_BITS) rows
        sketch[row["piece"]] = _counts(row["counts"])
    sketch = sketch.ravel()
    unit = max(1, int(sketch.mean(dtype=np.float64)) >> 8)
    return np.minimum(sketch // np.uint32(unit), (1 << 16) - 1).astype(np.uint16)


def _prefixes(width: int, parts: int, sketch):
    """The rare shingles of each node, packed by part: 32-bit key, node, size, place in the node's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for table in W.chunks(batches):
            done, keys, nodes, sizes = set(), [], [], []
            for shingles in shingle_sets(table.column("text").chunk(0), width):
                n = len(shingles)
                node = node_of(shingles) if n else None
                if not n or node in done:
                    continue
                done.add(node)
                first = n - (NUM * n + DEN - 1) // DEN + 1
                keys.append(shingles[np.lexsort((shingles, counts[_slots(shingles)]))[:first]])
                nodes.append(node)
                sizes.append(n)
            if not keys:
                continue
            lengths = [len(k) for k in keys]
            key = np.concatenate(keys)
            node, size = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.uint32), lengths)
            place = np.concatenate([np.arange(x, dtype=np.uint32) for x in lengths])
            mixed = W.mix(key)
            part = (mixed % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            short = (mixed >> np.uint64(32)).astype(np.uint32)
            at = [order[cuts[p] : cuts[p + 1]] for p in used]
            columns = [pa.array([x[i].tobytes() for i in at], pa.binary()) for x in (short, node, size, place)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *columns], ["part", "keys", "nodes", "sizes", "places"])

    return run


def _groups(frame: pd.DataFrame) -> pd.DataFrame:
    """(shared, node, n, place): nodes that share a key and whose sizes allow a link with the next."""
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["keys"]]).astype(np.int64)
    node = np.concatenate([np.frombuffer(x, np.int64) for x in frame["nodes"]])
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["sizes"]]).astype(np.int64)
    place = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["places"]])
    order = np.lexsort((place, node, n, key))
    key, node, n, place = key[order], node[order], n[order], place[order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node, n, place = key[new], node[new], n[new], place[new]
    split = np.append(True, (key[1:] != key[:-1]) | (DEN * n[:-1] < NUM * n[1:]))
    run = np.cumsum(split) - 1
    count = np.bincount(run)
    keep = count[run] > 1
    shared = (np.int64(frame["part"].iloc[0]) << 32) + run[keep]
    return pd.DataFrame({"shared": shared, "node": node[keep], "n": n[keep], "place": place[keep].astype(np.int32)})


def _needed(n: int, sizes: np.ndarray) -> np.ndarray:
    """Least number of common shingles that links sets of these sizes."""
    return -(-NUM * (n + sizes) // (NUM + DEN))


def divide_skip(query: np.ndarray, records: list[np.ndarray]) -> np.ndarray:
    """How many elements of ``query`` each record has, for those that reach their bound; else -1.

    All sets are sorted and distinct.
    """
    sizes = np.array([len(r) for r in records])
    bound = _needed(len(query), sizes)
    owner = np.repeat(np.arange(len(records)), sizes)
    flat = np.concatenate(records)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    own = query[at] == flat
    order = np.lexsort((owner[own], at[own]))
    lists, members = at[own][order], owner[own][order]
    first = np.searchsorted(lists, np.arange(len(query) + 1))
    length = np.diff(first)
    least = int(bound.min())
    n_long = int(least / (0.01 * np.log2(max(2, length.max(initial=2))) * least + 1)) if len(records) > 8 else 0
    by_length = np.argsort(-length, kind="stable")
    long_ = by_length[:n_long]
    short = np.ones(len(query), bool)
    short[long_] = False
    counts = np.bincount(members[short[lists]], minlength=len(records))
    open_ = np.flatnonzero(counts >= bound - n_long)
    for s in long_:
        one = members[first[s] : first[s + 1]]
        if not len(one) or not len(open_):
            continue
        place = np.minimum(np.searchsorted(one, open_), len(one) - 1)
        counts[open_] += one[place] == open_
    out = np.full(len(records), -1)
    out[open_] = np.where(counts[open_] >= bound[open_], counts[open_], -1)
    return out


def _pack(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // _SET_BYTES, 8), np.uint8)
    wide[:, :_SET_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, _SET_BYTES)
    return np.unique(wide.view("<u8").ravel())


def _search(task: pd.DataFrame) -> pd.DataFrame:
    """Links of one block: the row of the centre itself is the query, the others are the records."""
    own = task["node"] == task["centre"]
    query, records = task[own], task[~own]
    if not len(records) or not len(query):
        return pd.DataFrame({"centre": [], "node": []}, dtype="int64")
    found = divide_skip(_unpack(query["shingles"].iloc[0]), [_unpack(s) for s in records["shingles"]])
    return pd.DataFrame({"centre": query["centre"].iloc[0], "node": records["node"].to_numpy()[found >= 0]})


class _Join:
    """The tables of one join: documents, their nodes, and the groups of nodes."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, groups: DataFrame, width: int):
        self.rows, self.nodes, self.groups, self.width = rows, nodes, groups, width
        own = groups.groupBy("node").agg(F.collect_list("shared").alias("rare"))  # of one node: bounded by its text
        self.rare = materialise(own, "rare")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in ``wanted``, read again from one document of each.

        Which documents to read is a bitmap of bounded size; documents that pass by
        coincidence are dropped by the join with ``wanted`` that follows.
        """
        spark = self.rows.sparkSession
        chosen = self.nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.xxhash64("id", "digest").alias("mark"))
        chosen = materialise(chosen, "wanted")
        bits = min(MAX_BITMAP_BITS, max(10, int(chosen.count()).bit_length() + 5))
        slot = F.call_function("shiftrightunsigned", F.col("mark"), F.lit(64 - bits))
        word = F.call_function("shiftright", slot, F.lit(6)).alias("word")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
        found = chosen.groupBy(word).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most 2 ** 19 rows
        bitmap = np.zeros(1 << bits - 6, np.int64)
        bitmap[found["word"].to_numpy(np.int64)] = found["bits"]
        shared, width = spark.sparkContext.broadcast(bitmap), self.width

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def passing() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    mark = batch.column(batch.schema.get_field_index("mark")).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
                    on = (shared.value.view(np.uint64)[(mark >> np.uint64(6)).astype(np.int64)] >> (mark & np.uint64(63))) & np.uint64(1)
                    yield batch.filter(pa.array(on.astype(bool)))

            for table in W.chunks(passing()):
                sets = [(node_of(s), _pack(s)) for s in shingle_sets(table.column("text").chunk(0), width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.binary())], ["node", "shingles"])

        return self.rows.select(F.xxhash64("id", "digest").alias("mark"), "text").mapInArrow(read, "node long, shingles binary")

    def counted(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the number of rare shingles that both have, as ``common``: one row a pair throughout."""
        own = self.rare.select("node", F.col("rare").alias("own"))
        other = self.rare.select(F.col("node").alias("centre"), F.col("rare").alias("other"))
        common = F.size(F.array_intersect("own", "other")).alias("common")
        return pairs.join(own, "node").join(other, "centre").select("node", "centre", common)

    def search(self, pairs: DataFrame) -> DataFrame | None:
        """The (centre, node) rows of ``pairs`` that are linked; a centre's records are cut into blocks.

        ``pairs`` have ``common``. All shingles that two sets share, up to the end of the
        prefix that ends first, are common ones; the rest lies in what follows that prefix.
        Pairs that cannot reach their bound so are left out. None if no row is linked.
        """
        sizes = self.nodes.select("node", "n")
        of_centre = sizes.select(F.col("node").alias("centre"), F.col("n").alias("m"))
        bound = "ceil(4 * (n + m) / 9) - greatest(ceil(4 * n / 5), ceil(4 * m / 5)) + 1"
        pairs = pairs.join(sizes, "node").join(of_centre, "centre").where(f"common >= {bound}").select("centre", "node", "n")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            return None
        blocks = pairs.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
        salted = pairs.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        sets = self._sets(pairs.select("node").union(blocks.select(F.col("centre").alias("node"))))
        asked = blocks.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        tasks = salted.select("node", "centre", "block").union(asked)
        # One join gives the sets of records and queries alike; both go to the centre's block.
        filled = tasks.join(sets, "node").select("centre", "block", "node", "shingles")
        found = materialise(filled.groupBy("centre", "block").applyInPandas(_search, "centre long, node long"), "links")
        return None if found.isEmpty() else found


#: Number of bits in which the bitmaps of ``a`` and ``b`` differ, the longer one folded to the shorter.
_WORDS = "least(size(a.bits), size(b.bits))"
_WORD = "a.bits[i] ^ b.bits[i] ^ if(size(a.bits) > {0}, a.bits[i + {0}], 0L) ^ if(size(b.bits) > {0}, b.bits[i + {0}], 0L)".format(_WORDS)
_DIFFERENT = f"aggregate(sequence(0, {_WORDS} - 1), 0, (sum, i) -> sum + bit_count({_WORD}))"


def _best(pairs: DataFrame, by: str) -> DataFrame:
    """Of the (by, node, centre) rows, for each ``by`` the pair that occurs most (ties: the smallest)."""
    counted = pairs.groupBy(by, "node", "centre").count() if by != "node" else pairs.groupBy("node", "centre").count()
    best = counted.groupBy(by).agg(F.min(F.struct((-F.col("count")).alias("few"), "centre", "node")).alias("b"))
    return best.select("b.node", "b.centre").distinct()


def link(docs: DataFrame, *, id_col: str, text_col: str, width: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n, node) of every row, and (node, label) of the linked nodes: the least node of their component."""
    rows = keyed(docs, id_col, text_col)
    parts = parts_for(docs)
    context = docs.sparkSession.sparkContext
    told = materialise(rows.mapInArrow(_describe(width), "id long, digest long, n long, node long, bits array<long>, piece int, counts binary"), "shingle-sets")
    members = told.where("piece IS NULL").select("id", "digest", "n", "node")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("d"), F.min("n").alias("n"))
    nodes = materialise(nodes.select("node", "d.id", "d.digest", "n"), "nodes")
    sent = rows.mapInArrow(_prefixes(width, parts, context.broadcast(_sketch(told))), "part int, keys binary, nodes binary, sizes binary, places binary")
    groups = materialise(sent.groupBy("part").applyInPandas(_groups, "shared long, node long, n long, place int"), "groups")
    join = _Join(rows, nodes, groups, width)

    links = None
    labels = docs.sparkSession.createDataFrame([], "node long, label long")

    def joined(found: DataFrame | None) -> DataFrame:
        """Labels after adding the links found last."""
        nonlocal links, labels
        if found is not None:
            links = found if links is None else links.unionByName(found)
            labels = components(links, "centre", "node")
        return labels

    def mixed(rows: DataFrame = groups) -> DataFrame:
        """``rows`` of groups that still hold several components, with the label of each node."""
        own = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        own = materialise(own, "labelled")
        several = own.groupBy("shared").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("shared")
        return own.join(several, "shared", "left_semi")

    centres = groups.groupBy("shared").agg(F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("centre"))
    pairs = groups.join(centres, "shared").where("node != centre").select("node", "centre")
    joined(join.search(join.counted(_best(pairs, "node"))))

    per_part = mixed().groupBy("shared", "label").agg(F.min("node").alias("node"))
    centres = per_part.groupBy("shared").agg(F.min(F.struct("label", "node")).alias("c"))
    pairs = per_part.join(centres, "shared").where(F.col("label") != F.col("c.label")).select("label", "node", F.col("c.node").alias("centre"))
    joined(join.search(join.counted(_best(pairs, "label"))))

    # The first shingle that two linked sets share leaves room behind it, in both, for all that they must share.
    rest = mixed()
    smallest = rest.groupBy("shared").agg(F.min("n").alias("least"))
    rest = rest.join(smallest, "shared").where("place <= n - ceil(4 * (n + greatest(least, ceil(4 * n / 5))) / 9)").drop("least", "label")
    rest = materialise(rest, "rest")
    bits = told.join(nodes.join(rest, "node", "left_semi"), ["node", "id", "digest"], "left_semi").groupBy("node").agg(F.first("bits").alias("bits"))
    bits = materialise(bits, "bits")

    def near(some: Callable[[DataFrame], DataFrame], order: str) -> DataFrame:
        """Pairs of nodes of a group that may link and are in different components, with one of ``some`` rows as centre."""
        rows = materialise(mixed(rest).join(bits, "node"), "mixed")
        a, b = rows.alias("a"), some(rows).alias("b")
        must = "ceil(4 * (a.n + b.n) / 9)"
        found = a.join(b, F.col("a.shared") == F.col("b.shared")).where(
            f"{order} AND a.label != b.label AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n"
            f" AND a.place <= a.n - {must} AND b.place <= b.n - {must} AND {_DIFFERENT} <= a.n + b.n - 2 * {must}"
        )
        return found.select(F.col("a.node").alias("node"), F.col("b.node").alias("centre"))

    def centre_rows(rows: DataFrame) -> DataFrame:
        orders = [F.min_by("node", F.struct(F.xxhash64(F.lit(i), "node"), "node")) for i in range(CENTRES)]
        chosen = rows.groupBy("shared").agg(F.array_distinct(F.array(*orders)).alias("nodes"))
        return rows.join(chosen.select("shared", F.explode("nodes").alias("node")), ["shared", "node"], "left_semi")

    def search_near(some: Callable[[DataFrame], DataFrame], order: str) -> None:
        left = near(some, order).select(F.greatest("node", "centre").alias("node"), F.least("node", "centre").alias("centre"))
        joined(join.search(join.counted(materialise(left.distinct(), "left"))))

    search_near(centre_rows, "a.node != b.node")
    search_near(lambda rows: rows, "a.node < b.node")
    return members, labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id``, ``is_first`` and ``repeats``.

    Words are runs without ASCII white space of the text with A-Z in lower case. A text's set
    holds its distinct runs of ``width`` words, or all its words as one if there are fewer;
    null texts and texts without words have an empty set and link with nothing. Two texts
    link if their sets share four fifths of their union. ``component_id`` is the smallest id
    that links reach, the row itself included (a null id counts only if there is no other).
    ``is_first`` marks the row of a component with the smallest id, of equal ids the smallest
    text digest; ``repeats`` counts the rows with the same id and text. Rows with an empty
    set are first. Columns of these names are replaced.
    """
    members, labels = link(docs, id_col=id_col, text_col=text_col, width=width)
    counted = members.groupBy("id", "digest", "n", "node").agg(F.count("*").alias("repeats"))
    placed = counted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = materialise(placed.select("id", "digest", "n", "label", "repeats"), "placed")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    least = placed.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("least"))
    found = placed.join(least, "label", "left").select(
        "id",
        "digest",
        F.col("n").alias("n_shingles"),
        F.coalesce("least.id", "id").alias("component_id"),
        F.coalesce(place == F.col("least"), F.lit(True)).alias("is_first"),
        "repeats",
    )
    added = ("n_shingles", "component_id", "is_first", "repeats")
    kept = [c for c in docs.columns if c.lower() not in added]
    mark = free_name(docs, "text_digest")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(mark, digest(text_col)).alias("d")
    joined = rows.join(found.alias("f"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("f.id")) & F.col(f"d.{mark}").eqNullSafe(F.col("f.digest")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in kept], *[F.col(f"f.{c}") for c in added])
