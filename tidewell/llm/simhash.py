"""SimHash near-dedup with pigeonring candidate filtering.

Lay the eight bytes of a 64-bit fingerprint on a ring.  If two fingerprints differ
in at most 3 bits, some byte starts a chain in which the first l bytes together
differ in at most 3 l / 8 bits, for every l.  So the first two bytes are equal and
the next three differ in at most one bit together, which leaves two of those three
equal: both fingerprints agree on 32 bits picked by the chain's start (8) and the
equal pair (3).  Those 24 keys deal out the candidates; the chain budgets and then
the Hamming distance are checked on each candidate.

A key that many distinct fingerprints share is dealt again by more of their bits
until its groups are small, so no task holds an unbounded group and no pair is lost.

``similar_groups`` links by a wide reach instead, and by the shingle sets' Jaccard
similarity in the end.  The keys of a wide reach would be a few bits long, so its
candidates share one of the first hashes of their sets, in an order that puts hashes
of very many sets last; the same chain budgets and the Hamming distance, here of
fingerprints over distinct shingles, prune them, and what passes is verified on the
whole sets.  This rule is one for groups of all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, shuffle_partitions, stored, text_list
from tidewell.llm.components import connected_components

SEED = 42
WORDS = 3
REACH = 3
#: Distinct fingerprints in a candidate group that is compared within one task.
GROUP = 512
BLOCK = 1 << 16
#: Shingles of ``similar_groups``, how many of a set's first hashes deal its candidates, and how many least hashes
#: these are picked from.  Two sets of Jaccard similarity s miss each other with a probability of about
#: (1 - s) ** SKETCH: 3 in a million at 0.8.
SIMILAR_WORDS, SKETCH, KEPT = 5, 8, 32
#: Bits in which fingerprints of similarity 0.8 may differ: 10 on average, 12 for sets of a few shingles, deviation 3.
WIDE = 22
#: Groups of sets that share a hash: small ones are joined, larger ones compared in blocks of SETS.  Hashes among the
#: least of over HOT sets go last in the order, HOT_HASHES of them at most.
SMALL, SETS, HOT, HOT_HASHES = 32, 1024, 512, 1 << 20
BROADCAST_ROWS = 400_000


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, a block at a time."""
    tokens = text.encode().lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not tokens:
        return
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    digest = xxhash.xxh64_intdigest
    while some := [digest(s, SEED) for _, s in zip(range(BLOCK), shingles)]:
        yield np.array(some, np.uint64)


def _majority(blocks: Iterator[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles: a bit is set where over half the hashes have it."""
    return _majority(shingle_hashes(text, words))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in text_list(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["key", "fp"])

    return run


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a signed long); null texts count as empty."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(_fingerprints(words), f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def _byte_mask(places) -> int:
    return sum(0xFF << (8 * (p % 8)) for p in places)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: The bits that each of the 24 keys fixes: byte i and i + 1, and two of the next three.
MASKS = [_byte_mask((i, i + 1, i + a, i + b)) for i in range(8) for a, b in ((2, 3), (2, 4), (3, 4))]


def finer(mask: int) -> list[int]:
    """Masks with more bits: the free bits in four parts, each mask fixing one of them as well.

    Two fingerprints that agree on ``mask`` and differ in 3 bits agree on one part.
    With 3 free bits or fewer there is nothing to split: all that agree are linked.
    """
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[p::4]) for p in range(4)] if len(free) > REACH else []


def _on_ring(x: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Whether the byte-wise differences ``x`` (n x 8 bit counts) hold a chain within its budgets."""
    ring = np.concatenate((x, x), axis=1)
    ok = np.zeros(len(x), bool)
    for start in range(8):
        ok |= (np.cumsum(ring[:, start : start + 8], axis=1) * 8 <= reach * np.arange(1, 9)).all(axis=1)
    return ok


def _links(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what links within each group: at most one fewer than its fingerprints."""
    for batch in groups:
        left, right = [], []
        for values in batch.column(0).to_pylist():
            fps = np.array(sorted(values), np.int64).view(np.uint64)
            open_ = np.ones(len(fps), bool)
            while open_.any():
                front = [int(np.argmax(open_))]
                open_[front] = False
                while front:
                    at = front.pop()
                    near = np.nonzero(open_)[0]
                    diff = np.bitwise_count((fps[near] ^ fps[at]).view(np.uint8).reshape(-1, 8))
                    near, diff = near[ring := _on_ring(diff)], diff[ring]
                    near = near[diff.sum(axis=1) <= REACH]
                    open_[near] = False
                    left += [fps[at]] * len(near)
                    right += fps[near].tolist()
                    front += near.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (left, right)], ["a", "b"])


def _deal_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, mask) to one row for each finer mask."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        masks, of = np.unique(batch.column(1).to_numpy().view(np.uint64), return_inverse=True)
        table = np.array([finer(int(m)) for m in masks], np.uint64).reshape(-1, 4)
        new = table[of].ravel()
        fp = np.repeat(fps, 4)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (fp, new, fp & new)], ["fp", "mask", "bits"])


def near_edges(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within 3 bits of ``fps`` (distinct fp).

    Counts per key combine before the shuffle; only keys with two fingerprints or
    more go on.  Groups of more than ``group`` (8 at least, since as many agree on
    all but 3 bits) are dealt again by finer masks.
    """
    parts, group = [], max(group, 1 << REACH)
    keys = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in MASKS))
    keyed = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.mask", "x.bits")
    while True:
        sizes = keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = cut(keyed.join(sizes, ["mask", "bits"]))
        small = shared.where(F.col("n") <= group).groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps"))
        parts.append(small.select("fps").repartition(shuffle_partitions(fps.sparkSession)).mapInArrow(_links, "a long, b long"))
        large = shared.where(F.col("n") > group)
        if not large.take(1):
            break
        keyed = large.select("fp", "mask").mapInArrow(_deal_finer, "fp long, mask long, bits long").distinct()
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    return edges


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Every row of ``docs`` with fp, fingerprint (16 hex digits) and component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest key
    reachable over links, the row's own included.  Texts without words, null or
    empty, have fingerprint zero and link like others.  Equal fingerprints are one
    node, so large groups of copies cost one node; repeated rows stay repeated.
    """
    marked = cut(with_fingerprint(docs, key, text, words))
    nodes = cut(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = cut(connected_components(near_edges(nodes.select("fp"))))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(key, "fp", hexed.alias("fingerprint"), "component_id")


# groups by similarity


def _set_of(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _name(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, fp, least = [], [], [], []
            for t in text_list(batch.column(1)):
                found = _set_of(list(shingle_hashes(t, words)))
                sid.append(_name(found))
                n.append(len(found))
                fp.append(_majority(found[i : i + BLOCK] for i in range(0, len(found), BLOCK)))
                least.append(found[:KEPT].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(sid), pa.array(n, pa.int32()), _longs(fp), pa.array(least, pa.list_(pa.int64()))], ["key", "sid", "n", "fp", "least"])

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_set_of(list(shingle_hashes(t, words))) for t in text_list(batch.column(0))]
            yield pa.RecordBatch.from_arrays([_longs([_name(x) for x in found]), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["sid", "hashes"])

    return run


def on_ring(x: Column, reach: int) -> Column:
    """Whether the bits ``x`` in which two fingerprints differ hold a chain within its budgets and are ``reach`` at most."""
    found = F.lit(False)
    for start in range(8):
        turned = F.shiftrightunsigned(x, 8 * start).bitwiseOR(F.shiftleft(x, 64 - 8 * start)) if start else x
        chain = F.lit(True)
        for length in range(1, 8):
            chain = chain & (F.bit_count(turned.bitwiseAND(F.lit((1 << 8 * length) - 1))) <= reach * length // 8)
        found = found | chain
    return found & (F.bit_count(x) <= reach)


def _maybe(n: Column, fp: Column, m: Column, gp: Column, reach: int, num: int, den: int) -> Column:
    """The length filter, the ring and the Hamming distance."""
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & on_ring(fp.bitwiseXOR(gp), reach)


def _sets(used: DataFrame, rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """sid and hashes of the sets ``used``; texts are read again for these only."""
    used = cut(used)
    sized = F.broadcast if used.count() <= BROADCAST_ROWS else lambda df: df
    firsts = nodes.join(sized(used), "sid", "left_semi").select(F.col("first").alias("first_key")).distinct()
    texts = rows.join(sized(firsts), rows["key"].eqNullSafe(F.col("first_key")), "left_semi").select("text")
    sets = texts.mapInArrow(_whole_sets(words), "sid long, hashes array<long>").join(sized(used), "sid", "left_semi")
    return stored(sets.dropDuplicates(["sid"]))


def _similar(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    pairs = cut(pairs.distinct())
    sets = _sets(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), rows, nodes, words)
    one, other = (sets.select(F.col("sid").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in ("a", "b"))
    both = pairs.join(one, "a").join(other, "b")
    similar = F.size(F.array_intersect("a_hashes", "b_hashes")) * (num + den) >= num * (F.size("a_hashes") + F.size("b_hashes"))
    return cut(both.where(similar).select("a", "b"))


def _shared_counts(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each of ``one`` shares with each of ``other``: products of incidence matrices, ``width`` hashes at a time."""
    flat = [np.concatenate(x) for x in (one, other)]
    row = [np.repeat(np.arange(len(x)), [len(h) for h in x]) for x in (one, other)]
    known = np.intersect1d(*flat)
    total = np.zeros((len(one), len(other)), np.float32)
    at = [np.searchsorted(known, f) for f in flat]
    real = [(a < len(known)) & (known[np.minimum(a, len(known) - 1)] == f) if len(known) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    for start in range(0, len(known), width):
        parts = []
        for a, r, ok, x in zip(at, row, real, (one, other)):
            here = ok & (a >= start) & (a < start + width)
            m = np.zeros((len(x), min(width, len(known) - start)), np.float32)
            m[r[here], a[here] - start] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def _block_links(reach: int, num: int, den: int):
    """Links between the sets of a block outside their group's usual component and those of another block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            of = lambda t: [np.asarray(h, np.int64) for h in t["hashes"].to_pylist()]
            one, other = of(left), of(right)
            sid, root = ([t[c].to_numpy() for t in (left, right)] for c in ("sid", "root"))
            size = [np.array([len(h) for h in x]) for x in (one, other)]
            fp = [t["fp"].to_numpy().view(np.uint64) for t in (left, right)]
            near = (np.bitwise_count(fp[0][:, None] ^ fp[1]) <= reach) & (root[0][:, None] != root[1])
            if near.any():
                near &= _shared_counts(one, other) * (num + den) >= num * (size[0][:, None] + size[1])
            # a spanning forest over the components that meet here: one link fewer than there are
            roots, of_root = np.unique(np.concatenate(root), return_inverse=True)
            i, j = np.nonzero(near)
            u, v = of_root[: len(one)][i], of_root[len(one) :][j]
            pick = np.full((len(roots), len(roots)), -1)
            pick[u, v] = pick[v, u] = np.arange(len(i))
            new = np.ones(len(roots), bool)
            for start in np.unique(u):
                front = [start] * bool(new[start])
                new[start] = False
                while front:
                    found = pick[front.pop()]
                    near_by = np.nonzero(new & (found >= 0))[0]
                    new[near_by] = False
                    a += sid[0][i[found[near_by]]].tolist()
                    b += sid[1][j[found[near_by]]].tolist()
                    front += near_by.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked_in_blocks(groups: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, reach: int, num: int, den: int) -> DataFrame:
    """Links (a, b) across the components of large groups (token, sid, fp, root, usual, size, odd), each pair counted in full.

    The ``odd`` sets outside the usual component are dealt to blocks, and all
    ``size`` sets to others; each block meets each of the others once.
    """
    groups = groups.join(_sets(groups.select("sid").distinct(), rows, nodes, words), "sid")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(SETS)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("sid"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["token", "one", "other", "sid", "fp", "root", "hashes"]
    left = groups.where("root <> usual").withColumn("one", own("odd")).withColumn("other", every("size")).select(*columns)
    right = groups.withColumn("other", own("size")).withColumn("one", every("odd")).select(*(F.col(c).alias(c) for c in columns))
    by = ("token", "one", "other")
    return cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_block_links(reach, num, den), "a long, b long"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (token, sid, n, fp) of groups over several components, with their root, their group's usual one, its size and how many are odd."""
    named = members.join(roots, members["sid"] == roots["node"], "left").select("token", "sid", "n", "fp", F.coalesce("root", "sid").alias("root"))
    parts = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("part"))
    groups = parts.groupBy("token").agg(F.max(F.struct("part", "root")).alias("most"), F.sum("part").alias("size"))
    mixed = groups.where("most.part < size").select("token", F.col("most.root").alias("usual"), "size", (F.col("size") - F.col("most.part")).alias("odd"))
    return cut(named.join(mixed, "token"))


def _hot_last(hot: Broadcast):
    """Sets to their sketches: the least hashes that are not ``hot`` (sorted), then those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(3)
            sizes = np.diff(least.offsets.to_numpy())
            values, row = least.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(hot.value, values), len(hot.value) - 1)
            order = np.lexsort((hot.value[at] == values, row))  # stable: within a set hashes stay in order
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends = np.concatenate(([0], np.cumsum(np.minimum(sizes, SKETCH)))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order][place < SKETCH]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sketch], ["sid", "n", "fp", "sketch"])

    return run


def _sketched(nodes: DataFrame) -> DataFrame:
    """sid, n, fp and sketch of ``nodes``: the first SKETCH of the least hashes, those that over HOT sets hold last.

    A passage that many texts share would deal them all to each other; so they are
    dealt by what else they have.  Any order that is one for all sets will do.  At
    most HOT_HASHES hashes, 8 bytes each, go to the tasks: with more the bound rises.
    """
    total = nodes.agg(F.sum(F.size("least"))).first()[0] or 0
    counts = nodes.select(F.explode("least").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    hot = counts.where(F.col("held") > max(HOT, total // HOT_HASHES)).select("token").toArrow()["token"].to_numpy()
    rows = nodes.select("sid", "n", "fp", "least")
    if not len(hot):
        return rows.select("sid", "n", "fp", F.slice("least", 1, SKETCH).alias("sketch"))
    return rows.mapInArrow(_hot_last(nodes.sparkSession.sparkContext.broadcast(np.sort(hot))), "sid long, n int, fp long, sketch array<long>")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, num: int = 4, den: int = 5, reach: int = WIDE) -> DataFrame:
    """key and component_id of every row: the smallest key reachable over pairs of Jaccard num/den or more.

    The sets are of runs of ``words`` words, by their XXH64; a shorter text is one run.
    Texts without words, null or empty, link with each other; equal sets are one node.
    No pair below the similarity links.  A pair at it is missed where no hash of the
    sketches is shared or the fingerprints differ in more than ``reach`` bits, well
    under one in a hundred, less the more similar.  Each set is first held against
    the first of each group; then only pairs across the components found can change
    the outcome.  In large groups these are counted block by block, all of them, and
    a block gives no more links than it joins components.  Rows that repeat a key
    are rows apart, null keys sort before others; other columns are ignored.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    marked = stored(rows.mapInArrow(_sketches(words), f"key {rows.schema['key'].dataType.simpleString()}, sid long, n int, fp long, least array<long>"))
    # a set's hash names it, so its size, fingerprint and least hashes are the same in all rows
    nodes = cut(marked.groupBy("sid", "n", "fp", "least").agg(F.min("key").alias("first")))
    postings = _sketched(nodes).select("sid", "n", "fp", F.explode("sketch").alias("token"))
    heads = postings.groupBy("token").agg(F.min(F.struct("sid", "n", "fp")).alias("e"), F.max("sid").alias("last"))
    shared = stored(postings.join(heads.where("e.sid < last").drop("last"), "token"))
    near = _maybe(F.col("n"), F.col("fp"), F.col("e.n"), F.col("e.fp"), reach, num, den)
    edges = _similar(shared.where((F.col("sid") > F.col("e.sid")) & near).select(F.col("sid").alias("a"), F.col("e.sid").alias("b")), rows, nodes, words, num, den)
    mixed = _rooted(shared.select("token", "sid", "n", "fp"), cut(connected_components(edges)))
    links = edges.unionByName(_linked_in_blocks(mixed.where(F.col("size") > SMALL), rows, nodes, words, reach, num, den))
    now = mixed.where(F.col("size") <= SMALL)
    left = now.where("root <> usual").select("token", *(F.col(c).alias(f"l_{c}") for c in ("sid", "n", "fp", "root")))
    once = (F.col("root") == F.col("usual")) | (F.col("sid") < F.col("l_sid"))
    met = left.join(now, "token").where((F.col("root") != F.col("l_root")) & once & _maybe(F.col("l_n"), F.col("l_fp"), F.col("n"), F.col("fp"), reach, num, den))
    across = met.select(F.greatest("sid", "l_sid").alias("a"), F.least("sid", "l_sid").alias("b"))
    roots = cut(connected_components(links.unionByName(_similar(across, rows, nodes, words, num, den))))
    named = cut(nodes.join(roots, nodes["sid"] == roots["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select(F.col("key").alias(key), "sid").join(named.join(least, "root").select("sid", "component_id"), "sid").select(key, "component_id")


def _firsts(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    first = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_first")).distinct()
    return docs.join(first, docs[key].eqNullSafe(first["_first"]), "left_semi")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest key of each component within 3 bits, columns unchanged.

    Rows that repeat this key in one component all stay.
    """
    return _firsts(docs, simhash_groups(docs, key, text), key)


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row of the smallest key of each component of ``similar_groups``, columns unchanged.

    Rows that repeat this key in one component all stay.
    """
    return _firsts(docs, similar_groups(docs, key, text, **options), key)
