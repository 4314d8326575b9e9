"""Prefix trie of conversations as a node table over minimal perfect hash slots.

Rebuilding.  A conversation c is the first h original turns of conversation c - c % 5 and its own turns after its first h.
Only digests of (role, text) are sorted and exchanged, no texts.

Enumeration.  The digest of a prefix is the exclusive or of the digests of its (depth, role, text), 128 bits; running values
are taken in blocks of depths, and a block's carry from the totals of earlier blocks, so one long conversation is many
small windows.  Distinct digests are the nodes, counted with partial sums; rows of one digest must agree in depth, parent
and turn, else the job fails.

Shards.  Nodes of one member are tails with a closed form.  The others fall into levels by the number of their members
(2 to 256, to 65,536, ...) and into blocks of depths; the nodes below one another in the same level and block are a
fragment, named by its top.  A fragment has at most 256 nodes of a depth, however popular its prefixes.  Whole fragments
form a shard of bounded size: its digests get slots by a minimal perfect hash, looked up slots are verified against the
stored digests, counts are scattered into flat arrays, and arrays are accumulated through parent slots from the deepest
level up.  What a fragment's top hands to its parent goes through an exchange to the next level or block, so there are as many
rounds as levels and blocks, two or three on most data.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import positions
from .common import stored

GROUP, HEAD_MOD = 5, 9
RUN_BLOCK, DEPTH_BLOCK, LEVEL_BITS = 4096, 16_384, 8
SHARD_ROWS = 200_000
_CHUNK_IDS = 4096
_SEED = 1
_DONE = "p1 long, p2 long, q1 long, q2 long, depth long, n long, conv_id long, children long, leaves long, saved long, top boolean"


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD_MOD


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, t1, t2, size) of all rebuilt turns and of depth 0, (conv, length) of all conversations).

    ``turns`` has conv_id, turn, role and text.  Turns are ordered by ``turn``, null first; equal ones by a digest of role and
    text.  Null roles and texts count as empty.  Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(_SEED), role, text).alias("t2"),
        F.octet_length(text).cast("long").alias("size"))
    own = stored(positions(slim, ["conv"], ["turn", "t1", "t2"], "at"), "trie-turns")
    sizes = own.groupBy("conv").agg(F.max("at").alias("have"))
    head = head_length(F.col("conv"))
    source = F.col("conv") - F.col("conv") % GROUP
    given = sizes.select(F.col("conv").alias("source"), F.col("have").alias("theirs"))
    convs = stored(sizes.withColumn("source", source).join(given, "source", "left").select(
        "conv", "source", head.alias("h"), "have", F.least(head, F.coalesce("theirs", F.lit(0))).alias("k")), "trie-conversations")
    turn = ["t1", "t2", "size"]
    lent = own.filter(F.col("at") < HEAD_MOD).select(F.col("conv").alias("source"), "at", *turn)
    first = convs.join(lent, "source").filter(F.col("at") <= F.col("h")).select("conv", F.col("at").alias("depth"), *turn)
    rest = (own.filter(F.col("at") > head).join(convs.select("conv", "h", "k"), "conv")
            .select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), *turn))
    none = F.lit(0).cast("long")
    top = convs.select("conv", none.alias("depth"), *[none.alias(c) for c in turn])
    return top.union(first).union(rest), convs.select("conv", (F.col("k") + F.greatest(F.col("have") - F.col("h"), F.lit(0))).alias("length"))


def prefix_digests(rows: DataFrame, run_block: int = RUN_BLOCK) -> DataFrame:
    """``rows`` with the digest (p1, p2) of the prefix that ends there, and (q1, q2) of the one before; depth 0 is (0, 0)."""
    def part(seed):
        return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "t1", "t2"))

    marked = rows.withColumns({"z1": part(2), "z2": part(3), "block": F.expr(f"depth div {run_block}")})
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("conv", "block").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    carried = totals.select("conv", "block", F.bit_xor("s1").over(before).alias("c1"), F.bit_xor("s2").over(before).alias("c2")).filter("block > 0")
    run = marked.select("*", F.bit_xor("z1").over(inside).alias("r1"), F.bit_xor("z2").over(inside).alias("r2")).join(carried, ["conv", "block"], "left")
    zero = F.lit(0).cast("long")
    p1, p2 = F.col("r1").bitwiseXOR(F.coalesce("c1", zero)), F.col("r2").bitwiseXOR(F.coalesce("c2", zero))
    return run.select("conv", "depth", "t1", "t2", "size", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("z1")).alias("q1"), p2.bitwiseXOR(F.col("z2")).alias("q2"))


def node_table(paths: DataFrame) -> DataFrame:
    """One row for each distinct digest, with ``n`` members, the smallest as conv_id; fails where a digest has two meanings."""
    same = ["depth", "q1", "q2", "t1", "t2", "size"]
    nodes = paths.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv_id"),
                                          F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi"))
    checked = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("two prefixes share one digest")))
    return nodes.withColumn("lo", checked).select("p1", "p2", "n", "conv_id", "lo.depth", "lo.q1", "lo.q2", "lo.size")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Slots:
    """Minimal perfect hash of distinct 128-bit digests: each level places the digests that are alone in their cell.

    A digest's slot is the number of places taken before it, so n digests have the slots 0 to n - 1.  The digests are
    kept by slot, and a foreign one is told by them.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray, load: float = 1.5, most: int = 100):
        self.levels, left, taken = [], np.arange(len(k1)), 0
        while len(left):
            if len(self.levels) == most:
                raise ValueError("repeated digests")
            cells = int(len(left) * load) + 1
            at = self._cell(k1[left], k2[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((cells, alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.first, self.second = np.zeros(len(k1), np.int64), np.zeros(len(k1), np.int64)
        slots = self._find(k1, k2)
        self.first[slots], self.second[slots] = k1, k2

    @staticmethod
    def _cell(k1, k2, level, cells):
        mixed = _mix(k1.view(np.uint64) ^ _mix(k2.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
        return (mixed % np.uint64(cells)).astype(np.int64)

    def _find(self, k1, k2):
        slots, open_ = np.full(len(k1), -1), np.arange(len(k1))
        for level, (cells, alone, place) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._cell(k1[open_], k2[open_], level, cells)
            hit = alone[at]
            slots[open_[hit]] = place[at[hit]]
            open_ = open_[~hit]
        return slots

    def __getitem__(self, digests) -> np.ndarray:
        """Slots of (k1, k2); -1 for digests that are not in the table."""
        k1, k2 = digests
        slots = self._find(k1, k2)
        known = slots >= 0
        known[known] = (self.first[slots[known]] == k1[known]) & (self.second[slots[known]] == k2[known])
        return np.where(known, slots, -1)


def accumulate(shard: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved bytes of the nodes of whole fragments, in the order of the rows.

    The columns ``children``, ``leaves`` and ``saved`` hold what tails and finished fragments have handed over.
    """
    slots = Slots(shard["p1"], shard["p2"])
    own = slots[shard["p1"], shard["p2"]]
    m = len(own)

    def scattered(values):
        flat = np.zeros(m, np.int64)
        np.add.at(flat, own, values)
        return flat

    parent, depth = np.full(m, -1), np.zeros(m, np.int64)
    parent[own], depth[own] = slots[shard["q1"], shard["q2"]], shard["depth"]
    parent[depth == 0] = -1  # the root's digest is its own parent's
    children, leaves = scattered(shard["children"]), scattered(shard["leaves"])
    saved = scattered(shard["saved"] + (shard["n"] - 1) * shard["size"])
    inside = parent >= 0
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, cuts):
        rows = rows[inside[rows]]
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    return {"children": children[own], "leaves": leaves[own], "saved": saved[own], "top": ~inside[own]}


def _shards(limit: int):
    names = ["p1", "p2", "q1", "q2", "depth", "n", "conv_id", "children", "leaves", "saved", "size", "f1", "f2"]

    def done(t):
        rows = {c: t.column(c).to_numpy() for c in names}
        rows |= accumulate(rows)
        return pa.RecordBatch.from_pydict({f.split()[0]: rows[f.split()[0]] for f in _DONE.split(", ")})

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > limit:
                f1, f2 = held.column("f1").to_numpy(), held.column("f2").to_numpy()
                edges = np.flatnonzero((f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])) + 1
                if len(edges):
                    yield done(held.slice(0, edges[-1]))
                    held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield done(held)

    return run


def _ends_hash(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of ``ends`` (p1, p2, conv): ids are sorted over all tasks, joined in chunks, and the chunks hashed in order."""
    def chunks(batches):
        for b in batches:
            p1, p2, conv = (b.column(c).to_numpy() for c in ("p1", "p2", "conv"))
            edges = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            out = []
            for i, j in zip([0, *edges], [*edges, len(conv)]):
                out += [(p1[i], p2[i], conv[k], ",".join(map(str, conv[k:min(k + _CHUNK_IDS, j)].tolist()))) for k in range(i, j, _CHUNK_IDS)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["p1", "p2", "first", "ids"])

    def hashes(batches):
        key, digest, out = None, None, []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("p1", "p2", "ids")]):
                if row[:2] != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = row[:2], hashlib.sha256(row[2].encode())
                else:
                    digest.update(b"," + row[2].encode())
            if len(out) >= _CHUNK_IDS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["p1", "p2", "ends_sha256"])
                out = []
        if key:
            out.append((*key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["p1", "p2", "ends_sha256"])

    order = ["p1", "p2", "conv"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "p1 long, p2 long, first long, ids string")
    return (parts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashes, "p1 long, p2 long, ends_sha256 string"))


def trie(turns: DataFrame, run_block: int = RUN_BLOCK, depth_block: int = DEPTH_BLOCK, level_bits: int = LEVEL_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role, text; other columns are not read.  An empty table, or one without any conv_id, has no nodes.
    Repeated rows are repeated turns.  See ``rebuilt`` for nulls and ties.  The sizes of blocks, levels and shards change the work, not
    the result.
    """
    rows, lengths = rebuilt(turns)
    paths = stored(prefix_digests(rows, run_block), "trie-paths")
    nodes = stored(node_table(paths), "trie-nodes")
    single, shared = nodes.filter("n = 1"), nodes.filter("n > 1")

    # tops of fragments along each conversation; a window holds at most one block of depths
    level = F.expr(f"(length(bin(n - 1)) - 1) div {level_bits}")
    block = F.expr(f"depth div {depth_block}")
    walk = paths.select("conv", "p1", "p2").join(shared, ["p1", "p2"]).withColumns({"level": level, "block": block})
    along = Window.partitionBy("conv", "level", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.first(F.struct(F.col("p1").alias("f1"), F.col("p2").alias("f2"))).over(along)
    placed = walk.withColumn("top", top).filter(F.col("conv") == F.col("conv_id")).drop("conv").select("*", "top.f1", "top.f2").drop("top")
    tails = single.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("tails"))
    placed = stored(placed.join(tails, ["p1", "p2"], "left").withColumn("tails", F.coalesce("tails", F.lit(0))), "trie-shared")

    rounds = sorted(((r.level, -r.block) for r in placed.select("level", "block").distinct().collect()))
    handed, finished = None, []
    for lv, bl in rounds:
        part = placed.filter((F.col("level") == lv) & (F.col("block") == -bl))
        given = {c: F.lit(0).cast("long") for c in ("g_children", "g_leaves", "g_saved")}
        if handed is None:
            part = part.withColumns(given)
        else:
            sums = handed.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
                F.count(F.lit(1)).alias("g_children"), F.sum("leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))
            part = part.join(sums, ["p1", "p2"], "left").withColumns({c: F.coalesce(c, v) for c, v in given.items()})
        ready = part.select("p1", "p2", "q1", "q2", "depth", "n", "conv_id", (F.col("g_children") + F.col("tails")).alias("children"),
                            (F.col("g_leaves") + F.col("tails")).alias("leaves"), F.col("g_saved").alias("saved"), "size", "f1", "f2")
        done = stored(ready.repartition("f1", "f2").sortWithinPartitions("f1", "f2").mapInArrow(_shards(shard_rows), _DONE), "trie-round")
        finished.append(done)
        tops = done.filter("top AND depth > 0")
        handed = tops if handed is None else handed.union(tops)

    ends = stored(_ends_hash(lengths.select("conv", F.col("length").alias("depth")).join(paths.select("conv", "depth", "p1", "p2"), ["conv", "depth"])
                             .select("p1", "p2", "conv")), "trie-ends")
    alone = single.join(ends, ["p1", "p2"], "left")
    has_end = F.col("ends_sha256").isNotNull()
    zero = F.lit(0).cast("long")
    out = ["p1", "p2", "q1", "q2", "depth", "n", "conv_id", "children", "leaves", "saved", "ends_sha256"]
    tree = alone.withColumns({"children": F.when(has_end, zero).otherwise(zero + 1), "leaves": zero + 1, "saved": zero}).select(*out)
    for done in finished:
        tree = tree.union(done.join(ends, ["p1", "p2"], "left").select(*out))
    # the parent of a node of one member has that member, or is shared
    above = shared.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    return tree.join(above, ["q1", "q2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
