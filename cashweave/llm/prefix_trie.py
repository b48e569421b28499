"""Prefix trie of conversations: sorted sequences, common-prefix lengths, sparse-table range minima.

Sequences are sorted globally and cut into blocks. Within a block every candidate prefix
finds the left and the right end of its members by its own binary searches over a sparse
table of range minima of the common-prefix lengths, without a stack and without regard to
other candidates; minima over the ids give the smallest member. A node stands at its
first member, so in the order of (first member, depth) a subtree is a run of nodes, and sums over
subtrees are differences of running sums.

A node whose members go on in later blocks is open. Open nodes at a block's end are
prefixes of one sequence, so there are at most as many as that sequence has turns. The same
searches over one minimum a block find the blocks where they start and end, and their
numbers are put together from the parts in the first block, the blocks between, and the last.
Only counts and minima of the blocks (a few numbers a block) go through the driver.

Turns are compared by 128 bits of SHA-256; texts are read once and not shuffled. Blocks are
cut by (sequence, id), so equal sequences, a third of all rows or more, fill many blocks.
A conversation itself is one row of 40 bytes a turn. The ids of members that end in an
open node are hashed one after the other, as SHA-256 needs, from chunks of `CHUNK_IDS` ids.

Defined cases: null turns first, then equal turns by role and digest of the turn; null
role or text is empty; rows with a null id belong to no conversation; repeated rows are
turns of their own; an empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cashweave.llm.common import Batches, in_tasks, partitions, restage
from cashweave.llm.ordered import in_blocks

DIGEST = 32  # hexadecimal digits of a turn's digest
BLOCK_TURNS, CHUNK_IDS = 200_000, 500
MOST_HEAD, HEADS_OF = 9, 5
NONE = hashlib.sha256(b"").hexdigest()
ENDLESS = 1 << 62


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests of the rebuilt turns as one string, and bytes of their texts.

    Conversation c takes the first h turns of conversation c - c % 5, then its own after its first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("t"))
    heads = own.select(F.col("conv_id").alias("base"), F.slice("t", 1, MOST_HEAD - 1).alias("head"))
    own = own.withColumns({
        "h": (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).cast("int"),
        "base": F.col("conv_id") - F.col("conv_id") % HEADS_OF,
    })
    tail = F.slice("t", F.col("h") + 1, F.greatest(F.lit(0), F.size("t") - F.col("h")))
    whole = F.when(F.col("head").isNull(), tail).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), tail))
    out = own.join(heads, "base", "left").select("conv_id", whole.alias("t"))
    return out.select("conv_id", F.array_join(F.col("t.digest"), "").alias("path"), F.col("t.bytes").alias("sizes"))


# --- range minima -----------------------------------------------------------


class RangeMin:
    """Sparse table over a sequence; all questions are arrays."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last r so that all values after `at` up to r are `least` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + 1 < len(level)
            fits[fits] = level[at[fits] + 1] >= least[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first l so that all values after l up to `at` are `least` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            fits = start > 0
            fits[fits] = self.levels[k][start[fits]] >= least[fits]
            at[fits] -= 1 << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum from `first` to `last`; first <= last."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for level in np.unique(k):
            own = k == level
            values = self.levels[level]
            out[own] = np.minimum(values[first[own]], values[last[own] - (1 << int(level)) + 1])
        return out


def common(a: str, b: str) -> int:
    """Turns of the longest common prefix."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


# --- blocks -----------------------------------------------------------------

SORTED = "_block long, _pos long, conv_id long, _lcp long, _len long, _new array<long>, _path string"


def neighbours(batches: Batches) -> Batches:
    """Of a sorted block: prefix lengths against the row before, sizes of the turns that differ; a last row holds the last path."""
    block, pos, last = TaskContext.get().partitionId(), 0, None
    schema = pa.schema([(n, pa.int64()) for n in ("_block", "_pos", "conv_id", "_lcp", "_len")] + [("_new", pa.list_(pa.int64())), ("_path", pa.string())])
    for batch in batches:
        rows = []
        for conv, path, sizes in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes")]):
            lcp = -1 if last is None else common(last, path)
            rows.append((block, pos, conv, lcp, len(sizes), sizes[max(lcp, 0) :], path if last is None else None))
            last, pos = path, pos + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    if last is not None:
        row = (block, -1, None, None, None, None, last)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types)], schema=schema)


class Blocks:
    """What is known of each block that has rows: size, smallest id, smallest inner prefix length, prefix shared with the block before."""

    def __init__(self, rows: list):
        self.number = {r["_block"]: k for k, r in enumerate(rows)}
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.smallest = RangeMin(np.array([r["least"] for r in rows], np.int64))
        inner = np.array([ENDLESS if r["inner"] is None else r["inner"] for r in rows], np.int64)
        self.link = np.array([r["link"] for r in rows] + [-1], np.int64)
        # a prefix that enters a block leaves it at the other side if both are long enough
        self.rightward = RangeMin(np.minimum(inner, self.link[1:]))
        self.leftward = RangeMin(np.minimum(inner, self.link[:-1]))

    def start(self, boundary: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The block where the node starts that goes from block `boundary` - 1 into `boundary`."""
        return self.leftward.left(boundary - 1, depth)

    def end(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The block where an open node that starts in `start` ends."""
        return self.rightward.right(start, depth) + 1

    def between(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and smallest id of the blocks after `start` and before `end`."""
        sums = np.r_[0, np.cumsum(self.count)]
        least = np.full(len(start), ENDLESS, np.int64)
        some = end - start > 1
        least[some] = self.smallest.least(start[some] + 1, end[some] - 1)
        return sums[end] - sums[start + 1], least


# One row for each fact that a block contributes. `kind`: node (closed, whole), open (a node
# that goes on), kid (children of an open node), chain (an open node that enters this block),
# ends (a chunk of ids of members that end in an open node), total (sums over closed nodes).
# `boundary` names the open node of that depth between the blocks boundary - 1 and boundary.
FACTS = (
    "kind string, block long, depth long, conv_id long, parent_conv_id long, boundary long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, bytes long, part long, text string"
)
FACT_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def facts(table: pa.Table, blocks: Blocks) -> pa.Table:
    """All facts of one block, its rows in any order."""
    table = table.sort_by("_pos").combine_chunks()
    block = blocks.number[table.column("_block")[0].as_py()]
    conv, length = table.column("conv_id").to_numpy(), table.column("_len").to_numpy()
    lcp = table.column("_lcp").to_numpy().copy()
    n, link, onward = len(conv), int(blocks.link[block]), int(blocks.link[block + 1])
    lcp[0] = link
    sizes = table.column("_new").combine_chunks().flatten().to_numpy()
    skip = max(link, 0)
    sizes = np.r_[np.zeros(int(link < 0), np.int64), sizes[skip:]]

    # candidates: the prefixes of each row that the row before does not have
    made = length - lcp
    pos = np.repeat(np.arange(n), made)
    first = np.r_[0, np.cumsum(made)]
    depth = np.arange(len(pos)) - first[pos] + lcp[pos] + 1
    prefix, ids = RangeMin(lcp), RangeMin(conv)
    right = prefix.right(pos, depth)
    is_open = (right == n - 1) & (onward >= depth)
    top = depth == 0
    above = np.maximum(depth - 1, 0)
    up_left, up_right = prefix.left(pos, above), prefix.right(pos, above)
    leaves = ~top & (up_right == n - 1) & (onward >= above)
    enters = ~top & (up_left == 0) & (link >= above)
    up_open = leaves | enters
    boundary = np.where(leaves, block + 1, block)
    up_conv = ids.least(up_left, up_right)

    # children, by the parent's first row and depth
    deep = int(depth.max(initial=0)) + 2
    key = pos * deep + depth
    parents, kids = np.unique((up_left * deep + above)[~top & ~up_open], return_counts=True)
    children = np.zeros(len(pos), np.int64)
    at = np.searchsorted(parents, key)
    found = at < len(parents)
    found[found] = parents[at[found]] == key[found]
    children[found] = kids[at[found]]

    members = right - pos + 1
    closed = ~is_open
    weight = np.where(closed, (members - 1) * sizes, 0)
    saved = np.r_[0, np.cumsum(weight)]
    leaf = np.r_[0, np.cumsum(closed & (children == 0))]
    end = first[right + 1]
    same = np.r_[False, (lcp[1:] == length[1:]) & (length[1:] == length[:-1])]
    run = np.r_[np.flatnonzero(~same), n]  # runs of equal sequences
    run_end = run[np.searchsorted(run, np.arange(n), side="right")]

    out = []

    def add(kind: str, count: int, **columns) -> None:
        given = {"kind": pa.array([kind] * count, pa.string()), "block": pa.array(np.full(count, block, np.int64))}
        for name in FACT_COLUMNS[2:]:
            kind_of = pa.string() if name == "text" else pa.int64()
            given[name] = pa.array(columns[name], kind_of) if name in columns else pa.nulls(count, kind_of)
        out.append(pa.table(given))

    own = np.flatnonzero(closed)
    ending = [hashlib.sha256(joined(conv[p : run_end[p]]).encode()).hexdigest() if ends else NONE
              for p, ends in zip(pos[own].tolist(), (length[pos[own]] == depth[own]).tolist())]
    add("node", len(own), depth=depth[own], conv_id=ids.least(pos[own], right[own]),
        parent_conv_id=pa.array(up_conv[own], mask=(top | up_open)[own]), boundary=pa.array(boundary[own], mask=~up_open[own]),
        n_convs=members[own], n_children=children[own], n_leaves=leaf[end[own]] - leaf[own],
        saved_tokens=saved[end[own]] - saved[own], text=ending)
    own = np.flatnonzero(is_open)
    add("open", len(own), depth=depth[own], conv_id=ids.least(pos[own], right[own]),
        boundary=pa.array(boundary[own], mask=~up_open[own]), n_convs=members[own], bytes=sizes[own],
        n_leaves=leaf[-1] - leaf[own], saved_tokens=saved[-1] - saved[own])
    add("total", 1, n_leaves=leaf[-1:], saved_tokens=saved[-1:])
    for edge in (block, block + 1):
        hit = up_open & (boundary == edge)
        depths, counts = np.unique(above[hit], return_counts=True)
        add("kid", len(depths), depth=depths, boundary=np.full(len(depths), edge), n_children=counts)
    entering = np.arange(link + 1 if block else 0)
    reach = prefix.right(np.zeros(len(entering), np.int64), entering)
    stop = first[reach + 1]
    add("chain", len(entering), depth=entering, boundary=np.full(len(entering), block), n_convs=reach + 1,
        conv_id=ids.least(np.zeros(len(entering), np.int64), reach), n_leaves=leaf[stop], saved_tokens=saved[stop])

    # ids of members that end in an open node: where it starts, and where it enters with nothing longer before
    starts = [(p, int(d), block + 1) for p, d in zip(pos[own].tolist(), depth[own].tolist()) if length[p] == d]
    if block and length[0] == link:
        starts.append((0, link, block))
    for p, d, edge in starts:
        cuts = range(p, int(run_end[p]), CHUNK_IDS)
        add("ends", len(cuts), depth=np.full(len(cuts), d), boundary=np.full(len(cuts), edge), part=np.arange(len(cuts)),
            text=[joined(conv[c : min(c + CHUNK_IDS, int(run_end[p]))]) for c in cuts])
    return pa.concat_tables(out).select(FACT_COLUMNS)


# --- open nodes -------------------------------------------------------------


def with_blocks(df: DataFrame, blocks: Blocks, start: str, extra: str) -> DataFrame:
    """Adds `_start` from boundary and depth, or `_end`, `_mid` and `_least` of an open node that starts in `block`."""
    names = [*df.columns, *[c.split()[0] for c in extra.split(", ")]]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], extra])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            depth = batch.column("depth").to_numpy(zero_copy_only=False)
            from_block = batch.column(start).to_numpy(zero_copy_only=False)
            if start == "boundary":
                new = [blocks.start(from_block, depth)]
            else:
                end = blocks.end(from_block, depth)
                new = [end, *blocks.between(from_block, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in new]], names=names)

    return in_tasks(df, run, ddl)


def hashed_ends(batches: Batches) -> Batches:
    """SHA-256 over the chunks of each node in order; chunks come sorted by node."""
    now, digest = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for start, depth, text in zip(*[batch.column(c).to_pylist() for c in ("_start", "depth", "text")]):
            if (start, depth) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (start, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["_start", "depth", "text"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], names=["_start", "depth", "text"])


def opened(found: DataFrame, blocks: Blocks) -> DataFrame:
    """(_start, depth, conv_id, boundary of the parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the open nodes."""
    of = lambda kind: found.where(F.col("kind") == kind)
    node = ["_start", "depth"]
    nodes = with_blocks(of("open"), blocks, "block", "_end long, _mid long, _least long").withColumnRenamed("block", "_start")
    last = of("chain").select(
        F.col("block").alias("_end"), "depth", F.col("n_convs").alias("_rows"), F.col("conv_id").alias("_id"),
        F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"),
    )
    kids = with_blocks(of("kid").select("boundary", "depth", "n_children"), blocks, "boundary", "_start long")
    kids = kids.groupBy(*node).agg(F.sum("n_children").alias("_kids"))
    ends = with_blocks(of("ends").select("boundary", "block", "depth", "part", "text"), blocks, "boundary", "_start long")
    ends = ends.repartition(partitions(found.sparkSession), *node).sortWithinPartitions(*node, "block", "part")
    ends = in_tasks(ends, hashed_ends, "_start long, depth long, text string").withColumnRenamed("text", "_hash")
    whole = nodes.join(last, ["_end", "depth"]).join(kids, node, "left").join(ends, node, "left").select(
        *node, "_end", "boundary",
        F.least("conv_id", "_least", "_id").alias("conv_id"),
        (F.col("n_convs") + F.col("_mid") + F.col("_rows")).alias("n_convs"),
        F.coalesce("_kids", F.lit(0)).cast("long").alias("n_children"),
        (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"),
        "bytes", F.coalesce("_hash", F.lit(NONE)).alias("ends_sha256"),
    )
    own = whole.withColumns({
        "_weight": (F.col("n_convs") - 1) * F.col("bytes"),
        "_leaf": (F.col("n_children") == 0).cast("long"),
    })
    own, _ = restage(own, "open-nodes")
    # deeper open nodes of the same block lie in the subtree
    deeper = Window.partitionBy("_start").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"_weights": F.sum("_weight").over(deeper), "_leafs": F.sum("_leaf").over(deeper)})
    # sums over whole blocks, closed and open nodes; a row a block
    totals = of("total").select("block", F.col("saved_tokens").alias("s"), F.col("n_leaves").alias("l")).unionByName(
        own.select(F.col("_start").alias("block"), F.col("_weight").alias("s"), F.col("_leaf").alias("l")))
    totals = totals.groupBy("block").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select("block", F.sum("s").over(upto).alias("s"), F.sum("l").over(upto).alias("l"))
    before = totals.select(F.col("block").alias("_start"), F.col("s").alias("_s0"), F.col("l").alias("_l0"))
    after = totals.select((F.col("block") + 1).alias("_end"), F.col("s").alias("_s1"), F.col("l").alias("_l1"))
    return summed.join(before, "_start").join(after, "_end").select(
        *node, "conv_id", "boundary", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("_leafs") + F.col("_l1") - F.col("_l0")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_weights") + F.col("_s1") - F.col("_s0")).alias("saved_tokens"),
        "ends_sha256",
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(paths: DataFrame, blocks: int | None = None) -> DataFrame:
    """(conv_id, path, sizes) with unique ids to the nodes of the trie, named by smallest member and depth."""
    spark = paths.sparkSession
    paths, _ = restage(paths, "paths")
    if blocks is None:
        turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
        blocks = max(1, min(partitions(spark), -(-turns // BLOCK_TURNS)))
    rows, _ = restage(in_tasks(in_blocks(paths, ["path", "conv_id"], blocks), neighbours, SORTED), "sorted")

    # a row a block; only here the whole first and last sequence of a block are compared
    inner = F.min(F.when(F.col("_pos") > 0, F.col("_lcp"))).alias("inner")
    ends = [F.max(F.when(F.col("_pos") == 0, F.col("_path"))).alias("first"), F.max(F.when(F.col("_pos") < 0, F.col("_path"))).alias("last")]
    summary = rows.groupBy("_block").agg(F.count("conv_id").alias("n"), F.min("conv_id").alias("least"), inner, *ends)
    summary = summary.withColumn("last", F.lag("last").over(Window.orderBy("_block")))

    def links(batches: Batches) -> Batches:
        for batch in batches:
            pairs = zip(batch.column("last").to_pylist(), batch.column("first").to_pylist())
            link = pa.array([-1 if a is None else common(a, b) for a, b in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_block", "n", "least", "inner")], link], names=["_block", "n", "least", "inner", "link"])

    linked = in_tasks(summary, links, "_block long, n long, least long, inner long, link long").collect()
    if not linked:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    known = Blocks(sorted(linked, key=lambda r: r["_block"]))
    found, _ = restage(rows.where("_pos >= 0").drop("_path").groupBy("_block").applyInArrow(lambda t: facts(t, known), FACTS), "facts")

    nodes = found.where("kind = 'node'").withColumnRenamed("text", "ends_sha256")
    if len(linked) == 1:
        return nodes.select(*COLUMNS)
    whole, _ = restage(opened(found, known), "opened")
    # the open node between two blocks, by boundary and depth: the key of its children in either block
    chain = with_blocks(found.where("kind = 'chain'").select("boundary", "depth"), known, "boundary", "_start long")
    named = chain.join(whole.select("_start", "depth", F.col("conv_id").alias("_up")), ["_start", "depth"])
    named = named.select(F.col("boundary").alias("_boundary"), F.col("depth").alias("_above"), "_up")
    every = nodes.select(*COLUMNS, "boundary").unionByName(
        whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COLUMNS, "boundary"))
    every = every.join(named, (F.col("boundary") == F.col("_boundary")) & (F.col("depth") - 1 == F.col("_above")), "left")
    return every.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).select(*COLUMNS)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(turns))


OP12_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), hex AS (
  SELECT DISTINCT c FROM own
), crc AS (
  SELECT c, 0 AS byte, 4294967295::BIGINT AS r FROM hex
  UNION ALL
  SELECT c, byte + 1,
         list_reduce([xor(r, ord((c::VARCHAR)[byte + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
  FROM crc WHERE byte < length(c::VARCHAR)
), heads AS (
  SELECT c, xor(r, 4294967295::BIGINT) % 9 AS h, c - c % 5 AS base FROM crc WHERE byte = length(c::VARCHAR)
), rebuilt AS (
  SELECT h.c, o.role, o.text, 0 AS part, o.pos FROM heads h JOIN own o ON o.c = h.base AND o.pos <= h.h
  UNION ALL
  SELECT h.c, o.role, o.text, 1, o.pos FROM heads h JOIN own o ON o.c = h.c AND o.pos > h.h
), turns AS (
  SELECT c, strlen(text) AS bytes, row_number() OVER w AS depth,
         list(sha256(strlen(role)::VARCHAR || ':' || role || text)) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos)
), prefixes AS (
  SELECT c, depth, bytes, md5(path::VARCHAR) AS node, lag(md5(path::VARCHAR), 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS up FROM turns
  UNION ALL
  SELECT c, 0, 0, 'root', NULL FROM heads
), lengths AS (
  SELECT c, max(depth) AS n FROM prefixes GROUP BY c
), nodes AS (
  SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (c) GROUP BY node
), kids AS (
  SELECT up AS node, count(*) AS n_children FROM nodes GROUP BY up
), below AS (
  SELECT DISTINCT a.node, b.node AS lower FROM prefixes a JOIN prefixes b ON a.c = b.c AND b.depth >= a.depth
), sums AS (
  SELECT below.node, sum((l.n_convs - 1) * l.bytes) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM below JOIN nodes l ON l.node = lower LEFT JOIN kids k ON k.node = lower GROUP BY below.node
)
SELECT x.conv_id::BIGINT AS conv_id, x.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN kids k ON k.node = x.node LEFT JOIN nodes p ON p.node = x.up
"""
