"""A trie of conversation prefixes: how many conversations share which first turns, and what sharing them would save.

Distinct turns are dictionary-encoded, so a conversation is an array of ids and no text travels. Equal conversations collapse
first. The rest is cut into range shards of the lexicographic order, whatever their first turns. A task builds a ternary search
tree for at most ``TURNS`` turns at a time: the ids below one node form a binary tree, balanced because the sorted conversations
are inserted median first. One pass from the youngest node to the oldest accumulates members, leaves and savings; a node is
always older than what hangs below it, so nothing recurses and conversations may have any length.

Only prefixes of a shard's first and last conversation can be shared with other shards. These boundary nodes go on as partial
sums and are merged, ``FAN`` shards at a time, until one group is left; a node strictly inside a group is final there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import discard, stored

# Turns that one tree holds at a time (a longer conversation stands alone), and neighbouring shards merged by one task.
TURNS, FAN = 200_000, 32
# Ids of conversations joined before they reach the digest of their group.
ID_BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
# Key of the root; the key of any other boundary node digests its parent's key and its turn's id.
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def sequences(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<id, size>>) of every conversation, its turns in order.

    ``id`` stands for a distinct (role, text), ``size`` is the text's code points. A null role or text counts as empty, null
    turns come first, rows of one turn number go by the digest of role and text. Rows without a conversation id are left out.
    A conversation's ids are one array; its texts never leave the task that read them.
    """
    said, by = F.coalesce(rows[text], F.lit("")), F.coalesce(rows[role], F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 32))
    one = rows.where(rows[conv].isNotNull()).select(
        rows[conv].cast("long").alias("conv_id"), rows[turn].alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("size")
    )
    ids = stored(one.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))
    listed = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size")))
    grouped = one.join(ids, "digest").groupBy("conv_id").agg(listed.alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, and goes on after its own first h turns.

    h is crc32 of c in decimal modulo ``most``. Of an absent conversation nothing is taken; shorter ones give all they have.
    """
    own = conversations.select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h")
    )
    firsts = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lent"))
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(firsts, "base", "left").select("conv_id", F.concat(lent, F.when(F.size("turns") > 0, rest).otherwise(F.col("turns"))).alias("turns"))


def _end_digests(keyed: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the ids of equal conversations, ascending, comma-joined; ids meet in blocks and are streamed."""
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("block")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = keyed.groupBy("seq", block).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if seq != at:
                    if at is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = seq, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["seq", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["seq", "ends"])

    return blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(run, "seq string, ends string")


class Tree:
    """A ternary search tree over sorted, distinct sequences of turn ids; node 0 is the root, with no turn."""

    def __init__(self):
        self.turn, self.size, self.low, self.high, self.down, self.parent, self.depth = [None], [0], [0], [0], [0], [-1], [0]
        self.n, self.conv, self.ends = [0], [None], [None]

    def child(self, node: int, turn: int, size: int) -> int:
        """The node of this turn below ``node``, made if it is missing (0 stands for no link)."""
        at, links = self.down[node], self.down
        put = node
        while at:
            if turn == self.turn[at]:
                return at
            links, put = (self.low if turn < self.turn[at] else self.high), at
            at = links[at]
        new = links[put] = len(self.turn)
        self.turn.append(turn)
        self.size.append(size)
        for link in (self.low, self.high, self.down):
            link.append(0)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        self.n.append(0)
        self.conv.append(None)
        self.ends.append(None)
        return new

    def insert(self, turns: list[int], sizes: list[int], conv: int, n: int, ends: str) -> None:
        node = 0
        for turn, size in zip(turns, sizes, strict=True):
            node = self.child(node, turn, size)
        self.n[node], self.conv[node], self.ends[node] = n, conv, ends

    def path(self, turns: list[int]) -> Iterator[int]:
        node = 0
        yield node
        for turn in turns:
            node = self.child(node, turn, 0)
            yield node


def by_medians(count: int) -> Iterator[int]:
    """Positions 0 to count - 1, the middle one first, then the middles of both sides."""
    spans = [(0, count)]
    while spans:
        a, b = spans.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += [(middle + 1, b), (a, middle)]


# A boundary node is a list: key, parent's key, depth, size, then what merging changes: smallest conversation, members,
# final children, leaves and savings below them, digest of its ends, whether it lies on the first and on the last path.
KEY, ABOVE, DEPTH, SIZE, CONV, N, KIDS, LEAVES, SAVED, ENDS, FIRST, LAST = range(12)
# A final row: key and parent's key (null unless boundary nodes), conv_id, depth, parent_conv_id, n_convs, n_children,
# n_leaves, saved_tokens, ends_sha256.


def shard(items: list[tuple]) -> tuple[dict[bytes, list], list[tuple]]:
    """Boundary nodes and final rows of sorted, distinct items (turn ids, sizes, conv, members, digest of ends)."""
    tree = Tree()
    for i in by_medians(len(items)):
        tree.insert(*items[i])
    keys: dict[int, bytes] = {}
    flags = {}
    for side, item in ((0, items[0]), (1, items[-1])):
        key = ROOT
        for node in tree.path(item[0]):
            if node:
                key = hashlib.blake2b(key + tree.turn[node].to_bytes(8, "big", signed=True), digest_size=16).digest()
            keys[node] = key
            flags.setdefault(node, [False, False])[side] = True
    count = len(tree.turn)
    kids, leaves, saved = [0] * count, [0] * count, [0] * count
    n, conv, parent = tree.n, tree.conv, tree.parent
    for v in range(count - 1, 0, -1):
        p = parent[v]
        n[p] += n[v]
        conv[p] = conv[v] if conv[p] is None else min(conv[p], conv[v])
        if v not in keys:
            leaves[v] = leaves[v] or 1
            saved[v] += (n[v] - 1) * tree.size[v]
            kids[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    rows = [
        (None, keys.get(parent[v]), conv[v], tree.depth[v], None if parent[v] in keys else conv[parent[v]], n[v], kids[v], leaves[v], saved[v], tree.ends[v] or NO_ENDS)
        for v in range(1, count)
        if v not in keys
    ]
    edge = {
        key: [key, keys.get(parent[v]), tree.depth[v], tree.size[v], conv[v], n[v], kids[v], leaves[v], saved[v], tree.ends[v], *flags[v]]
        for v, key in keys.items()
    }
    return edge, rows


def merged(left: dict[bytes, list], right: dict[bytes, list]) -> dict[bytes, list]:
    """Boundary nodes of two neighbouring shards as those of one: its first path is the left one's, its last the right one's."""
    out = {}
    for key, node in left.items():
        out[key] = [*node[:LAST], False]
    for key, node in right.items():
        if key not in out:
            out[key] = [*node[:FIRST], False, node[LAST]]
            continue
        at = out[key]
        at[CONV] = min(at[CONV], node[CONV])
        for part in (N, KIDS, LEAVES, SAVED):
            at[part] += node[part]
        at[ENDS], at[LAST] = at[ENDS] or node[ENDS], node[LAST]
    return out


def settled(edge: dict[bytes, list], all_of_it: bool = False) -> tuple[dict[bytes, list], list[tuple]]:
    """Final rows of the nodes on neither path (of every node, if no further shard can touch them), and what stays open."""
    inner = [k for k, node in edge.items() if all_of_it or not (node[FIRST] or node[LAST])]
    inner.sort(key=lambda k: -edge[k][DEPTH])
    for k in inner:
        node = edge[k]
        node[LEAVES] = node[LEAVES] or 1
        node[SAVED] += (node[N] - 1) * node[SIZE]
        above = edge.get(node[ABOVE])
        if above is not None:
            above[KIDS] += 1
            above[LEAVES] += node[LEAVES]
            above[SAVED] += node[SAVED]
    gone = set(inner)
    rows = []
    for k in inner:
        key, above, depth, _, conv, n, kids, leaves, saved, ends, *_ = edge[k]
        known = above is None or above in gone
        rows.append((key, None if known else above, conv, depth, edge[above][CONV] if above in gone else None, n, kids, leaves, saved, ends or NO_ENDS))
    return {k: node for k, node in edge.items() if k not in gone}, rows


_ROW = (
    "key binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, size long, first boolean, last boolean, part long"
)
_ARROW = pa.schema([
    ("key", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("size", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("part", pa.int64()),
])
_BATCH = 50_000


def _final(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), _BATCH):
        columns = list(zip(*rows[start : start + _BATCH], strict=True))
        none = [None] * len(columns[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, none, none, none, none], _ARROW, strict=True)], schema=_ARROW)


def _open(edge: dict[bytes, list], part: int) -> Iterator[pa.RecordBatch]:
    rows = [(x[KEY], x[ABOVE], x[CONV], x[DEPTH], None, x[N], x[KIDS], x[LEAVES], x[SAVED], x[ENDS], x[SIZE], x[FIRST], x[LAST], part) for x in edge.values()]
    for start in range(0, len(rows), _BATCH):
        columns = list(zip(*rows[start : start + _BATCH], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _grow(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[pa.RecordBatch]:
    """One task's range of sorted conversations: trees of at most ``turns`` turns, their boundaries merged as they come."""
    part, edge, items, held = TaskContext.get().partitionId(), None, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal edge, items, held
        fresh, rows = shard(items)
        items, held = [], 0
        yield from _final(rows)
        if edge is None:
            edge = fresh
        else:
            edge, rows = settled(merged(edge, fresh))
            yield from _final(rows)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ids", "sizes", "conv_id", "n", "ends")]
        for item in zip(*columns, strict=True):
            if items and held + len(item[0]) > turns:
                yield from flush()
            items.append(item)
            held += len(item[0])
    if items:
        yield from flush()
    if edge is not None:
        yield from _open(edge, part)


def _merge(table: pa.Table, last: bool) -> pa.Table:
    """Neighbouring shards' boundary nodes as one shard's; ``last`` if no other group is left."""
    rows = table.to_pylist()
    shards: dict[int, dict[bytes, list]] = {}
    for r in rows:
        node = [r[c] for c in ("key", "above", "depth", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "first", "last")]
        shards.setdefault(r["part"], {})[node[KEY]] = node
    out, edge = [], None
    for part in sorted(shards):
        if edge is None:
            edge = shards[part]
        else:
            edge, final = settled(merged(edge, shards[part]))
            out += _final(final)
    if last:
        edge, final = settled(edge, True)
        out += _final(final)
    out += _open(edge, rows[0]["part"] // FAN)
    return pa.Table.from_batches(out, _ARROW)


def trie(conversations: DataFrame, turns: int = TURNS, shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns array<struct<id, size>>), the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, members but one times the code points of the node's last
    text), ends_sha256 (ids of conversations that end here, ascending, comma-joined, digested; without any that of ''). A
    conversation without turns is a member of the root. Conversation ids must be distinct. No conversations give no rows.
    ``shards`` range shards are made, by default one for each ``turns`` turns and at least spark.sql.shuffle.partitions.
    """
    spark = conversations.sparkSession
    code: Column = F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",")
    keyed = stored(conversations.select("conv_id", "turns", F.sha2(code, 256).alias("seq")))
    once = keyed.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns"))
    whole = once.join(_end_digests(keyed.select("seq", "conv_id")), "seq")
    items = stored(whole.select(F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"), "conv_id", "n", "ends"))
    if shards is None:
        total = items.agg(F.sum(F.size("ids"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // turns))
    ranged = items.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    levels = [stored(ranged.mapInArrow(lambda batches: _grow(batches, turns), _ROW))]
    discard(keyed)
    groups = shards
    while True:
        last = groups <= FAN
        edges = levels[-1].where("part is not null")
        near = edges.groupBy(F.floor(F.col("part") / FAN).alias("_group"))
        levels.append(stored(near.applyInArrow((lambda t: _merge(t, True)) if last else (lambda t: _merge(t, False)), _ROW)))
        groups = -(-groups // FAN)
        if last:
            break
    discard(items)
    rows = levels[0].where("part is null")
    for level in levels[1:]:
        rows = rows.unionByName(level.where("part is null"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = rows.where("key is not null").select(F.col("key").alias("above"), F.col("conv_id").alias("named"))
    below = rows.where("above is not null").join(named, "above").select("conv_id", "depth", F.col("named").alias("parent_conv_id"), *columns[2:])
    return rows.where("above is null").select(*below.columns).unionByName(below)
