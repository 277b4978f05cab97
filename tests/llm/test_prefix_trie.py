import hashlib
import random
import zlib

from pyspark.sql import functions as F

from kilohour.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(conversations):
    """All nodes of {conv: [(turn, size), ...]} from sets of prefixes."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, who in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        kids = {q for q in inside if len(q) == len(p) + 1}
        leaves = [q for q in inside if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in inside)]
        saved = sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in inside)
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(p))
        above = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), above, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, conversations):
    rows = [(c, [{"id": t, "size": s} for t, s in turns]) for c, turns in conversations.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<id: long, size: long>>")


def some(pick, n, alphabet, longest):
    size = {t: pick.randint(0, 30) for t in range(alphabet)}
    return {c: [(t, size[t]) for t in (pick.randrange(alphabet) for _ in range(pick.randint(0, longest)))] for c in pick.sample(range(-50, 20_000), n)}


def test_trie_matches_sets_of_prefixes(spark):
    pick = random.Random(8)
    for n, alphabet, longest, turns, shards in ((60, 3, 5, 7, 5), (60, 2, 7, 1, 40), (40, 9, 2, 1000, 1), (1, 2, 3, 5, 3)):
        conversations = some(pick, n, alphabet, longest)
        assert got(prefix_trie.trie(frame(spark, conversations), turns, shards)) == plain(conversations), (n, alphabet)


def test_copies_and_a_common_first_turn(spark):
    conversations = {c: [(7, 10), (8, 3)] for c in range(4090, 4200)}
    conversations |= {c: [(7, 10), (c + 100, 1)] for c in range(60)} | {5000: [], 5001: [(7, 10)]}
    assert got(prefix_trie.trie(frame(spark, conversations), 16, 12)) == plain(conversations)


def test_merging_over_several_levels_in_memory():
    """More shards than one task merges, folded as the jobs fold them, without Spark."""
    pick = random.Random(4)
    conversations = some(pick, 80, 3, 6)
    ends, items = {}, {}
    for c, turns in conversations.items():
        ends.setdefault(tuple(turns), []).append(c)
    for turns, who in ends.items():
        digest = hashlib.sha256(",".join(map(str, sorted(who))).encode()).hexdigest()
        items[tuple(t for t, _ in turns)] = ([t for t, _ in turns], [s for _, s in turns], min(who), len(who), digest)
    rows, edges = [], []
    for key in sorted(items):
        edge, final = prefix_trie.shard([items[key]])
        edges.append(edge)
        rows += final
    while len(edges) > 1:
        above = []
        for start in range(0, len(edges), 3):
            edge = edges[start]
            for other in edges[start + 1 : start + 3]:
                edge, final = prefix_trie.settled(prefix_trie.merged(edge, other))
                rows += final
            above.append(edge)
        edges = above
    left, final = prefix_trie.settled(edges[0], True)
    rows += final
    named = {r[0]: r[2] for r in rows if r[0]}
    assert not left
    assert sorted(((r[2], r[3], named[r[1]] if r[1] else r[4], *r[5:]) for r in rows), key=str) == plain(conversations)


def test_a_tree_is_balanced_and_long_conversations_do_not_recurse():
    tree = prefix_trie.Tree()
    for i in prefix_trie.by_medians(1023):
        tree.insert([i], [1], i, 1, "x")
    deepest = {0: 0}
    for v in range(1, 1024):
        for link in (tree.low, tree.high):
            if link[v]:
                deepest[link[v]] = deepest.get(v, 0) + 1
    assert max(deepest.values()) <= 10
    edge, rows = prefix_trie.shard([([1] * 100_000, [2] * 100_000, 1, 3, "e")])
    _, final = prefix_trie.settled(edge, True)
    top = next(r for r in final if r[3] == 0)
    assert not rows and len(final) == 100_001 and top[8] == 100_000 * 2 * 2 and top[7] == 1


def test_turns_are_ordered_encoded_and_rebuilt(spark):
    rows = [
        (100, 2, "user", "b", 1), (100, 1, "user", "a", 1), (100, None, None, None, 1), (101, 1, "user", "x", 1), (101, 2, "assistant", None, 1),
        (101, 3, "user", "long " * 5000, 1), (102, 1, "", "", 1), (None, 1, "user", "lost", 1), (350, 1, "user", "a", 1), (101, 3, "user", "long " * 5000, 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int")
    found = prefix_trie.sequences(df)
    by_conv = {r["conv_id"]: [(t["id"], t["size"]) for t in r["turns"]] for r in found.collect()}
    sizes = {c: [s for _, s in turns] for c, turns in by_conv.items()}
    assert sizes == {100: [0, 1, 1], 101: [1, 0, 25_000, 25_000], 102: [0], 350: [1]}
    assert by_conv[102][0] == by_conv[100][0] and by_conv[350][0] == by_conv[100][1] and by_conv[101][2] == by_conv[101][3]
    made = {r["conv_id"]: [(t["id"], t["size"]) for t in r["turns"]] for r in prefix_trie.rebuilt(found).collect()}
    # ids are dealt anew by each run, so compare by sizes
    for c, turns in sizes.items():
        h = zlib.crc32(str(c).encode()) % 6
        assert [s for _, s in made[c]] == sizes.get(c - c % 100, [])[:h] + turns[h:]
    assert got(prefix_trie.trie(frame(spark, {}))) == []
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df.limit(0)))).count() == 0


def test_clashing_columns(spark):
    rows = [(c, t, "user", f"say {t}", b"", 5) for c in range(3) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest binary, id int").withColumn("seq", F.lit(1))
    out = prefix_trie.trie(prefix_trie.sequences(df)).collect()
    assert sorted((r["depth"], r["n_convs"], r["conv_id"]) for r in out) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0)]
