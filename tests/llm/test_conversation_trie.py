"""The trie and its contraction against plain versions."""
import collections
import hashlib
import os
import random
import sys
import zlib

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from sessionlab.llm import conversation_trie as T  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, pos long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain_trie(rows):
    """Rows without ties between different turns."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[:len(k)] == k]
        ends = sorted(c for c in members if len(made[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], sum(not kids[x] for x in below),
                    sum((len(nodes[x]) - 1) * len(x[-1][1].split()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def check(spark, rows):
    got = [tuple(r) for r in T.prefix_trie(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_random_conversations(spark):
    r, rows = random.Random(5), []
    for c in r.sample(range(130), 70):
        if c % 20 == 0 and r.random() < 0.3:
            continue    # families without their first conversation
        rows += [(c, t, r.choice(["user", None, "bot"]), r.choice(["a b", "a  b", "", None, "c d\te"])) for t in range(r.randint(1, 6))]
    rows += [(200, None, "u", "first"), (200, -4, "u", "second"), (200, 1 << 60, "u", "last"), (201, 3, "u", "x"), (202, 5, None, None), (None, 0, "u", "nobody")]
    rows += [(220, 1, "u", "same")] * 5 + [(221, 1, "u", "same")] * 5 + [(300, 0, "u", "word " * 30_000), (301, 0, "u", "word " * 30_000)]
    check(spark, rows)


def test_long_chain_many_equal_conversations_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "BLOCK_BITS", 3)
    monkeypatch.setattr(T, "CHUNK_BITS", 2)
    monkeypatch.setattr(T, "HOT", 3)
    rows = [(c, t, "u", f"t{t}") for c in (400, 407, 409) for t in range(70)] + [(c, t, "u", f"one {t}") for c in range(20 * 30, 20 * 33) for t in range(2)]
    rows += [(409, 70 + t, "u", "again") for t in range(12)] + [(1000, 1, "u", "same")] * 40
    check(spark, rows)
    assert T.prefix_trie(table(spark, rows).limit(0)).count() == 0
    assert T.prefix_trie(table(spark, [(None, 1, "u", "t")])).count() == 0


def test_tied_turns_keep_all_rows(spark):
    rows = [(1, 0, "u", f"t{i}") for i in range(30)] + [(1, 0, "u", "t3")] * 2 + [(1, 1, "u", "end")]
    got = T.turns(table(spark, rows), "conv_id", "turn", "role", "text").collect()
    assert sorted(r.pos for r in got) == list(range(33)) and len({r.d1 for r in got}) == 31
    hashes = [r.d1 for r in sorted(got, key=lambda r: r.pos)]
    assert hashes[:32] == sorted(hashes[:32])


def test_contraction_equals_walking(spark):
    r = random.Random(9)
    parent = {0: None}
    for v in range(1, 400):   # bushes, chains and a second tree
        parent[v] = None if v == 350 else v - 1 if r.random() < 0.7 else r.randrange(v)
    depth = {v: 0 if p is None else None for v, p in parent.items()}
    for v in range(400):
        depth[v] = 0 if parent[v] is None else depth[parent[v]] + 1
    kids = collections.Counter(parent.values())
    want = {v: [1, v] for v in parent}
    for v in range(399, 0, -1):
        if parent[v] is not None:
            want[parent[v]] = [x + y for x, y in zip(want[parent[v]], want[v])]
    tree = spark.createDataFrame([(v, p, depth[v], kids[v], 1, v) for v, p in parent.items()], "node long, parent long, depth long, n_children long, one long, number long")
    got = {x.node: [x.one, x.number] for x in T.subtree_sums(tree, ["one", "number"]).collect()}
    assert got == want
    assert T.subtree_sums(tree.limit(0), ["one"]).count() == 0


def test_list_hash_of_many_numbers(spark):
    df = spark.range(-700, 3000).select(F.struct(F.lit(1).cast("long").alias("a"), F.pmod("id", F.lit(2)).alias("b")).alias("node"), F.col("id").alias("conv"))
    got = {r.node.b: r.digest for r in T.list_hashes(df).collect()}
    assert got == {b: hashlib.sha256(",".join(str(i) for i in range(-700, 3000) if i % 2 == b).encode()).hexdigest() for b in (0, 1)}
