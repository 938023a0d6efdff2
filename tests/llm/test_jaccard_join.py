"""The n-gram Jaccard join against all pairs."""
import collections
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from sessionlab.llm import jaccard_join as J  # noqa: E402

SCHEMA = "doc_id long, text string, n long, token long, set_key string, rep long"
WORDS = [f"w{i}" for i in range(2000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in rows], SCHEMA)


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def all_pairs(rows):
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k), i)) for k, (i, _) in enumerate(rows)), key=repr)


def edited(r, text, n):
    words = text.split(" ")
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.6:
            words[at] = r.choice(WORDS)
        elif kind < 0.8 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, r.choice(WORDS))
    return " ".join(words)


def collection(seed, groups, most):
    r, texts = random.Random(seed), []
    for _ in range(groups):
        base = " ".join(r.choices(WORDS, k=r.choice([4, 9, 12, 40, 90, 150])))
        texts += [edited(r, base, r.randint(0, 5)) for _ in range(r.randint(1, most))]
    passage = " ".join(r.choices(WORDS, k=60))
    texts += [passage + " " + " ".join(r.choices(WORDS, k=r.randint(3, 60))) for _ in range(40)]
    texts += r.choices(texts, k=30)
    r.shuffle(texts)
    return list(enumerate(texts))


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "Ä one two"), (906, "ä one two"), (None, "one two"), (None, None), (907, "w " * 30_000), (908, "W " * 20_000),
         (909, " ".join(WORDS)), (909, " ".join(WORDS[:1990])), (909, "other words stand here"), (None, " ".join(reversed(WORDS))), (None, " ".join(reversed(WORDS)))]


@pytest.mark.parametrize("seed, limit, rounds", [(1, 64, 3), (2, 4, 3), (3, 6, 1)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, limit, rounds):
    """Low limits send the groups through the long lists."""
    monkeypatch.setattr(J, "LIMIT", limit)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "FEW_PAIRS", 0 if seed == 2 else 100)
    rows = collection(seed, 12, 25) + (EDGES if seed < 3 else [])
    got = [tuple(r) for r in J.jaccard_components(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == all_pairs(rows)


def test_empty_table(spark):
    assert J.jaccard_components(table(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in J.jaccard_components(table(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_merge_skip_counts_like_a_counter():
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(0, 20))) for _ in range(r.randint(0, 8))]
        counts = collections.Counter(x for values in lists for x in values)
        for need in (1, 2, 3, 5):
            assert J.merge_skip(lists, need) == sorted((v, c) for v, c in counts.items() if c >= need)


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique((r.integers(0, 3000, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)) for _ in range(2))
        differing = sum(int(x).bit_count() for x in (J.parity(a) ^ J.parity(b)).view(np.uint64).tolist())
        assert differing <= len(np.setxor1d(a, b))


def test_heads_never_part_linked_sets():
    r = np.random.default_rng(6)
    like, parted = J.LIKENESS, 0
    for _ in range(400):
        base = np.unique(r.integers(-2 ** 62, 2 ** 62, r.integers(6, 300)))
        x, y = (np.unique(np.r_[base[r.random(len(base)) > r.random() * 0.2], r.integers(-2 ** 62, 2 ** 62, r.integers(0, 30))]) for _ in range(2))
        if min(len(x), len(y)) < like.least:
            continue
        least = -(-like.part * (len(x) + len(y)) // (like.part + like.whole))
        agree = J.heads_agree(len(x), len(y), least, J.sketch(x, like)[2], J.sketch(y, like)[2])
        linked = len(np.intersect1d(x, y)) >= least
        assert J.common(x, y) == len(np.intersect1d(x, y)) and (agree or not linked)
        parted += not agree
    assert parted > 100


def sets_and_docs(spark, rows):
    docs = table(spark, rows).select("doc_id", "text")
    made = J.materialize(J.sketches(docs, J.LIKENESS).withColumn("row", J.F.monotonically_increasing_id()), "sketches")
    return J.materialize(J.sets_of(made, J.classes_of(made.where("n > 0")), J.LIKENESS), "sets"), docs


def test_posts_meet_once(spark):
    """Lengths of lists are counted where the posts meet: there is no second exchange of all posts, nor a join with it."""
    posts, far = J.posted(*sets_and_docs(spark, collection(5, 6, 8)), J.LIKENESS)
    assert far is None and "Join" not in posts._jdf.queryExecution().optimizedPlan().toString()
    lists = collections.Counter(r.token for r in posts.collect())
    assert lists and min(lists.values()) > 1


def test_whole_sets_are_gathered_once(spark, monkeypatch):
    """Classes that enter whole are spread over their shingles once, copies beside each other wherever they were read."""
    monkeypatch.setattr(J, "LIMIT", 4)
    seen, plain_by_token = [], J.by_token

    def by_token(whole):
        seen.extend(r.id for r in whole.select("id").collect())
        return plain_by_token(whole)
    monkeypatch.setattr(J, "by_token", by_token)
    J.posted(*sets_and_docs(spark, collection(2, 12, 25)), J.LIKENESS)
    assert seen and len(seen) == len(set(seen))

    r = np.random.default_rng(8)
    groups = [np.unique(r.integers(-2 ** 62, 2 ** 62, 50)).tolist() for _ in range(40)]
    whole = spark.createDataFrame([(40 * k + g, groups[g]) for k in range(40) for g in range(40)], "id long, found array<long>").repartition(40, "id")
    rows = plain_by_token(J.beside_copies(whole)).count()
    assert rows <= 3 * 40 * 50 < plain_by_token(whole).count()


def test_shingles_of_whole_sets_are_no_rows_of_their_own(spark):
    """Sets without common shingles are as many rows as there are parts, and their counts are exact."""
    r = np.random.default_rng(9)
    sets = [np.unique(r.integers(-2 ** 62, 2 ** 62, 300)).tolist() for _ in range(300)]
    shared = sets[0][:20]
    whole = spark.createDataFrame([(k, sorted({*s, *shared})) for k, s in enumerate(sets)], "id long, found array<long>").repartition(4, "id")
    lists = J.by_token(whole)
    assert lists.count() <= 4 * J.BUCKETS
    assert {tuple(x) for x in J.frequent(lists, 5).collect()} == {(t, 300) for t in shared}
    made = whole.withColumns({"n": J.F.size("found").cast("long"), "batch": J.F.col("id") % 7})
    long = spark.createDataFrame([(t,) for t in [*shared[:9], *sets[5][30:60], 12345]], "token long")
    found = {x.id: x for x in J.apart(made, J.by_token(made), long, J.BUCKETS).collect()}
    known = {*shared[:9], *sets[5][30:60]}
    assert len(found) == 300
    for k, s in enumerate(sets):
        every = {*s, *shared}
        assert found[k].far == sorted(every & known) and found[k].near == sorted(every - known) and found[k].n == len(every)


@pytest.mark.parametrize("few", [500_000, 3])
def test_heads_stay_where_they_are(spark, monkeypatch, few):
    """Classes find their long lists without a join of their heads, unless the long lists are very many; the posts are the same."""
    monkeypatch.setattr(J, "LIMIT", 4)
    monkeypatch.setattr(J, "BROADCAST_NUMBERS", few)
    plans, plain = [], J.materialize

    def materialize(df, name="stage"):
        if name == "moved-on":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)
    args = sets_and_docs(spark, collection(2, 12, 25))
    monkeypatch.setattr(J, "materialize", materialize)
    posts, far = J.posted(*args, J.LIKENESS)
    assert plans and all(("Join Inner" in p) == (few == 3) for p in plans)
    lists = collections.Counter(r.token for r in posts.collect())
    assert lists and min(lists.values()) > 1 and far is not None


def test_halved_heads_never_part_linked_sets():
    """Numbers with equal upper halves stand on both sides of a head's end."""
    like = J.LIKENESS
    x = np.r_[np.arange(40) * 2 ** 32, 40 * 2 ** 32 + np.arange(200)].astype(np.int64)
    y = np.r_[x, 2 ** 61]
    least = -(-like.part * (len(x) + len(y)) // (like.part + like.whole))
    heads = [J.sketch(s, like)[2] >> 32 for s in (x[x != 40 * 2 ** 32 + 1], y)]
    for cut in range(41, 78):
        assert J.heads_agree(len(x) - 1, len(y), least, heads[0][:cut], heads[1])
    r = np.random.default_rng(11)
    for _ in range(300):
        base = np.unique(r.integers(0, 2 ** 34, 200))
        a, b = (np.unique(np.r_[base[r.random(len(base)) > r.random() * 0.15], r.integers(0, 2 ** 34, r.integers(0, 20))]) for _ in range(2))
        need = -(-like.part * (len(a) + len(b)) // (like.part + like.whole))
        if len(np.intersect1d(a, b)) >= need:
            assert J.heads_agree(len(a), len(b), need, *((J.sketch(s, like)[2] >> 32).astype(np.int32) for s in (a, b)))
