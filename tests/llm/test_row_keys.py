"""Rows without an id, with a repeated one, repeated rows and clashing columns through the pipeline and its stages; number lists."""
import collections
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from sessionlab.llm import block_mixing, golay_simhash, pseudonyms  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 long, root string, size string, taken string, _replaced string, fp int"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "lmnrst"]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "r", "z", "t", "x", 2) for i, t, s in rows], SCHEMA)


def texts(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


ROWS = [(i, prose(90, i), "ab"[i % 2]) for i in range(30)] + [(None, prose(90, 100 + i), "a") for i in range(6)] + [(77, prose(90, 200 + i), "b") for i in range(4)]
COPIES = [(900, prose(90, 3), "a"), (77, prose(90, 5), "b"), (None, prose(90, 7), "a"), (8, prose(90, 8), "a"), (901, prose(90, 100), "a")]


def test_one_of_each_group_of_rows(spark):
    got = texts(golay_simhash.one_of_similar(docs(spark, ROWS + COPIES)).collect())
    want = collections.Counter((i, t) for i, t, _ in ROWS)
    want[(None, prose(90, 7))] += 1      # rows without an id stay, copies or not; 901 leads the group of such a row
    want[(901, prose(90, 100))] += 1
    assert got == want
    assert texts(golay_simhash.one_of_each(docs(spark, ROWS + COPIES)).collect()) == want


def test_mixing_returns_each_row_once(spark):
    rows = ROWS + [(5, prose(90, 5), "b")] * 3 + [(None, prose(40, 1), None)] * 5 + [(None, None, "a"), (None, "", "a")]
    mixed = block_mixing.mixed_documents(docs(spark, rows)).collect()
    taken = block_mixing.Mix(docs(spark, rows)).taken().collect()
    assert collections.Counter((r.doc_id, r.size, r.taken, r.source) for r in mixed) == collections.Counter((r.doc_id, r["size"], r.taken, r.source) for r in taken if r.taken > 0)
    assert all(r.t1 == 1 and r.root == "r" and r["size"] == len(r.text.split()) for r in mixed) and len(taken) == len(rows)


def test_equal_ids_are_dealt_over_all_buckets(spark):
    """A third of the rows without an id and as many of one id: buckets stay even, and so does the work."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i % 1500} " + "word " * 400, "s") for i in range(3000)]
    mix = block_mixing.Mix(docs(spark, rows))
    sizes = [r["n"] for r in mix.placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * len(rows) / len(sizes)


def run(spark, tmp_path, rows):
    folder = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, folder)


def test_pipeline_keeps_its_rows(spark, tmp_path):
    got = run(spark, tmp_path, ROWS + COPIES + [(950, None, "a"), (951, "", "b")])
    found = texts(got.collect())
    assert max(found.values()) <= 2 and not set(found) - {(i, t) for i, t, _ in ROWS + COPIES}
    assert found[(None, prose(90, 7))] <= 2 and not {900, 950, 951} & {i for i, _ in found}
    assert {"t1", "root", "_replaced", "fp", "taken", "target"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    first = got.first()
    assert first._replaced == "x" and first.t1 == 1 and first.taken > 0
    stages, d = dict(corpus_pipeline.STAGES), docs(spark, ROWS + COPIES)
    for name in ("quality_rules", "decontamination", "private_data"):
        assert texts(stages[name](spark, d, str(tmp_path)).collect()) == collections.Counter((i, t) for i, t, _ in ROWS + COPIES), name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0


def test_lists_of_numbers_are_left_alone(spark):
    r = random.Random(1)
    rows = [(i, " ".join(str(r.randrange(10 ** r.randint(1, 6))) for _ in range(20)), "s") for i in range(1000)]
    rows += [(2000, "3400 5600 7800 9100 and 0810992847249404", "s"), (2001, " ".join(str(r.randrange(1000, 10000)) for _ in range(2000)), "s")]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005", "30569309025904", "3056 930902 5904", "6011000990139424", "4222222222222", "2223003122003222"]
    rows += [(3000 + i, f"Pay {c} now", "s") for i, c in enumerate(cards)]
    got = {x.doc_id: x for x in pseudonyms.pseudonymise(docs(spark, rows), "k").collect()}
    assert sum(got[i].n_replaced > 0 for i in range(1000)) <= 20 and got[2000].n_replaced == 0
    assert all(got[3000 + i].n_replaced == 1 for i in range(len(cards)))


def test_deep_pages_take_linear_time():
    from sessionlab.llm import mincut_extract
    page = "<div>word " * 50_000
    assert mincut_extract.main_text(page) in ("", "\n".join(["word"] * 50_000))
    found = mincut_extract.blocks_of("<div>a<div>b<p>c</p></div></div><h2>d</h2>")
    assert [b.spot.depth for b in found] == [1, 2, 3, 1] and [b.heading for b in found] == [False, False, False, True]
    assert [mincut_extract.distance(found[0].spot, b.spot, 99) for b in found] == [0, 1, 2, 2] and mincut_extract.distance(found[2].spot, found[3].spot, 3) == 3
