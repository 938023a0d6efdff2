"""Fill-in-the-middle against a plain version, and its containers against lists."""
import hashlib
import os
import random
import re
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from sessionlab.llm import fill_middle as M  # noqa: E402

SCHEMA = "doc_id long, text string, n long, form string, output string"


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(a), len(a + b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(a + b), f"<P>{a}<S>{c}<M>{b}"


def random_text(r, n):
    return "".join(r.choices(["a", "Z", "é", "7", " ", "\n", "<", "P", ">", "S", "M", "😀", "word", "\u0000"], k=n))


def test_every_row_equals_the_plain_version_and_is_restored(spark):
    r = random.Random(1)
    rows = [(i, random_text(r, r.randint(0, 60))) for i in range(500)]
    rows += [(None, "one two"), (None, None), (501, None), (502, ""), (503, " \n\t"), (504, "a <M> b"), (505, "x" * 200_000), (506, "1 " * 90_000),
             (507, random_text(r, 200_000)), (508, "same"), (508, "same"), (-3, "minus three")]
    df = spark.createDataFrame([(i, t, 5, "f", "o") for i, t in rows], SCHEMA)
    got = M.fill_in_middle(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((g.doc_id, g.n, g.form, g.cut1, g.cut2, g.output) for g in got), key=key) == sorted(((i, *plain_version(i, t)) for i, t in rows), key=key)
    assert sorted(g.back for g in got) == sorted(t or "" for _, t in rows)
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_containers_select_the_kth_offset():
    r = np.random.default_rng(2)
    cases = {M.ArrayContainer: [np.array([0]), np.arange(0, 8000, 2), np.array([65535])],
             M.RunContainer: [np.arange(65536), np.concatenate([np.arange(10, 5000), np.arange(6000, 65536)])],
             M.BitmapContainer: [np.flatnonzero(r.random(65536) < 0.5), np.arange(1, 65536, 2)]}
    for kind, sets in cases.items():
        for offsets in sets:
            c = M.container(offsets)
            assert type(c) is kind and [c.select(k) for k in range(len(offsets))] == offsets.tolist()


def test_boundaries_over_many_containers():
    r = random.Random(4)
    text = random_text(r, 150_000) + "y" * 140_000 + "." * 70_000 + "z"
    ends = [0]
    for unit in re.findall("[A-Za-z]+|[^A-Za-z]", text):
        ends.append(ends[-1] + len(unit))
    marks = M.Boundaries(text)
    assert len(marks) == len(ends) - 1 and {type(p).__name__ for p in marks.parts} >= {"BitmapContainer", "RunContainer"}
    assert [marks.select(k) for k in range(0, len(ends), 37)] == ends[::37] and marks.select(len(marks)) == len(text)
