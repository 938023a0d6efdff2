"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names (capitalised words inside a sentence) become typed placeholders, punctuation and case go. Hashes
of every run of `WINDOW` template words of the documents are joined with those of the benchmark items, and likewise the
hashes of plain runs, of the words as they are without case. A document is contaminated by an item if the runs of either
kind that meet cover half of the item, or `LONG_RUN` words of it in one alignment. Template runs count where the names of
their alignment agree: each name of the item stands for one name of the document, as when a question is put again with
other numbers and names. Numbers may change slot by slot. Plain runs count where they meet the whole item or no alignment
of it disagrees.

Defined results: items of fewer than `WINDOW` words have no run and are never found, nor are template runs in which
placeholders outnumber words; null and empty texts are clean; rows that share id and text are judged alike; an empty
table on either side finds nothing; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize, small_side

WINDOW = 8
LONG_RUN = 13
COVER = 0.5

# What counts as a number, a unit after it, and a name.
UNITS = ("km|cm|mm|nm|kg|mg|lbs?|oz|kwh|kw|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|ml|miles?|meters?|metres?|feet|foot|inch(?:es)?|yards?|grams?|pounds?|ounces?|tons?|"
         "litres?|liters?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent|dollars?|euros?|cents?|m|g|l|s|h")
NUMBER = r"(?<![\p{L}\p{N}])[-+]?[$€£]?[0-9]+(?:[.,:/][0-9]+)*%?"
UNIT = rf"(?: ?(?i:{UNITS})(?![\p{{L}}\p{{N}}]))"
NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}[\p{L}'’-]*"
MARK = "\u0001"


def split_words(plain: Column) -> Column:
    """The words of a text of single blanks; none of an empty one. The text is named once, so that the patterns that make it run once."""
    return F.array_remove(F.split(plain, " "), "")


def template(text: Column) -> Column:
    """The text's template words. Only texts that can hold a placeholder go through the patterns."""
    named = F.regexp_replace(text, NAME, f" {MARK}name ")
    numbered = F.regexp_replace(F.regexp_replace(named, NUMBER + UNIT, f" {MARK}num {MARK}unit "), NUMBER, f" {MARK}num ")
    marked = F.when(named.rlike("[0-9]"), numbered).otherwise(named)
    return split_words(F.trim(F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}]+", " ")))


def plain_words(text: Column) -> Column:
    """The text's words without case and punctuation."""
    return split_words(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")))


def slot_values(text: Column) -> Column:
    """What stands in the slots `num` and `name`, in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"{NAME}|{NUMBER}{UNIT}?"), F.lit(0)), F.lower)


def is_slot(word: Column) -> Column:
    return word.isin(MARK + "num", MARK + "name")


def run_hashes(words: Column) -> Column:
    """Hash of every run of WINDOW (8) words: pairs of neighbours, of neighbouring pairs, and of those. Null past the last run."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = F.zip_with(h, F.slice(h, step + 1, F.size(words)), lambda a, b: F.xxhash64(a, b))
    return h


def runs(texts: DataFrame) -> DataFrame:
    """(key columns, pos, run) of `texts` (key columns, words): every full run."""
    keys = [c for c in texts.columns if c != "words"]
    hashed = texts.where(F.size("words") >= WINDOW).withColumn("n", F.size("words") - WINDOW + 1).withColumn("h", run_hashes(F.col("words")))
    return hashed.select(*keys, F.posexplode(F.slice("h", F.lit(1), F.col("n"))).alias("pos", "run"))


def item_runs(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, iplain, ipos, run, n_runs, slots: values in the run's slots) of template runs with enough plain words and of plain runs (iplain)."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    worded = items.withColumn("words", template(F.col("text"))).withColumn("values", slot_values(F.col("text"))).withColumn("item_key", F.xxhash64("text"))
    found = runs(worded.select("item_id", "item_key", "words"))
    back = worded.select(F.col("item_id").alias("i2"), F.col("item_key").alias("k2"), "words", "values")
    joined = found.join(back, (F.col("item_id") == F.col("i2")) & (F.col("item_key") == F.col("k2")))
    slots = slots_of(F.col("words"), F.col("values"), F.col("pos"))
    plain = F.size(F.filter(F.slice("words", F.col("pos") + 1, WINDOW), lambda w: ~w.startswith(MARK)))
    kept = joined.where(2 * plain >= WINDOW).select("item_id", "item_key", F.lit(False).alias("iplain"), F.col("pos").alias("ipos"), "run", slots.alias("islots"))
    literal = runs(items.select("item_id", F.xxhash64("text").alias("item_key"), plain_words(F.col("text")).alias("words"))).select(
        "item_id", "item_key", F.lit(True).alias("iplain"), F.col("pos").alias("ipos"), "run", F.array().cast("array<string>").alias("islots"))
    kept = kept.unionByName(literal)
    sizes = kept.groupBy("item_id", "item_key", "iplain").agg(F.count("*").alias("n_runs"))
    return _joined(kept, sizes, ["item_id", "item_key", "iplain"]).select("item_id", "item_key", "iplain", "ipos", "run", "islots", "n_runs")


def document_runs(own: DataFrame) -> DataFrame:
    """(doc_id, text_key, of_template, of_plain, pos, run) of every run. A text without slots has the same runs of both kinds."""
    worded = own.select("doc_id", "text_key", template(F.col("text")).alias("t"), plain_words(F.col("text")).alias("p"))

    def kind(words, of_template, of_plain):
        return F.struct(F.col(words).alias("words"), F.lit(of_template).alias("of_template"), F.lit(of_plain).alias("of_plain"))
    kinds = F.when(F.col("t") == F.col("p"), F.array(kind("t", True, True))).otherwise(F.array(kind("t", True, False), kind("p", False, True)))
    return runs(worded.select("doc_id", "text_key", F.explode(kinds).alias("k")).select("doc_id", "text_key", "k.of_template", "k.of_plain", "k.words"))


def slots_of(words: Column, values: Column, pos: Column) -> Column:
    before = F.size(F.filter(F.slice(words, F.lit(1), pos), is_slot))
    inside = F.size(F.filter(F.slice(words, pos + 1, F.lit(WINDOW)), is_slot))
    return F.slice(values, before + 1, inside)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id) of contaminated documents with n_covered (item runs met), n_runs and longest_run (words)."""
    items = small_side(item_runs(benchmark, item_col, item_text_col))
    own = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    both_kinds = document_runs(own).join(items, "run").where((F.col("iplain") & F.col("of_plain")) | (~F.col("iplain") & F.col("of_template")))
    shift = (F.col("pos") - F.col("ipos")).alias("shift")
    met = materialize(both_kinds.drop("of_template", "of_plain").distinct().select("*", shift), "runs-met")
    item = ["doc_id", "text_key", "item_id", "item_key"]

    slotted = met.where(~F.col("iplain") & (F.size("islots") > 0))
    wanted = small_side(slotted.select("doc_id", "text_key").distinct()).withColumnsRenamed({"doc_id": "d2", "text_key": "t2"})
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")), "left_semi").distinct()
    valued = texts.select("doc_id", "text_key", template(F.col("text")).alias("words"), slot_values(F.col("text")).alias("values"))
    both = _joined(slotted, valued, ["doc_id", "text_key"])
    pairs = both.select(*item, "shift", F.explode(F.arrays_zip("islots", slots_of(F.col("words"), F.col("values"), F.col("pos")).alias("dslots"))).alias("p")).select(
        *item, "shift", F.col("p.islots").alias("iv"), F.col("p.dslots").alias("dv")).where(F.col("iv").rlike(r"^\p{L}")).distinct()
    unlike = materialize(pairs.groupBy(*item, "shift").agg(F.count("*").alias("n"), F.countDistinct("iv").alias("ni")).where("n > ni").select(*item, "shift"), "unlike")

    agreed = _without(met.where(~F.col("iplain")), unlike, [*item, "shift"]).unionByName(met.where("iplain"))
    kind = [*item, "iplain"]
    aligned = agreed.groupBy(*kind, "shift").agg(F.count("*").alias("in_line"))
    longest = aligned.groupBy(*kind).agg((F.max("in_line") + WINDOW - 1).alias("longest_run"))
    cover = agreed.groupBy(*kind).agg(F.countDistinct("ipos").alias("n_covered"), F.first("n_runs").alias("n_runs"))
    found = _joined(cover, longest, kind).where((F.col("n_covered") >= COVER * F.col("n_runs")) | (F.col("longest_run") >= LONG_RUN))
    whole = F.col("iplain") & (F.col("n_covered") == F.col("n_runs"))
    part = _without(found.where(F.col("iplain") & ~whole), unlike.select(*item).distinct(), item)
    all_found = found.where(~F.col("iplain") | whole).unionByName(part)
    return all_found.groupBy(*item).agg(F.max_by("n_covered", F.col("n_covered") / F.col("n_runs")).alias("n_covered"), F.max_by("n_runs", F.col("n_covered") / F.col("n_runs")).alias("n_runs"),
                                        F.max("longest_run").alias("longest_run"))


def _without(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of `a` whose `cols`, which may be null, are not in `b`."""
    return a.join(b.withColumnsRenamed({c: f"{c}_2" for c in cols}), _same(cols), "left_anti")


def _same(cols: list[str]) -> Column:
    test = F.lit(True)
    for c in cols:
        test = test & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return test


def _joined(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Join on columns that may be null."""
    return a.join(b.withColumnsRenamed({c: f"{c}_2" for c in cols}), _same(cols)).drop(*(f"{c}_2" for c in cols))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ids, sorted), longest_run in words (0 where clean)."""
    found = matches(docs, benchmark, id_col, text_col)
    by = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("longest_run").alias("longest_run"))
    held = small_side(by).withColumnsRenamed({"doc_id": "doc_id_2", "text_key": "text_key_2"})
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    joined = own.join(held, _same(["doc_id", "text_key"]), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, columns unchanged, that no item contaminates."""
    bad = small_side(matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("bad_id")) & (F.xxhash64(text_col) == F.col("bad_key")), "left_anti")
