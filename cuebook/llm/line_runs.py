"""Removal of repeated line runs with a suffix array by prefix doubling. DataFrame functions only.

The lines of a text that are not blank form its sequence. Equal lines get one line id, their rank
among all lines that occur more than once; a line that occurs once ends every repeat and is left
out. Each doubling ranks the suffixes by twice as many lines: the rank of a pair of ranks, h lines
apart. Ranks come from a range partitioning of the distinct pairs, sorted inside the partitions,
so no task sees all suffixes; pairs that occur once are left out again.

Suffixes whose first ``min_lines`` lines are equal stand together in the suffix array: an interval
whose longest common prefix is at least ``min_lines``. Doubling ends at that depth, as deeper ranks
only divide intervals and change nothing about what is a copy. The smallest place of an
interval (by id, then line) stays, the others are later copies; their windows together are the
later copies of all maximal repeated runs, and those are deleted. A line of at least
``long_words`` words is a run by itself. With ``run_words``, so are fewer than ``min_lines`` lines that
have as many words together; ranks then grow by one line a round, so that each depth is seen.

Lines are compared as they are; blank lines are kept. Null and empty texts have one blank line. Rows
equal in id and text are one document, and all get its result; rows with a null id count as
smallest. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .graph import counted

MIN_LINES, LONG_WORDS, RUN_WORDS = 3, 30, 50


def _key(c: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def _document(id_col: Column, text: Column) -> Column:
    return _key(F.concat_ws("|", id_col.cast("string"), text))


def _ranked(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` whose ``keys`` occur more than once, with ``out``: the place of the keys in their sorted order."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("_cue_n")).filter("_cue_n > 1").drop("_cue_n")
    ranks = written(often.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(out, F.monotonically_increasing_id()), "ranks")
    return rows.join(ranks, keys)


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, i, line, key, words) for each line that is not blank: its place in the sequence and in the text."""
    text = text_of(docs[text_col])
    own = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumn("doc", _document(F.col("id"), F.col("text")))
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, n: F.struct(n.alias("line"), x.alias("s")))
    full = F.filter(numbered, lambda x: F.trim(F.regexp_replace(x["s"], r"[\t\r\f\x0B]", " ")) != "")
    rows = own.select("doc", "id", full.alias("a")).select("doc", "id", F.posexplode("a").alias("i", "x"))
    return rows.select("doc", "id", "i", F.col("x.line").alias("line"), _key(F.col("x.s")).alias("key"),
                       F.size(F.array_remove(F.split(F.col("x.s"), r"[ \t\r\f\x0B]+"), "")).alias("words"))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text",
                 run_words: int | None = None) -> DataFrame:
    """(doc, line) of every line to delete, once."""
    place = F.struct("id", "doc", "i")
    lines = _ranked(sequences(docs, id_col, text_col), ["key"], "r").drop("key")
    lines = written(lines.dropDuplicates(["doc", "i"]), "lines")

    def copies(rows: DataFrame, keys: list[str]) -> DataFrame:
        first = written(rows.groupBy(*keys).agg(F.min(place).alias("_cue_first")), "first")
        return rows.join(first, keys).filter(place != F.col("_cue_first"))

    gone = copies(lines.filter(F.col("words") >= long_words), ["r"]).select("doc", "line")

    def windows(suffixes: DataFrame, depth: int) -> DataFrame:
        return copies(suffixes, ["r"]).select("doc", F.explode(F.sequence("i", F.col("i") + (depth - 1))).alias("i"))

    # For run_words a suffix has the words of its first ``depth`` lines, and those of the last of them.
    sized = [F.col("words"), F.col("words").alias("last")] if run_words else []
    suffixes, depth, found = lines.select("doc", "id", "i", "r", *sized), 1, []
    while depth < min_lines:
        h = 1 if run_words else min(depth, min_lines - depth)  # the last round overlaps, and ends at min_lines exactly
        ahead = suffixes.select("doc", (F.col("i") - h).alias("i"), F.col("r").alias("r2"), *[F.col("last").alias("last2") for _ in sized[:1]])
        pairs = written(suffixes.join(ahead, ["doc", "i"]), "pairs")
        sums = [(F.col("words") + F.col("last2")).alias("words"), F.col("last2").alias("last")] if run_words else []
        suffixes = written(_ranked(pairs, ["r", "r2"], "rank").select("doc", "id", "i", F.col("rank").alias("r"), *sums), "suffixes")
        depth += h
        if run_words and depth < min_lines:
            found.append(windows(suffixes.filter(F.col("words") >= run_words), depth))
    found.append(windows(suffixes, min_lines))
    runs = reduce(DataFrame.unionAll, found).distinct().join(lines.select("doc", "i", "line"), ["doc", "i"]).select("doc", "line")
    return gone.unionAll(runs).distinct()


def delete_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text",
                run_words: int | None = None) -> DataFrame:
    """(id, n_lines, n_deleted, text): what is left of each text, its lines joined by line feeds."""
    copies = later_copies(docs, min_lines, long_words, id_col, text_col, run_words)
    # Deleted lines as sorted runs [a, b): numbers less their index in the sorted list are equal inside a run.
    listed = copies.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("l"))
    step = F.transform("l", lambda x, n: F.struct((x - n).alias("run"), x.alias("at")))
    runs = listed.select("doc", F.size("l").cast("long").alias("n_deleted"), F.explode(step).alias("s")) \
        .groupBy("doc", "n_deleted", "s.run").agg(F.min("s.at").alias("a"), (F.max("s.at") + 1).alias("b")) \
        .groupBy("doc", "n_deleted").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    runs = written(runs, "runs")
    text = text_of(docs[text_col])
    own = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumn("doc", _document(F.col("id"), F.col("text")))
    joined = own.join(counted(runs, 500_000), "doc", "left")
    lines, n = F.split("text", "\n"), F.size(F.split("text", "\n"))
    # What stays are the gaps before, between and after the runs.
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"]))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(n))
    gaps = F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return joined.select(F.col("id").alias(id_col), n.cast("long").alias("n_lines"), F.coalesce("n_deleted", F.lit(0).cast("long")).alias("n_deleted"),
                         F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("text"))
