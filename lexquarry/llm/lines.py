"""Line dedup by a suffix array over line ids.

Lines are numbered by their place in the order of their hashes, and each document is a
sequence of line numbers.  Only stretches of lines that all occur more than
once, of ``min_words`` words or more, can hold a repeated run; their suffixes
are sorted by distributed prefix doubling: the rank of a suffix by its first
``2 * step`` lines is that of the pair (rank by ``step`` lines, rank ``step``
lines on), its place among all suffixes, found by sums over cells of ranks.  A
suffix that no other one equals keeps its rank and takes no further part.

Suffixes that agree in the shortest window of ``min_words`` words stand next to
each other in the array: a longest-common-prefix interval of so many words.
They are those with equal windows, and a window of m lines is named exactly by
the ranks of the two windows of the largest power of two, one from its start and one to its end.
In each interval the occurrence that comes first in the documents stays.

The same is done for the reversed sequences.  A line of a repeated run of
``min_words`` words or more lies in a shortest window within the run, one that
starts where the run does or at a line of it, or one that ends there; so the
lines of all windows that also occur earlier, held against all occurrences,
are those of all maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.plans.storage import drop_written, written

WORD = r"[^\x20\x09-\x0D]+"


def line_ids(text: Column) -> tuple[Column, Column]:
    """(name of every line, its words), lines ending at newlines; blanks, tabs and returns at a line's end alone don't count.

    A name is two hashes of 64 bits, so that different lines don't meet in one among very many.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    name = lambda line: F.struct(F.xxhash64(line).alias("r2"), F.xxhash64(F.lit(1), line).alias("also"))
    return (
        F.transform(lines, lambda line: name(F.rtrim(line, F.lit(" \t\r")))),
        F.transform(lines, lambda line: F.regexp_count(line, F.lit(WORD))),
    )


#: A group of equal ranks is put in order by at most so many cells at once.
CELLS = 1 << 12


def places(groups: DataFrame, cell: Column, by: tuple[str, ...] = ("r2",)) -> DataFrame:
    """(r1, r2, rank) of groups (r1, r2, n), or of groups told apart by ``by``: twice the rank of r1 plus how many of its suffixes come before, one more when the group is a single suffix.

    ``cell`` cuts each r1 into a bounded number of ranges of r2, so no task orders all suffixes of a common line.
    """
    groups = groups.withColumn("cell", cell)
    before = Window.partitionBy("r1").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = groups.groupBy("r1", "cell").agg(F.sum("n").alias("n")).select("r1", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("r1", "cell").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("place", F.coalesce(F.sum("n").over(within), F.lit(0)))
    rank = F.col("r1") + 2 * (F.col("start") + F.col("place")) + (F.col("n") == 1).cast("long")
    return ranked.join(cells, ["r1", "cell"]).select("r1", *by, rank.alias("rank"))


def doubled(values: Column, lines: Column, step: int) -> Column:
    """Sums of the windows of ``2 * step`` lines, from those of ``step`` lines."""
    kept = F.greatest(lines - 2 * step + 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), kept), F.slice(values, F.lit(1 + step), kept), lambda a, b: a + b)


def shortest_windows(words: DataFrame, min_words: int) -> DataFrame:
    """``words`` with ``ends``: for each line (to, sum), the end of the shortest window of ``min_words`` words from it and its words; to is 0 where there is none."""
    longest = words.agg(F.max(F.size("words"))).first()[0] or 0
    out, steps = words.withColumns({"n": F.size("words"), "s1": F.col("words")}), [1]
    while 2 * steps[-1] <= longest:  # a column for each doubling, within the row that holds the stretch
        step = steps[-1]
        out = out.withColumn(f"s{2 * step}", doubled(F.col(f"s{step}"), F.col("n"), step))
        steps.append(2 * step)
    out = out.withColumn("ends", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("to"), F.lit(0).alias("sum"))))
    for step in reversed(steps):  # lines are taken while the window stays short of the words

        def longer(x: Column) -> Column:
            total = x["sum"] + F.get(f"s{step}", x["to"])
            return F.when(total < min_words, F.struct((x["to"] + step).alias("to"), total.alias("sum"))).otherwise(x)

        out = out.withColumn("ends", F.when(F.col("n") >= step, F.transform("ends", longer)).otherwise(F.col("ends")))
    last = lambda x: x["sum"] + F.get("s1", x["to"])
    ends = F.transform("ends", lambda x: F.when(last(x) >= min_words, F.struct((x["to"] + 1).alias("to"), last(x).alias("sum"))).otherwise(F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum"))))
    return out.withColumn("ends", ends).drop("n", *[f"s{step}" for step in steps])


def stretches(lines: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """((row, doc_id, side, first, ranks, words), number of suffixes a side) of stretches of repeated lines; side 1 holds each reversed."""
    name = ("r2", "also")
    seen = lines.select(F.explode("names").alias("l")).groupBy("l.r2", "l.also").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("r1", F.lit(0).cast("long"))
    repeated = written(places(seen, F.shiftright("r2", 64 - 16), name).select(*name, "rank"), "line-numbers")
    each = lines.select("row", "doc_id", F.posexplode(F.arrays_zip("names", "words")).alias("pos", "l")).select("row", "doc_id", "pos", "l.names.r2", "l.names.also", F.col("l.words").alias("words"))
    found = each.join(repeated, list(name)).withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("row").orderBy("pos")))
    runs = found.groupBy("row", "doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "rank", "words"))).alias("l"), F.sum("words").alias("total"), F.min("pos").alias("first"))
    runs = written(runs.filter(F.col("total") >= min_words).select("row", "doc_id", "first", F.col("l.rank").alias("ranks"), F.col("l.words").alias("words")), "stretches")
    count = runs.agg(F.coalesce(F.sum(F.size("ranks")), F.lit(0))).first()[0]
    total = lines.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    back = F.transform(F.reverse("ranks"), lambda r: r + 2 * total)  # the reversed suffixes come after all others
    sides = F.array(F.struct(F.lit(0).alias("side"), "ranks", "words"), F.struct(F.lit(1).alias("side"), back.alias("ranks"), F.reverse("words").alias("words")))
    drop_written(repeated)
    return runs.select("row", "doc_id", "first", F.explode(sides).alias("s")).select("row", "doc_id", "first", "s.*"), 4 * total if count else 0


def repeated_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, start, end, words, m, a, b): shortest windows whose suffixes aren't alone; equal (m, a, b) is one interval of the suffix array."""
    runs, most = stretches(lines, min_words)
    state = written(shortest_windows(runs, min_words).drop("words"), "suffixes")
    key = ["row", "doc_id", "first", "side"]
    shift = max(0, most.bit_length() - CELLS.bit_length() + 1)
    step, found = 1, None
    while True:
        m, n = F.col("to") - F.col("pos"), F.size("ranks")
        here = state.select(*key, "ranks", n.alias("n"), F.posexplode("ends").alias("pos", "e")).select(*key, "ranks", "n", "pos", "e.to", F.col("e.sum").cast("long").alias("words"))
        here = here.filter((m >= step) & (m < 2 * step)).select(*key, "n", "pos", "to", "words", m.alias("m"), F.get("ranks", F.col("pos")).alias("a"), F.get("ranks", F.col("to") - step).alias("b"))
        here = written(here.filter("a % 2 = 0 and b % 2 = 0"), "windows")
        found = here if found is None else found.unionByName(here)
        open_ = lambda e, i: (e["to"] - i >= 2 * step) & (F.get("ranks", i) % 2 == 0)  # noqa: B023, E731
        if state.filter(F.size(F.filter("ends", open_)) > 0).isEmpty():
            break
        pairs = F.transform("ranks", lambda r, i: F.struct(r.alias("r1"), F.coalesce(F.get("ranks", i + step), F.lit(-1)).alias("r2"), F.get("ends", i).alias("e")))  # noqa: B023
        each = state.select(*key, F.posexplode(pairs).alias("pos", "p")).select(*key, "pos", "p.*")
        groups = each.filter("r1 % 2 = 0").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))
        ranks = written(places(groups, F.shiftright("r2", shift)), "ranks")  # written, so that AQE can split a hot pair's suffixes
        merged = each.join(ranks, ["r1", "r2"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("rank", "r1").alias("rank"), "e"))).alias("l"))
        last, state = state, written(merged.select(*key, F.col("l.rank").alias("ranks"), F.col("l.e").alias("ends")), "suffixes")
        drop_written(last, ranks)
        step *= 2
    ahead = F.col("side") == 0
    return found.select(
        "doc_id", (F.col("first") + F.when(ahead, F.col("pos")).otherwise(F.col("n") - F.col("to"))).alias("start"),
        (F.col("first") + F.when(ahead, F.col("to")).otherwise(F.col("n") - F.col("pos"))).alias("end"), "words", "m", "a", "b",
    )


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, words, source_id, source_start) of the shortest runs that are later copies.

    Lines count from 0 and ``end`` is exclusive.  Runs overlap: together they
    cover the lines of all longer ones.  The source is a run's first occurrence.  Null text
    is one empty line; rows that repeat an id are one document's lines and
    never copies of each other; null ids are left out; an empty table gives an
    empty result; other columns are ignored.
    """
    ids, words = line_ids(F.col("text"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    lines = written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", ids.alias("names"), words.alias("words")), "lines")
    windows = repeated_windows(lines, min_words)
    drop_written(lines)
    interval = ["m", "a", "b"]
    first = windows.groupBy(*interval).agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "intervals")
    return (
        windows.join(first, interval)
        .filter("doc_id <> source.doc_id or start > source.start")
        .select("doc_id", "start", "end", "words", F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start"))
        .distinct()
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers), text without them.

    A document whose lines all go keeps an empty text.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    lane = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    apart = runs.withColumn("apart", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("apart").over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    runs = apart.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = runs.select(F.col("doc_id").alias("_id"), F.explode(F.sequence("start", F.col("end") - 1)).alias("line"))
    gone = written(gone.groupBy("_id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    none = F.array().cast("array<int>")
    out = rows.join(gone, F.col("doc_id") == F.col("_id"), "left").withColumn("removed", F.coalesce("removed", none))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))  # by hashing, in order
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    out = out.withColumn("lines", lines)
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
        F.when(F.size("removed") > 0, kept).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table: removed lines and the digest of what stays."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2("text", 256).alias("text_sha256")
    )
