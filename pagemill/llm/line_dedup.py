"""Line deduplication by a suffix array over sequences of line ids; DataFrame operations only.

A document is its sequence of lines that hold a word. A run of consecutive lines with at least ``min_words`` words in
all that occurred before (in a document with a smaller id, or earlier in the same one) is a later copy, and every line in
some later copy is deleted. Runs do not reach across documents; shorter repeats, such as one common line, stay.

The steps:

1. Lines are identified by digests; those that occur once end every repeated run, so only stretches of repeated lines go on.
2. Prefix doubling: the rank of a suffix by its first 2^(k+1) lines is that by 2^k lines, followed by the sorted place of its pair of
   ranks by 2^k lines, here and 2^k lines on; a suffix that ends there comes first. A suffix that no other equals in 2^k lines, or
   that has ended, keeps its rank, and a stretch without other suffixes leaves the rounds. They go on until no two suffixes agree in
   2^k lines any more without having ended, so the last ranks, and the order of documents among equal suffixes, are the suffix array.
3. Longest common prefixes of neighbours in the array. If the lines before two neighbours are equal, their prefix is that of the suffixes
   one line before, less one line (the permuted form of the array), so it is worked out only where they differ: ranks tell the largest
   power of two of equal lines, and as many lines after them are compared; these prefixes sum up to n log n lines at most. The others
   follow by a window within the stretch.
4. The suffixes that agree in their first n lines are an interval of the array: it begins where a neighbour's prefix is shorter
   than n. The depths n looked at for a suffix are those of the runs that have enough words, and would not without their first line or
   have not without their last: every maximal repeated run of enough words is a union of such runs, and every suffix of an interval has the same.
   In an interval with several suffixes all but the first in order of (id, place) are later copies.

Counting and naming are aggregations with partial sums; joins are on written tables, so AQE can split a hot line. What follows the order of
the array goes by its range partitions, each with the last of those before it (a row a partition). Other windows are within a document.

Defined results: a null text stays null and an empty one empty; a document all of whose lines are later copies becomes empty;
rows equal in id and text are one document and get the same result; null ids come first in the order; an empty table gives no rows;
a very long text is one stretch or more, and sorted as such; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, free_name

MIN_WORDS = 50
#: A word of a line: no regular expression of a language, so that other engines agree.
WORD = r"[^ \t\r\f\x0B]+"
BLANKS = " \t\r\f\x0B"
#: Bytes that a round adds to a rank.
PLACE = 8
DOC = ["_a", "_b"]
#: Numbers of lines to delete are broadcast up to this size in all; beyond it texts meet them by a shuffle.
BROADCAST_BYTES = 8 << 20


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a document by its id and text."""
    return [F.xxhash64(f"`{id_col}`", f"`{text_col}`"), F.xxhash64(f"`{text_col}`", F.lit(1), f"`{id_col}`")]


def _ranked(keys: DataFrame, columns: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Distinct keys with their places in sorted order (increasing numbers, not gapless; the upper bits are the partition's)."""
    return scratch.save(keys.orderBy(*columns).withColumn(name, F.monotonically_increasing_id()))


def _words(line: Column) -> Column:
    """The number of words in a line that has one; only lines with other white space than single spaces are split."""
    trimmed = F.trim(line)
    odd = trimmed.contains("  ")
    for blank in BLANKS[1:]:
        odd |= trimmed.contains(blank)
    spaces = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(F.btrim(line, F.lit(BLANKS)), f"[{BLANKS}]+"))).otherwise(spaces + 1)


def _bytes(place: str | Column) -> Column:
    """A place as bytes that sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(place), 2 * PLACE, "0"))


def _part(at: str) -> Column:
    return F.shiftright(at, 33)


def _stretch(*order: str) -> Window:
    return Window.partitionBy(*DOC, "_seg").orderBy(*order) if order else Window.partitionBy(*DOC, "_seg")



def repeated_stretches(docs: DataFrame, id_col: str, text_col: str, min_words: int, scratch: Scratch) -> DataFrame:
    """The lines that occur more than once, with the stretches they form: _seg, its last line _to, and _end of the shortest run of enough words from each line.

    _left is the line before within the stretch, and _after the next line's _end.
    """
    line = F.filter(F.transform(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: s["line"].rlike(WORD))
    # keys before the lines, or they would be worked out for each
    keyed = docs.select(F.col(f"`{id_col}`").alias("_id"), *(v.alias(k) for k, v in zip(DOC, _keys(id_col, text_col))), line.alias("_lines"))
    lines = scratch.save(
        keyed.select("_id", *DOC, F.posexplode("_lines").alias("p", "_s"))
        .select("_id", *DOC, "p", "_s.i", _words(F.col("_s.line")).alias("words"), F.unhex(F.md5("_s.line")).alias("_line"))
    )
    repeated = lines.groupBy("_line").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_line")
    ranks = _ranked(repeated, ["_line"], "r0", scratch)
    # dealt out by document once, for what follows
    table = lines.join(ranks, "_line").drop("_line").repartition(*DOC).dropDuplicates([*DOC, "p"])
    table = table.withColumn("_seg", F.col("p") - F.row_number().over(Window.partitionBy(*DOC).orderBy("p")))
    table = table.withColumns({"_c1": F.sum("words").over(_stretch("p")), "_left": F.lag("r0").over(_stretch("p"))}).withColumn("_c0", F.col("_c1") - F.col("words"))
    table = table.withColumns({"_back": -F.col("_c0"), "_all": F.max("_c1").over(_stretch()), "_to": F.max("p").over(_stretch())})
    behind = F.min("p").over(_stretch("_back").rangeBetween(Window.unboundedPreceding, -min_words))
    table = table.withColumn("_end", F.coalesce(behind - 1, F.when(F.col("_all") - F.col("_c0") >= min_words, F.col("_to"))))
    table = table.withColumn("_after", F.lead("_end").over(_stretch("p")))
    table = scratch.save(table.where(F.col("_all") >= min_words).select("_id", *DOC, "_seg", "p", "i", "r0", "_left", "_to", "_end", "_after"))
    scratch.drop(lines, ranks)
    return table


def doubled(table: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``table`` with _rank, the places of 1, 2, 4, ... lines one behind the other until they tell all different suffixes apart, and how many places it has at most."""
    columns = [c for c in table.columns if c not in ("i", "r0")]
    step = table.select(*columns, _bytes("r0").alias("_rank"), F.lit(True).alias("_open"))
    done, k = [], 0
    while True:
        there = F.coalesce(F.lead("_rank", 1 << k).over(_stretch("p")), F.lit(b""))
        step = scratch.save(step.withColumns({"_there": there, "_live": F.max("_open").over(_stretch())}))
        done.append(step.where("not _live").select(*columns, "_rank"))
        pairs = step.where("_open").groupBy("_rank", "_there").agg(F.count(F.lit(1)).alias("_n"))
        ranked = pairs.orderBy("_rank", "_there").withColumn("_next", F.concat("_rank", _bytes(F.monotonically_increasing_id())))
        ranked = scratch.save(ranked.select("_rank", "_there", "_next", ((F.col("_n") > 1) & (F.octet_length("_there") > 0)).alias("_more")))
        k += 1
        found = step.where("_open").drop("_open").join(ranked, ["_rank", "_there"])
        found = found.select(*columns, F.col("_next").alias("_rank"), F.col("_more").alias("_open"))
        step = found.unionByName(step.where("_live and not _open").select(*columns, "_rank", "_open"))
        if ranked.where("_more").isEmpty():
            for part in done:
                step = step.drop("_open").unionByName(part)
            return step, k + 1


def suffix_array(ranked: DataFrame, places: int, scratch: Scratch) -> DataFrame:
    """The suffixes with their places in the array (_at, increasing) and lcp, the lines that each has in common with the one before."""
    ordered = scratch.save(ranked.orderBy("_rank", "_id", *DOC, "p").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", _part("_at")))
    row = F.struct(*DOC, "_seg", "p", "_left", "_rank")
    ends = ordered.groupBy("_part").agg(F.max_by(row, "_at").alias("_last"))
    carried = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))  # a row a partition
    own = F.lag(row).over(Window.partitionBy("_part").orderBy("_at"))
    found = ordered.join(F.broadcast(carried), "_part").withColumn("_q", F.coalesce(own, "_carried"))
    # the largest k with 2^k lines in common, -1 without one
    first = lambda c, k: F.substring(c, 1, PLACE * (k + 1))
    level = F.coalesce(*(F.when(first("_rank", k) == first("_q._rank", k), k) for k in range(places - 1, -1, -1)), F.lit(-1))
    whole = F.col("_to") - F.col("p") + 1
    known = F.when(F.col("_q").isNull(), F.lit(0)).when(F.col("_rank") == F.col("_q._rank"), whole)
    kept = ["_id", *DOC, "_seg", "p", "_to", "_end", "_after", "_at"]
    found = scratch.save(found.withColumn("_k", level).select(
        *kept, "_k", *(F.col(f"_q.{c}").alias(f"_q{c}") for c in (*DOC, "_seg", "p")),
        F.when(F.col("_k") < 0, 0).when(known.isNotNull(), known).when(F.col("_left").eqNullSafe(F.col("_q._left")) & F.col("_left").isNotNull(), None)
        .otherwise(-1).alias("_known"),
    ))
    # where the lines before differ: 2^k lines, then as many more as are equal of the next 2^k
    numbered = F.array_sort(F.collect_list(F.struct("p", first("_rank", 0).alias("line"))))
    stretches = scratch.save(ordered.groupBy(*DOC, "_seg").agg(F.min("p").alias("_from"), F.transform(numbered, lambda x: x["line"]).alias("_lines")))
    scratch.drop(ordered)
    there = stretches.toDF(*(f"_q{c}" for c in stretches.columns))
    size = F.expr("shiftleft(1, _k)")
    following = lambda p, start, lines: F.slice(lines, F.col(p) - F.col(start) + 1 + size, size)
    open_ = found.where("_known = -1").join(stretches, [*DOC, "_seg"]).withColumn("_here", following("p", "_from", "_lines")).drop("_from", "_lines")
    open_ = open_.join(there, [f"_q{c}" for c in (*DOC, "_seg")]).withColumn("_there", following("_qp", "_q_from", "_q_lines"))
    differs = F.array_position(F.zip_with("_here", "_there", lambda x, y: ~x.eqNullSafe(y)), True)
    found = found.where("_known is null or _known <> -1").select(*kept, "_known").unionByName(open_.select(*kept, (size + differs - 1).cast("int").alias("_known")))
    given = F.last(F.when(F.col("_known").isNotNull(), F.struct("p", "_known")), ignorenulls=True).over(_stretch("p"))
    found = found.withColumn("_given", given)
    return found.select("_id", *DOC, "p", "_to", "_end", "_after", "_at", (F.col("_given._known") - F.col("p") + F.col("_given.p")).alias("lcp"))


def later_copies(array: DataFrame, scratch: Scratch) -> DataFrame:
    """(document, first line, number of lines) of the runs that are later copies, by the intervals of the array."""
    # the shortest run of enough words from here, and those that end further on and have not enough without this line
    furthest = F.greatest(F.col("_end"), F.coalesce(F.col("_after") - 1, F.col("_to")))
    depths = F.sequence(F.col("_end") - F.col("p") + 1, furthest - F.col("p") + 1)
    runs = array.where("_end is not null").select("_id", *DOC, "p", "_at", "lcp", F.explode(depths).alias("n"))
    runs = scratch.save(runs.orderBy("n", "_at").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", _part("_row")))
    begins = F.when(F.col("lcp") < F.col("n"), F.col("_row"))
    ends = runs.groupBy("_part").agg(F.max(begins).alias("_last"))
    carried = ends.select("_part", F.max("_last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row a partition
    own = F.max(begins).over(Window.partitionBy("_part").orderBy("_row"))
    named = scratch.save(runs.join(F.broadcast(carried), "_part").select("_id", *DOC, "p", "n", F.coalesce(own, "_carried").alias("_interval")))
    scratch.drop(runs)
    firsts = scratch.save(named.groupBy("_interval").agg(F.min(F.struct("_id", *DOC, "p")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    later = named.join(firsts, "_interval").where(F.struct(*DOC, "p") != F.struct(*(f"_first.{c}" for c in (*DOC, "p"))))
    return later.groupBy(*DOC, "p").agg(F.max("n").alias("n"))


def removed_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, scratch: Scratch) -> DataFrame:
    """(document key, the numbers of its lines to delete) for the documents that lose lines."""
    table = repeated_stretches(docs, id_col, text_col, min_words, scratch)
    later = later_copies(suffix_array(*doubled(table, scratch), scratch), scratch)
    places = later.select(*DOC, F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p")).distinct()
    gone = scratch.save(places.join(table.select(*DOC, "p", "i"), [*DOC, "p"]).groupBy(*DOC).agg(F.collect_set("i").alias("_gone")))
    scratch.drop(table)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` with later copies of runs of lines deleted from the text; ``removed`` names a column for their number."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone = removed_lines(docs, id_col, text_col, min_words, scratch)
    weight = gone.agg(F.sum(F.size("_gone") * 4 + 64)).first()[0] or 0
    # the texts need not be sorted, and where the table is small they need not move
    gone = F.broadcast(gone) if weight <= BROADCAST_BYTES else gone.hint("shuffle_hash")
    names = [free_name(c, docs.columns) for c in (*DOC, "_gone")]
    gone = gone.toDF(*names)
    numbers = F.col(names[2])
    rest = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(numbers, i)), "\n")
    columns = [F.when(numbers.isNull(), F.col(f"`{c}`")).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(removed))
    keyed = docs.withColumns(dict(zip(names, _keys(id_col, text_col))))
    return keyed.join(gone, names[:2], "left").select(*columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")), removed="n_removed")


OP2_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), numbered AS (
  SELECT *, len(regexp_extract_all(line, '[^ \t\r\f\x0B]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM raw WHERE regexp_matches(line, '[^ \t\r\f\x0B]')
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS c1 FROM numbered
), runs AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c1 - a.c1 + a.w >= {MIN_WORDS} GROUP BY a.doc_id, a.p
  UNION
  SELECT b.doc_id, max(a.p) AS s, b.p AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c1 - a.c1 + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.p
), texts AS (
  SELECT r.doc_id, r.s, r.e, string_agg(c.line, chr(10) ORDER BY c.p) AS t
  FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.p BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS place FROM texts
), gone AS (
  SELECT DISTINCT c.doc_id, c.i FROM ordered o JOIN c ON c.doc_id = o.doc_id AND c.p BETWEEN o.s AND o.e WHERE o.place > 1
), rest AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (g.i IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.i = r.i GROUP BY r.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id
"""
