"""Repeated runs of lines, by prefix doubling over line ids; DataFrame functions only.

The documents are sequences of line ids (blank lines aside). Rank k orders the suffixes by their
first 2 ** k lines; ranks of 2 ** (k + 1) lines are the sorted pairs of two ranks k that lie
2 ** k lines apart. Only suffixes that share their first lines with another one stay in the
table: the others have no common prefix of that length with any suffix. Suffixes of equal rank
form an interval of that common prefix; its first member in document order is the first copy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.llm.common import Scratch, plainly, text_key, written

_WORD = r"[^\x20\x09-\x0D]+"
_PLACE = ("doc_id", "hash", "seq")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, hash (of the text), seq, pos, line (id), words.

    `pos` counts all lines of the text from 0, `seq` those with a word.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    full = F.filter(lines, lambda s: s["x"].rlike(_WORD))
    rows = docs.select("doc_id", "hash", F.posexplode(full).alias("seq", "s"))
    return rows.select("doc_id", "hash", "seq", "s.pos", F.unhex(F.md5("s.x")).alias("line"), F.regexp_count("s.x", F.lit(_WORD)).alias("words"))


def _later(rows: DataFrame, keys: list[str], ordered: bool, write: Scratch) -> DataFrame:
    """The rows whose `keys` occur again elsewhere, with `rank` and whether a copy stands before.

    `ordered`: ranks follow the order of the keys. They are fixed by writing them.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), *_PLACE)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")).filter("__n > 1").drop("__n")
    groups = groups.orderBy(*keys) if ordered else groups
    groups = write(groups.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.join(groups, keys).withColumn("later", place != F.col("__first")).drop("__first")


def _ahead(column: str, n: int) -> Column:
    """The value of `column` n lines further on in the same document; null if that line has none."""
    return F.max(column).over(Window.partitionBy("doc_id", "hash").orderBy("seq").rangeBetween(n, n))


def marked(docs: DataFrame, least_words: int, whole: bool, write: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The lines to delete (doc_id, hash, pos) and the longest later copy of each document.

    A line goes if it lies in a run that has occurred before (in the order of doc_id, text hash and line)
    and holds at least `least_words` words. A shortest such run around a line has no more than
    `least_words` lines, so runs of up to that many lines settle the deletions; a length between
    two powers of two is the pair of two overlapping ranks. With `whole` the doubling goes
    on until no run repeats; the longest copy is then given in lines, as a power of two.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("hash"), F.col("text").cast("string").alias("text"))
    lines = write(line_table(texts), "lines")
    # A row that occurs again has its lines again: such documents, few as a rule, count once.
    twice = lines.filter("seq = 0").groupBy("doc_id", "hash").count().filter("count > 1")
    if not twice.isEmpty():
        twice = write(twice.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h")), "twice")
        same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h"))
        once = lines.join(twice, same, "left_semi").dropDuplicates([*_PLACE])
        lines = write(lines.join(twice, same, "left_anti").unionByName(once), "once")
    again = write(lines.groupBy("line").count().filter("count > 1").select("line"), "again")
    # Written before it is grouped: a very frequent line's join partition can then be split.
    lines = write(lines.join(again, "line"), "repeated")
    base = write(_later(lines, ["line"], ordered=True, write=write).drop("line"), "active")
    gone = [base.filter(F.col("later") & (F.col("words") >= least_words)).select("doc_id", "hash", "pos")]
    lengths = [base.filter("later").select("doc_id", "hash", F.lit(1).alias("run"))]
    now, n = base, 1
    span = Window.partitionBy("doc_id", "hash").orderBy("seq")
    while n < least_words or whole:
        doubled = None
        for m in range(n + 1, 2 * n + 1):
            if m < 2 * n and m > least_words:
                continue
            rows = now.withColumn("__next", _ahead("rank", m - n))
            if m <= least_words:
                # Words and places of the run's lines; each of them repeats, so `base` has it.
                run = base.select("doc_id", "hash", "seq", F.sum("words").over(span.rangeBetween(0, m - 1)).alias("__words"), F.collect_set("pos").over(span.rangeBetween(0, m - 1)).alias("__lines"))
                run = run.dropDuplicates(["doc_id", "hash", "seq"])
            rows = rows.filter("__next is not null").select("doc_id", "hash", "seq", F.col("rank").alias("__a"), F.col("__next").alias("__b"))
            found = write(_later(rows, ["__a", "__b"], ordered=m == 2 * n, write=write).drop("__a", "__b"), "active")
            if m <= least_words:
                keys = [found["doc_id"].eqNullSafe(run["doc_id"]), found["hash"] == run["hash"], found["seq"] == run["seq"]]
                hit = found.filter("later").join(run, keys).filter(F.col("__words") >= least_words)
                gone.append(hit.select(found["doc_id"], found["hash"], F.explode("__lines").alias("pos")))
            doubled = found
        now, n = doubled, 2 * n
        if now.isEmpty():
            break
        lengths.append(now.filter("later").select("doc_id", "hash", F.lit(n).alias("run")))
    deleted = write(reduce(DataFrame.unionByName, gone).distinct(), "deleted")
    longest = reduce(DataFrame.unionByName, lengths).groupBy("doc_id", "hash").agg(F.max("run").alias("longest_copy")) if whole else None
    return deleted, longest


def deduplicated(docs: DataFrame, least_words: int = 5, whole: bool = True) -> DataFrame:
    """`docs` with the lines of later copies taken out of `text`, and n_lines, n_deleted, longest_copy.

    Lines end at \\n; blank lines stay. A text that loses all its lines becomes empty; null stays
    null. Rows of equal doc_id and text are one document here: none is a copy of the other. Columns
    named n_lines, n_deleted or longest_copy (only with `whole`) are replaced; any others may be there.
    """
    added = ["n_lines", "n_deleted", *(["longest_copy"] if whole else [])]
    docs, names = plainly(docs, ("doc_id", "text"), added)
    return _deduplicated(docs, least_words, whole).toDF(*names, *added)


def _deduplicated(docs: DataFrame, least_words: int, whole: bool) -> DataFrame:
    write = Scratch()
    deleted, longest = marked(docs, least_words, whole, write)
    by_doc = deleted.groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("__gone"))
    if longest is not None:
        by_doc = by_doc.join(longest.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h"), "longest_copy"), F.expr("doc_id <=> __d and hash = __h"), "full")
        by_doc = by_doc.select(F.coalesce("doc_id", "__d").alias("doc_id"), F.coalesce("hash", "__h").alias("hash"), "__gone", "longest_copy")
    by_doc = written(by_doc.withColumnsRenamed({"doc_id": "__id", "hash": "__hash", "longest_copy": "__longest"}), "by-doc")
    write.clear()
    out = docs.join(by_doc, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (text_key("text") == F.col("__hash")), "left")
    # Lines are split once, and the places that stay come from one hashed difference.
    split = F.array(F.struct(F.split("text", "\n").alias("x"), F.col("__gone").alias("gone")))
    places = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["x"]) - 1), s["gone"])
    kept = F.transform(split, lambda s: F.array_join(F.transform(places(s), lambda i: F.get(s["x"], i)), "\n"))[0]
    added = {"n_lines": F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n"))), "n_deleted": F.coalesce(F.size("__gone"), F.lit(0))}
    if whole:
        added["longest_copy"] = F.coalesce("__longest", F.lit(0))
    added["text"] = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return out.select(*[(added["text"].alias("text") if c == "text" else docs[c]) for c in docs.columns], *[v.alias(k) for k, v in added.items() if k != "text"])
