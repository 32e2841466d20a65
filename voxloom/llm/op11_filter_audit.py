"""Filter interaction audit: what each filter removes, alone, before and after the others, for all their orders.

Whether a document fails a filter does not depend on the order, so each document is reduced to a mask of the filters that
it fails. Masks are counted by part once, and the figures of all orders and steps are sums over at most 32 masks a part.

Identical texts are found by partition refinement: documents are split by their lengths in code points, then by
the hashes of successive blocks, each `GROWTH` times as long as all before it; classes of one document are dropped after each
split. Only then are the whole texts of those that are left compared, and all but the least doc_id of equal texts are marked.

Filters and signatures need one reading of the texts each and move none; the texts move once, to be picked by class, and those of
classes of several again. Hot classes (one text in a third of all rows) are counted before the shuffle, and their rows are salted for the comparison.

Defined cases: a null text is an empty one and equal to it; a null source is the part ''; rows that repeat a doc_id are
documents each, and are no duplicates of one another; a row without a doc_id is no duplicate and makes no other row one; a document is good (toxic)
if any of its labels says so; labels without a doc_id are ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.shared import drop_written, written

#: Words below which filter A fails a text, and percentages: B of different words (below), C of capitals (above).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
#: Characters any of which fails filter D.
JUNK = "[#$%&*|]"
LETTERS = "ABCDE"
#: Code points of the first block, and how many times longer the text before a block's end is than before its beginning.
BLOCK, GROWTH = 256, 16
#: Rows of a class that are compared with one copy of its texts.
SALT = 512


def failures(text: Column, words: Column, min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS, junk: str = JUNK) -> Column:
    """Mask of the filters A (1), B (2), C (4) and D (8) that a text with these words fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < min_words, 100 * distinct < min_distinct * n, 100 * capitals > max_capitals * F.length(text), text.rlike(junk)]
    mask = F.lit(0)
    for k, test in enumerate(tests):
        mask = mask + F.when(test, 1 << k).otherwise(0)
    return mask


def block_hashes(text: Column) -> Column:
    """Hashes of a text's blocks, as many as its length needs; an empty text has none."""
    ends = [0, BLOCK]
    while ends[-1] < 2**31 - 1:  # no string is longer
        ends.append(min(ends[-1] * GROWTH, 2**31 - 1))
    return F.array_compact(F.array(*[F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, b - a))) for a, b in pairwise(ends)]))


def refined(signatures: DataFrame) -> DataFrame:
    """A table class, n of the classes with several members, from rows (length, blocks): split by length, then by one block's hash after the other, classes of one dropped each time.

    A class is named by a hash of its splits, as :func:`class_of` makes it.
    """
    rows, step = signatures.select(F.xxhash64("length").alias("class"), "blocks"), 0
    before = None
    while True:
        sizes = rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes.select("class"), "class", "left_semi"), "classes")
        if before is not None:
            drop_written(before)
        before = rows
        if not rows.where(F.size("blocks") > step).head(1):
            return rows.groupBy("class").agg(F.count("*").alias("n"))
        rows = rows.withColumn("class", F.when(F.size("blocks") > step, F.xxhash64("class", F.col("blocks")[step])).otherwise(F.col("class")))
        step += 1


def class_of(length: Column, blocks: Column) -> Column:
    """The class of a text after all splits."""
    return F.aggregate(blocks, F.xxhash64(length), lambda c, h: F.xxhash64(c, h))


def duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text not null, ...) whose text is identical to that of a smaller doc_id, with all columns."""
    text = F.col("text")
    rows = docs.where("doc_id is not null")
    signatures = written(rows.select(F.length(text).alias("length"), block_hashes(text).alias("blocks")), "signatures")
    classes = refined(signatures)
    named = rows.withColumn("class", class_of(F.length(text), block_hashes(text)))
    # the same plan at every size: classes grow with the documents, so they are never sent to all tasks
    left = written(named.join(classes.hint("merge"), "class"), "left")
    drop_written(signatures)
    # whole texts: a class holds one text, but for chance
    first = left.groupBy("class", "text").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    first = first.select("class", "text", "first", F.explode(F.expr(f"sequence(0L, n div {SALT})")).alias("salt"))
    salted = left.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id), n div {SALT} + 1)")).drop("n")
    return salted.join(first, ["class", "salt", "text"]).where("doc_id > first").select(*docs.columns)


def mask_counts(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of a mask."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    with_words = lambda df: df.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    mask = failures(F.col("text"), F.col("words"), **limits)
    all_ = with_words(rows).select("doc_id", "part", mask.alias("mask"), F.lit(1).alias("n"))
    # what is a duplicate moves from its mask to that with filter E
    again = with_words(duplicates(rows)).select("doc_id", "part", mask.alias("mask"))
    moved = again.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))).alias("m")).select("doc_id", "part", "m.mask", "m.n")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return all_.unionAll(moved).join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the five filters and step.

    Counts are of the part's documents: kept after this step, removed by it, redundant (failing its filter, but removed
    before), failing its filter only, good and toxic ones removed by it, and removed by its filter in all 120 orders.
    """
    cells = mask_counts(docs, labels, **limits).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    earlier = sum((F.when(F.expr(f"instr(substring(filter_order, 1, step - 1), '{c}') > 0"), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))
    own = F.expr("cast(shiftleft(1, locate(substring(filter_order, step, 1), 'ABCDE') - 1) as int)")
    rows = rows.withColumn("earlier", earlier).withColumn("own", own)
    total = lambda test, value: F.expr(f"aggregate(filter(cells, c -> {test}), 0L, (s, c) -> s + {value})")
    removed = "(c.mask & own) <> 0 and (c.mask & earlier) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("(c.mask & (own | earlier)) = 0", "c.n").alias("kept"), total(removed, "c.n").alias("removed"),
        total("(c.mask & own) <> 0 and (c.mask & earlier) <> 0", "c.n").alias("redundant"), total("c.mask = own", "c.n").alias("unique_fails"),
        total(removed, "c.good").alias("good_lost"), total(removed, "c.toxic").alias("toxic_lost"),
        # a document that fails b filters is removed by each of them in 120 / b orders
        total("(c.mask & own) <> 0", "c.n * (120 div bit_count(c.mask))").alias("shapley"),
    )


SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
        FROM w LEFT JOIN l USING (doc_id)),
    p AS (SELECT DISTINCT [a, b, c, d, e] AS o FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e)
        WHERE len(list_distinct([a, b, c, d, e])) = 5),
    steps AS (SELECT o, array_to_string([substr('ABCDE', CAST(x AS INTEGER), 1) FOR x IN o], '') AS filter_order, CAST(step AS INTEGER) AS step FROM p, range(1, 6) s(step)),
    g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
    x AS (SELECT part, filter_order, step, o[step] AS own, good, toxic, fails, n, fails[o[step]] AS hit,
        len([1 FOR y IN o[1:step - 1] IF fails[y]]) > 0 AS gone, len([1 FOR y IN fails IF y]) AS many FROM g, steps),
    r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
