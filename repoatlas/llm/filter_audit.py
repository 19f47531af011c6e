"""How text filters act on each other: every order of the filters, from counts of failure masks.

A document is five bits, one per filter it fails. Documents with the same part and mask are
one cell with its counts. Each cell is folded over all orders of the filters, which gives one
weighted struct per order and step, and the arrays of a part's cells are added elementwise.
The documents are read once; what follows the masks does not grow with them.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import WORD
from repoatlas.sources.scratch import save_table

#: The filters by letter; the bit of a filter in a mask is its place here.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"

BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failure_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = {
        "A": n < LEAST_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * LEAST_DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * MOST_CAPITALS_PERCENT,
        "D": text.rlike(SYMBOLS),
    }
    return reduce(
        Column.bitwiseOR, [F.when(t, F.lit(BITS[k])).otherwise(F.lit(0)) for k, t in tests.items()]
    )


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest`` per document; a null text or part is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        failure_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic`` with the bit of filter E in the mask.

    Of the documents with one text, those with the smallest id pass filter E. Documents are
    first added up per text, part and id, then per text and part, so a text that a third of
    all documents hold travels as one row per task and part. ``masks`` is read twice: save it
    first.
    """
    labels = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    known = masks.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "mask", "digest").count()
    known = known.join(labels.filter("doc_id IS NOT NULL"), "doc_id", "left")
    n = F.col("count")
    weights = {
        "n": n, "good": n * F.coalesce("good", F.lit(0)), "toxic": n * F.coalesce("toxic", F.lit(0)),
    }
    known = known.select("doc_id", "part", "mask", "digest", *[c.alias(k) for k, c in weights.items()])
    by_text = known.groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("first_id"),
        *[F.sum(k).alias(k) for k in weights],
        *[F.min_by(k, "doc_id").alias(f"first_{k}") for k in weights],
    )
    first = by_text.groupBy("digest").agg(F.min("first_id").alias("least_id"))
    marked = by_text.join(first, "digest")
    is_first = F.col("first_id") == F.col("least_id")
    passing = {k: F.when(is_first, F.col(f"first_{k}")).otherwise(F.lit(0)) for k in weights}
    two = F.array(
        F.struct(F.col("mask").alias("mask"), *[c.alias(k) for k, c in passing.items()]),
        F.struct(
            F.col("mask").bitwiseOR(F.lit(BITS["E"])).alias("mask"),
            *[(F.col(k) - c).alias(k) for k, c in passing.items()],
        ),
    )
    nameless = masks.filter("doc_id IS NULL").groupBy("part", "mask").count().select(
        "part", "mask", F.col("count").alias("n"), F.lit(0).cast("long").alias("good"),
        F.lit(0).cast("long").alias("toxic"),
    )
    cells = marked.select("part", F.inline(two)).filter("n > 0").unionByName(nameless)
    return cells.groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in weights])


def constants(values: list) -> str:
    """SQL of an array of constants; Spark folds it to one literal, which goes out with the plan."""
    return f"array({', '.join(map(str, values))})"


def fold_orders() -> Column:
    """For a cell ``mask, n, good, toxic``: a struct of counts for each order and each of its steps."""
    orders = constants([constants([BITS[c] for c in order]) for order in ORDERS])
    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    mask, zero = F.col("mask"), F.lit(0).cast("long")

    def step(acc: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) > 0
        removed = acc["alive"] & fails
        of = lambda test, weight: F.when(test, F.col(weight)).otherwise(zero)
        counts = F.struct(
            of(acc["alive"] & ~fails, "n").alias("kept"), of(removed, "n").alias("removed"),
            of(fails & ~acc["alive"], "n").alias("redundant"), of(mask == bit, "n").alias("unique_fails"),
            of(removed, "good").alias("good_lost"), of(removed, "toxic").alias("toxic_lost"),
        )
        out = F.concat(acc["out"], F.array(counts)).cast(kind)
        return F.struct((acc["alive"] & ~fails).alias("alive"), out.alias("out"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("out"))
    return F.flatten(
        F.transform(F.expr(orders), lambda order: F.aggregate(order, start, step, lambda acc: acc["out"]))
    )


def add_folds(folds: Column) -> Column:
    """Elementwise sums of an array of arrays of counts, none of them empty."""
    add = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    rest = F.slice(folds, F.lit(2), F.size(folds))
    return F.aggregate(rest, folds[0], lambda acc, x: F.zip_with(acc, x, add))


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; the last adds the documents that the step's filter removes over
    all orders. A null text is empty, a null part is the empty part. Filter E compares texts
    over the whole table: every row whose text a row with a smaller id has fails it; rows of
    one id and text pass or fail together, and a row with a null id passes it, counts for no
    other and has no label. An id with several label rows is good or toxic if one of them
    says so. Parts are those of the documents: an empty table gives no rows. Other columns
    are ignored. A part has at most 32 cells, so its arrays are bounded.
    """
    masks = save_table(text_masks(docs, id_col, text_col, part_col))
    cells = mask_cells(masks, labels).select("part", fold_orders().alias("fold"))
    merged = cells.groupBy("part").agg(F.collect_list("fold").alias("folds"))
    merged = merged.select("part", add_folds(F.col("folds")).alias("sums"))
    letters = F.expr(constants([repr(c) for order in ORDERS for c in order]))
    zero = F.lit(0).cast("long")

    def share(letter: str) -> Column:
        removed = F.zip_with("sums", letters, lambda s, c: F.when(c == letter, s["removed"]).otherwise(zero))
        return F.aggregate(removed, zero, lambda acc, x: acc + x)

    shapley = F.create_map(*[x for letter in FILTERS for x in (F.lit(letter), share(letter))])
    rows = merged.select("part", shapley.alias("shares"), F.posexplode("sums").alias("at", "counts"))
    names = F.expr(constants([repr(order) for order in ORDERS]))
    return rows.select(
        "part", F.element_at(names, F.floor(F.col("at") / len(FILTERS)).cast("int") + 1).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
        *[F.col("counts")[c].alias(c) for c in COUNTS],
        F.col("shares")[F.element_at(letters, F.col("at") + 1)].alias("shapley"),
    )
