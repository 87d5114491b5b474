"""Fingerprints of documents by closed syncmers, as Column expressions.

The letters are words (long ones in pieces). A k-mer of LETTERS_K letters is an anchor when the least of its inner substrings of
LETTERS_S letters, by hash, is its first or its last. Whether a k-mer is an anchor depends on its own letters alone, so text that
two documents share has the same anchors in both, wherever it stands; only k-mers across an edit differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.functions.entities import let
from leadloom.llm.common import saved, text_of

#: Letters of a k-mer and of its inner substrings.
LETTERS_K, LETTERS_S = 5, 2
#: A word, or sixteen characters of a longer one.
LETTER = r"[^\x20\x09-\x0D]{1,16}"
#: An anchor is one integer: place of its first letter above, 32 bits of its hash below.
HASH_BITS = 32
MASK = (1 << HASH_BITS) - 1
#: Quantiles of the ids, and rows in a bucket of neighbouring ids.
CELLS, BUCKET_ROWS = 256, 4096


def _from(array: Column, n: int) -> Column:
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array) - n, F.lit(0)))


def _hash32(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MASK))


def anchors(text: Column) -> Column:
    """The closed syncmers of the text, in order: place * 2**32 + hash of the k-mer. Null and empty texts have none.

    A text of fewer letters than a k-mer, or without an anchor, has one: its whole sequence of letters, at place 0. A text of
    blanks alone has none. Equal texts have equal anchors. Ties between inner substrings count as least.
    """
    inner = LETTERS_K - LETTERS_S + 1

    def syncmers(s: Column) -> Column:
        """s: hashes of the inner substrings, one for each place at which one starts."""
        least = s
        for step in range(1, inner):
            least = F.zip_with(least, _from(s, step), lambda a, b: F.least(a, b))
        edge = F.zip_with(s, _from(s, inner - 1), lambda a, b: F.least(a, b))
        marked = F.zip_with(least, edge, lambda a, b: a == b)
        n = F.size(s) - (inner - 1)
        places = F.filter(F.transform(F.slice(marked, F.lit(1), n), lambda closed, i: F.when(closed, i)), lambda i: i.isNotNull())
        kmer = lambda i: F.xxhash64(*[F.get(s, i + j) for j in range(0, inner, LETTERS_S)], F.get(s, i + inner - 1))
        return F.transform(places, lambda i: F.shiftleft(i.cast("long"), HASH_BITS).bitwiseOR(_hash32(kmer(i))))

    none = F.array().cast("array<bigint>")

    def of(letters: Column) -> Column:
        s = letters
        for step in range(1, LETTERS_S):
            s = F.zip_with(s, _from(letters, step), lambda a, b: F.xxhash64(a, b))
        s = F.slice(s, F.lit(1), F.greatest(F.size(letters) - (LETTERS_S - 1), F.lit(0)))
        whole = F.array(_hash32(F.xxhash64(F.array_join(letters, " "))))
        found = F.when(F.size(letters) >= LETTERS_K, let(s, syncmers)).otherwise(none)
        return let(found, lambda x: F.when(F.size(x) > 0, x).when(F.size(letters) > 0, whole).otherwise(none))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTER), 0), of)


def written(found: Column) -> Column:
    """Anchors as text: 8 hexadecimal digits of the hash and, in hexadecimal, the place, joined by blanks."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.hex(_hash32(x)), 8, "0"), F.hex(F.shiftrightunsigned(x, HASH_BITS)))), " ")


def hashes(found: Column) -> Column:
    return F.transform(found, _hash32)


def likeness(a: Column, b: Column) -> Column:
    """Of all anchors of two texts, the share that both have, wherever they stand: 1 for equal texts, also for two without anchors."""
    return let(
        F.struct(hashes(a).alias("a"), hashes(b).alias("b")),
        lambda h: let(F.size(F.array_union(h["a"], h["b"])), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(h["a"], h["b"])) / n)),
    )


def aligned(a: Column, b: Column) -> Column:
    """The share of a's anchors that stand in b at the shift of the first or of the last anchor that both have.

    Text with one passage added, taken out or replaced keeps all other anchors at one of these two shifts; text made of shared
    phrases in another order doesn't.
    """

    def placed(h: Column, x: Column) -> Column:
        at = lambda s, k: F.shiftrightunsigned(F.element_at(s, F.array_position(k, x).cast("int")), HASH_BITS)
        shift = F.shiftleft(at(h["a"], h["ah"]) - at(h["b"], h["bh"]), HASH_BITS)
        return let(shift, lambda d: F.array_intersect(h["a"], F.transform(h["b"], lambda y: y + d)))

    def of(h: Column) -> Column:
        common = F.array_intersect(h["ah"], h["bh"])
        return let(common, lambda c: F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.size(F.array_union(placed(h, F.element_at(c, 1)), placed(h, F.element_at(c, -1)))) / F.size(h["a"])))

    return let(F.struct(a.alias("a"), b.alias("b"), hashes(a).alias("ah"), hashes(b).alias("bh")), of)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint`: the closed syncmers of the whole text, as `written` gives them. A column of that name is replaced."""
    return docs.withColumn("fingerprint", written(anchors(F.col(text))))


def _buckets(docs: DataFrame) -> DataFrame:
    """docs with `bucket`, a struct that ascends with (doc_id, text_md5), null ids first, so that each bucket has few rows.

    Quantiles of the ids make at most CELLS cells, whose bounds are all that reaches the driver; a cell is divided evenly over
    its range of ids into as many parts as it has times BUCKET_ROWS rows. An id that fills a whole cell, a third of all rows
    say, and the null id are divided by the hash of their rows' texts.
    """
    shares = [i / CELLS for i in range(CELLS)] + [1.0]
    n, bounds = docs.agg(F.count("*"), F.percentile_approx("doc_id", shares, 16 * CELLS)).first()
    bounds = bounds or []
    id_ = F.col("doc_id")
    lows = sorted(set(bounds))
    hot = {b for b in lows if bounds.count(b) > 1}
    if not lows:  # no rows, or null ids alone
        lows = [0]
    parts = max(1, -(-n // (CELLS * BUCKET_ROWS)))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    cell = F.size(F.filter(array(lows), lambda b: b <= id_))
    at = lambda xs: F.get(array([float(x) for x in xs]), F.col("_cell") - 1)
    low, width = at(lows), F.greatest(at([*lows[1:], lows[-1]]) - at(lows), F.lit(1.0))
    part = F.floor((id_.cast("double") - low) / width * parts).cast("long")
    piece = F.when(id_.isNull() | id_.isin(sorted(hot)), F.conv(F.substring("text_md5", 1, 3), 16, 10).cast("int")).otherwise(F.lit(1 << 12))
    return docs.withColumn("_cell", F.when(id_.isNull(), F.lit(-1)).otherwise(cell)).withColumn("bucket", F.struct(F.col("_cell").alias("cell"), F.coalesce(part, F.lit(0)).alias("part"), piece.alias("piece"))).drop("_cell")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with anchors and, of the next row by descending doc_id, `next_text` and `next_anchors`; the first follows the last.

    Null ids come last; rows with one id are ordered by a hash of their text. Texts are shuffled once, by bucket of neighbouring
    ids. The first row of each bucket, one row in some thousands, goes along with the bucket that it follows, as a ghost.
    """
    rows = _buckets(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("text_md5", F.md5(F.col("text").cast("binary"))))
    order = F.struct("doc_id", "text_md5")
    tops = saved(rows.groupBy("bucket").agg(F.max(order).alias("top")), "tops")
    # which bucket's last row each top follows: the nearest higher bucket, found cell by cell; the highest follows the lowest
    ladder = Window.partitionBy("bucket.cell").orderBy("bucket")
    ends = tops.groupBy("bucket.cell").agg(F.min("bucket").alias("lowest"), F.max("bucket").alias("highest"))
    every = Window.orderBy("cell")  # one row for each cell, CELLS + 1 at most
    ends = ends.select("cell", F.coalesce(F.lead("lowest").over(every), F.min("lowest").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above"))
    follows = tops.withColumn("above_here", F.lead("bucket").over(ladder)).withColumn("cell", F.col("bucket.cell")).join(F.broadcast(ends), "cell").select(F.coalesce("above_here", "above").alias("after"), "bucket", "top")
    first = rows.join(follows, (rows["bucket"] == follows["bucket"]) & rows["doc_id"].eqNullSafe(follows["top.doc_id"]) & (rows["text_md5"] == follows["top.text_md5"]))
    ghosts = saved(first.dropDuplicates(["after"]).select(rows["doc_id"], "text", "text_md5", F.col("after").alias("bucket")), "firsts")
    down = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.desc("text_md5"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    dealt = both.repartition("bucket").withColumn("anchors", anchors(F.col("text")))
    near = dealt.withColumns({"next_text": F.lead("text").over(down), "next_anchors": F.lead("anchors").over(down)})
    return near.filter("not ghost").select("doc_id", "text", "anchors", "next_text", "next_anchors")


def edit_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and how much of the anchors keeps its place (aligned_edited, aligned_next).

    Null texts are empty. Rows with one id are rows of their own, each with its next; an only row is its own next. An empty
    table gives an empty result; other columns play no part.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_anchors", anchors(F.col("edited")))
    own, new, nxt = F.col("anchors"), F.col("edited_anchors"), F.col("next_anchors")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(own).alias("fingerprint"),
        written(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, nxt).alias("near_next"),
        aligned(own, new).alias("aligned_edited"),
        aligned(own, nxt).alias("aligned_next"),
    )
