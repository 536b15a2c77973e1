"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


#: 2**n for a text of twice to under four times as many characters, its `size`.
_HALF = "shiftleft(1, length(bin(size)) - 2)"


def _halves(text: str, before: Column) -> list[tuple[Column, Column, Column]]:
    """(whether, key, rest), four times: a half of the text is cut off at its front or end, and its hash goes
    on from `before`.  Columns `size` and `half` are the text's length and _HALF of it.

    Of two texts one edit apart an equal half can be cut off, as long as both cut the same: a text one short of the
    next class is cut as in that one too."""
    size, half, made = F.col("size"), F.col("half"), []
    for m, when in ((half, F.lit(True)), (half * 2, F.bit_count(size + 1) == 1)):
        front, back = F.substring(text, F.lit(1), m), F.substring(text, size - m + 1, m)
        made.append((when, F.xxhash64(before, m, F.lit(0), front), F.substring(text, m + 1, size)))
        made.append((when, F.xxhash64(before, m, F.lit(1), back), F.substring(text, F.lit(1), size - m)))
    return made


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose `key` another row has too."""
    return rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")


def _more_edits(hashed: DataFrame, first: DataFrame, least: int, edits: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (h, g, h2, g2) that may be `edits` edits apart, and the text of their lines.

    Of edits + 1 segments of the shorter line, one stands in the longer, shifted by at most `edits`."""
    place = first.select(F.col("own.id").alias("id"), F.col("own.no").alias("no"), "h", "g", "own")
    text, _ = stage(hashed.where(F.length("line") >= least).join(place, ["id", "no", "h", "g"]).select("h", "g", "own", "line").dropDuplicates(["h", "g"]), "texts")
    size, parts = F.length("line"), edits + 1
    bounds = lambda long, i: (F.floor(long * i / parts).cast("int"), F.floor(long * (i + 1) / parts).cast("int"))
    own, other = [], []
    for i in range(parts):
        start, end = bounds(size, i)
        own.append(F.xxhash64(size, F.lit(i), F.substring("line", start + 1, end - start)))
        for less in range(parts):
            long = size - less
            start, end = bounds(long, i)
            for shift in range(-edits, parts):
                inside = (long >= least) & (start + shift >= 0) & (end + shift <= size)
                other.append(F.when(inside, F.xxhash64(long, F.lit(i), F.substring("line", start + shift + 1, end - start))))
    held = text.select("h", "g", F.explode(F.array(*own)).alias("key"))
    asked = text.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.explode(F.array_distinct(F.array_compact(F.array(*other)))).alias("key"))
    return held.join(asked, "key").where("h <> h2 or g <> g2").select("h", "g", "h2", "g2").distinct(), text


def _one_edit(hashed: DataFrame, first: DataFrame, most: int, halves: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs (h, g, h2, g2) that may be an edit apart, and the text of their lines."""
    spark, size = hashed.sparkSession, F.length("line")
    # long lines with a half that another has, and their text
    cut = first.where("k0 is not null").select("h", "g", "own", F.explode(F.array_compact(F.array(*halves))).alias("key"))
    found, _ = stage(_shared(cut).select("h", "g", "own").distinct(), "halves")
    place = found.select(F.col("own.id").alias("id"), F.col("own.no").alias("no"), "h", "g", "own")
    texts = hashed.where(size > most).join(place, ["id", "no", "h", "g"]).select("h", "g", "own", "line")
    long_lines, _ = stage(texts.dropDuplicates(["h", "g"]), "long")
    # `pre` starts as the length of the longer of two lines; only that one is cut into variants
    lengths = F.explode(F.array(F.lit(0), F.lit(1))).alias("more")
    sized = long_lines.select("h", "g", "own", "line", lengths)
    state = sized.select("h", "g", "own", (F.length("line") + F.col("more")).cast("long").alias("pre"), F.col("line").alias("mid"), (F.col("more") == 0).alias("cuts"), (F.col("more") == 1).alias("whole"))
    ends = []
    while True:
        longer = state.where(F.length("mid") > most).withColumn("size", F.length("mid")).withColumn("half", F.expr(_HALF))
        if longer.isEmpty():
            break
        options = F.array(*[F.when(when, F.struct(key.alias("key"), rest.alias("rest"))) for when, key, rest in _halves("mid", F.col("pre"))])
        row = ["h", "g", "own", "cuts", "whole"]
        split = longer.select(*row, F.explode(F.array_compact(options)).alias("o")).select(*row, F.col("o.key").alias("key"), F.col("o.rest").alias("rest"))
        state, _ = stage(_shared(split).select("h", "g", "own", F.col("key").alias("pre"), F.col("rest").alias("mid"), "cuts", "whole"), "rests")
        ends.append(state.where(F.length("mid") <= most + 1))

    either = F.lit(True)
    brief = first.where("short is not null").select("h", "g", "own", F.lit(0).cast("long").alias("pre"), F.col("short").alias("mid"), either.alias("cuts"), either.alias("whole"))
    for more in ends:
        brief = brief.unionByName(more)
    places = F.sequence(F.lit(1), F.length("mid"))
    cut = brief.where("cuts and mid <> ''").select("h", "g", "own", "pre", F.explode(places).alias("i"), "mid")
    before, after = F.expr("substring(mid, 1, i - 1)"), F.expr("substring(mid, i + 1)")
    # substitutions: the earliest line of each key, for all lines of the key
    same = Window.partitionBy("key")
    swapped = (
        cut.select("h", "g", "own", F.xxhash64("pre", before, F.col("i"), after).alias("key"))
        .withColumn("near", F.min(F.struct("own", "h", "g")).over(same))
        .where("near.own < own")
        .select("h", "g", F.col("near.h").alias("h2"), F.col("near.g").alias("g2"))
    )
    # insertions and deletions: a line's variant is another line; of a run of one character, the last is left out
    last = F.expr("substring(mid, i, 1) <> substring(mid, i + 1, 1)")
    dropped = cut.where(last).select("h", "g", F.xxhash64("pre", F.concat(before, after)).alias("key"))
    whole = brief.where("whole").select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.xxhash64("pre", "mid").alias("key"))
    grown = dropped.join(whole, "key").where("h <> h2 or g <> g2").select("h", "g", "h2", "g2")
    pairs = swapped.unionByName(grown).distinct()
    short = first.where("short is not null").select("h", "g", "own", F.col("short").alias("line"))
    text = short.unionByName(long_lines.where(F.length("line") > most + 1).select("h", "g", "own", "line"))
    return pairs, text


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 16, most: int = 64, edits: int = 1) -> DataFrame:
    """(id, gone): the numbers, from 0, of the lines of each document that an earlier line repeats.

    Lines are compared without spaces, tabs and carriage returns at their ends.  A line that is not blank
    goes if an equal one stands earlier, by (id, line number), in any document; one of `least` characters
    or more also if one of that length at most `edits` edits away does.  What follows is for one edit; for
    more, see `_more_edits`.

    Only `most` characters or a few more are cut into variants, one for each character left out.  Of a longer
    line, halves that another line shares are cut off first, and halves of the rest, until that is short: an
    edit leaves one of two halves as it is.  The hash of what was cut off goes into the variants' keys.

    Variants that a substitution shares keep the place of the character left out: all lines with
    such a key are one edit apart, so each needs the earliest of them, not pairs.  A line and one with a
    further character meet where a variant of the second equals the first.  Keys are hashes; the
    edit distance of what meets is verified over the whole lines."""
    spark = docs.sparkSession
    line = F.btrim("line", F.lit(" \t\r"))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
        .select("id", "no", line.alias("line"))
        .where("line <> ''")
    )
    hashed = lines.select("id", "no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")
    size = F.col("size")
    # lines of most + 1 characters are short as well as long: they may be an edit from either
    keyed = hashed.withColumn("size", F.length("line")).withColumn("half", F.expr(_HALF)).select(
        "id", "no", "h", "g", F.when((size >= least) & (size <= most + 1), F.col("line")).alias("short"),
        *[F.when((size > most) & when, key).alias(f"k{i}") for i, (when, key, _) in enumerate(_halves("line", F.lit(0).cast("long")))],
    )
    halves = [f"k{i}" for i in range(4)]
    grouped = keyed.groupBy("h", "g").agg(F.min(F.struct("id", "no")).alias("own"), *[F.first(c).alias(c) for c in ("short", *halves)])
    first, _ = stage(grouped, "lines")

    pairs, text = _one_edit(hashed, first, most, halves) if edits == 1 else _more_edits(hashed, first, least, edits)
    later = F.when(F.col("own2") < F.col("own"), F.struct("h", "g", F.col("own2").alias("near"))).otherwise(F.struct(F.col("h2").alias("h"), F.col("g2").alias("g"), F.col("own").alias("near")))
    verified = (
        pairs.join(text, ["h", "g"])
        .join(text.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("own").alias("own2"), F.col("line").alias("other")), ["h2", "g2"])
        .where(F.levenshtein("line", "other", edits) >= 0)
        .select(later.alias("x"))
        .groupBy("x.h", "x.g")
        .agg(F.min("x.near").alias("near"))
    )
    near, _ = stage(verified, "near")
    bar = first.select("h", "g", "own").join(near, ["h", "g"], "left").select("h", "g", F.least("own", "near").alias("bar"))
    gone = keyed.select("id", "no", "h", "g").join(bar, ["h", "g"]).where(F.struct("id", "no") > F.col("bar"))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the lines that an earlier line repeats, and n_lines and n_removed beside them, which replace
    columns of docs of that name.

    Null text: no lines, stays null.  Blank lines stay, so an empty text is one.  A row with a null id is compared with
    nothing.  Rows of one id are one document, whose lines of one number are not compared.  An empty table
    gives no rows.  A very long text is cut into lines in one row; its lines are then rows like others.  Ids are of any
    type that has an order.  Other columns may have any name."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = removed_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", "t", **how)
    # numbers for names on the way, so that no column of docs clashes with another
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    # cut after the join: the lines would else be shuffled beside the text
    joined = own.join(found.withColumnRenamed("id", "_own"), F.col("_id") == F.col("_own"), "left").withColumn("_lines", F.split("_t", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(
        *[(text if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)],
        F.greatest(F.coalesce(F.size("_lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
