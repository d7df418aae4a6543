"""Joins by something else than equality, each over an index that bounds its candidates: intervals, substrings, sets of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import kept


def segments_to_regions(segments: DataFrame, regions: DataFrame, slack: float = 0.001) -> DataFrame:
    """segments (key, seg, start, end) to regions (key, region, r_start, r_end): the first region that holds the middle, give or take
    `slack`; else the one with most overlap (or the least distance), the first of equals.

    Regions lie in bins as wide as a region is on average, so there are about three bin rows for a region. A segment meets the regions of the bin
    of its middle. One whose middle no region holds meets those of the bins it touches, and the nearest region on either side, which a
    sorted pass over ends and starts carries along. So a segment meets no more regions than overlap there. Keys without regions, and
    segments or regions with a null end, give no row."""
    segments = segments.where("start is not null and `end` is not null").select("key", "seg", "start", "end")
    regions = regions.where("r_start is not null and r_end is not null").select("key", "region", "r_start", "r_end")
    wide = F.lit(max(regions.agg(F.avg(F.col("r_end") - F.col("r_start"))).first()[0] or 0.0, 2 * slack, 1e-9))
    bin_of = lambda c: F.floor(c / wide)
    bins = regions.withColumn("bin", F.explode(F.sequence(bin_of(F.col("r_start") - slack), F.greatest(bin_of(F.col("r_start") - slack), bin_of(F.col("r_end") + slack)))))
    middle = (F.col("start") + F.col("end")) / 2
    holds = (middle >= F.col("r_start") - slack) & (middle <= F.col("r_end") + slack)
    inside = segments.withColumn("bin", bin_of(middle)).join(bins, ["key", "bin"]).where(holds).groupBy("key", "seg", "start", "end").agg(F.min("region").alias("region"))
    inside = kept(inside)
    rest = kept(segments.join(inside.select("key", "seg", "start", "end"), ["key", "seg", "start", "end"], "left_anti"))
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    first, last = F.least("start", "end"), F.greatest("start", "end")
    touched = rest.withColumn("bin", F.explode(F.sequence(bin_of(first), bin_of(last)))).join(bins, ["key", "bin"])
    rank = lambda overlap: F.struct(overlap.alias("overlap"), (-F.col("region")).alias("order"))
    found = touched.select("key", "seg", "start", "end", rank(shared).alias("r"))

    def nearest(at: Column, edge: str, falling: bool) -> DataFrame:
        """The last region edge at or before a segment's start (or, falling, the first one at or after its end)."""
        sign = -1 if falling else 1
        here = regions.select("key", (F.col(edge) * sign).alias("v"), F.lit(0).alias("asks"), F.struct((F.col(edge) * sign).alias("v"), (-F.col("region")).alias("order"), "r_start", "r_end").alias("near"), *(F.lit(None).cast(rest.schema[c].dataType).alias(c) for c in ("seg", "start", "end")))
        asks = rest.select("key", (at * sign).alias("v"), F.lit(1).alias("asks"), F.lit(None).cast(here.schema["near"].dataType).alias("near"), "seg", "start", "end")
        seen = F.max("near").over(W.partitionBy("key").orderBy("v", "asks").rowsBetween(W.unboundedPreceding, 0))
        out = here.unionByName(asks).withColumn("near", seen).where("asks = 1 and near is not null")
        span = F.least("end", "near.r_end") - F.greatest("start", "near.r_start")
        return out.select("key", "seg", "start", "end", F.struct(span.alias("overlap"), F.col("near.order").alias("order")).alias("r"))

    found = found.unionByName(nearest(F.col("start"), "r_end", False)).unionByName(nearest(F.col("end"), "r_start", True))
    best = found.groupBy("key", "seg", "start", "end").agg(F.max("r").alias("r")).select("key", "seg", (-F.col("r.order")).alias("region"), F.lit(False).alias("inside"))
    return inside.select("key", "seg", "region", F.lit(True).alias("inside")).unionByName(best)


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(n))), lambda g: F.char_length(g) == n))


def find_by_name(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (wanted), files (name): the file with that name, else the first (by name) that contains it in any case; null where there is none.

    An index lists the names by their runs of three characters. A name of three characters or more is looked up under its rarest one, and
    what is found there is verified; the first name is kept for each run of one or two characters, which answers shorter ones. The
    empty name is in every name. Repeated rows of names are answered each."""
    low = lambda c: F.lower(F.col(c))
    listed = files.where("name is not null").select("name").distinct()
    asked = kept(names.where("wanted is not null").select("wanted").distinct())
    exact = asked.join(listed.select(F.col("name").alias("wanted")), "wanted", "left_semi").select("wanted", F.col("wanted").alias("name"))
    short = listed.select("name", F.explode(F.concat(grams(low("name"), 1), grams(low("name"), 2))).alias("g")).groupBy("g").agg(F.min("name").alias("name"))
    few = asked.where(F.char_length(low("wanted")).between(1, 2)).join(short, low("wanted") == F.col("g")).select("wanted", "name")
    everywhere = listed.agg(F.min("name").alias("name")).where("name is not null")
    none = asked.where("wanted = ''").join(F.broadcast(everywhere)).select("wanted", "name")  # one row
    index = kept(listed.select("name", F.explode(grams(low("name"), 3)).alias("g")))
    sizes = index.groupBy("g").agg(F.count("*").alias("n"))
    parts = asked.where(F.char_length(low("wanted")) >= 3).select("wanted", F.explode(grams(low("wanted"), 3)).alias("g"))
    # a run that no name has stands for no answer
    rarest = parts.join(sizes, "g", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("wanted", F.col("r.g").alias("g"))
    many = rarest.join(index, "g").where(low("name").contains(low("wanted"))).groupBy("wanted").agg(F.min("name").alias("name"))
    found = few.unionByName(none).unionByName(many).groupBy("wanted").agg(F.min("name").alias("name"))
    best = found.join(exact.select("wanted", F.col("name").alias("same")), "wanted", "full").select("wanted", F.coalesce("same", "name").alias("name"))
    return names.join(best, "wanted", "left").select("wanted", "name")


def word_set(text: Column) -> Column:
    """Distinct words of a text: lower case, without marks."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of words: 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / F.nullif(F.size(a) + F.size(b), F.lit(0)))


def f1_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left (left_id, text), right (right_id, text): all pairs whose word sets have an F1 of `least` or more (above 0), with f1.

    Sets whose F1 is t share t / (2 - t) of the words of either one at least. So a left set that is too small or too large for every right
    one goes at once, and when words are sorted from rare to frequent, pairs meet in a word among the first of both; only these are joined,
    frequent words hardly ever. Words that only one side has come first of all and are counted, not stored. Pairs that have too few words
    left behind the word they meet in, or are of too unequal size, are left out before the sets, which are joined to the pairs by id, are
    compared exactly. Two empty sets are a pair. Ids must be unique on each side; the right one should be the smaller: its words are broadcast up to a million."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    part = least / (2 - least)
    n = F.size("words")
    sides = {"right": kept(right.select(F.col("right_id").alias("id"), word_set(F.col("text")).alias("words")))}
    low, high = sides["right"].where(n > 0).agg(F.min(n), F.max(n)).first()
    fits = lambda w: (F.size(w) == 0) | (F.lit(False) if low is None else (F.size(w) >= low * part - 1e-9) & (F.size(w) * F.lit(part) <= high + 1e-9))
    # a plain filter would make each set once for every time it names it
    one = F.explode_outer(F.filter(F.array(word_set(F.col("text"))), fits))
    sides["left"] = kept(left.select(F.col("left_id").alias("id"), one.alias("words")).where(F.col("words").isNotNull()))
    words = {k: v.select("id", n.alias("n"), F.explode("words").alias("word")) for k, v in sides.items()}
    listed = kept(words["right"].groupBy("word").agg(F.count("*").alias("right_freq")))
    small = F.broadcast if listed.count() <= 1_000_000 else lambda df: df  # words, 64 MB or so
    met = words["left"].join(small(listed), "word").groupBy("word", "right_freq").agg(F.count("*").alias("left_freq"))
    counts = kept(met.select("word", (F.col("left_freq") * F.col("right_freq")).alias("freq")))

    def firsts(k: str) -> DataFrame:
        ranked = words[k].join(small(counts), "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "word"))).alias("m"))
        # with the slack of a rounding error one word more may be taken, never one less; words of one side alone take their places first
        alone = F.col("n") - F.size("m")
        take = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(part) - 1e-9).cast("int") + 1, F.lit(1)) - alone
        first = ranked.where(take > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("m", F.lit(1), take)["word"]).alias("at", "word"))
        return first.select(F.col("id").alias(f"{k}_id"), F.col("n").alias(f"{k}_n"), (F.col("alone") + F.col("at")).alias(f"{k}_at"), "word")

    # behind the first word that two sets share, no more words can be shared than either has left
    most = F.least(F.col("left_n") - F.col("left_at"), F.col("right_n") - F.col("right_at"))
    near = most >= (F.col("left_n") + F.col("right_n")) * (least / 2) - 1e-9
    pairs = firsts("left").join(firsts("right"), "word").where(near).select("left_id", "right_id").distinct()
    with_sets = pairs.join(sides["left"].select(F.col("id").alias("left_id"), F.col("words").alias("a")), "left_id").join(sides["right"].select(F.col("id").alias("right_id"), F.col("words").alias("b")), "right_id")
    out = with_sets.select("left_id", "right_id", word_f1(F.col("a"), F.col("b")).alias("f1")).where(F.col("f1") >= F.lit(least))
    empty = [v.where(F.size("words") == 0).select(F.col("id").alias(f"{k}_id"), F.lit(0).alias("_none")) for k, v in sides.items()]
    return out.unionByName(empty[0].join(empty[1], "_none").select("left_id", "right_id", F.lit(1.0).alias("f1")))
