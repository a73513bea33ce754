"""Consistent weighted samples: fingerprints whose positions agree as often as the generalised Jaccard similarity says.

For each position and each term of weight w, gamma variables r and c and a uniform b are drawn from a hash of position and term.
With t = floor(ln w / r + b) the term bids ln c - r (t - b + 1); the lowest bid's term and t are the sample. Two weighted
sets take the same sample with the probability sum of minima over sum of maxima of their weights.

Terms are words, weights their counts. Texts are dealt by ranges of ids once; counting words and taking the lowest bids
group by the range among other columns, so that neither moves a row again. A position keeps one number, a bid above a sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

POSITIONS = 32
SAMPLE_BITS = 16
#: -ln(1 - v/2) on [0, 1] is nearly the sum of these times v, v^2 and so on.
BETWEEN = (0.4999241, 0.1262991, 0.0340854, 0.0357665, -0.0195213, 0.0165896)
WHITE = r"[\x20\x09-\x0D]+"
#: What stands for the samples of a text without words; no sample has it.
NOTHING = 0


def term_counts(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys``, h, w0, w1, ...: each distinct word of some texts of a row by its hash and its count in each of them.

    h is null for what is no word; every row has a word or that.
    """
    bodies = rows.select(*keys, F.posexplode(F.array(*texts)).alias("__which", "__body"))
    words = bodies.select(*keys, "__which", F.explode(F.split(F.coalesce(F.col("__body"), F.lit("")), WHITE)).alias("__word"))
    hashed = words.select(*keys, "__which", F.when(F.col("__word") != "", F.xxhash64("__word")).alias("h"))
    return hashed.groupBy(*keys, "h").agg(*[F.count_if(F.col("__which") == n).alias(f"w{n}") for n in range(len(texts))])


def _exponential(bits: str, at: int) -> Column:
    """An exponential variable of 27 bits of a hash: zeros at the end count halvings, twenty more bits what is between.

    The part between is -ln(1 - v/2) for a uniform v, as a polynomial that is right to five digits. ``bids`` makes the columns.
    """
    low, v = F.col(f"{bits}_low{at}"), F.col(f"{bits}_v{at}")
    halvings = F.bit_count(low.bitwiseAND(-low) - 1)
    between = F.lit(0.0)
    for factor in reversed(BETWEEN):
        between = (between + factor) * v
    return halvings * math.log(2) + between


def bids(rows: DataFrame, keep: list[str], term: str, position: str, weight_logs: list[str]) -> DataFrame:
    """``keep`` and bid0, bid1, ...: the bid for each weight, above its sample, as a long whose order is the bids'; null for no weight.

    What is used more than once is a column of an earlier projection: written into one expression, or under a condition,
    Spark would make a hash some sixty times for one bid, in more code than the JVM compiles.
    """
    kept = list(dict.fromkeys([*keep, term, *weight_logs]))
    made = rows.select(*kept, *[F.xxhash64(term, F.col(position) * 3 + i).alias(c) for i, c in enumerate(("__first", "__second", "__third"))])
    parts = []
    for c in ("__first", "__second"):
        for at in (0, 32):
            low = F.shiftrightunsigned(c, at).bitwiseOR(F.lit(1 << 12))  # a bit that ends the count
            v = F.shiftrightunsigned(c, at + 12).bitwiseAND(F.lit((1 << 20) - 1)) / float(1 << 20)
            parts += [low.alias(f"{c}_low{at}"), v.alias(f"{c}_v{at}")]
    made = made.select(*kept, *parts, (F.shiftrightunsigned("__third", 40) / float(1 << 24)).alias("__shift"))
    scale, cost = (_exponential(c, 0) + _exponential(c, 32) + 1e-9 for c in ("__first", "__second"))
    made = made.select(*kept, scale.alias("__scale"), F.log(cost).alias("__cost"), "__shift")
    scale, cost, shift = F.col("__scale"), F.col("__cost"), F.col("__shift")
    made = made.select("*", *[F.floor(F.col(w) / scale + shift).alias(f"__level{n}") for n, w in enumerate(weight_logs)])
    found = []
    for n in range(len(weight_logs)):
        level = F.col(f"__level{n}")
        value = cost - scale * (level - shift + 1)
        sample = (F.shiftrightunsigned(term, 20) + level * 40503).bitwiseAND(F.lit((1 << (SAMPLE_BITS - 1)) - 1)) + 1
        found.append(F.shiftleft(((value + 512.0) * float(1 << 30)).cast("long"), SAMPLE_BITS).bitwiseOR(sample).alias(f"bid{n}"))
    return made.select(*keep, *found)


def signatures(rows: DataFrame, keys: list[str], text: str, positions: int = POSITIONS) -> DataFrame:
    """``keys`` and ``samples`` (array of int) of every text, as ``signatures_of`` makes them."""
    return signatures_of(rows, keys, {"samples": text}, positions)


def signatures_of(rows: DataFrame, keys: list[str], texts: dict[str, str], positions: int = POSITIONS) -> DataFrame:
    """``keys`` and an array of int for each of ``texts`` (name of the result: column of the text).

    ``keys`` must tell the rows apart; by the first they are dealt. The variables of a term and a position are drawn once for
    all texts of a row, which share most of their terms: a row for each term and position makes a bid for each text, in code that
    is small whatever the number of positions, and is met by the lowest bids so far right there.
    Null and empty texts, and texts of white space, have ``NOTHING`` at every position.
    """
    which = range(len(texts))
    each = term_counts(rows, keys, list(texts.values()))
    logs = [F.when(F.col("h").isNotNull() & (F.col(f"w{n}") > 0), F.log(F.col(f"w{n}").cast("double"))).alias(f"w{n}") for n in which]
    every = F.sequence(F.lit(0), F.lit(positions - 1))
    dealt = each.select(*keys, "h", *logs, F.explode(every).alias("position"))
    made = bids(dealt, [*keys, "position"], "h", "position", [f"w{n}" for n in which])
    least = made.groupBy(*keys, "position").agg(*[F.min(f"bid{n}").alias(f"bid{n}") for n in which])
    mask = F.lit((1 << SAMPLE_BITS) - 1).cast("long")
    samples = [F.coalesce(F.col(f"bid{n}").bitwiseAND(mask), F.lit(NOTHING)).cast("int").alias(name) for n, name in enumerate(texts)]
    found = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", *samples))).alias("__found"))
    return found.select(*keys, *[F.col("__found").getField(name).alias(name) for name in texts])


def likeness(a: Column, b: Column) -> Column:
    """Share of positions that agree, an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(samples: Column) -> Column:
    """Four lowercase hex digits for each position."""
    return F.concat_ws("", F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))))


def ranges(ids: DataFrame, column: str, each: int = 2) -> list:
    """The largest id of each of some ranges with about as many rows; a few for every shuffle partition."""
    parts = each * max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ids.where(F.col(column).isNotNull()).select(column).repartitionByRange(parts, column)
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max(column).alias("last")).orderBy("part")
    return [r["last"] for r in ends.collect()]  # one for each range


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, place, id, next_part, text, edited) of every row: ``edited`` has the next document's beginning as its second half.

    Texts move once: rows are dealt by ranges of ids, and within a range, and within its order of ids, the next document is at hand.
    Only the first document of each range travels to the range before. Of rows that share an id the one whose text is smallest
    stands for it; the document after the last is the first. A null id has no next document, and its rows are dealt by text.
    ``part`` and ``place`` tell rows apart; rows that repeat id and text are alike but for their place.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ends = ranges(own, "id")
    # the range of an id: how many ranges end before it
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("id"))) if ends else F.lit(0)
    lone = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, len(ends)))).cast("int")
    dealt = own.withColumn("part", F.when(F.col("id").isNull(), lone).otherwise(part.cast("int")))
    down = Window.partitionBy("part").orderBy(F.col("id").desc(), F.col("text").desc())
    seen = down.rowsBetween(Window.unboundedPreceding, -1)
    # the last row of an id, going down, is its smallest text
    placed = dealt.select(
        "part", "id", "text", F.row_number().over(down).alias("place"),
        F.when(~F.lead("id").over(down).eqNullSafe(F.col("id")), F.col("text")).alias("head"),
    )
    placed = placed.select("part", "place", "id", "text", F.last("head", True).over(seen).alias("next_text"))
    firsts = dealt.where("id IS NOT NULL").groupBy("part").agg(F.min(F.struct("id", "text")).alias("first"))
    before = F.pmod(F.col("part") - 1, F.lit(max(1, len(ends)))).cast("int")
    firsts = firsts.select(before.alias("before"), F.col("first.text").alias("first_text"))
    met = placed.join(firsts, (placed.part == firsts.before) & placed.next_text.isNull() & placed.id.isNotNull(), "left")
    kept = F.expr("substring(text, 1, int(length(text) - floor(length(text) / 2)))")
    new = F.expr("substring(coalesce(next_text, first_text, ''), 1, int(floor(length(text) / 2)))")
    return met.select("part", "place", "id", "text", F.concat(kept, new).alias("edited"))


def compared(docs: DataFrame, id_col: str = "doc_id", text: str = "text", positions: int = POSITIONS) -> DataFrame:
    """id, n_chars, edited_sha256, samples, edited_samples, near_edited and near_next of every row.

    Every row is sampled by itself, so equal texts have equal samples however often they come; two texts without words are
    alike (1), one with and one without are not (0). ``near_next`` compares with the document that ``edited_pairs`` names; for a
    null id with an empty text. Nulls, repeated rows and long texts as in ``edited_pairs``; an empty table gives an empty result.
    """
    pairs = edited_pairs(docs, id_col, text)
    facts = pairs.select("part", "place", "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    made = signatures_of(pairs, ["part", "place"], {"samples": "text", "edited_samples": "edited"}, positions)
    table = settle(facts.join(made, ["part", "place"]), "samples")
    # the same order again, now of short rows
    ids = table.where("id IS NOT NULL")
    first_of = ids.groupBy("id").agg(F.max_by("samples", "place").alias("first_samples"), F.max("part").alias("part"))
    down = Window.partitionBy("part").orderBy(F.col("id").desc())
    starts = first_of.groupBy("part").agg(F.min_by("first_samples", "id").alias("start"))
    parts = starts.select(F.max("part") + 1).scalar()
    starts = starts.select(F.pmod(F.col("part") - 1, parts).alias("part"), "start")
    following = first_of.select("id", "part", F.lag("first_samples").over(down).alias("inside"))
    following = following.join(starts, "part").select("id", F.coalesce("inside", "start").alias("next_samples"))
    found = table.join(following, "id", "left")
    nothing = F.array_repeat(F.lit(NOTHING), positions)
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "samples", "edited_samples",
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.coalesce("next_samples", nothing)).alias("near_next"),
    )
