"""Removing lines that repeat an earlier line, exactly or within a bound, in DataFrame operations only.

Two lines are one edit apart if equal remainders are left when the edited place is deleted from both. The deletion neighbourhood is
emitted from coarse to fine. First each distinct line deletes each of ``PIECES`` stretches of itself and emits the hash
of what remains, with the stretches placed for its own length and for the length below, so that a line meets lines that are one
code point shorter. Only lines that meet another line over some stretch go on, and only with that stretch: there they emit the
hashed remainder of every single deleted code point, with its position. Equal lengths that agree on position and remainder are one
substitution apart; a line whose remainder is another line whole is one insertion away from it. The earliest line of each key is a windowed minimum, so no
pairs are formed but of a line with the earliest one that it meets, and there the edit distance itself is checked. Coarse keys are counted before lines are joined to those that several
lines hold, so a key that very many lines hold is combined before the shuffle and split after it.

Replaced words are found alike, for any number of them. A line's words are cut into stretches, and each choice of as many stretches as
words may be replaced is left out in turn. Choices that meet another line's are cut again, and so on until what is left out is no more words than the
bound, where equal remainders at equal places are the proof. One inserted or deleted word leaves the first or the second half as it was: lines that
meet over a half emit the remainder of every single deleted word.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.staging import discard, reclaim, staged

#: Stretches that a line is cut into, and the fewest code points of a line that is compared within an edit unless stated otherwise; in a short line one
#: edit makes another word.
PIECES = 4
SHORTEST = 20
#: Words that a line must have for each of its words that may differ.
WORDS_EACH = 6
#: Coarse keys of words that are shuffled at once.
KEYS_AT_ONCE = 5


WHITE = " \t\n\x0b\x0c\r"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with its later duplicate lines taken out of ``text_col``; all rows and columns stay.

    Lines end at ``\\n``. A line goes if an earlier line equals it or, with at least ``shortest`` code points in both, is one
    inserted, deleted or replaced code point away from it. With ``words`` it also goes if an earlier line has as many words, at most ``words`` of
    them others, or if one inserted or deleted word lies between the two. The shorter line must have ``WORDS_EACH`` words for each that differs, and so many at least;
    words are what stands between white space, of which the amount plays no part. Earlier means a smaller id (null first), then a smaller hash of the text, then
    a smaller place in the text, whether that line itself stays or not. Lines of white space alone stay and
    match nothing. Rows with the same id and text count as one document, and each comes back alike. A null text
    stays null; a text whose lines all go becomes empty. An empty table gives an empty result.
    """
    gone = duplicate_lines(docs, id_col, text_col, words, shortest).groupBy("__id", "__of").agg(F.collect_set("__place").alias("__gone"))
    rows = docs.withColumns({"__a": F.col(id_col), "__b": F.xxhash64(text_col)})
    joined = rows.join(gone.hint("shuffle_hash"), F.col("__a").eqNullSafe(F.col("__id")) & (F.col("__b") == F.col("__of")), "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, shortest: int = SHORTEST) -> DataFrame:
    """``(__id, __of, __place)`` of the lines that ``dedup_lines`` takes out: id, hash of the text and place from 0."""
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__of"), F.col(text_col).alias("text"))
    lines = texts.select("__id", "__of", F.posexplode(F.split("text", "\n", -1)).alias("__place", "line"))
    lines = lines.where(F.trim("line", F.lit(WHITE)) != "")
    spot = F.struct("__id", "__of", "__place")
    spots = lines.select(spot.alias("spot"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))

    keyed = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n": F.char_length("line")})
    coarse = {f"k{j}": F.when(F.col("n") >= shortest, F.xxhash64(*_outside(j))) for j in range(2 * PIECES)}
    keyed = keyed.withColumns(coarse)
    if words:
        keyed = _with_word_keys(keyed, words)
    keys = [*coarse, *(c for c in keyed.columns if c.startswith("q"))]
    distinct = keyed.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("times"), *[F.min(k).alias(k) for k in keys])
    distinct = staged(distinct, "distinct-lines")
    if words:
        reclaim(docs.sparkSession)

    repeated = distinct.where("times > 1").select("h1", "h2", "first")
    again = spots.join(repeated, ["h1", "h2"]).where(~F.col("spot").eqNullSafe(F.col("first"))).select("spot.*")
    # A line that goes near an earlier one goes as a first occurrence, and its repeats go as repeats.
    met = _met(distinct)
    reclaim(docs.sparkSession)
    tables, more = [distinct, met], None
    if words:
        more, kept = _near_words(texts, distinct, words)
        tables += kept
        reclaim(docs.sparkSession)
    near = _near(texts, met) if more is None else _near(texts, met).unionByName(more)
    gone = staged(again.unionByName(near), "gone-lines")
    del spots, lines, keyed, repeated, again, near, more
    for table in tables:
        discard(table)
    reclaim(docs.sparkSession)
    return gone


def _met(distinct: DataFrame) -> DataFrame:
    """By document the first occurrences of lines that meet another over some stretch, with that stretch."""
    stretches = F.array(*[F.struct(F.lit(j).alias("stretch"), F.col(f"k{j}").alias("key")) for j in range(2 * PIECES)])
    coarse = distinct.where("k0 is not null").select(F.xxhash64("h1", "h2").alias("line_id"), F.explode(stretches).alias("x")).select("line_id", "x.*")
    shared = staged(coarse.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key"), "shared-keys")
    reclaim(distinct.sparkSession)
    held = coarse.join(shared, "key", "left_semi").select("line_id", "stretch")
    met = distinct.select(F.xxhash64("h1", "h2").alias("line_id"), "first").join(held, "line_id")
    met = staged(met.groupBy("first.__id", "first.__of").agg(F.collect_list(F.struct(F.col("first.__place").alias("__place"), "stretch")).alias("met")), "met-lines")
    discard(shared)
    return met


def _near(texts: DataFrame, met: DataFrame) -> DataFrame:
    """First occurrences that are one edit away from an earlier line."""
    same = F.col("t.__id").eqNullSafe(F.col("m.__id")) & (F.col("t.__of") == F.col("m.__of"))
    found = texts.alias("t").join(met.hint("shuffle_hash").alias("m"), same).select("t.__id", "t.__of", F.split("text", "\n", -1).alias("lines"), "met")
    found = found.select("__id", "__of", F.explode(F.transform("met", lambda m: F.struct(m["__place"].alias("__place"), m["stretch"].alias("stretch"), F.get("lines", m["__place"]).alias("line")))).alias("m"))
    found = staged(found.select(F.struct("__id", "__of", "m.__place").alias("spot"), "m.stretch", "m.line").distinct(), "near-lines")
    lines = found.groupBy("spot").agg(F.min("line").alias("line"))
    found = found.withColumns({"n": F.char_length("line"), "longer": (F.col("stretch") >= PIECES).cast("int"), "piece": F.col("stretch") % PIECES})
    length, prefix, suffix, start, width = _placed(F.col("n"), F.col("longer"), F.col("piece"))
    found = found.select("spot", "longer", length.alias("length"), "piece", F.substring("line", F.lit(1), prefix).alias("before"), F.substring("line", suffix, F.col("n")).alias("behind"), F.substring("line", start, width).alias("inside"))

    # Fine: without each code point of the stretch; a line that may be the shorter one also whole, at place -1.
    at = F.explode(F.when(F.col("longer") == 1, F.sequence(F.lit(0), F.char_length("inside") - 1)).otherwise(F.sequence(F.lit(-1), F.char_length("inside") - 1)))
    fine = found.withColumn("at", at)
    rest = F.when(F.col("at") < 0, F.col("inside")).otherwise(F.concat(F.substring("inside", F.lit(1), F.col("at")), F.substring("inside", F.col("at") + 2, F.char_length("inside"))))
    place = F.when(F.col("longer") == 1, F.lit(-1)).otherwise(F.col("at"))
    parts = ["length", "piece", "before", "behind", "place", "rest"]
    fine = fine.withColumns({"rest": rest, "place": place}).select("spot", "longer", "place", F.xxhash64(*parts).alias("f1"), F.xxhash64(F.lit(1), *parts).alias("f2"))
    here = Window.partitionBy("f1", "f2")
    whole = F.min(F.when((F.col("longer") == 0) & (F.col("place") == -1), F.col("spot"))).over(here)
    fine = fine.withColumns({"earliest": F.min("spot").over(here), "whole": whole})
    fine = fine.withColumn("other", F.when(F.col("longer") == 1, F.col("whole")).otherwise(F.col("earliest"))).where(F.col("other") < F.col("spot"))
    pairs = fine.select("spot", "other").distinct().join(lines, "spot").join(lines.select(F.col("spot").alias("other"), F.col("line").alias("of_other")), "other")
    return pairs.where(F.levenshtein("line", "of_other", 1) >= 0).select("spot.*").distinct()


def _placed(n: Column, longer: Column | int, piece: Column | int) -> tuple[Column, ...]:
    """The shorter line's length, the prefix's length, the suffix's first place, and the stretch's first place and width."""
    length = n - longer
    low = F.floor(length * piece / PIECES).cast("int")
    high = F.floor(length * (piece + 1) / PIECES).cast("int")
    return length, low, high + longer + 1, low + 1, high - low + longer


def _outside(stretch: int) -> list[Column]:
    """What a coarse key is made of: the shorter line's length, the stretch's number and what stands around it."""
    longer, piece = divmod(stretch, PIECES)
    length, prefix, suffix, _, _ = _placed(F.col("n"), longer, piece)
    return [length, F.lit(piece), F.substring("line", F.lit(1), prefix), F.substring("line", suffix, F.col("n"))]


def _spaced(line: str) -> Column:
    """The line's words with one space between them."""
    odd = [F.col(line).contains(x) for x in ("  ", *WHITE.replace("\n", "")[1:])] + [F.col(line).startswith(" "), F.col(line).endswith(" ")]
    one = F.trim(F.regexp_replace(line, "[ \\t\\x0b\\f\\r]+", " "))
    return F.when(reduce(Column.__or__, odd), one).otherwise(F.col(line))


def _cut(words: Column, n: Column, parts: int) -> list[Column]:
    """An array's parts of about equal size."""
    bounds = [F.floor(n * j / parts).cast("int") for j in range(parts + 1)]
    return [F.slice(words, a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def _choices(words: int) -> list[tuple[int, tuple[int, ...]]]:
    """By place in the array of coarse keys the number of words that may be replaced and the stretches that are left out."""
    return [(k, left) for k in range(1, words + 1) for left in combinations(range(words + 3), k)]


def _with_word_keys(lines: DataFrame, words: int) -> DataFrame:
    """``lines`` with the coarse keys ``q0`` and on: one for each choice (null where a line may not have so many words replaced), then four of halves.

    The halves are those of the shorter line: two keys of a line as the shorter one, two as the longer one.
    """
    lines = lines.withColumn("w", _spaced("line"))
    lines = lines.withColumn("m", F.char_length("w") - F.char_length(F.replace("w", F.lit(" "), F.lit(""))) + 1)

    def end(count: Column) -> Column:
        """Code points of the first words."""
        return F.char_length(F.call_function("substring_index", F.col("w"), F.lit(" "), count))

    parts, m = words + 3, F.col("m")
    ends = {f"e{j}": end(F.floor(m * j / parts).cast("int")) for j in range(1, parts)}
    lines = lines.withColumns(ends).withColumns({"e0": F.lit(0), f"e{parts}": F.char_length("w"), "may": F.least(F.lit(words), F.floor(m / WORDS_EACH))})
    lines = lines.withColumns({f"s{j}": F.xxhash64(F.substring("w", F.col(f"e{j}") + 1, F.col(f"e{j + 1}") - F.col(f"e{j}"))) for j in range(parts)})
    keys = []
    for i, (k, left) in enumerate(_choices(words)):
        keys.append(F.when(F.col("may") == k, F.xxhash64(F.lit(i), "m", *[f"s{j}" for j in range(parts) if j not in left])))
    for longer in (0, 1):
        length = m - longer
        half = F.floor(length / 2).cast("int")
        halves = F.substring("w", F.lit(1), end(half)), F.substring("w", end(half + longer) + 1, F.char_length("w"))
        keys += [F.when(length >= WORDS_EACH, F.xxhash64(F.lit(-1 - i), length, part)) for i, part in enumerate(halves)]
    return lines.withColumns({f"q{i}": key for i, key in enumerate(keys)}).drop("w", "m", "may", *[c for j in range(parts + 1) for c in (f"e{j}", f"s{j}")])


def _near_words(texts: DataFrame, distinct: DataFrame, words: int) -> tuple[DataFrame, list[DataFrame]]:
    """First occurrences that are within the bound of words of an earlier line, and the staged tables that they are read from."""
    choices = _choices(words)
    line = F.xxhash64("h1", "h2").alias("line_id")
    held = []
    # Some keys at a time, so that their shuffles don't lie on the disks together; those of halves meet each other.
    halves = range(len(choices), len(choices) + 4)
    for some in [*(range(at, min(at + KEYS_AT_ONCE, len(choices))) for at in range(0, len(choices), KEYS_AT_ONCE)), halves]:
        keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col(f"q{i}").alias("key")) for i in some])
        keys = distinct.select(line, F.explode(keys).alias("x")).select("line_id", "x.*").where("key is not null")
        keys, several = _held(keys, "key")
        held.append(staged(keys.select("line_id", "choice"), "held-lines"))
        discard(several)
        reclaim(texts.sparkSession)
    at = distinct.select(line, "first").join(reduce(DataFrame.unionByName, held), "line_id")
    at = at.groupBy("first.__id", "first.__of").agg(F.collect_list(F.struct(F.col("first.__place").alias("__place"), "choice")).alias("met"))
    met = staged(at, "met-words")
    reclaim(texts.sparkSession)

    same = F.col("t.__id").eqNullSafe(F.col("m.__id")) & (F.col("t.__of") == F.col("m.__of"))
    found = texts.alias("t").join(met.hint("shuffle_hash").alias("m"), same).select("t.__id", "t.__of", F.split("text", "\n", -1).alias("lines"), "met")
    # Rows with the same id and text are one document, and each line of it comes once.
    found = found.select("__id", "__of", F.explode(F.transform("met", lambda m: F.struct(m["__place"].alias("__place"), m["choice"].alias("choice"), F.get("lines", m["__place"]).alias("line")))).alias("m"))
    found = found.select(F.struct("__id", "__of", "m.__place").alias("spot"), "m.choice", "m.line").distinct()
    hashed = F.transform(F.split(_spaced("line"), " ", -1), lambda w: F.xxhash64(w))
    found = staged(found.select("spot", "choice", hashed.alias("w")).withColumn("m", F.size("w")), "met-word-lines")

    tables, near = [*held, met, found], []
    masks = _masks(left for _, left in choices)
    for k in range(1, words + 1):
        rows = [i for i, c in enumerate(choices) if c[0] == k]
        state = found.where(F.col("choice").isin(rows))
        parts = F.array(*_cut(F.col("w"), F.col("m"), words + 3))
        state = _left_out(state.select("spot", "choice", "m", parts.alias("parts"), F.get(masks, "choice").alias("mask")), "choice", "m")
        state = state.select("spot", "f1", "f2", "inside")
        state, staging = _narrowed(state, k)
        tables += staging
        earliest = state.groupBy("f1", "f2").agg(F.min("spot").alias("earliest"))
        near.append(state.join(earliest, ["f1", "f2"]).where(F.col("earliest") < F.col("spot")).select("spot.*"))
    near.append(_one_word_more(found.where(F.col("choice") >= len(choices)).withColumn("half", F.col("choice") - len(choices))))
    return reduce(DataFrame.unionByName, near).distinct(), tables


def _held(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Those of ``rows`` whose keys other rows have too, with the number ``held`` of them, and the staged table of these keys.

    Keys are counted before rows are joined to them, so a key that very many rows have is combined before the shuffle and split after it.
    """
    several = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "several")
    return rows.join(several, list(keys)), several


def _masks(choices: Iterable[tuple[int, ...]]) -> Column:
    """The numbers whose bits are the parts that each choice leaves out."""
    return F.array(*[F.lit(sum(1 << j for j in left)) for left in choices])


def _left_out(rows: DataFrame, *about: str) -> DataFrame:
    """``rows`` with two hashes ``f1`` and ``f2`` of ``about`` and the ``parts`` outside ``mask``, and the words ``inside`` it."""
    within = lambda j: F.call_function("shiftright", F.col("mask"), j).bitwiseAND(1) == 1
    rows = rows.withColumns({"rest": F.filter("parts", lambda _, j: ~within(j)), "inside": F.flatten(F.filter("parts", lambda _, j: within(j)))})
    return rows.withColumns({"f1": F.xxhash64(*about, "rest"), "f2": F.xxhash64(F.lit(1), *about, "rest")})


def _narrowed(state: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(spot, f1, f2)`` of remainders without at most ``k`` words, from those without more words, as far as another line has them too.

    Each round leaves out at most ``k`` of ``3 * k`` parts of what the round before it left out; choices that meet no line are dropped, and so
    are those that meet only the lines that a smaller choice of the same parts meets.
    """
    state, several = _held(state, "f1", "f2")
    state = state.select("spot", "f1", "f2", "inside")
    tables, done = [several], []
    masks = _masks(left for size in range(k + 1) for left in combinations(range(3 * k), size))
    while True:
        state = staged(state, "narrowed-lines")
        tables.append(state)
        done.append(state.where(F.size("inside") <= k).select("spot", "f1", "f2"))
        wide = state.where(F.size("inside") > k)
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, done), tables
        cut = F.array(*_cut(F.col("inside"), F.size("inside"), 3 * k))
        chosen = wide.select("spot", F.col("f1").alias("p1"), F.col("f2").alias("p2"), cut.alias("parts"), F.explode(masks).alias("mask"))
        chosen = _left_out(chosen, "p1", "p2", "mask").select("spot", "p1", "p2", "mask", "f1", "f2", "inside")
        chosen, several = _held(chosen, "f1", "f2")
        tables.append(several)
        chosen = chosen.withColumn("all", F.collect_list(F.struct("mask", "held")).over(Window.partitionBy("spot", "p1", "p2")))
        within = F.exists("all", lambda x: (x["mask"] != F.col("mask")) & (x["mask"].bitwiseAND(F.col("mask")) == x["mask"]) & (x["held"] == F.col("held")))
        state = chosen.where(~within).select("spot", "f1", "f2", "inside")


def _one_word_more(found: DataFrame) -> DataFrame:
    """First occurrences that an earlier line is left of, or that are left of it, when one word is deleted."""
    found = found.withColumn("longer", (F.col("half") >= 2).cast("int")).withColumn("piece", F.col("half") % 2).withColumn("length", F.col("m") - F.col("longer"))
    middle = F.floor(F.col("length") / 2).cast("int")
    outside = F.when(F.col("piece") == 0, F.slice("w", 1, middle)).otherwise(F.slice("w", middle + 1 + F.col("longer"), F.col("length") - middle))
    inside = F.when(F.col("piece") == 0, F.slice("w", middle + 1, F.col("m"))).otherwise(F.slice("w", 1, middle + F.col("longer")))
    found = found.select("spot", "longer", "piece", "length", outside.alias("outside"), inside.alias("inside"))
    at = F.when(F.col("longer") == 1, F.sequence(F.lit(0), F.size("inside") - 1)).otherwise(F.array(F.lit(-1)))
    found = found.withColumn("at", F.explode(at))
    rest = F.when(F.col("at") < 0, F.col("inside")).otherwise(F.concat(F.slice("inside", F.lit(1), F.greatest("at", F.lit(0))), F.slice("inside", F.greatest("at", F.lit(0)) + 2, F.size("inside"))))
    parts = ["length", "piece", "outside", "rest"]
    found = found.withColumn("rest", rest).select("spot", "longer", F.xxhash64(*parts).alias("f1"), F.xxhash64(F.lit(1), *parts).alias("f2"))
    # Of lines that share a remainder those as long as it are equal in their words, and go before or after one of the longer ones.
    least = {name: F.min(F.when(F.col("longer") == longer, F.col("spot"))).alias(name) for longer, name in enumerate(("least_shorter", "least_longer"))}
    least = found.groupBy("f1", "f2").agg(*least.values()).where("least_shorter is not null and least_longer is not null")
    other = F.when(F.col("longer") == 1, F.col("least_shorter")).otherwise(F.col("least_longer"))
    return found.join(least, ["f1", "f2"]).where(other < F.col("spot")).select("spot.*").distinct()
