"""Applications: edit distance, spell checking, alignment, rule cascades, lexicon lookup, transliteration.

Each works on a whole relation of inputs at once, over the operators of this package or a lattice of the same cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidOperation
from ..functions.semiring import TROPICAL, code_points
from ..plans.model import Fst, from_lexicon, from_sequences, renumber
from ..plans.storage import Rounds, store
from .product import compose


def string_acceptors(df: DataFrame, fst_id: str, text: str) -> Fst:
    """One linear acceptor for each row: labels are code points. An empty text is one final state."""
    s = TROPICAL
    rows = df.select(F.col(fst_id).cast("bigint").alias("fst_id"), F.posexplode(code_points(F.col(text))).alias("at", "label"))
    out = from_sequences(rows, ["at"], "label", s)
    empty = df.where(F.col(text) == "").select(F.col(fst_id).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"), F.lit(True).alias("is_start"), s.cast(s.one).alias("final_weight"))
    return out.with_(states=out.states.unionByName(empty))


# -- edit distance and alignment -----------------------------------------------------------------
def edit_lattice(df: DataFrame, a: str, b: str, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> DataFrame:
    """df with `cost` and `ops`: the cheapest way from text a to text b, ops 1 match, 2 substitute, 3 insert, 4 delete.

    The lattice of a pair is folded row by row within its own row of the relation, so no pair meets another. Ties take
    the diagonal first, then deletion, then insertion."""
    x, y = code_points(F.col(a)), code_points(F.col(b))
    cell = lambda cost, ops: F.struct(cost.alias("c"), ops.alias("o"))
    no = F.array().cast("array<int>")
    op = lambda n: F.lit(n).cast("int")
    first = F.transform(F.sequence(F.lit(0), F.size(F.col("__y"))), lambda j: cell(j * F.lit(insert), F.array_repeat(op(3), j)))

    def line(prev: Column, c: Column) -> Column:
        start = F.get(prev, 0)
        begin = F.array(cell(start["c"] + F.lit(delete), F.array_append(start["o"], op(4))))

        def step(acc: Column, j: Column) -> Column:
            diagonal, above, left = F.get(prev, j), F.get(prev, j + 1), F.get(acc, j)
            same = F.get(F.col("__y"), j) == c
            d = diagonal["c"] + F.when(same, F.lit(0.0)).otherwise(F.lit(substitute))
            u, i = above["c"] + F.lit(delete), left["c"] + F.lit(insert)
            best = F.when((d <= u) & (d <= i), cell(d, F.array_append(diagonal["o"], F.when(same, op(1)).otherwise(op(2))))).when(u <= i, cell(u, F.array_append(above["o"], op(4)))).otherwise(cell(i, F.array_append(left["o"], op(3))))
            return F.array_append(acc, best)

        places = F.when(F.size("__y") > 0, F.sequence(F.lit(0), F.greatest(F.size("__y") - 1, F.lit(0)))).otherwise(no)
        return F.aggregate(places, begin, step)

    held = df.withColumns({"__x": x, "__y": y}).withColumn("__first", first)
    last = F.aggregate("__x", F.col("__first"), line)
    return held.withColumn("__last", F.element_at(last, -1)).withColumns({"cost": F.col("__last.c"), "ops": F.col("__last.o")}).drop("__x", "__y", "__first", "__last")


def edit_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with `distance`: Levenshtein's, at unit costs."""
    return df.withColumn("distance", F.levenshtein(F.col(a), F.col(b)).cast("bigint"))


# -- spell checking ------------------------------------------------------------------------------
def spell_check(lexicon: DataFrame, word: str, targets: DataFrame, target: str, k: int = 2, best: int | None = 10) -> DataFrame:
    """(target, word, distance): for each target the `best` words within k edits (None: all of them).

    The trie of the lexicon is composed with the Levenshtein automaton of all targets at once: a frontier row is a trie
    state with a place in a target and the edits so far. Each round reads one letter of the trie; only rows within k
    edits go on, so the work follows the near part of the trie."""
    trie = from_lexicon(lexicon.select(F.col(word).alias("w")).distinct(), "w", TROPICAL)
    arcs = store(trie.arcs.select(F.col("src").alias("at"), "ilabel", F.col("dst").alias("to")), "trie")
    words = trie.finals.select(F.col("state").alias("word"))
    t = targets.select(F.col(target).alias("target")).where("target is not null").distinct().withColumn("chars", code_points(F.col("target"))).withColumn("n", F.size("chars"))
    # Deleting letters of the target moves within it and reads nothing: every place is offered with its cost.
    spread = lambda df: df.select("target", "chars", "n", "at", F.explode(F.sequence("i", F.least(F.col("n"), F.col("i") + (F.lit(k) - F.col("d"))))).alias("j"), "i", "d").select("target", "chars", "n", "at", F.col("j").alias("i"), (F.col("d") + F.col("j") - F.col("i")).alias("d"))
    least = lambda df: df.groupBy("target", "chars", "n", "at", "i").agg(F.min("d").alias("d"))
    rounds = Rounds(lexicon.sparkSession, "spell")
    front = rounds.add(least(spread(t.select("target", "chars", "n", F.lit("").alias("at"), F.lit(0).alias("i"), F.lit(0).alias("d")))))
    while rounds.last:
        j = front.join(arcs, "at")
        here = F.get("chars", F.col("i"))
        moves = F.array(F.struct((F.col("i") + 1).alias("i"), (F.col("d") + F.when(here == F.col("ilabel"), 0).otherwise(1)).alias("d")), F.struct(F.col("i").alias("i"), (F.col("d") + 1).alias("d")))
        step = j.select("target", "chars", "n", F.col("to").alias("at"), F.explode(moves).alias("m")).select("target", "chars", "n", "at", "m.i", "m.d").where(f"d <= {int(k)} and i <= n")
        front = rounds.add(least(spread(step)))
    found = rounds.rows().where("i = n").groupBy("target", "at").agg(F.min("d").alias("distance")).withColumnRenamed("at", "word").join(words, "word", "left_semi")
    if best is None:
        return found.select("target", "word", F.col("distance").cast("bigint").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("distance", "word"))
    return found.withColumn("r", rank).where(F.col("r") <= best).select("target", "word", F.col("distance").cast("bigint").alias("distance"))


# -- rules ---------------------------------------------------------------------------------------
def apply_rules(words: Fst, rules: list[Fst], epsilon: bool = False) -> Fst:
    """A cascade: the words composed with one rule transducer after another. A rule table is one machine (fst_id 0) that
    every word's machine meets. epsilon: the rules have epsilon moves."""
    out = words
    for rule in rules:
        out = renumber(compose(out, rule, epsilon=epsilon, shared=True)).stored("rule")
    return out


def transliterate(df: DataFrame, text: str, table: dict[str, str], result: str = "result") -> DataFrame:
    """df with `result`: at each place the longest key of the table that fits is replaced, other letters stay.

    The table is a bounded set of rules, given by the caller."""
    if not table or "" in table:
        raise InvalidOperation("the table needs non-empty keys")
    longest = max(map(len, table))
    m = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))

    def step(acc: Column, i: Column) -> Column:
        take, out = F.lit(1), F.substring(F.col(text), i, F.lit(1))
        for n in range(1, longest + 1):
            part = F.substring(F.col(text), i, F.lit(n))
            fits = (F.length(part) == n) & F.map_contains_key(m, part)
            take, out = F.when(fits, F.lit(n)).otherwise(take), F.when(fits, F.element_at(m, part)).otherwise(out)
        return F.when(acc["next"] == i, F.struct((i + take).alias("next"), F.concat(acc["out"], out).alias("out"))).otherwise(acc)

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(result, F.aggregate(places, F.struct(F.lit(1).alias("next"), F.lit("").alias("out")), step)["out"])


def pronounce(words: DataFrame, word: str, lexicon: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(word, pronunciation, source): the lexicon's entries (word, pronunciation), else the rules letter by letter."""
    known = words.join(lexicon.select(F.col("word").alias(word), "pronunciation"), word).withColumn("source", F.lit("lexicon"))
    other = transliterate(words.join(lexicon.select(F.col("word").alias(word)), word, "left_anti"), word, rules, "pronunciation").withColumn("source", F.lit("rules"))
    return known.select(F.col(word).alias("word"), "pronunciation", "source").unionByName(other.select(F.col(word).alias("word"), "pronunciation", "source"))


def analyze(words: DataFrame, word: str, stems: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(word, stem, suffix): every division into a known stem (stem) and suffix (suffix; may be empty)."""
    cut = words.select(F.col(word).alias("word"), F.explode(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))).alias("i"))
    cut = cut.select("word", F.substring("word", F.lit(1), F.col("i")).alias("stem"), F.expr("substring(word, i + 1)").alias("suffix"))
    return cut.join(stems.select("stem").distinct(), "stem", "left_semi").join(suffixes.select("suffix").distinct(), "suffix", "left_semi").select("word", "stem", "suffix").distinct()


# -- numbers and dates ---------------------------------------------------------------------------
# The words of English numbers, and the names of the months.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
MONTHS = "January February March April May June July August September October November December".split()


def number_words() -> dict[str, int]:
    """Words up to ninety with their values."""
    return {w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}


def ordinal_words() -> dict[str, int]:
    """Ordinals of number words and scales: irregular ones, and those made with -th and -ieth."""
    plain = number_words() | SCALES
    irregular = set(ORDINALS.values())
    return ORDINALS | {(w[:-1] + "ieth" if w.endswith("y") else w + "th"): n for w, n in plain.items() if n and n not in irregular}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))


def spell_number(n: Column) -> Column:
    """A number from 0 to 999,999,999,999 in English words."""
    small = F.array(*map(F.lit, UNITS))
    tens = F.array(*map(F.lit, TENS))
    n = n.cast("bigint")

    def below_thousand(x: Column) -> Column:
        rest = x % 100
        two = F.when(rest == 0, F.lit(None)).when(rest < 20, F.get(small, rest.cast("int"))).otherwise(F.concat_ws("-", F.get(tens, (F.floor(rest / 10) - 2).cast("int")), F.when(rest % 10 > 0, F.get(small, (rest % 10).cast("int")))))
        return F.concat_ws(" ", F.when(x >= 100, F.concat(F.get(small, F.floor(x / 100).cast("int")), F.lit(" hundred"))), two)

    parts = [F.when(F.floor(n / v) % 1000 > 0, F.concat(below_thousand(F.floor(n / v) % 1000), F.lit(f" {w}"))) for w, v in reversed(SCALES.items()) if v >= 1000]
    return F.when(n == 0, F.lit("zero")).otherwise(F.concat_ws(" ", *parts, F.when(n % 1000 > 0, below_thousand(n % 1000))))


def numbers_to_digits(text: Column) -> Column:
    """Runs of number words as digits, ordinals as 21st; all other words stay. Words are separated by blanks, and hyphens
    within a number.

    The words are folded from left to right: a group below a thousand is collected, a scale takes it to the sum, and any
    other word, or a word that cannot go on with the group, ends the number."""
    plain, scales, ordinals = _map(number_words()), _map(SCALES), _map(ordinal_words())
    known = "|".join([*number_words(), *SCALES, *ordinal_words()])
    words = F.split(F.regexp_replace(text, rf"(?i)\b({known})-(?=({known})\b)", "$1 "), " ")
    none = F.lit(0).cast("bigint")
    state = lambda out, total, group, on: F.struct(out.alias("out"), total.cast("bigint").alias("total"), group.cast("bigint").alias("group"), on.alias("on"))
    number = lambda a: (a["total"] + a["group"]).cast("string")
    ended = lambda a: F.when(a["on"], F.array_append(a["out"], number(a))).otherwise(a["out"])

    def step(a: Column, word: Column) -> Column:
        w = F.lower(word)
        v, scale, nth = F.element_at(plain, w).cast("bigint"), F.element_at(scales, w).cast("bigint"), F.element_at(ordinals, w).cast("bigint")
        low = a["group"] % 100
        fits = lambda x: a["on"] & (low == 0) | a["on"] & (low >= 20) & (low % 10 == 0) & (x < 10) & (x > 0)
        value = F.when(fits(nth), a["total"] + a["group"] + nth).when(a["on"] & (nth >= 100), F.when(nth == 100, a["total"] + a["group"] * 100).otherwise(a["total"] + a["group"] * nth)).otherwise(nth)
        joined = fits(nth) | a["on"] & (nth >= 100)
        ending = F.when((value % 100).between(11, 13), "th").when(value % 10 == 1, "st").when(value % 10 == 2, "nd").when(value % 10 == 3, "rd").otherwise("th")
        return (
            F.when(v.isNotNull(), F.when(fits(v), state(a["out"], a["total"], a["group"] + v, F.lit(True))).otherwise(state(ended(a), none, v, F.lit(True))))
            .when(scale.isNotNull() & a["on"], F.when(scale == 100, state(a["out"], a["total"], a["group"] * 100, F.lit(True))).otherwise(state(a["out"], a["total"] + a["group"] * scale, none, F.lit(True))))
            .when(nth.isNotNull(), state(F.array_append(F.when(joined, a["out"]).otherwise(ended(a)), F.concat(value.cast("string"), ending)), none, none, F.lit(False)))
            .otherwise(state(F.array_append(ended(a), word), none, none, F.lit(False)))
        )

    empty = F.array().cast("array<string>")
    return F.aggregate(words, state(empty, none, none, F.lit(False)), step, lambda a: F.array_join(ended(a), " "))


def normalize_text(df: DataFrame, text: str, result: str = "result") -> DataFrame:
    """df with `result`: numbers in words as digits, dates (March 5th, 2021) as 2021-03-05, sums in dollars as $5, and ten
    digits of a telephone number as +1-555-123-4567."""
    out = numbers_to_digits(F.col(text))
    for i, month in enumerate(MONTHS, 1):
        name = month if len(month) < 4 else rf"{month[:3]}(?:{month[3:]}|\.)?"
        out = F.regexp_replace(out, rf"(?i)\b{name} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b", f"$2-{i:02d}-$1")
    out = F.regexp_replace(out, r"\b(\d{4}-\d{2})-(\d)(?!\d)", "$1-0$2")
    out = F.regexp_replace(out, r"(?<![\d-])(?:\+?1[ .-])?\(?(\d{3})\)?[ .-]?(\d{3})[ .-](\d{4})(?![\d-])", "+1-$1-$2-$3")
    return df.withColumn(result, F.regexp_replace(out, r"(?i)\b(\d+) dollars?\b", r"\$$1"))
