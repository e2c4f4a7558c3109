"""URL filters by a ratio of character language models, in DataFrame operations only.

Rules (host suffix, path prefix, verdict) settle the urls they fit; the longest rule wins. Their verdicts also label
the urls from which two variable-order Markov models are learned, one of accepted and one of rejected urls. A model
predicts each character of host and path from up to two before it: counts of the longer context are smoothed with the
prediction of the shorter one (`SMOOTHING` virtual characters), down to the uniform distribution. Urls without a rule
are judged by the log-likelihood difference of both models per character, against a threshold calibrated on the
labelled urls: the point between both means at equal distance in standard deviations.

Characters are mapped to an alphabet of `len(ALPHABET) + 2` symbols (any other character, and the beginning), so the
model is one array of at most 42^3 numbers whatever the size of the table: this is its proven size bound, and a url is
scored within its row, without a join or a shuffle.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and has ratio 0; with no
accepted or no rejected labels, all other urls are allowed; repeated rows and null page_ids are judged like others.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-/_"
#: Symbols: the letters of the alphabet from 1 on, then any other character, and 0 before the beginning.
SYMBOLS = len(ALPHABET) + 2
SMOOTHING = 2.0
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, empty where there is none."""
    after = F.when(url.contains("://"), url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like `net/`), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def symbols(host: Column, path: Column) -> Column:
    """The symbols of host and path, two zeros before them."""
    text = F.translate(F.concat(host, path), UPPER, LOWER)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    number = F.transform(letters, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(len(ALPHABET) + 1))
    return F.concat(F.array(F.lit(0), F.lit(0)), number)


def grams(s: Column) -> Column:
    """The code of each character with the two before it."""
    codes = F.zip_with(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: a * SYMBOLS + b), F.slice(s, 3, F.size(s)), lambda ab, c: ab * SYMBOLS + c)
    return F.filter(codes, lambda c: c.isNotNull())


def model(labelled: DataFrame) -> list[float] | None:
    """The table of log10 ratios (accepted to rejected) by gram code, from rows of (grams, verdict)."""
    rows = labelled.select("verdict", F.explode("grams").alias("g")).groupBy("g", "verdict").count().collect()
    logs = {}
    for says in ("allow", "block"):
        three = {r["g"]: r["count"] for r in rows if r["verdict"] == says}
        if not three:
            return None
        two: dict[int, int] = {}
        one: dict[int, int] = {}
        for g, n in three.items():
            two[g % (SYMBOLS * SYMBOLS)] = two.get(g % (SYMBOLS * SYMBOLS), 0) + n
            one[g % SYMBOLS] = one.get(g % SYMBOLS, 0) + n
        after_two: dict[int, int] = {}
        after_one: dict[int, int] = {}
        for g, n in three.items():
            after_two[g // SYMBOLS] = after_two.get(g // SYMBOLS, 0) + n
        for g, n in two.items():
            after_one[g // SYMBOLS] = after_one.get(g // SYMBOLS, 0) + n
        total = sum(one.values())
        p1 = [(one.get(c, 0) + SMOOTHING / SYMBOLS) / (total + SMOOTHING) for c in range(SYMBOLS)]
        p2 = [(two.get(b * SYMBOLS + c, 0) + SMOOTHING * p1[c]) / (after_one.get(b, 0) + SMOOTHING) for b, c in product(range(SYMBOLS), repeat=2)]
        logs[says] = [math.log10((three.get(g, 0) + SMOOTHING * p2[g % (SYMBOLS * SYMBOLS)]) / (after_two.get(g // SYMBOLS, 0) + SMOOTHING)) for g in range(SYMBOLS**3)]
    return [round(a - b, 5) for a, b in zip(logs["allow"], logs["block"])]


def ratio(codes: Column, table: Column) -> Column:
    """The mean log ratio of a url's characters, rounded so that the order of the sum does not show; 0 without any."""
    total = F.aggregate(codes, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return F.when(F.size(codes) > 0, F.round(total / F.size(codes), 9)).otherwise(F.lit(0.0))


def judge(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """`keep`, host, path, rule, verdict and ratio."""
    own = ["host", "path", "rule", "verdict", "ratio"]
    kept = [f"__k{i}" for i in range(len(keep))]
    host, path = split_url(pages[url].cast("string"))
    rows = pages.select(*(pages[c].alias(k) for c, k in zip(keep, kept)), host.alias("host"), path.alias("path"))
    name, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": says})
    codes = grams(symbols(F.col("host"), F.col("path")))
    labelled = rows.where("verdict is not null").select("verdict", codes.alias("grams"))
    table = model(labelled)
    if table is None:
        found = rows.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "ratio": F.lit(0.0)})
    else:
        # The optimizer folds the text into one constant array of the plan.
        held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
        means = labelled.select("verdict", ratio(F.col("grams"), held).alias("r")).groupBy("verdict").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")).collect()
        m, s = {r["verdict"]: r["m"] for r in means}, {r["verdict"]: r["s"] + 1e-9 for r in means}
        threshold = (m["block"] * s["allow"] + m["allow"] * s["block"]) / (s["allow"] + s["block"])
        found = rows.withColumn("ratio", ratio(codes, held))
        found = found.withColumn("verdict", F.coalesce("verdict", F.when(F.col("ratio") >= threshold, F.lit("allow")).otherwise(F.lit("block"))))
    return found.select(*(F.col(k).alias(n) for k, n in zip(kept, free_names(keep, own))), *own)
