"""Quality rules with risk-controlled thresholds.

A rule is a statistic of a text and a row of cutoffs from lenient to strict; it rejects what is above its cutoff. Labelled
good documents are the holdout: at each cutoff, the number that the rule rejects among a stratum's good documents has an
exact binomial tail, P(Bin(n, limit) <= rejected), and a cutoff is certified if that tail is at most the level, that is, if
the Clopper-Pearson upper bound of its false rejections is within the limit. Cutoffs are tested from lenient to strict until
one fails (a fixed sequence, which needs no further correction); over rules and strata the level is divided (Bonferroni),
and the limit over the rules. So with probability 1 - level no stratum loses more than the limit of its good documents.
A stratum with too few labels to certify anything loses none. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_hot, table, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LIMIT, LEVEL = 0.02, 0.05
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A statistic over the columns of `statistics`, null where it is not defined (such rows are never rejected by it)."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


def _falling(high: float, low: float, steps: int) -> tuple[float, ...]:
    return tuple(round(high * (low / high) ** (i / (steps - 1)), 6) for i in range(steps))


#: Statistics in SQL over the columns of `statistics`; every cutoff is a candidate, none is a decision.
RULES = (
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", _falling(2.0, 0.02, 24)),
    Rule("chars_per_word", "word_chars / nullif(n_words, 0)", _falling(16.0, 5.0, 32)),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", _falling(0.9, 0.05, 24)),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", _falling(0.9, 0.02, 24)),
    Rule("upper_share", "n_upper / nullif(word_chars, 0)", _falling(0.9, 0.02, 24)),
)


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _count_of(text: Column, characters: str) -> Column:
    """How many of the characters (each a single byte) the text has: the bytes that go when they are replaced by nothing."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that the array holds twice or more. A window's key is built by doubling: of two words,
    of four, of eight; keys are 64-bit hashes."""

    def doubled(width: int):
        def of(keys: Column) -> Column:
            n = F.greatest(F.size(keys) - width, F.lit(0))
            return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(keys, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))

        return of

    def places(keys: Column) -> Column:
        """Places whose key is another's too, in order: once sorted, equal keys are neighbours."""
        same = lambda s, x, at: F.get(s, at)["k"].eqNullSafe(x["k"])
        marked = lambda s: F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x["i"]))
        return F.sort_array(F.array_compact(_let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), marked)))

    def covered(starts: Column) -> Column:
        """Words in the windows that begin at these places."""
        n = F.size(starts) - 1
        steps = F.zip_with(F.slice(starts, F.lit(2), n), F.slice(starts, F.lit(1), n), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x).cast("long")

    keys = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        keys = _let(keys, doubled(width))
    none = F.lit(0).cast("long")
    return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), none).otherwise(_let(places(k), covered)))


def statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep and n_words, word_chars (code points in words), n_symbols, n_upper (A-Z), n_lines (with a word),
    n_dup_lines (equal to an earlier one) and n_repeat_words, over whole texts; null texts have no words."""
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    spaced = F.translate("_text", BLANKS[1:], " " * (len(BLANKS) - 1))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumns({"_spaced": spaced, "_lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))})
    rows = rows.withColumn("_words", F.array_remove(F.split("_spaced", " "), ""))
    return rows.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.char_length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).alias("n_symbols"), (F.char_length("_text") - F.char_length(F.translate("_text", UPPER, ""))).cast("long").alias("n_upper"),
        F.col("_lines.n").cast("long").alias("n_lines"), (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"), _repeated(F.col("_words")).alias("n_repeat_words"),
    )


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series, to about 1e-12, eight places further on."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return series - sum((F.ln(x + j) for j in range(8)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding, for k < n p; 1 for other k, which certify nothing.

    Terms fall from k downwards by a ratio under 1; those under e^-40 of the first are left out."""
    k, n = k.cast("double"), n.cast("double")
    odds = (1 - p) / p
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = k / (n - k + 1) * odds
    terms = F.least(k, F.ceil(40 / (1 - ratio))).cast("int")
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] * (k - j + 1) / (n - k + j) * odds
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    # sequence() runs backwards if its end is before its start, so no term is its own case
    total = F.when(terms < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), one, add, lambda a: a["s"]))
    return F.when(k < n * p, F.least(first * total, F.lit(1.0))).otherwise(1.0)


def calibrate(good: DataFrame, *, limit: float, level: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, n_good, cut_<rule> for each rule) from good documents' statistics and stratum: the strictest certified
    cutoff, null if none is. One aggregate with map-side combining, a row for each stratum, rule and step at most."""

    def step(rule: Rule) -> Column:
        """The first cutoff that the document is above; cutoffs fall."""
        value = F.expr(rule.value)
        return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: ~F.coalesce(value > c, F.lit(False))))

    steps = F.array(*[F.struct(F.lit(r).alias("rule"), step(rule).alias("step")) for r, rule in enumerate(rules)])
    n = written(good.groupBy("stratum").agg(F.count("*").alias("n_good")))
    each = level / max(1, n.count() * len(rules))
    hits = good.select("stratum", F.explode(steps).alias("s")).select("stratum", "s.rule", "s.step").groupBy("stratum", "rule", "step").agg(F.count("*").alias("hits"))
    places = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(c).alias("cutoff")) for r, rule in enumerate(rules) for j, c in enumerate(rule.cutoffs)])
    tried = n.select("stratum", "n_good", F.explode(places).alias("p")).select("stratum", "n_good", "p.*").join(hits, ["stratum", "rule", "step"], "left")
    rejected = F.sum(F.coalesce("hits", F.lit(0))).over(W.partitionBy("stratum", "rule").orderBy("step"))
    tested = tried.withColumn("rejected", rejected).withColumn("passes", binomial_tail(F.col("rejected"), F.col("n_good"), limit / len(rules)) <= each)
    until = F.coalesce(F.min(F.when(~F.col("passes"), F.col("step"))).over(W.partitionBy("stratum", "rule")), F.lit(1 << 30))
    chosen = tested.withColumn("until", until).where("step < until")
    # cutoffs fall from step to step, so the strictest is the smallest
    cuts = chosen.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{rule.name}") for r, rule in enumerate(rules)])
    return n.join(cuts, "stratum", "left")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", limit: float = LIMIT, level: float = LEVEL, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, stratum, statistics, base_failed, rejected_by, kept): one row for each row of docs, over whole texts.

    base_failed: under 20 words, or over 30 % of them in repeated windows. Of the others, those that a rule rejects at the
    cutoff certified for their stratum go; rejected_by lists the rules. At most `limit` of a stratum's good documents (label
    1) go by the rules, for all strata with probability 1 - level. Null strata are one stratum. Labels that are null,
    other than 0 and 1, without an id or contradictory don't count; repeated ones count once, each row of a repeated
    document counts. Without labels the rules reject nothing."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"), F.col(text).alias("_t"))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    stats = written(statistics(rows, "_id", "stratum", text="_t").withColumn("base_failed", failed))
    one = labels.select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("_y")).where("_l is not null and _y in (0, 1)").groupBy("_l").agg(F.min("_y").alias("_y")).where("_y = 1").select("_l")
    cuts = written(calibrate(stats.where("not base_failed").join(one, F.col("_id") == F.col("_l"), "left_semi"), limit=limit, level=level, rules=rules))
    strata = stats.groupBy("stratum").agg(F.count("*").alias("_n")).join(cuts, "stratum", "left")
    joined = join_hot(stats, strata, "stratum", "_n", max(1, stats.count()))
    rejects = [F.when(F.expr(rule.value) > F.col(f"cut_{rule.name}"), F.lit(rule.name)) for rule in rules]
    out = joined.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("")).otherwise(F.concat_ws(",", *rejects)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).withColumnRenamed("_id", doc_id)


def op12_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def oracle() -> str:
    """The query in SQL: exploded windows, and the binomial tail as a plain sum of all its terms."""
    word, r = "[^\\x20\\x09-\\x0D]+", len(RULES)
    grid = ", ".join(f"({i}, {j}, CAST({c} AS DOUBLE))" for i, rule in enumerate(RULES) for j, c in enumerate(rule.cutoffs))
    values = ", ".join(f"({rule.value}) AS v{i}" for i, rule in enumerate(RULES))
    long = " UNION ALL ".join(f"SELECT stratum, {i} AS rule, v{i} AS v FROM good" for i in range(r))
    picks = ", ".join(f"min(cutoff) FILTER (rule = {i}) AS c{i}" for i in range(r))
    tests = ", ".join(f"CASE WHEN v{i} > c{i} THEN '{rule.name}' END" for i, rule in enumerate(RULES))
    p = LIMIT / r
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws, row_number() OVER () AS u FROM documents),
g AS (SELECT u, i, ws[i:i + {WINDOW - 1}] AS g FROM (SELECT u, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
h AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT u, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM (SELECT u, i, lead(i) OVER (PARTITION BY u ORDER BY i) AS nx FROM h) GROUP BY u),
ln AS (SELECT u, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT u, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{word}') GROUP BY u),
f AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, length(t) - length(translate(t, '{UPPER}', '')) AS n_upper, coalesce(ln.n, 0) AS n_lines, CAST(coalesce(ln.n - ln.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN ln USING (u) LEFT JOIN rep USING (u)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM f),
good AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1)),
n AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
k AS (SELECT n.stratum, n.n, q.rule, q.step, q.cutoff, (SELECT count(*) FROM ({long}) l WHERE l.stratum = n.stratum AND l.rule = q.rule AND l.v > q.cutoff) AS k FROM n, (VALUES {grid}) q(rule, step, cutoff)),
tail AS (SELECT *, CASE WHEN k < n * {p!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) ELSE 1.0 END AS tail FROM k),
ok AS (SELECT * FROM (SELECT *, min(CASE WHEN tail > {LEVEL} / ({r} * (SELECT count(*) FROM n)) THEN step END) OVER (PARTITION BY stratum, rule) AS bad FROM tail) WHERE step < coalesce(bad, 1000)),
c AS (SELECT stratum, {picks} FROM ok GROUP BY stratum),
j AS (SELECT v.*, CASE WHEN base_failed THEN '' ELSE concat_ws(',', {tests}) END AS rejected_by FROM v LEFT JOIN c USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM j"""
