"""Benchmark decontamination on a positional inverted index.

The index holds postings (term, document, position) for terms of the test items, which are the only ones a
search can ask for; postings of the rarest term of a window also store the words around it. A search takes
each window's two rarest terms by their counts in the corpus, shifts both posting lists by the
terms' offsets in the item, intersects them, and compares the words around each remaining
posting with the item: that gives exact phrase matches. Proximity matches are pairs of the same two
lists within a given distance. Texts are cut into words once and the words are written; counts and postings are read
off them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, written

#: Words are runs of digits, letters A-Z in lower case, and characters beyond ASCII; these characters are between them.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 32 << 20
WINDOW = 10
LISTED = 20_000  # so many terms are looked up within an array of words, more by a join
FEW, PART_BYTES = 4, 1 << 22  # least partitions of tables of the benchmark's size, and bytes of its text for each


def normalised(text: Column) -> Column:
    """A text's words with one blank between them; one translation of characters is far cheaper than matching words."""
    blanks = F.translate(F.coalesce(text, F.lit("")), BETWEEN + UPPER, " " * len(BETWEEN) + LOWER)
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def small(frame: DataFrame, size: int) -> DataFrame:
    """Broadcast a frame whose bytes have been taken and are within the bound; else leave the join to Spark."""
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def bytes_of(frame: DataFrame) -> int:
    """Bytes of a frame's words, with what rows and cells of arrays take besides."""
    text, words = [c for c, kind in frame.dtypes if kind == "string"], [c for c, kind in frame.dtypes if kind == "array<string>"]
    each = [F.coalesce(F.octet_length(c), F.lit(0)) for c in text] + [F.octet_length(F.array_join(c, "")) + 16 * F.size(c) for c in words]
    return frame.agg(F.sum(sum(each, F.lit(64)).cast("long"))).first()[0] or 0


def partitions(size: int) -> int:
    """How many partitions tables of a benchmark of so many bytes have."""
    return max(FEW, -(-size // PART_BYTES))


def words_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, n_words, words): one row for each row of docs, words with one blank between them, written once.

    A row's key is its id with a hash of its text, so rows that share an id but not a text stay apart."""
    cut = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), normalised(F.col(text)).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    return written(cut.select("id", "h", n_words.cast("long").alias("n_words"), "words"))


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, words) with at least one word."""
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), normalised(F.col(text)).alias("w")).where("w <> ''").distinct().withColumn("w", F.split("w", " "))


def windows_of(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, n, v, q1, q2, t1, t2): positions and terms of the two rarest words of every window, the words v of the
    item from window - 1 before to window - 1 after q1, and the item's number n of words; q2 is null in one-word items."""
    reach = window - 1
    key = F.sha2(F.array_join("w", " "), 256)  # words hold no blanks
    places = items.select("item", key.alias("key"), F.posexplode("w").alias("q", "term")).join(counts, "term", "left")
    by_item = places.groupBy("item", "key").agg(F.array_sort(F.collect_list(F.struct("q", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("c") - window, F.lit(0)))
    rare = F.transform(starts, lambda s: F.array_sort(F.transform(F.slice("c", s + 1, F.lit(window)), lambda x: F.struct(x["n"].alias("n"), x["q"].alias("q")))))

    def one(r: Column) -> Column:
        q1, q2 = F.get(r, F.lit(0))["q"], F.get(r, F.lit(1))["q"]
        first = F.greatest(q1 - reach, F.lit(0))
        v = F.transform(F.slice("c", first + 1, q1 - first + window), lambda x: x["term"])
        return F.struct(v.alias("v"), q1.alias("q1"), q2.alias("q2"), F.get("c", q1)["term"].alias("t1"), F.get("c", q2)["term"].alias("t2"))

    return by_item.select("item", F.size("c").alias("n"), F.explode(F.transform(rare, one)).alias("r")).select("item", "n", "r.*").distinct()


def term_counts(words: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """(term, n): how often each term occurs in the whole corpus."""
    return words.select(F.explode(F.split("words", " ")).alias("term")).join(small(terms, size), "term").groupBy("term").agg(F.count("*").alias("n"))


def build_index(words: DataFrame, terms: DataFrame, size: int, around: int) -> DataFrame:
    """Postings (term, id, h, pos, ctx) of `terms`(term, anchor); ctx holds up to `around` words on either side of
    an anchor term's posting. words has id, h and words.

    Up to LISTED terms are found within a text's array of words, so that only postings leave it; more terms, or terms of
    over BROADCAST_BYTES, are joined with all words, each with the words around it."""
    tokens = words.select("id", "h", F.split("words", " ").alias("w"))
    listed = [r["term"] for r in terms.select("term").limit(LISTED + 1).collect()] if size <= BROADCAST_BYTES else []
    near = f"slice(w, greatest(i - {around}, 0) + 1, i - greatest(i - {around}, 0) + {around + 1})"
    if 0 < len(listed) <= LISTED:
        those = ", ".join(f"'{t}'" for t in sorted(listed))  # words hold no quotes
        places = F.expr(f"filter(transform(w, (x, i) -> IF(x IN ({those}), struct(i AS pos, x AS term, {near} AS near), NULL)), s -> s IS NOT NULL)")
    else:
        places = F.expr(f"transform(w, (x, i) -> struct(i AS pos, x AS term, {near} AS near))")
    found = tokens.select("id", "h", F.explode(places).alias("s")).select("id", "h", "s.*").join(small(terms, size), "term")
    return found.select("term", "id", "h", "pos", F.when(F.col("anchor"), F.col("near")).alias("ctx"))


def _run_lengths(ctx: Column, at: Column, w: Column, q: Column, reach: int) -> tuple[Column, Column]:
    """How many words before and after agree, up to `reach`; places outside either text never agree."""
    bits = F.array_join(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.when(F.coalesce(F.when((at + o >= 0) & (q + o >= 0), F.get(ctx, at + o) == F.get(w, q + o)), F.lit(False)), "1").otherwise("0")), "")
    return F.length(F.regexp_extract(F.substring(bits, 1, reach), "1*$", 0)), F.length(F.regexp_extract(F.substring(bits, reach + 2, reach), "^1*", 0))


def phrase_hits(postings: DataFrame, windows: DataFrame, size: int, window: int) -> DataFrame:
    """(id, h, item, lo, hi): spans of document words covered by occurrences of windows."""
    reach = window - 1
    anchors = windows.select("item", "n", "v", "q1", "t1").distinct()
    pairs = windows.select("item", "n", "v", "q1", "q2", "t2").distinct()
    first = postings.where("ctx is not null").alias("p").join(small(anchors, size), F.col("p.term") == F.col("t1")).select("id", "h", "item", "n", "v", "q1", F.col("pos").alias("pos1"), "ctx")
    #: the list of the second rarest term, shifted by the distance of the two in the item
    wanted = first.select("id", "h", "item", "n", "v", "q1", "pos1").join(small(pairs, size), ["item", "n", "v", "q1"]).withColumn("pos2", F.col("pos1") + F.col("q2") - F.col("q1"))
    second = postings.select(F.col("id").alias("i2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.col("term").alias("s2"))
    both = wanted.where("q2 is not null").join(second, F.expr("id <=> i2 and h = h2 and pos2 = p2 and t2 = s2"), "left_semi")
    kept = both.unionByName(wanted.where("q2 is null")).select("id", "h", "item", "n", "v", "q1", "pos1").distinct()
    kept = kept.select(*[F.col(c).alias(f"k_{c}") for c in kept.columns])
    candidates = first.join(kept, F.expr("id <=> k_id and h = k_h and item = k_item and n = k_n and v = k_v and q1 = k_q1 and pos1 = k_pos1"), "left_semi")
    left, right = _run_lengths(F.col("ctx"), F.least("pos1", F.lit(reach)), F.col("v"), F.least("q1", F.lit(reach)), reach)
    run = candidates.withColumn("l", left).withColumn("r", right)
    full = (F.col("n") >= window) & (F.col("l") + F.col("r") + 1 >= window) | (F.col("n") < window) & (F.col("l") >= F.col("q1")) & (F.col("r") >= F.col("n") - 1 - F.col("q1"))
    short = F.col("n") < window
    lo = F.col("pos1") - F.when(short, F.col("q1")).otherwise(F.col("l"))
    hi = F.col("pos1") + F.when(short, F.col("n") - 1 - F.col("q1")).otherwise(F.col("r"))
    return run.where(full).select("id", "h", "item", lo.alias("lo"), hi.alias("hi"))


def proximity_hits(postings: DataFrame, windows: DataFrame, size: int, slop: int) -> DataFrame:
    """(id, h, item, pos1, pos2): occurrences of a window's two rarest terms at most `slop` words apart, in either
    order. Positions are bucketed by `slop`, so the join is an equality join on neighbouring buckets."""
    pairs = windows.where("q2 is not null").select("item", "t1", "t2").distinct()
    first = postings.alias("p").join(small(pairs, size), F.col("p.term") == F.col("t1")).select("id", "h", "item", "t2", F.col("pos").alias("pos1")).withColumn("b", F.explode(F.expr(f"array(int(pos1 / {slop}) - 1, int(pos1 / {slop}), int(pos1 / {slop}) + 1)")))
    second = postings.select(F.col("id").alias("i2"), F.col("h").alias("h2"), F.col("term").alias("s2"), F.col("pos").alias("pos2")).withColumn("b2", F.expr(f"int(pos2 / {slop})"))
    return first.join(second, F.expr(f"id <=> i2 and h = h2 and t2 = s2 and b = b2 and abs(pos1 - pos2) <= {slop} and pos1 <> pos2")).select("id", "h", "item", "pos1", "pos2").distinct()


def search(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Matches of benchmark items in documents: (id, h, item, lo, hi) phrase spans, or, given a slop, proximity
    pairs (id, h, item, pos1, pos2); h is xxhash64 of the text, positions count words.

    Null and empty texts match nothing, nor do items without words; rows that repeat id and text give
    their matches as often; other columns of either table don't matter."""
    return _search(words_of(docs, doc_id, text), benchmark, item_id, item_text, window, slop)


def _search(words: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, slop: int | None = None) -> DataFrame:
    few = partitions(benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0)
    items = saved(items_of(benchmark, item_id, item_text).coalesce(few))
    terms = saved(items.select(F.explode("w").alias("term")).distinct().coalesce(few))
    counts = term_counts(words, terms, bytes_of(terms))
    windows = saved(windows_of(items, counts, window).coalesce(few))
    wanted = saved(windows.select(F.col("t1").alias("term"), F.lit(True).alias("anchor")).union(windows.where("t2 is not null").select("t2", F.lit(False))).groupBy("term").agg(F.max("anchor").alias("anchor")).coalesce(few))
    postings = saved(build_index(words, wanted, bytes_of(wanted), window - 1))
    size = bytes_of(windows)
    return proximity_hits(postings, windows, size, slop) if slop else phrase_hits(postings, windows, size, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, _h, n_words, n_hit, items, contaminated): one row for each row of docs.

    Null and empty texts have no words and no hits; items without words match nothing; an item of fewer words than
    the window is one window. Rows that repeat id and text get the same result. items is the sorted array
    of matched item ids as strings; a null item id counts as the empty string."""
    words = words_of(docs, doc_id, text)
    hits = _search(words, benchmark, item_id, item_text, window)
    spans = hits.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"] - 1, a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["hi"].cast("long")).alias("end")),
        lambda a: a["n"],
    )
    per_doc = spans.select("id", "h", covered.alias("n_hit"), "items")
    base = words.select(F.col("id").alias("b_id"), F.col("h").alias("b_h"), "n_words")
    out = base.join(per_doc, F.expr("b_id <=> id and b_h = h"), "left")
    return out.select(F.col("b_id").alias(doc_id), F.col("b_h").alias("_h"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: A document word is hit if it lies in an occurrence of a window: windows as ten words joined by blanks.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)),
m AS (SELECT DISTINCT r, s, dw.k, item FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
