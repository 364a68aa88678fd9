"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts and benchmark items become sequences of words in which numbers, units and names are typed placeholders. Windows of
``WINDOW`` template words are hashed and joined. Matches on one diagonal (same shift between document and item) belong to one
occurrence; its slots must be filled consistently: one value of the item may stand for one value of the document only. So a
question with other numbers or names is found, and a text that merely has the same shape is not. Windows with too few words beside
their placeholders say nothing as templates; they are joined by a hash of the lower-cased words themselves. An item of fewer than
``WINDOW`` words is one window of its own length; one of fewer than ``LITERALS`` words only matches a document of just these words.

The benchmark is broadcast if a count shows that it has at most ``MAX_BROADCAST`` windows, else joined by shuffle. Documents
are not shuffled for the search, only their matches, which are stored; the words of documents with a match are then read again
for their slots. Nothing is ever joined within the documents.

Defined cases: null texts and texts without words are empty and match nothing, as items and as documents; a very long text is
searched whole; items with equal templates and slots count once, under the smallest id; repeated rows (same doc_id and text) give one
result; different texts under one doc_id are searched each by itself; a null doc_id is an id like others; other columns, whatever their
names, are ignored (the query) or kept (``remove_contaminated``); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.sources import durable

WINDOW = 8
#: Of the words in a benchmark window, so many must be words, not placeholders, else only the same words match it.
LITERALS = 4
#: So many windows on one diagonal (13 words in a row), or half of a shorter item's (of all its windows, or, matched as templates,
#: of those that can match so), make a document contaminated.
RUN = 6
MAX_BROADCAST = 200_000
#: Units that become placeholders behind a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "l", "s", "sec", "min", "h", "hr",
    "hrs", "ms", "kmh", "mph", "km/h", "usd", "eur", "dollars", "euros", "cents", "percent", "meters", "metres", "miles", "hours",
    "minutes", "seconds", "days", "weeks", "months", "years", "kilograms", "grams", "pounds", "liters", "litres", "degrees",
)


def cleaned(text: Column) -> Column:
    """Words with their closing marks between single blanks; other punctuation at the edges of words is gone, numbers stand alone."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(t, r"([0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", "$1 ")).otherwise(t)
    return F.trim(F.regexp_replace(t, r"(?:[^\p{L}\p{N}.!?/']+|(?<![\p{L}\p{N}])['./!?]+)+", " "))


def template_of(clean: Column) -> Column:
    """The cleaned text with a placeholder for every number, unit and name, other words in lower case, without closing marks."""
    unit = rf"(?i)(?<![^ ])([0-9][^ ]*) (?:{'|'.join(UNITS)})([.!?/']*)(?= |$)"
    t = F.regexp_replace(F.regexp_replace(clean, unit, "$1 <unit>$2"), r"(?<![^ ])[0-9][^ ]*?([.!?/']*)(?= |$)", "<number>$1")
    t = F.when(clean.rlike("[0-9]"), t).otherwise(clean)
    t = F.regexp_replace(t, r"(?<=[^ .!?] )[\p{Lu}\p{Lt}][^ ]*", "<name>")  # not at the beginning of a sentence
    return F.regexp_replace(F.lower(t), "[.!?/']+(?= |$)", "")


def _prepared(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``template`` and ``words`` (lower case), ``n`` and, for each, ``slot``: the value that a placeholder stands for, else null."""
    rows = rows.withColumn("__clean", cleaned(F.col(text_col))).withColumn("__template", template_of(F.col("__clean")))
    words, bare = F.split(F.regexp_replace(F.lower("__clean"), "[.!?/']+(?= |$)", ""), " "), F.split("__template", " ")
    slot = F.zip_with(words, bare, lambda w, t: F.when(F.startswith(t, F.lit("<")), w))
    rows = rows.withColumn("slot", F.when(F.contains("__template", F.lit("<")), slot)).withColumn("words", words).withColumn("template", bare)
    return rows.withColumn("n", F.size("template")).drop("__clean", "__template")


def _hashes(words: str, *seed: Column) -> Column:
    """The hash of every window of words."""
    starts = F.sequence(F.lit(1), F.col("n") - WINDOW + 1)
    return F.transform(starts, lambda i: F.xxhash64(*seed, F.slice(words, i, F.lit(WINDOW))))


def _windows(rows: DataFrame, *keep: str, literal: bool = True) -> DataFrame:
    """``keep``, ``at`` (from 1), ``weak`` and ``hash`` of every window: of its template and, if ``literal``, once more of its words.

    Of documents, only the key goes into the exploded rows, not the words.
    """
    rows = rows.withColumn("codes", F.transform("template", lambda w: F.xxhash64(w)))
    hashes = _hashes("codes")
    if literal:
        rows = rows.withColumn("word_codes", F.transform("words", lambda w: F.xxhash64(w)))
        hashes = F.concat(hashes, _hashes("word_codes", F.lit("words")))
    hashes = F.when(F.col("n") >= WINDOW, hashes)  # no filter, which would evaluate the templates a second time
    at, last = F.col("i") + 1, F.col("n") - WINDOW + 1
    return rows.select(*keep, "n", F.posexplode(hashes).alias("i", "hash")).select(
        *keep, F.when(at > last, at - last).otherwise(at).alias("at"), (at > last).alias("weak"), "hash"
    )


def _short_windows(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """As ``_windows``, of each of the given ``size``s, all smaller than ``WINDOW``."""

    def windows(k: int, words: str, weak: bool) -> Column:
        one = lambda i: F.struct(
            i.alias("at"), F.lit(weak).alias("weak"), F.lit(k).alias("size"), F.xxhash64(F.lit(k), F.lit(weak), F.slice(words, i, F.lit(k))).alias("hash")
        )
        return F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), one))

    own = [windows(k, w, weak) for k in sizes for w, weak in (("template", False), ("words", True))]
    return rows.select(*keep, "n", F.explode(F.flatten(F.array_compact(F.array(*own)))).alias("w")).select(*keep, "n", "w.*")


def _slots(at: str, size: str) -> Column:
    return F.slice("slot", F.col(at), F.col(size))


def _placeholders(slots: Column) -> Column:
    return F.coalesce(F.greatest(F.size(F.filter(slots, lambda x: x.isNotNull())), F.lit(0)), F.lit(0))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, weak, size, item_id, item_at, n_item (windows of the item), n_strong (those that match as templates), item_slots.

    A window has one hash: of its template, or, where that is too ``weak``, of its words.
    """
    items = _prepared(benchmark.select("item_id", "text"), "text").filter(F.array_join("template", "") != "")
    items = items.groupBy("template", "slot", "n").agg(F.min_by("words", "item_id").alias("words"), F.min("item_id").alias("item_id"))
    size = F.least("n", F.lit(WINDOW))
    few = lambda slots, size: size - _placeholders(slots) >= LITERALS
    n_item = F.col("n") - size + 1
    strong = F.filter(F.sequence(F.lit(1), n_item), lambda i: few(F.slice("slot", i, size), size))
    items = items.withColumns({"n_item": n_item, "n_strong": F.size(strong), "size": size})
    keep = ["item_id", "n_item", "n_strong", "slot"]
    long = _windows(items.filter(F.col("n") >= WINDOW), *keep).withColumn("size", F.lit(WINDOW))
    short = _short_windows(items.filter(F.col("n") < WINDOW), list(range(1, WINDOW)), *keep).filter(F.col("size") == F.col("n")).drop("n")
    at = long.unionByName(short)
    at = at.select("hash", "weak", "size", "item_id", F.col("at").alias("item_at"), "n_item", "n_strong", _slots("at", "size").alias("item_slots"))
    return at.filter(F.col("weak") != few(F.col("item_slots"), F.col("size")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, text_hash, item_id, n_windows, coverage, changed_slots."""
    bench = benchmark_windows(benchmark)
    size = bench.agg(F.count(F.lit(1)).alias("all"), F.count_if("weak").alias("weak"), F.collect_set("size").alias("sizes")).first()
    if size["all"] <= MAX_BROADCAST:
        bench = F.broadcast(bench)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = _windows(_prepared(rows, "text"), "doc_id", "text_hash", literal=size["weak"] > 0).withColumn("size", F.lit(WINDOW))
    found = found.join(bench, ["hash", "weak", "size"])
    if short := sorted(k for k in size["sizes"] if k < WINDOW):
        whole = (F.col("size") >= LITERALS) | (F.col("size") == F.col("n"))
        few = _short_windows(_prepared(rows, "text"), short, "doc_id", "text_hash")
        found = found.unionByName(few.join(bench, ["hash", "weak", "size"]).filter(whole).drop("n"))
    hits = durable(found.drop("hash").distinct(), "windows")
    # the words of the few documents with a hit, each once
    keys = hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    if keys.count() <= MAX_BROADCAST:
        keys = F.broadcast(keys)
    same = lambda t: F.col("doc_id").eqNullSafe(t["__id"]) & (F.col("text_hash") == t["__hash"])
    own = _prepared(rows.join(keys, same(keys), "left_semi").dropDuplicates(["doc_id", "text_hash"]), "text")
    own = own.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "slot")
    met = hits.join(own, same(own)).select(
        "doc_id", "text_hash", "item_id", "n_item", "n_strong", "weak", (F.col("at") - F.col("item_at")).alias("shift"), F.col("at").alias("i"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.when(F.col("weak"), F.col("item_slots")).otherwise(_slots("at", "size")).alias("b")).alias("z"),
    )
    pairs = F.coalesce(F.filter(F.col("z"), lambda p: p["a"].isNotNull()), F.array().cast("array<struct<a:string,b:string>>"))
    runs = met.groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.max("n_item").alias("n_item"), F.max("n_strong").alias("n_strong"),
        F.count_distinct("i").alias("n_windows"), F.count_distinct(F.when(~F.col("weak"), F.col("i"))).alias("n_templates"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
    )
    values = F.array_distinct(F.transform("slots", lambda p: p["a"]))
    changed = F.size(F.filter("slots", lambda p: p["a"] != p["b"]))
    most = lambda n, of: F.col(n) >= F.least(F.lit(RUN), F.ceil(F.col(of) / 2))
    enough = most("n_windows", "n_item") | (F.col("n_strong") > 0) & most("n_templates", "n_strong")
    found = runs.filter(enough & (F.size("slots") == F.size(values))).withColumn("changed", changed)
    return found.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_windows").alias("n_windows"),
        F.max(F.col("n_windows") / F.col("n_item")).alias("coverage"),
        F.min("changed").cast("long").alias("changed_slots"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__hash"])
    return docs.join(found, same, "left_anti")


def op3_template_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item."""
    return contaminated(docs, benchmark).drop("text_hash")
