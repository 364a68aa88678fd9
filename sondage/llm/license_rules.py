"""License scan with ordered signature rules, in DataFrame functions alone.

A text is brought to words (A-Z lower-cased; everything but letters, digits and non-ASCII characters separates). A few
keywords gate everything: a document without one never meets a regular expression, and a rule only runs where one of
its own keywords occurs. Detections are word intervals. A detection that lies inside another one is suppressed: intervals are
ordered by start, then longer first, then the rule's priority, and one pass with the furthest end so far decides.

The rules come from hand-written families (name, versions, keywords) by notice, SPDX, URL and mention templates. No shuffle:
every step works on a row's own arrays, so neither hot sources nor copies matter.

Defined cases: a null text is empty and has no words; an empty text has 0 words, null positions, empty labels and score 0;
repeated rows get equal results; further columns are ignored (the query) or passed through (``scan``).
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, keywords (every spelling of the name holds one of them), the license's name as a regex over words, versions
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("lgpl", "lesser library", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)? licen[cs]e", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", "mit licen[cs]e", ()),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("cddl", "common", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common", "common public licen[cs]e", ("1 0",)),
    ("osl", "open", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("boost", "boost", "boost software licen[cs]e", ("1 0",)),
    ("bsd", "bsd", "bsd licen[cs]e", ()),
    ("isc", "isc", "isc licen[cs]e", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("cecill", "cecill", "cecill(?: free software)?(?: licen[cs]e)?", ("1 0", "2 0", "2 1")),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("odbl", "database", "open(?: data commons)? database licen[cs]e", ("1 0",)),
    ("python", "python psf", "(?:python software foundation|psf|python) licen[cs]e", ("2", "2 0")),
    ("php", "php", "php licen[cs]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[cs]e", ()),
    ("openssl", "openssl", "openssl licen[cs]e", ()),
    ("bsl", "business", "business source licen[cs]e", ("1 1",)),
    ("sspl", "server", "server side public licen[cs]e", ("1",)),
    ("elastic", "elastic", "elastic licen[cs]e", ("1", "2", "2 0")),
    ("cc-by-nc-nd", "nc noncommercial", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:nd|noderivatives|noderivs)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "nc noncommercial", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:sa|sharealike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "nc noncommercial", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "nd noderivatives noderivs", "(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|noderivs)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sa sharealike", "(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("public-domain", "domain", "(?:in|into|to) the public domain", ()),
    ("proprietary", "reserved", "all rights reserved", ()),
    ("proprietary", "confidential", "proprietary and confidential", ()),
)
#: Every pattern needs one of these word starts; a test checks that against the rules.
GATES = ("licen", "cc", "creative", "spdx", "reserved", "confidential", "domain", "wtfpl", "unlicen", "cecill")
VERSION = "(?:version |v )?"
NOTICE = "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?"


def rules() -> list[dict]:
    """The ordered rules: a smaller priority is the more specific one. Confidence is the weight of a rule's evidence."""
    made = []
    for label, keywords, name, versions in FAMILIES:
        spdx = label.replace("-", " ")
        forms = []
        for v in versions:
            forms += [
                (0.99, f"{NOTICE}{name} {VERSION}{v}(?: or (?:any )?later(?: version)?)?"),
                (0.95, f"{name} {VERSION}{v}(?: or (?:any )?later(?: version)?)?"),
                (0.97, f"spdx licen[cs]e identifier {spdx} {v}(?: only| or later)?"),
            ]
        forms += [
            (0.9, f"{NOTICE}{name}"),
            (0.85, f"(?:this|the) (?:work|software|file|project|program|text|content) is (?:licen[cs]ed )?(?:under )?(?:the )?{name}"),
            (0.9, f"spdx licen[cs]e identifier {spdx}"),
            (0.7, name),
        ]
        made += [{"label": label, "keywords": "spdx" if "spdx" in p else keywords, "confidence": c, "pattern": p} for c, p in forms]
    return [r | {"priority": i} for i, r in enumerate(made)]


def normalised(text: Column) -> Column:
    """The words of a text between single blanks, and one blank at either end; a text without words gives one blank."""
    lower = F.lower(F.coalesce(text, F.lit("")))  # other letters stay word characters, and none becomes a letter of a pattern but U+212A, a k
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """(start, end) of every match in characters: pieces between matches and the matches themselves, added up."""
    whole = F.concat(F.lit("(?<= )"), pattern, F.lit("(?= )"))
    found = F.regexp_extract_all(words, whole, F.lit(0))
    gaps = F.transform(F.split(words, whole, -1), F.length)
    start = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(
        F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x)
    )
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end")))


def scan(docs: DataFrame, text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with ``words`` (normalised text) and ``found``: the detections that no other one contains.

    ``found`` holds label, confidence, start and end (in characters of ``words``), one entry for each label and interval kept.
    """
    table = rules()
    kind = "array<struct<label:string,keywords:string,confidence:double,pattern:string,priority:int>>"
    literal = F.from_json(F.lit(json.dumps(table)), kind)  # folded to a constant once
    keywords = sorted({r["keywords"] for r in table})
    rows = docs.withColumn("words", normalised(F.col(text_col)))
    gate = functools.reduce(lambda a, b: a | b, [F.contains(F.col("words"), F.lit(f" {g}")) for g in GATES])
    has = lambda k: functools.reduce(lambda a, b: a | b, [F.contains(F.col("words"), F.lit(f" {w} ")) for w in k.split()])
    own = F.array_compact(F.array(*[F.when(has(k), F.lit(k)) for k in keywords]))
    rows = rows.withColumn("__kw", F.when(gate, own))
    detected = F.flatten(
        F.transform(
            F.filter(literal, lambda r: F.array_contains(F.col("__kw"), r["keywords"])),
            lambda r: F.transform(
                _places(F.col("words"), r["pattern"]),
                lambda p: F.struct(
                    p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["priority"].alias("priority"),
                    r["label"].alias("label"), r["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    rows = rows.withColumn("__all", F.when(F.size("__kw") > 0, F.array_sort(detected)))
    # a detection is kept if it reaches further than all that start before it; at equal intervals the first rule wins
    return rows.withColumn(into, _kept(F.col("__all"))).drop("__kw", "__all")


def _kept(sorted_detections: Column) -> Column:
    kind = "array<struct<label:string,confidence:double,start:int,end:int>>"
    state = F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("kept"))
    step = lambda a, d: F.when(
        -d["minus_end"] > a["reach"],
        F.struct(
            (-d["minus_end"]).alias("reach"),
            F.concat(a["kept"], F.array(F.struct(
                d["label"].alias("label"), d["confidence"].alias("confidence"), d["start"].alias("start"), (-d["minus_end"]).alias("end")
            ))).alias("kept"),
        ),
    ).otherwise(a)
    return F.coalesce(F.aggregate(sorted_detections, state, step, lambda a: a["kept"]), F.array().cast(kind))


def op2_license_rules(docs: DataFrame) -> DataFrame:
    rows = scan(docs.select("doc_id", "text"))
    words = F.col("words")
    phrase = f"(?<= )(?:{'|'.join(sorted(BASE_PHRASES, key=len, reverse=True))})(?= )"
    has = {p: F.contains(words, F.lit(f" {p} ")) for p in BASE_PHRASES}
    some = has["gnu general public license"] | has["apache license"] | has["cc by"] | has["mit license"]
    first = F.least(*[F.when(h, F.instr(words, F.lit(f" {p} "))) for p, h in has.items()])
    last = F.greatest(
        *[F.when(h, F.length(words) - F.instr(F.reverse(words), F.lit(f" {p[::-1]} ")) - len(p)) for p, h in has.items()]
    )
    base = F.array_compact(F.array(*[F.when(h, F.lit(BASE_PHRASES[p])) for p, h in has.items()]))
    labels = F.array_sort(F.array_union(base, F.transform(F.col("found"), lambda d: d["label"])))
    return rows.select(
        "doc_id",
        F.when(words.rlike("[^ ]"), _blanks(words) - 1).otherwise(0).cast("long").alias("n_words"),
        F.when(some, F.regexp_count(words, F.lit(phrase))).otherwise(0).cast("long").alias("n_base"),
        F.when(some, _blanks(F.substring(words, F.lit(1), first)) - 1).cast("long").alias("first_word"),
        F.when(some, _blanks(F.substring(words, F.lit(1), last)) - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("found"), lambda d: d["confidence"])), F.when(some, F.lit(0.7)), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
