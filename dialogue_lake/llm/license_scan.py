"""License scans by ordered signature rules, in DataFrame operations only.

A text is brought to lower-case words with single blanks between. Only texts with one of a
few keywords go on; of the rules, only those run whose keyword the text has. Rules have
priorities: the more a pattern says (an SPDX tag, a grant, a named licence with version, a
bare name), the higher. A detection that lies within another of the same or a higher
priority is suppressed, so the most telling one of overlapping detections stays.

A missing or empty text has no words, no places and score 0. Repeated rows are scanned one
by one. The rules are a fixed table; the join with it is a broadcast of that table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.llm import textual as tx

# Word characters, base phrases and labels of the contract.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Label, keyword, name as it is written, and versions.
LICENSES = (
    ("apache", "apache", "apache( software)?", ("1.0", "1.1", "2.0")),
    ("agpl", "affero", "(gnu )?affero general public", ("1.0", "3.0")),
    ("lgpl", "lesser", "(gnu )?(lesser|library) general public", ("2.0", "2.1", "3.0")),
    ("gpl", "general public", "(gnu )?general public", ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", "(gnu )?gpl", ("1.0", "2.0", "3.0")),
    ("gfdl", "documentation", "(gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", "mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse public", ("1.0", "2.0")),
    ("eupl", "european union", "european union public", ("1.0", "1.1", "1.2")),
    ("cddl", "common development", "common development and distribution", ("1.0", "1.1")),
    ("artistic", "artistic", "(the )?artistic", ("1.0", "2.0")),
    ("cecill", "cecill", "cecill( free software)?", ("1.0", "1.1", "2.0", "2.1")),
    ("osl", "open software", "open software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", "academic free", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("ofl", "open font", "(sil )?open font", ("1.0", "1.1")),
    ("bsl", "boost", "boost software", ("1.0",)),
    ("psf", "python", "python( software foundation)?", ("2.0",)),
    ("php", "php", "php", ("3.0", "3.01")),
    ("zpl", "zope", "zope public", ("1.1", "2.0", "2.1")),
    ("lppl", "latex", "latex project public", ("1.0", "1.1", "1.2", "1.3")),
    ("ms-pl", "microsoft", "microsoft public", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal", ()),
    ("mit", "mit", "(the )?mit", ()),
    ("isc", "isc", "(the )?isc", ()),
    ("zlib", "zlib", "zlib( libpng)?", ()),
    ("x11", "x11", "x11", ()),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)?", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("upl", "universal permissive", "universal permissive", ("1.0",)),
    ("wtfpl", "wtfpl", "wtfpl", ("1.0", "2.0")),
    ("unlicense", "unlicense", "(the )?unlicense", ()),
    ("bsd-2-clause", "bsd", "(simplified bsd|bsd 2 clause|2 clause bsd)", ()),
    ("bsd-3-clause", "bsd", "((new|modified) bsd|bsd 3 clause|3 clause bsd)", ()),
    ("bsd-4-clause", "bsd", "((original|old) bsd|bsd 4 clause|4 clause bsd)", ()),
    ("bsd", "bsd", "bsd", ()),
    *((f"cc-by{part}", "cc by", f"cc by{part.replace('-', ' ')}", ("1.0", "2.0", "2.5", "3.0", "4.0"))
      for part in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")),
    *((f"cc-by{part}", "creative commons", f"creative commons attribution{words}", ("1.0", "2.0", "2.5", "3.0", "4.0"))
      for part, words in (
          ("", ""), ("-sa", " share ?alike"), ("-nc", " non ?commercial"), ("-nd", " no ?deriv(ative)?s?"),
          ("-nc-sa", " non ?commercial share ?alike"), ("-nc-nd", " non ?commercial no ?deriv(ative)?s?"))),
    ("cc0", "cc0", "cc0", ("1.0",)),
)
#: Label, keyword, phrase and priority of rules that stand alone.
SINGLES = (
    ("public-domain", "public domain", "(released|dedicated|placed|is) (in|into|to) the public domain", 3),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 3),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 3),
    ("bsd-3-clause", "neither the name", "neither the name of .{1,80}? nor the names of its contributors", 3),
    ("apache-2.0", "www apache org", "www apache org licenses license 2 0", 3),
    ("gpl", "www gnu org", "www gnu org licenses gpl", 3),
    ("lgpl", "www gnu org", "www gnu org licenses lgpl", 3),
    ("agpl", "www gnu org", "www gnu org licenses agpl", 3),
    ("proprietary", "proprietary", "proprietary and confidential", 3),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution)", 3),
    ("copyright", "copyright", "copyright (c )?(19|20)[0-9]{2}", 1),
    ("reserved", "rights reserved", "(all|some) rights reserved", 1),
)
#: What a kept detection of each priority says about the text, from 0 to 1.
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95, 4: 1.0}
BASE_CONFIDENCE = 0.4


def rules() -> list[tuple[int, str, int, str, str]]:
    """(order, keyword, priority, pattern, label): each licence in every way it is written."""
    found = []
    for label, keyword, name, versions in LICENSES:
        found += [
            (keyword, 3, f"(licensed|released|available|distributed|published) under (the )?(terms of )?(the )?{name}( license)?", label),
            (keyword, 2, f"{name} license", label)]
        for version in versions:
            digits = version.replace(".", " ")
            if digits.endswith(" 0"):
                digits = digits[:-2] + "( 0)?"
            number = f"(,? ?(license )?(version |v ?)?){digits}(?= )"
            found += [
                (keyword, 3, f"(licensed|released|available|distributed|published) under (the )?(terms of )?(the )?{name}( license)?{number}", f"{label}-{version}"),
                (keyword, 2, f"{name}( license)?{number}", f"{label}-{version}"),
                (keyword, 3, f"{name}( license)?{number}( or( at your option any)? later)", f"{label}-{version}"),
                ("spdx", 4, f"spdx license identifier {label.replace('-', ' ')} {version.replace('.', ' ')}(?= )", f"{label}-{version}")]
        if not versions:
            found.append(("spdx", 4, f"spdx license identifier {label.replace('-', ' ')}(?= )", label))
    found += [(keyword, priority, pattern, label) for label, keyword, pattern, priority in SINGLES]
    return [(i, keyword, priority, f"(?<= ){pattern}(?= )", label) for i, (keyword, priority, pattern, label) in enumerate(found)]


def normal(text: Column) -> Column:
    """Lower-case words with one blank around each."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), f"{SEPARATOR}+", " ")
    return F.translate(spaced, UPPER, LOWER)


def gate() -> str:
    """One pattern for all keywords; a blank stands for anything between words."""
    keywords = sorted({r[1] for r in rules()} | set(PHRASES.values()))
    return "(?i)(?:" + "|".join(k.replace(" ", f"{SEPARATOR}+") for k in keywords) + ")"


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the words of ``phrase`` stand in a row."""
    parts = phrase.split()
    return F.filter(
        F.transform(words, lambda x, i: F.when(x == parts[0], i)),
        lambda i: i.isNotNull() & tx.all_of([F.coalesce(F.get(words, i + k) == part, F.lit(False)) for k, part in enumerate(parts)]))


def detections(texts: DataFrame) -> DataFrame:
    """(row, label, priority, start, end) of what stays, from (row, norm); places are characters."""
    spark = texts.sparkSession
    table = spark.createDataFrame(rules(), "rule int, keyword string, priority int, pattern string, label string")
    keywords = F.array(*[F.lit(k) for k in sorted({r[1] for r in rules()})])
    gated = texts.withColumn("keyword", F.explode(F.filter(keywords, lambda k: F.contains(F.col("norm"), k))))
    tried = gated.join(F.broadcast(table), "keyword").withColumn(
        "found", F.expr("regexp_extract_all(norm, pattern, 0)")).filter(F.size("found") > 0).withColumn(
        "between", F.expr("split(norm, pattern, -1)"))
    # Where each match starts: the lengths of all that stands before it.
    spans = F.aggregate(
        F.arrays_zip(F.col("found").alias("m"), F.slice("between", 1, F.size("found")).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x.b) + F.length(x.m)).alias("at"),
            F.concat(acc.spans, F.array(F.struct(
                (acc.at + F.length(x.b)).alias("start"), (acc.at + F.length(x.b) + F.length(x.m)).alias("end")))).alias("spans")),
        lambda acc: acc.spans)
    rows = tried.select("row", "rule", "priority", "label", F.explode(spans).alias("s")).select(
        "row", "rule", "priority", "label", "s.start", "s.end")
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    # A span holds a later one of this order if it ends no earlier.
    holder = F.lit(None).cast("int")
    for level in sorted(CONFIDENCE):
        holder = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)).otherwise(holder)
    return rows.withColumn("holder", holder).filter(F.col("holder").isNull() | (F.col("holder") < F.col("end"))).drop("holder")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) per row."""
    body = tx.whole(text)
    own = tx.stored(docs.select(
        F.col(key).alias("key"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(body.rlike(gate()), normal(body)).alias("norm")).withColumn("row", F.monotonically_increasing_id()), "license-texts")
    gated = own.filter("norm is not null").select("row", "norm")
    words = gated.withColumn("words", F.split(F.trim("norm"), " "))
    for label, phrase in PHRASES.items():
        words = words.withColumn(label, F.when(F.contains("norm", F.lit(f" {phrase} ")), places(F.col("words"), phrase)).otherwise(
            F.array().cast("array<int>")))
    every = F.concat(*[F.col(f"`{x}`") for x in PHRASES])
    base = words.select(
        "row", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x in PHRASES])).alias("base_labels"))
    confidence = F.max(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("priority")])
    more = detections(gated).groupBy("row").agg(F.collect_set("label").alias("more"), confidence.alias("score"))
    found = own.drop("norm").join(base, "row", "left").join(more, "row", "left")
    none = F.array().cast("array<string>")
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    base_labels = F.coalesce("base_labels", none)
    return found.select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined(base_labels).alias("base_labels"), joined(F.array_union(base_labels, F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size(base_labels) > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"))
