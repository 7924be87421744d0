"""License scans with ordered signature rules, in DataFrame expressions only.

A text becomes its words, lower-cased and joined by single spaces. A cheap gate lets only texts with a hint of a
license through. There, each of the rules below is tried if the text holds the rule's keyword; a rule is a regular
expression over whole words. Detections that lie within one of a higher priority, or within a longer one or an
earlier rule's of the same priority, are suppressed. The four base phrases are counted at all their places and
their labels always stay.

Null text: no words. Repeated rows and ids are scanned one by one. Very long texts are read whole; work per rule is
linear in the text, and suppression sorts the detections of a document instead of comparing all with all. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logfold.llm.texts import text_of

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Confidence of a detection by the priority of its rule.
CONFIDENCE = (0.3, 0.6, 0.8, 0.9, 0.95)


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: label, keyword, names as regular expressions over words, versions; each gives a rule for a bare name, for a grant
#: under that name, for an identifier tag, and for every version.
FAMILIES = """
gpl|gnu|gnu general public licen[sc]e|1 2 3
gpl|gpl|gnu gpl|1 2 3
gpl|gpl|gpl|1 2 3
lgpl|lesser|gnu lesser general public licen[sc]e|2.1 3
lgpl|library|gnu library general public licen[sc]e|2
lgpl|lgpl|(?:gnu )?lgpl|2 2.1 3
agpl|affero|gnu affero general public licen[sc]e|1 3
agpl|agpl|(?:gnu )?agpl|1 3
gfdl|documentation|gnu free documentation licen[sc]e|1.1 1.2 1.3
apache|apache|apache(?: software)? licen[sc]e|1.0 1.1 2.0
mit|mit|(?:the )?mit licen[sc]e|
mit|expat|expat licen[sc]e|
mit-0|mit|mit no attribution(?: licen[sc]e)?|
x11|x11|x11 licen[sc]e|
bsd|bsd|bsd licen[sc]e|
bsd-2-clause|bsd|(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|
bsd-2-clause|clause|bsd 2 clause(?: licen[sc]e)?|
bsd-3-clause|bsd|(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|
bsd-3-clause|clause|bsd 3 clause(?: licen[sc]e)?|
bsd-4-clause|bsd|(?:original|4 clause|four clause) bsd(?: licen[sc]e)?|
0bsd|bsd|(?:zero clause bsd|0bsd)(?: licen[sc]e)?|
isc|isc|isc licen[sc]e|
mpl|mozilla|mozilla public licen[sc]e|1.0 1.1 2.0
mpl|mpl|mpl|1.1 2.0
epl|eclipse|eclipse public licen[sc]e|1.0 2.0
cddl|cddl|cddl|1.0 1.1
cddl|distribution|common development and distribution licen[sc]e|1.0 1.1
cpl|common|common public licen[sc]e|1.0
eupl|european|european union public licen[sc]e|1.1 1.2
eupl|eupl|eupl|1.1 1.2
cecill|cecill|cecill(?: licen[sc]e)?|1.0 2.0 2.1
artistic|artistic|artistic licen[sc]e|1.0 2.0
zlib|zlib|zlib(?: libpng)? licen[sc]e|
bsl|boost|boost software licen[sc]e|1.0
ofl|sil|sil open font licen[sc]e|1.0 1.1
osl|open|open software licen[sc]e|1.0 2.0 2.1 3.0
afl|academic|academic free licen[sc]e|2.1 3.0
psf|python|python(?: software foundation)? licen[sc]e|2
php|php|php licen[sc]e|3.0 3.01
ruby|ruby|ruby licen[sc]e|
openssl|openssl|openssl licen[sc]e|
postgresql|postgresql|postgresql licen[sc]e|
unicode|unicode|unicode licen[sc]e|
ncsa|ncsa|(?:university of illinois )?ncsa(?: open source)? licen[sc]e|
w3c|w3c|w3c software(?: notice and)? licen[sc]e|
ms-pl|microsoft|microsoft public licen[sc]e|
ms-rl|microsoft|microsoft reciprocal licen[sc]e|
upl|universal|universal permissive licen[sc]e|1.0
vim|vim|vim licen[sc]e|
wtfpl|wtfpl|wtfpl|2
unlicense|unlicense|unlicense|
odbl|database|open (?:data commons open )?database licen[sc]e|1.0
odc-by|commons|open data commons attribution licen[sc]e|1.0
sspl|server|server side public licen[sc]e|1
busl|business|business source licen[sc]e|1.1
elastic|elastic|elastic licen[sc]e|2.0
cc0|cc0|cc0|1.0
cc0|zero|creative commons zero|1.0
cc-by-nc-nd|cc|cc by nc nd|2.0 2.5 3.0 4.0
cc-by-nc-sa|cc|cc by nc sa|2.0 2.5 3.0 4.0
cc-by-nc|cc|cc by nc|2.0 2.5 3.0 4.0
cc-by-nd|cc|cc by nd|2.0 2.5 3.0 4.0
cc-by-sa|cc|cc by sa|2.0 2.5 3.0 4.0
cc-by|cc|cc by|2.0 2.5 3.0 4.0
cc-by-nc-nd|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s|2.0 3.0 4.0
cc-by-nc-sa|creative|creative commons attribution non ?commercial share ?alike|2.0 3.0 4.0
cc-by-nc|creative|creative commons attribution non ?commercial|2.0 3.0 4.0
cc-by-nd|creative|creative commons attribution no ?deriv(?:ative)?s|2.0 3.0 4.0
cc-by-sa|creative|creative commons attribution share ?alike|2.0 3.0 4.0
cc-by|creative|creative commons attribution|2.0 3.0 4.0
"""
#: label, priority, keyword, regular expression over words: notices without the name of a license, and addresses.
NOTICES = r"""
gpl|3|gnu|free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl|3|gnu|gnu org licenses(?: old licenses)? gpl(?: \d)*
gpl-2.0-or-later|4|later|version 2 of the license or at your option any later version
gpl-3.0-or-later|4|later|version 3 of the license or at your option any later version
lgpl|3|gnu|gnu org licenses lgpl(?: \d)*
agpl|3|gnu|gnu org licenses agpl(?: \d)*
apache-2.0|4|apache|(?:www )?apache org licenses license 2 0
apache-2.0|3|compliance|you may not use this file except in compliance with the license
mit|3|permission|permission is hereby granted free of charge to any person obtaining a copy
mit|2|above|the above copyright notice and this permission notice shall be included
mit|2|opensource|opensource org licenses mit
isc|3|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd|3|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause|3|redistributions|redistributions of source code must retain the above copyright notice
bsd-3-clause|3|endorse|neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4-clause|3|advertising|all advertising materials mentioning features or use of this software must display
mpl-2.0|4|mozilla|subject to the terms of the mozilla public license v 2 0
mpl|3|mozilla|(?:www )?mozilla org mpl
epl|3|eclipse|(?:www )?eclipse org legal epl
bsl-1.0|4|boost|(?:www )?boost org license 1 0
zlib|3|altered|altered source versions must be plainly marked as such
unlicense|4|unencumbered|free and unencumbered software released into the public domain
unlicense|3|unlicense|unlicense org
wtfpl|4|fuck|do what the fuck you want to public license
cc0|3|creativecommons|creativecommons org publicdomain zero
cc-by|3|creativecommons|creativecommons org licenses by \d \d
cc-by-sa|3|creativecommons|creativecommons org licenses by sa \d \d
cc-by-nc|3|creativecommons|creativecommons org licenses by nc \d \d
cc-by-nd|3|creativecommons|creativecommons org licenses by nd \d \d
cc-by-nc-sa|3|creativecommons|creativecommons org licenses by nc sa \d \d
cc-by-nc-nd|3|creativecommons|creativecommons org licenses by nc nd \d \d
public-domain|2|domain|(?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain|1|domain|public domain dedication
ofl|3|sil|scripts sil org ofl
proprietary|1|rights|all rights reserved
proprietary|2|confidential|proprietary and confidential
copyright|0|copyright|copyright (?:c )?(?:19|20)\d\d
no-warranty|0|warranty|without warranty of any kind
no-warranty|0|warranty|without any warranty
"""
#: What a text must hold to be scanned at all, lower-cased; every rule's match holds one.
HINTS = ("licen", "copyright", "spdx", "public domain", "domain", "warranty", "rights", "permission", "redistribut", "redistribute",
         "confidential", "gnu", "gpl", "mpl", "cddl", "eupl", "cecill", "wtfpl", "creative", "commons", "cc0", "bsd", "mozilla", "eclipse",
         "apache", "boost", "altered", "attribution", "unencumbered", "sil", "endorse", "advertising")
_GRANT = r"(?:licensed|released|distributed|available|provided|published|covered|governed|redistributed) (?:only )?(?:under|by)(?: the)?(?: terms of)?(?: the)? "


def rules() -> list[Rule]:
    """All rules in their order: addresses and notices, then for each family tag, versions, grant and name."""
    out = [Rule(*(int(x) if k == 1 else x for k, x in enumerate(line.split("|", 3)))) for line in NOTICES.strip().splitlines()]
    for line in FAMILIES.strip().splitlines():
        label, keyword, rest = line.split("|", 2)
        name, _, versions = rest.rpartition("|")
        for version in versions.split():
            plain = version.replace(".", " ")
            zero = r"(?: 0)?" if "." not in version else "(?: 0)?" if version.endswith(".0") else ""
            digits = plain.removesuffix(" 0") if version.endswith(".0") else plain
            full = f"{label}-{version if '.' in version else version + '.0'}"
            out.append(Rule(full, 3, keyword, rf"(?:{name})(?: version| v| licen[sc]e)* v?{digits}{zero}"))
        tag = label.replace("-", " ")
        out += [Rule(label, 4, "spdx", rf"spdx license identifier {tag}(?: \d+)*(?: only| or later)?"),
                Rule(label, 2, keyword, f"{_GRANT}(?:{name})"), Rule(label, 1, keyword, f"(?:{name})")]
    return list(dict.fromkeys(out))


#: ASCII characters between words, one by one: Java looks such a class up in a table, and tries ranges in turn.
_APART = "".join(f"\\x{k:02X}" for k in range(128) if not chr(k).isalnum())


def _words(text: Column) -> Column:
    """The text as lower-case words with one space between; only A-Z is folded."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, f"[{_APART}]+", " "))


def _whole(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _places(text: Column, pattern: Column) -> Column:
    """Array of (start, stop) in words: marks are put around the matches, which lie on whole words."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit("\x01$0\x02")), " ")
    at = lambda mark: F.filter(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda x: x.isNotNull())
    return F.arrays_zip(at("\x01").alias("start"), at("\x02").alias("stop"))


def _detections(text: Column) -> Column:
    """Array of (rule, priority, label, base, start, stop); stop is exclusive."""
    known = [(k, r.priority, r.label, r.keyword, _whole(r.pattern), False) for k, r in enumerate(rules())]
    known += [(len(known) + k, 1, label, phrase.split()[0], _whole(phrase), True) for k, (phrase, label) in enumerate(BASE.items())]
    names = ("rule", "priority", "label", "keyword", "pattern", "base")
    table = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row, strict=True))) for row in known))
    hit = F.filter(table, lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["pattern"]))
    return F.flatten(F.transform(hit, lambda r: F.transform(_places(text, r["pattern"]), lambda p: F.struct(
        r["rule"].alias("rule"), r["priority"].alias("priority"), r["label"].alias("label"), r["base"].alias("base"),
        p["start"].alias("start"), (p["stop"] + 1).alias("stop")))))


def gate() -> Column:
    """Whether a text holds a hint; it is lower-cased once."""

    def hinted(low: Column) -> Column:
        found = F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(f"cc[{_APART}]+by"))
        for hint in HINTS:
            found = F.contains(low, F.lit(hint)) | found
        return found

    return F.exists(F.array(F.lower("_text")), hinted)


def detections(docs: DataFrame) -> DataFrame:
    """_uid, doc_id, n_words and det, one row per detection of the texts that pass the gate (det null if none).

    det has the label, its rule's number and priority, its words and whether it is suppressed.
    """
    rows = docs.filter(gate()).withColumn("_uid", F.monotonically_increasing_id()).select("_uid", "doc_id", "n_words", _words(F.col("_text")).alias("_text"))
    each = rows.select("_uid", "doc_id", "n_words", F.explode_outer(_detections(F.col("_text"))).alias("d"))
    order = Window.partitionBy("_uid").orderBy("d.start", F.desc("d.stop"), F.desc("d.priority"), "d.rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in range(len(CONFIDENCE)):
        # what came before begins no later, so it holds this one if it ends no earlier
        reach = F.max(F.when(F.col("d.priority") >= level, F.col("d.stop"))).over(order)
        inside = inside | (F.col("d.priority").eqNullSafe(level) & F.coalesce(reach >= F.col("d.stop"), F.lit(False)))
    return each.withColumn("det", F.when(F.col("d").isNotNull(), F.struct("d.*", inside.alias("suppressed")))).drop("d")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document."""
    n_words = F.regexp_count("_text", F.lit(f"[^{_APART}]+")).cast("long")
    rows = docs.select("doc_id", text_of().alias("_text")).withColumn("n_words", n_words)
    nothing = F.lit(None).cast("long")
    plain = rows.filter(~gate()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), nothing.alias("first_word"), nothing.alias("last_word"),
                                        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    base, kept = F.col("det.base"), F.col("det.base") | ~F.col("det.suppressed")
    names = lambda where: F.array_join(F.sort_array(F.collect_set(F.when(where, F.col("det.label")))), ",")
    sure = F.element_at(F.array(*(F.lit(x) for x in CONFIDENCE)), F.col("det.priority") + 1)
    found = detections(rows).groupBy("_uid", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("det.start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("det.start"))).cast("long").alias("last_word"), names(base).alias("base_labels"), names(kept).alias("labels"),
        F.coalesce(F.max(F.when(kept, sure)), F.lit(0.0)).alias("score"))
    return plain.unionByName(found.drop("_uid"))
