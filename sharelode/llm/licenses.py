"""License scan by ordered signature rules, all in built-in expressions.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over its
words joined by one space. A first expression over the raw text keeps texts without any
license word out of all further work. Of the rest a rule is tried only if its keyword is
there. Both follow from the patterns, so they lose no match. Each match is an interval with its rule's priority; a match that lies within one
of at least its priority, or overlaps one of a higher priority, is suppressed. Matches are put in order
and compared only within groups that hang together by overlap, so the work of a text grows with its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.llm.common import only

# What the base counts as a license phrase, and its label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of text as it is
# What is between words, as the inside of a character class.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
# Texts that let a rule's matches through the gate, and what the gate then looks for.
_MARKS = {"licen": None, "spdx": "spdx", "copyleft": "copyleft", "public domain": "public domain",
          "creativecommons": "creative ?commons", "creative": "creative ?commons"}

# label, names, short names, how its address goes on, versions. Names are words joined by one space.
_LICENSES = [
    ("gpl", "(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl", "gnu org (?:copyleft|licenses(?: old licenses)?) gpl", ["1", "2", "3"]),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", "gnu org licenses(?: old licenses)? lgpl", ["2", "2.1", "3"]),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", "gnu org licenses agpl", ["1", "3"]),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e", "(?:gnu )?gfdl", "gnu org licenses fdl", ["1.1", "1.2", "1.3"]),
    ("apache", "apache(?: software)? licen[cs]e", "apache", "apache org licenses licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mit", "(?:mit|expat)(?: x11)? licen[cs]e", "mit", "opensource org licenses mit", []),
    ("bsd", "(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e", "bsd", "opensource org licenses bsd licen[cs]e", []),
    ("bsd-2-clause", "(?:2|two) clause bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?", "bsd 2 clause", "opensource org licenses bsd 2 clause", []),
    ("bsd-3-clause", "(?:3|three) clause bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?", "bsd 3 clause", "opensource org licenses bsd 3 clause", []),
    ("0bsd", "(?:zero clause|0 clause) bsd licen[cs]e", "0bsd", "opensource org licenses 0bsd", []),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mozilla org mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse public licen[cs]e", "epl", "eclipse org legal epl", ["1.0", "2.0"]),
    ("eupl", "european union public licen[cs]e", "eupl", "joinup ec europa eu [a-z ]*eupl", ["1.0", "1.1", "1.2"]),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "opensource org licenses cddl", ["1.0", "1.1"]),
    ("cpl", "common public licen[cs]e", "cpl", "opensource org licenses cpl", ["1.0"]),
    ("osl", "open software licen[cs]e", "osl", "opensource org licenses osl", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic free licen[cs]e", "afl", "opensource org licenses afl", ["1.1", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic licen[cs]e", "artistic", "opensource org licenses artistic", ["1.0", "2.0"]),
    ("isc", "isc licen[cs]e", "isc", "opensource org licenses isc", []),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses zlib", []),
    ("unlicense", "the unlicense", "unlicense", "unlicense org", []),
    ("wtfpl", "do what the [a-z]+ you want to public licen[cs]e", "wtfpl", "wtfpl net", []),
    ("boost", "boost software licen[cs]e", "bsl", "boost org licen[cs]e 1 0", ["1.0"]),
    ("ofl", "(?:sil )?open font licen[cs]e", "(?:sil )?ofl", "scripts sil org ofl", ["1.0", "1.1"]),
    ("odbl", "open (?:data commons )?(?:open )?database licen[cs]e", "odbl", "opendatacommons org licenses odbl", ["1.0"]),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", "opendatacommons org licenses by", ["1.0"]),
    ("pddl", "public domain dedication and licen[cs]e", "pddl", "opendatacommons org licenses pddl", ["1.0"]),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl", []),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl", []),
    ("upl", "universal permissive licen[cs]e", "upl", "opensource org licenses upl", ["1.0"]),
    ("ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", "opensource org licenses ncsa", []),
    ("psf", "python software foundation licen[cs]e", "psf", "docs python org 3 licen[cs]e", ["2"]),
    ("php", "php licen[cs]e", "php", "php net licen[cs]e", ["3.0", "3.01"]),
    ("ruby", "ruby licen[cs]e", "ruby", "ruby lang org en about licen[cs]e", []),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl org source licen[cs]e", []),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql", []),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", "w3c", "w3 org consortium legal", []),
    ("x11", "x11 licen[cs]e", "x11", "spdx org licenses x11", []),
    ("ecl", "educational community licen[cs]e", "ecl", "opensource org licenses ecl", ["1.0", "2.0"]),
    ("cecill", "cecill(?: free software)? licen[cs]e", "cecill", "cecill info licences", ["1.0", "1.1", "2.0", "2.1"]),
    ("ipl", "ibm public licen[cs]e", "ipl", "opensource org licenses ipl", ["1.0"]),
    ("lppl", "latex project public licen[cs]e", "lppl", "latex project org lppl", ["1.0", "1.2", "1.3"]),
    ("qpl", "q public licen[cs]e", "qpl", "opensource org licenses qpl", ["1.0"]),
    ("vim", "vim licen[cs]e", "vim", "vimhelp org uganda", []),
    ("sspl", "server side public licen[cs]e", "sspl", "mongodb com licensing server side public licen[cs]e", ["1"]),
    ("busl", "business source licen[cs]e", "busl", "mariadb com bsl", ["1.1"]),
    ("elastic", "elastic licen[cs]e", "elastic", "elastic co licensing elastic licen[cs]e", ["2.0"]),
    ("openrail", "(?:creativeml )?open ?rail(?: [ms])? licen[cs]e", "openrail", "bigscience huggingface co blog the bigscience rail licen[cs]e", []),
    ("llama", "llama [0-9]* ?community licen[cs]e", "llama[0-9]*", "ai meta com llama licen[cs]e", []),
]
# Creative Commons: the conditions, spelled out and short.
_COMMONS = [
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?", "by nd"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "by nc nd"),
]
_COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_OTHERS = [
    ("cc0", 90, "cc ?(?:0|zero)(?: 1 0)?(?: universal)?"),
    ("cc0", 90, "creativecommons org publicdomain zero"),
    ("public-domain", 70, "(?:dedicated to|released (?:in)?to|placed in|in) the public domain"),
    ("public-domain", 50, "public domain"),
    ("all-rights-reserved", 60, "all rights reserved"),
    ("proprietary", 70, "proprietary licen[cs]e|end user licen[cs]e agreement|commercial licen[cs]e"),
    ("no-warranty", 30, "without (?:any )?warranty|without warranties or conditions"),
    ("permission-notice", 40, "permission is hereby granted free of charge"),
    ("unknown-license", 20, "(?:licen[cs]ed|released|distributed|published) under"),
    ("unknown-license", 10, "(?:open source|free software|content) licen[cs]e"),
    ("copyleft", 30, "copyleft"),
]

# Values that one step of a running sum or maximum goes over.
_STEP = 128
_SPAN = "struct<from:int,to:int,priority:int,place:int,label:string>"

_GRANT = "(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
_VERSION = "(?: version| v)? ?"


def _texts(pattern: str) -> list[str]:
    """Texts that every match contains, in order; the first starts it and the last ends it (both may be empty)."""
    alternatives, texts, at = [], [""], 0
    while at < len(pattern):
        if pattern[at] == "|":
            alternatives, texts, at = [*alternatives, texts], [""], at + 1
            continue
        if pattern[at] == "(":
            end, depth = at + 1, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            inner = _texts(pattern[at + len("(?:"):end - 1])
        elif pattern[at] == "[":
            end, inner = pattern.index("]", at) + 1, ["", ""]
        else:
            end, inner = at + 1, [pattern[at]]
        if pattern[end:end + 1] in ("?", "*", "+"):
            end, inner = end + 1, ["", ""]
        texts = [*texts[:-1], texts[-1] + inner[0], *inner[1:]]
        at = end
    if not alternatives:
        return texts
    parts = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    shared = [p for p in parts if all(any(p in t for t in other) for other in alternatives)]
    return ["", max(shared, key=lambda p: (len(p), p), default=""), ""]


def _keyword(pattern: str) -> str:
    """The longest text that every match contains."""
    return max(_texts(pattern), key=len)


def rules() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword and pattern of each rule; an earlier rule wins among equals."""
    made = []
    for label, name, short, address, versions in _LICENSES:
        for version in versions:
            number = version.replace(".", " ")
            if number.endswith(" 0"):
                number = f"{number[:-2]}(?: 0)?"
            made += [
                (f"{label}-{version}", 95, f"spdx licen[cs]e identifier {short} {number}(?: (?:only|or later))?"),
                (f"{label}-{version}", 85, f"(?:{_GRANT})?(?:{name}){_VERSION}{number}"),
                (f"{label}-{version}", 80, f"{address} {number}"),
                (f"{label}-{version}", 75, f"{_GRANT}{short}{_VERSION}{number}"),
            ]
        made += [
            (label, 90, f"spdx licen[cs]e identifier {short}"),
            (label, 75, address),
            (label, 70, f"{_GRANT}(?:{name})"),
            (label, 70, f"{_GRANT}{short}"),
            (label, 65, f"(?:{name})"),
        ]
    for label, name, short in _COMMONS:
        for version in _COMMONS_VERSIONS:
            number = version.replace(".", " ")
            made += [
                (f"{label}-{version}", 92, f"cc {short}{_VERSION}{number}"),
                (f"{label}-{version}", 90, f"creative ?commons {name}{_VERSION}{number}"),
            ]
        made += [
            (label, 85, f"creativecommons org licenses {short}"),
            (label, 80, f"creative commons {name}"),
            (label, 80, f"cc {short}"),
        ]
    return [(label, priority, _keyword(pattern), pattern) for label, priority, pattern in made + _OTHERS]


def _gate() -> str:
    """An expression over text as it is that finds something in each text in which a rule or base phrase matches.

    It looks for the marks, and for the whole pattern of a rule that has none. All but the
    license word start a word, as matches do.
    """
    whole: dict[str, None] = {}
    marks = set()
    for _, _, _, pattern in rules():
        mark = next((m for m in _MARKS if any(m in t for t in _texts(pattern))), None)
        if mark is None:
            whole[pattern] = None
        elif _MARKS[mark]:
            marks.add(_MARKS[mark])
    # A pattern that goes on where a shorter one ends adds nothing.
    least = [p for p in whole if not any(p != q and "|" not in re.sub(r"\(.*?\)", "", q) and p.startswith(q) for q in whole)]
    granted = [p.removeprefix(_GRANT) for p in least if p.startswith(_GRANT)]
    starts = [*sorted(marks), *(p for p in least if not p.startswith(_GRANT)), f"{_GRANT}(?:{'|'.join(granted)})"]

    def spread(piece: re.Match) -> str:
        if piece[0][0] == "[":
            return piece[0].replace(" ", _BETWEEN)
        return f"[{_BETWEEN}]" + ("*" if piece[0] == " ?" else "+")

    return f"(?i)licen[cs]|(?<![0-9a-z])(?:{re.sub(r'\[[^]]*\]| \??', spread, '|'.join(starts))})"


_GATE = _gate()


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licenses that each document names.

    One row per input row: `doc_id`, `n_words`, of the base phrases `n_base`, `first_word`,
    `last_word` (null without any) and `base_labels`, all `labels`, `score` (the highest
    priority among the detections that are left, from 0 to 1) and `detections`, which are
    structs of label, priority, and first and last character among the words joined by one
    space and set between spaces.

    A null text is empty and gives no places, empty labels and a score of 0. Repeated rows and null
    ids are scanned like any others; an empty table gives an empty result. Whole texts are
    searched, whatever their length. Other columns are not looked at.
    """
    rows = only(docs, doc_id=id_column, text=text_column)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.when(text.rlike(_GATE), F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)))
    return (
        rows.select("doc_id", F.regexp_count(text, F.lit(_RAW_WORD)).cast("long").alias("n_words"),
                    words.alias("words"))
        .withColumn("marks", F.transform("words", _base_label))
        .withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
        .withColumn("found", _found(F.col("joined")))
        .withColumn("places", F.filter(
            F.transform("marks", lambda m, i: F.when(m.isNotNull(), i.cast("long"))), lambda p: p.isNotNull()))
        .withColumn("detections", _left(F.col("found")))
        .withColumn("base", F.array_sort(F.array_distinct(F.filter("marks", lambda m: m.isNotNull()))))
        .select(
            "doc_id", "n_words",
            F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
            F.get("places", F.lit(0)).alias("first_word"),
            F.get("places", F.size("places") - 1).alias("last_word"),
            _joined(F.col("base")).alias("base_labels"),
            _joined(F.array_sort(F.array_distinct(F.concat("base", F.col("detections.label"))))).alias("labels"),
            F.coalesce(F.array_max(F.col("detections.priority")) / 100, F.lit(0.0)).alias("score"),
            "detections",
        )
    )


def _joined(labels: Column) -> Column:
    return F.coalesce(F.array_join(labels, ","), F.lit(""))


def _base_label(word: Column, place: Column) -> Column:
    """Label of the base phrase that starts at this word, or null."""
    label = F.lit(None).cast("string")
    for phrase, name in reversed(BASE):
        first, *rest = phrase.split(" ")
        here = word == first
        for i, other in enumerate(rest, 1):
            here = here & (F.get("words", place + i) == other)
        label = F.when(here, F.lit(name)).otherwise(label)
    return label


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array with values, the merged values up to it.

    An array that grows by one is copied each time, so this goes block by block, then over the blocks.
    """
    def along(block: Column) -> Column:
        return F.aggregate(F.slice(block, F.lit(2), F.size(block)), F.slice(block, 1, 1),
                           lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(_STEP)), lambda first: F.transform(
            F.sequence(first, F.least(first + _STEP, F.size(all_)) - 1), lambda i: F.get(all_, i)))

    def joined(parts: Column, ends: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part, i: F.transform(
            part, lambda x: F.when(i == 0, x).otherwise(merge(F.get(ends, i - 1), x)))))

    return _let(values, lambda all_: _let(
        F.transform(blocks(all_), along),
        lambda parts: _let(_let(F.transform(parts, lambda part: F.element_at(part, -1)), along),
                           lambda ends: joined(parts, ends))))


def _found(joined: Column) -> Column:
    """All matches of all rules whose keyword is in the text."""
    # One literal; the optimizer reads it once for all rows.
    table = F.from_json(F.lit(json.dumps([
        {"label": label, "priority": priority, "place": place, "keyword": keyword, "pattern": f"(?<= )(?:{pattern})(?= )"}
        for place, (label, priority, keyword, pattern) in enumerate(rules())
    ])), "array<struct<label:string,priority:int,place:int,keyword:string,pattern:string>>")
    likely = F.filter(table, lambda r: F.contains(joined, r["keyword"]))
    return F.flatten(F.transform(likely, lambda r: _let(
        F.regexp_extract_all(joined, r["pattern"], F.lit(0)),
        lambda matches: F.when(F.size(matches) > 0, _spans(joined, r, matches)).otherwise(F.array().cast(f"array<{_SPAN}>")))))


def _spans(joined: Column, rule: Column, matches: Column) -> Column:
    steps = F.zip_with(F.split(joined, rule["pattern"], -1), matches,
                       lambda gap, match: F.length(gap) + F.coalesce(F.length(match), F.lit(0)))
    return _let(_running(steps, lambda n, x: n + x), lambda ends: F.transform(matches, lambda match, i: F.struct(
        (F.get(ends, i) - F.length(match)).alias("from"), F.get(ends, i).alias("to"),
        rule["priority"].alias("priority"), rule["place"].alias("place"), rule["label"].alias("label"))))


def _left(found: Column) -> Column:
    """The matches that no other one suppresses, in order."""
    def group(all_: Column, starts: Column) -> Column:
        return F.transform(starts, lambda first, k: F.transform(
            F.sequence(first, F.coalesce(F.get(starts, k + 1), F.size(all_)) - 1), lambda i: F.get(all_, i)))

    def starts(all_: Column, reach: Column) -> Column:
        """Where a match starts behind the ends of all before it."""
        return F.filter(F.sequence(F.lit(0), F.size(all_) - 1),
                        lambda i: (i == 0) | (F.get(all_, i)["from"] >= F.get(reach, i - 1)))

    def kept(all_: Column) -> Column:
        groups = _let(_running(F.transform(all_, lambda d: d["to"]), F.greatest),
                      lambda reach: _let(starts(all_, reach), lambda s: group(all_, s)))
        return F.flatten(F.transform(groups, lambda members: F.filter(
            members, lambda d: ~F.exists(members, lambda o: _suppresses(o, d)))))

    return F.when(F.size(found) > 0, _let(F.sort_array(found), kept)).otherwise(found)


def _suppresses(other: Column, found: Column) -> Column:
    """Whether `other` keeps `found` out of the result."""
    higher = other["priority"] > found["priority"]
    same = other["priority"] == found["priority"]
    inside = (other["from"] <= found["from"]) & (other["to"] >= found["to"])
    longer = (other["to"] - other["from"]) > (found["to"] - found["from"])
    before = (other["from"] == found["from"]) & (other["to"] == found["to"]) & (other["place"] < found["place"])
    overlaps = (other["from"] < found["to"]) & (other["to"] > found["from"])
    return (overlaps & higher) | (inside & same & (longer | before))
