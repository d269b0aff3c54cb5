"""License scans with ordered signature rules, as DataFrame expressions only.

A text becomes its lower-cased words, each in spaces of its own (` under  the  mit  license `), so that a regex
match always covers whole words and neighbouring matches never share a space. Rules are regexes over that form,
made from hand-written license names and sentence forms; each has a keyword, and a rule is tried on a text only
if the text has the keyword. Texts without any keyword, nearly all, are never normalised. All matches of the
tried rules become word intervals. An interval inside another one is suppressed, the longer wins; of equal
intervals the rule with the higher priority wins, then the smaller label. Overlaps without containment both stay.

Null and empty texts have no words and no labels. Repeated rows are scanned each by itself, an empty table gives
an empty result, extra columns are carried along and columns named like a result are replaced. Long texts are
scanned whole; only the list of a text's detections is held in its row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, table, without

#: Words to find wherever they stand consecutively, and their label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A run of word characters; both engines' regexes read it alike. On lower-cased text A-Z don't occur.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}


def _names() -> list[tuple[str, str, str]]:
    """(label, regex of the name, keyword): license names by family and version."""
    out = [
        ("mit", "(?:mit|expat)", "licen"), ("isc", "isc", "licen"), ("zlib", "zlib(?: libpng)?", "licen"), ("x11", "x11", "licen"),
        ("apache", "apache(?: software)?", "licen"), ("bsd", "bsd(?: style)?", "licen"), ("mpl", "mozilla public", "licen"), ("epl", "eclipse public", "licen"),
        ("boost-1", "boost software", "licen"), ("unlicense", "unlicense", "licen"), ("wtfpl", "wtfpl", "wtfpl"), ("artistic", "artistic", "licen"),
        ("eupl", "(?:eupl|european union public)", "licen"), ("ofl", "(?:sil )?open font", "licen"), ("cddl", "(?:cddl|common development and distribution)", "licen"),
        ("postgresql", "postgresql", "licen"), ("psf", "(?:psf|python software foundation)", "licen"), ("openssl", "openssl", "licen"), ("ruby", "ruby", "licen"),
        ("php", "php", "licen"), ("ncsa", "(?:ncsa|university of illinois)", "licen"), ("odbl", "(?:odbl|open database)", "licen"), ("vim", "vim", "licen"),
        ("gpl", "(?:gpl|gnu general public)", "gpl"), ("lgpl", "(?:lgpl|gnu lesser general public)", "gpl"), ("agpl", "(?:agpl|gnu affero general public)", "gpl"),
        ("gpl", "gnu general public", "licen"), ("lgpl", "gnu (?:lesser|library) general public", "licen"), ("agpl", "gnu affero general public", "licen"), ("gfdl", "gnu free documentation", "licen"),
    ]
    for n in "234":
        out.append((f"bsd-{n}-clause", f"(?:bsd {n} clause|{n} clause bsd)", "clause"))
    return out


def _versioned() -> list[tuple[str, str, str]]:
    out = []
    for family, name, versions in (
        ("gpl", "(?:gpl|(?:gnu )?general public license)", ("1", "2", "3")),
        ("lgpl", "(?:lgpl|(?:gnu )?lesser general public license)", ("2", "2 1", "3")),
        ("agpl", "(?:agpl|(?:gnu )?affero general public license)", ("1", "3")),
        ("apache", "apache(?: software)?(?: license)?", ("1", "1 1", "2")),
        ("mpl", "(?:mpl|mozilla public license)", ("1", "1 1", "2")),
        ("epl", "(?:epl|eclipse public license)", ("1", "2")),
        ("artistic", "artistic license", ("1", "2")),
        ("eupl", "eupl", ("1 1", "1 2")),
        ("cddl", "cddl", ("1", "1 1")),
        ("afl", "academic free license", ("2", "3")),
    ):
        key = "gpl" if family in ("gpl", "lgpl", "agpl") else "licen"
        for v in versions:
            label, version = f"{family}-{v.replace(' ', '.')}", f"(?: version| v)? v?{v}(?: 0)?"
            out.append((label, name + version, key))
            if key == "gpl":
                full = name.replace("gpl|", "").replace("?:l(", "?:(").replace("?:a(", "?:(")
                out += [(f"{label}-only", f"{full}{version} only", "licen"), (f"{label}-or-later", f"{full}{version} or(?: any)? later(?: version)?", "licen"), (label, full + version, "licen")]
                out.append((f"{label}-only", f"{name}{version} only", key))
                out.append((f"{label}-or-later", f"{name}{version} or(?: any)? later(?: version)?", key))
    for kind, long in _CC.items():
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}"
            out += [(label, f"cc {kind} {v}", " cc "), (label, f"creative commons {long}(?: license)? {v}", "commons")]
    return out


def rules() -> list[dict]:
    """All rules: label, priority, confidence, keyword and regex, in order of priority."""
    found: dict[tuple[str, str], dict] = {}

    def add(label: str, priority: int, confidence: float, keyword: str, words: str) -> None:
        pattern = f" {words.replace(' ?', chr(0)).replace(' ', '  ').replace(chr(0), '(?:  )?')} "
        found.setdefault((label, pattern), {"label": label, "priority": priority, "confidence": confidence, "keyword": keyword, "pattern": pattern})

    for phrase, label in BASE.items():
        add(label, 90, 0.95, {"cc by nc": " cc "}.get(phrase, "licen"), phrase)
    for label, name, key in _names():
        add(label, 80, 0.9, key, f"licensed under(?: the)?(?: terms of the)? {name}(?: license)?")
        add(label, 70, 0.85, key, f"(?:released|distributed|published|available|provided) under(?: the)?(?: terms of the)? {name} license")
        add(label, 50, 0.7, key, f"{name} license")
    for label, name, key in _versioned():
        add(label, 85, 0.95, key, f"(?:licensed|released|distributed|published) under(?: the)?(?: terms of the)? {name}")
        add(label, 60, 0.8, key, name)
    for a, b in product(("by", "by sa", "by nd", "by nc sa", "by nc nd"), ("",)):
        add(f"cc-{a.replace(' ', '-')}{b}", 55, 0.75, " cc ", f"cc {a}")
    for kind, long in _CC.items():
        add(f"cc-{kind.replace(' ', '-')}", 55, 0.8, "commons", f"creative commons {long}")
    for label, words, key in (
        ("cc0", "cc ?0(?: 1 0)?", "cc"), ("cc0", "creative commons zero", "commons"), ("public-domain", "(?:in|into|to) the public domain", "public  domain"),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
        ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose", "permission"),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
        ("bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors may be used", "contributors"),
        ("zlib", "this software is provided as is without any express or implied warranty in no event", "warranty"),
        ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
        ("gpl", "this program is free software you can redistribute it and or modify", "redistribute"),
        ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "licen"),
        ("boost-1", "boost software license version 1 0", "licen"), ("proprietary", "all rights reserved", "rights  reserved"), ("proprietary", "proprietary and confidential", "confidential"),
        ("proprietary", "no part of this (?:book|publication|work) may be reproduced", "reproduced"),
    ):
        add(label, 88, 0.97, key, words)
    for label in sorted({r["label"] for r in found.values() if r["label"] not in ("proprietary", "public-domain")}):
        add(label, 95, 0.99, "spdx", "spdx license identifier " + label.replace("-", " ").replace(".", " "))
    return sorted(found.values(), key=lambda r: (-r["priority"], r["label"], r["pattern"]))


#: A text is normalised if its lower-cased form contains one of these, or CC in front of a further word.
GATES = ("licen", "gpl", "wtfpl", "clause", "commons", "domain", "permission", "redistribut", "contributors", "warranty", "reserved", "confidential", "reproduced", "spdx", "unencumbered")
_CC_GATE = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]*(?:by|0)"
NEW = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
_H = "__quirelake_"


def _count(s: Column) -> Column:
    """Words in a piece of normalised text: every word has two spaces."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def _intervals(s: Column, r: Column) -> Column:
    """All places of a rule in the text, as word intervals.

    Matches are marked in the text, so their first and last words are found by one pass over its words.
    """
    inner = F.concat(F.lit(" ("), F.substring(r["pattern"], F.lit(2), F.length(r["pattern"]) - 2), F.lit(") "))
    marked = F.regexp_replace(s, inner, F.lit(" \u0001$1\u0002 "))

    def places(words: Column) -> Column:
        at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        both = F.arrays_zip(at("\u0001").alias("first"), at("\u0002").alias("last"))
        return F.transform(both, lambda x: F.struct(x["first"].cast("long").alias("first"), (x["last"] + 1).cast("long").alias("end"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    none = F.array().cast("array<struct<first:bigint,end:bigint,rank:int,label:string,confidence:double>>")
    return F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit("\u0001")), places(F.split(F.btrim(m), "  "))).otherwise(none))[0]


def _kept(places: Column) -> Column:
    """Places that lie in no other; sorted by start and falling end, so one running maximum tells."""
    keyed = F.array_sort(F.transform(places, lambda x: F.struct(x["first"], (-x["end"]).alias("back"), x["rank"], x["label"], x["confidence"])))
    kind = "array<struct<first:bigint,back:bigint,rank:int,label:string,confidence:double>>"
    zero = F.struct(F.lit(-1).cast("long").alias("to"), F.array().cast(kind).alias("out"))
    step = lambda a, x: F.when(-x["back"] <= a["to"], a).otherwise(F.struct((-x["back"]).alias("to"), F.concat(a["out"], F.array(x)).alias("out")))
    kept = F.aggregate(keyed, zero, step, lambda a: a["out"])
    return F.transform(kept, lambda x: F.struct(x["label"], x["first"].alias("first_word"), (-x["back"] - 1).alias("last_word"), x["confidence"]))


def scan(df: DataFrame, text: str = "text", signatures: list[dict] | None = None) -> DataFrame:
    """df with word and base columns, all labels, a score (the best confidence) and the kept detections."""
    signatures = rules() if signatures is None else signatures
    carried = without(df, NEW).columns
    hid = lambda n: F.col(_H + n)
    low = F.lower(hid("t"))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(low, F.lit(word))
    gate = gate | (F.contains(low, F.lit("cc")) & low.rlike(_CC_GATE))
    words = F.regexp_extract_all(ascii_lower(hid("t")), F.lit(LICENSE_WORD), F.lit(0))
    df = df.withColumn(_H + "t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumns({_H + "n": F.regexp_count(hid("t"), F.lit(ANY_CASE_WORD)).cast("long"), _H + "s": F.when(gate, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))})
    table_of = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["priority"]).alias("priority"), F.lit(r["confidence"]).alias("confidence"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["pattern"]).alias("pattern")) for r in signatures])
    s = hid("s")
    tried = F.filter(table_of, lambda r: F.contains(s, r["keyword"]))
    df = df.withColumn(_H + "d", F.when(s.isNotNull(), _kept(F.flatten(F.transform(tried, lambda r: _intervals(s, r))))))
    n_base, firsts, lasts, base = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE.items():
        spaced = f" {phrase.replace(' ', '  ')} "
        has = F.contains(s, F.lit(spaced))
        n_base = n_base + F.when(has, F.size(F.split(s, spaced, -1)).cast("long") - 1).otherwise(0)
        firsts.append(F.when(has, _count(F.substring_index(s, spaced, 1))))
        lasts.append(F.when(has, hid("n") - _count(F.substring_index(s, spaced, -1)) - len(phrase.split())))
        base.append(F.when(has, F.lit(label)))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*base))))
    found = F.coalesce(hid("d"), F.array().cast("array<struct<label:string,first_word:bigint,last_word:bigint,confidence:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(found, lambda x: x["label"]))))
    return df.select(
        *[F.col(f"`{c}`") for c in carried], hid("n").alias("n_words"), F.when(s.isNull(), F.lit(0).cast("long")).otherwise(n_base).alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce(F.array_max(F.transform(found, lambda x: x["confidence"])), F.lit(0.0)).alias("score"), found.alias("detections"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places and labels of licenses."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def sql() -> str:
    values = ",\n".join(f"('{r['label']}', {r['priority']}, cast({r['confidence']} as double), '{r['keyword']}', '{r['pattern']}')" for r in rules())
    phrases = ", ".join(f"(' {p.replace(' ', '  ')} ', '{label}', {len(p.split())})" for p, label in BASE.items())
    words = lambda x: f"cast((length({x}) - length(replace({x}, ' ', ''))) / 2 as bigint)"
    return rf"""
with t as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}') w from documents),
s as (select r, doc_id, cast(len(w) as bigint) n_words, ' ' || array_to_string(w, '  ') || ' ' s from t),
p(phrase, label, size) as (values {phrases}),
b as (select r, cast(sum(len(string_split(s, phrase)) - 1) as bigint) n_base,
             min({words("string_split(s, phrase)[1]")}) first_word, max(n_words - {words("string_split(s, phrase)[-1]")} - size) last_word,
             array_to_string(list_sort(list(distinct label)), ',') base_labels, list(distinct label) base_list
      from s join p on contains(s, phrase) group by r),
rules(label, priority, confidence, keyword, pattern) as (values {values}),
m as (select r, label, priority, confidence, regexp_extract_all(s, pattern) m, string_split_regex(s, pattern) g
      from s join rules on contains(s, keyword) and regexp_matches(s, pattern)),
u as (select r, label, priority, confidence, m, g, unnest(range(1, len(m) + 1)) k from m),
i as (select r, label, priority, confidence, list_sum(list_transform(g[:k], lambda x: {words("x")})) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: {words("x")})), 0) f, {words("m[k]")} n from u),
d as (select *, max(f + n) over (partition by r order by f, n desc, priority desc, label rows between unbounded preceding and 1 preceding) top from i),
k as (select r, list(distinct label) found, max(confidence) score from d where top is null or f + n > top group by r)
select doc_id, n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base_list, []) || coalesce(found, []))), ',') labels, coalesce(score, 0.0) score
from s left join b using (r) left join k using (r)
"""
