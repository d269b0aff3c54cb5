"""Quality rules as a short-circuit cascade of Catalyst expressions.

Rules are plain Column expressions over the text and the counts that the result has anyway; what a rule counts for
itself is part of the rule and evaluated where the cascade comes to it. On a bounded random sample of texts each
rule's cost (seconds a row with all that it counts, less those of a rule that rejects nothing) and selectivity (share
rejected) are measured; the cascade then tests rules in falling order of rejections per cost inside one CASE, so a row
that an early rule rejects never evaluates the later, dearer ones. The order moves cost only: the verdict is the
conjunction of all rules whatever their order, so reruns agree and ties in cost don't matter.

Nulls and empty texts have no words: they fail the length rule. Repeated rows are judged each by itself, an
empty table gives an empty result, and extra columns are carried along; columns named like a result are
replaced. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WHITE, WORD, table, without

#: Words in a repeated window, and the limits of the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Rows that cost and selectivity are measured on.
SAMPLE_ROWS = 500

#: Prefix of columns that live only inside the operator.
HIDDEN = "__quirelake_"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _hidden(name: str) -> Column:
    return F.col(f"{HIDDEN}{name}")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window found twice or more in the array, the first occurrence included.

    Window names are 64-bit hashes of the names of k words, read by index (a slice would copy the whole array). Texts without an equal pair of windows, nearly all, stop after
    one hash-set pass; the rest sort (name, place), keep places next to an equal name and measure their union.
    """

    def covered(names: Column) -> Column:
        def places(pairs: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
                return same(i - 1) | same(i + 1)

            return F.array_sort(F.transform(F.filter(pairs, twin), lambda x: x["i"]))

        pairs = F.array_sort(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = _let(pairs, places)
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, b: a + b))

    def windows(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])), 1, F.size(h) - (k - 1))

    names = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= k, 0).otherwise(_let(names, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), 0).otherwise(covered(n)))).cast("long")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with hidden columns: the text, its features and its number of lines with a word."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(_hidden("t"), "\n", -1), lambda line: line.rlike(WORD))
    inner = F.btrim(_hidden("t"), F.lit(WHITE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))
    w, ln = _hidden("w"), _hidden("l")
    df = df.withColumn(f"{HIDDEN}t", t).withColumns({f"{HIDDEN}w": words, f"{HIDDEN}l": lines})
    found = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.concat_ws("", w)),
        "n_symbols": F.regexp_count(_hidden("t"), F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_lines": F.size(ln),
        "n_repeat_words": repeated_words(w),
    }
    return df.withColumns({f"{HIDDEN}{k}": v.cast("long") for k, v in found.items()}).drop(f"{HIDDEN}w", f"{HIDDEN}l")


#: What each rule rejects; names in braces are features. Case is looked at in A-Z only, so scripts without case
#: never shout, and any non-ASCII character counts as part of a word, not as a bare one.
PREDICATES = {
    "symbols": "5 * {n_symbols} > {n_words}",
    "duplicate_lines": "100 * {n_dup_lines} > 30 * {n_lines}",
    "word_length": "2 * {word_chars} < 5 * {n_words} or {word_chars} > 20 * {n_words}",
    "shouting": "4 * {n_upper_pairs} > {word_chars}",
    "digits": "2 * {n_digits} > {word_chars}",
    "ellipses": "10 * {n_ellipses} > 3 * {n_words}",
    "markup": "5 * {n_braces} > {n_words}",
    "links": "5 * {n_links} > {n_words}",
}
#: Patterns that only one rule counts.
COUNTED = {"n_upper_pairs": "[A-Z][A-Z]", "n_digits": "[0-9]", "n_ellipses": "[.][.][.]", "n_braces": "[{}]", "n_links": "https?://"}
LAZY = {k: f"regexp_count({HIDDEN}t, '{v}')" for k, v in COUNTED.items()}


@dataclass(frozen=True)
class Rule:
    """`fails` is true for rows that the rule rejects."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    names = {k: f"{HIDDEN}{k}" for k in [*FEATURES, "n_lines"]} | LAZY
    return [Rule(k, F.expr(v.format(**names))) for k, v in PREDICATES.items()]


def base_failed() -> Column:
    n, r = _hidden("n_words"), _hidden("n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def order_rules(df: DataFrame, found: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost, selectivity) by falling rejections per cost, measured on about `rows` rows drawn at random.

    The sample holds texts, not features, so a rule's time has all that it counts; the time of a rule that rejects
    nothing, which is the job's own, is taken off.
    """
    total = df.count()
    sample = df.select(F.col(f"`{text}`").alias("t")).sample(fraction=min(1.0, 1.2 * rows / max(1, total)), seed=11).persist()

    def timed(rule: Rule) -> tuple[float, int]:
        features = text_features(sample, "t")
        began = time.perf_counter()
        hit = features.agg(F.count_if(rule.fails)).first()[0]
        return time.perf_counter() - began, hit

    try:
        n = max(1, sample.count())
        idle = Rule("none", F.lit(False))
        timed(idle)
        own = timed(idle)[0]
        out = []
        for rule in found:
            took, hit = timed(rule)
            out.append((rule, max(took - own, 1e-4) / n, hit / n))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: -(x[2] + 1e-6) / x[1])


def cascade(ordered: list[Rule]) -> Column:
    """True where some rule rejects: CASE stops at the first that does."""
    out = F.lit(False)
    for rule in reversed(ordered):
        out = F.when(rule.fails, True).otherwise(out)
    return out


def apply_rules(df: DataFrame, text: str = "text", found: list[Rule] | None = None, measure: bool = True) -> DataFrame:
    """df with the features, base_failed and kept."""
    found = rules() if found is None else found
    carried = [c for c in without(df, [*FEATURES, "base_failed", "kept"]).columns]
    features = text_features(df, text)
    ordered = [r for r, _, _ in order_rules(df, found, text)] if measure else found
    f = features.withColumn(f"{HIDDEN}base", base_failed())
    kept = F.when(_hidden("base"), False).otherwise(~cascade(ordered))
    return f.select(*[F.col(f"`{c}`") for c in carried], *[_hidden(c).alias(c) for c in FEATURES], _hidden("base").alias("base_failed"), kept.alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether the rules keep it."""
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *FEATURES, "base_failed", "kept")


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key


_SAME = _Same()
_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{_W}') w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) l from t),
win as (select r, i, list_slice(w, i, i + {WINDOW - 1}) g
        from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) i from w)),
twin as (select r, i from win qualify count(*) over (partition by r, g) > 1),
cov as (select r, cast(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as bigint) n
        from (select r, i, lead(i) over (partition by r order by i) nxt from twin) group by r),
f as (select w.r, doc_id, cast(len(w) as bigint) n_words, cast(length(list_aggregate(w || [''], 'string_agg', '')) as bigint) word_chars,
             cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
             cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, len(l) n_lines,
             coalesce(cov.n, 0) n_repeat_words,
             {", ".join(f"len(regexp_extract_all(t, '{v}')) {k}" for k, v in COUNTED.items())}
      from w left join cov on cov.r = w.r),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or {" or ".join(f"({p.format_map(_SAME)})" for p in PREDICATES.values())}) kept
from b
"""
