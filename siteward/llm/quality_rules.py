"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes for quality (1), against it (-1) or not at all (0). Nobody says how good the
rules are: expectation-maximisation estimates, for texts of good and of bad quality, how likely each rule's vote is, from
the votes alone, and each text gets the posterior probability that it is good. The documents are read once; what the
estimate needs of them is how often each combination of votes occurs, at most 3 ** len(RULES) rows at any input size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name: (condition to vote against, condition to vote for) in SQL over the counts below.
RULES = {
    "symbols": ("n_symbols * 100 >= 3 * word_chars", "false"),
    "dup_lines": ("n_dup_lines * 100 >= 40 * n_lines AND n_lines > 0", "false"),
    "repeats": ("n_repeat_words * 100 > 20 * n_words", "false"),
    "capitals": ("n_capitals * 100 >= 30 * word_chars", "false"),
    "word_length": ("word_chars * 10 < 30 * n_words OR word_chars * 10 > 100 * n_words", "word_chars * 10 >= 35 * n_words AND word_chars * 10 <= 75 * n_words"),
    "length": ("n_words < 10", "n_words >= 50"),
    "sentences": ("n_sentences = 0 AND n_words >= 60", "n_sentences * 60 >= n_words"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
ROUNDS = 12
SMOOTH = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that the array has twice or more, the first time included."""
    n = F.size(words) - (width - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
        twice = let(by_hash, lambda s: F.filter(s, lambda e, k: F.coalesce(same(s, e, k), F.when(k == 0, F.get(s, k + 1)["h"] == e["h"]).otherwise(F.get(s, k - 1)["h"] == e["h"]), F.lit(False))))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0)))
    return F.when(n >= 2, some).otherwise(F.lit(0)).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that the rules look at. Null texts count as empty; clashing columns are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumns({"_sw_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_sw_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_sw_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_sw_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_sw_lines").cast("long"),
            "n_dup_lines": (F.size("_sw_lines") - F.size(F.array_distinct("_sw_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_sw_words")),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_sentences": F.regexp_count(F.concat(text, F.lit(" ")), F.lit(r"[.!?][\x20\x09-\x0D]")).cast("long"),
        }
    )
    return out.drop("_sw_words", "_sw_lines")


def with_votes(counted: DataFrame) -> DataFrame:
    """counted with base_failed and a column vote_<rule> of -1, 0 or 1 for each rule."""
    votes = {f"vote_{k}": F.expr(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END") for k, (no, yes) in RULES.items()}
    return counted.withColumns({"base_failed": F.expr(BASE_FAILED), **votes})


def log_odds(model: dict) -> Column:
    """log(P(good) / P(bad)) of a row's votes."""
    out = F.lit(model["prior"])
    for k in RULES:
        w = model[k]
        out = out + F.when(F.col(f"vote_{k}") < 0, w[-1]).when(F.col(f"vote_{k}") > 0, w[1]).otherwise(w[0])
    return out


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over how often each combination of votes occurs: {"prior": log odds of good, rule: {vote: log
    ratio of the vote's probabilities in good and in bad texts}}. It begins with 0.9 good where no rule votes against and
    0.1 elsewhere. Without rows all is 0."""
    names = [f"vote_{k}" for k in RULES]
    patterns = materialize(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "votes")
    good = F.when(F.least(*names) < 0, 0.1).otherwise(0.9)
    model: dict = {}
    for _ in range(rounds):
        g, b = F.col("n") * good, F.col("n") * (1 - good)
        sums = [F.sum(g).alias("g"), F.sum(b).alias("b")]
        sums += [F.sum(F.when(F.col(f"vote_{k}") == v, w)).alias(f"{k}{v}{s}") for k in RULES for v in (-1, 0, 1) for s, w in (("g", g), ("b", b))]
        row = patterns.agg(*sums).first().asDict()
        at = lambda x: row[x] or 0.0
        all_g, all_b = at("g") + 3 * SMOOTH, at("b") + 3 * SMOOTH
        model = {"prior": math.log((at("g") + SMOOTH) / (at("b") + SMOOTH))}
        for k in RULES:
            model[k] = {v: math.log((at(f"{k}{v}g") + SMOOTH) / all_g) - math.log((at(f"{k}{v}b") + SMOOTH) / all_b) for v in (-1, 0, 1)}
        good = 1 / (1 + F.exp(-log_odds(model)))
    discard(patterns)
    return model


def judged(voted: DataFrame, model: dict) -> DataFrame:
    """voted with p_good and kept: base_failed is false and good quality is at least as likely as bad."""
    odds = log_odds(model)
    return voted.withColumns({"p_good": 1 / (1 + F.exp(-odds)), "kept": ~F.col("base_failed") & (odds >= 0)})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, votes, p_good, kept. Null and empty texts fail; equal
    rows stay apart; an empty table gives an empty one."""
    voted = with_votes(with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))).drop("text")
    voted = materialize(voted, "quality")
    return judged(voted, fit(voted))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    own = F.struct(*docs.columns).alias("_sw_row")
    voted = materialize(with_votes(with_counts(docs.select(own, F.col(text_col).alias("text")))).drop("text"), "quality")
    return judged(voted, fit(voted)).where("kept").select("_sw_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL: counts from lists, the repeats by windows with positions, and a pair of CTEs for each round."""
    votes = ", ".join(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END AS vote_{k}" for k, (no, yes) in RULES.items())
    names = ", ".join(f"vote_{k}" for k in RULES)
    long = " UNION ALL ".join(f"SELECT id, n, '{k}' AS rule, vote_{k} AS vote FROM patterns" for k in RULES)
    rounds = "".join(
        f""",
ends{t} AS (SELECT sum(n * good) AS g, sum(n * (1 - good)) AS b FROM patterns JOIN post{t} USING (id)),
theta{t} AS (SELECT rule, vote, ln((sum(n * good) + {SMOOTH}) / (any_value(g) + 3 * {SMOOTH})) - ln((sum(n * (1 - good)) + {SMOOTH}) / (any_value(b) + 3 * {SMOOTH})) AS w
  FROM votes JOIN post{t} USING (id), ends{t} GROUP BY rule, vote),
odds{t} AS (SELECT id, any_value(ln((g + {SMOOTH}) / (b + {SMOOTH}))) + sum(w) AS odds FROM votes JOIN theta{t} USING (rule, vote), ends{t} GROUP BY id),
post{t + 1} AS (SELECT id, 1 / (1 + exp(-odds)) AS good FROM odds{t})"""
        for t in range(ROUNDS)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
windows AS (SELECT r, p, list_slice(ws, p, p + 4) AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1)::BIGINT)) AS p FROM w)),
twice AS (SELECT r, p FROM windows JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, p + k AS q FROM twice, range(5) AS s(k)) GROUP BY r),
counts AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(regexp_extract_all(t || ' ', '[.!?][\\x20\\x09-\\x0D]'))::BIGINT AS n_sentences
  FROM w LEFT JOIN covered USING (r)),
voted AS (SELECT *, {BASE_FAILED} AS base_failed, {votes} FROM counts),
patterns AS (SELECT row_number() OVER () AS id, * FROM (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL)),
votes AS ({long}),
post0 AS (SELECT id, CASE WHEN least({names}) < 0 THEN 0.1 ELSE 0.9 END AS good FROM patterns){rounds}
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND odds >= 0 AS kept
FROM voted JOIN patterns USING ({names}) JOIN odds{ROUNDS - 1} USING (id)"""


ORACLE_SQL = _oracle()
