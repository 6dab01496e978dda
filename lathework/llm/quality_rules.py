"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each.

Every document gets counts of its whole text. Each rule turns them into a vote: 1 (good), -1 (bad)
or 0 (abstains). The votes of all documents are counted by pattern (3 ** 6 patterns at most,
whatever the corpus), expectation-maximisation over the pattern counts gives the share of good
documents and each rule's accuracies, and the posterior probability of
quality decides in place of "all rules must pass". DataFrame functions only; the driver sees
pattern counts alone.

Defined results: a null text is empty (no words: the base test fails); a null id stays null;
repeated rows and ties are judged one by one, alike; an empty table gives an empty table; other
columns, also such as are called like the results, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import SPACE, let, stash, words

SYMBOLS = r"[#*$%&|<>]"
GRAM = 5
#: Words among which variety is measured: a longer text is cut into slices, as its share of distinct words falls with its length.
SLICE = 2000
#: What is believed of every rule before any document: how often its good and its bad votes are right (bad votes are narrow
#: by design, good ones only say that nothing is odd), and how many documents, as a share of all, this belief is worth.
RIGHT = {1: 0.6, -1: 0.95}
BELIEF = 1.0
#: What the belief that half of the documents are good is worth, in the same way.
SHARE = 0.2

#: Votes as SQL over the counts of a document, in the order of the pattern. A rule abstains (0) where it has no evidence.
RULES = {
    "length": "CASE WHEN n_words < 10 THEN -1 ELSE 0 END",
    "symbols": "CASE WHEN n_symbols > 0.1 * n_words THEN -1 ELSE 0 END",
    # A symbol on every fourth word is a second reason, not the first one once more.
    "littered": "CASE WHEN n_symbols > 0.25 * n_words THEN -1 ELSE 0 END",
    # Repetition in words, echoes, lines and variety shows together, so it has one vote.
    "repetition": """CASE WHEN 100 * n_repeat_words > 20 * n_words OR n_echo > 0.3 * n_words OR n_lines >= 3 AND n_dup_lines > 0.4 * n_lines
        OR n_words >= 20 AND n_varied < 0.35 * n_words THEN -1 WHEN n_words >= 20 AND n_varied >= 0.5 * n_words AND n_echo <= 0.15 * n_words THEN 1 ELSE 0 END""",
    "word_length": "CASE WHEN word_chars < 2.5 * n_words OR word_chars > 12 * n_words THEN -1 ELSE 0 END",
    "endings": "CASE WHEN n_ended >= 0.5 * n_lines THEN 1 WHEN n_ended = 0 AND n_words >= 20 THEN -1 ELSE 0 END",
}


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def marked(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def covered(p: Column) -> Column:
            n = F.size(p)
            twice = F.filter(
                p,
                lambda x, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["g"] == x["g"]))
                | ((k < n - 1) & (p[F.least(k + 1, n - 1)]["g"] == x["g"])),
            )
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n")),
                lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(GRAM), s - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, covered))

    grams = F.when(
        F.size(w) >= GRAM,
        F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.concat_ws(" ", *(w[i + j] for j in range(GRAM)))),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return let(grams, marked)


def _varied(w: Column) -> Column:
    """Distinct words of each slice of ``SLICE`` words, summed over the text."""
    starts = F.sequence(F.lit(1), F.size(w), F.lit(SLICE))
    sliced = F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(w, i, SLICE))))
    return F.when(F.size(w) > SLICE, sliced).otherwise(F.size(F.array_distinct(w)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts that the rules read, one row for each input row; ``carried`` holds the columns named in ``carry``."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _varied(w).cast("long").alias("n_varied"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))]))).cast("long").alias("n_echo"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda s: s.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        )

    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *([F.struct(*carry).alias("carried")] if carry else []),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(words(F.col(text_col)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    ).select("doc_id", *(["carried"] if carry else []), "w.*", "word_chars", "n_symbols", "l.*")


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over (votes, documents): P(good), and for each rule {vote: (P(vote | good), P(vote | bad))}.

    A rule has two accuracies, the chances that its good and its bad votes are right; rules are right or
    wrong independently, and that a rule abstains tells nothing. The belief in the rules enters as
    pseudo-counts in proportion to the documents, and no vote counts as worse than chance; both also
    fix which class is called good. EM starts from the belief.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.5, []
    m, worth = len(patterns[0][0]), BELIEF * total
    prior, right = 0.5, [dict(RIGHT) for _ in range(m)]
    for _ in range(rounds):
        table = _table(right)
        good = [posterior(prior, table, v) for v, _ in patterns]
        new = (sum(p * n for p, (_, n) in zip(good, patterns)) + SHARE * total / 2) / (total + SHARE * total)
        moved = abs(new - prior)
        for j in range(m):
            for vote, before in RIGHT.items():
                cast = [(p if vote > 0 else 1 - p, n) for p, (v, n) in zip(good, patterns) if v[j] == vote]
                a = max(0.5, (sum(p * n for p, n in cast) + worth * before) / (sum(n for _, n in cast) + worth))
                moved = max(moved, abs(a - right[j][vote]))
                right[j][vote] = a
        prior = new
        if moved < 1e-12:
            break
    return prior, _table(right)


def _table(right: list[dict[int, float]]) -> list[dict[int, tuple[float, float]]]:
    return [{1: (a[1], 1 - a[1]), 0: (1.0, 1.0), -1: (1 - a[-1], a[-1])} for a in right]


def posterior(prior: float, table: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    """P(good | votes)."""
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, votes, ``p_quality`` and ``kept`` for each row of ``docs``; ``carried`` holds the columns named in ``carry``.

    ``kept`` is false where the base test fails (fewer than 10 words, or over a fifth of the words
    in repeated 5-word windows), else ``p_quality >= threshold``.
    """
    votes = [f"v_{k}" for k in RULES]
    found = stash(measure(docs, id_col, text_col, carry), "quality-counts").select(
        "*", *(F.expr(sql).cast("int").alias(v) for v, sql in zip(votes, RULES.values()))
    )
    rows = found.groupBy(*votes).count().collect()  # 3 ** len(RULES) rows at most
    prior, table = fit(sorted((tuple(r[v] for v in votes), r["count"]) for r in rows))
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, t in zip(votes, table):
        a = {k: math.log(p / q) for k, (p, q) in t.items()}
        odds = odds + F.when(F.col(v) == 1, a[1]).when(F.col(v) == -1, a[-1]).otherwise(a[0])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        found.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_quality") >= threshold))
    )
