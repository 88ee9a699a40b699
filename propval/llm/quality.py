"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates how often each rule votes either
way on good and on bad documents, and a document's posterior probability of being good replaces an all-must-pass filter:
a bad vote of a rule that the others seldom bear out is overruled, and a document that hardly any rule calls good is
rejected although none calls it bad. A vote never counts against its own meaning. EM runs over all documents that
the base rule leaves, and needs only how often each vector of votes occurs: at most 3^rules rows, however large the
corpus, and this is all that reaches the driver.

Null and empty texts have no words and all counts 0; they fail the base rule. Long texts are measured whole, in n log n.
Repeated rows are judged alike, each on its own, so there are no ties; a posterior of exactly the threshold keeps. Extra
columns stay as they are; the names of counts and votes replace columns of these names in `measured` and `votes`, and
never in `filtered`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.llm.text import SPACE, WORD, own_columns, unused_prefix, window_hashes, word_hashes, words
from propval.session import written

WINDOW = 5
#: P(good) before any vote.
PRIOR_GOOD = 0.8
#: Pseudo-votes that keep each estimate on the side of the rule's meaning where votes are few.
SMOOTH = 2.0

#: (rule, good if, bad if), on the ratios of `ratios()`; where neither holds, a rule abstains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "symbol_share < 0.005", "symbol_share > 0.02"),
    ("capitals", "capital_share BETWEEN 0.004 AND 0.08", "capital_share > 0.3"),
    ("shouting", "shout_share < 0.01", "shout_share > 0.05"),
    ("bars", "bar_share < 0.01", "bar_share > 0.1"),
    ("repeats", "repeat_share < 0.05", "repeat_share > 0.1"),
    ("lines", "dup_line_share < 0.1", "dup_line_share > 0.25"),
    ("word_length", "word_length BETWEEN 3.5 AND 6.5", "word_length NOT BETWEEN 2.5 AND 9"),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals", "n_shouts", "n_bars")


def repeat_words(hashes: Column) -> Column:
    """Words that stand in a WINDOW-word window found twice or more in the text. hashes: of all windows, a column.

    Windows are sorted by (hash, place), so equal ones are neighbours: n log n for a text, whatever repeats."""
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        count = F.size(pairs)
        same = F.zip_with(
            F.slice(pairs, F.lit(1), F.greatest(count - 1, F.lit(0))),
            F.slice(pairs, F.lit(2), F.greatest(count - 1, F.lit(0))),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
        )
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
        # every place covers WINDOW words, less what the next one covers again
        follow = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(places, follow, lambda p, q: F.least(q - p, F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts METRICS and EXTRA of each whole text, under `prefix` + name."""
    p = lambda name: f"{prefix}{name}"
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    only = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")).cast("long")
    one = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumn(p("__words"), words(F.col(f"`{text}`")))
        .withColumn(p("__hashes"), word_hashes(F.col(p("__words"))))
        .withColumn(p("__windows"), window_hashes(F.col(p("__hashes")), WINDOW))
        .withColumns(
            {
                p("n_words"): F.size(p("__words")).cast("long"),
                p("word_chars"): F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
                p("n_symbols"): only("#*$%&|<>"),
                p("n_dup_lines"): (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                p("n_repeat_words"): repeat_words(F.col(p("__windows"))),
                p("n_lines"): F.size(lines).cast("long"),
                p("n_capitals"): only(r"\p{Lu}"),
                p("n_shouts"): one("!"),
                p("n_bars"): one("|"),
            }
        )
        .drop(p("__words"), p("__hashes"), p("__windows"))
    )


def ratios(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "symbol_share": per(c("n_symbols"), c("word_chars")),
        "capital_share": per(c("n_capitals"), c("word_chars")),
        "shout_share": per(c("n_shouts"), c("word_chars")),
        "bar_share": per(c("n_bars"), c("n_words")),
        "repeat_share": per(c("n_repeat_words"), c("n_words")),
        "dup_line_share": per(c("n_dup_lines"), c("n_lines")),
        "word_length": per(c("word_chars"), c("n_words")),
    }


def votes(measures: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, prefix: str = "", into: str = "votes") -> DataFrame:
    """Adds the array of votes (1 good, -1 bad, 0 abstains), in the order of the rules."""
    names = {name: f"{prefix}__r_{name}" for name in ratios(prefix)}
    with_ratios = measures.withColumns({names[k]: v for k, v in ratios(prefix).items()})

    def vote(good: str, bad: str) -> Column:
        for name, own in names.items():
            good, bad = good.replace(name, own), bad.replace(name, own)
        return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)

    return with_ratios.withColumn(into, F.array(*[vote(g, b) for _, g, b in rules]).cast("array<int>")).drop(*names.values())


def fit(voted: DataFrame, n_rules: int, votes_col: str = "votes", rounds: int = 200, tolerance: float = 1e-9) -> dict:
    """EM for a two-class model with rules independent given the class; the input is counted per vote vector first."""
    seen = [(tuple(r[0]), r[1]) for r in voted.groupBy(votes_col).count().orderBy(votes_col).collect()]  # <= 3^rules rows
    good_prior = PRIOR_GOOD
    # p[class][rule][vote + 1]: how often a rule votes bad, abstains, votes good on documents of a class
    start = {1: [0.01, 0.29, 0.7], 0: [0.3, 0.5, 0.2]}
    p = {k: [list(row) for _ in range(n_rules)] for k, row in start.items()}
    before = -math.inf
    for _ in range(rounds if seen else 0):
        total, good_total, likelihood = 0.0, 0.0, 0.0
        counts = {k: [[SMOOTH * x for x in row] for _ in range(n_rules)] for k, row in start.items()}
        for v, n in seen:
            a = good_prior * math.prod(p[1][j][x + 1] for j, x in enumerate(v))
            b = (1 - good_prior) * math.prod(p[0][j][x + 1] for j, x in enumerate(v))
            q = a / (a + b)
            likelihood += n * math.log(a + b)
            total += n
            good_total += n * q
            for j, x in enumerate(v):
                counts[1][j][x + 1] += n * q
                counts[0][j][x + 1] += n * (1 - q)
        good_prior = min(max((good_total + 1) / (total + 2), 0.05), 0.99)
        for k in (0, 1):
            p[k] = [[x / sum(row) for x in row] for row in counts[k]]
        if abs(likelihood - before) <= tolerance * max(1.0, abs(likelihood)):
            break
        before = likelihood
    logit = math.log(good_prior / (1 - good_prior))
    ratio = lambda j, x: math.log(p[1][j][x] / p[0][j][x])
    weights = [[min(0.0, ratio(j, 0)), ratio(j, 1), max(0.0, ratio(j, 2))] for j in range(n_rules)]
    return {"prior": good_prior, "logit": logit, "weights": weights}


def posterior(model: dict, votes_col: str = "votes") -> Column:
    """P(good | votes) as a column expression."""
    score = F.lit(float(model["logit"]))
    for j, w in enumerate(model["weights"]):
        v = F.col(votes_col)[j]
        score = score + F.when(v == 1, float(w[2])).when(v == -1, float(w[0])).otherwise(float(w[1]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def base_failed(prefix: str = "") -> Column:
    c = lambda name: F.col(f"{prefix}{name}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def filtered(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that the base rule or the posterior rejects; the texts are measured once."""
    p = unused_prefix(docs, "q")
    voted = written(votes(measured(docs, text, p), prefix=p, into=f"{p}votes").select(*own_columns(docs), f"{p}votes", base_failed(p).alias(f"{p}failed")), "voted")
    passed = voted.where(~F.col(f"{p}failed"))
    return passed.where(posterior(fit(passed, len(RULES), f"{p}votes"), f"{p}votes") >= threshold).select(*own_columns(docs))
