"""Personal data: labelers vote on spans, their reliabilities are estimated, and a span classifier is trained on the outcome.

Spans of four kinds are found by fixed patterns with checks (the base), which always stay, and by looser patterns: e-mail
addresses written out, defanged and longer network addresses, numbers without a country code, and card numbers with other separators.
Five labelers vote on every span that it is personal data (1), that it is not (-1), or abstain (0): the written form, a checksum or value range,
a gazetteer of prefixes and endings, words before it, and the characters at its edges. Expectation-maximisation
estimates, kind by kind, how reliable each labeler is, from counts of vote vectors (at most 3^5 a kind); the posteriors are soft labels for a logistic
classifier over votes and surface features, which so weighs what the labelers do not see. It needs the sums of labels
by feature vector only, at most 3^5 x 2^3 a kind. Loose spans that it gives `threshold` and that overlap no base span are added.

Everything runs in expressions. A span's place is a prefix sum of the lengths between matches, made by doubling: n log n for a
text with n matches, in its row. No pattern can match across lines, recurse with the text's length or try a run of characters from
every place.

Null and empty texts have no spans. Texts are searched whole. Repeated rows are searched each; equal starts are ordered by kind. An empty table
gives an empty result; with no span at all the prior weights decide, and there is nothing to decide. Extra columns stay as they are in `found`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.llm import quality
from propval.llm.text import own_columns, unused_prefix
from propval.session import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: (kind, pattern, what a text must hold for it): the base. Possessive forms of the plain patterns, tried at starts of runs only, match the same.
BASE = (
    (EMAIL, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (CARD, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    (PHONE, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
#: The loose patterns. Numbers are cards from 13 digits on, phones below.
LOOSE = (
    (
        EMAIL,
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(]\x20?at\x20?[\])]|(?<=\x20)at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])]|(?<=\x20)dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}",
        r"@|[\[(\x20]dot[\])\x20]",
    ),
    (IP, r"(?<![0-9A-Fa-f:.\]])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Fa-f:])", r"\[\.\][0-9]|:[0-9A-Fa-f]{1,4}:"),
    (PHONE, r"(?<![A-Za-z0-9.,+/:_-])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){8,18}+(?![A-Za-z0-9])(?![.,:/_-][A-Za-z0-9])", r"[0-9]"),
)
#: Code points before a span in which its context is looked for, back to the span before.
CONTEXT = 40

#: Words that announce personal data, by kind, and words that announce other numbers; in the languages of the corpus.
ANNOUNCING = (
    "e-?mail|mail|contact|write|reach|correo|courriel|kontakt|contacto",
    "ip|host|address|adresse|dirección|login|visitor|client",
    "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|pay|payment",
    "tel|phone|telephone|mobile|cell|call|fax|whatsapp|téléphone|portable|appelez|telefon|handy|anrufen|teléfono|móvil|llame",
)
OTHERWISE = "version|v|isbn|issn|doi|order|invoice|page|pages|line|section|article|art|no|nr|num|ref|serial|build|token|key|hash|price|total|population|seite|siehe|página|rechnung|facture"
#: Endings of addresses, as a gazetteer.
ENDINGS = "com|org|net|edu|gov|int|info|biz|name|io|co|me|app|dev|eu|uk|us|ca|au|nz|ie|de|at|ch|fr|be|lu|nl|es|pt|it|mx|ar|cl|br|in|jp|cn|kr|se|no|dk|fi|pl|cz|ru"
#: Country codes of telephone numbers, their first digits.
COUNTRIES = "1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|85[0-9]|88[06]|97[0-9]"

LABELERS = ("form", "value", "gazetteer", "context", "edges")
SURFACE = ("separated", "bracketed", "own_line")
#: Log odds before anything is learned, and how strongly they hold (as so many observations' worth).
PRIOR_BIAS, PRIOR_FOR, PRIOR_AGAINST, PRIOR_STRENGTH = -2.0, 1.5, -3.0, 4.0


def scan(values: Column, op, neutral: int) -> Column:
    """Inclusive running `op` over an array, by doubling: n log n."""
    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        rounds, values, lambda now, k: F.transform(now, lambda x, i: op(x, F.coalesce(F.get(now, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(neutral))))
    )


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name the array of its pattern's leftmost, non-overlapping matches: start, end (code points), value, before, after.

    patterns: pattern and guard, a shorter pattern that any text with a match has."""
    t, names = F.col(text), list(patterns)
    none = F.array().cast("array<string>")
    keep = lambda d: [F.col(c) for c in d.columns if not c.startswith("__m_")]
    df = df.withColumns({f"__m_v_{n}": F.when(t.rlike(guard), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, (p, guard) in patterns.items()})
    df = df.withColumns({f"__m_p_{n}": F.when(F.size(f"__m_v_{n}") > 0, F.split(t, patterns[n][0], -1)).otherwise(none) for n in names})

    def gaps(n: str) -> Column:
        v, p = F.col(f"__m_v_{n}"), F.col(f"__m_p_{n}")
        return F.transform(v, lambda _, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(v, i - 1)), F.lit(0)))

    df = df.withColumns({f"__m_g_{n}": gaps(n) for n in names})
    df = df.withColumns({f"__m_s_{n}": scan(F.col(f"__m_g_{n}"), lambda a, b: a + b, 0) for n in names})

    def spans(n: str) -> Column:
        v, p, s = F.col(f"__m_v_{n}"), F.col(f"__m_p_{n}"), F.col(f"__m_s_{n}")
        return F.transform(
            v,
            lambda x, i: F.struct(
                F.get(s, i).alias("start"),
                (F.get(s, i) + F.length(x)).alias("end"),
                x.alias("value"),
                F.right(F.get(p, i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(p, i + 1), F.lit(2)).alias("after"),
            ),
        )

    df = df.withColumns({n: spans(n) for n in names})
    return df.select(*keep(df))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: int, value: Column) -> Column:
    """The base's check of a match."""
    if kind == IP:
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == CARD:
        return F.length(digits(value)).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits(value)), F.lit(False))
    if kind == PHONE:
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def free(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no base span; both arrays sorted, of structs with start and end. n log n."""
    tagged = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("loose"), x["end"].alias("end"), x.alias("of")))
    all_ = F.sort_array(F.concat(tagged(base, 0), tagged(loose, 1)))
    low = -(1 << 30)
    ends = scan(F.transform(all_, lambda m: F.when(m["loose"] == 0, m["end"]).otherwise(low)), F.greatest, low)
    starts = F.reverse(scan(F.reverse(F.transform(all_, lambda m: F.when(m["loose"] == 0, -m["start"]).otherwise(low))), F.greatest, low))
    told = F.arrays_zip(all_.alias("m"), ends.alias("ends"), starts.alias("starts"))
    kept = F.filter(told, lambda x: (x["m"]["loose"] == 1) & (x["ends"] <= x["m"]["start"]) & (-x["starts"] >= x["m"]["end"]))
    return F.transform(kept, lambda x: x["m"]["of"])


def vote(against: Column, for_: Column) -> Column:
    return F.when(against & ~for_, -1).when(for_ & ~against, 1).otherwise(0)


def votes(x: Column) -> Column:
    """What the labelers say of a span (a struct with kind, base, value, before, after)."""
    kind, value, before, after, d = x["kind"], x["value"], x["before"], x["after"], digits(x["value"])
    n = F.length(d)
    by_kind = lambda *c: F.element_at(F.array(*c), kind + 1)
    date = value.rlike(r"^\(?(?:[12][0-9]{3}[.\x20-][01]?[0-9][.\x20-][0-3]?[0-9]|[0-3]?[0-9][.\x20-][01]?[0-9][.\x20-][12][0-9]{3})(?![0-9])")
    thousands = value.rlike(r"^[0-9]{1,3}(?:[\x20.][0-9]{3}){2,}$")
    number = value.rlike(r"^(?:\(?0?[2-9][0-9]{1,3}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}|0[1-9](?:[\x20.-][0-9]{2}){4}|\(?0[0-9]{2,4}\)?[\x20/-][0-9]{5,8}|00[0-9][\x20().0-9-]+)$")
    grouped = value.rlike(r"^(?:[0-9]{4}[\x20.-]{1,2}){3}[0-9]{1,7}$|^[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}$")
    same = d.rlike(r"^([0-9])\1*$")
    form = F.when(x["base"], 1).when(kind == PHONE, vote(date | thousands | ~value.rlike(r"[\x20().-]"), number)).when(kind == CARD, vote(thousands, grouped)).otherwise(0)
    card = F.coalesce(F.call_function("luhn_check", d), F.lit(False))
    high = value.rlike(r"^(?:0+|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})[.\[]")
    range_ = by_kind(F.lit(0), F.when(high, -1).otherwise(0), F.when(card & ~same, 1).otherwise(-1), F.when(same | ~n.between(9, 15), -1).otherwise(0))
    ending = value.rlike(rf"(?i)[.\x20)\]](?:{ENDINGS})$")
    private = value.rlike(r"^(?:10|127|192(?:\.|\[\.\])168|0)[.\[]")
    issuer = d.rlike("^(?:4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6(?:011|5[0-9]{2})[0-9]{12})$")
    area = F.when(value.startswith("+"), d.rlike(f"^(?:{COUNTRIES})")).otherwise(d.rlike("^(?:00[1-9]|0[1-9]|1?[2-9][0-9]{2}[2-9])"))
    known = by_kind(
        F.when(ending, 1).otherwise(-1), F.when(private, -1).otherwise(1), F.when(issuer, 1).otherwise(-1), F.when(area, 1).otherwise(-1)
    )
    said = by_kind(*[before.rlike(rf"(?i)(?<!\pL)(?:{w})(?!\pL)") for w in ANNOUNCING])
    context = vote(before.rlike(rf"(?i)(?<!\pL)(?:{OTHERWISE})(?!\pL)[^\pL]{{0,4}}$"), said)
    edges = F.when(before.rlike(r"[\"'=$€£#/\\&]$") | after.rlike(r"^[\"'%€$£/\\]|^\x20?[%€$£]"), -1).when(before.rlike(r"[:(<]\x20?$"), 1).otherwise(0)
    return F.array(*[F.coalesce(c, F.lit(0)).cast("int") for c in (form, range_, known, context, edges)])


def surface(x: Column) -> Column:
    return F.array(
        x["value"].rlike(r"[0-9][\x20()-]+[0-9]").cast("int"),
        x["value"].rlike(r"[()\[\]]").cast("int"),
        ((x["before"] == "") | x["before"].endswith("\n")).cast("int") * ((x["after"] == "") | x["after"].startswith("\n")).cast("int"),
    )


def spotted(docs: DataFrame, text: str = "text", base: str = "base", loose: str = "loose") -> DataFrame:
    """docs with the arrays `base` and `loose` of spans: start, kind, end, votes, surface; sorted by start, then kind."""
    names = {f"b{k}": (p, guard) for k, p, guard in BASE} | {f"l{k}": (p, guard) for k, p, guard in LOOSE}
    own = docs.columns
    read = matches(docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")), "__text", names).drop("__text")

    def kept(k: int, column: str, is_base: bool) -> Column:
        """As structs that sort by start and kind."""
        kind = lambda x: F.when(F.length(digits(x["value"])) >= 13, CARD).otherwise(PHONE) if not is_base and k == PHONE else F.lit(k)
        spans = F.filter(F.col(column), lambda x: passes(k, x["value"])) if is_base else F.col(column)
        return F.transform(
            spans,
            lambda x: F.struct(x["start"].alias("start"), kind(x).cast("int").alias("kind"), x["end"].alias("end"), F.lit(is_base).alias("base"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")),
        )

    sure = F.sort_array(F.concat(*[kept(k, f"b{k}", True) for k, *_ in BASE]))
    maybe = F.sort_array(F.concat(*[kept(k, f"l{k}", False) for k, *_ in LOOSE]))
    read = read.withColumns({"__sure": sure, "__maybe": maybe}).drop(*names)
    read = read.withColumn("__maybe", F.when((F.size("__sure") > 0) & (F.size("__maybe") > 0), free(F.col("__sure"), F.col("__maybe"))).otherwise(F.col("__maybe")))
    judged = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), votes(x).alias("votes"), surface(x).alias("surface")))
    return read.withColumns({base: judged("__sure"), loose: judged("__maybe")}).drop("__sure", "__maybe")


def features(x: Column) -> Column:
    """Of a span: its kind, each labeler's vote for and against, the surface; 0 or 1 each."""
    kinds = [(x["kind"] == k).cast("double") for k in range(len(KINDS))]
    said = [(x["votes"][j] == v).cast("double") for j in range(len(LABELERS)) for v in (1, -1)]
    return F.array(*kinds, *said, *[x["surface"][j].cast("double") for j in range(len(SURFACE))])


def learn(spans: DataFrame, base: str = "base", loose: str = "loose") -> dict:
    """Reliabilities by EM and the classifier's weights, from all spans of a `spotted` table."""
    each = spans.select(F.explode(F.concat(F.col(base), F.col(loose))).alias("x")).select("x", F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes"))
    models = [quality.fit(each.where(F.col("kind") == k), len(LABELERS)) for k in range(len(KINDS))]  # vectors of votes, counted
    p = F.lit(0.0)
    for k, m in enumerate(models):
        p = F.when(F.col("kind") == k, quality.posterior(m)).otherwise(p)
    # at most 4 x 3^5 x 2^3 rows
    rows = each.groupBy(features(F.col("x")).alias("f"), p.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()
    prior = np.array([PRIOR_BIAS] * len(KINDS) + [PRIOR_FOR, PRIOR_AGAINST] * len(LABELERS) + [0.0] * len(SURFACE))
    x = np.array([r["f"] for r in rows], dtype=float).reshape(len(rows), len(prior))
    target, n = np.array([r["p"] for r in rows]), np.array([float(r["n"]) for r in rows])
    weights = logistic(x, target, n, prior)
    return {"labelers": models, "weights": [float(w) for w in weights]}


def logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method for soft labels `target`, n times each, with a normal prior around `prior`."""
    w = prior.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(n * (np.logaddexp(0, z) - target * z)) + PRIOR_STRENGTH / 2 * np.sum((w - prior) ** 2))

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n * (q - target)) + PRIOR_STRENGTH * (w - prior)
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w)), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.max(np.abs(size * step)) < 1e-9:
            break
    return w


def added(model: dict, loose: Column, threshold: float = 0.5) -> Column:
    """The loose spans that the classifier takes for personal data."""
    weights, least = F.array(*[F.lit(w) for w in model["weights"]]), math.log(threshold / (1 - threshold))
    odds = lambda x: F.aggregate(F.zip_with(features(x), weights, lambda f, w: f * w), F.lit(0.0), lambda a, b: a + b)
    return F.filter(loose, lambda x: odds(x) >= least)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs (without the text) with `base_spans` and `spans`: arrays of start, kind (a number, as in KINDS), end, by start and kind."""
    p = unused_prefix(docs, "pii")
    rest = [c for c in own_columns(docs.drop(F.col(f"`{text}`")))]
    names = {c: f"{p}{i}" for i, c in enumerate(docs.drop(F.col(f"`{text}`")).columns)}
    spans = written(spotted(docs.select(*[c.alias(n) for c, n in zip(rest, names.values(), strict=True)], F.col(f"`{text}`").alias("text"))).drop("text"), "spans")
    model = learn(spans)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    base, more = plain(F.col("base")), plain(added(model, F.col("loose"), threshold))
    clash = {c.lower() for c in names} & {"base_spans", "spans"}
    return spans.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in clash], base.alias("base_spans"), F.sort_array(F.concat(base, more)).alias("spans"))
