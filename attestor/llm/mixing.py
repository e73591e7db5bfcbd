"""Mixing documents to target domain weights by soft membership; DataFrame functions only.

1. A naive-Bayes classifier over hashed words and the text's shape is fitted on the labelled table (a
   bounded sample of it) and gives every document a posterior over the domains. A feature speaks only for
   the domain where it is significantly more frequent than in each other one (log-odds of `STRONG` or more, a root likelihood ratio
   of `SIGNIFICANT`), once for a document, so that long texts don't add up noise.
2. Each document gets a nonnegative rate so that the expected tokens of each
   domain, the sum of rate * tokens * posterior, meet the targets. Projected
   gradient steps minimise the squared gaps. Each step is one aggregate over the
   table of tokens and posteriors that returns one number for each domain; the rates
   themselves are never stored: a step is max(0, rate - posterior . g), an
   expression over the posteriors. The gradient is scaled by the inverse Gram matrix of the posteriors of all
   documents with a rate over 0, so that few steps are needed, and a step that doesn't lower the gaps is halved.
   Equal rows count once in the sums.
   What still lacks after `MAX_STEPS` steps is in the column `gap` and gives a warning.
3. `copies` rounds the rate at random by a hash of doc_id: floor(rate + u).

Starting from 1, the rates change as little as the targets allow (in the metric of tokens).

Defined cases: a null or blank text has no tokens, the prior as posterior and is
kept once; labels with nulls are passed over; without labels all rates are the
budget's; a domain that has no tokens can't be met and is left out of the targets
(its weight is spread over the others); repeated rows get the same rate; more than `MAX_DOMAINS` domains are a ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_below, saved

MAX_TRAIN = 9000
#: Size of the classifier's table: the features it keeps, the most significant ones; bounds what is collected and broadcast.
MAX_WORDS = 20_000
#: There are many words, some of which are rare by chance, and few shapes.
SIGNIFICANT, SIGNIFICANT_SHAPE, STRONG = 5.0, 3.0, 1.0
#: The features of a shape are at this number and above, those of words below.
SHAPES = 1 << 40
MAX_DOMAINS = 16
MAX_STEPS = 20
CLOSE = 1e-4
SMOOTHING = 0.5
#: Words from which on the absence of a domain's words counts in full, and how much it counts at most.
ABSENT_WORDS, LEAST_ABSENT = 100, -4.0
#: Posteriors that may be broadcast (some 50 MB); more meet the documents in a merge join.
BROADCAST_ROWS = 500_000


BLANKS = r"[\x20\x09-\x0D]+"


#: Words from which on a text has a shape.
SHAPE_WORDS = 12


def featured(rows: DataFrame) -> DataFrame:
    """Adds words, once (the distinct ones), and shape (strings).

    The shape is told in steps: distinct words by the number of words, letters of a word, capitals, digits and marks by all
    characters, and lines. So junk is told by its form, whatever its words are. Each step is a projection of
    its own, so that nothing is worked out twice, and no function is called for a single word.
    """
    n, size = F.size("words"), F.greatest(F.length("text"), F.lit(1))
    only = lambda kind: F.length(F.regexp_replace("text", f"[^{kind}]+", ""))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("low", F.lower("text")).withColumn("words", F.array_remove(F.split("low", BLANKS), "")).withColumn("once", F.array_distinct("words"))
    share = lambda count, steps: F.floor(count / size * steps)
    steps = [
        F.floor(F.lit(12) * F.size("once") / F.greatest(n, F.lit(1))) * 32 + F.floor(F.log2(n + F.lit(1)) / 2),
        F.floor(F.lit(40) * F.size("once") / F.greatest(n, F.lit(1))) + F.when(n >= 100, 100).otherwise(0),
        F.floor((size - n) / F.greatest(n, F.lit(1)) / 1.5),
        share(only("A-Z"), 12),
        share(only("0-9"), 20),
        share(only("!|#*~=%&$"), 25),
        share(only("\\n"), 100),
    ]
    shape = F.array(*[F.concat(F.lit(f"\u0002{i}:"), x.cast("string")) for i, x in enumerate(steps)])
    return rows.withColumn("shape", F.when(n >= SHAPE_WORDS, shape).otherwise(F.array().cast("array<string>"))).drop("low")


def _number(feature: Column) -> Column:
    """What stands for a feature: a 32-bit hash, from SHAPES on for those of a shape."""
    number = F.hash(feature).cast("long")
    return F.when(F.startswith(feature, F.lit("\u0002")), F.lit(SHAPES) + F.pmod(number, F.lit(1 << 32))).otherwise(number)


#: Domains, log-priors, by word the log-odds of the one domain that it speaks for, and by domain what it says when none of its words is there.
Model = tuple[list[str], list[float], dict[int, list[float]], list[float]]


def fit_domains(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The classifier's model, as above.

    `labels` is (doc_id, domain). A word counts once for each document.
    """
    labels = labels.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in labels.groupBy("domain").agg(F.count("*").alias("n")).limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not sizes:
        return ["all"], [0.0], {}, [0.0]
    domains = sorted(sizes)
    taken = F.lit(False)
    for d in domains:
        taken = taken | ((F.col("domain") == d) & sample_below(F.col("doc_id"), min(1.0, max_train / len(domains) / sizes[d])))
    # at most about max_train rows
    some = F.broadcast(labels.where(taken))
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("domain", "text")
    rows = featured(rows).select("domain", F.concat("once", "shape").alias("buckets"), F.transform("words", lambda w: F.hash(w)).alias("all"))
    # copies of one text would make its words look typical of its domain: one of those with equal least word triples stays
    triples = F.when(F.size("all") >= 3, F.transform(F.sequence(F.lit(0), F.size("all") - 3), lambda i: F.struct(F.get("all", i), F.get("all", i + 1), F.get("all", i + 2))))
    least = lambda seed: F.array_min(F.transform("triples", lambda t: F.xxhash64(t, F.lit(seed))))
    rows = rows.withColumn("triples", triples).select("domain", "buckets", *[F.coalesce(least(i), F.hash("all")).alias(f"m{i}") for i in range(3)])
    for i in range(3):
        rows = rows.dropDuplicates(["domain", f"m{i}"])
    rows = saved(rows.select("domain", "buckets"))
    total = sum(sizes.values())
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everyone = sum(n.values())
    held = rows.select("domain", F.explode("buckets").alias("f")).select("domain", _number(F.col("f")).alias("b")).groupBy("b").agg(F.count("*").alias("whole"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    # each word against the domain that comes second in its rate
    k = range(len(domains))
    rate = [(F.col(f"n{i}") + SMOOTHING) / (n.get(d, 0) + 1) for i, d in enumerate(domains)]
    values, sizes_of = [], []
    for i, d in enumerate(domains):
        rivals = [F.struct(rate[j].alias("rate"), F.col(f"n{j}").alias("n"), F.lit(n.get(domains[j], 0) + 1).alias("all")) for j in k if j != i]
        rival = F.greatest(*rivals) if len(rivals) > 1 else rivals[0] if rivals else F.struct(rate[i].alias("rate"), F.col(f"n{i}").alias("n"), F.lit(1).alias("all"))
        mine, all_mine = F.col(f"n{i}"), n.get(d, 0) + 1
        share = (mine + rival["n"]) / (all_mine + rival["all"])
        term = lambda got, size: F.when(got > 0, got * F.log(got / (share * size))).otherwise(0.0)  # noqa: B023, E731
        value = F.log(rate[i] / rival["rate"])
        size = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(mine, all_mine) + term(rival["n"], rival["all"]))))
        counts = (size >= F.when(F.col("b") >= SHAPES, SIGNIFICANT_SHAPE).otherwise(SIGNIFICANT)) & (value >= STRONG)
        values += [F.when(counts, value).otherwise(0.0).alias(f"s{i}"), F.when(counts, F.log((1.01 - rate[i]) / (1.01 - rival["rate"]))).otherwise(0.0).alias(f"a{i}")]
        sizes_of.append(F.when(counts, size).otherwise(0.0))
    most = F.greatest(*sizes_of) if len(domains) > 1 else F.lit(0.0)
    kept = held.select("b", most.alias("size"), *values).where("size > 0").orderBy(F.col("size").desc(), "b").limit(MAX_WORDS)
    rows = kept.collect()
    # what all words' absence says is bounded, each one's part in proportion; a word that is there takes its part back
    whole = [sum(r[f"a{i}"] for r in rows) for i in k]
    absent = [max(LEAST_ABSENT, x) for x in whole]
    part = [x / y if y else 0.0 for x, y in zip(absent, whole, strict=True)]
    odds = {r["b"]: [r[f"s{i}"] - part[i] * r[f"a{i}"] for i in k] for r in rows}
    return domains, [math.log(sizes[d] / total) for d in domains], odds, absent


def _key() -> Column:
    """Stands for a row (128 bits); equal rows share it and get the same rate."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))))


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """(key, tokens, p) for every different row that has words; p is the array of domain posteriors.

    Words meet a table of at most MAX_WORDS rows of log-odds; those without any are dropped and the rest
    summed on the map side, so that one row for each document is shuffled.
    """
    domains, prior, odds, absent = model
    k = range(len(domains))
    table = docs.sparkSession.createDataFrame([(b, *row) for b, row in odds.items()], "b long, " + ", ".join(f"s{i} double" for i in k))
    rows = docs.select(_key().alias("key"), F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), BLANKS), "").alias("words"))
    words = rows.select("key", F.size("words").cast("long").alias("tokens"), F.posexplode(F.array_distinct("words")).alias("at", "f")).select("key", "tokens", "at", F.hash("f").cast("long").alias("b"))
    hits = words.join(F.broadcast(table), "b", "left").where("at = 0 or s0 is not null").select("key", "tokens", "at", *[f"s{i}" for i in k])
    # a shape has few steps, which are looked up in place
    known = {b: row for b, row in odds.items() if b >= SHAPES}
    if known:
        says = [F.create_map(*[F.lit(x) for b, row in known.items() for x in (b, float(row[i]))]) for i in k]
        one = lambda b: F.array(*[F.coalesce(F.try_element_at(m, b), F.lit(0.0)) for m in says])
        total = F.aggregate(F.transform("shape", _number), F.array(*[F.lit(0.0) for _ in k]), lambda t, b: F.zip_with(t, one(b), lambda x, y: x + y))
        shaped = featured(docs.select(_key().alias("key"), "text")).select("key", F.size("words").cast("long").alias("tokens"), total.alias("s"))
        hits = hits.unionByName(shaped.select("key", "tokens", F.lit(-1).alias("at"), *[F.get("s", F.lit(i)).alias(f"s{i}") for i in k]))
    # equal rows add up alike, which their number takes back
    sums = hits.groupBy("key", "tokens").agg(F.count_if(F.col("at") == 0).alias("rows"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in k])
    sums = sums.where("rows > 0")
    long = F.least(F.lit(1.0), F.col("tokens") / ABSENT_WORDS)
    sums = sums.withColumn("logits", F.array(*[F.lit(prior[i]) + F.lit(absent[i]) * long + F.col(f"s{i}") / F.col("rows") for i in k]))
    sums = sums.withColumn("e", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return sums.select("key", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting for a few unknowns."""
    n = len(right)
    a = [[*row, y] for row, y in zip(matrix, right, strict=True)]
    for i in range(n):
        j = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[j] = a[j], a[i]
        for r in range(n):
            if r != i and a[i][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def _rate(steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    for g in steps:
        move = sum((F.get(F.col("p"), F.lit(k)) * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def bounded(mass: list[float], target: list[float], kept: int) -> list[float]:
    """The targets with each domain but `kept` at its mass at most; `kept` gets what they leave, and its own mass at least."""
    out = [min(m, t) for m, t in zip(mass, target, strict=True)]
    out[kept] = max(mass[kept], sum(target) - sum(t for i, t in enumerate(out) if i != kept))
    return out


def fit_rates(table: DataFrame, domains: list[str], weights: dict[str, float], budget: float = 1.0, keep: str | None = None) -> tuple[list[list[float]], list[float]]:
    """Gradient steps and the remaining gaps (as shares of all tokens); `table` has tokens and p, `keep` is as in `mix`."""
    k = range(len(domains))
    part = lambda i: F.get(F.col("p"), F.lit(i))
    first = table.agg(
        F.sum("tokens").alias("all"),
        *[F.sum(F.col("tokens") * part(i)).alias(f"m{i}") for i in k],
        *[F.sum(F.col("tokens") * part(i) * part(j)).alias(f"g{i}_{j}") for i in k for j in k if j >= i],
    ).first()
    total = float(first["all"] or 0)
    if not total:
        return [], [0.0 for _ in k]
    mass = [first[f"m{i}"] / total for i in k]
    wanted = [weights.get(d, 0.0) if mass[i] > 1e-12 else 0.0 for i, d in enumerate(domains)]
    if not sum(wanted):
        wanted = mass
    target = [budget * x / sum(wanted) for x in wanted]
    if keep in domains:
        target = bounded(mass, target, domains.index(keep))
    pairs = [(i, j) for i in k for j in k if j >= i]

    def square(row) -> list[list[float]]:
        return [[row[f"g{min(i, j)}_{max(i, j)}"] / total + (1e-9 if i == j else 0.0) for j in k] for i in k]

    def after(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """The gaps, and the Gram matrix of the documents that still have a rate."""
        rated = table.withColumn("r", _rate(steps))
        moves = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        got = rated.agg(*[F.sum(F.col("tokens") * part(i) * F.col("r")).alias(f"m{i}") for i in k], *[F.sum(moves * part(i) * part(j)).alias(f"g{i}_{j}") for i, j in pairs]).first()
        return [got[f"m{i}"] / total - target[i] for i in k], square(got)

    steps: list[list[float]] = []
    gap, gram, scale = [m - t for m, t in zip(mass, target, strict=True)], square(first), 1.0
    for _ in range(MAX_STEPS):
        if max(map(abs, gap)) < CLOSE or scale < 1e-2:
            break
        tried = [*steps, [scale * x for x in _solve(gram, gap)]]
        new_gap, new_gram = after(tried)
        if sum(x * x for x in new_gap) < sum(x * x for x in gap):
            steps, gap, gram, scale = tried, new_gap, new_gram, 1.0
        else:
            scale /= 2
    return steps, gap


def mix(docs: DataFrame, labels: DataFrame, source: DataFrame, weights: dict[str, float], budget: float = 1.0, keep: str | None = None) -> DataFrame:
    """`docs` with tokens, p, rate, copies and gap (what each domain's expected tokens are off their target by, over all tokens).

    The classifier is fitted on `labels` (doc_id, domain) and the texts of
    `source`; `weights` are target shares by domain, and `budget` the expected tokens over those there are.
    No document that is most likely of the domain `keep` gets a rate below 1, and no other one a rate above 1.
    """
    model = fit_domains(source, labels)
    weighed = saved(posteriors(docs, model))
    steps, gap = fit_rates(weighed, model[0], weights, budget, keep)
    if max(map(abs, gap), default=0.0) >= CLOSE:
        warnings.warn(f"targets are missed by {dict(zip(model[0], [round(x, 4) for x in gap], strict=True))} of all tokens", stacklevel=2)
    few = weighed.count() <= BROADCAST_ROWS
    columns = [c for c in docs.columns if c not in ("tokens", "p", "rate", "copies", "gap")]
    rows = docs.select(*columns, _key().alias("__key")).join((F.broadcast(weighed) if few else weighed.hint("merge")).withColumnRenamed("key", "__key"), "__key", "left")
    rows = rows.withColumn("p", F.coalesce("p", F.array(*[F.lit(math.exp(x)) for x in model[1]]))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # a document without tokens weighs nothing in any sum and is kept once
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(_rate(steps))
    if keep in model[0]:
        # the last step may leave a small gap, and mixed posteriors lie between the domains
        own = F.get("p", F.lit(model[0].index(keep))) >= F.array_max("p")
        rate = F.when(own, F.greatest(F.lit(1.0), rate)).otherwise(F.least(F.lit(1.0), rate))
    uniform = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.coalesce(uniform, F.lit(0.5))).cast("int"))
    return rows.select(*columns, "tokens", "p", "rate", "copies", F.array(*[F.lit(float(x)) for x in gap]).alias("gap"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): `low` for quality 0, else `toxic` or `clean`."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))
