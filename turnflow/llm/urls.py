"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm.common import small, stored, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n_url", "n_host", "n_path", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_escapes", "is_https", "is_www", "has_fragment", "suffix_seen", "suffix_blocked", "section_seen", "section_blocked")
FIT_ROWS = 20_000
#: What labelled URLs are counted by: the last label of the host, and the first part of the path, where sites put a language or a section.
COUNTED = ("suffix", "section")
#: Hosts are dealt into so many folds; the counts are hidden from the fit for one fold's labelled URLs.
FOLDS, HIDDEN = 5, 0
TREES, DEPTH = 10, 4
CUT = 0.5


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host` (ASCII lower case) and `path`; both empty without a `://`."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substr(F.col(url), start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return df.withColumns({"host": F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and its subdomains
    where the path starts with the rule's. The rules are a parameter, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the features that the URL alone gives; those of a null URL are 0."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    length = F.greatest(F.length(u), F.lit(1)).cast("double")
    letters = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / length
    entropy = F.aggregate(F.transform(letters, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "n_url": F.length(u).cast("double"),
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "host_depth": F.size(F.split("host", r"\.")).cast("double"),
            "path_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(u, r"[^0-9]", "")) / length,
            "entropy": entropy,
            "n_params": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "n_hyphens": count("-").cast("double"),
            "n_escapes": count("%").cast("double"),
            "is_https": u.startswith("https:").cast("double"),
            "is_www": F.col("host").startswith("www.").cast("double"),
            "has_fragment": u.contains("#").cast("double"),
        }
    )


def labelled(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages with host, path, hit (the rule's name and verdict, or null), suffix, section, fold (by host) and label (1: block, null: no rule)."""
    known = with_host(pages).withColumn("hit", first_rule(F.col("host"), F.col("path"), rules))
    own = {"suffix": F.substring_index("host", ".", -1), "section": F.regexp_extract("path", "^/([^/]*)", 1), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")}
    return known.withColumns(own).withColumn("label", (F.col("hit.verdict") == "block").cast("double"))


def label_counts(known: DataFrame, by: str) -> DataFrame:
    """For each suffix or section how many URLs are labelled and blocked, by fold."""
    of = lambda f: (F.sum(F.when(F.col("fold") == f, 1.0).otherwise(0.0)), F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)))
    pairs = [of(f) for f in range(FOLDS)]
    return known.filter("label IS NOT NULL").groupBy(F.col(by).alias("counted")).agg(F.array(*[a for a, _ in pairs]).alias("n_of"), F.array(*[b for _, b in pairs]).alias("b_of"))


def with_counts(known: DataFrame, counts: DataFrame, prior: float, by: str) -> DataFrame:
    """Adds seen and blocked of the suffix or section. A labelled URL gets those of the other folds' hosts alone, and one of the hidden fold
    none at all, as a URL whose suffix was never labelled: so the trees learn what to do without them."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    own = lambda a: F.when(F.col("label").isNull(), F.lit(0.0)).otherwise(F.get(a, F.col("fold")))
    hidden = F.col("label").isNotNull() & (F.col("fold") == HIDDEN)
    left = lambda a: F.when(hidden | F.col(a).isNull(), F.lit(0.0)).otherwise(total(F.col(a)) - own(F.col(a)))
    joined = known.join(counts, F.col(by) == F.col("counted"), "left")
    n, b = left("n_of"), left("b_of")
    return joined.withColumns({f"{by}_seen": F.log1p(n), f"{by}_blocked": (b + 2 * prior) / (n + 2)}).drop("counted", "n_of", "b_of")


def described(known: DataFrame, counts: dict[str, DataFrame], prior: float) -> DataFrame:
    """Adds all features. Counts of few suffixes or sections are sent to the tasks, others are joined by shuffling."""
    for by, table in counts.items():
        known = with_counts(known, small(table, 100_000), prior, by)
    return lexical(known)


def fitted(sample: DataFrame) -> GBTClassificationModel:
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=6, predictionCol="as_is")
    model = trees.fit(vector.transform(stored(sample, "url-sample")))
    return model.setProbabilityCol("chance").setRawPredictionCol("margin")


def scored(model: GBTClassificationModel, full: DataFrame) -> DataFrame:
    """Adds score, the chance of block."""
    seen = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full))
    return seen.withColumn("score", vector_to_array("chance")[1])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, fit_rows: int = FIT_ROWS, cut: float = CUT) -> DataFrame:
    """pages with `host`, `path`, `rule`, `verdict` and `score` (chance of block).

    A URL that a rule fits has the rule's verdict. These URLs are the labels for gradient-boosted trees, which judge
    the others: block if the score is at least `cut`. The trees are fitted on at most `fit_rows` labelled URLs, those
    with the least hash of the URL; that bound keeps the fit's cost fixed. Suffix statistics (how often the last label
    of the host is labelled, and its share of blocks, drawn to the overall share), and those of the path's first part, count all labelled URLs, but never
    those of hosts in a labelled URL's own fold. Where no rule fits any URL, or all labels agree, there is nothing to
    learn and the others are allowed or get that label, with score 0 or 1. Null and malformed URLs have empty host and path and are
    judged by the trees. Equal URLs get equal results, rows count each. URLs are read whole, however long. Columns of
    pages named like a result are replaced, all others stay, whatever their names.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    known = labelled(pages.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col("url")), rules)
    counts = {by: stored(label_counts(known, by), f"url-{by}") for by in COUNTED}
    n, blocked = counts["suffix"].agg(F.coalesce(F.sum(F.aggregate("n_of", F.lit(0.0), lambda x, y: x + y)), F.lit(0.0)), F.coalesce(F.sum(F.aggregate("b_of", F.lit(0.0), lambda x, y: x + y)), F.lit(0.0))).first()

    if n and 0 < blocked < n:
        full = described(known, counts, (blocked + 1) / (n + 2))
        sample = full.filter("label IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(fit_rows).select(*FEATURES, "label")
        out = scored(fitted(sample), full)
    else:
        out = known.withColumn("score", F.lit(1.0 if blocked else 0.0))
    learnt = F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learnt).alias("verdict"), "score")


def held_out(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, fit_rows: int = FIT_ROWS, cut: float = CUT) -> DataFrame:
    """label, score and n of labelled URLs of one fold of hosts, judged by trees fitted on the other folds."""
    known = labelled(pages.select("url"), rules).filter("label IS NOT NULL")
    others = known.filter(F.col("fold") != FOLDS - 1)
    counts = {by: stored(label_counts(others, by), f"url-{by}") for by in COUNTED}
    n, blocked = others.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (blocked + 1) / (n + 2)
    sample = described(others, counts, prior).orderBy(F.xxhash64("url"), "url").limit(fit_rows).select(*FEATURES, "label")
    test = known.filter(F.col("fold") == FOLDS - 1).withColumns({"truth": F.col("label"), "label": F.lit(None).cast("double")})
    return scored(fitted(sample), described(test, counts, prior)).select("url", F.col("truth").alias("label"), "score", (F.col("score") >= cut).alias("blocked"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
