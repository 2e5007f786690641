"""URL filters by association rules, in DataFrame operations only.

A url is a set of tokens: its scheme, the labels of its host, the parts of labels with hyphens, the segments of its
path that are not numbers, its extension and the keys of its query. From labelled urls FP-growth mines combinations of
tokens together with the label. A rule "these tokens, then block" is a candidate when enough blocked urls support it and
its confidence is MIN_LIFT times the share of blocked urls among all (or a stated confidence), and it is pruned when a
part of it is as sure. Candidates are learned on two thirds of the labelled documents and judged: the lower bound of
their precision (Wilson), at an error of ALPHA for all antecedents that were tried together, must be above the share of
blocked urls and PRECISION, and so must the bound on the other third, at an error of FOLD_ALPHA. What chance alone would give does
not pass; where hosts and labels are unrelated no rule is left and the given list and its default decide. Tokens that stand in exactly the same labelled urls count as one (the first by name), or
itemsets would double with each of them. Rules match by an inverted index: each rule is filed under the one of its
tokens that is rarest among the urls, and a url looks up its own tokens there and checks the rest. A list of given
rules (host, path) goes first: they are found by an equality join on the suffixes of the host.

Defined cases: a null url or one without "://" has an empty host and path and no tokens, fits no rule and is allowed;
labels are read as the worst of repeated ones; ties between rules go to the surer, then the longer, then the smaller by
text; rows that repeat are judged each; without labels nothing is learned; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

MIN_COUNT = 20
MIN_SUPPORT = 0.001
MIN_LIFT = 1.2
MAX_TOKENS = 3
#: Errors of the bounds on the learning part (shared by all antecedents tried) and on the other, and the precision below which nothing is blocked.
ALPHA, FOLD_ALPHA, PRECISION = 0.01, 0.05, 0.5
#: One of so many documents judges what the others have taught.
FOLDS = 3
#: Rules up to which they are broadcast to the urls.
BROADCAST_RULES = 20_000
_BLOCK = "=block"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Tokens of a url; none where it has no host part."""
    url = F.coalesce(url, F.lit(""))
    named = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    segments = F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    scheme = F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    extension = F.array(F.lower(F.regexp_extract(path, r"\.([0-9A-Za-z]{1,8})$", 1)))
    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    found = F.concat(named("s:", scheme), named("h:", labels), named("w:", parts), named("p:", segments), named("e:", extension), named("q:", keys))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _mined(labelled: DataFrame, min_count: int, min_support: float) -> tuple[DataFrame, float]:
    """All rules (rule_tokens, confidence, support) towards block of at most MAX_TOKENS tokens with enough support, and the share of blocked rows."""
    from pyspark.ml.fpm import FPGrowth

    rows = materialize(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("i"), "tokens", "block"), "transactions")
    none = rows.select(F.col("tokens").alias("rule_tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    n, blocked = rows.agg(F.count("*"), F.count_if("block")).first()
    least = max(min_support, min_count / n) if n else 1.0
    if n < min_count or not blocked or least > 1:
        return none, 0.0
    # Only tokens that stand in blocked urls often enough can be in a rule; of those with the same urls one is left.
    each = rows.select("i", "block", F.explode(F.array_distinct("tokens")).alias("t"))
    code = [F.bit_xor(F.xxhash64("i", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    often = each.groupBy("t").agg(F.count("*").alias("n"), F.count_if("block").alias("m"), *code).where(F.col("m") >= least * n)
    use = often.groupBy("n", "h1", "h2").agg(F.min("t").alias("t")).select("t")
    kept = each.join(use, "t").groupBy("i", "block").agg(F.collect_set("t").alias("items"))
    items = F.concat("items", F.when(F.col("block"), F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>")))
    slim = materialize(kept.select(items.alias("items")), "slim")
    # Urls without any such token count in the support as well.
    m = slim.count()
    if not m:
        return none, blocked / n
    grown = FPGrowth(itemsCol="items", minSupport=min(1.0, least * n / m), minConfidence=0.0).fit(slim).associationRules
    blocking = grown.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == _BLOCK) & (F.size("antecedent") <= MAX_TOKENS))
    return materialize(blocking.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", (F.col("support") * m / n).alias("support")), "rules"), blocked / n


def _without_idle(found: DataFrame) -> DataFrame:
    """Rules that say something new: none of whose parts is as sure. At most MAX_TOKENS tokens are few enough to list all parts."""
    parts = [F.transform(F.col("rule_tokens"), lambda t: F.array(t))]
    drop = F.transform(F.col("rule_tokens"), lambda t: F.array_remove(F.col("rule_tokens"), t))
    parts.append(F.when(F.size("rule_tokens") > 2, drop).otherwise(F.array().cast("array<array<string>>")))
    listed = found.where(F.size("rule_tokens") > 1).select("rule_tokens", "confidence", F.explode(F.concat(*parts)).alias("part"))
    short = found.select(F.col("rule_tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    idle = listed.join(short, "part").where("part_confidence >= confidence").select("rule_tokens").distinct()
    return found.join(idle, "rule_tokens", "left_anti")


def learn_rules(
    labelled: DataFrame, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float | None = None, min_lift: float = MIN_LIFT
) -> DataFrame:
    """Rules (rule_tokens, confidence, support) from rows (tokens, block), by support and confidence alone."""
    found, base = _mined(labelled, min_count, min_support)
    sure = min(1.0, min_lift * base) if min_confidence is None else min_confidence
    return _without_idle(found.where(F.col("confidence") >= sure))


def lower_bound(hits: Column, n: Column, alpha: float) -> Column:
    """Wilson's lower bound of a share at a one-sided error of alpha."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha)
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def significant_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, alpha: float = ALPHA, precision: float = PRECISION) -> DataFrame:
    """Rules (rule_tokens, confidence, support) from rows (doc_id, tokens, block) that chance does not explain.

    Learned on documents outside the judging third: precision's lower bound, at alpha shared by all antecedents tried, is
    above the base rate and `precision`; on that third the bound at FOLD_ALPHA is above both again.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    learn, judge_by = labelled.where(fold != 0), materialize(labelled.where(fold == 0).select(F.monotonically_increasing_id().alias("i"), "tokens", "block"), "judging")
    found, base = _mined(learn, min_count, min_support)
    tried = found.count()
    n, blocked = judge_by.agg(F.count("*"), F.count_if("block")).first()
    if not tried or not n:
        return found.limit(0)
    rows = learn.where(F.size("tokens") > 0).count()
    hits = F.round(F.col("support") * rows)
    good = found.where(lower_bound(hits, F.round(hits / F.col("confidence")), alpha / tried) > max(base, precision))
    good = materialize(_without_idle(good).withColumn("rule", F.monotonically_increasing_id()), "good")
    filed = good.select("rule", F.size("rule_tokens").alias("long"), F.explode("rule_tokens").alias("t"))
    met = judge_by.select("i", "block", F.explode(F.array_distinct("tokens")).alias("t")).join(filed, "t").groupBy("rule", "long", "i", "block").agg(F.count("*").alias("held")).where("held = long")
    seen = met.groupBy("rule").agg(F.count_if("block").alias("k"), F.count("*").alias("m"))
    kept = seen.where(lower_bound(F.col("k"), F.col("m"), FOLD_ALPHA) > max(blocked / n, precision)).select("rule")
    return good.join(kept, "rule").drop("rule")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, confidence, mined) of the surest rule that fits each url (row, tokens), by an index on each rule's rarest token."""
    rules = materialize(rules, "mined")
    small = rules.count() <= BROADCAST_RULES
    share = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    each = urls.select("row", "tokens", F.explode("tokens").alias("t"))
    filed = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("t"))
    counts = each.select("t").join(share(filed.select("t").distinct()), "t", "left_semi").groupBy("t").count()
    rarest = F.min_by("t", F.struct(F.coalesce("count", F.lit(0)), "t"))
    index = filed.join(counts, "t", "left").groupBy("rule_tokens", "confidence").agg(rarest.alias("t"))
    looked = each.join(share(index), "t").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    text = F.array_join("rule_tokens", " ")
    best = F.min_by(F.struct("confidence", text.alias("mined")), F.struct(-F.col("confidence"), -F.size("rule_tokens"), text))
    return looked.groupBy("row").agg(best.alias("b")).select("row", "b.confidence", "b.mined")


def given_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict, rule_host, rule_path) of texts like example.net/en/."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = spark.sql("select rule, verdict from values " + ", ".join(f"({quote(r)}, {quote(v)})" for r, v in rules) + " as t(rule, verdict)")
    at = F.locate("/", F.concat("rule", F.lit("/")))
    return rows.select("rule", "verdict", F.substring("rule", F.lit(1), at - 1).alias("rule_host"), F.substring("rule", at, F.length("rule")).alias("rule_path"))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(urls: DataFrame, rules: DataFrame, learned: DataFrame) -> DataFrame:
    """row, host, path, rule, verdict, mined (the learned rule that fits best) for urls (row, host, path, tokens)."""
    small = rules.count() <= BROADCAST_RULES
    listed = urls.where("host <> ''").select("row", "path", F.explode(host_suffixes(F.col("host"))).alias("rule_host"))
    fits = listed.join(F.broadcast(rules) if small else rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("row").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("hit"))
    mined = matched_rules(urls, learned)
    joined = urls.join(best, "row", "left").join(mined, "row", "left")
    own = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return joined.select("row", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "mined")


#: The production list.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split_urls(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").alias("_url"))
    return parts.withColumn("tokens", tokens_of(F.col("_url"), F.col("host"), F.col("path"))).drop("_url").withColumn("row", F.monotonically_increasing_id())


def labelled_urls(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, tokens, block) of urls whose path ends with the number of a labelled document: block where it is bad or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) as bigint)")
    return urls.select("tokens", number.alias("doc_id")).join(bad, "doc_id").select("doc_id", "tokens", F.coalesce("block", F.lit(False)).alias("block"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    urls = materialize(split_urls(table(spark, sf_dir, "pages").select("page_id", "url")), "urls")
    labelled = labelled_urls(urls, table(spark, sf_dir, "labels"))
    judged = judge(urls, given_rules(spark, RULES), significant_rules(labelled))
    return judged.join(urls.select("row", "page_id"), "row").select("page_id", "host", "path", "rule", "verdict", "mined")


QUERIES = {"op9_url_rules": op9_url_rules}
ORACLES: dict[str, str] = {}
