"""URL filters: explicit rules first, then mined association rules.

Explicit rules are (host, path, verdict). A url's host is what stands after the first
``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path goes on from
there up to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path
starts with the rule's; the longest rule wins. Rules meet urls by equality on the host's
suffixes, not by a scan of all pairs.

The other urls are judged by association rules. Transactions are the labelled urls' tokens
(scheme, labels of the host, first path segments, file ending, query keys) with their
label; here the labels are the explicit rules' verdicts. Spark's FP-growth mines token
combinations of at least ``SUPPORT`` of the labelled urls, and rules "tokens -> label" of at
least ``CONFIDENCE`` and a lift over ``LIFT`` stay. Tokens that stand in exactly the same
labelled urls say the same: they are one item while combinations are mined (of a url form
with forty query keys one item is left, not 2**40 combinations), and any of them fulfils the
item where rules are matched, as if the rule were written out for each. A rule whose tokens hold those of a kept
rule that is as confident says nothing more and is pruned. Matching goes by an inverted
index: each rule stands under its rarest token, token sets that many urls share are matched
once, and the other tokens are then compared. The most confident rule decides, then the one
with more support, then block before allow; without a rule the url is allowed.

Only DataFrame functions run here, and the JVM's FP-growth.

Defined cases: a null url, or one without ``://``, has empty host and path, no tokens, no
rule, and is allowed; of equal explicit rules one by name decides; without labelled urls
nothing is mined; urls may have any number of tokens; repeated rows give repeated results; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.llm.common import stored

SUPPORT, CONFIDENCE, LIFT, LEAST_URLS = 0.005, 0.9, 1.05, 5
SEGMENTS = 2
LABEL = "label="


def host_and_path(url) -> tuple:
    """(host, path) expressions of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (page_id, url) with host, path, and the winning rule and its verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    table = spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    # a rule list is a parameter: every distinct (host, path) finds its rule once
    kinds = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = (kinds.join(table, "rule_host").where(F.expr("startswith(path, rule_path)"))
            .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "rule_verdict")).alias("best"))
            .select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best.rule", "best.rule_verdict"))
    return rows.join(fits, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left").drop("of_host", "of_path")


def tokens(host, path, url):
    """Distinct tokens of a url; numbers are one token, so that sets repeat."""
    plain = lambda x: F.regexp_replace(x, r"\d+", "0")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("query="), plain(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))),
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), plain(x))),
        F.transform(F.slice(segments, 1, SEGMENTS), lambda x, k: F.concat(F.lit("path"), k.cast("string"), F.lit("="), plain(x))),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")), keys)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(tokens, label, confidence, support) of the rules that the labelled token sets
    (columns tokens, label) support."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    n = items.count()
    schema = "tokens array<string>, label string, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=max(support, min(1.0, LEAST_URLS / n)), minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL)).where(F.col("lift") > lift)
    found = found.where(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = stored(found.select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(LABEL) + 1})").alias("label"),
                                "confidence", "support"), "mined")
    # a rule is pruned where one with a token less (its least confident part does) is as confident
    less = (rules.where(F.size("tokens") > 1).withColumn("out", F.explode("tokens"))
            .select("tokens", "label", "confidence", F.array_remove(F.col("tokens"), F.col("out")).alias("fewer"))
            .join(rules.select(F.col("tokens").alias("fewer"), "label", F.col("confidence").alias("already")), ["fewer", "label"])
            .where("already >= confidence").select("tokens", "label").distinct())
    return rules.join(less, ["tokens", "label"], "left_anti")


def alike(labelled: DataFrame) -> DataFrame:
    """(token, item) of the labelled urls' tokens (column tokens): tokens of the same rows
    share an item, the first of them. Rows are told apart by two 64-bit sums."""
    row = F.monotonically_increasing_id()
    held = stored(labelled.select(row.alias("row"), "tokens"), "labelled").select("row", F.explode("tokens").alias("token"))
    by = ["n", "x", "y"]
    rows = held.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("y"))).alias("y"))
    first = rows.groupBy(*by).agg(F.min("token").alias("item"))
    return stored(rows.join(first, by).select("token", "item"), "alike")


def as_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (distinct tokens, further columns) with ``items``, those that their tokens fulfil."""
    key = [c for c in rows.columns]
    found = rows.select(*key, F.explode("tokens").alias("token")).join(items, "token").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found  # at most as many items as the url has tokens


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, label, by) of the distinct token sets that a rule fits: the deciding rule."""
    common = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rules = rules.withColumnRenamed("tokens", "needed")
    rarest = (rules.withColumn("token", F.explode("needed")).join(common, "token")
              .groupBy("needed", "label", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("r"), F.count("*").alias("known"))
              .where(F.col("known") == F.size("needed")).withColumn("token", F.col("r.token")).drop("r", "known"))
    hit = (sets.withColumn("token", F.explode("tokens")).join(rarest, "token")
           .where(F.size(F.array_except("needed", "tokens")) == 0))
    return (hit.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "label", "needed")).alias("best"))
            .select("tokens", F.col("best.label").alias("label"), F.col("best.needed").alias("by")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = with_rule(pages, rules).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    rows = stored(rows.drop("url"), "urls")
    labelled = rows.where("rule is not null and size(tokens) > 0").select("tokens", F.col("rule_verdict").alias("label"))
    items = alike(labelled)
    # equal labelled urls are one row with a count while their tokens are looked up
    counted = as_items(labelled.groupBy("tokens", "label").agg(F.count("*").alias("n")), items)
    mined = mine(counted.select(F.col("items").alias("tokens"), "label", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col"))
    sets = stored(as_items(rows.where("rule is null and size(tokens) > 0").select("tokens").distinct(), items), "kinds")
    hit = match(sets.select(F.col("items").alias("tokens")).distinct(), mined).withColumnRenamed("tokens", "items")
    found = sets.join(hit, "items").select(F.col("tokens").alias("of"), "label", "by")
    out = rows.join(found, F.col("rule").isNull() & (F.col("tokens") == F.col("of")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "label", F.lit("allow")).alias("verdict"),
                      F.array_join("by", " ").alias("mined_rule"))
