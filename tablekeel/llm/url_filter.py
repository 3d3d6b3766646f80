"""URL filters [native]: rules by host and path, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import ascii_lower, settle, table

#: Fixed values: (host, path, verdict) of the rules that the query applies.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits. Of equally long ones the first wins."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # what comes later here wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(-F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


FEATURES = ["chars", "depth", "digit_ratio", "host_entropy", "path_entropy", "params", "labels", "dashes", "section_rate", "suffix_rate", "suffix_weight", "secure", "extension", "fragment"]


def lexical(urls: DataFrame) -> DataFrame:
    """Add lexical features to rows with ``url, host, path``: rounded, so that many rows share a vector."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1))
    return (
        urls.withColumn("chars", F.length(url).cast("double"))
        .withColumn("depth", F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"))
        .withColumn("digit_ratio", F.round(F.regexp_count(url, F.lit("[0-9]")) / n, 2))
        .withColumn("host_entropy", F.round(entropy(host), 1))
        .withColumn("path_entropy", F.round(entropy(path), 1))
        .withColumn("params", F.when(url.contains("?"), F.regexp_count(url, F.lit("[?&][^=&#]+="))).otherwise(0).cast("double"))
        .withColumn("labels", F.size(F.split(host, r"\.")).cast("double"))
        .withColumn("dashes", F.regexp_count(host, F.lit("-")).cast("double"))
        .withColumn("secure", url.startswith("https").cast("double"))
        .withColumn("extension", path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"))
        .withColumn("fragment", url.contains("#").cast("double"))
        .withColumn("suffix", F.substring_index(host, ".", -1))
        .withColumn("first_segment", F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")))
        .withColumn("section", F.concat_ws("/", "suffix", "first_segment"))
    )


def parted(urls: DataFrame) -> DataFrame:
    """Lexical features of rows with ``url``, and their host and path."""
    return lexical(urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))


@dataclass
class Model:
    """Boosted trees, and the statistics of suffixes and sections (suffix and first path segment) they need."""

    smooth: float
    counts: dict[str, DataFrame]
    trees: GBTClassificationModel | None = None

    def complete(self, urls: DataFrame, training: bool = False) -> DataFrame:
        """Add shares of blocked URLs among the labelled ones, smoothed towards a half.

        In ``training`` a row sees what URLs of new hosts will see: its own fold of hosts is left
        out, and for a quarter of the URLs the section is unknown, for another one the suffix too.
        """
        unknown = F.pmod(F.xxhash64(F.lit("unknown"), "url"), F.lit(4))
        for key in ("suffix", "section"):
            held = self.counts[key]
            urls = urls.join(held.groupBy(key).agg(F.sum("b").alias("_b"), F.sum("n").alias("_n")), key, "left")
            b, n = F.coalesce("_b", F.lit(0.0)), F.coalesce("_n", F.lit(0))
            if training:
                urls = urls.join(held.select(key, "fold", F.col("b").alias("_fb"), F.col("n").alias("_fn")), [key, "fold"], "left")
                b, n = b - F.coalesce("_fb", F.lit(0.0)), n - F.coalesce("_fn", F.lit(0))
                hidden = unknown == 0 if key == "suffix" else unknown <= 1
                b, n = F.when(hidden, 0.0).otherwise(b), F.when(hidden, 0).otherwise(n)
            above = F.lit(0.5) if key == "suffix" else F.col("suffix_rate")  # a section without URLs is taken for its suffix
            urls = urls.withColumn(f"{key}_rate", F.round((b + self.smooth * above) / (n + self.smooth), 3)).withColumn(f"{key}_weight", F.round(F.log1p(n), 1)).drop("_b", "_n", "_fb", "_fn")
        return urls

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` with lexical features, and ``block_score``."""
        made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.complete(urls))
        return self.trees.transform(made).withColumn("block_score", vector_to_array("probability")[1])


def learn(known: DataFrame, trees: int = 12, depth: int = 3, smooth: float = 20.0, folds: int = 5) -> Model | float:
    """Grow trees from rows with lexical features and ``label``; where all labels are equal, or there are none, the share of blocked ones instead.

    Statistics enter as smoothed shares, taken over the hosts of other folds. Blocked and allowed
    URLs weigh the same in all. Equal feature vectors are summed up into weights before the trees
    are grown.
    """
    prior, n = known.agg(F.avg("label"), F.count(F.lit(1))).first()
    if not n or prior in (0.0, 1.0):
        return prior or 0.0
    known = known.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    counts = {k: settle(known.groupBy(k, "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")), k) for k in ("suffix", "section")}
    model = Model(smooth, counts)
    balanced = F.count(F.lit(1)) / F.when(F.col("label") == 1, 2 * prior).otherwise(2 - 2 * prior)
    weighted = settle(model.complete(known, training=True).groupBy("label", *FEATURES).agg(balanced.alias("weight")), "vectors")
    grower = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, minInfoGain=0.001, minWeightFractionPerNode=0.02, seed=11)
    model.trees = grower.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(weighted).select("features", "label", "weight"))
    return model


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str, url_col: str) -> DataFrame:
    """Rows ``page_id, url`` with lexical features, ``rule`` and its verdict ``ruled``."""
    rows = parted(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def labelled_by_rules(rows: DataFrame) -> DataFrame:
    return rows.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, trees: int = 12, depth: int = 3, smooth: float = 20.0, least: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return per row ``page_id, host, path, rule, verdict, block_score``.

    ``labelled`` has ``url, label`` (1: block); by default the URLs that a rule fits, labelled by
    its verdict. A rule's verdict holds; other URLs get the trees' (see ``learn``), which block from a
    score of ``least`` on: a URL that nothing is known of scores about a half, and passes.

    A null URL, or one without ``://``, has an empty host and path and is judged like any other.
    Without labelled URLs of both kinds the verdict is the more frequent label, or ``allow``. Rows
    that repeat an id are judged each by itself. Other columns are ignored. An empty table gives an
    empty table.
    """
    rows = settle(ruled(pages, rules, id_col, url_col), "urls")
    known = labelled_by_rules(rows) if labelled is None else parted(labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label")))
    model = learn(known, trees, depth, smooth)
    if not isinstance(model, Model):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if model == 1.0 else "allow")).alias("verdict"), F.lit(model).alias("block_score"))
    return model.score(rows).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") >= least, "block").otherwise("allow")).alias("verdict"), "block_score")


def held_out(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, parts: int = 4, least: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row ``urls, right, blocked``: the trees' verdicts on labelled URLs of a quarter of the hosts, none of which they have seen."""
    known = labelled_by_rules(ruled(pages, rules, id_col, url_col)).withColumn("unseen", F.pmod(F.xxhash64(F.lit("unseen"), "host"), F.lit(parts)) == 0)
    known = settle(known, "urls")
    model = learn(known.where("NOT unseen"))
    score = model.score(known.where("unseen")) if isinstance(model, Model) else known.where("unseen").withColumn("block_score", F.lit(model))
    return score.agg(F.count(F.lit(1)).alias("urls"), F.count_if((F.col("block_score") >= least) == (F.col("label") == 1)).alias("right"), F.count_if(F.col("label") == 1).alias("blocked"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
