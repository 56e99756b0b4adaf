"""URL filtering: host and path rules, and gradient-boosted trees for what no rule decides.

The trees see only the characters of a URL: lengths, depth, the share of digits and other
signs, the entropy of its characters, how many parameters it has, and how often
labelled URLs with its host's last label were blocked.  They are trained from labelled URLs, of
which a bounded sample is taken by a hash.  All columns are built-in functions, so
features and predictions stay inside one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Names of the lexical features.
FEATURES = ["f_length", "f_host", "f_path", "f_query", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_other", "f_entropy", "f_params", "f_secure", "f_extension", "f_longest", "f_suffix"]


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``; null if none fits.

    ``rules``: pairs of a rule (``host/path prefix``) and ``allow`` or ``block``.  A rule fits its
    host and its subdomains, if the path starts with the rule's.  Rules of the same
    length: the first given.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds the lexical features but the suffix's, and ``suffix``, the last label of the host."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda text, letters: F.char_length(text) - F.char_length(F.regexp_replace(text, letters, ""))
    share = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.transform(F.array_distinct(F.split(url, F.lit(""))), share), F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))
    longest = F.coalesce(F.array_max(F.transform(F.split(url, r"[^A-Za-z0-9]+"), F.char_length)), F.lit(0))
    columns = {
        "f_length": F.char_length(url), "f_host": F.char_length(host), "f_path": F.char_length(path), "f_query": F.char_length(query),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "f_labels": F.size(F.split(host, r"\.")),
        "f_digits": count(url, "[0-9]") / n, "f_hyphens": count(url, "[-_]"), "f_other": count(url, r"[^A-Za-z0-9./:_-]") / n, "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))), "f_secure": F.startswith(F.lower(url), F.lit("https")),
        "f_extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")), "f_longest": longest,
    }
    return urls.withColumns({k: v.cast("double") for k, v in columns.items()} | {"suffix": F.substring_index(host, ".", -1)})


class Trees:
    """Gradient-boosted trees fitted to labelled URLs."""

    def __init__(self, labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", most_rows: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 7):
        """``label_col``: 1 for block, 0 for allow; other rows and null URLs are left out.

        At most ``most_rows`` distinct URLs are used, those with the smallest hash.  If only
        one class is there, it is the answer for all; without rows everything is allowed.
        """
        known = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(url_col).alias("url")).agg(F.max(label_col).cast("double").alias("label"))
        few = saved(known.orderBy(F.xxhash64(F.lit("url sample"), "url"), "url").limit(most_rows), "url-sample")
        self.classes = sorted(r[0] for r in few.select("label").distinct().collect())
        self.model = None
        if len(self.classes) < 2:
            return
        rows = lexical(few, "url")
        prior = few.agg(F.avg("label")).first()[0]
        # At most as many suffixes as the sample has rows.
        self.suffixes = saved(rows.groupBy("suffix").agg(((F.sum("label") + 5 * prior) / (F.count("*") + 5)).alias("f_suffix")), "url-suffixes")
        self.prior = prior
        ready = self._assembled(rows).select("features", "label").coalesce(2)
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False, checkpointInterval=-1).fit(ready)

    def _assembled(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(self.suffixes), "suffix", "left").withColumn("f_suffix", F.coalesce("f_suffix", F.lit(self.prior)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)

    def score(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds ``block_score``, the probability of block."""
        if self.model is None:
            return urls.withColumn("block_score", F.lit(self.classes[0] if self.classes else 0.0))
        out = self.model.transform(self._assembled(lexical(urls, url_col)))
        return out.select(*urls.columns, vector_to_array("probability")[1].alias("block_score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, url_col: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """Adds ``host, path, rule, verdict, block_score`` to every row.

    A rule's verdict holds; what no rule fits is blocked if the trees give at least
    ``threshold``.  They are trained from ``labelled`` (``url, label``); without it, from the
    URLs that the rules decide.  Null URLs and those without ``://`` have an empty host and
    path and are judged by the trees.  Rows are independent: ties, repeated rows and
    empty tables need no care; columns named like the new ones are replaced.
    """
    new = ["host", "path", "rule", "verdict", "block_score"]
    plain = pages.drop(*[c for c in new if c in pages.columns and c != url_col])
    host, path = host_of(url_col), path_of(url_col)
    if labelled is None:
        decided = pages.select(F.col(url_col).alias("url"), rule_of(host, path, rules)["verdict"].alias("v"))
        labelled = decided.where("v IS NOT NULL").select("url", (F.col("v") == "block").cast("int").alias("label"))
        labelled_url = "url"
    else:
        labelled_url = url_col
    scored = Trees(labelled, url_col=labelled_url, **options).score(plain, url_col)
    fit = rule_of(host, path, rules)
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.withColumns({"host": host, "path": path, "rule": fit["rule"], "verdict": F.coalesce(fit["verdict"], own)}).select(*plain.columns, *new)
