"""URL filters: host and path rules, and a logistic regression for what no rule fits.

Everything that touches the pages is a DataFrame expression: host and path are cut out,
rules are looked up, and the model adds one weight for each distinct hashed character
n-gram of host and path, looked up in one literal array. Only the small labelled table is
trained on, on the driver: it is bounded by ``MAX_LABELLED``.

Defined results: a null url and one without ``://`` have empty host and path and no rule,
and the model judges them by its bias; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams are counted into so many places.
PLACES = 4096
GRAM_SIZES = (3, 4)
REGULARISATION = 0.001
RATE = 0.5
ITERATIONS = 400
#: Rows that a labelled table may have; training reads all of them.
MAX_LABELLED = 10_000


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: A small labelled table for general use: sites that a corpus should take or block, each
#: with every form of host and path below, so that these forms say nothing by themselves.
TAKEN_SITES = (
    "city-library gardening history compiler university kitchen weather news theatre thorn inter museum "
    "mathematics athens hiking school research music birds court thunder teaching northern weaving tions ther "
    "thing heron there thand blend sheet handed tinder station nation"
).split()
BLOCKED_SITES = (
    "casino-win online-casino casino-slots free-bets sports-bets bets-now cheap-pills pills-online cheap-meds "
    "spam-farm link-farm content-farm ads-track ad-tracker track-ads adult-x adult-videos xxx-adult win-money free-win"
).split()
HOST_FORMS = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com")
PATH_FORMS = ("/en/12", "/de/7/", "/fr/431.html", "/es/88", "", "/")
LABELLED = tuple(
    (f"https://{host.format(site)}{PATH_FORMS[(i + j) % len(PATH_FORMS)]}", label)
    for label, sites in ((0, TAKEN_SITES), (1, BLOCKED_SITES))
    for i, site in enumerate(sites)
    for j, host in enumerate(HOST_FORMS)
)


def host_of(url: str) -> Column:
    after = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    whole = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.locate("/", whole)
    return F.when(at > 0, F.substring(whole, at, F.length(whole))).otherwise(F.lit(""))


def _after(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as (text, verdict), or null; equal lengths: the first."""
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    made = lambda r: F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
    ordered = sorted(rules, key=lambda r: -len(r.text))
    none = F.lit(None).cast("struct<text: string, verdict: string>")
    return F.coalesce(*[F.when(fits(r), made(r)) for r in ordered], none)


def places(host: Column, path: Column, n: int = PLACES, sizes=GRAM_SIZES) -> Column:
    """The distinct hashed n-grams of host and path, as places from 1."""

    def grams(tag: str, text: Column, k: int) -> Column:
        # all digits alike: numbers in paths say nothing
        ended = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        last = F.length(ended) - k + 1
        at = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(ended, i, F.lit(k))), F.lit(n)).cast("int") + 1)

    parts = [grams(tag, text, k) for tag, text in (("host", host), ("path", path)) for k in sizes]
    return F.array_distinct(F.concat(*parts))


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]

    def probability(self, places_: Column) -> Column:
        """That a url with these places is one to block."""
        # one constant, folded into a literal array before the plan runs
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        z = F.aggregate(places_, F.lit(self.bias), lambda a, i: a + F.element_at(table, i))
        return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame, url: str = "url", label: str = "label", n: int = PLACES) -> UrlModel:
    """Logistic regression of ``label`` (1: block) on the n-grams of ``url``, by gradient
    descent with momentum over the small table's places."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(
        places(host_of(url), path_of(url), n).alias("p"), F.col(label).cast("double").alias("y")
    )
    rows = rows.limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    if not rows:
        return UrlModel(0.0, (0.0,) * n)
    rows.sort(key=lambda r: (r["y"], r["p"]))
    y = np.array([r["y"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["p"]) for r in rows])
    place = np.array([i - 1 for r in rows for i in r["p"]], np.int64)
    weights, bias = np.zeros(n), 0.0
    speed, bias_speed = np.zeros(n), 0.0
    for _ in range(ITERATIONS):
        z = bias + np.bincount(row, weights[place], len(rows))
        off = (1 / (1 + np.exp(-z)) - y) / len(rows)
        speed = 0.9 * speed - RATE * (np.bincount(place, off[row], n) + REGULARISATION * weights)
        bias_speed = 0.9 * bias_speed - RATE * off.sum()
        weights, bias = weights + speed, bias + bias_speed
    return UrlModel(float(bias), tuple(float(w) for w in weights))


def judge(pages: DataFrame, model: UrlModel, rules: list[Rule], url: str = "url", least: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and
    ``block_probability`` of the model. Old columns of these names give way."""
    made = ("host", "path", "rule", "verdict", "block_probability")
    host, path = host_of(url), path_of(url)
    kept = [c for c in pages.columns if c not in made]
    cut = pages.select(*kept, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    cut = cut.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    cut = cut.withColumn("block_probability", model.probability(places(F.col("host"), F.col("path"), len(model.weights))))
    by_model = F.when(F.col("block_probability") >= least, F.lit("block")).otherwise(F.lit("allow"))
    return cut.select(
        *kept, "host", "path", F.col("_rule.text").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "block_probability",
    )


def labelled_table(like: DataFrame, rows=LABELLED) -> DataFrame:
    return like.sparkSession.createDataFrame(list(rows), "url string, label int")
