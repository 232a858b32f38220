"""URL filter: rules first, else logistic regression on hashed character n-grams.

Native: only DataFrame functions touch the URLs. The classifier is fitted on the driver from a
labelled table of at most `MAX_LABELLED` rows, whose features Spark made by the same expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound

#: At most so many labelled rows are used for fitting (those with the least hash).
MAX_LABELLED = 2000
#: Hashed features; the model is one array of so many numbers, whatever the size of the data.
DIMS = 4096
GRAMS = (3, 4)

# Rules (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# A small labelled table; 1 is unwanted (gambling, adult, pills, loans, downloads).
UNWANTED = """
casino-win.example/play best-casino.example/bonus/1 online-poker.example/en/ slots-jackpot.example/spin
bet-now.example/odds sport-betting.example/fr/win free-spins.example/casino roulette-king.example/
blackjack-win.example/en/7 mega-jackpot.example/win.html lucky-slots.example/de/ poker-cash.example/ref
xxx-video.example/watch adult-cams.example/live porn-tube.example/1 sexy-chat.example/en/ hot-xxx.example/
cheap-pills.example/buy viagra-shop.example/order cialis-online.example/en/ pills-pharmacy.example/discount
payday-loan.example/apply quick-loans.example/cash credit-fast.example/offer easy-cash.example/win
free-download.example/crack warez-keygen.example/file torrent-hub.example/get cracked-apps.example/serial
click-bonus.example/prize win-prize.example/claim lottery-winner.example/claim replica-watches.example/buy
casino.example/en/12 www.casino-win.example/de/9.html blog.casino-win.example/fr/3 m.casino-bonus.example/es/5
spam-links.example/seo buy-followers.example/cheap get-rich.example/crypto bitcoin-double.example/invest
""".split()
WANTED = """
news.example/2021/05/story.html blog.example/en/1042 www.library.example/catalogue/77 docs.example/guide/intro
university.example/research/paper museum.example/collection/12 weather.example/forecast/today city.example/transport
recipes.example/soup/tomato garden.example/plants/rose history.example/articles/rome science.example/physics/light
m.travel.example/paris/museums forum.example/t/33 wiki.example/Mathematics code.example/project/readme
www.school.example/lessons/4 health.example/sleep/advice music.example/review/album books.example/novel/1984
weekly.example/en/204 village-shop.example/de/38 orchestra.example/fr/programme theatre.example/es/tickets
www.cathedral.example/en/visit.html m.railway.example/de/timetable blog.sailing.example/fr/10 pottery.example/en/3
photo.example/gallery/8 maps.example/region/north events.example/calendar/may radio.example/show/morning
animals.example/birds/owl language.example/grammar/verbs film.example/festival/2019 bikes.example/repair/chain
kids.example/stories/fox space.example/missions/moon open-data.example/tables/census parks.example/trails/lake
""".split()


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else ''."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together) that fits; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Distinct hashed character n-grams: of `^host$` and of the path without digits."""

    def grams(text: Column, mark: str, n: int) -> Column:
        def of(letters: Column) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(1)))
            return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.array_join(F.slice(letters, i, n), "")), F.lit(DIMS)).cast("int"))

        return bound(F.split(text, ""), of)

    # The last label (com, net ...) and hyphens are left in; runs of digits become one 0.
    name = F.concat(F.lit("^"), F.regexp_replace(host, "[0-9]+", "0"), F.lit("$"))
    rest = F.regexp_replace(path, "[0-9]+", "0")
    return F.array_distinct(F.concat(*[grams(name, f"h{n}", n) for n in GRAMS], *[grams(rest, f"p{n}", n) for n in GRAMS]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("http://" + u, 1) for u in UNWANTED] + [("http://" + u, 0) for u in WANTED], "url string, label int")


def fit(labelled: DataFrame, epochs: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights (the bias last) by stochastic gradient descent in a fixed order. Rows with a null
    URL or a label other than 0 and 1 are ignored; without rows all weights are 0."""
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1))
        .select("url", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("url"), "url", "label")
        .limit(MAX_LABELLED)
        .select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), "label")
        .collect()
    )
    w = [0.0] * (DIMS + 1)
    for epoch in range(epochs):
        step = rate / (1 + 0.1 * epoch)
        for f, label in rows:
            scale = 1 / math.sqrt(len(f) or 1)
            z = w[DIMS] + scale * sum(w[i] for i in f)
            push = step * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for i in f:
                w[i] += scale * push - step * ridge * w[i]
            w[DIMS] += push
    return [round(x, 6) for x in w]


def score(f: Column, weights: list[float]) -> Column:
    """Probability of class 1; the weights are one literal array of DIMS + 1 numbers."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(f, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    z = F.lit(weights[DIMS]) + total / F.sqrt(F.greatest(F.size(f), F.lit(1)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge_urls(df: DataFrame, labelled: DataFrame, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """`df` with host, path, rule, spam_score and verdict; columns of these names are replaced.

    A rule's verdict stands; else block if the score is at least `threshold`. A null URL or one
    without `://` has an empty host and path, no rule, and the classifier's verdict on empty text.
    """
    weights = fit(labelled)
    out = df.drop("host", "path", "rule", "spam_score", "verdict") if url == "url" else df
    out = out.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", name).withColumn("spam_score", score(features(F.col("host"), F.col("path")), weights))
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("spam_score") >= threshold, "block").otherwise("allow")))
