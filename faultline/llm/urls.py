"""URL filter: host and path rules first, else a ratio of character language models. Spark expressions only.

Two character models, of accepted and of rejected URLs, are smoothed over variable orders: a context of
two characters backs off to one and to none with Witten-Bell weights, so that the order used follows
the counts. Characters fold to 32 symbols; the log-likelihood ratio of a symbol after its context is
then one of 32^3 numbers, a bound that no input moves, and travels as one scalar array. A URL's score
is the mean ratio over its symbols (length-normalised); the threshold is calibrated on a tenth of the
training URLs, by hash, that the counts leave out.

Training URLs may be given. Otherwise every URL of the table is one: it counts as rejected if its host
or path holds a word of UNWANTED between separators, as accepted if not. The rules take no part in this,
so their hosts and languages teach the models nothing. Seed URLs made from UNWANTED and WANTED by one
pattern stand beside the table, so that both models exist where it holds no unwanted URL. All URLs are
counted, so what the models gather grows with the table.

A null URL, or one without ``://``, has an empty host and path; the models read the whole URL after its
scheme, or all of it without one, and a null one as the empty string. With an empty table the result is
empty. Repeated URLs get equal verdicts. Only the id and the URL are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOLS, EDGE = 32, 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols by number: letters, any digit, three separators, anything else (30), the edge of the string (31).
_ALPHABET = _LOWER + "0/.-"
#: Score bins of the calibration, each 0.02 wide.
_BIN, _MOST = 0.02, 400


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


# The rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


# Words of unwanted sites, and of ordinary ones for the seed URLs.
UNWANTED = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "bonus", "cams", "casino", "cheap", "cialis", "clickbait", "crack", "dating", "escort", "gamble", "gambling", "jackpot", "keygen", "loan", "loans",
    "lottery", "malware", "nude", "payday", "pharmacy", "phish", "pills", "poker", "popup", "porn", "replica", "roulette", "sex", "slots", "spam", "spyware", "torrent", "track", "tracker", "viagra", "warez", "xxx",
)
WANTED = (
    "about", "archive", "article", "blog", "book", "city", "college", "community", "docs", "education", "events", "forum", "garden", "guide", "health", "help", "history", "home", "journal", "kitchen", "lab", "learn",
    "library", "magazine", "map", "museum", "music", "nature", "news", "park", "people", "press", "project", "recipes", "research", "river", "school", "science", "stories", "street", "travel", "university", "weather",
)


def unwanted(url: Column) -> Column:
    """A word of UNWANTED stands between separators in the host or the path."""
    return F.concat(host_of(url), path_of(url)).rlike(rf"(?i)(?<![A-Za-z0-9])({'|'.join(UNWANTED)})(?![A-Za-z0-9])")


def seed_urls(spark: SparkSession) -> DataFrame:
    """url, good: each word in a host beside another word of its list."""
    hosts = [(f"{word}-{words[(k + 1) % len(words)]}", good) for words, good in ((UNWANTED, False), (WANTED, True)) for k, word in enumerate(words)]
    return spark.createDataFrame(hosts, "host string, good boolean").select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), "good")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _text(url: Column) -> Column:
    """What the models read: the whole URL after its scheme, with query and fragment; all of it without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, _rest(url)).otherwise(url), F.lit(""))


def _first_fit(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """The value of the longest rule that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return F.lit(None).cast("string") if out is None else out


def grams(text: Column) -> Column:
    """The numbers of a text's symbol triples: two edges stand before it, one after it."""
    folded = F.translate(F.translate(text, _UPPER, _LOWER), "0123456789", "0000000000")
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(_ALPHABET)), F.lit(0)) - 1, F.lit(30)))
    edge = F.array(F.lit(EDGE))
    pairs = F.zip_with(F.concat(edge, edge, codes), F.concat(edge, codes, edge), lambda x, y: x * SYMBOLS + y)
    # the third symbols are one fewer than the pairs; the last pair has none
    return F.filter(F.zip_with(pairs, F.concat(codes, edge), lambda p, z: p * SYMBOLS + z), lambda t: t.isNotNull())


def _model(counted: DataFrame) -> DataFrame:
    """One row, one array: the log ratio of every triple. ``counted``: gram, good, bad."""
    cells = counted.sparkSession.range(SYMBOLS**3).select(F.col("id").cast("int").alias("gram"))
    t = cells.join(counted, "gram", "left").fillna(0, ["good", "bad"])
    last, context = F.col("gram") % SYMBOLS, F.floor(F.col("gram") / SYMBOLS).cast("int")
    t = t.withColumns({"last": last, "context": context, "pair": F.col("gram") % SYMBOLS**2, "near": F.floor(F.col("gram") / SYMBOLS).cast("int") % SYMBOLS})
    by = Window.partitionBy
    for k in ("good", "bad"):
        t = t.withColumns({f"{k}1": F.sum(k).over(by("pair")), f"{k}0": F.sum(k).over(by("last"))})
        t = t.withColumns({
            f"{k}_n2": F.sum(k).over(by("context")), f"{k}_t2": F.sum((F.col(k) > 0).cast("int")).over(by("context")),
            # a pair stands in SYMBOLS triples, so sums over the middle symbol count each pair so often
            f"{k}_n1": F.sum(k).over(by("near")), f"{k}_t1": F.sum((F.col(f"{k}1") > 0).cast("int")).over(by("near")) / SYMBOLS,
            f"{k}_n": F.sum(k).over(by(F.lit(0))),
        })
        p0 = (F.col(f"{k}0") + 1) / (F.col(f"{k}_n") + SYMBOLS)
        p1 = F.when(F.col(f"{k}_n1") > 0, (F.col(f"{k}1") + F.col(f"{k}_t1") * p0) / (F.col(f"{k}_n1") + F.col(f"{k}_t1"))).otherwise(p0)
        p2 = F.when(F.col(f"{k}_n2") > 0, (F.col(k) + F.col(f"{k}_t2") * p1) / (F.col(f"{k}_n2") + F.col(f"{k}_t2"))).otherwise(p1)
        t = t.withColumn(f"log_{k}", F.log(p2))
    ratio = F.array_sort(F.collect_list(F.struct("gram", (F.col("log_good") - F.col("log_bad")).alias("r"))))
    return t.agg(F.transform(ratio, lambda x: x["r"]).alias("model"))


def _score(triples: Column, model: Column) -> Column:
    return F.aggregate(triples, F.lit(0.0), lambda a, g: a + F.get(model, g)) / F.size(triples)


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the bin edge of the best balanced accuracy over (score, good); 0 if a class is missing."""
    at = F.greatest(F.least(F.floor(F.col("score") / _BIN), F.lit(_MOST)), F.lit(-_MOST)).cast("int")
    bins = scored.groupBy(at.alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    below = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = bins.select("bin", F.sum("g").over(whole).alias("goods"), F.sum("b").over(whole).alias("bads"), F.coalesce(F.sum("g").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("caught"))
    fair = (1 - F.col("lost") / F.col("goods")) + F.col("caught") / F.col("bads")
    best = F.max_by(F.col("bin") * _BIN, F.struct(fair, -F.abs("bin"))).alias("t")
    return ranked.where("goods > 0 and bads > 0").agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, training: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score. ``training``: url, good (boolean)."""

    def parts(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"), _text(F.col(url_column)).alias("text"))

    rows = parts(pages, id_column).withColumns({
        "rule": _first_fit(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.host + r.path)),
        "ruled": _first_fit(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.verdict)),
    })
    if training is None:
        url = F.col(url_column)
        training = pages.select(url_column, (~F.coalesce(unwanted(url), F.lit(False))).alias("good")).where(url.isNotNull() & (url != "")).unionByName(seed_urls(pages.sparkSession).withColumnRenamed("url", url_column))
    known = parts(training.where("good is not null"), "good")
    known = known.select("good", grams(F.col("text")).alias("triples"), (F.pmod(F.xxhash64("text"), F.lit(10)) == 0).alias("held"))
    counted = known.where("not held").select("good", F.explode("triples").alias("gram")).groupBy("gram").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    model = _model(counted)
    # the array stands beside the rows as a subquery's value; a subquery may not stand inside a lambda
    held = known.where("held").withColumn("model", model.scalar())
    threshold = _threshold(held.select("good", _score(F.col("triples"), F.col("model")).alias("score")))
    scored = rows.withColumn("model", model.scalar()).withColumn("score", _score(grams(F.col("text")), F.col("model")))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block"))
    return scored.select(id_column, "host", "path", "rule", verdict.alias("verdict"), "score")
