"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark's own feature hashing and regression only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without_summary

LENGTHS, FEATURES, STRENGTH = (3, 4, 5), 1 << 15, 1e-3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labelled URLs: fixed training values. Each topic word is put together with general words into host names.
BLOCKED = """
casino slots jackpot poker roulette blackjack betting bets bingo lottery gambling
porn xxx sexcam escort nude adult hookup webcam
viagra cialis pharmacy pills steroids slimming potency
ads adserver banner popunder clickads adtracker tracking pixel telemetry affiliate sponsored
warez keygen crack torrent serials cheats
payday loans replica crypto doubler giveaway prize ringtones survey
phishing malware trojan botnet spam mailer clickbait
""".split()
ALLOWED = """
library museum university college school research science history wiki docs dictionary language
garden cooking recipes bakery coffee kitchen farmer fishing travel maps railway airport harbour hotel
council government parliament health clinic hospital dentist nurse emergency weather climate ocean
music concert theatre cinema gallery painting poetry essays letters books reader publisher journal
news tribune herald gazette review magazine radio television podcast community forum support
software developer code archive database network hardware robotics physics chemistry biology mathematics
football tennis chess hiking cycling swimming astronomy photo camera design studio furniture carpenter
insurance bank finance market shop grocery bicycle motor energy solar water forest animal bird
children family parents wedding charity church volunteer village town region island mountain river
""".split()
#: General words that go before or after a topic word, endings and paths: of either label alike.
_WORDS = "my the new best top web go first city home live daily world planet center group house point line club".split()
_ENDINGS = ("com", "net", "org", "info", "co.uk", "eu", "io")
_PATHS = ("/", "/index.html", "/about", "/2021/05/item-{n}", "/articles/{n}", "/view.php?id={n}", "/category/list/{n}.html", "/contact#form")


def labelled_urls(spark: SparkSession, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, each: int = 6) -> DataFrame:
    """The small labelled URL table: url and label (1: block); `each` hosts of every topic word."""
    rows = [("", 0.0)]
    for label, topics in ((1.0, blocked), (0.0, allowed)):
        for i, topic in enumerate(topics):
            for j in range(each):
                k = 7 * i + 11 * j
                word = _WORDS[k % len(_WORDS)]
                name = (topic, f"{word}-{topic}", f"{topic}-{word}", f"{word}{topic}", f"{topic}{word}", f"{topic}{k % 90 + 10}")[j % 6]
                url = f"https://{('', 'www.')[k % 2]}{name}.{_ENDINGS[k % len(_ENDINGS)]}{_PATHS[(i + j) % len(_PATHS)].format(n=100 + 37 * k)}"
                rows.append((url, label))
    table = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in rows])
    return spark.range(0, 1, 1, 1).select(F.explode(table).alias("r")).select("r.*")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without '://'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and its verdict (both null if none fits) out of a short list of (verdict, host + path prefix); the longest wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, tail = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + tail))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _grams(df: DataFrame) -> DataFrame:
    """df (host, path) with grams: every character n-gram of ^host$ and of the path, marked by where it is from."""

    def of(text: Column, mark: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        parts = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, parts).otherwise(F.array().cast("array<string>"))

    host = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.lit("^"), "host", F.lit("$")))
    return df.withColumn("grams", F.concat(*[of(text, mark, n) for text, mark in ((host, "h"), (F.col("path"), "p")) for n in LENGTHS]))


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(_grams(df))


def train(labelled: DataFrame, strength: float = STRENGTH) -> LogisticRegressionModel:
    """Fit on a small table (url, label: 1.0 for block)."""
    host, path = url_parts(F.col("url"))
    table = _hashed(labelled.select(host.alias("host"), path.alias("path"), "label"))
    return without_summary(LogisticRegression(regParam=strength, maxIter=60, standardization=False).fit(table), labelled.sparkSession)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel) -> DataFrame:
    """page_id, host, path, rule and verdict ('allow' or 'block') of every page, and the model's score.

    A rule's verdict comes first; else the model blocks from 0.5 up. A null URL,
    or one without '://', has an empty host and path, fits no rule, and is
    judged by the model's intercept. Repeated rows, and rows with a null
    page_id, are judged like any other; a URL of any length is judged whole;
    other columns are not read.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parts = _hashed(pages.select("page_id", host.alias("host"), path.alias("path")))
    scored = model.transform(parts).withColumn("score", vector_to_array("probability")[1])
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
