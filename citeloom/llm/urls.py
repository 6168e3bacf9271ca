"""URL filter: rules by host and path, and a logistic regression for the rest.

The model sees hashed character n-grams of host and path and is trained from a
small labelled table of URLs, ``labelled`` unless another is given.  Splitting, rules, n-grams, hashing and scoring are
DataFrame and MLlib operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host and path, verdict); the longest that fits wins.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

#: Words in the hosts of labelled URLs, by verdict, and what stands beside them in both.
BLOCKED = (
    "casino poker betting bets lottery slots jackpot pills pharmacy viagra loans payday adult sex porn escort dating "
    "ads adserver banner popup tracker clicks spam malware phishing warez replica"
).split()
ALLOWED = (
    "library university college museum gallery theatre music news journal press weather climate garden recipes kitchen "
    "school hospital health science history language travel railway harbour cinema football village council church forum "
    "docs software manual books letters poetry nature forest mountain river market bakery bicycle sports orchestra report law"
).split()
BESIDE = "best my online city free daily world the top club center home 24 net".split()
SITES = ("", "www.", "m.", "blog.")
PATHS = ("", "/", "/en/12", "/de/3.html", "/page/4", "/index", "/fr/81/", "/item")

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
REGULARISATION = 0.003


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule for the host or a parent domain whose path begins the url's.

    The rules are a parameter of the query, tested one after the other.
    """
    found = [F.lit(None).cast("string")]
    for rule in sorted((r for r, _ in rules), key=lambda r: (-len(r), r)):
        domain, _, rest = rule.partition("/")
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        found.insert(-1, F.when(fits & F.startswith(path, F.lit("/" + rest)), F.lit(rule)))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def with_grams(rows: DataFrame, text: str, mark: str, name: str) -> DataFrame:
    """Add the character n-grams of a column; ``mark`` keeps host and path apart.

    Each length is made from the one before and the characters further on, so the work
    is in proportion to the text.
    """
    rows = rows.withColumn("_chars", F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    made, grams = F.transform("_chars", lambda c: F.concat(F.lit(mark), c)), []
    for n in range(2, max(GRAMS) + 1):
        further = F.slice("_chars", n, F.greatest(F.size("_chars") - (n - 1), F.lit(0)))
        # Beyond the end one side is null, and so is what is made of it.
        made = F.zip_with(made, further, lambda x, y: F.concat(x, y))
        if n in GRAMS:
            grams.append(made)
    return rows.withColumn(name, F.array_compact(F.concat(*grams))).drop("_chars")


def featured(urls: DataFrame) -> DataFrame:
    """Add ``features`` to rows with ``host`` and ``path``."""
    framed = F.when(F.col("host") != "", F.concat(F.lit("^"), F.col("host"), F.lit("$"))).otherwise("")
    grams = with_grams(with_grams(urls.withColumn("_host", framed), "_host", "h", "_hosts"), "path", "p", "_paths")
    grams = grams.withColumn("grams", F.concat("_hosts", "_paths")).drop("_host", "_hosts", "_paths")
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams)


def labelled(spark: SparkSession) -> DataFrame:
    """``url, label`` of URLs made of the words above: each word stands alone, before,
    after and between others; both labels have the same neighbours, sites and paths."""
    rows = []
    for label, found in ((1.0, BLOCKED), (0.0, ALLOWED)):
        for i, word in enumerate(found):
            one, other = BESIDE[i % len(BESIDE)], BESIDE[(i * 5 + 3) % len(BESIDE)]
            for k, host in enumerate((word, one + word, f"{other}-{word}", f"{word}-{one}", word + other)):
                at = i + 3 * k
                rows.append((f"http://{SITES[at % len(SITES)]}{host}.test{PATHS[at % len(PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def trained(table: DataFrame) -> LogisticRegressionModel:
    """Logistic regression from labelled URLs (``url``, ``label`` 1 for block)."""
    split = table.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return LogisticRegression(regParam=REGULARISATION, standardization=False, maxIter=60).fit(featured(split))


def judged(
    pages: DataFrame,
    model: LogisticRegressionModel,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, risk`` of every row.

    ``risk`` is the model's probability of block; it decides (from 0.5) where no
    rule fits.  A null url or one without ``://`` has an empty host and path and
    is allowed.  Repeated rows are judged one by one; urls are read whole, however
    long; a table without rows gives none; other columns are ignored.
    """
    split = pages.select(
        F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    scored = model.transform(featured(split)).withColumn("risk", vector_to_array("probability")[1])
    verdicts = F.create_map(*[F.lit(x) for pair in (*rules, ("", "allow")) for x in pair])
    learnt = F.when((F.col("risk") >= 0.5) & ((F.col("host") != "") | (F.col("path") != "")), "block").otherwise("allow")
    verdict = F.coalesce(F.element_at(verdicts, F.col("rule")), learnt)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "risk")
