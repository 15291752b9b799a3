"""Pattern rules over URLs: an index by each rule's rarest literal token fetches the few rules worth a regular expression.

A rule is ``host/path``: it fits its host and all subdomains, if the URL's path starts with the rule's. ``*`` stands for any run of
characters (of the host: without a slash), ``^`` for a border: a place with no letter or digit before or after it; a rule without a slash
fits any path. Of the fitting rules the one of the highest rank wins, then the longest, then the longer host, then block, then the last
by code point.

The literal tokens of a rule are the runs of A-Z, a-z and 0-9 that every URL it fits holds as whole tokens: those with something
else than a letter, a digit or ``*`` on both sides. One pass over the URLs counts them; each rule is filed under its rarest one (the first
of equals), or under the empty token, which every URL has. The distinct tokens of the URLs meet the index in an equijoin, and only
the rules met there run their regular expressions.

A token that more than one in _HOT_PARTS of the URLs hold is dealt over so many salts that each gets no more than that, on both sides of the join.
There are at most _HOT_PARTS such tokens for each token that a URL holds on the mean, so their list goes to all tasks. The join with the
index has no hint: Spark broadcasts it if it is small by its own measure.

Defined results: a null URL, or one without "://", has an empty host and path, which only rules like ``*`` fit. Repeated rows, ids and
null ids stay as they are; URLs of any length are read whole; an empty table gives no rows; without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest.llm.frames import stored

ALLOW, BLOCK = "allow", "block"
#: The fixed rules of the sample pages: (verdict, rule).
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HOT_PARTS = 1000
_BORDER = r"(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"


#: Hosts with one of these words between borders are blocked where no fixed rule fits.
UNWANTED = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")


def production_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules, of rank 1, and below them the words unwanted in hosts."""
    rows = [(v, r, 1) for v, r in RULES] + [(BLOCK, f"*^{word}^*", 0) for word in UNWANTED]
    return spark.createDataFrame(rows, "verdict string, rule string, rank int")


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct runs of letters and digits of a URL, and the empty token."""
    parts = F.split(F.concat_ws("/", host, path), "[^A-Za-z0-9]+")
    return F.array_union(F.array(F.lit("")), F.array_distinct(parts))


def compiled(rules: DataFrame) -> DataFrame:
    """(rule, verdict, rank, length, host_length, regex, tokens) out of (verdict, rule, rank); a rule that is there twice has the higher
    rank, and then blocks if one of the two does."""
    best = F.max(F.struct("rank", "verdict"))
    rules = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(best.alias("best")).select("rule", "best.*")
    rule, slash = F.col("rule"), F.instr("rule", "/") > 0
    host = F.translate(F.substring_index(rule, "/", 1), _UPPER, _UPPER.lower())
    path = F.when(slash, F.substr(rule, F.instr(rule, "/"))).otherwise(F.lit(""))

    def quoted(part: Column, any_run: str) -> Column:
        escaped = F.regexp_replace(part, r"([\x00-\x7F&&[^A-Za-z0-9*^]])", r"\\$1")
        return F.regexp_replace(F.regexp_replace(escaped, r"\^", _BORDER), r"\*+", any_run)

    ends = F.when(slash, F.lit("")).otherwise(F.lit(r"(?=/|\z)"))
    regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host, "[^/]*"), quoted(path, ".*"), ends)
    # A host starts and, without a path, ends at a border; a path may go on after the rule's last character.
    bordered = F.concat(F.lit("."), host, path, F.when(slash, F.lit("")).otherwise(F.lit("/")))
    tokens = F.regexp_extract_all(bordered, F.lit(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])"), F.lit(1))
    return rules.select(
        "rule", "verdict", "rank", F.length("rule").alias("length"), F.length(host).alias("host_length"), regex.alias("regex"), F.array_distinct(tokens).alias("tokens")
    )


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The rules of :func:`compiled` with ``token``: the one that fewest URLs hold by ``counts`` (token, n), or the empty one."""
    tokens = rules.select("rule", F.explode("tokens").alias("token"))
    rarest = tokens.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rules.drop("tokens").join(rarest, "rule", "left").withColumn("token", F.coalesce("rarest.token", F.lit(""))).drop("rarest")


def judge(urls: DataFrame, rules: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """The columns ``keep`` of every row with ``host``, ``path``, ``rule`` and ``rank`` (null if none fits), and ``verdict``.

    ``rules`` has (verdict, rule, rank), the verdicts ``allow`` and ``block``; a null rule counts for nothing.
    """
    kept = {f"kept_{i}": F.col(c) for i, c in enumerate(keep)}
    pages = urls.select(*[c.alias(n) for n, c in kept.items()], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    tokens = tokens_of(F.col("host"), F.col("path"))
    known = compiled(rules)

    literals = known.select(F.explode("tokens").alias("token")).distinct().unionByName(rules.sparkSession.range(1).select(F.lit("").alias("token")))
    seen = pages.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(seen.join(literals, "token", "left_semi"), "token_counts")
    whole = counts.where("token = ''").first()
    n_urls = whole.n if whole else 0
    dealt = counts.select("token", F.ceil(F.col("n") * _HOT_PARTS / max(n_urls, 1)).cast("int").alias("salts"))
    index = indexed(known, counts).join(dealt, "token", "left")
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    hot = dealt.where("salts > 1").withColumnRenamed("token", "hot_token")
    held = pages.withColumn("row", F.monotonically_increasing_id()).withColumn("held", F.explode(tokens))
    held = held.join(F.broadcast(hot), F.col("held") == F.col("hot_token"), "left")
    held = held.withColumn("its_salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("hot_token", "salts")
    met = held.join(index, (F.col("held") == F.col("token")) & (F.col("its_salt") == F.col("salt")), "left").where("token IS NOT NULL OR held = ''")
    fits = F.col("token").isNotNull() & F.expr("concat(host, path) rlike regex")
    candidate = F.when(fits, F.struct("rank", "length", "host_length", "verdict", "rule"))
    best = met.groupBy("row", *kept, "host", "path").agg(F.max(candidate).alias("best"))
    return best.select(
        *[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)], "host", "path", F.col("best.rule").alias("rule"), F.col("best.rank").alias("rank"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
