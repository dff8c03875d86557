"""Secrets in texts: fixed patterns, and random-looking tokens found by a battery of randomness tests.

Everything is SQL expressions in one projection per text; the only shuffles
carry a small histogram of test results and the result rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

# --- fixed values: the kinds, their patterns and least lengths ---------------
KEYWORDS = ("password", "passwd", "secret", "token")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# -----------------------------------------------------------------------------


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


_KEY = "|".join([*map(_either_case, KEYWORDS), f"{_either_case('api')}_?{_either_case('key')}"])
ASSIGN_HEAD = rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+"
# Candidates of the battery: unbroken runs of the characters that encodings use.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"

# Strata of the false-discovery control: token lengths below each limit share one.
LENGTHS = (24, 32, 40, 48, 64, 128)
# Evidence is kept in steps of a quarter of a decimal digit, up to STEPS of them.
STEPS = 160


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<s, e, v>>`` with code point offsets, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))
    walked = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")), start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["g"])).alias("s"),
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"),
                x["m"].alias("v")))).alias("out")))
    return walked["out"]


def _when_found(text: Column, pattern: str) -> Column:
    """Offsets are worked out only for texts in which the pattern occurs."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(text.rlike(pattern), matches(text, pattern)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Decimal digits of the upper tail probability of a normal value (0 for z below 0)."""
    return F.when(z <= 0, 0.0).otherwise(
        (z * z / 2 + F.log(z * 2.5066282746310002 + F.exp(-z / 2) * 2)) / 2.302585092994046)


def battery(token: Column) -> Column:
    """Test results of one token: ``struct<random, evidence, stratum>``.

    The encoding (hex, base32, base64) is inferred from the characters.
    ``random`` says that none of three tests rejects a uniform random string
    of that alphabet: the chi-squared statistic of its character counts, the
    number of runs of equal character class (Wald-Wolfowitz), and the lag-one
    serial correlation of character codes.  ``evidence`` is the p-value, in
    steps of a quarter digit, of the opposite hypothesis, ordinary written
    words: coincidences as frequent as in prose, and class changes as rare.
    """
    body = F.regexp_replace(token, "=+$", "")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    n = F.length(body).cast("double")
    is_hex = body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    is_32 = body.rlike("^[A-Z2-7]+$")
    size = F.when(is_hex, 16.0).when(is_32, 32.0).otherwise(64.0)
    # Probability that two neighbours of a random string differ in class (lower, upper, digit, other).
    change = F.when(is_hex, 2 * (10 / 16) * (6 / 16)).when(is_32, 2 * (26 / 32) * (6 / 32)).otherwise(
        1 - (26 * 26 * 2 + 10 * 10 + 2 * 2) / 64 ** 2)
    same = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(
        F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0)))
    classes = F.translate(
        body, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double")
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    lagged = F.aggregate(
        F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
                   lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, x: a + x) / n
    # Uniform random alphabet.
    chi = size * same / n - n
    z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1))
    z_runs = F.abs(runs - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    z_serial = F.abs(lagged / F.greatest(square, F.lit(1e-9))) * F.sqrt(n)
    random = (square > 0) & (z_chi < 4.0) & (z_runs < 3.5) & (z_serial < 3.5)
    # Ordinary words, also joined by capitals, signs or digits: a class change at one place in three at most,
    # coincidences of at least 0.05.
    pairs = n * (n - 1) / 2
    z_words = (runs - 1 - (n - 1) / 3) / F.sqrt((n - 1) * (2 / 9))
    z_coincide = (pairs * 0.05 - (same - n) / 2) / F.sqrt(pairs * 0.05 * 0.95)
    # Fisher's combination of the two p-values: of their product P it makes P * (1 - ln P).
    product = _normal_tail(z_words) + _normal_tail(z_coincide)
    digits = product - F.log10(1 + product * 2.302585092994046)
    stratum = F.lit(0)
    for limit in LENGTHS:
        stratum = stratum + (n >= limit).cast("int")
    return F.struct(
        F.coalesce(random, F.lit(False)).alias("random"),
        # A token that some test of randomness rejects is a test without evidence.
        F.when(random, F.least(F.floor(digits * 4), F.lit(STEPS))).otherwise(0).cast("int").alias("evidence"), stratum.alias("stratum"))


def discovery_limits(tested: DataFrame, rate: float) -> DataFrame:
    """Benjamini-Hochberg within each length stratum: the least evidence that counts.

    ``tested`` has one row per candidate, whatever its tests said.  The p-values are counted in steps
    (rounded up, so the control errs on the safe side); the table that is
    worked on has at most ``(STEPS + 1)`` rows per stratum.
    """
    counts = tested.groupBy("stratum", "evidence").agg(F.count("*").alias("n"))
    other = counts.select("stratum", F.col("evidence").alias("at"), F.col("n").alias("m"))
    return (
        counts.join(other, "stratum")
        .groupBy("stratum", "evidence").agg(
            F.sum(F.when(F.col("at") >= F.col("evidence"), F.col("m"))).alias("above"), F.sum("m").alias("all"))
        .filter(F.pow(F.lit(10.0), -F.col("evidence") / 4) * F.col("all") <= rate * F.col("above"))
        .groupBy("stratum").agg(F.min("evidence").alias("limit"))
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.001) -> DataFrame:
    """Secrets of every text: ``id_col``, ``base`` and ``random`` as ``array<struct<s, e, kind>>``.

    ``base`` holds the pattern hits by start and kind; ``random`` the tokens
    that no test of randomness rejects and that false-discovery control at
    ``rate`` keeps, unless a pattern hit covers part of them.  A null text
    counts as empty and has no hits; each row of a repeated text or identifier
    is scanned by itself; other columns are ignored.
    """
    kinds = list(LEAST)
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    raw = source.select(
        "_id", _when_found(F.col("_t"), ASSIGN).alias("assign"),
        _when_found(F.col("_t"), "AKIA[A-Z0-9]{16,}").alias("access"),
        _when_found(F.col("_t"), "[0-9a-f]{24,}").alias("hex"),
        _when_found(F.col("_t"), TOKEN).alias("token"))

    def of_kind(kind: str, rank: int) -> Column:
        head = "^" + ASSIGN_HEAD if kind == "assign" else "^"
        fits = F.filter(kind, lambda x: F.length(F.regexp_replace(x["v"], head, "")) >= LEAST[kind])
        return F.transform(fits, lambda x: F.struct(
            x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    spans = raw.select("_id", "token", F.array_sort(F.concat(
        *[of_kind(k, i) for i, k in enumerate(kinds)])).alias("base"))
    tested = cut(spans.select("_id", "base", F.transform(
        F.filter("token", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))),
        lambda t: F.struct(t["s"].alias("s"), F.lit(len(kinds)).alias("r"), t["e"].alias("e"),
                           battery(t["v"]).alias("test"))).alias("token")), "secrets")
    limits = discovery_limits(
        tested.select(F.explode("token.test").alias("t")).select("t.*"), rate).collect()
    least = [STEPS + 1] * (len(LENGTHS) + 1)
    for row in limits:
        least[row["stratum"]] = row["limit"]
    least_of = F.array(*[F.lit(x) for x in least])
    kept = F.filter("token", lambda t: t["test"]["random"] & (
        t["test"]["evidence"] >= F.element_at(least_of, t["test"]["stratum"] + 1)))
    return tested.select(
        F.col("_id").alias(id_col), "base", F.transform(kept, lambda t: F.struct(
            t["s"].alias("s"), t["r"].alias("r"), t["e"].alias("e"), F.lit("random").alias("kind"))).alias("random"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pattern hits and random tokens of all documents."""
    found = find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in LEAST], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "random"))).alias("spans"))
