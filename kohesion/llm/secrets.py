"""Secret scans: patterns, and a randomness test battery on the tokens that patterns don't name.

Every maximal run of 20 or more base64url/base64 characters that overlaps no
base span is a candidate.  Its encoding is inferred from its characters, and
three one-sided tests ask whether it is text written in that encoding:

* chi-squared alphabet uniformity: the chi-squared statistic against a uniform
  alphabet, as the repeat rate of symbols, compared with the repeat rate of text;
* runs: the number of runs of one character class (lower, upper, digit, other),
  compared with the rate at which text changes class;
* serial correlation: the lag-1 correlation of vowels, which text strews evenly
  (it is negative there) and random symbols don't; a sequence, over half of whose
  neighbours are equal or next to each other in the alphabet, is as regular as can be.

The null model of each test is text (identifiers, paths, long words), so a small
p-value speaks for a random token.  Text passes or fails the three nearly
independently, so their scores are added (Stouffer's method); one-case letters
have no runs, so their two other scores are.  A token is reported if it passes a
Benjamini-Hochberg step-up over all candidates of its length class, so the
share of false reports is controlled separately for short tokens, which carry
little evidence, and long ones.  The step-up runs over counts in bins of
log10 p and rounds p up to its bin's edge.

All of it is DataFrame functions.  Texts are read once; a text's matches become
rows of a few numbers, and places are running sums over them, so the work grows
with the number of matches and not with its square, however many one text has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohesion.llm._store import save

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"((?<![0-9a-f])[0-9a-f]{32,})"
#: Kind, pattern, the group whose length counts, the least length.
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 1, 16), ("hex", HEX, 1, 32))
TOKEN = r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2})"
#: What every match of the above starts with; texts without it are looked at once.
ANY = r"(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)[\"'\x20:=]|AKIA|[A-Za-z0-9+/_-]{20}"
METHOD_KIND = "random"
#: Places of the kinds above and of tokens.
KINDS = (*BASE, (METHOD_KIND, TOKEN, 1, 20))
_TOKENS = len(BASE)

# The null model, text written in each encoding (long identifiers, paths and words of source code).
#: Encoding: characters, alphabet size, repeat rate of text, rate at which text changes character class (None: it can't).
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12, 0.12),
    "letters": ("^(?:[a-z]+|[A-Z]+)$", 26, 0.066, None),
    "base32": ("^[A-Z2-7]+$", 32, 0.075, 0.12),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", 36, 0.07, 0.15),
    "base64": ("", 64, 0.055, 0.30),
}
#: The lag-1 correlation of vowels in text.
SERIAL = -0.33
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 96)
BINS_PER_DECADE = 100
LAST_BIN = 30_000


def _matches(text: Column, rank: int) -> Column:
    """The matches of one kind as (rank, place, gap before, size, size of the group that counts, token), in order."""
    _, pattern, group, _ = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())
    made = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"),
            i.alias("place"),
            x["gap"].alias("gap"),
            F.length(x["whole"]).alias("size"),
            F.length(x["value"]).alias("value"),
            (x["whole"] if rank == _TOKENS else F.lit(None).cast("string")).alias("token"),
        ),
    )
    return F.when(F.col("hit") & text.rlike(pattern), made).otherwise(F.array().cast("array<struct<rank:int,place:int,gap:int,size:int,value:int,token:string>>"))


def normal_tail(z: Column) -> Column:
    """P(N(0,1) > z) by the Abramowitz-Stegun 7.1.26 polynomial; never below 1e-300."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    # The coefficients of formula 7.1.26.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, half).otherwise(1.0 - half), F.lit(1e-300))


def infer_encoding(body: Column) -> Column:
    """The smallest alphabet that holds the token (without padding)."""
    (first, (pattern, *_)), *rest = list(ENCODINGS.items())[:-1]
    return reduce(lambda c, kv: c.when(body.rlike(kv[1][0]), F.lit(kv[0])), rest, F.when(body.rlike(pattern), F.lit(first))).otherwise(F.lit(list(ENCODINGS)[-1]))


def _by_encoding(place: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in ENCODINGS.items() for x in (k, None if v[place] is None else float(v[place]))])[F.col("encoding")]


def randomness(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with ``z_uniform``, ``z_runs`` (null where there are none), ``z_serial``, and ``p`` of the three together."""
    vowels = "aeiouAEIOU"
    codes = F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.ascii(c))
    own = tokens.withColumn("body", F.rtrim(F.col(token), F.lit("="))).withColumn("n", F.length("body").cast("double")).withColumn("encoding", infer_encoding(F.col("body")))
    count = lambda c: F.col("n") - F.length(F.replace(F.col("body"), c, F.lit("")))
    own = own.select(
        "*",
        codes.alias("codes"),
        _by_encoding(1).alias("alphabet"),
        _by_encoding(2).alias("rate"),
        _by_encoding(3).alias("change"),
        F.aggregate(F.array_distinct(F.split("body", "")), F.lit(0.0), lambda s, c: s + F.when(c == "", F.lit(0.0)).otherwise(F.pow(count(c), F.lit(2.0)))).alias("squares"),
        (F.regexp_count("body", F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/_-]+")) - 1).cast("double").alias("changes"),
        F.regexp_count("body", F.lit(f"[{vowels}]")).cast("double").alias("v"),
        F.regexp_count("body", F.lit(f"[{vowels}]+")).cast("double").alias("v_runs"),
        (F.col("body").rlike(f"^[{vowels}]").cast("double") + F.col("body").rlike(f"[{vowels}]$").cast("double")).alias("v_ends"),
    )
    n, share = F.col("n"), F.col("v") / F.col("n")
    # chi-squared = alphabet / n * squares - n, told as the chance that two symbols are equal.
    own = own.withColumn("chi2", F.col("alphabet") / n * F.col("squares") - n).withColumn("repeat", ((F.col("chi2") + n) * n / F.col("alphabet") - n) / (n * (n - 1)))
    # Products of neighbours about the mean, from the number of vowels, of their pairs and at the ends.
    lagged = (F.col("v") - F.col("v_runs")) - share * (2 * F.col("v") - F.col("v_ends")) + (n - 1) * share * share
    power = F.col("v") * (1 - share)
    near = F.aggregate(F.zip_with("codes", F.slice("codes", 2, F.size("codes")), lambda a, b: F.when(F.abs(a - b) <= 1, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    own = own.select(
        "*",
        ((F.col("rate") - F.col("repeat")) / F.sqrt(2 * F.col("rate") * (1 - F.col("rate")) / (n * (n - 1)))).alias("z_uniform"),
        ((F.col("changes") - (n - 1) * F.col("change")) / F.sqrt((n - 1) * F.col("change") * (1 - F.col("change")))).alias("z_runs"),
        # Without vowels, or with nothing else, it tells nothing.
        F.when(2 * near > n - 1, -F.sqrt(n)).when(power > 0, (lagged / power - SERIAL) * F.sqrt(n)).otherwise(F.lit(0.0)).alias("z_serial"),
    )
    both = F.col("z_uniform") + F.col("z_serial")
    z = F.when(F.col("z_runs").isNull(), both / F.sqrt(F.lit(2.0))).otherwise((both + F.col("z_runs")) / F.sqrt(F.lit(3.0)))
    return own.select(*[F.col(f"`{c}`") for c in tokens.columns], "z_uniform", "z_runs", "z_serial", normal_tail(z).alias("p"))


def _length_class(size: Column) -> Column:
    return F.lit(0) + sum((size >= n).cast("int") for n in LENGTHS[1:])


def _p_bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row; a span is (start, rank, end, class, bin), base ones without class and bin, others tested tokens that overlap no base span."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("id", "text", F.col("text").rlike(ANY).alias("hit"))
    # The key is written with the matches, so it is the same wherever it is read.
    rows = save(own.select(F.monotonically_increasing_id().alias("key"), "id", F.concat(*[_matches(F.col("text"), i) for i in range(len(KINDS))]).alias("matches")), "secret-matches")
    plain = rows.filter(F.size("matches") == 0)
    some = rows.filter(F.size("matches") > 0)
    # From here on a text is a few numbers for each match.
    match = some.select("key", "id", F.explode("matches").alias("m")).select("key", "id", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("rank") + 1)
    span = match.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int")).filter(F.col("value") >= least)
    is_base = F.col("rank") < _TOKENS
    up = Window.partitionBy("key").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    near = span.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(down))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    kept = near.filter(is_base | free).select("key", "id", "start", "rank", "end", "token")
    tested = randomness(kept)
    placed = tested.select(
        "key",
        "id",
        F.struct(
            "start",
            "rank",
            "end",
            F.when(~is_base, _length_class(F.col("end") - F.col("start"))).alias("class"),
            F.when(~is_base, _p_bin(F.col("p"))).alias("bin"),
        ).alias("span"),
    )
    grouped = placed.groupBy("key").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("span")).alias("spans"))
    # A text whose matches all fail has no span left.
    none = F.array().cast("array<struct<start:int,rank:int,end:int,class:int,bin:int>>").alias("spans")
    failed = some.join(grouped.select("key"), "key", "left_anti").select("id", none)
    return plain.select("id", none).union(failed).union(grouped.select("id", "spans"))


def step_up(scanned: DataFrame, q: float) -> DataFrame:
    """(class, least): per length class the lowest bin that the Benjamini-Hochberg step-up at ``q`` accepts."""
    counts = scanned.select(F.explode("spans").alias("c")).filter("c.bin is not null").groupBy(F.col("c.class").alias("class"), F.col("c.bin").alias("bin")).agg(F.count("*").alias("n"))
    # At most LAST_BIN + 1 rows for each of the length classes.
    own = Window.partitionBy("class")
    ranked = counts.withColumn("above", F.sum("n").over(own.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(own))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= F.lit(q) * F.col("above") / F.col("all"))
    return passed.groupBy("class").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, found) per row of ``docs``.

    ``base`` and ``found`` are arrays of (start, rank, end, kind) by start and
    rank; ``found`` adds the tokens that the battery reports at false-discovery
    rate ``q``.  Null and empty texts have no spans; very long texts are scanned
    whole, and their work grows with length and matches; a null id stays null;
    repeated rows are scanned each; an empty table gives an empty result.
    """
    scanned = save(scan(docs, id_col, text_col), "secrets")
    # One row of at most len(LENGTHS) entries.
    least = step_up(scanned, q).agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("least"))
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    named = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.element_at(kinds, s["rank"] + 1).alias("kind")))
    found = scanned.crossJoin(F.broadcast(least)).select(
        "id",
        named(F.filter("spans", lambda s: s["rank"] < _TOKENS)).alias("base"),
        named(F.filter("spans", lambda s: (s["rank"] < _TOKENS) | (s["bin"] >= F.col("least")[s["class"]]))).alias("found"),
    )
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return found.select("id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], "base", "found")


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
