"""Secret scan: key patterns, and a battery of randomness tests with length-aware control of false discoveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Tokens that the battery judges, and the alphabets it infers, narrowest first.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "lower": ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "BASE36": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base64url": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    "base64": ("^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TINY = 1e-15
#: Matches of a text that are walked through at once; see `blocks`.
BLOCK = 64


def blocks(items: Column) -> Column:
    """items in slices of BLOCK, the last one shorter; none of an empty array.

    What is carried from item to item is carried within and then between blocks, as an array or text that grows item by item
    is copied each time, which would be quadratic in the matches of a text.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK))))


def running(sizes: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For an array of integers the array of what `join` makes of all before each, from 0 on."""
    step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost matches that do not overlap, in code points, exclusive end.

    The texts between matches and the matches themselves, laid end to end, give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    plus = lambda at, size: at + size

    def place(parts: Column) -> Column:
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + x["gap"] + x["size"]))
        return F.flatten(F.zip_with(parts, running(lengths, plus), within))

    def within(part: Column, at: Column) -> Column:
        before = running(F.transform(part, lambda x: x["gap"] + x["size"]), plus)
        start = lambda x, b: at + b + x["gap"]
        return F.zip_with(part, before, lambda x, b: F.struct(start(x, b).alias("start"), (start(x, b) + x["size"]).alias("end"), x["hit"].alias("hit")))

    def sized(found: Column) -> Column:
        pairs = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(found["hits"])), found["hits"], lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
        return let(pairs, lambda items: F.coalesce(let(blocks(items), place), none))

    return F.when(text.rlike(pattern), let(F.struct(gaps.alias("gaps"), hits.alias("hits")), sized)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the base kinds, by start and then in the order assign, access, hex."""
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], "^" + ASSIGN, 2)) >= 6)
    access = F.filter(located(text, ACCESS), lambda x: F.length(x["hit"]) >= 20)
    # a run is matched whole, so the runs of 24 or more are the same matches as those of any length, less the short ones
    hexes = located(text, HEX[:-1] + "{24,}")
    kinds = [(0, "assign", assign), (1, "access", access), (2, "hex", hexes)]

    def named(order: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    all_ = F.concat(*[F.transform(spans, named(order, kind)) for order, kind, spans in kinds])
    return F.transform(F.array_sort(all_), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; absolute error under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tests(token: Column) -> Column:
    """struct<encoding, n, matches, p_uniform, p_runs, p_serial, p_random>: the battery's tests of a token (without
    padding) against uniform randomness in its inferred encoding.

    matches: pairs of equal symbols. p_uniform: chi-squared, upper tail, by the cube-root normal approximation. p_runs:
    runs above and below the middle of the alphabet, two-sided. p_serial: lag-1 correlation of codes, two-sided.
    p_random: the least of the three times three.
    """

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    alphabet = lambda e: F.coalesce(*[F.when(e == name, letters) for name, (_, letters) in ENCODINGS.items()])

    def coded(a: Column) -> Column:
        codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(a["letters"], c).cast("double"))
        return F.struct(a["encoding"].alias("encoding"), F.length(a["letters"]).cast("double").alias("k"), codes.alias("codes"))

    def summed(x: Column) -> Column:
        codes, k = x["codes"], x["k"]
        n = F.size(codes).cast("double")
        pairs = lambda f: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), f)
        equal = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.size(F.array_remove(codes, c)), F.lit(2.0)))
        ends = F.element_at(codes, 1) + F.element_at(codes, -1)
        return F.struct(
            x["encoding"].alias("encoding"), k.alias("k"), n.alias("n"), equal.alias("equal"), total(F.transform(codes, lambda c: (c > k / 2).cast("double"))).alias("up"),
            total(pairs(lambda a, b: ((a > k / 2) != (b > k / 2)).cast("double"))).alias("turns"), total(codes).alias("sum"), total(F.transform(codes, lambda c: c * c)).alias("squares"),
            total(pairs(lambda a, b: a * b)).alias("lagged"), ends.alias("ends"),
        )

    def scored(x: Column) -> Column:
        n, up, df, mean = x["n"], x["up"], x["k"] - 1, x["sum"] / x["n"]
        z_uniform = (F.pow(F.greatest(x["k"] * x["equal"] / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        expected = 2 * up * (n - up) / n  # runs, less one
        spread = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(TINY)))
        z_runs = F.when((up > 0) & (up < n), F.abs(x["turns"] - expected) / spread).otherwise(F.sqrt(n))
        power, lag = x["squares"] - n * mean * mean, x["lagged"] - mean * (2 * x["sum"] - x["ends"]) + (n - 1) * mean * mean
        z_serial = F.when(power > TINY, F.abs(lag / power + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        kept = [x["encoding"].alias("encoding"), n.cast("int").alias("n"), ((x["equal"] - n) / 2).alias("matches")]
        return F.struct(*kept, z_uniform.alias("uniform"), z_runs.alias("runs"), z_serial.alias("serial"))

    def judged(x: Column) -> Column:
        kept = [x[c].alias(c) for c in ("encoding", "n", "matches")]
        return F.struct(*kept, (1 - normal_cdf(x["uniform"])).alias("p_uniform"), (2 * (1 - normal_cdf(x["runs"]))).alias("p_runs"), (2 * (1 - normal_cdf(x["serial"]))).alias("p_serial"))

    def joint(x: Column) -> Column:
        kept = [x[c].alias(c) for c in ("encoding", "n", "matches", "p_uniform", "p_runs", "p_serial")]
        return F.struct(*kept, F.least(F.lit(1.0), 3 * F.least(x["p_uniform"], x["p_runs"], x["p_serial"])).alias("p_random"))

    start = F.transform(F.array(inferred(token)), lambda e: F.struct(e.alias("encoding"), alphabet(e).alias("letters")))
    for step in (coded, summed, scored, judged, joint):
        start = F.transform(start, step)
    return F.element_at(start, 1)


def inferred(token: Column) -> Column:
    """The narrowest encoding whose alphabet holds the whole token."""
    return F.coalesce(*[F.when(token.rlike(rx), name) for name, (rx, _) in ENCODINGS.items()], F.lit("base64"))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds the fields of tests() for the column `token`."""
    return tokens.withColumn("_tests", tests(F.col("token"))).select("*", "_tests.*").drop("_tests")


class Discovery:
    """Which tokens are found random, as thresholds fitted on all distinct tokens of a corpus.

    Two null hypotheses are ranked by the Benjamini-Hochberg rule, each at level `fdr` within classes of encoding and
    length (powers of two), as longer tokens tell random keys and text better apart.
    Ordinary text: how often two letters of text are equal is counted over all candidates that consist of letters; from
    that follow mean and variance of the number of equal pairs (on which chi-squared rests) in n letters, and p_text, the
    chance of so few. Randomness: p_random of the battery. A discovery is a token for which text is rejected and
    randomness is not. The ranks go over histograms of p-values by hundredths of a decade, so what the driver sees is one
    threshold a class and hypothesis, however large the corpus; each document then judges its own tokens.
    """

    def __init__(self, tested: DataFrame, fdr: float = 0.01):
        letters = tested.where("encoding not in ('decimal', 'hex', 'HEX') and token rlike '^[A-Za-z]+$'").select(F.lower("token").alias("t"))
        totals = letters.agg(*[F.sum(F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).alias(c) for c in LETTERS]).first()
        counts = [float(totals[c] or 0) + 1.0 for c in LETTERS]
        q = [c / sum(counts) for c in counts]
        self.s2, self.s3 = sum(x * x for x in q), sum(x**3 for x in q)
        ranked = tested.select("encoding", self.size_class(F.col("n")).alias("class"), self.bin(self.p_text(F.col("token"), F.col("n"), F.col("matches"))).alias("text"), self.bin(F.col("p_random")).alias("random"))
        each = ranked.select("encoding", "class", F.explode(F.create_map(F.lit("text"), "text", F.lit("random"), "random")).alias("null", "bin"))
        cell = each.groupBy("encoding", "class", "null", "bin").agg(F.count("*").alias("n"))
        by = Window.partitionBy("encoding", "class", "null")
        up_to = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        passed = F.pow(F.lit(10.0), F.col("bin") / 100) <= fdr * up_to / F.sum("n").over(by)
        self.cuts = cell.withColumn("passed", passed).where("passed").groupBy("encoding", "class", "null").agg(F.max("bin").alias("bin")).collect()

    def p_text(self, token: Column, size: Column, matches: Column) -> Column:
        n = size.cast("double")
        pairs = n * (n - 1) / 2
        spread = F.sqrt(F.greatest(pairs * (self.s2 + 2 * (n - 2) * self.s3 - (2 * n - 3) * self.s2 * self.s2), F.lit(TINY)))
        # digits among letters: text has them at its ends, if at all; each change between the two is as unlikely as 1 in 8
        changes = F.size(F.split(token, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1
        cases = F.size(F.split(token, "(?<=[a-z])(?=[A-Z])")) - 1
        return let((matches - pairs * self.s2) / spread, normal_cdf) * F.pow(F.lit(0.125), F.greatest(changes - 1, F.lit(0))) * F.pow(F.lit(0.25), cases)

    @staticmethod
    def size_class(n: Column) -> Column:
        return F.floor(F.log2(n.cast("double"))).cast("int")

    @staticmethod
    def bin(p: Column) -> Column:
        return F.ceil(100 * F.log10(F.greatest(p, F.lit(TINY)))).cast("int")

    def judge(self, token: Column) -> Column:
        """Whether a token is a discovery; the battery runs only for classes that have any."""
        cut = {null: F.create_map(*[x for r in self.cuts if r["null"] == null for x in (F.lit(f"{r['encoding']} {r['class']}"), F.lit(r["bin"]))]) for null in ("text", "random")}
        if not any(r["null"] == "text" for r in self.cuts):
            return F.lit(False)
        rejects = any(r["null"] == "random" for r in self.cuts)
        key = F.concat_ws(" ", inferred(token), self.size_class(F.length(token)).cast("string"))

        def decide(found: Column, name: Column) -> Column:
            text = self.bin(self.p_text(token, found["n"], found["matches"])) <= F.try_element_at(cut["text"], name)
            return text & (self.bin(found["p_random"]) > F.coalesce(F.try_element_at(cut["random"], name), F.lit(-(10**6)))) if rejects else text

        return let(key, lambda name: F.when(F.try_element_at(cut["text"], name).isNotNull(), let(tests(token), lambda found: decide(found, name))).otherwise(False))


def discoveries(tested: DataFrame, fdr: float = 0.01) -> DataFrame:
    """The rows of tested tokens that are found random; see Discovery."""
    return tested.where(Discovery(tested, fdr).judge(F.col("token")))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, fdr: float = 0.01) -> DataFrame:
    """Adds `spans` to the columns `keep` of docs: array<struct<kind, start, end>> by start and kind, in code points.

    Kinds assign, access and hex are matches of fixed patterns in whole texts; kind random is added by the battery
    for tokens that do not overlap those. A first pass writes the distinct tokens of all documents and fits the
    thresholds on them; a second one scans each document where it is read, so that no text is shuffled or written.
    A null text is empty; a text of any length is scanned whole; an empty table gives no rows; repeated rows are scanned each.
    Any columns may be kept but `spans` itself, which is replaced; others are ignored.
    """
    names = [c for c in keep or docs.columns if c != "spans"]
    rows = docs.select(F.struct(*names).alias("_in"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    tokens = rows.where(F.col("_text").rlike(CANDIDATE)).select(F.explode(F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).alias("hit"))
    tokens = tokens.select(F.rtrim(F.col("hit"), F.lit("=")).alias("token")).distinct()
    found = Discovery(materialize(battery(tokens), "tokens"), fdr)
    random = F.filter(located(F.col("_text"), CANDIDATE), lambda c: found.judge(F.rtrim(c["hit"], F.lit("="))))
    if not any(r["null"] == "text" for r in found.cuts):  # no token of the corpus is a discovery
        random = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    marked = rows.select("_in", base_spans(F.col("_text")).alias("_base"), random.alias("_random"))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    # each block of base spans, which lie in order of start, is passed over whole unless its own extent meets the token
    extent = lambda part: F.struct(F.element_at(part, 1)["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part"))
    held = F.coalesce(F.transform(blocks(F.col("_base")), extent), F.array().cast("array<struct<start:int,end:int,part:array<struct<kind:string,start:int,end:int>>>>"))
    free = let(held, lambda parts: F.filter("_random", lambda r: ~F.exists(parts, lambda block: meet(block, r) & F.exists(block["part"], lambda b: meet(b, r)))))
    order = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    both = F.concat("_base", F.transform(free, lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["end"].alias("end"))))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), order(s).alias("o"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return marked.select("_in.*", spans.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by a mark; spans, which lie in order of start, are replaced as one where they overlap.

    The text is cut once for each block of spans, and each block's part is then marked span by span.
    """

    def marked(at: Column, part: Column) -> Column:
        """The text from `at` to the last end of a block's spans."""
        last = F.greatest(at, F.array_max(F.transform(part, lambda s: s["end"])))

        def walk(own: Column) -> Column:
            step = lambda acc, s: F.struct(
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(own, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
                F.greatest(acc["at"], s["end"]).alias("at"),
            )
            return F.aggregate(part, F.struct(F.lit("").alias("out"), at.alias("at")), step, lambda acc: acc["out"])

        return let(F.substring(text, at + 1, last - at), walk)

    def whole(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.array_max(F.transform(part, lambda s: s["end"])))
        pieces = F.zip_with(running(ends, lambda a, b: F.greatest(a, b)), parts, marked)
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(blocks(spans), whole)).otherwise(text)
