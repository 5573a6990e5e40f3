"""Secret scan with DataFrame functions alone: base patterns plus character Markov models.

Two order-1 character models are counted in Spark from labelled samples: random strings and ordinary tokens. Their
log-likelihood ratio per character pair is one table of 128 x 128 numbers, a constant of the scan. Runs of candidate
characters are cut at base spans, and each piece is divided into ordinary and random stretches by the best path through
the two models, so that a name or a path beside a secret does not dilute it. Random stretches with enough evidence are
reported besides what the base patterns find. Places come from cutting a text at the matches: the lengths of the pieces
and of the matches give every start and end in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import smallest_hashes, text_of

# The base patterns. Only the keywords ignore case, of ASCII letters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Runs of this many characters or more are searched; shorter ones cannot hold enough evidence.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
LEAST = 12
#: A stretch is random from this mean log-likelihood ratio per character pair (natural log) and this total on.
RATIO = 0.7
EVIDENCE = 15.0
#: What a path pays for passing from one model to the other.
SWITCH = 7.0
#: Documents (those with the smallest hash of the id) whose tokens are ordinary, and random strings drawn: the bounds of the labelled sample.
SAMPLE_DOCS = 400
SAMPLE_RANDOM = 1500
#: Made ordinary tokens: names of NAME_WORDS, numbers and date stamps, and copies of each ruler.
SAMPLE_NAMES = 20_000
SAMPLE_NUMBERS = 1500
SAMPLE_RULERS = 60
CODES = 128
TOKEN = r"[A-Za-z0-9+/_=-]{2,}"
ALPHABET = [c for c in range(CODES) if chr(c).isalnum() or chr(c) in "+/_=-"]
#: Words that names of variables, keys and paths are made of; they join the words of the documents in the ordinary sample.
NAME_WORDS = """
account access action active address admin alpha amount api app archive array auth backup balance base batch beta bin
block body branch bucket buffer build button cache call card case cert chain change channel char check class client
cloud code col com command commit common component config connection connector const container content context control
cookie copy core count create credential cron current customer dashboard data database date day debug default delete
deploy dev device dir docs document domain download east edge email enable encoding endpoint engine env error event
example export factory failed feature field file filter final flag folder font format frame function gateway github
global google group handler hash header health history home host hour html http https id image import index info init
input install instance int item java job json key label lambda language last layer layout lib license limit line link
linux list load local log login main manager map master max message meta method metric min minute mobile mode model
module month name net network next node null number object online open option order org output owner package page
param parent partition password path payload payment permission phone plan platform plugin point policy pool port
prefix price primary private process prod product production profile project property proxy public python query queue
random rate read record redis region release remote report request reserved resource response rest result role root
route rule run sample schema script search secret section security select server service session set settings shared
shop signature site size socket source spec src stack staging standard start state static status step storage store
stream string stripe style suffix sum support switch system table tag target task team temp template tenant test text
theme thread time title token tool total track transaction transfer tree type update upload uri url user util util
valid value variable vault vendor version video view volume warehouse web webhook west window worker workspace write
www year zone
""".split()


def _styled(words: list[Column], n: Column) -> Column:
    """Three words as one of twelve kinds of name, path or assignment; n picks the kind and the numbers inside."""
    a, b, c = map(F.lower, words)
    number = F.pmod(F.xxhash64(n), F.lit(10_000)).cast("string")
    camel = F.concat(F.initcap(b), F.initcap(c))
    kinds = F.array(a, F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), F.concat(a, camel), F.upper(F.concat_ws("_", a, b, c)),
                    F.concat(F.initcap(a), camel), F.concat_ws("=", a, b), F.concat_ws("_", a, F.substring(number, 1, 2)), F.concat_ws("-", a, b, number),
                    F.concat(F.lit("/"), a, F.lit("/"), b, F.substring(number, 1, 1), F.lit("/"), c), F.concat_ws("-", F.upper(a), number))
    return F.get(kinds, F.pmod(n, F.lit(12)).cast("int"))


def _rulers() -> list[str]:
    """Lines, table borders, repeated characters and the alphabet itself."""
    marks = "=-_+/"
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ([m * 40 for m in marks] + [(a + b) * 10 for a in marks for b in marks if a != b] + ["+------------+---------+"]
            + [chr(c) * 12 for c in ALPHABET] + [letters, letters.upper(), letters.upper() + letters + "0123456789+/"])


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", n_docs: int = SAMPLE_DOCS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(sample, random): whole ordinary tokens over the candidate alphabet, and encodings of digests of numbers.

    Ordinary are the tokens of a bounded sample of documents after their base matches are blanked, names in snake, camel,
    kebab and upper case, paths and assignments of the documents' words and of NAME_WORDS, decimal numbers, date stamps and
    rulers. The random strings are hex in either case, base64 and base64 for URLs of SHA-512 digests, which are uniform by
    construction; padding is stripped.
    """
    spark = docs.sparkSession
    picked = smallest_hashes(docs.select(id_col, text_of().alias("text")), id_col, "markov", n_docs, ("text",)).select("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        picked = picked.withColumn("text", F.regexp_replace("text", pattern, " "))
    picked = picked.select("text", F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("words"))
    thirds = F.transform(F.sequence(F.lit(0), F.size("words") - 3, F.lit(3)), lambda i: _styled([F.get("words", i + j) for j in range(3)], (i / 3).cast("long")))
    names = F.when(F.size("words") >= 3, thirds).otherwise(F.array().cast("array<string>"))
    tokens = picked.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), names)).alias("sample"))
    known = F.split(F.lit(" ".join(NAME_WORDS)), " ")
    three = [F.get(known, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(NAME_WORDS))).cast("int")) for i in range(3)]
    made = spark.range(SAMPLE_NAMES).select(_styled(three, F.col("id")).alias("sample"))
    number = F.regexp_replace(F.sha2(F.concat(F.lit("number:"), F.col("id").cast("string")).cast("binary"), 256), "[a-f]", "")
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(15_000)).cast("int"))
    time = [F.substring(number, i, 2) for i in (1, 3, 5)]
    stamps = F.array(number, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.concat_ws("-", *time)), F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), *time))
    numbers = spark.range(SAMPLE_NUMBERS).select(F.explode(stamps).alias("sample"))
    rulers = spark.range(SAMPLE_RULERS).select(F.explode(F.split(F.lit(" ".join(_rulers())), " ")).alias("sample"))
    words = tokens.unionByName(made).unionByName(numbers).unionByName(rulers).withColumn("random", F.lit(False))
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")).cast("binary"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "[=\r\n]", "")
    kinds = F.array(digest, F.upper(digest), b64, F.translate(b64, "+/", "-_"), F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(b64, "[+/]", ""))))
    drawn = spark.range(n_random).select(F.explode(kinds).alias("sample")).withColumn("random", F.lit(True))
    return words.unionByName(drawn)


def _codes(value: Column) -> Column:
    """The code of every character of an ASCII text, in one pass over it."""
    return F.transform(F.split(value, ""), lambda c: F.ascii(c))


def ratio_table(samples: DataFrame) -> list[float]:
    """log P(b | a) under the random model minus under the ordinary model, at a * 128 + b for ASCII codes a and b.

    Both models are smoothed by adding a half to every pair of the candidate alphabet. At most 2 * 128 * 128 counts reach the driver.
    """
    codes, n = _codes(F.col("sample")), F.length("sample")
    at = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * CODES + b)
    pairs = samples.where(F.length("sample") > 1).select("random", F.explode(at).alias("pair")).where(F.col("pair") < CODES * CODES)
    counts: dict[bool, list[float]] = {True: [0.5] * CODES**2, False: [0.5] * CODES**2}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] += r["count"]
    out = [0.0] * CODES**2
    for a in ALPHABET:
        rows = {k: [v[a * CODES + b] for b in ALPHABET] for k, v in counts.items()}
        for b, p, q in zip(ALPHABET, rows[True], rows[False], strict=True):
            out[a * CODES + b] = round(math.log(p / sum(rows[True])) - math.log(q / sum(rows[False])), 4)
    return out


def _found(text: Column, pattern: str, kind: str, order: int, group: int = 0) -> Column:
    """Matches as structs (start, order, kind, end, value), leftmost and without overlap; value is the group."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value"))
    none = F.expr("cast(array() as array<struct<start: int, kind_no: int, kind: string, end: int, value: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        hit = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    start = F.struct(F.lit(0).alias("at"), none.alias("hits"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["hits"]).otherwise(none)


def _pieces(candidates: Column, base: Column) -> Column:
    """The parts of the candidates outside base spans, at least LEAST characters long, as structs (start, value)."""
    cut = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("order"), b["end"].alias("end"), F.lit("").alias("value"))),
                                F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("order"), c["end"].alias("end"), c["value"].alias("value")))))
    none = F.expr("cast(array() as array<struct<start: int, value: string>>)")

    def kept(acc: Column, end: Column) -> Column:
        """What is done, with the pending part up to ``end``."""
        part = F.struct(acc["start"].alias("start"), F.substring(acc["value"], acc["start"] - acc["first"] + 1, end - acc["start"]).alias("value"))
        return F.when(end - acc["start"] >= LEAST, F.concat(acc["done"], F.array(part))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        is_base = x["order"] == 0
        return F.struct(
            F.when(is_base, F.greatest(acc["covered"], x["end"])).otherwise(acc["covered"]).alias("covered"),
            F.when(is_base, acc["first"]).otherwise(x["start"]).alias("first"),
            F.when(is_base, F.greatest(acc["start"], x["end"])).otherwise(F.greatest(acc["covered"], x["start"])).alias("start"),
            F.when(is_base, acc["end"]).otherwise(x["end"]).alias("end"), F.when(is_base, acc["value"]).otherwise(x["value"]).alias("value"),
            kept(acc, F.when(is_base, F.least(acc["end"], x["start"])).otherwise(acc["end"])).alias("done"))

    start = F.struct(*[F.lit(0).alias(c) for c in ("covered", "first", "start", "end")], F.lit("").alias("value"), none.alias("done"))
    whole = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value")))
    return F.when(F.size(base) == 0, whole).otherwise(F.aggregate(cut, start, step, lambda acc: kept(acc, acc["end"])))


def _stretches(value: Column, llr: Column, ratio: float) -> Column:
    """Random stretches (first, end) of one piece on the best path through both models, in one pass over its characters.

    The path starts and ends in either model at no cost, so that a stretch reaches the border of the piece unless the
    characters before it are clearly ordinary.
    """
    none = F.expr("cast(array() as array<struct<first: int, end: int>>)")

    def closed(acc: Column, end: Column) -> Column:
        total = acc["random"] - acc["entry"]
        good = (total >= EVIDENCE) & (total >= ratio * (end - acc["first"] - 1))
        return F.when(good, F.concat(acc["hits"], F.array(F.struct(acc["first"].alias("first"), end.alias("end"))))).otherwise(acc["hits"])

    def step(acc: Column, code: Column) -> Column:
        enter = acc["plain"] - SWITCH > acc["random"]
        leave = acc["random"] - SWITCH > acc["plain"]
        enters = acc["plain"] - SWITCH
        return F.struct(
            (acc["at"] + 1).alias("at"), code.alias("last"),
            F.when(enter, enters).otherwise(acc["random"] + F.get(llr, acc["last"] * CODES + code)).alias("random"),
            F.when(enter, enters).otherwise(acc["entry"]).alias("entry"), F.when(enter, acc["at"]).otherwise(acc["first"]).alias("first"),
            F.when(enter, acc["plain_hits"]).otherwise(acc["hits"]).alias("hits"),
            F.when(leave, acc["random"] - SWITCH).otherwise(acc["plain"]).alias("plain"),
            F.when(leave, closed(acc, acc["at"])).otherwise(acc["plain_hits"]).alias("plain_hits"))

    # Code 127 stands before the first character; its row of the table is zero.
    start = F.struct(F.lit(0).alias("at"), F.lit(CODES - 1).alias("last"), F.lit(0.0).alias("random"), F.lit(0.0).alias("entry"), F.lit(0).alias("first"), none.alias("hits"),
                     F.lit(0.0).alias("plain"), none.alias("plain_hits"))
    return F.aggregate(_codes(value), start, step, lambda acc: F.when(acc["random"] >= acc["plain"], closed(acc, acc["at"])).otherwise(acc["plain_hits"]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", ratio: float = RATIO) -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex, base_sha256, spans and n_random.

    Base spans are leftmost and non-overlapping per kind. The models add spans of the kind ``random`` from the
    parts of candidates outside base spans. Places count code points, ends are exclusive. A null text is empty: no spans and the digest of the empty
    string. Only the id and the text are read; repeated rows answer alike; empty in, empty out.
    """
    llr = F.split(F.lit(",".join(f"{x:g}" for x in table)), ",").cast("array<double>")
    rows = docs.select(F.col(id_col), text_of().alias("_t"))
    rows = rows.select(
        id_col,
        F.filter(_found(F.col("_t"), ASSIGN, "assign", 0, 1), lambda x: F.length(x["value"]) >= ASSIGN_LEAST).alias("_assign"),
        _found(F.col("_t"), ACCESS, "access", 1).alias("_access"), _found(F.col("_t"), HEX, "hex", 2).alias("_hex"),
        _found(F.col("_t"), CANDIDATE, "random", 3).alias("_candidates"))
    rows = rows.withColumn("_base", F.concat("_assign", "_access", "_hex"))

    def random(piece: Column) -> Column:
        return F.transform(_stretches(piece["value"], llr, ratio), lambda x: F.struct(
            (piece["start"] + x["first"]).alias("start"), F.lit(3).alias("kind_no"), F.lit("random").alias("kind"), (piece["start"] + x["end"]).alias("end"), F.lit("").alias("value")))

    rows = rows.withColumn("_pieces", _pieces(F.col("_candidates"), F.col("_base")))
    rows = rows.withColumn("_random", F.flatten(F.transform("_pieces", random)))
    return rows.select(
        id_col, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("_base", "_random")).alias("spans"),
        F.size("_random").cast("long").alias("n_random"))
