"""Secret scan in DataFrame expressions alone: candidates by pattern, false positives removed by a random forest.

Candidates are long mixed strings, private-key headers, and whatever of six
characters or more is assigned to a name that speaks of a secret. What the forest
looks at (length, character transitions, dictionary coverage, path and
neighbouring words) are column expressions; it is Spark's own random forest,
fitted on a table of labelled findings. The dictionary is that of the corpus: its
most frequent words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Runs of 16 and more characters of keys, paths and base64, or a key block's header.
RUN = r"[A-Za-z0-9+/_.-]{16,}+={0,2}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: A run is a candidate if, without trailing stops and joints, it still has 16 characters and both letters and digits, or is such a header.
TAIL, LEAST = r"(?<![+/_.-])[+/_.-]+$", 16
#: A name that speaks of a secret and what assigns to it; the value behind is a candidate too if it has SHORT characters, whatever they are.
ASSIGN = r"(?=[acpstACPST])(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)[\"'`]?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"'`]?"
VALUE, SHORT = r"[^\s\"'`,;<>]", 6
#: Where the value begins with a run of 16, that run is what counts.
PATTERN = RUN + "|" + ASSIGN + "(?![A-Za-z0-9+/_.-]{16})" + VALUE + "{6,}+"
HEADER = "-----BEGIN "
BEFORE, AFTER = 40, 20
TREES, DEPTH, FINDINGS = 30, 8, 6000
#: The dictionary holds at most so many words, the most frequent ones of three letters and more.
WORDS = 5000
#: Runs whose places are summed together.
SUMS = 256

# Words that speak for a secret, words that speak for another kind of string, common words, and known beginnings of keys.
FOR = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private"
AGAINST = "commit|revision|sha1|sha-?256|sha-?512|md5|checksum|digest|uuid|guid|etag|integrity|hash|version|image|file|path|page|order|build|example"
COMMON = (
    "about|after|and|app|are|build|client|code|com|config|data|date|default|document|en|example|file|for|from|get|has|have|home|html|http|image|index|info|ing|ion|item|key|"
    "lib|list|local|mail|main|model|module|name|net|new|not|object|of|order|org|page|path|png|post|query|record|report|request|response|result|sample|server|service|set|source|"
    "string|system|table|test|text|that|the|this|time|token|type|update|url|user|usr|value|version|view|was|web|with|word|www|your"
)
BEGINNINGS = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|eyJ|-----BEGIN)"

# Shapes of the labelled findings. A word in braces stands for random text of that kind.
SECRETS = (
    'token = "{hex40}"', 'TOKEN = "{HEX40}"', "token: {hex40}", "{word} {word} token = '{hex32}' {word}", "api_key: {mix32}", 'apikey="{mix24}"', "secret={hex32}", "client_secret: '{mix40}'",
    'password = "{mix16}"', "Authorization: Bearer {mix40}", "auth {word} {mix32}", "AWS_ACCESS_KEY_ID=AKIA{UP16}", "aws_secret_access_key = {mix40}", "{word} ghp_{mix36} {word}", "xoxb-{num12}-{mix24}",
    "{word} sk-{mix48}", 'password = "{pass10}"', "PASSWORD={pass10}", "{word} pwd: {pass8} {word}", "db_password: '{let18}'", "secret => \"{pass12}\"", "token: {let24}", 'passphrase="{let18}"', "login {word} passwd={pass8}", "private key -----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "access-key {hex64}", "credential: {mix20}", 'token = "{hex40}"{mark} {word}', "passwd:{mix18} {word}",
)
OTHERS = (
    "commit {hex40}", "{word} revision {hex40} {word}", "sha256:{hex64}", "md5 checksum {hex32}", "uuid {uuid}", "id={uuid} {word}", "https://www.example.com/{word}-{word}-{num4}/{word}", "/usr/lib/{word}{num2}/{word}.so.1",
    "{word}-{word}-{word}-{num2}", "version-1.{num2}.0-{word}", "{word}.{num2}@mail{num2}.example.com", "integrity sha384-{mix64}", "{word}{word}{word}{num2} {word}", "token = \"your-token-here-{num4}\"", "example_key_{num8}_{word}",
    "image/{hex32}.png", "etag: \"{hex32}\"", "order {num8}-{num8}-A{num2}", "page {word}_{word}_{num4}.html", "{word} {word}{word}{num8} {word}", "build-{num8}-{hex8}-{word}", "file {word}/{word}/{hex40}/{word}", "hash {hex40}",
    "password for {word}_{word}_{num4}", "password: {word}", "password = {word}_{word}", "token: $({word}_token)", "secret=<{word}-{word}>", "passwd = {word}.{word}()", "password: ********", "token = next({word})", "{word} secret: {word}{word} {word}",
    "api_key = os.environ[{word}]", "password=%({word})s", "pwd: /home/{word}/{word}", "token: {word}-{word}-{word}", "{word} 2024-01-{num2}T{num2} {word}_{num8}_{word}", "the key of {word}-{word}{num2}-{word}",
)


def synthetic_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings ``(text, label, shape)`` by rule: the shapes above in turn (``shape`` is a shape's number), filled from digests of the row's number."""
    shapes = [(s, 1) for s in SECRETS] + [(s, 0) for s in OTHERS]
    table = F.array(*[F.struct(F.lit(s).alias("form"), F.lit(y).alias("label"), F.lit(k).alias("shape")) for k, (s, y) in enumerate(shapes)])
    letters = lambda salt: F.translate(hexes(salt), "0123456789", "kqwzrtvgju")
    marked = lambda salt: F.concat(mixed(salt).substr(1, 3), F.element_at(F.array(*map(F.lit, "!@#$%&*?")), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(8)) + 1).cast("int")), mixed(salt).substr(4, 20))
    hexes = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), "id").cast("binary"), 512)
    mixed = lambda salt: F.translate(F.base64(F.unhex(hexes(salt))), "+/=\n", "aZ7")
    digits = lambda salt: F.translate(hexes(salt), "abcdef", "135790")
    common = F.split(F.lit(COMMON), r"\|")
    word = lambda salt: F.concat(*[F.element_at(common, (F.pmod(F.xxhash64(F.lit(f"{salt}{k}"), "id"), F.size(common)) + 1).cast("int")) for k in (0, 1)])
    text = F.col("form")
    for name, size, make in (
        ("hex8", 8, hexes), ("hex32", 32, hexes), ("hex40", 40, hexes), ("hex64", 64, hexes), ("HEX40", 40, lambda s: F.upper(hexes(s))), ("mix16", 16, mixed), ("mix18", 18, mixed), ("mix20", 20, mixed),
        ("mix24", 24, mixed), ("mix32", 32, mixed), ("mix36", 36, mixed), ("mix40", 40, mixed), ("mix48", 48, mixed), ("mix64", 64, mixed), ("UP16", 16, lambda s: F.upper(mixed(s))),
        ("pass8", 8, marked), ("pass10", 10, marked), ("pass12", 12, marked), ("let18", 18, letters), ("let24", 24, letters), ("num2", 2, digits), ("num4", 4, digits), ("num8", 8, digits), ("num12", 12, digits),
    ):
        text = F.replace(text, F.lit("{" + name + "}"), F.substring(make(name), 1, size))
    h = hexes("uuid")
    text = F.replace(text, F.lit("{uuid}"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)))
    text = F.replace(text, F.lit("{mark}"), F.element_at(F.array(*map(F.lit, ("###", "***", "!!", ","))), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")))
    for k in range(4):  # a different word for each place
        text = F.regexp_replace(text, r"^(.*?)\{word\}", F.concat(F.lit("$1"), word(f"w{k}")))
    text = F.replace(text, F.lit("{word}"), word("last"))
    picked = spark.range(0, n, 1, 4).withColumn("pick", F.element_at(table, (F.col("id") % len(shapes) + 1).cast("int")))
    return picked.select("id", "pick.*").select(text.alias("text"), "label", "shape")


def dictionary_of(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> list[str]:
    """The most frequent words of three letters and more in all texts, in lower case: all words from the lowest frequency on that leaves ``most`` of them or fewer.

    Frequencies are told apart in steps of an eighth of a doubling, so that the
    driver sees a few hundred counts, and then only the words that it takes.
    """
    word = F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("word")
    counts = docs.select(word).where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    stepped = cut(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("step")))
    taken, least = 0, None
    for row in sorted(stepped.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        taken += row.n
        if taken > most:
            break
        least = row.step
    return [] if least is None else sorted(r.word for r in stepped.where(F.col("step") >= least).select("word").collect())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(sizes: Column) -> Column:
    """Where each run begins, from an array of (gap before it, its length).

    Running sums are taken within blocks and over the blocks' totals, so a text
    with very many runs does not copy one growing array for each of them.
    """
    block = lambda z, b: F.slice(z, b * SUMS + 1, F.lit(SUMS))
    blocks = lambda z: F.sequence(F.lit(0), F.floor((F.size(z) - 1) / SUMS).cast("int"))
    empty = F.array().cast("array<int>")

    def run(part: Column, begin: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"))
        return F.aggregate(part, F.struct(begin.alias("at"), empty.alias("starts")), step, lambda acc: acc["starts"])

    totals = lambda z: F.transform(blocks(z), lambda b: F.struct(F.lit(0).alias("gap"), F.aggregate(block(z, b), F.lit(0), lambda s, x: s + x["gap"] + x["own"]).alias("own")))
    return F.when(F.size(sizes) > 0, _let(sizes, lambda z: _let(run(totals(z), F.lit(0)), lambda base: F.flatten(F.transform(blocks(z), lambda b: run(block(z, b), F.get(base, b))))))).otherwise(empty)


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """A row per candidate: the columns in ``keep``, ``start`` (in characters, from 0), ``candidate``, ``before``, ``after``.

    A text is cut once into runs and the gaps between them; places and
    neighbouring words come from those pieces, in time that grows with the text.
    """
    text = F.col(text_col)
    found = docs.where(text.rlike(PATTERN)).select(*keep, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("__found"), F.split(text, PATTERN, -1).alias("__gaps"))
    run, gap = (lambda i: F.get("__found", i)), (lambda i: F.get("__gaps", i))
    sizes = F.transform("__found", lambda r, i: F.struct(F.length(gap(i)).alias("gap"), F.length(r).alias("own")))
    last, head = (lambda x, n: F.right(x, F.lit(n))), (lambda x, n: F.left(x, F.lit(n)))
    # Runs have ten characters or more, so four of them and the gaps between hold all that BEFORE needs, and two what AFTER needs.
    before = lambda i, head: last(F.concat_ws("", *[piece for k in (3, 2, 1, 0) for piece in (last(run(i - k - 1), BEFORE), last(gap(i - k), BEFORE))], head), BEFORE)
    after = lambda i, tail: head(F.concat_ws("", tail, *[piece for k in (1, 2) for piece in (head(gap(i + k), AFTER), head(run(i + k), AFTER))]), AFTER)
    bare = lambda r: F.when(r.startswith(HEADER), r).otherwise(F.regexp_replace(r, TAIL, ""))
    name = lambda r: F.regexp_extract(r, "^" + ASSIGN + "(?![A-Za-z0-9+/_.-]{16})(?=" + VALUE + "{6})", 0)
    mixed = lambda c: (F.length(c) >= LEAST) & c.rlike("[0-9]") & c.rlike("[A-Za-z]") | c.startswith(HEADER)
    assigned = lambda x: (F.length(x["candidate"]) >= SHORT) & x["before"].rlike(ASSIGN + "$")

    def described(starts: Column) -> Column:
        named = F.transform("__found", lambda r, i: F.struct(i.alias("i"), r.alias("run"), name(r).alias("name")))
        parts = F.transform(named, lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"), bare(F.substring(x["run"], F.length(x["name"]) + 1, F.length(x["run"]))).alias("candidate")))
        whole = F.transform(parts, lambda x: F.struct(
            (F.get(starts, x["i"]) + F.length(x["name"])).alias("start"), x["candidate"].alias("candidate"), before(x["i"], x["name"]).alias("before"),
            after(x["i"], F.substring(run(x["i"]), F.length(x["name"]) + F.length(x["candidate"]) + 1, F.length(run(x["i"])))).alias("after"),
        ))
        return F.filter(whole, lambda x: F.coalesce(mixed(x["candidate"]) | assigned(x), F.lit(False)))

    return found.select(*keep, F.explode(_let(_starts(sizes), described)).alias("__c")).select(*keep, "__c.*")


def features(words: list[str]) -> dict[str, Column]:
    """What the forest looks at, from ``candidate``, ``before`` and ``after``; ``words`` is the dictionary, in lower case.

    The dictionary covers those stretches of letters, cut where a capital follows
    a small letter, that are words of it.
    """
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    n = F.length(c).cast("double")
    chars = F.array_distinct(F.split(c, ""))
    share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[a-z]+", "a"), r"[A-Z]+", "A"), r"[0-9]+", "0"), r"[^A-Za-z0-9]+", "_"))
    stretches = F.split(F.lower(F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+")
    covered = F.aggregate(F.filter(stretches, lambda w: (F.length(w) >= 3) & w.isin(*words)), F.lit(0), lambda s, w: s + F.length(w)) / n if words else F.lit(0.0)
    common = (n - F.length(F.regexp_replace(F.lower(c), f"({COMMON})", ""))) / n
    entropy = F.aggregate(
        F.transform(chars, lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    on = lambda condition: condition.cast("double")
    return {
        "length": F.log2(n), "transitions": turns / n, "dictionary": covered, "common": common, "digits": share("[0-9]"), "upper": share("[A-Z]"), "distinct": F.size(chars) / n, "entropy": entropy,
        "hex": on(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "uuid": on(c.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), "joints": share("[^A-Za-z0-9]"),
        "slashes": share("/"), "dots": share(r"\."), "path": on(before.rlike(r"(?:[/\\@]|://|www\.)\S*$") | after.rlike(r"^(?:[/\\@]|\.[a-z])") | c.rlike(r"\.[a-z]{2,4}$|^/")),
        "beginning": on(c.rlike(BEGINNINGS)), "for": on(before.rlike(f"(?:{FOR})[^a-z]{{0,6}}$")), "for_near": on(before.rlike(f"(?:{FOR})")),
        "against": on(before.rlike(f"(?:{AGAINST})[^a-z]{{0,6}}$")), "against_inside": on(F.lower(c).rlike("example|sample|dummy|your[-_]|placeholder|xxxx")),
        "quoted": on(before.rlike("[\"'`]$")), "assigned": on(before.rlike("[=:]\\s*[\"'`]?$")),
    }


def _measured(found: DataFrame, keep: list[str], words: list[str]) -> DataFrame:
    measured = features(words)
    wide = found.select(*keep, *[x.alias(f"__{name}") for name, x in measured.items()])
    return VectorAssembler(inputCols=[f"__{name}" for name in measured], outputCol="__features").transform(wide).select(*keep, "__features")


def train(findings: DataFrame, words: list[str] | None = None) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings ``(text, label)``; a text's first candidate has the label."""
    found = candidates(findings.select("text", F.col("label").cast("double").alias("label"), F.monotonically_increasing_id().alias("__row")), "text", ["__row", "label"])
    first = found.groupBy("__row", "label").agg(F.min_by(F.struct("candidate", "before", "after"), "start").alias("c")).select("label", "c.*")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="sqrt")
    return forest.fit(_measured(first, ["label"], with_common(words)))


def with_common(words: list[str] | None) -> list[str]:
    """A dictionary with the common words in it."""
    return sorted({*(words or []), *(w for w in COMMON.split("|") if len(w) >= 3)})


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """Findings in every whole text: the id, ``start``, ``secret``, ``score``, ``is_secret``.

    One row per candidate, in which ``score`` is the forest's probability of a
    secret and ``is_secret`` says whether that reaches ``threshold``; ``start``
    counts characters from 0. Null and empty texts have no candidates; long texts
    are looked at whole; null ids are kept; a candidate that a text repeats has a
    row for each place; repeated rows come out repeated. ``findings`` (``text,
    label`` 0 or 1) defaults to ``synthetic_findings``. ``words`` is the
    dictionary (``dictionary_of`` the corpus); the common words are always in it.
    Other columns are not looked at.
    """
    model = train(synthetic_findings(docs.sparkSession) if findings is None else findings, words)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__doc"))
    scored = model.transform(_measured(candidates(slim, "__doc", ["__id"]), ["__id", "start", "candidate"], with_common(words)))
    score = F.round(vector_to_array("probability")[1], 9)
    return scored.select(F.col("__id").alias(id_col), F.col("start").cast("long").alias("start"), F.col("candidate").alias("secret"), score.alias("score"), (score >= threshold).alias("is_secret"))
