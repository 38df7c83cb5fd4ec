"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame functions and Spark ML. Candidates are found in each row and stay there as an array, with the words
beside them; the fitted trees become CASE expressions, so that finding, scoring and redacting are one pass over the texts
without a shuffle.

The forest is fitted on labelled findings. labelled_findings() makes them by a rule: values of public key formats and of
usual credentials on one side, and words, numbers, paths, hashes, identifiers and placeholders on the other, each in a line
of text. They do not depend on the documents, so the same forest judges every table; fit_filter() takes any other table of
labelled lines as well.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = r"""["']?[ \t]{0,3}[:=][ \t]{0,3}["']?"""
_NAME = rf"[A-Za-z_.\-]{{2,30}}+{_SIGN}(?:(?<=:)//)?+"
_RUN = r"(?:[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9+/_\-]={0,2}+|[A-Za-z0-9+/_.\-]{14}==|[A-Za-z0-9+/_.\-]{15}=)"
#: A run of 16 or more key letters with dots between and = at the end, with the name that it is assigned to, if any.
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])(?:{_NAME})?{_RUN}"
#: The same, as groups: name and sign before, the candidate itself.
PARTS = rf"(?s)^((?:{_NAME})?)({_RUN})$"
#: Parts of a candidate that are candidates too are what stands between these, from so many letters on.
BETWEEN, LEAST = "[./]+", 16
CREDENTIAL = r"(?i)passw|pwd|secret(?!ar|ion)|token(?!i[sz])|api.?key|access.?key|auth(?!ors?(?![a-z])|orit|enti)|credential|private|bearer"
_CREDENTIAL_NAME = rf"(?=[A-Za-z0-9_.\-]{{2,60}}+{_SIGN})[A-Za-z0-9_.\-]{{0,40}}?(?:{CREDENTIAL})[A-Za-z0-9_.\-]{{0,40}}+{_SIGN}(?:(?i:bearer|basic|token)[ \t]+)?+"
_WIDE = r"""(?:[^\s"'<>&]|&(?![A-Za-z0-9_.\-]{1,40}+=)){4,}+"""
#: A credential's name and four or more letters of any kind up to a space, quote or the next parameter of a URL.
ASSIGNED = rf"(?<![A-Za-z0-9_.\-]){_CREDENTIAL_NAME}{_WIDE}"
#: The same, as groups.
ASSIGNED_PARTS = rf"(?s)^({_CREDENTIAL_NAME})({_WIDE})$"
_FORMATS = (
    "(?:AKIA|ASIA)[A-Z0-9]{16}",
    "gh[pousr]_[A-Za-z0-9]{36}",
    r"xox[abprs]-[A-Za-z0-9\-]{10,}+",
    "[sr]k_live_[A-Za-z0-9]{16,}+",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"eyJ[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{6,}+\.[A-Za-z0-9_\-]{6,}+",
    r"ya29\.[A-Za-z0-9_\-]{16,}+",
    r"hv[sbr]\.[A-Za-z0-9_\-]{16,}+",
    r"SG\.[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+",
    r"hooks\.slack\.com/services/[A-Za-z0-9]+/[A-Za-z0-9]+/[A-Za-z0-9]++",
)
#: Fixed formats of keys: what has one of them is a secret whatever the forest says.
KNOWN = rf"(?<![A-Za-z0-9])(?:{'|'.join(_FORMATS)})(?![A-Za-z0-9])"
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: The user and the password of a URL.
IN_URL = r"""(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/@"'<>]*:[^\s/@"'<>]{3,}+@"""
IN_URL_PARTS = r"""(?s)^(.*?://[^:]*:)(.*)@$"""
#: What stands for a password without being one.
STAND_IN = r"(?i)^(?:pass(?:word|wd|phrase)?|pwd|secret|token|user(?:name)?|x{3,}|\*+|\.{3,}|\$.*|%.*|\{.*|\[.*)$"
#: Values that are no credentials whatever their name: numbers with or without a unit (under a password's name they may be
#: one), and words that switch something.
NUMBER = r"(?i)^[+-]?[0-9][0-9.,_]*(?:ms|s|sec|m|min|h|d|days?|k|m|kb|mb|gb|%)?$"
SWITCH = r"(?i)^(?:true|false|none|null|nil|yes|no|on|off|enabled?|disabled?|required|optional|default|auto|basic|digest|string|str|int|integer|bool|boolean|float|bytes?)$"
PASSWORD = r"(?i)passw|passphrase|pwd|pin\b|secret"
#: Words of letters only, which are judged only as what is assigned to a credential's name.
WORD = "^(?:[A-Za-z]?[a-z]+|[A-Z]+)$"
#: A host or path, of which only parts are judged, and the ends of files whose names carry a digest.
LOCATION = r"^(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,8}/|^/"
ASSET = r"(?i)\.(?:m?js|css|map|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|html?|json|wasm)$"
#: Words beside a candidate that tell of a digest or an identifier, and of an example.
DIGEST = r"(?i)\b(?:commit|sha\d*|md5|crc\d*|digest|checksum|hash|uuid|guid|revision|rev|etag|id|build|version|base64|integrity)\b"
EXAMPLE = r"(?i)example|sample|dummy|placeholder|change.?me|your|redacted|xxxx|todo|goes.?here|insert"
MASK = "[SECRET]"
#: Characters of the text left and right of a candidate in which its neighbouring words are looked for.
LEFT, RIGHT = 40, 24
#: Words of the dictionary, lines of labelled findings of each kind, the forest.
WORDS, LINES, SEED = 4000, 80, 7
TREES, DEPTH = 20, 7
FEATURES = ["length", "transitions", "classes", "digits", "distinct", "dictionary", "path", "credential", "digest", "example", "assigned"]
#: Letters to the classes between which transitions are counted: vowel, consonant, capital, digit; - stands for all others.
_LETTERS = "aeiouybcdfghjklmnpqrstvwxzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_CLASSES = "v" * 6 + "c" * 20 + "U" * 26 + "0" * 10
_MARK = "\u0001"
_FOUND = "array<struct<name:string,value:string,left:string,right:string,inside:boolean>>"


def frequent_words(tokenizer: str, n: int = WORDS) -> list[str]:
    """The dictionary: the first n words of 3 to 12 lower-case letters in the vocabulary file of a byte-level BPE."""
    from tokenizers import Tokenizer

    vocab = sorted(Tokenizer.from_file(tokenizer).get_vocab().items(), key=lambda x: x[1])
    words = [t[1:] for t, _ in vocab if t[:1] == "Ġ" and t[1:].isascii() and t[1:].isalpha() and t[1:].islower() and 3 <= len(t) - 1 <= 12]
    return words[:n]


def with_candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs and a column `out`: every candidate of the text (name, value, left, right, inside). Null counts as empty.

    Candidates are runs of key letters, the parts of runs between dots and slashes (inside), known key formats in runs,
    what is assigned to a credential's name, passwords in URLs, and private key blocks. left and right are the text beside
    it, name is what it is assigned to, up to the value. Numbers and switches under a credential's name are none.
    """
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_MARK), F.lit(" "))

    def cut(pattern: str) -> Column:  # text, match, text, match, ..., text
        return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def found(pieces: Column, parts: str) -> Column:
        n = (F.size(pieces) - 1) / 2
        each = F.transform(
            F.sequence(F.lit(1), n.cast("int")),
            lambda k: F.struct(
                F.regexp_extract(F.get(pieces, 2 * k - 1), parts, 1).alias("name"),
                F.regexp_extract(F.get(pieces, 2 * k - 1), parts, 2).alias("value"),
                F.substring(F.get(pieces, 2 * k - 2), -LEFT, LEFT).alias("left"),
                F.substring(F.get(pieces, 2 * k), 1, RIGHT).alias("right"),
                F.lit(False).alias("inside"),
            ),
        )
        return F.when(n >= 1, each).otherwise(F.array().cast(_FOUND))

    def like(x: Column, value: Column, inside: bool) -> Column:
        return F.struct(F.lit("").alias("name"), value.alias("value"), x["left"].alias("left"), x["right"].alias("right"), F.lit(inside).alias("inside"))

    none = F.array().cast(_FOUND)
    cuts = docs.withColumns({"_runs": cut(CANDIDATE), "_assigned": cut(ASSIGNED)})
    both = cuts.withColumns({"_runs": found(F.col("_runs"), PARTS), "_assigned": found(F.col("_assigned"), ASSIGNED_PARTS)})
    long_part = lambda x: lambda v: (F.char_length(v) >= LEAST) & ~(x["value"].rlike(ASSET) & v.rlike("^[0-9a-f]+$"))
    within = lambda x: F.when(x["value"].rlike("[./]"), F.transform(F.filter(F.split(x["value"], BETWEEN), long_part(x)), lambda v: like(x, v, True))).otherwise(none)
    known = lambda x: F.when(x["value"].rlike(KNOWN), F.transform(F.regexp_extract_all(x["value"], F.lit(KNOWN), F.lit(0)), lambda v: like(x, v, False))).otherwise(none)
    # marks that end a sentence or a bracket are not of an assigned value
    trimmed = F.transform("_assigned", lambda x: x.withField("value", F.regexp_replace(x["value"], r"[.,;:)\]}]++$", "")))
    alone = lambda name, value: F.struct(name.alias("name"), value.alias("value"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit(False).alias("inside"))
    all_of = lambda pattern: F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
    blocks = F.when(F.contains(clean, F.lit("PRIVATE KEY")), F.transform(all_of(PRIVATE_KEY), lambda v: alone(F.lit(""), v))).otherwise(none)
    in_urls = F.transform(all_of(IN_URL), lambda v: alone(F.regexp_extract(v, IN_URL_PARTS, 1), F.regexp_extract(v, IN_URL_PARTS, 2)))
    urls = F.when(F.contains(clean, F.lit("://")), F.filter(in_urls, lambda x: ~x["value"].rlike(STAND_IN))).otherwise(none)
    said = F.filter(trimmed, lambda x: (x["value"] != "") & ~x["value"].rlike(SWITCH) & (~x["value"].rlike(NUMBER) | x["name"].rlike(PASSWORD)))
    runs = F.filter("_runs", lambda x: ~x["value"].rlike(LOCATION) & ~((x["name"] != "") & x["value"].rlike(NUMBER)))
    every = F.concat(runs, F.flatten(F.transform("_runs", within)), F.flatten(F.transform("_runs", known)), said, urls, blocks)
    return both.withColumn(out, every).drop("_runs", "_assigned")


def _steps(value: Column) -> Column:
    """The transitions of a value: pairs of classes of neighbouring letters."""
    classes = F.translate(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), _LETTERS, _CLASSES)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(classes) - 1, F.lit(1))), lambda k: F.substr(classes, k, F.lit(2)))


@dataclass
class SecretFilter:
    """A fitted forest, the log-odds of each transition, and the dictionary."""

    model: RandomForestClassificationModel
    odds: dict[str, float]
    words: list[str]


def features(found: Column, odds: dict[str, float], words: list[str]) -> dict[str, Column]:
    """What the forest sees of a candidate."""
    value, name = found["value"], found["name"]
    size = F.char_length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])
    by_form: dict[str, str] = {}  # first letter and length -> words between spaces
    for w in words:
        by_form[f"{w[0]}{len(w)}"] = by_form.get(f"{w[0]}{len(w)}", " ") + w + " "
    dictionary = F.create_map(*[F.lit(x) for pair in by_form.items() for x in pair])
    is_word = lambda w: F.contains(F.coalesce(F.element_at(dictionary, F.concat(F.left(w, F.lit(1)), F.char_length(w))), F.lit("")), F.concat(F.lit(" "), w, F.lit(" ")))
    own = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    known = F.filter(F.transform(own, F.lower), is_word)
    near = F.concat_ws(" ", F.regexp_extract(found["left"], r"(\S+\s+){0,3}\S*$", 0), name)
    beside = F.concat_ws(" ", near, value, F.regexp_extract(found["right"], r"^\S*(\s+\S+)?", 0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": size,
        "transitions": F.aggregate(_steps(value), F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(table, x), F.lit(0.0))) / size,
        "classes": (F.char_length(kinds) - 1) / size,
        "digits": F.char_length(F.regexp_replace(value, "[^0-9]+", "")) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "dictionary": F.aggregate(known, F.lit(0), lambda a, w: a + F.char_length(w)) / size,
        "path": F.char_length(F.regexp_replace(value, "[^/.]+", "")) + flag(found["inside"] | found["left"].rlike("[/@]$") | found["right"].rlike("^[/@]")),
        "credential": flag(near.rlike(CREDENTIAL)),
        "digest": flag(near.rlike(DIGEST)),
        "example": flag(beside.rlike(EXAMPLE)),
        "assigned": flag(name != ""),
    }


def labelled_findings(spark: SparkSession, words: list[str], lines: int = LINES, seed: int = SEED) -> DataFrame:
    """(text, value, secret): for each kind of finding `lines` lines of text that hold a value of it, by a rule and a seed."""
    rng = random.Random(seed)
    some = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexa, alnum = digits + "abcdef", digits + lower + upper
    word = lambda: rng.choice(words)
    joined = lambda mark, lo, hi: mark.join(word() for _ in range(rng.randint(lo, hi)))
    spoken = lambda lo, hi: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "th"]) for _ in range(rng.randint(lo, hi)))
    digest = lambda: some(h := rng.choice([hexa, hexa.upper()]), n := rng.choice([32, 40, 40, 64]), n)
    uuid = lambda: "-".join(some(hexa, n, n) for n in (8, 4, 4, 4, 12))
    names = ["token", "password", "secret", "api_key", "apikey", "passwd", "client_secret", "access-key", "auth_token", "db.password", "TOKEN", "SECRET_KEY", "Authorization"]
    sign = lambda: rng.choice([" = \"", "=", ": ", ": \"", " = ", "='", "\": \"", ":"])
    close = lambda s: "\"" if "\"" in s else "'" if "'" in s else ""
    mixed = lambda lo, hi: some(alnum, lo, hi) + rng.choice(digits) + rng.choice(lower) + rng.choice(upper)
    human = lambda: word() + some(digits, 2, 4) + rng.choice(["", "!", "&", "#", "_"]) + some(alnum, 1, 4)

    def assigned(name: str, value: str) -> str:
        s = sign()
        return f"{name}{s}{value}{close(s)}"

    def named(kind):  # a credential's value
        return lambda: (assigned(rng.choice(names), v := kind()), v)

    def bare(kind):
        return lambda: ((v := kind()), v)

    def after(names, kind):
        return lambda: (rng.choice([assigned, lambda n, v: f"{n} {v}"])(rng.choice(names), v := kind()), v)

    secret = [
        named(digest), named(digest), named(lambda: mixed(13, 37)), named(lambda: mixed(3, 13)), named(human), named(lambda: some(alnum + "+/", 38, 42)), named(uuid),
        after(["Authorization: Bearer", "-H 'X-Auth:", "api key", "the secret", "login token"], lambda: mixed(17, 37)),
        bare(lambda: mixed(17, 45)), bare(lambda: f"https://{word()}.{word()}.com/{word()}/" + mixed(17, 37)),
        bare(lambda: f"{some(alnum, 2, 6)}.{mixed(17, 30)}.{mixed(17, 30)}"), bare(lambda: "AKIA" + some(upper + digits, 16, 16)), bare(lambda: "ghp_" + some(alnum, 36, 36)),
        bare(lambda: f"xoxb-{some(digits, 10, 12)}-{some(alnum, 24, 24)}"), bare(lambda: "sk_live_" + some(alnum, 24, 24)),
    ]
    harmless = [
        bare(lambda: spoken(8, 12)), bare(lambda: spoken(8, 12).capitalize()), bare(lambda: spoken(8, 12).upper()), bare(lambda: some(digits, 16, 19)), after(["phone", "card", "iban", "order"], lambda: some(digits, 16, 22)),
        bare(lambda: f"{spoken(2, 7)}.{some(digits, 2, 2)}@mail{rng.choice(digits)}.{word()}.com"), bare(lambda: joined("-", 3, 7) + rng.choice(["", "-2024", "-" + some(digits, 1, 5)])), bare(lambda: joined("_", 3, 6)),
        bare(lambda: "/" + joined("/", 3, 7) + rng.choice(["", ".txt", ".html", "/"])), bare(lambda: f"https://www.{word()}{word()}.com/" + joined("/", 1, 4) + "/" + joined("-", 2, 6)),
        bare(lambda: rng.choice(["www.", "docs.", ""]) + f"{word()}.{rng.choice(['com', 'org', 'net', 'de'])}/" + joined("/", 1, 3) + rng.choice(["", "/", ".html", "-" + joined("-", 1, 4) + "-20" + some(digits, 2, 2)])),
        after(["commit", "sha256", "md5", "checksum", "revision", "etag", "git commit", "sha1"], digest), after(["id", "uuid", "guid", "request id"], uuid), bare(uuid), after(["integrity", "digest", "data:image/png;base64,"], lambda: some(alnum + "+/", 40, 90)),
        bare(lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 6))) + rng.choice(["", "2"])), after(["version", "build"], lambda: f"{some(digits, 1, 2)}.{some(digits, 1, 2)}.{some(digits, 1, 3)}-{word()}.{some(digits, 1, 6)}"),
        named(lambda: rng.choice(["your-", "my-example-", "sample-", "<insert-"]) + joined("-", 1, 3) + rng.choice(["-goes-here", "-placeholder", "-123"])), named(lambda: joined("_", 2, 4)), named(lambda: word() + "." + word() + "()"),
        after(["at", "on", "time"], lambda: f"20{some(digits, 2, 2)}-0{rng.randint(1, 9)}-1{some(digits, 1, 1)}T1{some(digits, 1, 1)}:00:00.{some(digits, 3, 6)}Z"), after(["user", "author", "name", "title"], lambda: joined(".", 3, 6)),
        after(["Author", "by", "Name", "From"], lambda: "-".join(spoken(2, 4).capitalize() for _ in range(rng.randint(3, 5))) + rng.choice(["", "-19" + some(digits, 2, 2), "-20" + some(digits, 2, 2)])),
        named(lambda: word() + rng.choice([")", ",", ";", "."])), bare(lambda: "-".join(word().capitalize() for _ in range(rng.randint(3, 6))) + rng.choice(["", "-" + some(digits, 2, 4)])),
    ]
    rows = []
    for label, kinds in ((1, secret), (0, harmless)):
        for kind in kinds:
            for _ in range(lines):
                line, value = kind()
                left = " ".join(rng.choice([word, lambda: spoken(1, 4)])() for _ in range(rng.randint(0, 5)))
                right = rng.choice(["", ".", ",", " ", "\n"]) + " " + joined(" ", 0, 4)
                rows.append([f"{left} {line}{right}", value, label])
    schema = "array<struct<text:string,value:string,secret:int>>"
    made = json.dumps([{"text": t, "value": v, "secret": s} for t, v, s in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(made), schema)))


def _labelled(lines: DataFrame) -> DataFrame:
    """The findings in labelled lines that are, hold, or are a part of the line's value."""
    rows = with_candidates(lines.withColumnRenamed("value", "of"), "text", "found").select("secret", "of", F.explode("found").alias("found"))
    same = F.contains("of", F.col("found.value")) | F.contains(F.col("found.value"), F.col("of"))
    return rows.filter(same & (F.char_length("found.value") >= 4))


def fit_filter(lines: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> SecretFilter:
    """A filter fitted on labelled lines (text, value, secret 0 or 1), which must fit on one machine; ValueError if a kind is missing."""
    found = _labelled(lines).persist()
    try:
        steps = found.select("secret", F.explode(_steps(F.col("found.value"))).alias("step")).groupBy("step").pivot("secret", [0, 1]).count().fillna(0).collect()  # pairs of five classes
        total = [sum(r[str(k)] for r in steps) for k in (0, 1)]
        if not all(total):
            raise ValueError("labelled findings of both kinds are needed")
        odds = {r["step"]: round(float(_log((r["1"] + 1) / (total[1] + 1)) - _log((r["0"] + 1) / (total[0] + 1))), 6) for r in steps}
        seen = found.select("secret", *[c.alias(n) for n, c in features(F.col("found"), odds, words).items()]).coalesce(1)
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen.orderBy(*FEATURES, "secret"))
        model = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(data)
        return SecretFilter(model, odds, words)
    finally:
        found.unpersist()


def _log(x: float) -> float:
    from math import log

    return log(x)


def forest_score(model: RandomForestClassificationModel, of: dict[str, Column]) -> Column:
    """The share of trees that call a candidate a secret, as an expression over its features."""
    columns = list(of.values())

    def vote(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(columns[split.featureIndex()] <= split.threshold(), vote(node.leftChild())).otherwise(vote(node.rightChild()))

    votes = [vote(tree._call_java("rootNode")) for tree in model.trees]
    return sum(votes[1:], votes[0]) / len(votes)


def certain(found: Column) -> Column:
    """Secrets by their format or place alone: known key formats, private key blocks, passwords in URLs."""
    return found["value"].rlike(rf"^{KNOWN}$") | found["value"].startswith("-----BEGIN") | found["name"].contains("://")


def _judged(found: Column) -> Column:
    """Candidates that the forest looks at: no mere word, unless it is assigned to a credential's name."""
    return ~found["value"].rlike(WORD) | found["name"].rlike(CREDENTIAL)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _masked(text: Column, secret: Column) -> Column:
    """The text without a secret: one of LEAST letters or more wherever it stands, a shorter one after its own name only."""
    value, name = secret["value"], secret["name"]
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])("), _quoted(name), F.lit(")"), _quoted(value), F.lit("(?![A-Za-z0-9])"))
    return F.when(F.char_length(value) >= LEAST, F.replace(text, value, F.lit(MASK))).otherwise(F.regexp_replace(text, pattern, F.lit("$1" + MASK)))


def scan(docs: DataFrame, judge: SecretFilter, least: float = 0.5) -> DataFrame:
    """All columns of docs, text with its secrets masked, n_candidates, n_secrets and the secrets themselves.

    A candidate that has a known key format, is a password in a URL, or of which at least `least` of the trees say secret, is
    one. One of LEAST letters or more is masked wherever it stands in the text, a shorter one only where it was found: after
    the name that it is assigned to. n_candidates counts different values, n_secrets and secrets those of the secrets. Null texts count as empty and become
    empty, whole texts are searched, rows are judged each for itself. Columns of docs with one of the three names are
    replaced, others stay. An empty table stays empty.
    """
    docs = docs.drop("n_candidates", "n_secrets", "secrets")
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = with_candidates(docs.toDF(*names), text, "_found")
    sure = F.transform(F.filter("_found", certain), lambda x: F.struct(x["value"].alias("value"), x["name"].alias("name")))
    asked = F.filter("_found", lambda x: ~certain(x) & _judged(x))
    seen = F.transform(asked, lambda x: F.struct(x["value"].alias("value"), x["name"].alias("name"), *[c.alias(n) for n, c in features(x, judge.odds, judge.words).items()]))
    said = F.filter("_seen", lambda x: forest_score(judge.model, {n: x[n] for n in FEATURES}) >= least)
    told = found.withColumns({"_sure": sure, "_seen": seen})
    hit = F.array_union("_sure", F.transform(said, lambda x: F.struct(x["value"].alias("value"), x["name"].alias("name"))))
    kept = told.withColumn("_hit", hit).withColumn("secrets", F.array_sort(F.array_distinct(F.transform("_hit", lambda x: x["value"]))))
    # longer ones first, so that a secret within another leaves no rest
    by_size = F.array_sort("_hit", lambda a, b: F.char_length(b["value"]) - F.char_length(a["value"]))
    masked = F.aggregate(by_size, F.coalesce(text, F.lit("")), _masked)
    n = F.size(F.array_distinct(F.transform("_found", lambda x: x["value"]))).cast("long")
    out = kept.withColumns({text: masked, "n_candidates": n, "n_secrets": F.size("secrets").cast("long")})
    return out.select(*names, "n_candidates", "n_secrets", "secrets").toDF(*docs.columns, "n_candidates", "n_secrets", "secrets")


def scan_with_rules(docs: DataFrame, words: list[str]) -> DataFrame:
    """scan() by a filter fitted on labelled_findings()."""
    return scan(docs, fit_filter(labelled_findings(docs.sparkSession, words), words))
