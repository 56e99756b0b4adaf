"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of characters that keys are made of.  The forest sees its
length, how its characters change between kinds, how much of it is dictionary words,
the path it was found under and the words beside it.  It is trained from labelled findings.
Only DataFrame functions are used, from the scan to the forest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "[A-Za-z0-9_+/=-]"
#: What can be a secret: 16 or more characters of keys, at least one of them a digit.
CANDIDATE = rf"(?<!{_KEY})(?=[A-Za-z_+/=-]*[0-9]){_KEY}{{16,}}"
#: Characters of context on either side.
CONTEXT = 48

# Words that are not random, words beside secrets, words beside other codes.
WORDS = "about access account admin alpha api app base build cache chart class client cloud code color config content count data date default demo device docs document draft event example file final first font form group header height hello home html http image index info item john lang last latest line link list local login main master media menu message model month name network node note number object order page param part path person phone photo place plan point port post price product public query read record release report request result right root sample search sensor server service session site size sort source start state status step style summary system table team temp test text thing time title token total trial type update upload user value version view week width word work world year".split()
SECRET_WORDS = "token secret key apikey passwd password pwd auth authorization bearer credential credentials private access pass".split()
CODE_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid revision build version example sample placeholder dummy etag order invoice card tracking isbn number id ref".split()
PLAIN_PATHS = "test tests testdata example examples sample samples fixture fixtures doc docs lock vendor mock mocks".split()

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_changes", "f_entropy", "f_hex", "f_words", "f_repeats", "f_dashes", "f_assigned", "f_quoted", "f_secret_word", "f_code_word", "f_path"]


def candidates(docs: DataFrame, *, text_col: str = "text", path_col: str | None = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per candidate: ``id_col, ordinal, candidate, before, after, path``.

    The whole text is scanned; the text between candidates gives their context.  Null and
    empty texts have none.  A very long run is one candidate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, F.lit(CANDIDATE), F.lit(-1))
    few = docs.where(F.rlike(F.col(text_col), F.lit(CANDIDATE)))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    pieces = few.select(F.col(id_col), path.alias("path"), found.alias("found"), F.transform(between, lambda x: F.struct(F.right(x, F.lit(CONTEXT)).alias("end"), F.left(x, F.lit(CONTEXT)).alias("start"))).alias("between"))
    each = pieces.select(id_col, "path", "between", F.posexplode("found").alias("ordinal", "candidate"))
    return each.select(id_col, "ordinal", "candidate", F.get("between", F.col("ordinal"))["end"].alias("before"), F.get("between", F.col("ordinal") + 1)["start"].alias("after"), "path")


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.rlike(F.lower(text), F.lit(rf"(?<![a-z])({'|'.join(words)})(?![a-z])")).cast("double")


def featured(found: DataFrame, words: Sequence[str] = WORDS) -> DataFrame:
    """Adds the features to ``candidate, before, after, path``."""
    c = F.coalesce(F.col("candidate"), F.lit(""))
    n = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    left = lambda pattern: F.char_length(F.regexp_replace(c, pattern, ""))
    share = lambda pattern: (F.char_length(c) - left(pattern)) / n
    one = lambda x: (F.char_length(c) - F.char_length(F.replace(c, x, F.lit("")))) / n
    changes = F.regexp_count(c, F.lit("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"))
    entropy = F.aggregate(F.transform(F.array_distinct(F.split(c, F.lit(""))), one), F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))
    near = F.coalesce(F.col("before"), F.lit(""))
    line = F.regexp_extract(near, r"([^\n]*)\z", 1)
    columns = {
        "f_length": F.least(n, F.lit(400.0)), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_signs": share("[^A-Za-z0-9]"),
        "f_changes": changes / n, "f_entropy": entropy, "f_hex": F.rlike(c, F.lit(r"\A[0-9a-f]+\z|\A[0-9A-F]+\z")), "f_words": (F.char_length(c) - F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(words, key=len, reverse=True)), ""))) / n,
        "f_repeats": F.regexp_count(c, F.lit(r"(.)\1\1")) / n, "f_dashes": F.rlike(c, F.lit(r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z")),
        "f_assigned": F.rlike(line, F.lit(r"[=:]\s*[\"'`]?\z")), "f_quoted": F.rlike(line, F.lit(r"[\"'`]\z")),
        "f_secret_word": _any(line, SECRET_WORDS), "f_code_word": _any(line, CODE_WORDS), "f_path": _any(F.coalesce(F.col("path"), F.lit("")), PLAIN_PATHS),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def made_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """Labelled findings made from a rule: ``candidate, before, after, path, label``.

    No public table of labelled findings comes with the project.  Half of these are random keys in
    hexadecimal, base64 or with a prefix, mostly assigned to a name that says so; the
    others are what scanners report wrongly: commit and file digests, UUIDs, long numbers, names
    joined by signs, placeholders, and keys in tests or examples.
    """
    h = lambda k: F.sha2(F.concat_ws("-", F.lit(f"{seed}-{k}"), "id"), 256)
    pick = lambda options, k: F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64(F.lit(f"{seed}-{k}"), "id"), F.lit(len(options))) + 1).cast("int"))
    kind = F.pmod("id", F.lit(12))
    mixed = F.translate(F.base64(F.unhex(h("a"))), "+/=", "x7Q")
    number = F.substr(F.regexp_replace(F.concat(h("n"), h("m")), "[a-f]", ""), F.lit(1), F.lit(16))
    number = F.rpad(number, 16, "1234567890")
    uuid = F.regexp_replace(F.substr(h("u"), F.lit(1), F.lit(32)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    names = F.concat_ws("_", *[pick(WORDS, f"w{j}") for j in range(4)], F.substr(number, F.lit(1), F.lit(2)))
    hex40 = F.substr(h("h"), F.lit(1), F.lit(40))
    given = pick([f'{w}{s}{q}' for w in SECRET_WORDS for s in (" = ", ": ", "=") for q in ('"', "'", "")], "g")
    code = pick([f"{w}{s}" for w in CODE_WORDS for s in (" ", ": ", " = ", "=", ' "')], "c")
    plain = pick(["and then ", "see ", "in ", "the number ", "at ", "\n", "", "with ", "or "], "p")
    case = [
        (hex40, given, 1), (mixed, given, 1), (F.concat(pick(["sk_live_", "ghp_", "AKIA", "xoxb-", "AIza"], "x"), F.substr(mixed, F.lit(1), F.lit(32))), pick(['"', "= ", ": ", " ", "key "], "y"), 1),
        (F.substr(h("k"), F.lit(1), F.lit(32)), given, 1), (F.base64(F.unhex(h("b"))), given, 1), (mixed, F.concat(F.lit("Authorization: Bearer "), F.lit("")), 1),
        (hex40, code, 0), (h("s"), code, 0), (uuid, pick(["id ", 'uuid="', "", " = ", "guid: "], "z"), 0), (number, F.concat(plain, F.lit("")), 0), (names, pick(["", "def ", "= ", '"', " ", "name: "], "d"), 0),
        (F.concat(F.repeat(pick(["x", "0", "abc", "1234", "A"], "r"), 8), F.lit("0123456789")), given, 0),
    ]
    value, before, label = F.lit(None).cast("string"), F.lit("").cast("string"), F.lit(0)
    for k, (v, b, y) in enumerate(case):
        value, before, label = F.when(kind == k, v).otherwise(value), F.when(kind == k, b).otherwise(before), F.when(kind == k, y).otherwise(label)
    # A key in a test is a finding to drop, too.
    path = pick(["src/app/config.py", "settings.yml", "web", "main.js", "", "src12", "news"], "path")
    tested = F.pmod(F.xxhash64(F.lit(f"{seed}-t"), "id"), F.lit(8)) == 0
    return spark.range(n).select(value.alias("candidate"), F.concat(pick(["", "word word ", "// ", "const "], "f"), before).alias("before"), pick(['"', "'", " ", "\n", ";"], "e").alias("after"), F.when(tested, pick(["tests/data/keys.py", "docs/example.md"], "tp")).otherwise(path).alias("path"), F.when(tested, 0).otherwise(label).alias("label"))


def fit(findings: DataFrame, *, label_col: str = "label", trees: int = 20, depth: int = 8, seed: int = 7, words: Sequence[str] = WORDS):
    """A random forest from labelled findings (``candidate, before, after, path`` and a label 0 or 1).

    Gives None if there are not both classes.
    """
    known = findings.where(F.col("candidate").isNotNull() & F.col(label_col).isin(0, 1))
    rows = featured(known, words).withColumn("label", F.col(label_col).cast("double"))
    if rows.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)


def scan(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, words: Sequence[str] = WORDS) -> DataFrame:
    """Every candidate of every text with its ``score`` and ``is_secret``.

    Without a model (None) every candidate counts.  Repeated documents give repeated rows; an
    empty table gives none; null ids and paths are kept.  Columns of the documents other
    than the three play no part.
    """
    found = candidates(docs, text_col=text_col, path_col=path_col, id_col=id_col)
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found, words))
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= threshold).alias("is_secret"))
