"""Secret scan: candidates by pattern, false positives removed by a random forest.

In built-in functions and Spark's own forest only. A candidate is a run of 16 or more of letters
A-Z, digits and ``+ / _ = -``, such runs joined by dots, after a credential's name what quotes
hold or any 6 or more marks without blanks, or the password of an address
(``scheme://user:password@host``); none has a longest length. A name and ``=`` or ``:`` before it belong to what
stands around it. Its features are its length; its character transitions (runs of one
kind, and pairs of neighbours that are frequent in the corpus's words); how much of it dictionary
words cover, the dictionary being the most frequent words of all documents; signs of a path or
address in and before it; and the words around it. The forest learns from labelled findings: given
ones, or those that plain rules label beyond doubt (a credential's name and an assignment before a
mixed run, or a form that only secrets have: a secret; letters only, digits only, inside a path, or
a name's word or stand-in: none). Secrets of mixed letters are learned without their name too.

Defined cases: a null or empty text has no findings; repeated rows have findings each; rows with a
null doc_id too; where labelled findings of one kind are missing, every finding has the chance 1
or 0 of the kind there is, and 0 without any.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import new_path

#: Labelled findings of each kind that the forest may learn from.
PER_KIND = 20_000
DICTIONARY_WORDS, CONTEXT = 400, 48
# Names of credentials, fixed values; the short ones only as whole words before an assignment.
_NAMES = (r"(?i:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api[_\- ]?key|access[_\- ]?key"
          r"|private[_\- ]?key|credential|auth|bearer)")
_SHORT_NAMES = r"(?<![A-Za-z])(?i:pw|pass)"
_ASSIGN = r"\s{0,4}(?:=>|:=|==|[=:])\s{0,4}"
# A credential's name up to its value: an assignment, or blanks before something with a digit.
_LEAD = (r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{0,40}?(?:" + _NAMES + r"[A-Za-z0-9_\-]{0,24}[\"'`]?"
         r"(?:" + _ASSIGN + r"|\s{1,4}(?:is\s)?(?=[^\s\"'`0-9]*+[0-9]))"
         r"|" + _SHORT_NAMES + r"[\"'`]?" + _ASSIGN + r")(?:(?i:bearer|basic|token)\s{1,4})?+")
# Its value: what quotes hold, or 6 or more marks that are not blank, without stops at the end.
# Groups repeat possessively: other repeats of groups take stack for each turn.
_STOPS, _SOLID = r"[.:!?)\]}&,;]", r"[^\s\"'`<>.:!?)\]}&,;]"
_VALUE = (r"(?:[\"'`]?(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')"
          r"|(?=[^\s\"'`<>]{6})(?![&,;])(?:" + _SOLID + r"++|" + _STOPS + r"++(?=" + _SOLID
          + r")(?:(?<![&,;])|(?![A-Za-z0-9_]++=)))++))")
# The password of an address: what is between the user and the host.
_LOGIN_LEAD = r"://[^\s/:@\"'`<>]*+:"
_LOGIN = "(?<=[A-Za-z0-9])" + _LOGIN_LEAD + r"[^\s/\"'`<>]+(?=@[A-Za-z0-9\[])"
# Runs without such a name: parts joined by dots, and single ones.
_RUN = r"[A-Za-z0-9_\-]{16,}+(?:\.[A-Za-z0-9_\-]{6,}+)++|[A-Za-z0-9+/_=\-]{16,}+"
_CANDIDATE = _LOGIN + "|" + _LEAD + _VALUE + "|" + _RUN
# A character that no text should hold; texts that do hold it take another way.
_MARKER = "\ufdd0"
# What of a candidate stands before its value: the credential's name, or another name and `=`.
_NAMED_LEAD = "^(?:" + _LOGIN_LEAD + "|" + _LEAD + r"[\"'`]?(?=\S))"
_OTHER_LEAD = r"^[A-Za-z_][A-Za-z0-9_\-]*=+(?=[A-Za-z0-9+/_\-.]{16})"
# Passwords of addresses in examples.
_SAMPLES = r"(?i)^(user|pass|pw|pwd|password|passwd|secret|token|changeme)$"
# Forms that only secrets have.
_FORMS = (r"^(A(KIA|SIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|xox[abprs]-\S{10,}"
          r"|[sr]k_(live|test)_\w{10,}|AIza[\w\-]{35}|glpat-[\w\-]{20}"
          r"|eyJ[\w\-]{5,}\.eyJ[\w\-]{5,}\.[\w\-]{6,})$")
# Values that stand for another one.
_STAND_INS = r"(?i)^(\$|%|\{|\*+$|x+$|null|none|true|false|undefined|required|optional|your|example)"
FEATURES = ("length", "runs", "pairs", "distinct", "digits", "upper", "marks", "hex", "coverage",
            "slashes", "after_path", "address", "named", "assigned", "quoted", "word_before",
            "digits_before", "word_after", "form", "dots", "login")

#: Features of what stands around a value.
AROUND = ("after_path", "address", "named", "assigned", "quoted", "word_before", "digits_before",
          "word_after", "login")


def candidates(docs: DataFrame) -> DataFrame:
    """Findings of every text: ``doc_id``, ``start`` (code points before), ``value``, and up to
    48 code points ``before`` and ``after`` (before: the whole name of the value, if longer)."""
    text = F.coalesce("text", F.lit(""))
    # One pass of the pattern puts markers around the findings: gap, finding, gap, ..., gap.
    parts = F.when(text.contains(_MARKER), _interleaved(text)).otherwise(F.split(
        F.regexp_replace(text, _CANDIDATE, f"{_MARKER}$0{_MARKER}"), _MARKER, -1))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.explode(_once(parts, _findings)).alias("f")).select("doc_id", "f.*")
    # The name before a value belongs to what stands before it.
    named = F.regexp_extract("value", _NAMED_LEAD, 0)
    found = found.withColumn("lead", F.when(named != "", named).otherwise(
        F.regexp_extract("value", _OTHER_LEAD, 0)))
    size = F.char_length("lead")
    return found.select(
        "doc_id", (F.col("start") + size).alias("start"),
        F.substring("value", size + 1, F.char_length("value") - size).alias("value"),
        F.right(F.concat("before", "lead"), F.greatest(F.lit(CONTEXT), size + 1)).alias("before"),
        "after")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _interleaved(text: Column) -> Column:
    """Gaps and findings of a text in turn, by two passes of the pattern."""
    gaps = F.split(text, _CANDIDATE, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0)), F.array(F.lit("")))
    both = F.flatten(F.zip_with(gaps, found, lambda gap, value: F.array(gap, value)))
    return F.slice(both, F.lit(1), F.size(both) - 1)


def _findings(parts: Column) -> Column:
    """Findings of the parts of a text as structs."""
    ends = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, part: F.struct((acc.at + F.char_length(part)).alias("at"),
                                   F.concat(acc.starts, F.array(acc.at)).alias("starts")))["starts"]
    places = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    return F.when(F.size(parts) > 1, _once(ends, lambda starts: F.transform(places, lambda i: F.struct(
        F.get(starts, i).alias("start"), F.get(parts, i).alias("value"),
        F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after")))))


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of 3 to 12 small letters a-z over all documents (at most
    ``words``; ties in order of the words)."""
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counted = found.filter(F.col("word").rlike("^[a-z]{3,12}$")).groupBy("word").agg(
        F.count("*").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def _share(value: Column, kinds: str) -> Column:
    """Share of the characters of these kinds."""
    return F.char_length(F.regexp_replace(value, f"[^{kinds}]", "")) / F.char_length(value)


def finding_features(findings: DataFrame, words: list[str]) -> DataFrame:
    """``findings`` with the columns of ``FEATURES``, all doubles."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.char_length(v)
    low = F.lower(v)
    # Longest first, so that a word wins over its own beginning.
    terms = "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"\z."
    pairs = "|".join(sorted({w[i:i + 2] for w in words for i in range(len(w) - 1)})) or r"\z."
    flags = {
        "hex": low.rlike("^[0-9a-f]+$"),
        "after_path": before.rlike(r"[/\\.~@]$") | after.rlike(r"^[/\\.@]\S"),
        "address": before.rlike(r"(?i)(://|www\.|@)\S*$"),
        "named": before.rlike(_NAMES + "|" + _SHORT_NAMES + r"[\"'`]?" + _ASSIGN + r"[\"'`]?$"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$"),
        "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        "word_before": before.rlike(r"\p{L}[.,;]?\s+$"),
        "digits_before": before.rlike(r"\d\s*$"),
        "word_after": after.rlike(r"^[\"'`]?[.,;]?\s+\p{L}"),
        "form": v.rlike(_FORMS), "dots": v.contains("."),
        "login": before.rlike(_LOGIN_LEAD + "$") & after.startswith("@"),
    }
    numbers = {
        "length": F.log2(n),
        "runs": F.char_length(F.regexp_replace(
            v, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n,
        "pairs": 1 - F.char_length(F.regexp_replace(low, pairs, "")) / n,
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / n,
        "digits": _share(v, "0-9"), "upper": _share(v, "A-Z"), "marks": _share(v, r"+/_=\-"),
        "coverage": 1 - F.char_length(F.regexp_replace(low, terms, "")) / n,
        "slashes": _share(v, "/"),
    }
    return findings.withColumns(
        {k: x.cast("double") for k, x in numbers.items()}
        | {k: x.cast("int").cast("double") for k, x in flags.items()})


def rule_label() -> Column:
    """1 or 0 for findings beyond doubt, else null."""
    v = F.col("value")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    named = F.col("before").rlike(
        "(?i)(" + _NAMES + r"[A-Za-z0-9_\-]{0,24}[\"'`]?\s*(=>|:=|==|=|:|\s|is\s)|" + _SHORT_NAMES
        + r"[\"'`]?\s*(=>|:=|==|=|:))\s*((bearer|basic|token)\s+)?[\"'`]?$")
    login = F.col("login") == 1
    word = v.rlike(r"^[A-Za-z_\-]+$") & ((F.col("coverage") >= 0.8) | (F.char_length(v) < 10))
    return (F.when(v.rlike(_FORMS), 1)
            .when(login & (v.rlike(_STAND_INS) | v.rlike(_SAMPLES) | (v.rlike("^[A-Za-z_\\-]+$")
                                                  & (F.col("coverage") >= 0.8))), 0)
            .when(login & mixed, 1)
            .when(named & (v.rlike(_STAND_INS) | word), 0)
            .when(named & mixed & (F.col("distinct") * F.char_length(v) >= 8), 1)
            .when(~named & ~login & (v.rlike("^[A-Za-z=_.\\-]+$") | v.rlike("^[0-9_.\\-]+$")
                            | (F.col("address") == 1)), 0))


def _unnamed(known: DataFrame) -> DataFrame:
    """Secrets of capitals, small letters and digits once more without what stands around them:
    else the forest would learn that only a name makes a secret."""
    v = F.col("value")
    bare = known.filter((F.col("label") == 1) & v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
                        & (F.char_length(v) >= 20))
    return bare.withColumns({c: F.lit(0.0) for c in AROUND}
                            | {"before": F.lit(""), "after": F.lit("")})


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5,
                 per_kind: int = PER_KIND, trees: int = 30, depth: int = 8) -> DataFrame:
    """Every finding with its chance to be a secret: ``doc_id``, ``start``, ``value``,
    ``p_secret`` and ``is_secret`` (1 from ``threshold``).

    ``labels`` may hold labelled findings: ``doc_id``, ``start``, ``is_secret``.
    """
    spark = docs.sparkSession
    path = new_path(spark, "findings")
    finding_features(candidates(docs), dictionary(docs)).write.parquet(path)
    findings = spark.read.parquet(path)
    if labels is None:
        known = findings.withColumn("label", rule_label())
        known = known.unionByName(_unnamed(known))
    else:
        known = findings.join(labels.select("doc_id", "start", F.col("is_secret").alias("label")),
                              ["doc_id", "start"])
    known = known.select(F.col("label").cast("double").alias("label"), *FEATURES,
                         F.xxhash64("value", "before", "after").alias("__order"))
    parts = [known.filter(F.col("label") == kind).orderBy("__order").limit(per_kind)
             for kind in (0.0, 1.0)]
    sample_path = new_path(spark, "findings-sample")
    parts[0].unionByName(parts[1]).write.parquet(sample_path)
    sample = spark.read.parquet(sample_path)
    kinds = {r.label for r in sample.select("label").distinct().collect()}
    keep = ("doc_id", "start", "value")
    if len(kinds) < 2:
        scored = findings.withColumn("p_secret", F.lit(float(max(kinds, default=0.0))))
    else:
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        forest = RandomForestClassifier(
            featuresCol="__features", labelCol="label", probabilityCol="__chance",
            rawPredictionCol="__raw", predictionCol="__kind", numTrees=trees, maxDepth=depth,
            seed=7).fit(gather.transform(sample))
        scored = forest.transform(gather.transform(findings)).withColumn(
            "p_secret", F.get(vector_to_array("__chance"), F.lit(1)))
    return scored.select(*keep, "p_secret",
                         (F.col("p_secret") >= threshold).cast("int").alias("is_secret"))
