"""Secret scans: candidate strings from patterns, false positives removed by a random forest.

The forest is trained on labelled findings and judges each candidate by its
length, its character transitions, how much of it dictionary words cover, the
path of its document, and the words next to it.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without_summary

#: A private key block; what is assigned to a name that speaks of a secret, of any characters; a quoted value; an unquoted run of token characters.
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<![A-Za-z_.-])(?=[A-Za-z_.-]*?(?:token|secret|passw|pwd|key|auth|bearer|credential))[A-Za-z_.-]++[\"']?\s*+[=:]\s*+[\"']?(?P<value>[^\s\"',;]{6,})"
    r"|(?<=[\"'])[^\s\"']{8,}(?=[\"'])"
    r"|(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}",
    re.I,
)
#: Fixed word lists: what stands next to secrets, what stands next to other long strings, and a small dictionary.
SECRET_WORDS = "token secret password passwd pwd apikey api_key key auth bearer credential access_key private_key client_secret signature".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest etag hash uuid guid id version build revision request trace file path url link integrity".split()
DICTIONARY = """about above access account action active address after again agent align already always answer apple array
author back background backup base before below between body border bottom branch button cache call case center change
changeme check child class client close code color column comment common company config connect content context control
copy count create current data database date default delete demo detail device dialog display document domain download
draft dummy east edit element email empty enable error event every example exist expect export false field file filter
final first folder font footer form format forward found function general global green group handle header height hello
here hidden history home horse host house image import index info input insert install item join keyboard label language
large layout left length letter level library light limit line link list local login long main manager margin master
match memory menu message method middle model module mouse move name network node none normal north note number object
offer office only open option order other output owner page parent part password path pattern person phone photo place
placeholder plain player please plugin point position post power press previous price print private process product
profile program project property public query question random read record remove report request reset resource response
result return right root router sample save schema screen script search secret section select send server service
session setting share shell short show simple single site size small sound source south space staging stage standard
start state static status stop storage store string style submit support sure switch system table target task template
test text theme this time title token tool total track transfer translate true type undefined unique update upload user
username value variable vector version video view visible warning water weather website welcome west white width window
word work world write wrong yellow your""".split()
FEATURES = (
    "length", "digit_share", "upper_share", "other_share", "distinct_share", "class_changes", "pair_surprise", "longest_letters",
    "dictionary_share", "is_hex", "secret_near", "other_near", "secret_after", "other_after", "assigned", "test_path",
)
_LETTER_PAIRS = {a + b for w in DICTIONARY for a, b in zip(w, w[1:])}
_BY_SIZE = sorted((w for w in DICTIONARY if len(w) >= 4), key=len, reverse=True)
_WORDS_OF = re.compile("|".join(map(re.escape, _BY_SIZE)))
_NEAR = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")
_TEST = re.compile(r"test|example|sample|fixture|mock|docs?(?![a-z])", re.I)


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """The features of a candidate, the text just before and after it, and its document's path."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in value]
    lower = value.lower()
    letters = [a + b for a, b in zip(lower, lower[1:]) if a.isalpha() and b.isalpha()]
    words = lambda found: {p for w in found for p in (w.lower(), *re.split(r"[_.-]", w.lower()))}
    parts, next_parts = words(_NEAR.findall(before)[-4:]), words(_NEAR.findall(after)[:3])
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("o") / n, len(set(value)) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(p not in _LETTER_PAIRS for p in letters) / len(letters) if letters else 0.5,
        max(map(len, re.findall(r"[A-Za-z]+", value)), default=0) / n,
        sum(map(len, _WORDS_OF.findall(lower))) / n,
        float(not set(lower) - set("0123456789abcdef-")),
        float(bool(parts & set(SECRET_WORDS))), float(bool(parts & set(OTHER_WORDS))), float(bool(next_parts & set(SECRET_WORDS))), float(bool(next_parts & set(OTHER_WORDS))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(_TEST.search(path))),
    ]


def labelled_findings(count: int = 2400, seed: int = 3) -> list[tuple[str, str, str, str, float]]:
    """Labelled findings (value, text before it, text after it, path, 1.0 for a secret), made up by rule."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: r.choice(DICTIONARY)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    secrets = [
        lambda: some("0123456789abcdef", r.choice((32, 40, 48, 64))), lambda: some(alnum, r.randint(20, 48)), lambda: some(b64, 40), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, r.randint(32, 48)), lambda: f"eyJ{some(alnum, 20)}.{some(alnum, 40)}.{some(alnum, 30)}",
        lambda: some(alnum + "!#%*_-", r.randint(10, 18)), lambda: f"-----BEGIN PRIVATE KEY-----\n{some(b64, 64)}\n-----END PRIVATE KEY-----",
    ]
    others = [
        lambda: "-".join(word() for _ in range(r.randint(3, 5))), lambda: "_".join(word() for _ in range(r.randint(3, 5))), lambda: "".join(word().title() for _ in range(3)) + "Id",
        lambda: "/".join(word() for _ in range(r.randint(3, 6))), lambda: "your-" + word() + "-token-here", lambda: some("xX*", 1) * r.randint(8, 40), lambda: some(string.digits, r.randint(16, 24)),
        lambda: f"{word()}.{word()}.{r.choice(('com', 'org', 'net'))}/{word()}-{word()}-{r.randint(1, 9999)}", lambda: "changeme" + some(string.digits, 3), lambda: "=-_."[r.randrange(4)] * r.randint(16, 60),
        lambda: "".join(word() for _ in range(r.randint(3, 5))), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}",
    ]
    digests = [lambda: some("0123456789abcdef", r.choice((32, 40, 64))), lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))]
    out = []
    for i in range(count):
        path = r.choice(("src/main.py", "app/config.yml", "lib/io.rs", "notes.txt", "web/index.html", "tests/fixtures/data.json", "docs/example.md"))
        lead, sign = " ".join(word() for _ in range(3)), r.choice((' = "', '="', ": ", '": "', " "))
        tail = r.choice(('" ', '", ', " ", "\n", "; ")) + " ".join(word() for _ in range(3))
        if i % 2:
            name = r.choice(SECRET_WORDS) if r.random() < 0.85 else word()
            name = r.choice((name, name.upper(), "config." + name, "my_" + name))
            out.append((r.choice(secrets)(), f"{lead} {name}{sign}", tail if r.random() < 0.9 else f" {r.choice(SECRET_WORDS)} {tail}", path, 1.0))
        elif r.random() < 0.35:
            out.append((r.choice(digests)(), f"{lead} {r.choice(OTHER_WORDS)}{sign}", tail if r.random() < 0.8 else f" {r.choice(OTHER_WORDS)} {tail}", path, 0.0))
        else:
            name = r.choice((*OTHER_WORDS, word(), word(), word(), *(SECRET_WORDS[:4] if r.random() < 0.3 else ())))
            out.append((r.choice(others)(), f"{lead} {name}{sign}", tail, path, 0.0))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, float]] | None = None, trees: int = 40, depth: int = 8) -> PipelineModel:
    """Fit the forest on a small list of labelled findings; the same list gives the same forest."""
    rows = [(*features(v, b, a, p), y) for v, b, a, p, y in (labelled_findings() if findings is None else findings)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=[*FEATURES, "label"])).coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="vector")
    return without_summary(Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="vector"), forest]).fit(table), spark)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, h, text, path in zip(batch["doc_id"], batch["text_hash"], batch["text"], batch["path"]):
            for m in CANDIDATE.finditer(text or ""):
                start, end = m.span("value" if m["value"] else 0)
                value = text[start:end]
                assigned, quoted = bool(m["value"]) or value.startswith("-----BEGIN"), text[start - 1 : start] in ("'", '"')
                if assigned or quoted or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                    rows.append((doc_id, h, start, end, value, *features(value, text[max(0, start - 80) : start], text[end : end + 80], path or "")))
        out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "start", "end", "value", *FEATURES])
        yield out.astype({"doc_id": batch["doc_id"].dtype, "text_hash": "int64", "start": "int64", "end": "int64", **{c: "float64" for c in FEATURES}})


def secret_findings(docs: DataFrame, model: PipelineModel, path: Column | None = None) -> DataFrame:
    """Every candidate of every whole text: doc_id, text_hash, start and end (code points), value, score and is_secret.

    One row per candidate, whatever its length: what is assigned to a name that
    speaks of a secret, a quoted run of 8 characters or more without blanks, and
    any run of 16 or more token characters with a digit and a letter. Where two
    begin together, the first kind of these is taken; candidates don't overlap.
    A document without any (null or empty texts among them) has no row. Repeated
    rows give repeated findings; texts of any length are read whole. path
    defaults to the column source where there is one; other columns are not
    read.
    """
    path = path if path is not None else F.col("source") if "source" in docs.columns else F.lit("")
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), path.cast("string").alias("path"))
    schema = "doc_id long, text_hash long, start long, end long, value string, " + ", ".join(f"{c} double" for c in FEATURES)
    scored = model.transform(read.mapInPandas(_candidates, schema)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_hash", "start", "end", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def without_secrets(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found secret replaced by `mark`, and n_chars counted anew where docs has it.

    Rows and their other columns stay as they are; a text without secrets too.
    """
    spans = findings.where("is_secret").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end")), asc=False).alias("spans"))
    joined = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("s.text_hash")), "left")
    clean = F.aggregate(
        F.coalesce("s.spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.col("d.text").cast("string"),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substring(t, (s["end"] + 1).cast("int"), F.length(t))),
    )
    columns = []
    for c in docs.columns:
        own = F.col(f"d.`{c}`")
        columns.append(clean.alias(c) if c == "text" else F.when(F.col("s.spans").isNull(), own).otherwise(F.length(clean)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own)
    return joined.select(*columns)
