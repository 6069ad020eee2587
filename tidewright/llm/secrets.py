"""Operator 1: secret scans with a random forest that removes false positives.

Patterns find candidates in whole texts: values of assignments to names such as token or password, keys with a known prefix, private keys
from header to END line (the header alone where none follows), and long unbroken strings. A random forest then decides from the candidate's length, its
character transitions, how much of it a dictionary covers, whether it is part of a path or address, and the words beside it. The dictionary
is the corpus' own: the DICTIONARY_WORDS words that most rows hold, counted over all rows, and PLACEHOLDERS. The forest is trained from
labelled findings: a DataFrame (before, value, after, label) that the caller may give; by default findings_for_training() makes `findings` of
them by rule from a fixed seed, its false alarms with words of the dictionary.

Null and empty texts have no findings; a row that repeats gets its findings again; ids may be null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = 48
DICTIONARY_WORDS = 20_000
SHORTEST, LONGEST = 4, 20  # letters of a word of the dictionary
NAME = r"(?:token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential|bearer)"
SIGN = r"[\w.-]{0,20}[\"'`]?\]?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"'`]?"
ASSIGNED = re.compile(rf"(?i:{NAME}){SIGN}(?P<value>(?<=[\"'`])[^\s\"'`]{{8,}}|[^\s\"'`<>;,)&#]{{8,}})")
NAMED = re.compile(NAME + SIGN + "$", re.I)
PREFIXED = re.compile(
    r"\b(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})"
)
HEADER = re.compile(r"(?P<value>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?)")
BARE = re.compile(r"(?<![\w+/=.-])(?P<value>[A-Za-z0-9+/=_-]{24,})(?![\w+/=-])")
# A text without any of a kind's stems, in lower case for the first, has no candidate of that kind.
ASSIGNED_STEMS = ("token", "secret", "pass", "pwd", "key", "credential", "bearer")
PREFIXED_STEMS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
# Words of placeholders, which stand in place of secrets, and words that mark a neighbour as telling for or against.
PLACEHOLDERS = frozenset("changeme change example sample test your token here insert default null none placeholder dummy password secret value xxxx config environ getenv process".split())
FOR_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "credential", "bearer", "auth", "private")
AGAINST_WORDS = (
    "example", "sample", "test", "dummy", "placeholder", "your", "sha1", "sha256", "md5", "checksum", "digest",
    "commit", "revision", "uuid", "id", "integrity", "hash", "etag", "version",
)
FEATURES = (
    "length", "entropy", "changes", "digits", "upper", "lower", "symbols", "hex", "longest_run", "distinct",
    "covered", "slashes", "path", "named", "known_prefix", "words_for", "words_against",
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates of a whole text, in order; a stretch counts once, for the first kind that finds it."""
    low, patterns = text.lower(), []
    if "-----BEGIN" in text:
        patterns.append(("header", HEADER))
    if any(x in low for x in ASSIGNED_STEMS):
        patterns.append(("assigned", ASSIGNED))
    if any(x in text for x in PREFIXED_STEMS):
        patterns.append(("prefixed", PREFIXED))
    if max(map(len, text.split()), default=0) >= 24:
        patterns.append(("bare", BARE))
    found: list[tuple[str, int, int]] = []
    for kind, pattern in patterns:
        taken = sorted((a, e) for _, a, e in found)
        for m in pattern.finditer(text):
            a, e = m.span("value")
            near = bisect_left(taken, (e, 0)) - 1
            if (near >= 0 and taken[near][1] > a) or (kind == "bare" and not any(c.isdigit() for c in text[a:e])):
                continue
            found.append((kind, a, e))
    return sorted(found, key=lambda x: x[1:])


def corpus_dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The `words` words of SHORTEST to LONGEST letters that most rows hold, ties in order of the alphabet; rows are counted on the map side first."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))).alias("word")
    counts = docs.select(word).where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return frozenset(r.word for r in counts.orderBy(F.col("n").desc(), "word").limit(words).select("word").collect())


def covered(value: str, dictionary: frozenset[str]) -> int:
    """How many characters of a value are in words of the dictionary, the longest word at each place first."""
    low, at, total = value.lower(), 0, 0
    while at <= len(low) - SHORTEST:
        n = next((n for n in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1) if low[at : at + n] in dictionary or low[at : at + n] in PLACEHOLDERS), 0)
        total += n
        at += n or 1
    return total


def features(before: str, value: str, after: str, dictionary: frozenset[str] = frozenset()) -> list[float]:
    """The forest's inputs of one candidate with up to CONTEXT characters on either side."""
    n = max(1, len(value))
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    group = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    changes = sum(a != b for a, b in zip(group, group[1:])) / n
    run = best = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    near = re.findall(r"[a-z]+\d*", (before + " " + after).lower())
    path = bool(re.search(r"(?:https?://|/|\\|\.\w{1,4}/)\S*$", before)) or bool(re.match(r"\.\w{1,4}\b", after)) or value.count("/") >= 2
    known = bool(re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN", value))
    numbers = (
        min(len(value), 200), entropy, changes, group.count("d") / n, group.count("u") / n, group.count("l") / n, group.count("s") / n,
        all(c in "0123456789abcdefABCDEF-" for c in value), best / n, len(counts) / n, covered(value, dictionary) / n, value.count("/") / n,
        path, bool(NAMED.search(before)), known, sum(w in FOR_WORDS for w in near), sum(w in AGAINST_WORDS for w in near),
    )
    return [float(x) for x in numbers]


def findings_for_training(findings: int = 2400, seed: int = 11, dictionary: frozenset[str] = frozenset()) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label): secrets of common shapes in assignments, and the usual false alarms."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables, known = "the re on in ti er an at nd le la de qu en es ar os ion ch un".split(), sorted(dictionary)
    text = lambda n, a=alnum: "".join(r.choice(a) for _ in range(n))
    word = lambda: r.choice(known) if known and r.random() < 0.8 else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    hexed = lambda kind: kind(text(9).encode()).hexdigest()
    secret = (
        lambda: hexed(hashlib.sha1),
        lambda: text(r.randint(20, 48)),
        lambda: "ghp_" + text(36),
        lambda: "AKIA" + text(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        lambda: base64.b64encode(r.randbytes(r.randint(18, 40))).decode(),
        lambda: hexed(hashlib.md5),
        lambda: text(r.randint(12, 20)) + r.choice("!@%^*"),
        lambda: text(r.randint(10, 18)),
    )
    stand_ins = "your_token_here changeme_please xxxxxxxxxxxxxxxx example-password insert-your-api-key null_or_default ******** <secret-value> test_password_1".split()

    def alarm(assigned: str, quote: str) -> tuple[str, str, str]:
        """What stands before, is and stands after a false alarm."""
        case = r.randrange(9)
        if case == 0:
            return assigned, r.choice(stand_ins), quote
        if case == 1:
            return r.choice(("commit ", "sha1: ", "checksum ", "digest: ", "revision ", "md5 ", "etag ")), hexed(r.choice((hashlib.sha1, hashlib.md5, hashlib.sha256))), ""
        if case == 2:
            h = hexed(hashlib.md5)
            return r.choice(("id ", "uuid: ", "ref ", "")), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", ""
        if case == 3:
            return "https://" + word() + ".example.com/", "/".join(word() for _ in range(4)) + "/" + text(8).lower(), ".html"
        if case == 4:
            return "", "_".join(word() for _ in range(r.randint(4, 7))) + str(r.randint(1, 99)), ""
        if case == 5:
            return "", str(r.randint(10**23, 10**30)), ""
        if case == 6:
            return assigned, r.choice(("os.environ['", "config.get(", "${", "process.env.")) + word().upper() + "_TOKEN", quote
        if case == 7:
            return "", (word() + "-") * r.randint(4, 8) + str(r.randint(1, 9)), ""
        return assigned, word() + r.choice(("", "-", "_", ".")) + word() + r.choice(("", word())), quote

    out = []
    for k in range(findings):
        name = r.choice(("token", "secret", "api_key", "password", "access_key", "AUTH_TOKEN", "client_secret"))
        sign, quote = r.choice((" = ", "=", ": ")), r.choice(('"', "'", ""))
        before, after = prose(r.randint(0, 5)) + " ", " " + prose(r.randint(0, 5))
        if k % 2:
            value = r.choice(secret)()
            bare = value[:4] in ("AKIA", "ghp_") and r.random() < 0.4
            out.append((before + ("" if bare else name + sign + quote), value, ("" if bare else quote) + after, 1))
        else:
            head, value, tail = alarm(name + sign + quote, quote)
            out.append((before + head, value, tail + after, 0))
    return out


def train_forest(spark: SparkSession, findings: DataFrame | None = None, dictionary: frozenset[str] = frozenset(), trees: int = 40, depth: int = 8, seed: int = 5):
    """A fitted RandomForestClassificationModel over FEATURES. findings: (before, value, after, label), a bounded table of reviewed findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    if findings is None:
        rows = findings_for_training(dictionary=dictionary)
    else:
        rows = [(r.before or "", r.value or "", r.after or "", int(r.label)) for r in findings.where("label is not null").toLocalIterator()]
    inputs = [(Vectors.dense(features(b[-CONTEXT:], v, a[:CONTEXT], dictionary)), float(y)) for b, v, a, y in rows]
    table = spark.createDataFrame(inputs, ["features", "label"]).coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(table)


def forest_arrays(model) -> list[tuple[np.ndarray, ...]]:
    """Each tree as arrays (feature, threshold, left, right, share of secrets), to be walked for many candidates at once."""
    out = []
    for tree in model.trees:
        nodes: list[list[float]] = []

        def walk(node) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, 0.0])
            if node.numDescendants() == 0:
                stats = list(node.impurityStats().stats())
                nodes[k][4] = stats[1] / max(1e-12, sum(stats))
            else:
                nodes[k][:2] = node.split().featureIndex(), node.split().threshold()
                nodes[k][2], nodes[k][3] = walk(node.leftChild()), walk(node.rightChild())
            return k

        walk(tree._call_java("rootNode"))
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return out


def forest_scores(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, threshold, left, right, share in trees:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            go = x[rows, feature[at[rows]]] <= threshold[at[rows]]
            at[rows] = np.where(go, left[at[rows]], right[at[rows]])
        total += share[at]
    return total / max(1, len(trees))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, value, score, is_secret) of every candidate in every whole text; positions in code points."""
    dictionary = corpus_dictionary(docs, text_col)
    trees = forest_arrays(train_forest(docs.sparkSession, findings, dictionary))
    known = docs.sparkSession.sparkContext.broadcast(dictionary)
    names = ["doc_id", "start", "end", "kind", "value", "score", "is_secret"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, inputs = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, a, e in candidates(t or ""):
                    rows.append((d, a, e, kind, t[a:e]))
                    inputs.append(features(t[max(0, a - CONTEXT) : a], t[a:e], t[e : e + CONTEXT], known.value))
            if rows:
                score = forest_scores(trees, np.array(inputs))
                d, a, e, kind, value = zip(*rows)
                columns = [*(pa.array(x, pa.int64()) for x in (d, a, e)), pa.array(kind), pa.array(value), pa.array(score), pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, start long, end long, kind string, value string, score double, is_secret boolean")
