"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is content-addressed by its SHA-256. The ledger
holds, for each blob and rule version, what was found; a scan takes the distinct
blobs that the ledger lacks under the present rules (an anti-join), applies the
rules to those alone, appends the findings, and joins findings back to all paths
that hold the blob. The ledger is a Parquet table bucketed by blob, so joining it moves no
part of its history. `op6_secrets` and the pipeline have a ledger of their own for
a run, in the shared folder, and feed it the documents in two appends (APPENDS); it goes
when its findings have been taken.

Texts move once: a partial aggregate keeps one text of each blob in every task, and
what is left of these goes to the task that judges its blob, seen or not.

Match positions without user functions: `split` gives the text between matches and
`regexp_extract_all` the matches; running lengths of the two are the spans.

Base rules assign, access and hex; the method adds private keys, JSON web tokens and
prefixed service tokens. Of a private key RULES, and so `op6_secrets` and its SQL, give
the header line; `redact` replaces the whole key (WHOLE_KEYS). A match is leftmost and doesn't overlap others of
its kind; one that fails its kind's length is dropped after it was matched.

Defined cases: a null text is an empty one; very long texts are scanned whole; repeated
rows are paths of one blob; spans that begin together are in the order of the rules;
an empty table gives an empty result and adds nothing to the ledger; columns of
the names that the operator adds are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.llm.common import checkpoint, let, table, text_or_empty, without
from searchkit.session import shared_folder


def _either(word: str) -> str:
    """A word with letters in either case, as classes (folding in regex engines also takes other letters)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    base: bool = True


_NAMES = "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, False),
    Rule("service", "(?:ghp_|gho_|ghs_|xoxb-|xoxp-|sk_live_|glpat-)[A-Za-z0-9_-]+", 0, 20, False),
)
#: A private key whole: to its END line, or without one to the end of its base64 lines (line breaks may be written out or spaces).
_BREAK = "(?:[\\x20\\t]*+(?:\\r?\\n|\\r|\\\\r\\\\n|\\\\n|\\\\r)[\\x20\\t]*+)"
_KEY = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    f"|(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\\r\\n\\\\]*+)*+"
    f"(?:{_BREAK}*+[\\x20\\t]*+[A-Za-z0-9+/=]{{40,}}+|{_BREAK}++[A-Za-z0-9+/=]++(?=[\\x20\\t]*+(?:[\\r\\n\\\\\"']|-----|\\z)))*+)"
)
WHOLE_KEYS = tuple(Rule(r.kind, _KEY, r.group, r.least, r.base) if r.kind == "pem" else r for r in RULES)
#: Rules whose pattern, being one greedy class, may ask for its length itself (the same matches, fewer of them).
_SELF = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans")
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """The spans of one rule in a text, in order."""
    pattern = F.lit(_SELF.get(rule.kind, rule.pattern))

    def of(m: Column) -> Column:
        def walk(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(m["gaps"], i))
            end = start + F.length(F.get(m["found"], i))
            span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
            fits = F.length(F.get(m["value"], i)) >= rule.least
            return F.struct(end.cast("long").alias("at"), F.when(fits, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m["found"]) - 1), zero, walk, lambda acc: acc["out"])

    found = F.struct(
        F.split(text, pattern.cast("string"), -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    return F.when(text.rlike(_SELF.get(rule.kind, rule.pattern)), let(found, of)).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule_version, secret_spans) of (blob, text) rows; spans by start, then kind as listed."""
    spans = F.sort_array(F.concat(*[_spans(F.col("text"), i, r) for i, r in enumerate(rules)]))
    return blobs.select("blob", F.lit(rule_version(rules)).alias("rule_version"), spans.alias("secret_spans"))


#: Buckets of the ledger, and appends in which one table of documents is fed to it.
BUCKETS, APPENDS = 64, 2


class Ledger:
    """Findings by blob and rule version: a Parquet table bucketed by blob, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        """path: None for a new ledger in the session's shared folder; else a ledger, which is made if it isn't there."""
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.table = "ledger_" + hashlib.md5(self.path.encode()).hexdigest()
        kinds = f"blob STRING, rule_version STRING, secret_spans {SPANS}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({kinds}) USING parquet CLUSTERED BY (blob) SORTED BY (blob) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def seen(self, version: str) -> DataFrame:
        """(blob, secret_spans) of what has been scanned under these rules."""
        return self.spark.table(self.table).where(F.col("rule_version") == version).select("blob", "secret_spans")

    def append(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
        """Scan the blobs of docs that the ledger lacks under these rules, and add them; how many they are."""
        version = rule_version(rules)
        rows = docs.select(blob_id(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
        each = rows.groupBy("blob").agg(F.first("text").alias("text"))
        new = checkpoint(scan(each.join(self.seen(version).select("blob"), "blob", "left_anti"), rules))
        n = new.count()
        if n:
            new.repartition(self.buckets, "blob").sortWithinPartitions("blob").write.format("parquet").bucketBy(self.buckets, "blob").sortBy("blob").mode("append").saveAsTable(self.table)
        return n

    def findings(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, appends: int = 1) -> DataFrame:
        """(blob, secret_spans) of all that the ledger has under these rules, once docs are in it; they are added in so many parts."""
        part = F.pmod(F.xxhash64(*[c for c in docs.columns if c != text_col], F.length(text_col)), F.lit(appends))
        for k in range(appends):
            self.append(docs.where(part == k) if appends > 1 else docs, text_col, rules)
        return self.seen(rule_version(rules))

    def drop(self) -> None:
        """Remove the ledger with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def blob_id(text_col: str = "text") -> Column:
    return F.sha2(text_or_empty(text_col), 256)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(docs: DataFrame, text_col: str, ledger: Ledger | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's findings once docs are in it; without a ledger those of one for this call, which is removed again."""
    if ledger is not None:
        return ledger.findings(docs, text_col, rules, APPENDS)
    own = Ledger(docs.sparkSession)
    try:
        return checkpoint(own.findings(docs, text_col, rules, APPENDS))
    finally:
        own.drop()


def find_secrets(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (without text_col) with secret_spans and the counts and digests of the base rules.

    Only hashes and findings meet in the join; what it joins is written, so
    that adaptive execution can split a blob with very many paths.
    """
    docs = without(docs, [*ADDED, "blob"])
    found = _found(docs, text_col, ledger, rules)
    paths = checkpoint(docs.withColumn("blob", blob_id(text_col)).drop(text_col))
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return paths.join(found, "blob").withColumns({
        "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
        "base_sha256": F.sha2(_digest(base), 256), "spans": _digest(F.col("secret_spans")),
    })


def redact(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = WHOLE_KEYS, few_bytes: int = 64 << 20) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (overlapping spans as one, by the first's kind).

    Blobs with a finding are broadcast if a count of their bytes shows them to be few; beyond, texts meet them in a shuffle.
    """
    docs = without(docs, ["_blob", "_spans"])
    found = _found(docs, text_col, ledger, rules)
    found = checkpoint(found.where(F.size("secret_spans") > 0).select(F.col("blob").alias("_blob"), F.col("secret_spans").alias("_spans")))
    size = found.agg(F.sum(F.lit(150) + 40 * F.size("_spans"))).first()[0] or 0
    joined = docs.withColumn("_blob", blob_id(text_col)).join(F.broadcast(found) if size <= few_bytes else found, "_blob", "left")
    text = F.col(text_col)
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    pieces = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], cut(acc["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text).cast("long"))),
    )
    return joined.withColumn(text_col, F.when(F.size("_spans") > 0, pieces).otherwise(text)).select(*docs.columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _oracle() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = _SELF.get(r.kind, r.pattern).replace("'", "''")
        parts.append(f"""
  SELECT r, {rank} AS rank, '{r.kind}' AS kind, g, m, v FROM (
    SELECT r, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS v
    FROM docs WHERE regexp_matches(text, '{p}'))""")
    leasts = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}
), spans AS (
  SELECT r, rank, kind, length(v[i]) AS size,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM found, unnest(range(1, len(m) + 1)) AS t(i)
), fit AS (
  SELECT r, rank, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM spans WHERE size >= CASE rank {leasts} END
), by_doc AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM fit GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_doc USING (r)
"""


ORACLE = _oracle()
