"""Secret scans over a ledger of blobs, with DataFrame functions only.

Every historical version of a file is a row (path, text). Its content address is the SHA-256
of the text, so versions with the same text are one blob. The ledger has the pairs (blob,
rule version) scanned so far; scan() reads only blobs with an unseen pair, applies only the
unseen rules to them, and returns the new ledger rows and findings. locate() joins findings
back to all paths.

Skew: copies of a blob are merged by a partial aggregate before any shuffle, and the join
back deals the paths of one blob over salts.

Null texts count as empty (redacted() leaves them null); an empty table has no findings; a text may be of any length and
have any number of matches, both cost in proportion. Offsets are code points, end exclusive. Spans of one
start are in the order of the rules. Repeated rows, and rows with null or equal ids, are versions of their own. Columns
of the rows may have any names, those used here included."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.components import shared_folder


@dataclass(frozen=True)
class Rule:
    """kind: name in reports; pattern: Java regular expression, its leftmost non-overlapping
    matches are candidates; group, least: a match counts if that group has so many characters;
    hint: a cheaper pattern that every text with a match has."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", _ASSIGN, 2, 6),
    # maximal runs, so the least length may stand in the pattern: a shorter first match hides no longer one
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
_KEY = "(?:[A-Z]{1,20} ){0,6}PRIVATE KEY-----"
#: Published formats of further credentials; their spans stand beside the base ones. Every repetition is possessive, bounded or of
#: one class of characters, so that the matcher's stack does not grow with the text.
MORE_RULES = (
    # to the END of the key, or the BEGIN alone where no END comes before the next key
    Rule("pem", f"-----BEGIN {_KEY}(?:(?:[^-]++|-(?!----(?:BEGIN|END) {_KEY}))*+-----END {_KEY})?", version=3, hint="-----BEGIN "),
    Rule("hosted_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint=r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/@]{3,}+@", version=2, hint="://[^\\s/:@]++:"),
)
RULES = BASE_RULES + MORE_RULES

#: Parts over which the paths of one blob are dealt in the join back.
SALTS = 16
#: Code points of a text in one piece of redact().
PIECE = 4096

_FINDING = "array<struct<start:int,rank:int,kind:string,end:int,rule_key:string>>"


def _none() -> Column:
    return F.array().cast(_FINDING)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: an expression that stands in a lambda is worked out again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array by doubling steps: as many rounds as its size has bits, each a pass over the array."""

    def further(acc: Column, r: Column) -> Column:
        step = F.pow(F.lit(2.0), r).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), step), F.slice(acc, F.lit(1), F.size(acc) - step)), both)

    def total(own: Column) -> Column:
        n = F.size(own)
        rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, own, further)

    return _let(values, total)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule as spans. The texts between matches give where each one starts, by running sums of lengths."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)

    def placed(both: Column) -> Column:
        found, between = both["found"], both["between"]
        ends = _running(F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.length(m) + F.length(gap)), lambda a, b: a + b)
        size = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
        spans = F.zip_with(ends, found, lambda end, m: F.when(size(m) >= rule.least, F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.key).alias("rule_key"))))
        return F.filter(spans, lambda s: s.isNotNull())

    return F.when(text.rlike(rule.hint or rule.pattern), _let(F.struct(found.alias("found"), between.alias("between")), placed)).otherwise(_none())


def address(text: Column) -> Column:
    """Content address of a version."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """One row for each blob with an unseen pair: blob_id, todo (rule keys scanned now), spans.

    ledger: (blob_id, rule_key) scanned before, from ledger_rows(); None: nothing was. Copies of a blob are merged before the
    ledger is joined, and the join needs no second shuffle of the texts."""
    blobs = versions.select(address(F.col(text)).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy("blob_id").agg(F.first("_text").alias("_text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob_id").agg(F.collect_set("rule_key").alias("_seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    spans = F.concat(*[F.when(F.array_contains("todo", r.key), _spans(F.col("_text"), r, k)).otherwise(_none()) for k, r in enumerate(rules)])
    return blobs.select("blob_id", "todo", F.array_sort(spans).alias("spans"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """Rows to append to the ledger after scan()."""
    return scanned.select("blob_id", F.explode("todo").alias("rule_key"))


def findings(scanned: DataFrame) -> DataFrame:
    """One row for each span: blob_id, kind, start, end, rule_key."""
    return scanned.select("blob_id", F.explode("spans").alias("s")).select("blob_id", "s.kind", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.rule_key")


class Ledger:
    """A table of scanned blobs in a shared folder: blob_id, todo (rule keys of one delivery) and spans, one Parquet folder for each
    delivery, under its name. The folder outlives this object: whoever opens it finds all finished deliveries, those whose write has
    ended (Spark's _SUCCESS). A delivery is scanned against all finished others, so one that broke off, or is delivered again
    under its name, takes its own folder anew and nothing of the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def deliveries(self) -> list[str]:
        """Names of the finished deliveries, sorted."""
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(self.path))]
        return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith("delivery=") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def _folder(self, name: str) -> str:
        return f"{self.path}/delivery={quote(name, safe='')}"

    def rows(self, but: str | None = None) -> DataFrame | None:
        """All scanned blobs so far, one row for each delivery that had a blob to do; but: a delivery to leave out."""
        folders = [self._folder(n) for n in self.deliveries() if n != but]
        return self.spark.read.parquet(*folders).select("blob_id", "todo", "spans") if folders else None

    def add(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str | None = None) -> str:
        """Scan what is unseen of a delivery of versions, and write it down under its name (without one: the next number). Returns the name."""
        if name is None:
            numbers = [int(n) for n in self.deliveries() if n.isdigit()]
            name = f"{max(numbers, default=-1) + 1:06d}"
        before = self.rows(name)
        scan(versions, text, rules, None if before is None else ledger_rows(before)).write.mode("overwrite").parquet(self._folder(name))
        return name


def locate(versions: DataFrame, scanned: DataFrame, text: str = "text", out: str = "_spans") -> DataFrame:
    """All versions with their columns, and in `out` (which replaces a column of that name) the spans of their blob, an empty array if it has none."""
    kept = [c for c in versions.columns if c.lower() != out.lower()]
    # the row travels as a struct, so its columns may have any names
    rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("_row"))
    spread = F.xxhash64(*[F.col("_row").getField(c) for c in versions.columns if c != text]) if len(versions.columns) > 1 else F.lit(0)
    found = _joined(rows.withColumn("_address", address(F.col("_row").getField(text))), scanned, spread)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("spans").alias(out))


def _joined(addressed: DataFrame, scanned: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """Rows with _address, and the spans of the blob. Rows of one blob are dealt over salts by `spread`; blobs with findings, which
    are few, stand once for each salt, so the copies of one blob are in several tasks. A blob scanned by several deliveries has the
    spans of all of them."""
    hits = scanned.where(F.size("spans") > 0).groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = hits.select(F.col("blob_id").alias("_blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_hit_salt"))
    rows = addressed.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    out = rows.join(hits, (F.col("_address") == F.col("_blob")) & (F.col("_salt") == F.col("_hit_salt")), "left")
    return out.withColumn("spans", F.coalesce("spans", _none())).drop("_blob", "_salt", "_hit_salt")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of covered characters replaced by a mark; spans in order of their starts. The text is cut into pieces
    once, so that what stands between spans is taken from a piece and not from the start of a long text."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    covered = F.concat(F.array(F.lit(0)), _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))

    def between(cut: Column, a: Column, b: Column) -> Column:
        """Code points a to b, a < b."""
        first, last = (a / PIECE).cast("int"), ((b - 1) / PIECE).cast("int")
        piece = lambda k: F.element_at(cut, k + 1)
        several = F.concat(F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(cut, first + 2, last - first - 1), ""), F.substring(piece(last), F.lit(1), b - last * PIECE))
        return F.when(a >= b, F.lit("")).when(first == last, F.substring(piece(first), a % PIECE + 1, b - a)).otherwise(several)

    def whole(own: Column) -> Column:
        cut, covered = own["cut"], own["covered"]  # covered: where the spans before each one end
        parts = F.zip_with(own["spans"], F.slice(covered, F.lit(1), F.size(own["spans"])), lambda s, at: F.when(s["start"] >= at, F.concat(between(cut, at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(cut, F.element_at(covered, -1), own["chars"]))

    done = _let(F.struct(pieces.alias("cut"), covered.alias("covered"), spans.alias("spans"), F.length(text).alias("chars")), whole)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the spans of the findings replaced in the text and, if there is one, its length set anew."""
    spans = "spans"
    while spans in (c.lower() for c in docs.columns):
        spans += "_"
    out, own = locate(docs, scan(docs, text), text, spans), F.col(f"`{text}`")
    out = out.withColumn(text, F.when(own.isNotNull(), redact(own, F.col(spans), mark)))
    if chars in docs.columns:
        out = out.withColumn(chars, F.length(own).cast(docs.schema[chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Deliveries in which the query hands the documents to the ledger.
DELIVERIES = 2


def secrets_query(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts by base kind, digest of base spans, all spans.

    The documents come to the ledger in deliveries, as the history of a repository does; what an earlier one had is not scanned again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    for k in range(DELIVERIES):
        ledger.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES)) == k))
    # only the address goes through the join; the text stays with the scan
    paths = docs.select("doc_id", address(F.col("text")).alias("_address"))
    out = _joined(paths, ledger.rows(), F.xxhash64("doc_id"))
    base = [r.kind for r in BASE_RULES]
    return out.select(
        "doc_id",
        *[F.size(_of_kinds([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(digest(_of_kinds(base)), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
