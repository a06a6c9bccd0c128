"""Secret scans: an incremental ledger of content-addressed blobs, scanned once per rule version."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import join_classes, saved, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern; matches are leftmost and do not overlap.

    ``hint``: a substring without which the pattern cannot match. A match counts if its group
    ``group`` has at least ``least`` characters.
    """

    kind: str
    pattern: str
    hint: str | None = None
    group: int = 0
    least: int = 0


#: The base kinds in their listed order. The greedy runs of access and hex give the
#: same matches with the least length inside the pattern, as a run has one match.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds that this scanner adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", hint="eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}={0,2}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", hint="://"),
)
RULES = BASE + MORE
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,rank:int>>"
#: Values in a block of ``running``; blocks are summed up by themselves.
_BLOCK = 64
#: Code points in a piece of a text that ``redacted`` cuts from.
_PIECE = 2048


def rule_version(rules: tuple[Rule, ...]) -> str:
    """The rules' own digest: other rules, or the same in another order, are another version."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda a plain expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join, start: int = 0) -> Column:
    """For each element the join (sum, maximum) of ``start`` and all before it.

    Two levels, blocks and the values inside a block, so that the time is nearly linear. ``values``
    must be a column or a lambda's variable, as it is used for each element.
    """
    zero = F.lit(start).cast("bigint")
    fold = lambda a: F.aggregate(a, zero, join)
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    of_blocks = F.transform(upto(F.ceil(F.size(values) / _BLOCK).cast("int")), lambda b: fold(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))

    def at(before):
        return F.transform(values, lambda _, i: join(F.get(before, F.floor(i / _BLOCK).cast("int")), fold(F.slice(values, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return bound(of_blocks, lambda s: bound(F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))), at))


def rule_lengths(text: Column, rule: Rule, rank: int) -> Column:
    """Lengths in code points of what lies between one rule's matches, of the matches, and of the group that counts.

    Null without a match, which one ``rlike`` settles.
    """
    pattern = F.lit(rule.pattern)
    long = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    whole = long(F.regexp_extract_all(text, pattern, F.lit(0)))
    held = long(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    may = text.rlike(rule.pattern)
    if rule.hint:
        may = text.contains(rule.hint) & may
    return F.when(may, F.struct(long(F.split(text, rule.pattern, -1)).alias("g"), whole.alias("n"), held.alias("h"), F.lit(rule.least).alias("least"), F.lit(rank).alias("rank")))


def _spans_of(m: Column) -> Column:
    """(start, rank, end) of the matches of one rule that count: lengths add up to positions."""
    gaps, lens = m["g"], m["n"]
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lens)), lens, lambda g, n: g + n)

    def span(before, i):
        start = before + F.get(gaps, i)
        return F.when(F.get(m["h"], i) >= m["least"], F.struct(start.alias("start"), m["rank"].alias("rank"), (start + F.get(lens, i)).alias("end")))

    return F.array_compact(F.transform(bound(steps, lambda v: running(v, lambda a, b: a + b)), span))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules in code points, end exclusive, by start, then by the rules' order, then by end."""
    found = F.array_compact(F.array(*(rule_lengths(text, r, k) for k, r in enumerate(rules))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    whole = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(kinds, x["rank"]).alias("kind"), x["rank"].alias("rank"))
    return F.transform(F.array_sort(F.flatten(F.transform(found, _spans_of))), whole)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"blob string, version string, spans {_SPAN}").parquet(path)


def _blobs(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(blob, _path) of every row: the SHA-256 of the text's UTF-8 bytes, null texts as empty ones."""
    return versions.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("blob"), F.col(path_col).alias("_path"))


def count_blobs(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, _least, copies): the smallest path and the number of rows of each text, written to the shared folder."""
    return saved(_blobs(versions, path_col, text_col).groupBy("blob").agg(F.min("_path").alias("_least"), F.count("*").alias("copies")))


def scan_new(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    path_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    version: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Findings (blob, version, spans) of the blobs in ``versions`` that ``ledger`` lacks.

    ``versions`` holds every historical text of every path, one row each. A blob is the SHA-256 of
    a text's UTF-8 bytes. Copies are found from (blob, path) alone; then one row of each unseen
    blob, that of the smallest path, takes its text to the scan. The join goes by blob and path
    together, so the thousands of copies of one text do not meet in one task. The version is by
    default that of the rules' own text.
    """
    version = version or rule_version(rules)
    unseen = counted if counted is not None else count_blobs(versions, path_col, text_col)
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    one = unseen.select(F.col("blob").alias("_b"), "_least")
    rows = versions.select(F.col(path_col).alias("_path"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(F.sha2(F.col("_text").cast("binary"), 256).alias("blob"), "_path", "_text")
    picked = rows.join(one, (F.col("blob") == F.col("_b")) & F.col("_path").eqNullSafe(F.col("_least")), "left_semi")
    # no filter on the findings here: it would be pushed below the join, and every copy scanned
    found = picked.select("blob", F.lit(version).alias("version"), find_spans(F.col("_text"), rules).alias("spans"))
    return found.dropDuplicates(["blob", "version"])


def findings(ledger: DataFrame, version: str | None = None) -> DataFrame:
    """(blob, spans) of the blobs with findings under a rule version."""
    return ledger.where((F.col("version") == (version or rule_version(RULES))) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")


def joined_findings(
    versions: DataFrame,
    ledger_path: str | None = None,
    path_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    version: str | None = None,
    keep: str | None = None,
) -> DataFrame:
    """(blob, spans) for every row, with its path or, by ``keep``, with another column of it: what ``scan`` does."""
    spark = versions.sparkSession
    version = version or rule_version(rules)
    ledger = None
    if ledger_path:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            ledger = read_ledger(spark, ledger_path)
    ledger_path = ledger_path or shared_dir(spark)
    counted = count_blobs(versions, path_col, text_col)
    scan_new(versions, ledger, path_col, text_col, rules, version, counted).write.mode("append").parquet(ledger_path)
    # every blob, not only those with findings: one of very many paths is to go by broadcast in either case
    found = counted.join(findings(read_ledger(spark, ledger_path), version), "blob", "left").select("blob", "copies", "spans")
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("blob")
    paths = versions.select(F.col(keep or path_col), blob)
    out = join_classes(paths, found, ["blob"], "copies", versions.count())
    return out.select(keep or path_col, "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def scan(
    versions: DataFrame,
    ledger_path: str | None = None,
    path_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    version: str | None = None,
) -> DataFrame:
    """One row for each row of ``versions``: path, blob, spans.

    The ledger is a Parquet table that grows by append: a blob and rule version already entered
    are not scanned again, in this run or a later one, and a failed run leaves earlier entries.
    The version follows from the rules, so changed rules scan all blobs again. Without a path a new
    ledger is started in the shared folder. Findings are joined back to all paths by blob; a blob
    of very many paths is joined by broadcast.

    Null texts are empty. Texts of any length are scanned whole. Repeated rows each give a row; null
    paths are kept; spans of one start are ordered by rule, then end. An empty table gives none.
    Other columns are ignored.
    """
    return joined_findings(versions, ledger_path, path_col, text_col, rules, version)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (merged where they overlap) replaced by ``mark``; ``spans`` are ordered by start.

    The text is cut to pieces of ``_PIECE`` code points first, so that no cut walks through it all.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def cut(at, start, end):
        """Code points start to end, from the pieces between."""
        a, b = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
        off, rest = (start % _PIECE).cast("int"), (end % _PIECE).cast("int")
        head = F.coalesce(F.get(at, a), F.lit(""))
        inner = F.array_join(F.slice(at, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        tail = F.substr(F.coalesce(F.get(at, b), F.lit("")), F.lit(1), rest)
        return F.when(a == b, F.substr(head, off + 1, rest - off)).otherwise(F.concat(F.substr(head, off + 1), inner, tail))

    def build(m):
        at, ends = m["p"], F.transform(m["s"], lambda x: x["end"])
        before = bound(ends, lambda v: running(v, lambda a, b: F.greatest(a, b)))

        def part(start, i):
            first = F.get(m["s"], i)["start"]
            return F.when(first >= start, F.concat(cut(at, start, first), F.lit(mark)))

        last = F.coalesce(F.array_max(ends), F.lit(0).cast("bigint"))
        return F.concat(F.array_join(F.array_compact(F.transform(before, part)), ""), cut(at, last, F.length(text).cast("bigint")))

    return bound(F.struct(pieces.alias("p"), spans.alias("s")), build)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Positions from the lengths of what lies between the matches, rule by rule."""
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS rank, '{x.kind}' AS kind, {x.least} AS least, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p, 0) AS found, regexp_extract_all(t, p, {x.group}) AS held FROM (SELECT r, t, '{x.pattern.replace(chr(39), chr(39) * 2)}' AS p FROM d) WHERE regexp_matches(t, p)"
        for k, x in enumerate(RULES)
    )
    size = lambda what: f"coalesce(list_sum(list_transform({what}, lambda x: length(x))), 0)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listing = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
x AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT r, rank, kind, ({size("gaps[1:i]")} + {size("found[1:i - 1]")})::BIGINT AS a, length(found[i]) AS n FROM x WHERE length(held[i]) >= least),
o AS (SELECT r, {counts}, {listing} FILTER (rank < {len(BASE)}) AS base, {listing} AS spans FROM (SELECT *, a + n AS b FROM s) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)
"""


OP10_SQL = _sql()
