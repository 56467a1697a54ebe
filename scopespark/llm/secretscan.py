"""Secret scan with corpus-wide ownership of candidate values, in DataFrame functions only.

Three kinds are matched by pattern wherever they stand (``assign``, ``access``, ``hex``).  Beyond
them every long token that mixes letters and digits is a candidate.  The value of every match and of every
candidate is hashed, and over the whole corpus the distinct repositories (documents) and owners (sources)
of each hash are counted, wherever it stands.  A value that many owners or many repositories carry is a
widely copied example; a candidate that stays with few of both looks live, and its occurrences are reported
as kind ``owned`` where no other match covers them.  Every span tells its value's owners and repositories.

Positions are code points, end exclusive.  Null or empty text has no spans; a null owner counts as
one owner and null ids as one repository; rows with null or repeated ids are scanned like any other row;
texts of any length are scanned whole; other columns are not read.  Matches of one document
are held together in that document's row, never across documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.session import spool

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "owned")


@dataclass(frozen=True)
class Pattern:
    """A kind's pattern, the group that holds the value, its least length, and a cheap necessary test."""

    kind: str
    regex: str
    group: int
    least: int
    hint: str


# The patterns of the three base kinds.  Runs of access and hex characters are maximal,
# so a least length in the pattern finds what dropping shorter matches would leave.
BASE = (
    Pattern("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)passw|secret|token|api_?key"),
    Pattern("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA"),
    Pattern("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
#: Candidates besides the base kinds: long tokens, of which those with few letters or digits are dropped.
TOKEN = Pattern("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20, r"[A-Za-z0-9+/_-]{20}")
LEAST_DIGITS = LEAST_LETTERS = 4
#: A value with more owners or more repositories than this is a widely copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 10

_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def find(text: Column, p: Pattern) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind, end, value>>.

    The text between matches and the matches themselves alternate, so that running lengths give positions.
    """
    gaps = F.split(text, p.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)) if p.group else whole
    parts = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(p.kind)).alias("kind"), (begin + x["len"]).alias("end"), x["value"].alias("value"))
        keep = F.when(F.length(x["value"]) >= p.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + x["len"]).alias("at"), keep.alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(p.hint), spans).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _mixed(value: Column) -> Column:
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= LEAST_DIGITS) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= LEAST_LETTERS)


def ownership(candidates: DataFrame, key: str = "hash", repository: str = "repository", owner: str = "owner") -> DataFrame:
    """Distinct repositories and owners of each candidate hash; partial aggregates absorb hot values."""
    owners = candidates.groupBy(key, owner).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("one").alias("n_owners"))
    repos = candidates.groupBy(key, repository).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("one").alias("n_repositories"))
    return owners.join(repos, key)


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(row, doc, base, spans): per row of ``docs`` the base spans and all spans, sorted by start and kind.

    Each of ``spans`` is struct<start, kind, end, hash, n_owners, n_repositories>; ``row`` numbers the rows, so
    repeated ids stay apart.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc).alias("doc"),
        F.col(owner).alias("owner"),
        F.array_sort(F.concat(*[hashed(find(t, p)) for p in BASE])).alias("base"),
        hashed(F.filter(find(t, TOKEN), lambda s: _mixed(s["value"]))).alias("tokens"),
    )
    found = spool(found, "secrets")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    marked = lambda spans, mark: F.transform(spans, lambda s: F.struct(s.alias("span"), mark(s).alias("free")))
    all_ = F.concat(marked("base", lambda s: s["start"] >= 0), marked("tokens", free))
    each = found.select("row", F.col("doc").alias("repository"), "owner", F.explode(all_).alias("m")).select("row", "repository", "owner", "m.free", "m.span.*")
    reported = (F.col("kind") < KINDS.index("owned")) | ((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))
    told = each.where("free").join(ownership(each), "hash").where(reported)
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repositories"))).alias("spans"))
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:string,n_owners:bigint,n_repositories:bigint>>)")
    return found.join(told, "row", "left").select("row", "doc", "base", F.coalesce("spans", nothing).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spread(spans: Column) -> Column:
    """owners:repositories of each span's value, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["n_owners"].cast("string"), s["n_repositories"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans replaced by ``mask``; spans sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,to:int>>)").alias("keep"))

    def step(acc: Column, s: Column) -> Column:
        apart = (s["start"] > acc["at"]) | (F.size(acc["keep"]) == 0)
        keep = F.when(apart, F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("at"), s["start"].alias("to"))))).otherwise(acc["keep"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), keep.alias("keep"))

    kept = F.aggregate(spans, start, step, lambda acc: F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("at"), F.length(text).alias("to")))))
    pieces = F.transform(kept, lambda k: F.substring(text, k["at"] + 1, F.greatest(k["to"] - k["at"], F.lit(0))))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mask)).otherwise(text)


def _sql_find(p: Pattern, text: str) -> str:
    regex = p.regex.replace("'", "''")
    return f"""list_filter(list_transform(regexp_extract_all({text}, '{regex}', 0), lambda m, i: struct_pack(
        start := list_sum(list_transform(string_split_regex({text}, '{regex}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{regex}', 0)[1:i - 1], lambda g: length(g))), 0),
        kind := {KINDS.index(p.kind)}, size := length(m), value := regexp_extract_all({text}, '{regex}', {p.group})[i])), lambda s: length(s.value) >= {p.least})"""


def sql(most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> str:
    """DuckDB SQL of the registered query."""
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    join = lambda c: f"array_to_string(list_transform({c}, lambda s: {kinds}[s.kind + 1] || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.size AS BIGINT)), ',')"
    count = lambda k: f"CAST(len(list_filter(base, lambda s: s.kind = {KINDS.index(k)})) AS BIGINT)"
    return f"""
    WITH found AS (
      SELECT row_number() OVER () AS rid, doc_id, source,
        list_sort(list_concat(list_concat({_sql_find(BASE[0], "coalesce(text, '')")}, {_sql_find(BASE[1], "coalesce(text, '')")}), {_sql_find(BASE[2], "coalesce(text, '')")})) AS base,
        list_filter({_sql_find(TOKEN, "coalesce(text, '')")}, lambda s: length(regexp_replace(s.value, '[^0-9]', '', 'g')) >= {LEAST_DIGITS} AND length(regexp_replace(s.value, '[^A-Za-z]', '', 'g')) >= {LEAST_LETTERS}) AS tokens
      FROM documents),
    marked AS (SELECT rid, doc_id, source, unnest(list_concat(list_transform(base, lambda b: struct_pack(span := b, free := true)),
      list_transform(tokens, lambda t: struct_pack(span := t, free := len(list_filter(base, lambda b: b.start < t.start + t.size AND t.start < b.start + b.size)) = 0)))) AS m FROM found),
    own AS (SELECT m.span.value AS v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(doc_id, -1)) AS repositories FROM marked GROUP BY 1),
    told AS (SELECT rid, list(struct_pack(start := m.span.start, kind := m.span.kind, size := m.span.size, owners := owners, repositories := repositories) ORDER BY m.span.start, m.span.kind) AS spans
      FROM marked JOIN own ON m.span.value = v
      WHERE m.free AND (m.span.kind < {KINDS.index("owned")} OR (owners <= {most_owners} AND repositories <= {most_repositories})) GROUP BY rid),
    merged AS (SELECT doc_id, base, coalesce(spans, []) AS spans FROM found LEFT JOIN told USING (rid))
    SELECT doc_id, {count("assign")} AS n_assign, {count("access")} AS n_access, {count("hex")} AS n_hex,
      sha256({join("base")}) AS base_sha256, {join("spans")} AS spans,
      CAST(len(spans) - len(base) AS BIGINT) AS n_owned,
      array_to_string(list_transform(spans, lambda s: s.owners || ':' || s.repositories), ',') AS ownership
    FROM merged"""
