"""Personal data by patterns, and unseen identifiers by bootstrapped contexts, in DataFrame functions only.

Four kinds are matched by pattern wherever they stand (``email``, ``ip``, ``card``, ``phone``).  Their matches are the
seeds of the bootstrap.  Texts are cut at the seeds, and the pieces into lexemes: words without white space, a label
such as ``ssn:`` apart from what follows it.  The lexical pattern of a place is the three lexemes before it, or the two before
it where the last is a label, digits read as zeros; what stands there is its instance.  Instances are the seeds and the candidates, lexemes made of letters
and digits with LEAST_DIGITS digits or more, compared without spaces, hyphens and brackets.

Patterns and instances form a graph whose edges carry how often they meet in the whole corpus.  Seeds are
trusted fully.  In each round a pattern's confidence is the trust of its instances, weighted by
occurrences, over all places in the corpus that the pattern stands before, ordinary words included; patterns
with CONFIDENT or more and SUPPORT trusted instances lend their instances KEEP of that confidence for the next
round.  All of it is whole thousandths, so that no order of summing changes a decision.  At the end every
candidate whose instance is trusted is reported as kind ``context``, wherever it stands.

Positions are code points, end exclusive.  Null or empty text has no spans; rows with null or repeated ids are
scanned like any other row, each for itself; equal texts add to the occurrences of an edge but not to its pattern's
number of instances; texts of any length are scanned whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.session import spool

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "context")
#: Least digits of a candidate.
LEAST_DIGITS = 5
#: Thousandths: least confidence of a pattern and least trust of an instance, what an instance keeps of a pattern's confidence.
CONFIDENT, KEEP = 500, 900
#: Least trusted instances of a pattern; rounds.
SUPPORT, ROUNDS = 3, 3

_SPAN = "struct<start:int,kind:int,end:int,value:string>"
_CANDIDATE = "struct<start:int,end:int,pattern:bigint,instance:bigint,seed:boolean>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _at_most_255(value: Column) -> Column:
    def small(part: Column) -> Column:
        rest = F.ltrim(part, F.lit("0"))
        return (F.length(rest) <= 3) & (F.coalesce(rest.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _luhn(value: Column) -> Column:
    def summed(digits: Column) -> Column:
        doubled = F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)])
        each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
        return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0

    digits = _digits(value)
    return F.when(F.length(digits).between(12, 19), summed(digits)).otherwise(False)


@dataclass(frozen=True)
class Pattern:
    """A kind's pattern, what its matches have to satisfy, a cheap necessary test, and the pattern as plainly written."""

    kind: str
    regex: str
    valid: Callable[[Column], Column]
    hint: str
    plain: str
    plain_valid: str


# The patterns of the four base kinds (``plain``).  ``regex`` finds the same matches in one pass: it
# starts only where a run of the first class begins or the last match ended, and gives nothing back.
BASE = (
    Pattern(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda v: F.lit(True),
        "@",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "true",
    ),
    Pattern(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _at_most_255,
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "len(list_filter(string_split(s.value, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
    ),
    Pattern(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        _luhn,
        r"[0-9](?:[\x20-]?[0-9]){11}",
        r"[0-9]([\x20-]?[0-9])+",
        """len(regexp_replace(s.value, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(s.value, '[^0-9]', '', 'g')), ''),
            lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END ELSE CAST(c AS INTEGER) END)) % 10 = 0""",
    ),
    Pattern(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: F.length(_digits(v)).between(9, 15),
        r"\+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "len(regexp_replace(s.value, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    ),
)

_GAP = r"\x20\x09-\x0D"
#: A label with its marks, or a word without any.
LEXEME = rf"[^{_GAP}:=#]*+[:=#]++|[^{_GAP}:=#]++"
#: A candidate inside a lexeme, and a cheap necessary test for a text.
CORE = r"^[^A-Za-z0-9]*([A-Za-z0-9](?:[A-Za-z0-9@._/+-]*[A-Za-z0-9])?)[^A-Za-z0-9]*\z"
_ENOUGH = rf"(?:[0-9][^0-9{_GAP}:=#]*+){{{LEAST_DIGITS}}}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
#: What ends a label; what stands before the first lexeme of a piece.
_LABEL, _EDGE = r"[:=#]\z", "^"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def find(text: Column, p: Pattern) -> Column:
    """The matches of ``p`` that are valid, as array<struct<start, kind, end, value>>.

    The text between matches and the matches themselves alternate, so that running lengths give positions.
    """
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def of(whole: Column) -> Column:
        parts = F.zip_with(F.slice(F.split(text, p.regex, -1), F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + F.length(x["value"])
            span = F.struct(begin.alias("start"), F.lit(KINDS.index(p.kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.when(p.valid(x["value"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return F.when(text.rlike(p.hint), _once(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), of)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Matches of the four kinds by start and kind."""
    return F.array_sort(F.concat(*[find(text, p) for p in BASE]))


def pieces(text: Column, base: Column) -> Column:
    """array<struct<at, text, seed>>: the text between base spans, and the span's value behind each piece but the last.

    A span that overlaps an earlier one cuts nothing.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<at:int,to:int,seed:string>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("at"), s["start"].alias("to"), s["value"].alias("seed"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    none = F.lit(None).cast("string")
    cuts = F.aggregate(base, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), F.length(text).alias("to"), none.alias("seed")))))
    cut = F.transform(cuts, lambda c: F.struct(c["at"].alias("at"), F.substring(text, c["at"] + 1, c["to"] - c["at"]).alias("text"), c["seed"].alias("seed")))
    return F.when(F.size(base) > 0, cut).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("text"), none.alias("seed"))))


def _flat(text: Column) -> Column:
    """Lower case with digits as zeros, as long as before."""
    return F.translate(text, _UPPER, _LOWER)


def _lexemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def _pattern(third: Column, second: Column, first: Column) -> Column:
    """Of the lexemes before a place, ``first`` the nearest."""
    return F.xxhash64(F.when(first.rlike(_LABEL), _EDGE).otherwise(third), second, first)


def _instance(value: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(value), r"[\x20()-]|^\+", ""))


def _candidates(piece: Column) -> Column:
    """The candidates of a piece and the seed behind it, each with its pattern and instance."""
    none = F.expr(f"cast(array() as array<{_CANDIDATE}>)")
    raw = piece["text"]
    start = F.struct(F.lit(0).alias("at"), *[F.lit(_EDGE).alias(c) for c in ("third", "second", "first")], none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        core = F.regexp_extract(x["raw"], CORE, 1)
        first = piece["at"] + begin + F.length(F.regexp_extract(x["raw"], "^[^A-Za-z0-9]*", 0))
        one = F.struct(first.alias("start"), (first + F.length(core)).alias("end"), _pattern(acc["third"], acc["second"], acc["first"]).alias("pattern"), _instance(core).alias("instance"), F.lit(False).alias("seed"))
        is_one = (F.length(x["raw"]) - F.length(F.replace(x["flat"], F.lit("0"), F.lit(""))) >= LEAST_DIGITS) & (F.length(core) > 0)
        return F.struct((begin + F.length(x["raw"])).alias("at"), acc["second"].alias("third"), acc["first"].alias("second"), x["flat"].alias("first"), F.when(is_one, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def listed(raws: Column) -> Column:
        with_gap = F.zip_with(F.slice(F.split(raw, LEXEME, -1), F.lit(1), F.size(raws)), raws, lambda g, r: F.struct(F.length(g).alias("gap"), r.alias("raw")))
        return F.zip_with(with_gap, _lexemes(_flat(raw)), lambda g, f: F.struct(g["gap"].alias("gap"), g["raw"].alias("raw"), f.alias("flat")))

    inside = F.when(raw.rlike(_ENOUGH), F.aggregate(_once(_lexemes(raw), listed), start, step, lambda acc: acc["out"])).otherwise(none)

    def behind(flat: Column) -> Column:
        last = [F.coalesce(F.try_element_at(flat, F.lit(-i)), F.lit(_EDGE)) for i in (3, 2, 1)]
        nowhere = F.lit(None).cast("int")
        return F.array(F.struct(nowhere.alias("start"), nowhere.alias("end"), _pattern(*last).alias("pattern"), _instance(piece["seed"]).alias("instance"), F.lit(True).alias("seed")))

    return F.concat(inside, F.when(piece["seed"].isNotNull(), _once(_lexemes(_flat(raw)), behind)).otherwise(none))


def places(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, places): how many places of the corpus each of ``patterns`` stands before."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.explode(pieces(t, base_spans(t))).alias("p"))
    flat = cut.select(_lexemes(_flat(F.col("p.text"))).alias("lex"), F.col("p.seed").isNotNull().cast("int").alias("more"))
    edge = F.lit(_EDGE)
    pairs = F.zip_with(F.concat(F.array(edge, edge, edge), "lex"), F.concat(F.array(edge, edge), "lex"), lambda third, second: F.struct(third.alias("third"), second.alias("second")))
    keys = F.zip_with(pairs, F.concat(F.array(edge), "lex"), lambda p, first: _pattern(p["third"], p["second"], first))
    each = flat.select(F.explode(F.slice(keys, F.lit(1), F.size("lex") + F.col("more"))).alias("pattern"))
    return each.join(patterns.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((pattern, confidence), (instance, trust)) from edges (pattern, instance, n, seed, places).

    Both are in thousandths; an instance that no confident pattern holds and no seed names has trust 0.
    """
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("long") * 1000).alias("own"))
    trust, scored = seeds.select("instance", F.col("own").alias("trust")), None
    for _ in range(rounds):
        met = edges.join(trust, "instance").groupBy("pattern").agg(
            F.floor(F.sum(F.col("n") * F.col("trust")) / F.max("places")).alias("confidence"),
            F.count_if(F.col("trust") >= CONFIDENT).alias("support"),
        )
        scored = spool(met.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern", "confidence"), "patterns")
        lent = edges.join(scored, "pattern").groupBy("instance").agg(F.floor(F.max("confidence") * KEEP / 1000).alias("lent"))
        trust = spool(seeds.join(lent, "instance", "left").select("instance", F.greatest("own", F.coalesce("lent", F.lit(0))).alias("trust")), "trust")
    return scored, trust


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, base, spans): per row of ``docs`` the base spans and all spans, by start and kind.

    Each of ``spans`` is struct<start, kind, end, trust>; ``row`` numbers the rows, so repeated ids stay apart.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), t.alias("text"), base_spans(t).alias("base"))
    listed = F.flatten(F.transform(pieces(F.col("text"), F.col("base")), _candidates))
    found = spool(cut.select("row", "doc", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), listed.alias("candidates")), "private")
    each = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    edges = spool(each.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    patterns = spool(edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT), "patterns")
    weighed = spool(edges.join(places(docs, patterns, text), "pattern"), "weighed")
    _, trust = bootstrap(weighed)
    # a seed's instance counts wherever it stands, confident pattern or not
    own = edges.where("seed").select("instance").distinct().withColumn("trust", F.lit(1000).cast("long"))
    trusted = trust.where(F.col("trust") >= CONFIDENT).union(own).groupBy("instance").agg(F.max("trust").alias("trust"))
    told = each.where(~F.col("seed")).join(trusted, "instance").groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end", "trust")).alias("more"))
    full = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(1000).cast("long").alias("trust")))
    return found.join(told, "row", "left").select("row", "doc", "base", F.when(F.col("more").isNull(), full).otherwise(F.array_sort(F.concat(full, F.col("more")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _sql_find(p: Pattern) -> str:
    regex = p.plain
    starts = f"list_sum(list_transform(string_split_regex(t, '{regex}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{regex}', 0)[1:i - 1], lambda g: length(g))), 0)"
    return f"""list_filter(list_transform(regexp_extract_all(t, '{regex}', 0), lambda m, i: struct_pack(start := CAST({starts} AS BIGINT), kind := {KINDS.index(p.kind)}, stop := CAST({starts} + length(m) AS BIGINT), value := m)), lambda s: {p.plain_valid})"""


def sql() -> str:
    """DuckDB SQL of the registered query."""
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    join = lambda c: f"array_to_string(list_transform({c}, lambda s: {kinds}[s.kind + 1] || ':' || s.start || ':' || s.stop), ',')"
    count = lambda k: f"CAST(len(list_filter(base, lambda s: s.kind = {KINDS.index(k)})) AS BIGINT)"
    lexeme = LEXEME.replace("++", "+").replace("*+", "*")
    instance = lambda v: f"regexp_replace(lower({v}), '[\\x20()-]|^\\+', '', 'g')"
    before = lambda k: f"coalesce(CASE WHEN i > {k} THEN flats[i - {k}] END, '{_EDGE}')"
    steps = []
    for r in range(ROUNDS):
        held = "seeds" if r == 0 else f"trust{r - 1}"
        steps.append(f"""scored{r} AS (SELECT w.pattern, CAST(sum(n * trust) // max(places) AS BIGINT) AS confidence FROM weighed w JOIN {held} USING (instance) GROUP BY 1
            HAVING sum(n * trust) // max(places) >= {CONFIDENT} AND count(*) FILTER (trust >= {CONFIDENT}) >= {SUPPORT}),
          trust{r} AS (SELECT instance, greatest(any_value(s.trust), coalesce(max(c.confidence * {KEEP} // 1000), 0)) AS trust FROM seeds s JOIN weighed USING (instance) LEFT JOIN scored{r} c USING (pattern) GROUP BY 1)""")
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    found AS (SELECT rid, doc_id, t, list_sort(list_concat(list_concat({_sql_find(BASE[0])}, {_sql_find(BASE[1])}), list_concat({_sql_find(BASE[2])}, {_sql_find(BASE[3])}))) AS base FROM texts),
    covers AS (SELECT rid, t, CASE WHEN len(base) = 0 THEN [] ELSE list_reduce(list_transform(base, lambda b: [b]), lambda acc, x: CASE WHEN x[1].start >= acc[-1].stop THEN list_concat(acc, x) ELSE acc END) END AS base FROM found),
    cut AS (SELECT rid, t, base, unnest(range(1, len(base) + 2)) AS k FROM covers),
    pieces AS (SELECT rid, k, CASE WHEN k = 1 THEN 0 ELSE base[k - 1].stop END AS origin, base[k].value AS seed,
      CASE WHEN len(base) = 0 THEN t ELSE substr(t, CAST(CASE WHEN k = 1 THEN 0 ELSE base[k - 1].stop END AS BIGINT) + 1, CAST(CASE WHEN k > len(base) THEN length(t) ELSE base[k].start END - CASE WHEN k = 1 THEN 0 ELSE base[k - 1].stop END AS BIGINT)) END AS piece FROM cut),
    lexed AS (SELECT rid, k, origin, seed, regexp_extract_all(piece, '{lexeme}', 0) AS raws, string_split_regex(piece, '{lexeme}') AS gaps, regexp_extract_all(translate(piece, '{_UPPER}', '{_LOWER}'), '{lexeme}', 0) AS flats FROM pieces),
    slots AS (SELECT rid, k, origin, seed, unnest(range(1, len(raws) + CASE WHEN seed IS NULL THEN 1 ELSE 2 END)) AS i, raws, gaps, flats FROM lexed),
    placed AS (SELECT rid, origin, i, i > len(raws) AS is_seed, seed, raws, gaps, raws[i] AS raw, {before(1)} AS first, {before(2)} AS second, {before(3)} AS third FROM slots),
    tested AS (SELECT *, CASE WHEN regexp_matches(first, '{_LABEL}') THEN '{_EDGE}' ELSE third END || ' ' || second || ' ' || first AS pattern, CASE WHEN is_seed THEN '' ELSE regexp_extract(raw, '{CORE}', 1) END AS core FROM placed),
    each AS (SELECT rid, pattern, is_seed, CASE WHEN is_seed THEN {instance("seed")} ELSE {instance("core")} END AS instance, core,
        origin + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(raws[1:i - 1], lambda g: length(g))), 0) + coalesce(length(regexp_extract(raw, '^[^A-Za-z0-9]*', 0)), 0) AS start
      FROM tested WHERE is_seed OR (core <> '' AND length(regexp_replace(raw, '[^0-9]', '', 'g')) >= {LEAST_DIGITS})),
    edges AS (SELECT pattern, instance, count(*) AS n, bool_or(is_seed) AS seed FROM each GROUP BY 1, 2),
    patterns AS (SELECT pattern FROM edges GROUP BY 1 HAVING count(*) >= {SUPPORT}),
    places AS (SELECT pattern, count(*) AS places FROM tested SEMI JOIN patterns USING (pattern) GROUP BY 1),
    weighed AS (SELECT e.*, places FROM edges e JOIN places USING (pattern)),
    seeds AS (SELECT instance, CASE WHEN bool_or(seed) THEN 1000 ELSE 0 END AS trust FROM weighed GROUP BY 1), {", ".join(steps)},
    trusted AS (SELECT instance FROM trust{ROUNDS - 1} WHERE trust >= {CONFIDENT} UNION SELECT instance FROM edges WHERE seed),
    more AS (SELECT rid, list(struct_pack(start := CAST(start AS BIGINT), kind := {KINDS.index("context")}, stop := CAST(start + length(core) AS BIGINT), value := '')) AS more FROM each SEMI JOIN trusted USING (instance) WHERE NOT is_seed GROUP BY 1),
    merged AS (SELECT doc_id, base, list_sort(list_concat(base, coalesce(more, []))) AS spans FROM found LEFT JOIN more USING (rid))
    SELECT doc_id, {", ".join(f"{count(k)} AS n_{k}" for k in KINDS[:4])}, sha256({join("base")}) AS base_sha256, {join("spans")} AS spans, CAST(len(spans) - len(base) AS BIGINT) AS n_context FROM merged"""
