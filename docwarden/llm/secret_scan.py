"""Secret scan with multipart credential linking, in DataFrame operations only.

Base spans are matches that are secrets by their form. Weak candidates (a login name, a short or
unlabelled secret, an endpoint) mean nothing alone. They are parts of a credential: all parts of a text,
base spans included, are joined with the parts that start at most ``SCOPE`` code points away (an interval
join, as a range frame over the sorted parts of one text), and a weak candidate is reported only where
its complements occur: an identifier beside a secret, a secret beside an identifier, an endpoint beside
both.

Positions come from the texts between matches: a match starts after all gaps and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200


def _any_case(words: str) -> str:
    """ASCII letters of either case, without the regular expression engine's own ideas of case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (role, pattern, group whose length is tested, least length). Kinds in order of the digest; the
#: first three are fixed by contract.
KINDS = {
    "assign": ("secret", f"({_any_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("identifier", "(AKIA[A-Z0-9]+)", 1, 18),
    "hex": ("secret", "([0-9a-f]+)", 1, 16),
    "identifier": ("identifier", f"({_any_case('user_?name|login|client_?id|account_?id|access_?key_?id')}){_ASSIGNED}([A-Za-z0-9@._+-]+)", 2, 3),
    "secret": ("secret", f"({_any_case('pwd|passphrase|credential|auth')}){_ASSIGNED}([A-Za-z0-9+/_.=!@#$%^&*-]+)", 2, 6),
    "blob": ("secret", "([A-Za-z0-9+/]+)", 1, 20),
    "endpoint": ("endpoint", r"(https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/?&=%-]*)?)", 1, 8),
}
BASE = ("assign", "access", "hex")
#: Texts that match none of these have no span: base kinds, and identifiers, without which nothing weak is reported.
GATE = "|".join([KINDS["assign"][1], "AKIA[A-Z0-9]{14}", "[0-9a-f]{16}", KINDS["identifier"][1]])


def _pieces(text: Column, kind: str) -> Column:
    """Per match of a kind: length of the gap before it, its own length, and whether it counts."""
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    counts = lambda v: F.length(v) >= least
    if kind == "blob":  # a mixture only
        counts = lambda v: (F.length(v) >= least) & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), tested.alias("tested"))
    return F.transform(zipped, lambda p: F.struct(
        F.lit(list(KINDS).index(kind)).alias("kind"), F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("size"), counts(p["tested"]).alias("counts")))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, start, end, reported) of all parts in texts that may hold a span. Rows
    that are equal in id and text are one. ``kind`` is a place in ``KINDS``."""
    likely = docs.select("doc_id", "text").filter(F.col("text").rlike(GATE)).withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    parts = F.array(*[_pieces(F.col("text"), kind) for kind in KINDS])
    rows = likely.select("doc_id", "text_key", F.explode(parts).alias("of_kind")).select("doc_id", "text_key", F.posexplode("of_kind").alias("place", "part"))
    upto = Window.partitionBy("doc_id", "text_key", "part.kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(
        "doc_id", "text_key", F.col("part.kind").alias("kind"), F.col("part.counts").alias("counts"), "part.size",
        F.sum(F.col("part.gap") + F.col("part.size")).over(upto).alias("end"),
    ).filter("counts").select("doc_id", "text_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    roles = F.array(*[F.lit(role) for role, *_ in KINDS.values()])
    near = Window.partitionBy("doc_id", "text_key").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    has = lambda role: F.max(F.col("role") == role).over(near)
    return (
        placed.withColumn("role", F.element_at(roles, F.col("kind") + 1))
        .withColumns({"identifiers": has("identifier"), "secrets": has("secret")})
        .withColumn("reported", F.expr(
            f"kind < {len(BASE)} or case role when 'identifier' then secrets when 'secret' then identifiers else identifiers and secrets end"))
        .select("doc_id", "text_key", "kind", "start", "end", "reported")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _gathered(docs: DataFrame) -> DataFrame:
    spans = found_spans(docs).filter("reported")
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    return spans.groupBy("doc_id", "text_key").agg(ordered.alias("spans"))


def _with_spans(docs: DataFrame) -> DataFrame:
    """(given, spans): the rows of ``docs`` as structs, which keeps their names apart, and their spans."""
    found = _gathered(docs)
    keyed = docs.select(F.struct("*").alias("given"), F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_key"))
    return keyed.join(found, F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_key") == F.col("text_key")), "left").select("given", "spans")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): counts of base spans, their
    digest, and all reported spans as ``kind:start:end`` (code points, end exclusive) in order. A null or
    empty text has none. Repeated rows give repeated results."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    found = _with_spans(docs.select("doc_id", "text")).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "given.doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span, overlapping ones as one, replaced by ``mark`` in the text. All
    columns and rows stay."""
    text = F.col("given.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))
    def step(acc, s):
        fresh = s["start"] >= acc["upto"]
        cut = F.substring(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], cut, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    done = F.aggregate("spans", start, step)
    clean = F.concat(done["out"], F.substring(text, (done["upto"] + 1).cast("int"), F.length(text)))
    return _with_spans(docs).withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text)).select(
        *[F.col("clean" if c == "text" else f"given.`{c}`").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """The same rows in DuckDB SQL over ``documents`` (doc_id unique)."""
    parts = " union all ".join(
        f"""select doc_id, {k} as kind, '{role}' as role, unnest(string_split_regex(text, '{p}')) as gap,
        unnest(list_append(regexp_extract_all(text, '{p}', 0), '')) as whole, unnest(list_append(regexp_extract_all(text, '{p}', {g}), '')) as tested,
        unnest(range(len(regexp_extract_all(text, '{p}', 0)) + 1)) as place, {least} as least from likely"""
        for k, (role, p, g, least) in enumerate((r, p.replace("'", "''"), g, n) for r, p, g, n in KINDS.values())
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    blob = list(KINDS).index("blob")
    return f"""
with likely as (select doc_id, text from documents where regexp_matches(text, '{GATE.replace("'", "''")}')),
parts as ({parts}),
placed as (
  select doc_id, kind, role, whole, tested, least,
         sum(length(gap) + length(whole)) over (partition by doc_id, kind order by place rows unbounded preceding) as e
  from parts),
spans as (
  select doc_id, kind, role, e - length(whole) as s, e from placed
  where length(tested) >= least and (kind <> {blob} or (regexp_matches(tested, '[0-9]') and regexp_matches(tested, '[A-Z]') and regexp_matches(tested, '[a-z]')))),
near as (
  select *, bool_or(role = 'identifier') over w as identifiers, bool_or(role = 'secret') over w as secrets from spans
  window w as (partition by doc_id order by s range between {SCOPE} preceding and {SCOPE} following)),
kept as (
  select *, [{names}][kind + 1] || ':' || s::bigint || ':' || e::bigint as label from near
  where kind < {len(BASE)} or case role when 'identifier' then secrets when 'secret' then identifiers else identifiers and secrets end),
per_doc as (
  select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
         string_agg(label, ',' order by s, kind, e) filter (kind < {len(BASE)}) as base, string_agg(label, ',' order by s, kind, e) as spans
  from kept group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc p on d.doc_id = p.doc_id"""
