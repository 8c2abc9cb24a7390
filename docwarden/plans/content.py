"""Queries over documents, vectors and conversations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.functions import text as X, validation as V, vectors
from docwarden.operators import answering, chunking as C, grounding as G, ingest as I, outcomes as O, retrieval as R, vector_index as VI
from docwarden.plans.registry import query
from docwarden.sources import files, snapshots
from docwarden.sources.stores import KeyedTable, append_batch, appended
from docwarden.sources.tables import new_folder
from docwarden.sources.derived import INGESTED_AT, derive, read, with_tables
from docwarden.functions.temporal import at

# Paragraphs of the given documents end at single line breaks.
LINES = r"\n+"
PIECE_CHARS = 500
# The given vectors are near-random, so the retrieval thresholds are set where each stage acts.
THRESHOLD, DEDUP = 0.2, 0.3

_WS = " || ".join(f"chr({c})" for c in X.WHITESPACE_CODES)
_WS_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in X.WHITESPACE_CODES) + "]"

_BLANK_LINE_SQL = rf"\n{_WS_CLASS}*\n+"


# --- files -------------------------------------------------------------------------

_NAMED = """
    select doc_id, n_chars, text,
        case doc_id % 7 when 0 then 'Report.PDF' when 1 then 'notes.docx' when 2 then 'plain.txt' when 3 then 'data.bin'
            when 4 then 'noext' when 5 then '.txt' else 'dir.v2/archive.tar.pdf' end as filename,
        case doc_id % 5 when 0 then 'application/pdf' when 1 then 'Text/Plain' when 2 then null when 3 then 'application/octet-stream'
            else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as content_type
    from {documents}"""
_KIND_SQL = """
    coalesce(case when ends_with(lower(filename), '.pdf') then 'pdf' when ends_with(lower(filename), '.docx') then 'docx'
                  when ends_with(lower(filename), '.txt') and filename <> '.txt' then 'txt' end,
             case when lower(content_type) = 'application/pdf' then 'pdf' when lower(content_type) = 'text/plain' then 'txt'
                  when lower(content_type) like '%wordprocessingml.document' then 'docx' end)"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NAMED, documents=read(spark, sf, "documents"))


_NAMED_DUCK = _NAMED.replace("{documents}", "documents")


@query("s1_file_kind", f"""
    with k as (select *, {_KIND_SQL} as kind from ({_NAMED_DUCK}))
    select doc_id, kind, case kind when 'pdf' then 'application/pdf' when 'txt' then 'text/plain'
        when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as canonical_type from k""")
def file_kinds(spark, sf):
    kind = files.file_kind(F.col("filename"), F.col("content_type"))
    return _named(spark, sf).select("doc_id", kind.alias("kind"), files.canonical_content_type(kind).alias("canonical_type"))


@query("s2_pdf_pages", """
    select doc_id, length(text) as n_chars, sha256(text) as text_hash from documents""")
def pdf_pages(spark, sf):
    """Documents cut into pages of ten lines and put together again."""
    lines = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(10))
    pages = F.transform(starts, lambda i: F.array_join(F.slice("lines", i, 10), "\n"))
    rows = lines.select("doc_id", F.posexplode_outer(pages).alias("page", "text"))
    joined = files.join_pages(rows, "doc_id")
    return joined.select("doc_id", F.length("text").cast("long").alias("n_chars"), X.content_hash(F.col("text")).alias("text_hash"))


@query("s3_decode_text", """
    select doc_id, length(text) + 1 as n_chars, sha256(text || chr(65533)) as text_hash from documents""")
def decode_text(spark, sf):
    """Every document with one stray byte at its end."""
    spoiled = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    text = files.decode_text(spoiled)
    return read(spark, sf, "documents").select("doc_id", F.length(text).cast("long").alias("n_chars"), X.content_hash(text).alias("text_hash"))


def _greedy_cte(source: str, keys: str, limit: int, separator: int) -> str:
    """Recursive grouping of ``source(keys, items)``: ``grouped(keys, i, grp)``."""
    fits = f"cur + {separator} + length(items[i + 1]) <= {limit}"
    return f"""
    walk AS (
        select {keys}, items, 1 as i, 0 as grp, length(items[1]) as cur from {source} where len(items) > 0
        union all
        select {keys}, items, i + 1, case when {fits} then grp else grp + 1 end,
            case when {fits} then cur + {separator} + length(items[i + 1]) else length(items[i + 1]) end
        from walk where i < len(items)
    )"""


_HEADED_SQL = f"""
    WITH RECURSIVE
    l AS (select conv_id, turn, trim(text, {_WS}) as t, role = 'user' as h from conversations),
    s AS (select *, sum(case when h then 1 else 0 end) over (partition by conv_id order by turn, t) as sec from l where t <> ''),
    sections AS (
        select conv_id, sec, max(t) filter (where h) as heading, list(t order by turn, t) filter (where not h) as items
        from s group by conv_id, sec having count(*) filter (where not h) > 0),
    {_greedy_cte('sections', 'conv_id, sec, heading', 1000, 2)},
    g AS (select conv_id, sec, heading, grp, string_agg(items[i], chr(10) || chr(10) order by i) as body
          from walk group by conv_id, sec, heading, grp),
    n AS (select *, row_number() over (partition by conv_id order by sec, grp) - 1 as gi,
              count(*) over (partition by conv_id, sec) as parts from g),
    named AS (select *, coalesce(nullif(heading, ''), 'conv-' || conv_id || '.docx') as label,
              case when heading is null then body else heading || chr(10) || chr(10) || body end as full_text from n)
    select substr(sha256('upload://' || sha256(cast(conv_id as varchar)) || chr(31) || 'uploaded_document' || chr(31)
               || coalesce(heading, '') || '#' || gi), 1, 32) as chunk_id,
        label || case when parts > 1 then ' (part ' || (grp + 1) || ')' else '' end as section_label,
        length(full_text) as n_chars, sha256(full_text) as content_hash
    from named"""


@query("s4_docx_sections", _HEADED_SQL)
def docx_sections(spark, sf):
    """Conversations as styled paragraphs: each user turn is a heading."""
    style = F.when(F.col("role") == "user", "Heading 1").otherwise("Normal")
    rows = read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", style.alias("style"))
    docs = files.docx_sections(rows, "conv_id").select(
        X.content_hash(F.col("conv_id").cast("string")).alias("file_hash"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("filename"),
        "sections",
    )
    chunks = C.chunk_documents(docs, ingested_at=at(INGESTED_AT), target_chars=1000)
    return chunks.select("chunk_id", "section_label", F.length("chunk_text").cast("long").alias("n_chars"), "content_hash")


@query("s5_upload_checks", f"""
    select doc_id, case when n_chars * 4000 > 20971520 then 'File exceeds the 20MB upload limit.'
        when length(text) = 0 then 'Uploaded file is empty.'
        when {_KIND_SQL} is null then 'Unsupported file type — only PDF, DOCX, and TXT files are accepted.' end as problem
    from ({_NAMED_DUCK})""")
def upload_checks(spark, sf):
    named = _named(spark, sf)
    kind = files.file_kind(F.col("filename"), F.col("content_type"))
    problem = files.upload_problem(F.octet_length("text"), kind, declared=F.col("n_chars") * 4000)
    return named.select("doc_id", problem.alias("problem"))


@query("s7_source_lookup", """
    select l.doc_id as chunk_id, d.source as section_label, 'upload://' || d.doc_id as source_url, length(d.text) as n_chars
    from (select distinct doc_id from labels) l join documents d on l.doc_id = d.doc_id""")
def source_lookup(spark, sf):
    """Rows of the store by id, without the vector."""
    store = read(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("section_label"),
        F.concat(F.lit("upload://"), F.col("doc_id").cast("string")).alias("source_url"), F.length("text").cast("long").alias("n_chars"),
    )
    return store.join(read(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")


@query("s9_provenance", f"""
    select doc_id, 'upload://' || sha256(text) as source_url, true as date_unknown, TIMESTAMP '{INGESTED_AT}' as retrieval_timestamp
    from documents""")
def provenance(spark, sf):
    url = F.concat(F.lit("upload://"), X.content_hash(F.col("text")))
    stamped = read(spark, sf, "documents").select("doc_id", *C.provenance(url, at(INGESTED_AT)))
    return stamped.select("doc_id", "source_url", F.col("published_date").isNull().alias("date_unknown"), "retrieval_timestamp")


# --- text and chunking -----------------------------------------------------------------


def _paragraph_sql(pattern: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(text, '{pattern}'), lambda p: trim(p, {_WS})), lambda p: p <> '')")


@query("c1_paragraphs", f"""
    select doc_id, len(a) as by_blank_line, len(b) as by_line, sha256(array_to_string(b, '|')) as line_hash
    from (select doc_id, {_paragraph_sql(_BLANK_LINE_SQL)} as a, {_paragraph_sql(LINES)} as b from documents)""")
def paragraphs(spark, sf):
    split = read(spark, sf, "documents").select("doc_id", X.paragraphs(F.col("text")).alias("a"), X.paragraphs(F.col("text"), LINES).alias("b"))
    return split.select(
        "doc_id", F.size("a").cast("long").alias("by_blank_line"), F.size("b").cast("long").alias("by_line"),
        X.content_hash(F.array_join("b", "|")).alias("line_hash"),
    )


def _groups_sql(pattern: str, target: int) -> str:
    return f"""
    p AS (select doc_id, text, {_paragraph_sql(pattern)} as items from documents),
    {_greedy_cte('p', 'doc_id, text', target, 2)},
    g AS (select doc_id, any_value(text) as doc_text, grp, string_agg(items[i], chr(10) || chr(10) order by i) as body, count(*) as paras
          from walk group by doc_id, grp)"""


_GROUPS = _groups_sql(LINES, X.TARGET_CHARS)


def _documents_as_files(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select(
        F.col("doc_id"),
        X.content_hash(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))).alias("file_hash"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        C.whole_text_section(F.col("text"), LINES).alias("sections"),
    )


@query("c2_size_groups", f"""
    WITH RECURSIVE {_GROUPS}
    select doc_id, cast(grp as bigint) as group_index, length(body) as n_chars, sha256(body) as body_hash from g""")
def size_groups(spark, sf):
    groups = C.group_documents(_documents_as_files(spark, sf).select("doc_id", "sections"))
    return groups.select("doc_id", F.col("group_index").cast("long").alias("group_index"),
                         F.length("body").cast("long").alias("n_chars"), X.content_hash(F.col("body")).alias("body_hash"))


def _pieces_sql(limit: int) -> str:
    return f"""
    b AS (select doc_id, doc_text, grp, body, max(grp) over (partition by doc_id) + 1 as parts from g),
    sent AS (select doc_id, grp, body, list_filter(string_split(regexp_replace(body, '([.!?]){_WS_CLASS}+', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> '') as items
             from b where length(body) > {limit}),
    many AS (select doc_id, grp, items from sent where len(items) > 1),
    swalk AS (
        select doc_id, grp, items, 1 as i, 0 as piece, length(items[1]) as cur from many
        union all
        select doc_id, grp, items, i + 1, case when cur + 1 + length(items[i + 1]) <= {limit} then piece else piece + 1 end,
            case when cur + 1 + length(items[i + 1]) <= {limit} then cur + 1 + length(items[i + 1]) else length(items[i + 1]) end
        from swalk where i < len(items)),
    packed AS (
        select doc_id, grp, piece, string_agg(items[i], ' ' order by i) as t from swalk group by doc_id, grp, piece
        union all select doc_id, grp, 0, body from sent where len(items) <= 1
        union all select doc_id, grp, 0, body from b where length(body) <= {limit}),
    cut AS (select doc_id, grp, piece, unnest(generate_series(0, (length(t) - 1) // {limit})) as slice, t from packed),
    pieces AS (select c.doc_id, b.doc_text, b.parts, c.grp, substr(t, slice * {limit} + 1, {limit}) as piece_text,
               row_number() over (partition by c.doc_id, c.grp order by piece, slice) as k,
               count(*) over (partition by c.doc_id, c.grp) as n
        from cut c join b on c.doc_id = b.doc_id and c.grp = b.grp)"""


_PIECES = _pieces_sql(PIECE_CHARS)


@query("c12_chunks", f"""
    WITH RECURSIVE {_GROUPS}, {_PIECES}
    select substr(sha256('upload://' || sha256(doc_id || ':' || doc_text) || chr(31) || 'uploaded_document' || chr(31) || '#' || grp
               || case when n > 1 then ':split' || k else '' end), 1, 32) as chunk_id,
        'doc-' || doc_id || '.txt' || case when parts > 1 then ' (part ' || (grp + 1) || ')' else '' end
            || case when n > 1 then ' (split ' || k || '/' || n || ')' else '' end as section_label,
        length(piece_text) as n_chars, sha256(piece_text) as content_hash,
        'upload://' || sha256(doc_id || ':' || doc_text) as source_url
    from pieces""")
def chunks(spark, sf):
    made = C.chunk_documents(_documents_as_files(spark, sf), ingested_at=at(INGESTED_AT), max_chars=PIECE_CHARS)
    return made.select("chunk_id", "section_label", F.length("chunk_text").cast("long").alias("n_chars"), "content_hash", "source_url")


@query("c3_oversize_split", f"""
    WITH RECURSIVE {_GROUPS}, {_PIECES}
    select doc_id, cast(grp as bigint) as group_index, max(n) as pieces, max(length(piece_text)) as longest, cast(sum(length(piece_text)) as bigint) as total
    from pieces group by doc_id, grp""")
def oversize_split(spark, sf):
    groups = C.group_documents(_documents_as_files(spark, sf).select("doc_id", "sections"))
    sized = groups.withColumn("sentences", F.when(F.length("body") > PIECE_CHARS, X.sentences(F.col("body"))))
    lengths = F.transform(C.split_oversized(F.col("body"), F.col("sentences"), PIECE_CHARS), F.length)
    cut = sized.select("doc_id", F.col("group_index").cast("long").alias("group_index"), lengths.alias("lengths"))
    return cut.select(
        "doc_id", "group_index", F.size("lengths").cast("long").alias("pieces"), F.array_max("lengths").cast("long").alias("longest"),
        F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, n: acc + n).alias("total"),
    )


@query("c4_c5_default_chunks", f"""
    WITH RECURSIVE {_groups_sql(_BLANK_LINE_SQL, X.TARGET_CHARS)}, {_pieces_sql(X.CHUNK_MAX_CHARS)}
    select doc_id, 'doc-' || doc_id || case when parts > 1 then ' (part ' || (grp + 1) || ')' else '' end
            || case when n > 1 then ' (split ' || k || '/' || n || ')' else '' end as section_label,
        length(piece_text) as n_chars, sha256(piece_text) as content_hash
    from pieces""")
def default_chunks(spark, sf):
    """Default paragraphs and sizes."""
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").alias("file_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
        C.whole_text_section(F.col("text")).alias("sections"),
    )
    made = C.chunk_documents(docs, ingested_at=at(INGESTED_AT))
    return made.select(F.col("file_hash").alias("doc_id"), "section_label", F.length("chunk_text").cast("long").alias("n_chars"), "content_hash")


@query("c7_stable_ids", """
    select doc_id, substr(sha256(coalesce(lang, '') || chr(31) || coalesce(case when doc_id % 3 > 0 then source end, '') || chr(31) || doc_id), 1, 32) as id
    from documents""")
def stable_ids(spark, sf):
    source = F.when(F.col("doc_id") % 3 > 0, F.col("source"))
    return read(spark, sf, "documents").select("doc_id", X.stable_id(F.col("lang"), source, F.col("doc_id").cast("string")).alias("id"))


@query("c8_c9_hashes", "select doc_id, sha256(text) as content_hash, sha256(encode(text)) as file_hash from documents")
def hashes(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.content_hash(F.col("text").cast("binary")).alias("file_hash")
    )


_BLANKED = "case when doc_id % 20 = 3 then ' ' || chr(10) || chr(9) || chr(160) || chr(10) when doc_id % 20 = 4 then '' else text end"


@query("c10_empty_documents", f"""
    select doc_id, 'EmptyDocumentError: doc-' || doc_id || ' has no non-empty paragraph' as failure_reason
    from (select doc_id, {_BLANKED} as t from documents) where trim(t, {_WS}) = ''""")
def empty_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.expr(_BLANKED).alias("text"))
    named = docs.select(
        F.col("doc_id").alias("file_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
        C.whole_text_section(F.col("text")).alias("sections"),
    )
    return C.empty_documents(named).select(F.col("file_hash").alias("doc_id"), "failure_reason")


@query("c11_token_estimates", """
    select source, cast(sum(greatest(1, length(text) // 4)) as bigint) as tokens, max(greatest(1, length(text) // 4)) as largest from documents group by source""")
def token_estimates(spark, sf):
    tokens = X.estimated_tokens(F.col("text"))
    return read(spark, sf, "documents").groupBy("source").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("largest"))


@query("c13_input_guard", f"""
    select doc_id, case when trim(t, {_WS}) = '' then 'empty text'
        when length(t) > 24000 then 'input text is ' || length(t) || ' chars, over 24000' end as problem
    from (select doc_id, {_BLANKED} as t from documents)""")
def input_guard(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.expr(_BLANKED).alias("text"))
    return docs.select("doc_id", C.chunk_problem(F.col("text")).alias("problem"))


@query("c14_vector_checks", """
    select vec_id, case vec_id % 6 when 1 then 'expected 64 values, got 63' when 2 then 'non-numeric value' when 3 then 'non-finite value'
        when 4 then 'non-finite value' when 5 then 'missing' end as reason from embeddings""")
def vector_checks(spark, sf):
    """Vectors spoiled in five ways."""
    def head(value):
        return F.concat(F.array(value.cast("float")), F.slice("embedding", 2, 63))
    kind = F.col("vec_id") % 6
    spoiled = (
        F.when(kind == 1, F.slice("embedding", 1, 63)).when(kind == 2, head(F.lit(None))).when(kind == 3, head(F.lit("NaN")))
        .when(kind == 4, head(F.lit("-Infinity"))).when(kind == 5, F.lit(None)).otherwise(F.col("embedding"))
    )
    return read(spark, sf, "embeddings").select("vec_id", vectors.invalid_vector_reason(spoiled, 64).alias("reason"))


# --- retrieval -----------------------------------------------------------------------


def _questions(spark, sf) -> DataFrame:
    """One question per label: the vector with the lowest id."""
    first = read(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.col("label").cast("long").alias("query_id"), "embedding")


def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _corpus(spark, sf) -> DataFrame:
    """All vectors; one without a document counts as the smallest text."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), X.estimated_tokens(F.col("text")).alias("est_tokens"))
    return _vectors(spark, sf).join(texts, "chunk_id", "left").withColumn("est_tokens", F.coalesce("est_tokens", F.lit(1)))


_SIM = "list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v))"
_RANKED = f"""
    e AS (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    q AS (select cast(label as bigint) as query_id, arg_min(v, vec_id) as v from e group by label),
    c AS (select vec_id as chunk_id, v, greatest(1, coalesce(length(text), 0) // 4) as est_tokens from e left join documents d on d.doc_id = e.vec_id),
    scored AS (select query_id, chunk_id, {_SIM} as similarity, c.v, est_tokens from q, c),
    pool AS (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from scored qualify rank <= 40),
    above AS (select *, row_number() over (partition by query_id order by rank) as pos from pool where similarity >= {THRESHOLD})"""
_DEDUPED = f"""{_RANKED},
    fold AS (
        select query_id, cast(0 as bigint) as pos, cast([] as double[][]) as kept, false as keep, cast(null as bigint) as chunk_id,
            cast(null as bigint) as rank, cast(null as double) as similarity, cast(null as bigint) as est_tokens from q
        union all
        select f.query_id, a.pos, case when dup then f.kept else list_append(f.kept, a.v) end, not dup, a.chunk_id, a.rank, a.similarity, a.est_tokens
        from fold f join above a on a.query_id = f.query_id and a.pos = f.pos + 1,
            lateral (select len(list_filter(f.kept, lambda k: list_dot_product(k, a.v) >= {DEDUP})) > 0 as dup)),
    kept AS (select query_id, rank, chunk_id, similarity, est_tokens from fold where keep)"""
_BUDGETED = f"""{_DEDUPED},
    running AS (select *, sum(est_tokens) over (partition by query_id order by rank) as context_tokens,
                row_number() over (partition by query_id order by rank) as first from kept),
    chosen AS (select * from running where first = 1 or context_tokens <= 6000)"""


@query("t1_top_k", f"WITH {_RANKED} select query_id, rank, chunk_id, round(similarity, 9) as similarity from pool")
def top_k(spark, sf):
    hits = R.top_k(_questions(spark, sf), _vectors(spark, sf))
    return hits.select("query_id", "rank", "chunk_id", F.round("similarity", 9).alias("similarity"))


@query("t3_indexed_hits", f"""
    WITH {_RANKED} select query_id, rank, chunk_id, round(similarity, 9) as similarity from pool where similarity >= {THRESHOLD}""")
def indexed_hits(spark, sf):
    """The relevant part of the top-K, through the cell index."""
    corpus = _vectors(spark, sf)
    centroids = VI.train_centroids(corpus, 8)
    assigned = VI.assign_cells(corpus, centroids)
    hits = VI.relevant_hits(_questions(spark, sf), assigned, centroids, VI.cell_widths(assigned), threshold=THRESHOLD)
    return hits.select("query_id", "rank", "chunk_id", F.round("similarity", 9).alias("similarity"))


@query("d1_deduplicated", f"WITH RECURSIVE {_DEDUPED} select query_id, rank, chunk_id, round(similarity, 9) as similarity from kept")
def deduplicated(spark, sf):
    hits = R.top_k(_questions(spark, sf), _vectors(spark, sf), keep_vectors_from=THRESHOLD)
    near = hits.where(R.relevant(F.col("similarity"), THRESHOLD))
    return R.deduplicate(near, DEDUP).select("query_id", "rank", "chunk_id", F.round("similarity", 9).alias("similarity"))


@query("b1_w1_token_budget", f"""
    WITH {_RANKED}, r AS (select query_id, rank, chunk_id, sum(est_tokens) over (partition by query_id order by rank) as context_tokens from pool)
    select query_id, rank, chunk_id, cast(context_tokens as bigint) as context_tokens from r where rank = 1 or context_tokens <= 3000""")
def token_budget(spark, sf):
    hits = R.top_k(_questions(spark, sf), _corpus(spark, sf), carry=["est_tokens"], keep_vectors_from=2.0)
    return R.token_budget(hits, 3000).select("query_id", "rank", "chunk_id", "context_tokens")


def _retrieved(spark, sf) -> DataFrame:
    return R.retrieve(_questions(spark, sf), _corpus(spark, sf), threshold=THRESHOLD, dedup_threshold=DEDUP)


@query("q1_retrieve", f"""
    WITH RECURSIVE {_BUDGETED}
    select query_id, rank, chunk_id, round(similarity, 9) as similarity, est_tokens, cast(context_tokens as bigint) as context_tokens from chosen""")
def retrieve(spark, sf):
    found = _retrieved(spark, sf)
    return found.select("query_id", "rank", "chunk_id", F.round("similarity", 9).alias("similarity"), "est_tokens", "context_tokens")


@query("a6_retrieval_report", f"""
    WITH RECURSIVE {_BUDGETED}
    select q.query_id, (select count(*) from pool p where p.query_id = q.query_id) as candidates_considered,
        (select count(*) from above a where a.query_id = q.query_id) as above_threshold,
        (select count(*) from above a where a.query_id = q.query_id) - (select count(*) from kept k where k.query_id = q.query_id) as deduped_out,
        (select count(*) from chosen c where c.query_id = q.query_id) as selected,
        cast((select coalesce(max(context_tokens), 0) from chosen c where c.query_id = q.query_id) as bigint) as context_tokens_estimate
    from q""")
def retrieval_report(spark, sf):
    return R.retrieval_report(_retrieved(spark, sf))


_PAIRS = """
    e AS (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    q AS (select label, arg_min(v, vec_id) as v from e group by label),
    p AS (select vec_id, q.v as a, e.v as b from e join q on e.label = q.label)"""


@query("v1_v2_similarity", f"""
    WITH {_PAIRS}
    select vec_id, round(list_dot_product(a, b), 9) as dot, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 9) as cosine from p""")
def similarity(spark, sf):
    """Every vector against the first of its label."""
    rows = _with_exemplar(spark, sf)
    a, b = F.col("exemplar"), F.col("embedding")
    return rows.select("vec_id", F.round(vectors.dot(a, b), 9).alias("dot"), F.round(vectors.cosine_similarity(a, b), 9).alias("cosine"))


def _with_exemplar(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("exemplar"))
    return rows.join(first, "label")


@query("f2_relevance_filter", f"""
    WITH {_PAIRS}
    select vec_id from p where list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) >= 0.1""")
def relevance_filter(spark, sf):
    rows = _with_exemplar(spark, sf)
    near = vectors.cosine_similarity(F.col("exemplar"), F.col("embedding"))
    return rows.where(R.relevant(near, 0.1)).select("vec_id")


@query("s6_embedded_rows", """
    select label, count(*) as embedded from embeddings where embedding is not null group by label""")
def embedded_rows(spark, sf):
    """Rows of the store that have a vector."""
    store = read(spark, sf, "embeddings")
    return store.where(F.col("embedding").isNotNull()).groupBy("label").agg(F.count("*").alias("embedded"))


# --- grounding -------------------------------------------------------------------------

_LINE_CHUNKS = f"""
    lines AS (select doc_id, {_paragraph_sql(LINES)} as items from documents),
    flat AS (select doc_id, unnest(items) as t, unnest(generate_series(1, len(items))) as i from lines)"""


def _passages(spark, sf) -> DataFrame:
    """Documents as questions with their lines as retrieved passages."""
    split = read(spark, sf, "documents").select("doc_id", X.paragraphs(F.col("text"), LINES).alias("items"))
    passages = F.transform("items", lambda t, i: F.struct(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), (i + 1).cast("string")).alias("chunk_id"), t.alias("chunk_text")
    ))
    return split.select("doc_id", "items", passages.alias("chunks"))


@query("g1_prompts", f"""
    WITH {_LINE_CHUNKS},
    blocks AS (select doc_id, string_agg('chunk_id=' || doc_id || ':' || i || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as b,
               max(t) filter (where i = 1) as question from flat group by doc_id)
    select doc_id, length(m) as n_chars, sha256(m) as message_hash from (select doc_id,
        'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'REFERENCE MATERIAL:' || chr(10) || b || chr(10) as m from blocks)""")
def prompts(spark, sf):
    asked = _passages(spark, sf).where(F.size("items") > 0)
    message = asked.select("doc_id", G.user_message(F.get("items", F.lit(0)), F.col("chunks")).alias("m"))
    return message.select("doc_id", F.length("m").cast("long").alias("n_chars"), X.content_hash(F.col("m")).alias("message_hash"))


_STOP = "[" + ", ".join(f"'{w}'" for w in G.SUPPORT_STOPWORDS) + "]"


def _tokens_sql(text: str) -> str:
    return (f"list_filter(list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-z]{{5,}}'), lambda w: lower(w))), "
            f"lambda w: not list_contains({_STOP}, w))")


@query("g2_salient_tokens", f"""
    select doc_id, len(t) as tokens, sha256(array_to_string(list_sort(t), ' ')) as token_hash
    from (select doc_id, {_tokens_sql("text || ' The Council approved Funding for energy'")} as t from documents)""")
def salient_tokens(spark, sf):
    text = F.concat("text", F.lit(" The Council approved Funding for energy"))
    tokens = read(spark, sf, "documents").select("doc_id", G.salient_tokens(text).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("tokens"), X.content_hash(F.array_join(F.array_sort("t"), " ")).alias("token_hash"))


@query("g3_citation_support", f"""
    WITH p AS (select a.conv_id, a.turn, {_tokens_sql('a.text')} as x, {_tokens_sql('u.text')} as y
        from conversations a join conversations u on u.conv_id = a.conv_id and u.turn + 1 = a.turn
        where a.role = 'assistant' and u.role = 'user'),
    s AS (select *, len(list_intersect(x, y)) as shared from p)
    select conv_id, turn, len(x) as answer_tokens, shared as shared_tokens, len(x) = 0 or shared >= least(2, len(x)) as supported from s""")
def citation_support(spark, sf):
    """Does the user's turn support the assistant's next one?"""
    turns = read(spark, sf, "conversations")
    answers = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = turns.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("passage"))
    judged = G.citation_overlap(answers.join(asked, ["conv_id", "turn"]), "answer", "passage")
    return judged.select("conv_id", "turn", "answer_tokens", "shared_tokens", "supported")


def _replies(spark, sf) -> DataFrame:
    """Replies to the documents' passages, right and wrong in ten ways."""
    kind = F.col("doc_id") % 10
    first, last = F.lit("1"), F.size("items").cast("string")
    answer = F.coalesce(F.get("items", F.lit(0)), F.lit("?"))

    def body(cited: Column, silent: str = "false") -> Column:
        said = F.to_json(F.struct(answer.alias("answer")))
        return F.concat(F.substring(said, 1, F.length(said) - 1), F.lit(', "citations": ['), cited, F.lit(f'], "not_in_corpus": {silent}}}'))

    def ids(n: Column) -> Column:
        return F.concat(F.col("doc_id").cast("string"), F.lit(":"), n)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    content = (
        F.when(kind == 0, body(quoted(ids(first))))
        .when(kind == 1, body(quoted(ids(last))))
        .when(kind == 2, body(F.concat(quoted(ids(first)), F.lit(', "nope", 12345, '), quoted(ids(first)))))
        .when(kind == 3, body(F.lit('"nope"')))
        .when(kind == 4, body(quoted(ids(first)), "true"))
        .when(kind == 5, body(quoted(ids(first)), '"false"'))
        .when(kind == 6, F.lit("no JSON at all"))
        .when(kind == 7, F.lit('{"citations": [], "not_in_corpus": false}'))
        .when(kind == 8, body(F.concat(quoted(ids(first)), F.lit(", "), quoted(ids(last)))))
        .otherwise(F.lit(None))
    )
    return _passages(spark, sf).withColumn("content", content)


_REPLY_SQL = f"""
    WITH {_LINE_CHUNKS},
    d AS (select doc_id, items, doc_id % 10 as kind, len(items) as n, items[1] as a, items[len(items)] as z from lines),
    j AS (select *, {_tokens_sql('a')} as ta, {_tokens_sql('z')} as tz from d),
    k AS (select *, len(ta) = 0 or len(list_intersect(ta, tz)) >= least(2, len(ta)) as supported from j),
    out AS (select doc_id, n, kind, doc_id || ':1' as id1, doc_id || ':' || n as idn, supported from k)"""
_STATUS_SQL = """
    case when n = 0 then 'not_in_corpus' when kind in (5, 6, 7, 9) then 'invalid' when kind = 4 then 'not_in_corpus' when kind = 3 then 'ungrounded'
        when kind = 1 and not supported then 'ungrounded' else 'ok' end"""


@query("g4_g7_reply_validation", f"""
    {_REPLY_SQL}
    select doc_id, {_STATUS_SQL} as status,
        case when n = 0 then '' when kind in (0, 2) then id1 when kind = 1 and supported then idn
             when kind = 8 and n = 1 then id1 when kind = 8 then id1 || ' ' || idn else '' end as citations,
        case when n = 0 then '' when kind = 1 and not supported then idn when kind = 2 then 'nope 12345' when kind = 3 then 'nope' when kind = 4 then id1 else '' end as dropped,
        case when n = 0 then null else case kind when 5 then 'not_in_corpus is not a boolean' when 6 then 'not JSON' when 7 then 'no answer' when 9 then 'empty content' end end as problem
    from out""")
def reply_validation(spark, sf):
    judged = G.validate_replies(_replies(spark, sf))
    return judged.select(
        "doc_id", "status", F.array_join("citations", " ").alias("citations"), F.array_join("dropped", " ").alias("dropped"), "problem"
    )


@query("g8_p20_answer_outcomes", f"""
    {_REPLY_SQL}, s AS (select {_STATUS_SQL} as status from out)
    select status, cast(case status when 'invalid' then 502 else 200 end as bigint) as http_status, count(*) as replies,
        count(*) filter (where status in ('not_in_corpus', 'ungrounded')) as told_not_in_corpus
    from s group by status""")
def answer_outcomes(spark, sf):
    told = O.query_response(G.validate_replies(_replies(spark, sf)))
    return told.groupBy("status", "http_status").agg(
        F.count("*").alias("replies"), F.count_if("response_not_in_corpus").alias("told_not_in_corpus")
    )


_SYSTEM = "Answer from the reference material, as JSON."
_CORRECTION = "These citations could not be used:\n{rejection_lines}\nAnswer again."


def _failing_model(messages: list[dict]) -> str:
    """Fails by the length of the question: too many calls, no answer in time, no JSON, or otherwise."""
    kind = len(messages[1]["content"].split("\n\nREFERENCE MATERIAL:\n", 1)[0].removeprefix("QUESTION:\n")) % 5
    if kind == 1:
        raise G.RateLimited("slow down")
    if kind == 2:
        raise TimeoutError("no answer")
    if kind == 3:
        raise ValueError("bad request")
    first_id = messages[1]["content"].split("chunk_id=", 1)[1].split("\n", 1)[0]
    return "no JSON" if kind == 4 else json.dumps({"answer": "a", "citations": [first_id], "not_in_corpus": False})


@query("g10_p20_call_failures", f"""
    WITH {_LINE_CHUNKS}, d AS (select doc_id, len(items) as n, length(items[1]) % 5 as kind from lines),
    s AS (select doc_id, case when n = 0 then 'not_in_corpus' when kind = 0 then 'ok' when kind = 1 then 'rate_limited' when kind = 2 then 'timeout'
        when kind = 3 then 'call_failed' else 'invalid' end as status from d)
    select doc_id, status, cast(case status when 'rate_limited' then 429 when 'timeout' then 504 when 'call_failed' then 500 when 'invalid' then 502
        else 200 end as bigint) as http_status from s""")
def call_failures(spark, sf):
    """Answers with their statuses when the model's calls fail."""
    asked = _passages(spark, sf).select(F.col("doc_id").alias("query_id"), F.get("items", F.lit(0)).alias("question"), "chunks")
    policy = G.RetryPolicy(max_attempts=2, base_backoff_seconds=0)
    told = O.query_response(G.generate_answers(asked, _failing_model, system_prompt=_SYSTEM, correction=_CORRECTION, policy=policy))
    return told.select(F.col("query_id").alias("doc_id"), "status", "http_status")


def _stand_in_model(messages: list[dict]) -> str:
    """Answers by the length of the question: at once, after a correction, never, or not in JSON."""
    asked = messages[1]["content"]
    question = asked.split("\n\nREFERENCE MATERIAL:\n", 1)[0].removeprefix("QUESTION:\n")
    first_id = asked.split("chunk_id=", 1)[1].split("\n", 1)[0]
    kind, corrected = len(question) % 4, len(messages) > 2
    if kind == 3:
        return "no JSON"
    cited = first_id if kind == 0 or (kind == 1 and corrected) else "nope"
    return json.dumps({"answer": question, "citations": [cited], "not_in_corpus": False})


@query("g9_g11_two_pass_answers", f"""
    WITH {_LINE_CHUNKS}, d AS (select doc_id, len(items) as n, length(items[1]) % 4 as kind from lines)
    select doc_id, case when n = 0 then 'not_in_corpus' when kind in (0, 1) then 'ok' when kind = 2 then 'ungrounded' else 'invalid' end as status,
        case when n > 0 and kind in (0, 1) then doc_id || ':1' else '' end as citations from d""")
def two_pass_answers(spark, sf):
    asked = _passages(spark, sf).select(F.col("doc_id").alias("query_id"), F.get("items", F.lit(0)).alias("question"), "chunks")
    answers = G.generate_answers(asked, _stand_in_model, system_prompt=_SYSTEM, correction=_CORRECTION)
    return answers.select(F.col("query_id").alias("doc_id"), "status", F.array_join("citations", " ").alias("citations"))


def _stand_in_vector(texts: list[str]) -> list[list[float]]:
    """A unit vector by the length of the text; some lengths fail, or give a vector of the wrong size."""
    def one(text: str) -> list[float]:
        if len(text) % 97 == 0:
            raise G.RateLimited("slow down")
        if len(text) % 97 == 1:
            raise TimeoutError("no vector")
        return [1.0] if len(text) % 97 == 2 else [float(i == len(text) % 64) for i in range(64)]

    return [one(t) for t in texts]


def _first_passage_model(messages: list[dict]) -> str:
    """Answers with the words of the first passage; by the length of the question, cites it at once, after a
    correction or never, or gives no JSON."""
    question, passages = messages[1]["content"].removeprefix("QUESTION:\n").rsplit("\n\nREFERENCE MATERIAL:\n", 1)
    first_id, rest = passages.split("chunk_id=", 1)[1].split("\n", 1)
    kind = len(question) % 4
    if kind == 3:
        return "no JSON"
    cited = first_id if kind == 0 or (kind == 1 and len(messages) > 2) else "nope"
    return json.dumps({"answer": rest.split("chunk_id=", 1)[0], "citations": [cited], "not_in_corpus": False})


# Questions by their place in the vector, of which there are as many as components.
_BY_PLACE = _BUDGETED.replace(
    "q AS (select cast(label as bigint) as query_id, arg_min(v, vec_id) as v from e group by label)",
    "q AS (select i as query_id, list_transform(range(64), lambda j: case when i = j then 1.0::double else 0.0::double end) as v from range(64) t(i))")


@query("g11_answer_query", f"""
    WITH RECURSIVE {_BY_PLACE},
    first AS (select query_id, arg_min(chunk_id, rank) as chunk_id from chosen join documents d on d.doc_id = chosen.chunk_id group by query_id),
    asked AS (select doc_id, length(text) as n, trim(text, {_WS}) = '' as blank from documents),
    told AS (select doc_id, f.chunk_id, case when blank then 'blank_question' when n > {X.EMBEDDING_MAX_CHARS} then 'question_too_long' when n % 97 = 0 then 'rate_limited'
        when n % 97 = 1 then 'timeout' when n % 97 = 2 then 'invalid_embedding' when f.chunk_id is null then 'not_in_corpus'
        when n % 4 in (0, 1) then 'ok' when n % 4 = 2 then 'ungrounded' else 'invalid' end as status
        from asked left join first f on f.query_id = n % 64)
    select doc_id, status, cast(case status when 'question_too_long' then 400 when 'blank_question' then 422 when 'rate_limited' then 429 when 'timeout' then 504
        when 'invalid_embedding' then 502 when 'invalid' then 502 else 200 end as bigint) as http_status,
        case when status = 'ok' then cast(chunk_id as varchar) else '' end as citations from told""")
def answer_query(spark, sf):
    """Every document as a question: embedded, answered from the passages that are near, and checked."""
    docs = read(spark, sf, "documents")
    corpus = _corpus(spark, sf).join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")), "chunk_id", "left")
    answers = answering.answer_query(
        docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), corpus.where(F.col("embedding").isNotNull()),
        _stand_in_vector, _first_passage_model, dim=64, policy=G.RetryPolicy(max_attempts=2, base_backoff_seconds=0),
        retrieval={"threshold": THRESHOLD, "dedup_threshold": DEDUP}, system_prompt=_SYSTEM, correction=_CORRECTION)
    told = O.query_response(answers)
    return told.select(F.col("query_id").alias("doc_id"), "status", "http_status", F.coalesce(F.array_join("citations", " "), F.lit("")).alias("citations"))


@query("j9_f8_citation_lookup", f"""
    {_REPLY_SQL}, cited AS (
        select doc_id, unnest(case when n = 0 then [] when kind in (0, 2) then [id1] when kind = 1 and supported then [idn]
            when kind = 8 and n = 1 then [id1] when kind = 8 then [id1, idn] else [] end) as chunk_id from out),
    pos AS (select doc_id, chunk_id, row_number() over (partition by doc_id order by cast(split_part(chunk_id, ':', 2) as int)) - 1 as position from cited)
    select p.doc_id, position, chunk_id, d.lang as doc_type, d.source as section_label, 'upload://' || p.doc_id as source_url
    from pos p join documents d on d.doc_id = p.doc_id join lines l on l.doc_id = p.doc_id
    where length(l.items[cast(split_part(chunk_id, ':', 2) as int)]) >= 80""")
def citation_lookup(spark, sf):
    """The store holds passages of 80 characters and more; citations of others are skipped."""
    answers = G.validate_replies(_replies(spark, sf)).select("doc_id", "citations")
    docs = read(spark, sf, "documents")
    numbered = docs.select("doc_id", "lang", "source", F.posexplode_outer(X.paragraphs(F.col("text"), LINES)).alias("i", "t"))
    store = numbered.where(F.length("t") >= 80).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("i") + 1).cast("string")).alias("chunk_id"),
        F.col("lang").alias("doc_type"), F.col("source").alias("section_label"),
        F.concat(F.lit("upload://"), F.col("doc_id").cast("string")).alias("source_url"), F.lit(None).cast("date").alias("published_date"),
    )
    found = G.lookup_citations(answers, store, "doc_id")
    return found.select("doc_id", "position", "chunk_id", "doc_type", "section_label", "source_url")


# --- ingest ------------------------------------------------------------------------------

_CLASSIFIED = f"""{with_tables('store', 'incoming')},
    classified AS (select i.chunk_id, i.content_hash, i.section_label, case when s.chunk_id is null then 'inserted'
        when s.content_hash is null or s.content_hash <> i.content_hash then 'updated' else 'skipped' end as outcome
        from incoming i left join store s on s.chunk_id = i.chunk_id)"""


def _classified(spark, sf) -> DataFrame:
    return I.classify_changes(derive(spark, sf, "incoming"), derive(spark, sf, "store"))


@query("u1_j10_classify_changes", f"{_CLASSIFIED} select chunk_id, outcome from classified")
def classify_changes(spark, sf):
    return _classified(spark, sf).select("chunk_id", "outcome")


@query("u2_to_embed", f"{_CLASSIFIED} select chunk_id, content_hash from classified where outcome <> 'skipped'")
def to_embed(spark, sf):
    return _classified(spark, sf).where(F.col("outcome") != "skipped").select("chunk_id", "content_hash")


def _letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(t.count("a")), float(t.count("e")), float(len(t))] for t in texts]


@query("u3_embed_changed", f"""
    {_CLASSIFIED} select c.chunk_id, case when length(d.text) > 24000 then 'failed' else outcome end as outcome,
        cast(case when length(d.text) <= 24000 then length(d.text) - length(replace(d.text, 'e', '')) end as double) as second_value
    from classified c join documents d on d.doc_id = c.chunk_id where outcome <> 'skipped'""")
def embed_changed(spark, sf):
    """Embedding boundary with a stand-in model of three letter counts; over-long texts fail alone."""
    done = I.embed_changed(_classified(spark, sf), _letter_counts, dim=3)
    return done.select("chunk_id", "outcome", F.get("embedding", F.lit(1)).cast("double").alias("second_value"))


@query("a5_outcome_counts", f"""
    {_CLASSIFIED}, o AS (select section_label, case when outcome <> 'skipped' and length(d.text) > 24000 then 'failed' else outcome end as outcome
        from classified c join documents d on d.doc_id = c.chunk_id)
    select section_label as lang, count(*) filter (where outcome = 'inserted') as inserted, count(*) filter (where outcome = 'updated') as updated,
        count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'failed') as failed, count(*) as total
    from o group by section_label""")
def outcome_counts(spark, sf):
    c = _classified(spark, sf)
    failed = (F.col("outcome") != "skipped") & C.chunk_problem(F.col("chunk_text")).isNotNull()
    final = c.withColumn("outcome", F.when(failed, "failed").otherwise(F.col("outcome")))
    return I.outcome_counts(final, ["section_label"]).withColumnRenamed("section_label", "lang")


@query("u4_s8_upsert", f"""
    {_CLASSIFIED} select chunk_id, content_hash, section_label from classified where outcome <> 'skipped'
    union all select s.chunk_id, s.content_hash, s.section_label from store s join classified c on c.chunk_id = s.chunk_id where c.outcome = 'skipped'""")
def upsert(spark, sf):
    store = derive(spark, sf, "store")
    changed = _classified(spark, sf).where(F.col("outcome") != "skipped")
    return I.upsert(store, changed).select("chunk_id", "content_hash", "section_label")


def _stored(spark: SparkSession, sf: str) -> KeyedTable:
    """The store as a keyed table in the shared folder, with one batch of changes applied, twice as after
    a failure."""
    rows = derive(spark, sf, "store").select("chunk_id", "content_hash", "section_label")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = KeyedTable(spark, new_folder(spark, "store"), schema, "chunk_id", digits=1)
    table.apply(rows, 0)
    changed = _classified(spark, sf).where(F.col("outcome") != "skipped").select(*rows.columns)
    table.apply(changed, 1)
    table.finish(1)
    return table


@query("s8_u4_stored_batches", f"""
    {_CLASSIFIED} select chunk_id, content_hash, section_label from classified where outcome <> 'skipped'
    union all select s.chunk_id, s.content_hash, s.section_label from store s join classified c on c.chunk_id = s.chunk_id where c.outcome = 'skipped'""")
def stored_batches(spark, sf):
    """The written form of the upsert: shards rewritten by Spark's writer, read back."""
    return _stored(spark, sf).read()


@query("u11_archived_store", f"""
    {_CLASSIFIED} select 'archive' as place, count(*) as n_rows, count(distinct content_hash) as hashes from classified
    union all select 'store', 0, 0""")
def archived_store(spark, sf):
    table, old = _stored(spark, sf), new_folder(spark, "archive")
    table.archive_to(old)
    return _union_counts(("archive", spark.read.parquet(old)), ("store", table.read()))


def _union_counts(*named) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows"), F.countDistinct("content_hash").alias("hashes")).select(F.lit(place).alias("place"), "n_rows", "hashes")
             for place, df in named]
    return parts[0].unionByName(parts[1])


@query("p15_appended_attempts", f"""
    {with_tables('attempts')} select outcome, count(*) as n_rows, count(distinct attempt_id) as attempts
    from attempts group by outcome""")
def appended_attempts(spark, sf):
    """Attempts appended batch by batch to rows that nothing can change; every batch comes twice."""
    rows = derive(spark, sf, "attempts").select("attempt_id", "file_hash", "outcome")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    path = new_folder(spark, "attempts")
    for batch in (0, 1, 0):
        append_batch(rows.where(F.pmod(F.xxhash64("attempt_id"), F.lit(2)) == batch), path, batch)
    kept = appended(spark, path, schema)
    return kept.groupBy("outcome").agg(
        F.count("*").alias("n_rows"), F.countDistinct("attempt_id").alias("attempts"))


@query("u5_upload_ledger", f"""
    {with_tables('attempts')},
    ordered AS (select *, row_number() over (partition by file_hash order by "at", attempt_id) as k,
        min(case when outcome = 'completed' then attempt_id end) over (partition by file_hash) as settled,
        min("at") over (partition by file_hash) as first_at, count(*) over (partition by file_hash) as n from attempts),
    pick AS (select * from ordered where attempt_id = settled or (settled is null and k = n))
    select file_hash, filename as original_filename, outcome as status, case when outcome = 'failed' then failure_reason end as failure_reason,
        chunk_count, first_at as uploaded_at, finished_at as completed_at, n as attempts from pick""")
def upload_ledger(spark, sf):
    return I.ledger(derive(spark, sf, "attempts")).drop("content_type")


@query("u5_attempt_responses", f"""
    {with_tables('attempts')}, s AS (select file_hash, min(attempt_id) as settled from attempts where outcome = 'completed' group by file_hash)
    select attempt_id, case when attempt_id > settled then 'completed' else 'processing' end as response,
        cast(case when attempt_id > settled then 200 else 202 end as bigint) as http_status
    from attempts a left join s on s.file_hash = a.file_hash""")
def attempt_responses(spark, sf):
    return I.attempt_responses(derive(spark, sf, "attempts")).select("attempt_id", "response", "http_status")


@query("u5_begin_attempts", f"""
    {with_tables('attempts')},
    wave AS (select file_hash, min(attempt_id) as id from attempts group by file_hash),
    led AS (select l.doc_id, case when l.toxic = 1 then 'failed' when l.quality = 1 then 'completed' else 'processing' end as status from labels l)
    select w.id as doc_id, case when led.status = 'completed' then 'completed' else 'processing' end as status,
        case when led.status = 'failed' then 'earlier ' || w.id end as previous_failure_reason,
        cast(case when led.status = 'completed' then 200 else 202 end as bigint) as http_status
    from wave w left join led on led.doc_id = w.id""")
def begin_attempts(spark, sf):
    """One upload per distinct file, against a ledger that knows the labelled ones."""
    attempts = derive(spark, sf, "attempts")
    wave = I.one_per_key(attempts.select("file_hash", "filename", "content_type", "at", "attempt_id"), "file_hash", [F.col("attempt_id")])
    wave = wave.select(F.col("attempt_id").cast("string").alias("file_hash"), "filename", "content_type", "at")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("processing")
    known = read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("file_hash"), F.lit("old.txt").alias("original_filename"), F.lit("text/plain").alias("content_type"),
        status.alias("status"), F.when(F.col("toxic") == 1, F.concat(F.lit("earlier "), F.col("doc_id").cast("string"))).alias("failure_reason"),
        F.lit(1).alias("chunk_count"), at(INGESTED_AT).alias("uploaded_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )
    begun = I.begin_attempts(known, wave)
    return begun.select(F.col("file_hash").cast("long").alias("doc_id"), "status", "previous_failure_reason", "http_status")


@query("u6_finish_attempts", """
    WITH f AS (select source, count(*) as total, count(*) filter (where length(text) > 24000) as failed from documents group by source)
    select source, case when failed > 0 then 'failed' else 'completed' end as status,
        case when failed > 0 then failed || '/' || total || ' chunk(s) failed to embed/insert' end as failure_reason from f""")
def finish_attempts(spark, sf):
    """Each source as one file whose chunks are its documents."""
    docs = read(spark, sf, "documents")
    outcome = F.when(C.chunk_problem(F.col("text")).isNotNull(), "failed").otherwise("inserted")
    outcomes = docs.select(F.col("source").alias("file_hash"), outcome.alias("outcome"))
    processing = docs.select(F.col("source").alias("file_hash")).distinct().select(
        "file_hash", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("failure_reason"),
        F.lit(None).cast("int").alias("chunk_count"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )
    done = I.finish_attempts(processing, outcomes, at(INGESTED_AT))
    return done.select(F.col("file_hash").alias("source"), "status", "failure_reason")


@query("u7_one_per_key", "select sha256(text) as content_hash, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by text")
def one_per_key(spark, sf):
    """Copies of a text inside one batch."""
    rows = read(spark, sf, "documents").select(X.content_hash(F.col("text")).alias("content_hash"), "doc_id", "source")
    return I.one_per_key(rows, "content_hash", [F.col("doc_id")])


@query("u10_insert_if_absent", """
    select d.doc_id, l.doc_id is null as inserted, l.doc_id is null or l.quality = d.doc_id % 2 as usable
    from documents d left join labels l on l.doc_id = d.doc_id""")
def insert_if_absent(spark, sf):
    proposed = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return I.insert_if_absent(read(spark, sf, "labels"), proposed, "doc_id", ["quality"]).select("doc_id", "inserted", "usable")


@query("a1_row_counts", """
    select 'documents' as table_name, count(*) as row_count from documents union all select 'embeddings', count(*) from embeddings
    union all select 'conversations', count(*) from conversations""")
def row_counts(spark, sf):
    return snapshots.row_counts({t: read(spark, sf, t) for t in ("documents", "embeddings", "conversations")})


@query("a2_counts_by_type", "select lang, count(*) as row_count from documents group by lang")
def counts_by_type(spark, sf):
    return snapshots.counts_by(read(spark, sf, "documents"), "lang")


@query("a8_upload_listing", f"""
    {with_tables('attempts')} select filename as original_filename, outcome as status, chunk_count, "at" as uploaded_at from attempts""")
def upload_listing(spark, sf):
    rows = derive(spark, sf, "attempts").withColumnsRenamed({"filename": "original_filename", "outcome": "status", "at": "uploaded_at"})
    return snapshots.upload_listing(rows)


@query("f10_question_validation", f"""
    select doc_id, length(t) between 1 and 2000 and trim(t, {_WS}) <> '' as valid from (select doc_id, {_BLANKED} as t from documents)""")
def question_validation(spark, sf):
    return read(spark, sf, "documents").select("doc_id", V.valid_question(F.expr(_BLANKED)).alias("valid"))
