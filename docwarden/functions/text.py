"""Text expressions: whitespace, paragraphs, greedy size grouping, hashes, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as whitespace for stripping and splitting
# (Unicode White_Space plus the four ASCII information separators).
WHITESPACE_CODES = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))
_WS_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in WHITESPACE_CODES) + "]"

# Boundaries and sizes of the chunker.
PARAGRAPH_BREAK = rf"\n{_WS_CLASS}*\n+"
SENTENCE_BREAK = rf"(?<=[.!?]){_WS_CLASS}+"
PARAGRAPH_JOIN = "\n\n"
TARGET_CHARS = 2000
EMBEDDING_MAX_CHARS = 24_000
CHUNK_MAX_CHARS = EMBEDDING_MAX_CHARS - 500
CHARS_PER_TOKEN = 4
ID_SEPARATOR = "\x1f"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. An expression used inside a lambda is
    otherwise computed again for every element the lambda visits."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Removes leading and trailing whitespace. A character-set trim is linear in the text;
    an anchored regular expression would rescan every inner run of blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def paragraphs(text: Column, pattern: str = PARAGRAPH_BREAK) -> Column:
    parts = F.transform(F.split(text, pattern), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: s != "")


def greedy_starts(lengths: Column, limit: int, separator: int) -> Column:
    """Start offsets of the groups made by filling each group until the next item, plus its
    separator, would pass ``limit``. An item longer than the limit stands alone.

    Only lengths pass through the fold, so the accumulator holds integers and never text."""
    start = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).cast("int").alias("index"),
        F.lit(0).cast("long").alias("size"),
    )

    def step(acc, length):
        opens = (acc["index"] == 0) | (acc["size"] + separator + length > limit)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(acc["index"]))).otherwise(acc["starts"]).alias("starts"),
            (acc["index"] + 1).cast("int").alias("index"),
            F.when(opens, length.cast("long")).otherwise(acc["size"] + separator + length).cast("long").alias("size"),
        )

    return F.aggregate(lengths, start, step, lambda acc: acc["starts"])


def joined_groups(items: Column, starts: Column, separator: str) -> Column:
    """Texts of the groups that begin at ``starts``."""
    def groups(begin):
        def text(start, i):
            end = F.coalesce(F.get(begin, i + 1), F.size(items))
            return F.array_join(F.slice(items, start + 1, end - start), separator)
        return F.transform(begin, text)

    return let(starts, groups)


def hard_slices(text: Column, width: int) -> Column:
    last = F.floor((F.length(text) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / CHARS_PER_TOKEN))


def content_hash(content: Column) -> Column:
    """64-hex SHA-256 of a text's UTF-8 bytes or of binary content."""
    return F.sha2(content, 256)


def stable_id(*parts: Column) -> Column:
    """32-hex id of identity parts. NULL parts count as empty, since ``concat_ws`` would drop
    them and let two identities meet."""
    if not parts:
        raise ValueError("stable_id needs at least one identity part")
    joined = F.concat_ws(ID_SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 32)
