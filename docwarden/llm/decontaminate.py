"""Benchmark decontamination by canonical templates.

Every word becomes a template token: a number, a unit after a number, and a name (a capitalised word
inside a sentence) become typed placeholders, their values kept as slots; any other word becomes itself
in lower case without punctuation at its ends. Windows of ``WINDOW`` tokens are hash-joined between
documents and benchmark in two forms: as template tokens, if at least half of them are words, and as
plain lower-case words, whatever they are. Along one alignment of a document with an item every slot
value of the item must stand for one value of the document; of alignments that break this only plain
windows count. A document is contaminated by an item when the windows of its alignments cover
``COVERAGE`` of all the item's windows or of those usable as templates: a verbatim copy if all slot
values are equal, else a re-parameterised one.

Documents and benchmark are of any size. Before the join the tasks drop windows that pass no bit filter
of the benchmark's windows, whose size is fixed. Windows are joined once per template, so that copies of
a question do not multiply the join. Alignments that may cover enough are then judged for each distinct
row of slot values of the template's items, and the item that fits best is reported: most windows, fewest
changed values, smallest item_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docwarden.llm.durable import written
from docwarden.llm.filters import bit_filter, passes
from docwarden.llm.words import Block, bits_to_long, blocks, record_batch, windows

WINDOW, COVERAGE = 8, 0.6
#: Words whose tokens a task remembers.
REMEMBERED = 400_000

#: Units that count as such after a number (fixed values).
UNITS = frozenset(
    b"% percent mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
    b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"usd eur dollar dollars cent cents euro euros pound pounds mph kmh km/h degree degrees meter meters metre metres gram grams".split()
)
_NUMBER, _UNIT, _NAME, _STOP, _EMPTY = 1, 2, 4, 8, 16
_NUMBER_FORM = re.compile(rb"[$+-]?(?:\xe2\x82\xac|\xc2\xa3)?[0-9][0-9.,:/]*%?")
_PUNCTUATION = b"\"'`.,;:!?()[]{}<>|*#&$_~-"
_PLACEHOLDERS = np.array([xxh3_64_intdigest(b"\0" + k) for k in (b"number", b"unit", b"name")], np.uint64)

#: An item: the hashes of its template and of its plain words; by place, the template hash of each window
#: (null: too few words); its slots' places and values.
_ITEM = pa.schema([
    ("id", pa.int64()), ("template", pa.int64()), ("vector", pa.int64()), ("size", pa.int32()), ("typed", pa.list_(pa.int64())),
    ("plain", pa.list_(pa.int64())), ("slot_at", pa.list_(pa.int32())), ("slot_is", pa.list_(pa.string())),
])
_ITEM_DDL = "id long, template long, vector long, size int, typed array<long>, plain array<long>, slot_at array<int>, slot_is array<string>"
_FOUND = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("hash", pa.int64()), ("slot_at", pa.list_(pa.int32())), ("slot_is", pa.list_(pa.string()))])
_FOUND_DDL = "id long, place int, hash long, slot_at array<int>, slot_is array<string>"


def _plain(word: bytes) -> bytes:
    """A word in lower case without punctuation at its ends."""
    core = word.strip(_PUNCTUATION)
    return (core.lower() if core.isascii() else core.decode("utf-8", "replace").lower().encode()) or word


class _Tokens:
    """Template tokens of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes, self.kinds = np.empty(0, np.uint64), np.empty(0, np.uint8)
        self.new: list[tuple[int, int]] = []

    def _add(self, word: bytes) -> int:
        core = word.strip(_PUNCTUATION)
        kind = 0
        if _NUMBER_FORM.fullmatch(core):
            kind |= _NUMBER
        elif core.lower() in UNITS:
            kind |= _UNIT
        if not kind & _NUMBER and core[:1].isupper() and core[1:].islower():
            kind |= _NAME
        elif core and core[0] >= 0x80 and not kind & _NUMBER:
            text = core.decode("utf-8", "replace")
            if text[0].isupper() and text[1:].islower():
                kind |= _NAME
        if word.rstrip(b"\"')]*").endswith((b".", b"!", b"?", b":")):
            kind |= _STOP
        if not core:
            kind |= _EMPTY
        self.known[word] = at = len(self.known)
        self.new.append((xxh3_64_intdigest(_plain(word)), kind))
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.__init__()
        get = self.known.get
        at = [get(w) for w in words]
        if None in at:
            at = [self.known[w] if w in self.known else self._add(w) for w in words]
            self.hashes = np.r_[self.hashes, np.array([h for h, _ in self.new], np.uint64)]
            self.kinds = np.r_[self.kinds, np.array([k for _, k in self.new], np.uint8)]
            self.new = []
        at = np.array(at, np.int64)
        return self.hashes[at], self.kinds[at]


def _templates(block: Block, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a block its template token's hash, its plain hash, and whether it is a slot."""
    hashes, kinds = tokens.of(block.words)
    first = np.zeros(len(hashes), bool)
    first[block.starts[block.counts > 0]] = True
    before = np.r_[np.uint8(0), kinds[:-1]]
    number = kinds & _NUMBER > 0
    unit = (kinds & _UNIT > 0) & (before & _NUMBER > 0) & ~first
    name = (kinds & _NAME > 0) & ~first & (before & _STOP == 0) & ~unit
    out = hashes.copy()
    for mark, kind in zip(_PLACEHOLDERS, (number, unit, name)):
        out[kind] = mark
    return out, hashes, number | unit | name


def _slots(block: Block, slots: np.ndarray, at: int, end: int) -> tuple[list[int], list[str]]:
    """Offsets and values of the slots among the words from ``at`` to ``end``."""
    places = (np.flatnonzero(slots[at:end]) + at).tolist()
    return [j - at for j in places], [_plain(block.words[j]).decode("utf-8", "replace") for j in places]


def _items(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Benchmark items with all their windows. One shorter than the window is one window."""
    tokens = _Tokens()
    for block in blocks(batches, block_words=1 << 16):
        template, plain, slots = _templates(block, tokens)
        rows = []
        for (item_id,), start, end in zip(block.keys, block.starts.tolist(), block.ends.tolist()):
            if end > start and item_id is not None:
                n = end - start
                size = min(n, window)
                filled = np.r_[0, np.cumsum(slots[start:end])]
                enough = 2 * (filled[size:] - filled[:-size]) <= size
                typed, exact = (bits_to_long(windows(x[start:end], size)).tolist() for x in (template, plain))
                whole = (int(bits_to_long(windows(x[start:end], n))[0]) for x in (template, plain))
                rows.append((item_id, *whole, size, [h if e else None for h, e in zip(typed, enough)], exact, *_slots(block, slots, start, end)))
        if rows:
            yield record_batch(_ITEM, *map(list, zip(*rows)))


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of every length in ``sizes`` that pass the filter: of template tokens with their slots, and of plain words."""
    tokens = _Tokens()
    for block in blocks(batches, block_words=1 << 16):
        template, plain, slots = _templates(block, tokens)
        filled = np.r_[0, np.cumsum(slots)]
        ids, owner = [k[0] for k in block.keys], block.owners()
        rows = []

        def add(places, hashes, size):
            for at, value in zip(places.tolist(), bits_to_long(hashes).tolist()):
                k = owner[at]
                rows.append((ids[k], at - int(block.starts[k]), value, *(_slots(block, slots, at, at + size) if size else ([], []))))  # size 0: plain

        for size in sizes:
            places = block.window_starts(size)
            if len(places):
                hashes = windows(template, size)[places]
                held = filled[places + size] - filled[places]
                hit = passes(found, hashes) & (2 * held <= size)
                add(places[hit], hashes[hit], size)
                filled_in = places[held > 0]  # other windows are the same in both forms
                hashes = windows(plain, size)[filled_in]
                hit = passes(found, hashes)
                add(filled_in[hit], hashes[hit], 0)
        if rows:
            yield record_batch(_FOUND, *map(list, zip(*rows)))


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document (doc_id, text) and benchmark item (item_id, text) that fits best
    where it stands: doc_id, item_id (the smallest of equal items), n_items (of its template), n_windows,
    n_matched, n_slots and n_changed (slot values of the item, and those of them that differ), kind
    (``verbatim`` or ``reparameterised``). The windows counted are all the item's or those usable as
    templates, whichever are covered better.

    Null and blank texts and null ids take no part. Rows that share an id are one document or item. Other
    columns are ignored."""
    spark = docs.sparkSession
    items = written(benchmark.select("item_id", "text").mapInArrow(lambda it: _items(it, window), _ITEM_DDL), "items")
    usable = F.filter(F.sequence(F.lit(0), F.size("typed") - 1), lambda p: F.get("typed", p).isNotNull())
    templates = items.groupBy("template").agg(
        F.countDistinct("id").alias("n_items"), F.any_value("size").alias("size"), F.any_value(usable).alias("usable"), F.any_value(F.size("plain")).alias("n_all"),
    )
    vectors = items.groupBy("template", "vector").agg(
        F.min("id").alias("item_id"), F.any_value("plain").alias("exact"), F.any_value("slot_at").alias("item_at"), F.any_value("slot_is").alias("item_is"),
    )
    forms = [items.select("template", F.posexplode(form).alias("item_place", "hash")) for form in ("typed", "plain")]
    known = written(forms[0].union(forms[1]).filter("hash is not null").distinct(), "known")
    sizes = [window, *sorted(r["size"] for r in items.filter(F.col("size") < window).select("size").distinct().collect())]  # fewer than ``window`` more
    shared = spark.sparkContext.broadcast(bit_filter(known.select("hash")))
    own = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(
        lambda it: _windows(it, sizes, shared.value), _FOUND_DDL).withColumnRenamed("id", "doc_id")
    slotted = F.size("slot_at") > 0
    values = F.zip_with("slot_at", "slot_is", lambda at, value: F.struct((at + F.col("item_place")).alias("at"), value.alias("is")))
    aligned = written(
        own.join(known, "hash").groupBy("doc_id", "template", (F.col("place") - F.col("item_place")).alias("shift")).agg(
            F.collect_set(F.when(~slotted, F.struct(F.col("item_place").alias("place"), "hash"))).alias("plain"),
            F.collect_set(F.when(slotted, F.col("item_place"))).alias("typed"),
            F.array_distinct(F.flatten(F.collect_set(F.when(slotted, values)))).alias("slots"),
        ),
        "aligned",
    )
    likely = (
        aligned.groupBy("doc_id", "template").agg(F.array_distinct(F.flatten(F.collect_set(F.array_union("plain.place", "typed")))).alias("places"))
        .join(templates, "template").filter(F.size("places") >= F.lit(coverage) * F.when(F.size("usable") > 0, F.size("usable")).otherwise(F.col("n_all")))
        .select("doc_id", "template", "size")
    )
    value = F.map_from_arrays("item_at", "item_is")
    judged = (
        aligned.join(likely, ["doc_id", "template"]).join(vectors, "template").withColumn("value", value)
        .withColumn("same", F.transform(F.filter("plain", lambda p: F.get("exact", p["place"]) == p["hash"]), lambda p: p["place"]))
        .withColumn("copied", F.transform(
            F.filter(F.map_entries("value"), lambda v: F.exists("same", lambda p: v["key"].between(p, p + F.col("size") - 1))),
            lambda v: F.struct(v["value"].alias("of"), v["value"].alias("is")),
        ))
        .withColumn("pairs", F.array_distinct(F.concat(F.transform("slots", lambda s: F.struct(F.element_at("value", s["at"]).alias("of"), s["is"].alias("is"))), "copied")))
        .withColumn("consistent", F.size(F.array_distinct("pairs.of")) == F.size("pairs"))
        .withColumn("places", F.when(F.col("consistent"), F.array_union("same", "typed")).otherwise(F.col("same")))
        .withColumn("pairs", F.when(F.col("consistent"), F.col("pairs")).otherwise(F.array_distinct("copied")))
        .filter(F.size("places") > 0)
        .withColumn("changed", F.size(F.filter("pairs", lambda p: p["of"] != p["is"])).cast("long"))
    )
    share = (
        judged.groupBy("doc_id", "template", "item_id").agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.max_by(F.struct(F.size("pairs").cast("long").alias("n_slots"), "changed"), F.struct(F.size("places"), -F.col("changed"), -F.col("shift"))).alias("best"),
            F.collect_list(F.struct("shift", F.size("places").alias("fits"), "changed")).alias("shifts"), F.sum("changed").alias("changes"),
        )
        .join(templates, "template")
        .withColumn("n_usable", F.size(F.array_intersect("places", "usable")))
        .withColumn("by_usable", (F.size("usable") > 0) & (F.col("n_usable") * F.col("n_all") >= F.size("places") * F.size("usable")))
        .withColumn("n_windows", F.when(F.col("by_usable"), F.size("usable")).otherwise(F.col("n_all")).cast("long"))
        .withColumn("n_matched", F.when(F.col("by_usable"), F.col("n_usable")).otherwise(F.size("places")).cast("long"))
        .filter(F.col("n_matched") >= F.lit(coverage) * F.col("n_windows"))
        .withColumn("n_slots", F.col("best.n_slots")).withColumn("n_changed", F.col("best.changed"))
    )
    reported = ["item_id", "n_items", "n_windows", "n_matched", "n_slots", "n_changed"]
    order = F.struct("s.fits", "n_matched", -F.col("s.changed"), -F.col("changes"), F.bitwise_not("item_id"))
    return (
        share.withColumn("s", F.explode("shifts"))
        .groupBy("doc_id", "template", "s.shift").agg(F.max_by(F.struct(*reported), order).alias("r"))
        .select("doc_id", "r.*").distinct()
        .withColumn("kind", F.when(F.col("n_changed") == 0, "verbatim").otherwise("reparameterised"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those of contaminated documents. Rows without an id stay."""
    return docs.join(contaminations(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
