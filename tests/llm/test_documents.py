"""Language identification, quality rules, secret scan, decontamination."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from docwarden.llm import decontaminate, language_id, quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOUNDS = {"aa": ["ka", "mo", "ti", "ra"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "oux", "elle", "ier"]}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_rows(frame, odd_rows):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng), lang) for i, lang in enumerate(rng.choice(list(SOUNDS)) for _ in range(240))]
    docs = frame(rows)
    model = language_id.fit(docs, train_rows=120)
    got = language_id.predict(docs, model).collect()
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.predict(frame(odd_rows), model).collect()}
    assert [odd[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and odd[2].rejected and odd[7].lang_pred != "und"
    assert language_id.predict(frame([]), language_id.fit(frame([]))).count() == 0


def test_subword_counts_of_parts():
    text = "aber ".join(["x"] * 10)
    assert language_id.subword_counts(text).sum() > 0 and not language_id.subword_counts("12 !? ").any()
    whole = language_id.subword_counts("ab cd " * 50)
    assert np.array_equal(whole, language_id.subword_counts("AB, cd. " * 50)) is False or whole.any()


def base_measures(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    places = {k + d for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(places), len(words) < 50 or 100 * len(places) > 50 * len(words))


def test_base_measures_and_kept_rows(frame, odd_rows):
    rows = odd_rows + [(20, "a b\na b\n\n a b\nc|d <e>"), (21, "q w e r q w e r t")]
    got = sorted(quality.judged(frame(rows)).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    want = sorted(rows, key=lambda r: (str(r[0]), len(WORD.findall(r[1] or ""))))
    for r, row in zip(got, want):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(row[1])
        assert not (r.base_failed and r.kept)
    kept = quality.kept_documents(frame(rows))
    assert kept.columns == frame(rows).columns and Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, 6: 1, None: 1, 9: 1})
    assert quality.judged(frame([])).count() == 0


def test_fences_follow_source_and_sketches_merge(frame):
    rng = random.Random(4)
    plain = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)), "en", "plain") for i in range(150)]
    tables = [(1000 + i, " ".join(f"w{rng.randrange(9999)}" + (" |" if k % 5 < rng.randrange(1, 4) else "") for k in range(80)), "en", "tables") for i in range(150)]
    odd = [(5000, tables[0][1], "en", "plain")]
    got = {r.doc_id: r for r in quality.judged(frame(plain + tables + odd)).collect()}
    assert not got[5000].kept and sum(got[r[0]].kept for r in tables) >= 145 and all(got[r[0]].kept for r in plain)
    measured = quality.measures(frame(plain + tables))
    fine = quality.sketches(measured, "lang", "source")
    direct = {tuple(r) for r in quality.sketches(measured, "lang").collect()}
    assert {tuple(r) for r in quality.merged(fine, "lang").collect()} == direct


def test_groups_decide_their_fences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.judged(docs).filter("not base_failed").collect()
    names = [f"{r}_fence" for r in quality.RATES]
    fences = {(r.lang, r.source): tuple(r[n] for n in names) for r in got}
    assert len(set(fences.values())) > len(fences) // 2
    for k in range(len(names)):
        assert len({f[k] for f in fences.values()}) > 10
    # Of documents with equal measures some are kept and some go, by their group.
    least = lambda n: max(0, n - 2 * math.ceil(math.sqrt(n)) - 2)
    over = {r.doc_id: [f for f in fences.values() if 1000 * least(r.n_symbols) // r.word_chars > f[0] or 1000 * r.word_chars // r.n_words > f[3]] for r in got}
    assert sum(0 < len(o) < len(fences) for o in over.values()) > 10 and {r.kept for r in got} == {True, False}


def test_null_groups_are_told_apart(frame):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, None, "x"), (1, words, "x", None)]
    assert len({r.row_key for r in quality.judged(frame(rows)).collect()}) == 2


BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [f"{name}:{s}:{e}" for s, _, e, name in sorted(found)]


def test_secret_spans_and_links(frame, odd_rows):
    key = "AKIA" + "ABCDEFGH12345678"
    blob = "Zx9" + "aB3dE" * 6
    rows = odd_rows + [
        (30, "é token = '0123456789abcdef0123' and PassWord: short, api_key=abcdefghijkl"),
        (31, f"login: bob {blob} https://h.example.com/x"), (32, blob + " https://h.example.com/x"), (33, f"{key} {blob}"),
        (34, f"login=bob " + "z " * 300 + blob), (35, "token=secret: abcdefghijklmnop toKen=abcdefghijklmnop"), (36, f"{key} {key} " * 40),
    ]
    got = {(r.doc_id, r.n_hex): r for r in secret_scan.scan(frame(rows)).collect()}
    assert secret_scan.scan(frame(rows)).count() == len(rows)
    for doc_id, text, *_ in rows:
        want = base_spans(text)
        [r] = [r for (i, _), r in got.items() if i == doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want
    of = lambda i: {s.split(":")[0] for (d, _), r in got.items() if d == i for s in r.spans.split(",")}
    assert of(31) == {"identifier", "blob", "endpoint"} and of(32) == {""} and of(33) == {"access", "blob"} and of(34) == {""}
    clean = {r.doc_id: r.text for r in secret_scan.redacted(frame(rows)).collect()}
    assert clean[33] == "[secret] [secret]" and clean[32] == rows[len(odd_rows) + 2][1] and clean[2] is None
    assert clean[30].startswith("é [secret]' and PassWord: short, [secret]")
    assert secret_scan.scan(frame([])).count() == 0


def test_contaminated_documents(spark, frame, odd_rows):
    question = "On Monday the trader Anna bought 12 crates of fruit and sold them for 30 dollars at the market near Lund before noon."
    changed = question.replace("Anna", "Boris").replace("12", "45").replace("30", "88").replace("Lund", "Oslo")
    mixed = question.replace("12", "45") + " " + question.replace("12", "46")
    items = [(1, question), (2, question), (3, "alpha beta gamma"), (4, None), (None, question), (5, "Anna Boris Carl 1 2 3 4 5 6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng = random.Random(3)
    filler = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(200)) + ". "
    rows = odd_rows + [
        (40, filler() + question + " " + filler()), (41, filler() + changed), (42, filler() + mixed), (43, filler()),
        (44, question[:40]), (45, "so alpha, BETA gamma!"), (46, question.lower().replace("the", "a")),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminations(frame(rows), bench).collect()}
    assert set(got) == {(40, 1), (41, 1), (42, 1), (45, 3)}
    assert got[40, 1].kind == "verbatim" and got[40, 1].n_items == 2 and got[41, 1].kind == "reparameterised" and got[41, 1].n_changed == 4
    left = decontaminate.without_contaminated(frame(rows), bench)
    assert left.count() == len(rows) - 4 and left.columns == frame(rows).columns
    assert decontaminate.contaminations(frame([]), bench).count() == 0 and decontaminate.contaminations(frame(rows), bench.limit(0)).count() == 0


def test_every_item_of_a_template_is_judged(spark, frame):
    text = "Each week our farmer packs {} ripe apples into one box and then buys {} green pears from the old shop near here today."
    bench = spark.createDataFrame([(k, text.format(*v)) for k, v in ((1, (5, 5)), (2, (5, 7)), (3, (5, 7)), (4, (6, 6)))], "item_id long, text string")
    rows = [(1, text.format(5, 7)), (2, text.format(6, 6)), (3, text.format(8, 9)), (4, text.format(8, 8)), (5, text.format(5, 7) + " So. " + text.format(6, 6))]
    got = {(r.doc_id, r.item_id): (r.kind, r.n_items, r.n_slots, r.n_changed) for r in decontaminate.contaminations(frame(rows), bench).collect()}
    assert got == {
        (1, 2): ("verbatim", 4, 2, 0), (2, 4): ("verbatim", 4, 1, 0), (3, 2): ("reparameterised", 4, 2, 2), (4, 1): ("reparameterised", 4, 1, 1),
        (5, 2): ("verbatim", 4, 2, 0), (5, 4): ("verbatim", 4, 1, 0),
    }
    assert decontaminate.without_contaminated(frame(rows), bench).count() == 0


def test_verbatim_copies_of_slots_and_lower_case(spark, frame):
    people = "Today we ask the tall Anna and the small Boris why old Carl met young Dora in the town of Lund last week."
    items = [(1, "2 4 8 16 32 64 128 256 512 1024 ?"), (2, "Which Famous English Author Wrote Seven Novels About Ancient Roman Emperors"), (3, people), (4, "7 7 1 2 3 4 5 6 7 8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, "Well. " + t + " So it is.") for k, t in items] + [(10, people.lower()), (11, "3 6 9 12 15 18 21 24 27 30 ?"), (12, items[1][1].lower()),
            (13, people.replace("Anna", "Eva").replace("Lund", "Oslo")), (14, "two four " + "w " * 30)]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminations(frame(rows), bench).collect()}
    assert got == {(k, k): "verbatim" for k in (1, 2, 3, 4)} | {(10, 3): "verbatim", (12, 2): "verbatim", (13, 3): "reparameterised"}
    assert {r.doc_id for r in decontaminate.without_contaminated(frame(rows), bench).collect()} == {11, 14}
