import random
import re

import numpy as np

import docwarden.llm.components as linked
from docwarden.llm import jaccard_join
from docwarden.llm.components import components
from docwarden.llm.filters import BITS, bit_filter
from docwarden.llm.jaccard_join import one_of_each, similarity_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    found = {}
    for doc_id, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return found


def model(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_groups_chains_and_passages(frame):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows, doc_id = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 20, 80, 150]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
            base = words if rng.random() < 0.6 else base  # chains: the ends need not be similar
    rows += [(doc_id + k, " ".join(passage + [f"u{k}_{i}" for i in range(25)])) for k in range(25)]
    rows += [(900, "A b C"), (901, "a B c"), (902, "a b"), (903, ""), (904, None)]
    got = similarity_components(frame(rows))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == model(rows)
    left = {r.doc_id for r in one_of_each(frame(rows)).collect()}
    assert left == {i for i, _, c in model(rows) if i == c}


def test_odd_rows(frame, odd_rows):
    got = sorted((tuple(r) for r in similarity_components(frame(odd_rows)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert len(got) == len(odd_rows)
    by_id = {r[0]: r for r in got}
    assert by_id[6][2] == 1 and by_id[1][2] == 1 and by_id[2] == (2, 0, 2) and by_id[3] == (3, 0, 3) and by_id[None][2] is None
    assert by_id[9][2] == 1  # case does not count
    kept = one_of_each(frame(odd_rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "10", "None"])
    assert similarity_components(frame([])).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (5, 5), (None, 3)]
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 200: 100}


def test_components_take_no_round_for_stars_and_none_to_see_the_end(spark, monkeypatch):
    rounds, written = [], linked.written
    monkeypatch.setattr(linked, "written", lambda df, label: rounds.append(label) or written(df, label))

    def found(pairs):
        rounds.clear()
        got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        return got, rounds.count("stars")

    assert found([]) == ({}, 0)
    assert found([(1, 5), (5, 1), (7, 1), (3, 2), (3, 3)]) == ({5: 1, 7: 1, 3: 2}, 0)
    assert found([(1, 2), (2, 3)]) == ({2: 1, 3: 1}, 1)
    assert found([(1, 3), (2, 3)]) == ({2: 1, 3: 1}, 1)
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert found(pairs)[0] == {i: r for i, r in enumerate(root) if i != r}


def test_a_copied_text_leaves_other_texts_of_its_id(frame):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    got = similarity_components(frame([(3, a), (7, a), (7, b), (9, b + " tail"), (11, "c " + b), (20, "d e f g h i")]))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(3, 3), (7, 3), (9, 3), (11, 3), (20, 20)}


def exchanged(plan):
    """Rows written by all exchanges of an executed plan."""
    name, inner = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [plan.plan()]
    children = plan.children()
    rows = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return rows + sum(map(exchanged, inner + [children.apply(i) for i in range(children.size())]))


def test_bits_of_uncopied_documents_are_not_exchanged_to_leave_out_copies(spark, frame, monkeypatch):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(300)] + [(1000 + i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(4)]
    rows += [(1000, "another text under the id of a copy"), (2000, "Another text under the id OF a copy !")]
    seen, keys, limit = [], jaccard_join._keys, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(jaccard_join, "_keys", lambda bits: seen.append(bits) or keys(bits))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.doc_id, r.component_id) for r in similarity_components(frame(rows)).collect()}
        held = {r.doc_id for r in seen[0].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {(i, i) for i in range(300)} | {(1000 + i, i) for i in range(4)} | {(2000, 0)}  # it is near the other text of 1000
    assert held == set(range(300)) | {1000, 2000}  # of the id 1000, the text that is no copy
    assert exchanged(seen[0]._jdf.queryExecution().executedPlan()) < 30  # of 306 rows


def test_a_filter_is_fetched_in_one_job_however_many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context, group = spark.sparkContext, "a filter of 3,000 values"
    values = [k * 0x9E3779B97F4A7C15 % 2**63 for k in range(3000)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        found = bit_filter(spark.createDataFrame([(v,) for v in values], "value long"))
        jobs = context.statusTracker().getJobIdsForGroup(group)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    held = np.zeros(2**BITS, bool)
    held[np.array(values) % 2**BITS] = True
    assert (np.unpackbits(found, bitorder="little") == held).all()
    assert 1 <= len(jobs) <= 3  # the exchange's and the rows'
