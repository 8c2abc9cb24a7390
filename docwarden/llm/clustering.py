"""Lloyd's clustering of integer vectors, sharded by dimension.

Vectors are cut into column blocks of ``WIDTH`` components. Rows travel in packets of at most ``PACKET``
vectors, and the table keeps one column per block, so that the task of a column block reads its own block
and no other. In each round

* a column-block task computes the exact partial squared distances of its block to its slices of the
  centroids,
* the blocks of a packet meet by its number, are added, and the smallest sum (the smaller number on ties)
  becomes each vector's cluster,
* each column block sums its own components per cluster and updates its own slice of the centroids.

The table is bucketed by packet, so that only partial distances and cluster numbers are shuffled, never the
vectors. What passes through the driver is bounded by the parameters: clusters times components.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.durable import new_path, shared_folder, written_to

COMPONENTS, WIDTH, PACKET = 64, 32, 2048
CLUSTERS, ROUNDS, SEED = 16, 3, 1
#: What a component becomes an integer by, and the bound of that integer: with it, a distance of 64 components
#: fits a long. Larger components (beyond about two million) count as the bound.
SCALE, BOUND = 64, 1 << 27

_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _blocks(components: int, width: int) -> list[tuple[int, int]]:
    return [(low, min(low + width, components)) for low in range(0, components, width)]


def integers(vectors: pa.ListArray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count (exactly ``components`` components, all finite), and their integers
    floor(64 * x) as a matrix."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kept = lengths == components
    flat = vectors.filter(pa.array(kept)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, components)  # a null becomes NaN
    finite = np.isfinite(values).all(axis=1)
    kept[np.flatnonzero(kept)[~finite]] = False
    return kept, np.clip(np.floor(values[finite] * SCALE), -BOUND, BOUND).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], components: int, blocks: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        kept, matrix = integers(batch.column(1), components)
        ids = batch.column(0).filter(pa.array(kept))
        for low in range(0, len(ids), PACKET):
            part = matrix[low : low + PACKET].astype("<i4")
            columns = [pa.array([part[:, a:b].tobytes()], pa.binary()) for a, b in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids[low : low + PACKET].to_pylist()], pa.list_(pa.int64())), *columns],
                names=["packet", "ids", *(f"block{k}" for k in range(len(blocks)))],
            )
            number += 1


def packets(vectors: DataFrame, components: int, width: int) -> DataFrame:
    """The table (packet, ids, block0, block1, ...), bucketed by packet in the shared folder."""
    blocks, spark = _blocks(components, width), vectors.sparkSession
    ddl = "packet long, ids array<long>, " + ", ".join(f"block{k} binary" for k in range(len(blocks)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        lambda b: _packed(b, components, blocks), ddl)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"packets_{uuid.uuid4().hex}"
    # Packets of one bucket are written by one task, so a bucket is one file.
    rows.repartition(buckets, "packet").write.bucketBy(buckets, "packet").option("path", new_path(shared_folder(spark), "packets")).saveAsTable(name)
    return spark.table(name)


def first_centroids(vectors: DataFrame, components: int, clusters: int, seed: int) -> np.ndarray:
    """The kept vectors with the smallest hash of ``seed:vec_id``, in ascending order; equal ids go by their
    components, and null ids hash as no digits."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("long"))
    rows = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") == components).filter(finite)
        .select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"), whole.alias("v"))
        .orderBy("hash", "v").limit(clusters).collect()
    )
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, components)


def _partial(batches: Iterator[pa.RecordBatch], slices: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per packet, the squared distances of one column block to the centroids' slices (clusters x width)."""
    for batch in batches:
        out = []
        for content in batch.column(1):
            part = np.frombuffer(content.as_py(), "<i4").astype(np.int64).reshape(-1, slices.shape[1])
            far = np.empty((len(part), len(slices)), "<i8")
            for k, centroid in enumerate(slices):
                gap = part - centroid
                far[:, k] = np.einsum("ij,ij->i", gap, gap)
            out.append(far.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["packet", "far"])


def _nearest(key, table: pa.Table, clusters: int) -> pa.Table:
    """Adds the column blocks of a packet; the smallest sum wins, the first of equal ones."""
    far = sum(np.frombuffer(x.as_py(), "<i8") for x in table["far"]).reshape(-1, clusters)
    cluster = far.argmin(axis=1)
    return pa.table({
        "packet": pa.array([key[0].as_py()], pa.int64()), "clusters": pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
        "distances": pa.array([far[np.arange(len(far)), cluster].astype("<i8").tobytes()], pa.binary()),
    })


def _sums(batches: Iterator[pa.RecordBatch], block: int, width: int, clusters: int) -> Iterator[pa.RecordBatch]:
    """One column block's sums and counts per cluster, over all packets of a task."""
    total, count = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64)
    for batch in batches:
        for content, chosen in zip(batch.column(0), batch.column(1)):
            part = np.frombuffer(content.as_py(), "<i4").astype(np.int64).reshape(-1, width)
            cluster = np.frombuffer(chosen.as_py(), "<i4")
            np.add.at(total, cluster, part)
            count += np.bincount(cluster, minlength=clusters)
    some = np.flatnonzero(count)
    for k in some.tolist():
        n = width
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(total[k], pa.int64()),
            pa.array([count[k]] * n, pa.int64()),
        ], names=["block", "cluster", "place", "total", "members"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cluster, distance in zip(*batch.columns):
            yield pa.RecordBatch.from_arrays([
                ids.values, pa.array(np.frombuffer(cluster.as_py(), "<i4")), pa.array(np.frombuffer(distance.as_py(), "<i8")),
            ], names=["vec_id", "cluster", "distance"])


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH
) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding; other columns are ignored): cluster, distance
    (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256.

    Null vectors, those of another length, and those with a null or non-finite component are left out.
    Repeated rows are vectors of their own; a null vec_id stays null. Ties go to the smaller cluster. With
    fewer vectors than clusters there are as many centroids as vectors; empty tables give no rows."""
    spark, blocks = vectors.sparkSession, _blocks(components, width)
    centroids = first_centroids(vectors, components, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    folder, table, k = shared_folder(spark), packets(vectors, components, width), len(centroids)

    def assigned() -> DataFrame:
        parts = [
            table.select("packet", f"block{n}").mapInArrow(lambda b, s=centroids[:, low:high].copy(): _partial(b, s), "packet long, far binary")
            for n, (low, high) in enumerate(blocks)
        ]
        return written_to(folder, reduce(DataFrame.union, parts).groupBy("packet").applyInArrow(
            lambda key, t: _nearest(key, t, k), "packet long, clusters binary, distances binary"), "assigned")

    def updated(now: DataFrame) -> np.ndarray:
        parts = [
            table.select("packet", f"block{n}").join(now.select("packet", "clusters"), "packet").select(f"block{n}", "clusters").mapInArrow(
                lambda b, n=n, w=high - low: _sums(b, n, w, k), "block int, cluster int, place int, total long, members long")
            for n, (low, high) in enumerate(blocks)
        ]
        # Whole shares of the sum, rounded down also below zero; at most clusters x components rows.
        total, members = F.sum("total"), F.sum("members")
        share = F.expr("cast((total - pmod(total, members)) div members as long)")
        rows = (
            reduce(DataFrame.union, parts).groupBy("block", "cluster", "place").agg(total.alias("total"), members.alias("members"))
            .select("block", "cluster", "place", share.alias("share")).collect()
        )
        out = centroids.copy()
        for r in rows:
            out[r["cluster"], blocks[r["block"]][0] + r["place"]] = r["share"]
        return out

    for _ in range(rounds):
        centroids = updated(assigned())
    final = table.select("packet", "ids").join(assigned(), "packet").select("ids", "clusters", "distances")
    rows = final.mapInArrow(_rows, "vec_id long, cluster int, distance long")
    found = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, found.get(c, 0), sum(found.values()), centroid_digest(centroids[c])) for c in range(k)]
    per_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per_cluster), "cluster").select(*(part.split()[0] for part in _RESULT.split(", ")))


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, over single components."""
    nearest = """
assigned{r} as (
    select n, cluster, far from (
        select n, cluster, far, row_number() over (partition by n order by far, cluster) as k
        from (select n, cluster, sum((x - c) * (x - c))::bigint as far from parts join centroids{r} using (place) group by n, cluster))
    where k = 1),"""
    update = """
moved{r} as (
    select cluster, place, ((s - ((s % m) + m) % m) // m)::bigint as c
    from (select cluster, place, sum(x)::bigint as s, count(*)::bigint as m from parts join assigned{r} using (n) group by cluster, place)),
centroids{next} as (select cluster, place, coalesce(m.c, o.c) as c from centroids{r} o left join moved{r} m using (cluster, place)),"""
    steps = "".join(nearest.format(r=r) + update.format(r=r, next=r + 1) for r in range(ROUNDS)) + nearest.format(r=ROUNDS)
    return f"""
with kept as (
    select row_number() over () as n, vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as v
    from embeddings
    where len(embedding) = {COMPONENTS} and len([x for x in embedding if x is not null and isfinite(x)]) = {COMPONENTS}),
parts as (select n, unnest(range({COMPONENTS})) as place, unnest(v) as x from kept),
starts as (
    select n, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as cluster
    from kept qualify cluster < {CLUSTERS}),
centroids0 as (select cluster, place, x as c from starts join parts using (n)),{steps}
digests as (select cluster, sha256(string_agg(c::varchar, ',' order by place)) as centroid_sha256 from centroids{ROUNDS} group by cluster)
select vec_id, cluster::int as cluster, far as distance, (sum(far) over (partition by cluster))::bigint as cluster_inertia,
       (sum(far) over ())::bigint as inertia, centroid_sha256
from assigned{ROUNDS} join kept using (n) join digests using (cluster)"""
