"""A cell index over the corpus, for questions with a relevance threshold.

Vectors are grouped into cells around centroids, and each cell remembers the widest angle between
its centroid and a member. By the triangle inequality on angles, a cell whose centroid is further
from the question than that angle plus the angle of the threshold holds nothing relevant, so its
files need not be read. The hits are the same as those of the full scan, whatever the centroids;
good centroids only make the scan shorter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docwarden.operators import retrieval as R

MAX_CELLS = 4096

# Added to every angle bound, in radians, so that rounding cannot exclude a row.
_SLACK = 1e-6


def train_centroids(corpus: DataFrame, cells: int, *, seed: int = 7) -> np.ndarray:
    """Centroids of the whole corpus."""
    if not 1 < cells <= MAX_CELLS:
        raise ValueError(f"between 2 and {MAX_CELLS} cells")
    usable = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: ~F.isnan(x))
    vectors = corpus.where(usable).select("embedding")
    features = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=5, distanceMeasure="cosine").fit(features)
    return np.array(model.clusterCenters())


def assign_cells(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``angle`` (to the cell's centroid). A zero vector is in no cell: it is
    relevant to nothing."""
    shipped = corpus.sparkSession.sparkContext.broadcast(_unit(centroids))
    schema = T.StructType(corpus.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        units = shipped.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            known = np.isfinite(norms) & (norms > 0)
            cosine = np.divide(x, norms[:, None], out=np.zeros_like(x), where=known[:, None]) @ units.T
            nearest = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(n), nearest], -1.0, 1.0))
            columns = list(batch.columns) + [
                pa.array(nearest.astype(np.int32), mask=~known), pa.array(angle, mask=~known),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names + ["cell", "angle"])

    return corpus.where(F.col("embedding").isNotNull()).mapInArrow(run, schema)


def write_index(assigned: DataFrame, path: str) -> None:
    """One folder per cell. The rebalancing shuffle splits a cell that holds very many rows over
    several tasks and files."""
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cell_widths(assigned: DataFrame) -> dict[int, float]:
    """Widest angle per cell; at most ``MAX_CELLS`` entries. Keep it beside the index."""
    widest = assigned.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.max("angle").alias("width"))
    return {r["cell"]: r["width"] for r in widest.collect()}


def cells_to_read(vectors: np.ndarray, centroids: np.ndarray, widths: dict[int, float], threshold: float) -> list[int]:
    """Cells that may hold a row relevant to one of the question vectors."""
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    angles = np.arccos(np.clip(_unit(vectors) @ _unit(centroids).T, -1.0, 1.0))
    return sorted(c for c, width in widths.items() if (angles[:, c] <= reach + width + _SLACK).any())


def relevant_hits(
    queries: DataFrame,
    index: DataFrame,
    centroids: np.ndarray,
    widths: dict[int, float],
    *,
    threshold: float = R.RELEVANCE_THRESHOLD,
    k: int = R.CANDIDATE_POOL,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of :func:`retrieval.top_k` that pass ``threshold``, from the cells that can hold any."""
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def cells_of(batches):
        for batch in batches:
            vectors = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1 if batch.num_rows else 0)
            cells = cells_to_read(vectors, centroids, widths, threshold) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([int(c) for c in cells], pa.int32())], names=["cell"])

    cells = [r["cell"] for r in asked.select("embedding").mapInArrow(cells_of, "cell int").distinct().collect()]  # at most all cells
    hits = R.top_k(asked, index.where(F.col("cell").isin(cells)), k, carry=carry, keep_vectors_from=threshold)
    return hits.where(R.relevant(F.col("similarity"), threshold))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors, dtype=np.float64), where=norms > 0)
