"""Embedding near-duplicates by an exact metric range join (operator 2).

Vectors link within a label if their cosine reaches the threshold, that is, if
their unit vectors are no further apart than a radius. Equal vectors are one
class from the start. Pivots (classes drawn by hash) partition the unit sphere of
each large label: a class lives in the cell of its nearest pivot and is copied
into each earlier cell whose border it may see across, by the triangle inequality:
a partner in cell j is within the radius, so d(x, p_j) <= d(x, p_home) + 2 radius,
and x lies within the radius of the plane between the two pivots. Cells join by
themselves; one of many rows is compared by pairs of blocks. A task emits weighted
link counts and a spanning forest, never all pairs.

Pivots are bounded: only labels with more than a 1/1024 part of all classes get
any, and no label more than ``PIVOTS``; other labels are one cell each.

Defined cases: a null label, and a vector that is null, empty, zero or holds null
or non-finite components, links with nothing; vectors of unequal length never
link; repeated rows are copies of each other; a component without ids has a null
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paxcast.llm import common, graph
from paxcast.llm.op7_minhash import forest

PIVOTS = 64
CELL = 512  # classes that a pivot is drawn for
BLOCK = 1024
SLACK = 1e-7


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct linkable vectors with their number of rows and smallest id."""
    good = vectors.where("label is not null and size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    good = good.where("exists(vector, v -> v <> 0)")
    return good.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("vector").alias("vector"),
    ).withColumn("space", F.xxhash64("label", F.size("vector")))


def pivots_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by label (and length): at most 1024 * PIVOTS vectors."""
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(f"n > {2 * CELL} and n * 1024 > {total}").select(
        F.col("space").alias("s"), F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL)).alias("k"), "n")
    # Drawn by hash: a class is a candidate with twice the chance it needs.
    draw = F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = classes.join(large, F.col("space") == F.col("s")).where(draw < 2 * F.col("k") / F.col("n")).select("space", "class_id", "vector", "k")
    out: dict[int, list] = {}
    for row in drawn.orderBy("space", "class_id").collect():
        if len(out.setdefault(row.space, [])) < row.k:
            out[row.space].append(np.array(row.vector, np.float64))
    return {space: units(found) for space, found in out.items()}


def cells(classes: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(space, cell, home, class_id, copies, vector): each class in its own cell
    and in the earlier ones whose border is within reach."""
    between = {space: distances(p, p) for space, p in pivots.items()}

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            out = []
            for space, part in frame.groupby("space", sort=False):
                index = part.index.to_numpy()
                if space not in pivots:
                    out.append((index, np.zeros(len(part), np.int32), np.ones(len(part), bool)))
                    continue
                p, gaps = pivots[space], between[space]
                d = distances(units(part["vector"].tolist()), p)
                home = d.argmin(axis=1)
                own = d[np.arange(len(d)), home]
                plane = (d * d - (own * own)[:, None]) / np.maximum(2 * gaps[home], 1e-12)
                seen = (d <= own[:, None] + 2 * radius + SLACK) & (plane <= radius + SLACK)
                seen &= np.arange(len(p))[None, :] <= home[:, None]
                seen[np.arange(len(d)), home] = True
                row, cell = np.nonzero(seen)
                out.append((index[row], cell.astype(np.int32), cell == home[row]))
            if out:
                index = np.concatenate([o[0] for o in out])
                found = frame.loc[index, ["space", "class_id", "copies"]].reset_index(drop=True)
                found["cell"], found["home"] = np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])
                found["vector"] = [np.asarray(v, np.float64).tobytes() for v in frame.loc[index, "vector"]]
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return classes.select("space", "class_id", "copies", "vector").mapInArrow(
        run, "space long, class_id long, copies long, cell int, home boolean, vector binary")


def block_links(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, weight): a's linked rows in a block, and edges of a spanning
    forest (weight null)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, copies, home = frame["class_id"].to_numpy(), frame["copies"].to_numpy(), frame["home"].to_numpy()
        x = np.array([np.frombuffer(v, np.float64) for v in frame["vector"]])
        norm = np.linalg.norm(x, axis=1)
        linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
        linked &= home[:, None] | home[None, :]
        if frame["i"].iat[0] != frame["j"].iat[0]:  # pairs inside one block have a task of their own
            own = frame["own"].to_numpy()
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, False)
        weight = linked @ copies
        some = np.flatnonzero(weight)
        edges = forest(linked)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], [ids[i] for i, _ in edges]]).astype("int64"),
            "b": pd.array([*[None] * len(some), *(ids[j] for _, j in edges)], dtype="Int64"),
            "weight": pd.array([*weight[some].tolist(), *[None] * len(edges)], dtype="Int64")})

    blocks = members.groupBy("space", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, ["space", "cell"]).withColumn("own", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return dealt.groupBy("space", "cell", "i", "j").applyInPandas(run, "a long, b long, weight long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Direct links, component and verdict of every row."""
    vectors = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    # -0.0 and 0.0 are one value, in the class and in its hash.
    vectors = vectors.withColumn("class_id", F.xxhash64("label", F.expr("transform(vector, v -> v + double(0))")))
    classes = common.materialise(classes_of(vectors))
    radius = float(np.sqrt(2 - 2 * threshold))
    found = common.materialise(block_links(cells(classes, pivots_of(classes), radius), threshold))
    links = found.where("weight is not null").groupBy("a").agg(F.sum("weight").alias("links")).withColumnRenamed("a", "class_id")
    joined = graph.components(found.where("weight is null").select("a", "b")).withColumnRenamed("id", "class_id")
    labelled = classes.select("class_id", "copies", "least_id").join(links, "class_id", "left").join(joined, "class_id", "left").select(
        "class_id", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    labelled = common.materialise(labelled)
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(least, "component").select("class_id", "n_links", "component_id", F.lit(True).alias("linkable"))
    return vectors.select("vec_id", "class_id").join(ids, "class_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
