"""Hard-negative mining: for an anchor and each of its positives the rows of other labels that score a little below.

Scores are integer inner products of quantised vectors, and exact. Most pairs are ruled out before that: an orthogonal
rotation on the principal axes puts most of a vector's length in its leading components, so a product over these is
close to the whole one, and what it lacks is at most the product of the lengths of the rests. The bound carries slack
for the rounding of floating point numbers, so nothing is lost. Anchors come in blocks of bounded size, which are
broadcast one after the other; all rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspark.llm.shared import picked, remove, shared_root, ship, stored

#: Bytes of anchors that are broadcast at once (two forms of their vectors).
BLOCK_BYTES = 16 << 20
#: The axes are found from about this many rows. They decide what is ruled out early, never a result.
AXES_ROWS = 10_000
#: Pairs that are held at once by a task.
PAIRS = 1 << 18
#: Scores outside this range count as its ends, so that their multiples fit 64 bits.
LIMIT = (1 << 63) // 100 - 1
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


#: Shares of the sample's squared length that the leading components hold where a product is looked at.
SHARES = (0.5, 0.75, 0.9)


def principal_axes(sample: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Columns: orthonormal axes, those with the largest second moments first. And after how many components a product
    is looked at."""
    energy, axes = np.linalg.eigh(sample.T @ sample)
    share = np.cumsum(np.maximum(energy[::-1], 0)) / max(float(np.maximum(energy, 0).sum()), 1e-300)
    return np.ascontiguousarray(axes[:, ::-1]), sorted({min(len(axes), int(np.searchsorted(share, s)) + 1) for s in SHARES})


class Turned:
    """Vectors (integers, as doubles) on the axes: leading components, the lengths of the rests, and exact ones."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray, ends: list[int]):
        self.vectors, self.turned, self.ends = vectors, vectors @ axes, ends
        squares = np.cumsum(np.square(self.turned)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1)
        self.rests = np.sqrt(rest[:, self.ends])
        self.lengths = np.sqrt(np.square(vectors).sum(axis=1))
        self.largest = float(np.abs(vectors).max(initial=0))


def slack(axes: np.ndarray) -> float:
    """How far a bound may be off by rounding, as a share of the product of both lengths: far more than the errors of
    rotation, sums and roots, and what the axes lack to orthogonality."""
    width = len(axes)
    return 16 * (width + 4) ** 2 * 2.0**-53 + 4 * float(np.abs(axes.T @ axes - np.eye(width)).sum())


def may_score(anchors: Turned, rows: Turned, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of wanted (a matrix) whose product may lie between low and high, which are given by anchor.

    Components are added for all pairs while over a quarter of them is left, then for those that are left."""
    slackened, low_, high_, kept, end = loose * np.outer(anchors.lengths, rows.lengths), low[:, None], high[:, None], wanted, 0
    product, step = np.zeros(wanted.shape), 0
    while step < len(anchors.ends) and (not step or np.count_nonzero(kept) * 4 > kept.size):
        more = anchors.ends[step]
        product += anchors.turned[:, end:more] @ rows.turned[:, end:more].T
        reach = np.outer(anchors.rests[:, step], rows.rests[:, step]) + slackened
        kept = kept & (product + reach >= low_) & (product - reach <= high_)
        end, step = more, step + 1
    a, r = np.nonzero(kept)
    product = product[kept]
    for i, more in enumerate(anchors.ends[step:], step):
        for at in range(0, len(a), PAIRS // 8):
            part = slice(at, at + PAIRS // 8)
            product[part] += np.einsum("ij,ij->i", anchors.turned[a[part], end:more], rows.turned[r[part], end:more])
        reach = anchors.rests[a, i] * rows.rests[r, i] + loose * anchors.lengths[a] * rows.lengths[r]
        left = (product + reach >= low[a]) & (product - reach <= high[a])
        a, r, product, end = a[left], r[left], product[left], more
    return a, r


def exact_scores(anchors: Turned, rows: Turned, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products, within LIMIT."""
    width, out = anchors.vectors.shape[1], np.zeros(len(a), np.int64)
    small = width * anchors.largest * rows.largest < LIMIT
    step = max(1, PAIRS // max(width, 1))
    for at in range(0, len(a), step):
        left, right = anchors.vectors[a[at : at + step]], rows.vectors[r[at : at + step]]
        if small:
            out[at : at + step] = np.einsum("ij,ij->i", left.astype(np.int64), right.astype(np.int64))
        else:
            sums = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(left, right, strict=True)]
            out[at : at + step] = [max(-LIMIT, min(LIMIT, s)) for s in sums]
    return out


class Best:
    """The first k of what each slot was given, by higher score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.ids, self.scores = k, np.full((slots, k), LAST), np.full((slots, k), NONE)

    @property
    def least(self) -> np.ndarray:
        """What a newcomer has to reach in each slot."""
        return self.scores[:, -1]

    def add(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores > self.least[slots]) | ((scores == self.least[slots]) & (ids < self.ids[slots, -1]))
        slots, ids, scores = slots[fit], ids[fit], scores[fit]
        if not len(slots):
            return
        touched = np.unique(slots)
        slots = np.concatenate([np.repeat(touched, self.k), slots])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -np.maximum(scores, -LAST), slots))  # empty places last; -NONE would overflow
        slots, ids, scores = slots[order], ids[order], scores[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(slots)) + 1])
        place = np.arange(len(slots)) - np.repeat(first, np.diff(np.append(first, len(slots))))
        kept = place < self.k
        self.ids[slots[kept], place[kept]], self.scores[slots[kept], place[kept]] = ids[kept], scores[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores != NONE)
        return slot, self.ids[slot, place], self.scores[slot, place]


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of `width`; missing components are zero."""
    sizes = np.diff(lists.offsets.to_numpy())
    out, flat = np.zeros((len(lists), width)), lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pieces(batches: Iterator[pa.RecordBatch], axes: np.ndarray, ends: list[int], step: int):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), Turned(dense(part.column("q"), len(axes)), axes, ends)


def _parts(vectors: np.ndarray, axes: np.ndarray, ends: list[int], step: int):
    """Anchors in parts that a task compares with a piece of its rows at once."""
    return [(slice(at, at + step), Turned(vectors[at : at + step], axes, ends)) for at in range(0, len(vectors), step)]


def _limits(best: np.ndarray) -> np.ndarray:
    return np.where(best == NONE, -np.inf, best)


def mine_hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). is_anchor is a condition on the column id. An anchor's positives are the first
    `positives` other rows of its label by higher score, then smaller id; for each of them come the first `negatives`
    rows of other labels whose score is between `low` and `high` per cent of the positive's, both included.

    Rows take no part whose id, label or vector is null, or which have a null or not finite component (before or after
    scaling). A shorter vector counts as filled up with zeros. Every row counts by itself, also where ids repeat, but
    rows with an anchor's own id are neither its positives nor its negatives. Scores beyond some 9 * 10^16 count as that.
    Identifiers and labels are integers; an empty table or one without anchors gives no rows; other columns are not
    read. The number of components is that of a model (a square matrix of it must fit a task)."""
    spark = embeddings.sparkSession
    ship(spark)
    root = shared_root(spark)
    scaled = F.expr(f"transform(v, x -> {scale} * cast(x as double))")
    rows = picked(embeddings, id=id_col, v=vector_col, label=label_col).where("id is not null and label is not null and v is not null")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    # floor of a double is a long in SQL; beyond 2^53 every double is whole already.
    rows = stored(rows.select("id", "label", F.expr("transform(v, x -> if(abs(x) < 9007199254740992, cast(floor(x) as double), x))").alias("q")), f"{root}/rows")
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    width = max(width, 1)
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    sample = numbered.where(F.pmod(F.xxhash64("n"), F.lit(max(1, total // AXES_ROWS))) == 0).select("q").toArrow().column("q").combine_chunks()
    axes, ends = principal_axes(dense(sample, width) if len(sample) else np.eye(width))
    loose = slack(axes)

    in_block = max(64, block_bytes // (16 * width))
    count = rows.where(is_anchor).count()
    blocks = -(-count // in_block)
    if blocks:
        dealt = numbered.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)))
        dealt.repartition("block").write.partitionBy("block").parquet(f"{root}/anchors")
    step = max(64, min(1024, (8 << 20) // (8 * width)))

    for number in range(blocks):
        block = spark.read.schema("id long, label long, q array<double>, n long, block int").parquet(f"{root}/anchors").where(F.col("block") == number).select("id", "label", "q").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
        vectors = dense(block.column("q").combine_chunks(), width)
        shipped = spark.sparkContext.broadcast((ids, labels, vectors, axes))

        def first(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, labels, vectors, axes = shipped.value
            best, parts = Best(len(ids), positives), _parts(vectors, axes, ends, step)
            for own, label, piece in _pieces(batches, axes, ends, PAIRS // step):
                for part, anchors in parts:
                    wanted = (labels[part, None] == label) & (ids[part, None] != own)
                    a, r = may_score(anchors, piece, wanted, _limits(best.least[part]), np.full(len(anchors.vectors), np.inf), loose)
                    best.add(a + part.start, own[r], exact_scores(anchors, piece, a, r))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["slot", "id", "score"])

        order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
        chosen = rows.mapInArrow(first, "slot long, id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).toArrow()  # at most `positives` an anchor of the block
        slots = chosen.column("slot").to_numpy() * positives + chosen.column("rank").to_numpy() - 1
        pos_ids, scores = np.full(len(ids) * positives, LAST), np.full(len(ids) * positives, NONE)
        pos_ids[slots], scores[slots] = chosen.column("id").to_numpy(), chosen.column("score").to_numpy()
        there = scores != NONE
        known = np.where(there, scores, 0)
        lows, highs = np.where(there, -(-low * known // 100), LAST), np.where(there, high * known // 100, NONE)
        windows = spark.sparkContext.broadcast((pos_ids, scores, lows, highs))

        def second(batches: Iterator[pa.RecordBatch], shipped=shipped, windows=windows) -> Iterator[pa.RecordBatch]:
            ids, labels, vectors, axes = shipped.value
            pos_ids, scores, lows, highs = windows.value
            best, parts = Best(len(lows), negatives), _parts(vectors, axes, ends, step)
            most = _limits(highs).reshape(-1, positives).max(axis=1)
            for own, label, piece in _pieces(batches, axes, ends, PAIRS // step):
                for part, anchors in parts:
                    wanted = (labels[part, None] != label) & (ids[part, None] != own)
                    slots = slice(part.start * positives, (part.start + len(anchors.vectors)) * positives)
                    least = np.maximum(lows[slots], best.least[slots]).astype(np.float64).reshape(-1, positives).min(axis=1)
                    a, r = may_score(anchors, piece, wanted, least, most[part], loose)
                    found = exact_scores(anchors, piece, a, r)
                    for j in range(positives):
                        slot = (a + part.start) * positives + j
                        fit = (found >= lows[slot]) & (found <= highs[slot])
                        best.add(slot[fit], own[r[fit]], found[fit])
            slot, found, score = best.rows()
            columns = [pa.array(x) for x in (slot, ids[slot // positives], pos_ids[slot], found, scores[slot], score)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        order = Window.partitionBy("slot").orderBy(F.desc("negative_score"), "negative_id")
        pairs = rows.mapInArrow(second, "slot long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{root}/found/block={number}")
        shipped.unpersist(), windows.unpersist()
    if not blocks:
        return spark.createDataFrame([], FOUND)
    remove(spark, f"{root}/rows", f"{root}/anchors")
    return spark.read.schema(f"{FOUND}, block int").parquet(f"{root}/found").drop("block")
