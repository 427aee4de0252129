"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform;
its hash is the axis, with sign, it then lies nearest to. A table joins ``hashes``
of them into a key. A vector is filed under its key and also looks into
``probes`` more keys of each table: those with one hash replaced by the next
nearest axis, least loss first. Pairs that meet, at least one of them filed
there, are verified by cosine in double precision.

Equal vectors of one label are one class with a count, so copies are never
compared. A pair that meets in several buckets is counted in one of them only,
which both sides derive from the vectors themselves; so buckets send link counts
and a spanning forest, never pairs. A bucket over ``bucket_rows`` is dealt into
blocks, and each pair of blocks is a task's group of its own.

Rows with a null label, a null id, or a vector that is null, empty, zero or holds
null or non-finite components link with nothing and stand for themselves. Vectors
of different lengths don't meet. Repeated rows are vectors of their own. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(n, tables, 1 + probes): the key a vector is filed under, then those it looks into; all differ."""
    n, d = x.shape
    width = 1 << max(0, d - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng([seed, width])
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best, second, loss = (np.empty((n, hashes), k) for k in (np.int64, np.int64, float))
        for j in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            rows, top = np.arange(n), size.argmax(axis=1)
            axis = lambda a, y=y, rows=rows: 2 * a + (y[rows, a] < 0)
            best[:, j], was = axis(top), size[rows, top].copy()
            if width > 1:
                size[rows, top] = -1
                nxt = size.argmax(axis=1)
                second[:, j], loss[:, j] = axis(nxt), was - size[rows, nxt]
            else:
                second[:, j], loss[:, j] = 1 - best[:, j], was
        place = (2 * width) ** np.arange(hashes, dtype=np.int64)
        main = (best * place).sum(axis=1)
        other = main[:, None] + (second - best) * place
        out[:, t, 0] = main
        out[:, t, 1:] = np.take_along_axis(other, np.argsort(loss, axis=1, kind="stable"), axis=1)[:, :probes]
    return out


def counted_here(ka: np.ndarray, kb: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a pair with these keys is counted in this bucket: the first table where they meet, the lower key there."""
    ab = (ka[:, :, :1] == kb).any(axis=2)  # b looks where a is filed
    ba = (kb[:, :, :1] == ka).any(axis=2)
    first = (ab | ba).argmax(axis=1)
    at = np.arange(len(ka))
    a, b = ka[at, first, 0], kb[at, first, 0]
    here = np.where(ab[at, first] & ba[at, first], np.minimum(a, b), np.where(ab[at, first], a, b))
    return (first == table) & (here == key)


def links(classes: DataFrame, cosine: float, tables: int, hashes: int, probes: int, seed: int, bucket_rows: int) -> DataFrame:
    """classes (node, label, copies, vector) -> rows (a, b, null): forest links; rows (a, null, n): vectors linked to a."""

    def files(light: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 5000):
                vectors = batch.column(3).to_pylist()
                widths = np.array([len(v) for v in vectors])
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    x = np.array([vectors[i] for i in at], np.float64)
                    k = keys(unit(x), tables, hashes, probes, seed)
                    n, _, p = k.shape
                    row = np.repeat(at, tables * p)
                    table = np.tile(np.repeat(np.arange(tables), p), n)
                    own = np.tile(np.arange(p) == 0, n * tables)
                    label = batch.column(1).to_numpy(zero_copy_only=False)[row].astype(np.int64)
                    cols = {"label": label, "width": np.full(len(row), width, np.int32), "t": table.astype(np.int32), "k": k.reshape(-1)}
                    if not light:
                        raw = [x[i].tobytes() for i in range(n)]
                        node, copies = (batch.column(c).to_numpy()[row] for c in (0, 2))
                        cols |= {"own": own, "node": node, "copies": copies, "raw": [raw[i] for i in np.repeat(np.arange(n), tables * p)]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()})

        return run

    bucket = ["label", "width", "t", "k"]
    shape = "label long, width int, t int, k long"
    hot = classes.mapInArrow(files(True), shape).groupBy(*bucket).count().where(F.col("count") > bucket_rows)
    hot = written(hot.select(*bucket, F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")), "hot")
    rows = classes.mapInArrow(files(False), shape + ", own boolean, node long, copies long, raw binary").join(hot, bucket, "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = [*bucket, "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ended(batch: pa.RecordBatch) -> np.ndarray:
            cols = [batch.column(c).to_numpy() for c in range(6)]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        def linked(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            starts = ended(batch)
            sizes = np.diff(np.append(starts, batch.num_rows))
            own = batch.column(6).to_numpy(zero_copy_only=False)
            good = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
            a, b, n = [], [], []
            for width in np.unique(batch.column(1).to_numpy()[starts[good]]):
                use = np.flatnonzero(good & (batch.column(1).to_numpy()[starts] == width))
                at = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in use])
                raw = batch.column(9).to_pylist()
                x = np.frombuffer(b"".join([raw[r] for r in at]), np.float64).reshape(len(at), width)
                x = unit(x)
                t, k, i, j = (batch.column(c).to_numpy()[at] for c in (2, 3, 4, 5))
                node, copies, block, is_own = batch.column(7).to_numpy()[at], batch.column(8).to_numpy()[at], batch.column(10).to_numpy()[at], own[at]
                all_keys = keys(x, tables, hashes, probes, seed)
                group_of = np.repeat(np.arange(len(use)), sizes[use])

                def tell(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """Of the pairs (p, q), those linked, and whether to count them here."""
                    ok = (is_own[p] | is_own[q]) & ((i[p] == j[p]) | (block[p] != block[q]))
                    p, q = p[ok], q[ok]
                    hit = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[hit], q[hit]
                    here = counted_here(all_keys[p], all_keys[q], t[p], k[p])
                    return p[here], q[here]

                found: list[tuple[np.ndarray, np.ndarray]] = []
                left, shift = np.flatnonzero(sizes[use][group_of] <= 64), 1
                while True:  # small buckets, all at once
                    left = left[left + shift < len(at)]
                    left = left[group_of[left] == group_of[left + shift]]
                    if not len(left):
                        break
                    found.append(tell(left, left + shift))
                    shift += 1
                for p, q in found:
                    a += [node[p], node[p], node[q]]
                    b += [node[q], np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)]
                    n += [np.zeros(len(p), np.int64), copies[q], copies[p]]
                bounds = np.append(0, np.cumsum(sizes[use]))
                for g in np.flatnonzero(sizes[use] > 64):
                    lo, hi = int(bounds[g]), int(bounds[g + 1])
                    total, label = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
                    for r in range(lo + 1, hi):
                        p = lo + np.flatnonzero(x[lo:r] @ x[r] >= cosine - 1e-9)
                        p, q = tell(p, np.full(len(p), r))
                        if len(p):
                            total[p - lo] += copies[r]
                            total[r - lo] += copies[p].sum()
                            for other in p[np.unique(label[p - lo], return_index=True)[1]]:
                                if label[other - lo] != label[r - lo]:
                                    a.append(node[r : r + 1])
                                    b.append(node[other : other + 1])
                                    n.append(np.zeros(1, np.int64))
                                    label[label == label[other - lo]] = label[r - lo]
                    some = np.flatnonzero(total)
                    a.append(node[lo + some])
                    b.append(np.zeros(len(some), np.int64))
                    n.append(total[some])
            join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            a, b, n = join(a), join(b), join(n)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n, mask=n == 0)], ["a", "b", "n"])

        kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names)  # noqa: PLW2901
            held.append(batch)
            kept += batch.num_rows
            if kept >= 4000:  # all but the last bucket, which may go on
                both = pa.Table.from_batches(held)
                last = int(ended(both.combine_chunks().to_batches()[0])[-1])
                if last:
                    yield linked(both.slice(0, last))
                    held, kept = both.slice(last).combine_chunks().to_batches(), both.num_rows - last
        if held:
            yield linked(pa.Table.from_batches(held))

    names = ["label", "width", "t", "k", "i", "j", "own", "node", "copies", "raw", "block"]
    dealt = rows.select(*names).repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(meet, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: int = 3, hashes: int = 3, probes: int = 3, seed: int = 7, bucket_rows: int = 4096,
) -> DataFrame:
    """A row for each vector: id, n_links, component_id (least id reachable), kept (it is that one)."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long", "boolean")
    label = F.when(vectors[label_col].isNotNull(), vectors[label_col].cast("long") if whole else F.xxhash64(vectors[label_col]))  # labels of other types by their hash
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumns({"node": F.when(F.col("sound"), F.xxhash64("label", "vector")), "check": F.when(F.col("sound"), F.xxhash64(F.lit("check"), "vector", "label"))})
    classes = rows.where("sound").groupBy("node", "check").agg(F.first("label").alias("label"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.min("id").alias("least"))
    classes = written(classes, "classes")
    met = written(links(classes.select("node", "label", "copies", "vector"), cosine, tables, hashes, probes, seed, bucket_rows), "links")
    counts = met.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(met.where("b is not null"))
    known = classes.select("node", "check", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known, "classes")  # read from files, a root of very many classes can be split in the join
    group = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(group, "root").select("node", "check", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = rows.select("id", "node", "check").join(known, ["node", "check"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
