"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors are brought to unit length in double precision; equal ones become one,
with a weight. Every vector goes to a shard by a hash; a shard's task builds a
layered graph, inserting vectors in batches whose searches advance together.
Graphs lie as files in the shared
folder; tasks that hold blocks of queries read every shard's, one after the other. A query's beam is widened while the
beam's last vector is still within the threshold, so a query in a dense cluster
gets all of it; and all beams are doubled until an audit, brute force for a bounded
sample of queries against all vectors, finds the wanted recall (of all links,
and as a mean over queries); if the widest beams do not reach it, the job fails.
What the search finds is verified by cosine in double precision. Each task returns
a count per query and a spanning forest of its links, never all pairs; components
of the forests are united. All links of a vector lie in its component, where they
are counted exactly, part against part.

Defined cases: null or
empty vectors, zero vectors and those with null or non-finite components link with
nothing and are kept; vectors of other lengths never meet; a null vec_id takes
part but is a component's id only if all its ids are null; repeated rows are equal
vectors; an empty table gives no rows. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import io
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, U64, mix, new_path, staged, store_uri
from .components import components, forest

#: Vectors of a shard at most, shards at least, vectors of a query block, blocks of a task.
SHARD, SHARDS, BLOCK, BLOCKS = 50_000, 8, 512, 32
#: Vectors of a part of a component.
PART = 1024
#: Queries of the audit, and the recall it asks for.
AUDIT, RECALL = 1024, 0.98

_INF = np.float32(np.inf)


def choose(vectors: np.ndarray, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` of each row's candidates (-1: none), sorted by similarity: first
    those nearer to the row's vector than to any chosen one, then the rest."""
    order = np.argsort(-np.where(cand < 0, -_INF, sims), axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, k = cand.shape
    there = cand >= 0
    x = vectors[np.maximum(cand, 0)]
    mutual = np.matmul(x, x.transpose(0, 2, 1))
    taken, apart, n = np.zeros((rows, k), bool), np.full((rows, k), -_INF), np.zeros(rows, int)
    for j in range(k):
        ok = there[:, j] & (apart[:, j] < sims[:, j]) & (n < width)
        taken[:, j] = ok
        n += ok
        apart = np.where(ok[:, None], np.maximum(apart, mutual[:, j]), apart)
    rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(np.where(there, cand, -1), rank, 1)
    return out if k >= width else np.pad(out, ((0, 0), (0, width - k)), constant_values=-1)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries together: (ids, similarities), best first, -1 where short."""
    rows, size = len(queries), len(links)
    ef = min(ef, size)
    ids, sims = np.full((rows, ef), -1, dtype=np.int32), np.full((rows, ef), -_INF, dtype=np.float32)
    seen = np.zeros((rows, size), bool)
    at = np.arange(rows)
    entry = entry[:, : ef]
    for c in range(entry.shape[1]):
        e = entry[:, c]
        new = (e >= 0) & ~seen[at, e]
        ids[new, c], seen[at[new], e[new]] = e[new], True
        sims[new, c] = np.einsum("ij,ij->i", vectors[e[new]], queries[new])
    done = np.zeros((rows, ef), bool)
    live = at
    step = max(1, ef // 24)  # vectors opened at once: wide beams open several
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), -_INF, sims[live])
        pick = open_.argmax(axis=1)[:, None] if step == 1 else np.argpartition(-open_, step - 1, axis=1)[:, :step]
        real = np.take_along_axis(open_, pick, 1) > -_INF
        more = real.any(axis=1)
        live, pick, real = live[more], pick[more], real[more]
        if not len(live):
            break
        done[live[:, None], pick] |= real
        near = np.where(real[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        if step > 1:  # two opened vectors may link to the same one
            _, one = np.unique(r * size + near[r, c], return_index=True)
            r, c = r[one], c[one]
            fresh = np.zeros_like(fresh)
            fresh[r, c] = True
        node = near[r, c]
        seen[live[r], node] = True
        got = np.full(near.shape, -_INF, dtype=np.float32)
        got[r, c] = np.einsum("ij,ij->i", vectors[node], queries[live[r]])
        all_s = np.concatenate([sims[live], got], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_d = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], done[live] = np.take_along_axis(all_i, best, 1), np.take_along_axis(all_s, best, 1), np.take_along_axis(all_d, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """A layered graph: layer ``l`` joins the first ``len(layers[l])`` vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray, width: int = 12, ef: int = 40, batch: int = 512) -> "Graph":
        """``vectors`` sorted by falling level."""
        self = cls(vectors, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            size, most = int((levels >= level).sum()), width * (2 if level == 0 else 1)
            links = np.full((size, most), -1, dtype=np.int32)
            done = 0
            while done < size:
                now = np.arange(done, min(size, done + (batch if done == 0 else min(batch, max(64, done)))))
                q = vectors[now]
                inner = q @ q.T
                np.fill_diagonal(inner, -_INF)
                k = min(ef, len(now) - 1)
                cand = np.full((len(now), 0), -1, dtype=np.int32)
                sims = np.zeros((len(now), 0), dtype=np.float32)
                if k > 0:
                    top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                    cand, sims = now[top].astype(np.int32), np.take_along_axis(inner, top, 1)
                if done:
                    start = self.enter(q, level, done)
                    ids, s = beam(vectors, links[:done], q, start, ef)
                    cand, sims = np.concatenate([cand, ids], axis=1), np.concatenate([sims, s], axis=1)
                if cand.shape[1]:
                    links[now] = choose(vectors, cand, sims, most)
                    self._back(links, now, most)
                done = int(now[-1]) + 1
            self.layers.insert(0, links)
        self.layers[0] = self._reachable(self.layers[0])
        return self

    @staticmethod
    def _reachable(links: np.ndarray, least: int = 4, room: int = 8) -> np.ndarray:
        """Vectors that fewer than ``least`` others link to get links from their own neighbours, in added columns."""
        size = len(links)
        lack = np.maximum(0, least - np.bincount(links[links >= 0], minlength=size))
        weak, used = np.flatnonzero(lack), np.zeros(size, dtype=np.int64)
        extra = np.full((size, room), -1, dtype=np.int32)
        for t in range(links.shape[1]):
            weak = weak[lack[weak] > 0]
            to = links[weak, t]
            of = weak[(to >= 0)]
            to = to[to >= 0]
            new = ~(links[to] == of[:, None]).any(axis=1)
            to, of = to[new], of[new]
            order = np.argsort(to, kind="stable")
            to, of = to[order], of[order]
            _, first, n = np.unique(to, return_index=True, return_counts=True)
            slot = used[to] + np.arange(len(to)) - np.repeat(first, n)
            fits = slot < room
            extra[to[fits], slot[fits]] = of[fits]
            np.add.at(used, to[fits], 1)
            lack[of[fits]] -= 1
        return np.concatenate([links, extra[:, : int(used.max(initial=0))]], axis=1)

    def enter(self, queries: np.ndarray, level: int, size: int) -> np.ndarray:
        """Where a search of layer ``level`` begins: what the layers above found among the first ``size``."""
        at = np.zeros((len(queries), 1), dtype=np.int32)
        above = len(self.layers) - 1
        for links in reversed(self.layers[len(self.layers) - above - 1 :] if above >= 0 else []):
            at, _ = beam(self.vectors, links, queries, at, 4)
        return np.where(at < size, at, 0 if size else -1)

    def _back(self, links: np.ndarray, now: np.ndarray, most: int) -> None:
        """Links from the new vectors' neighbours back to them; a full list is chosen anew."""
        own = links[now]
        r, c = np.nonzero(own >= 0)
        to, of = own[r, c], now[r].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        wide = int(n.max()) if len(n) else 0
        for a in range(0, len(nodes), 512):
            part = slice(a, a + 512)
            extra = np.full((len(nodes[part]), int(n[part].max())), -1, dtype=np.int32)
            for i, (f, k) in enumerate(zip(first[part], n[part], strict=True)):
                extra[i, :k] = of[f : f + k]
            held = links[nodes[part]]
            extra = np.where((extra[:, :, None] == held[:, None, :]).any(axis=2), -1, extra)
            cand = np.concatenate([held, extra], axis=1)
            x = self.vectors
            sims = np.einsum("ijk,ik->ij", x[np.maximum(cand, 0)], x[nodes[part]])
            if wide and cand.shape[1] > 4 * most:
                keep = np.argsort(-np.where(cand < 0, -_INF, sims), axis=1, kind="stable")[:, : 4 * most]
                cand, sims = np.take_along_axis(cand, keep, 1), np.take_along_axis(sims, keep, 1)
            links[nodes[part]] = choose(x, cand, sims, most)

    def search(self, queries: np.ndarray, ef: int, floor: float) -> list[np.ndarray]:
        """Ids found with similarity >= floor; beams that end above it are widened."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            at = np.zeros((len(todo), 1), dtype=np.int32)
            for links in reversed(self.layers[1:]):
                at, _ = beam(self.vectors, links, queries[todo], at, 4)
            step = max(1, (1 << 25) // max(1, len(self.vectors)))
            wider = []
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, sims = beam(self.vectors, self.layers[0], queries[part], at[a : a + step], ef)
                full = (sims[:, -1] >= floor) & (ids.shape[1] < len(self.vectors))
                for i, q in enumerate(part):
                    if not full[i]:
                        out[q] = ids[i][(ids[i] >= 0) & (sims[i] >= floor)]
                wider.append(part[full])
            todo, ef = np.concatenate(wider), 4 * ef
        return out


def levels_of(keys: np.ndarray, width: int = 12) -> np.ndarray:
    """Levels by a hash of the key: each is ``width`` times rarer than the one below."""
    u = ((mix(keys.view(np.uint64) * MULT) >> U64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.minimum(8, np.floor(-np.log(u) / np.log(width))).astype(np.int64)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, unit): key null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            key, dim, unit = [], [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], dtype=np.float64)
                top = np.abs(x).max(initial=0.0)
                ok = len(x) and np.isfinite(x).all() and top > 0
                if ok:
                    x = x / top
                    x = x / np.sqrt((x * x).sum())
                    x = x + 0.0  # no negative zeros
                data = x.tobytes() if ok else None
                key.append(xxhash.xxh3_64_intdigest(data) - (1 << 63) if ok else None)
                dim.append(len(x) if ok else None)
                unit.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], ["vec_id", "key", "dim", "unit"])

    return vectors.selectExpr("cast(vec_id as long) as vec_id", "embedding").mapInArrow(run, "vec_id long, key long, dim int, unit binary")


def build_graphs(reps: DataFrame, shards: int, folder: str) -> list[tuple[int, int, str]]:
    """Writes a file per shard, its vectors and the layers of its graph; returns (dim, shard, file).

    Every attempt of a task writes a file of its own name, and the committed row of an
    attempt names it, so files of lost attempts are never read.
    """
    uri = store_uri(reps.sparkSession, folder)

    def run(table):
        from pyarrow import fs

        keys = table["key"].to_numpy()
        level = levels_of(keys)
        order = np.argsort(-level, kind="stable")
        units = np.stack([np.frombuffer(x, dtype=np.float64) for x in table["unit"].to_pylist()])[order]
        graph = Graph.build(units.astype(np.float32), level[order])
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid4().hex}.npz"
        held = io.BytesIO()
        np.savez(held, keys=keys[order], weights=table["weight"].to_numpy()[order].astype(np.int64), units=units, **{f"layer{i}": x for i, x in enumerate(graph.layers)})
        with store.open_output_stream(name, compression=None) as out:
            out.write(held.getvalue())
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1], "file": pa.array([name])})

    placed = reps.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    files = staged(placed.select("dim", "shard", "key", "weight", "unit").groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, file string"), "hnsw-files")
    return sorted(tuple(r) for r in files.collect())


def load_graph(store, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """(keys, weights, unit vectors, graph) of a shard's file."""
    with store.open_input_file(name) as f:
        data = np.load(io.BytesIO(f.read()))
    layers = [data[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in data.files))]
    return data["keys"], data["weights"], data["units"], Graph(data["units"].astype(np.float32), layers)


def query_blocks(reps: DataFrame) -> DataFrame:
    """Stored blocks of queries of one length: (dim, block, keys, units)."""

    def run(batches):
        held: dict[int, list] = {}

        def row(dim):
            rows = held.pop(dim)
            return {"dim": dim, "block": int(xxhash.xxh3_64_intdigest(rows[0][1]) >> 1), "keys": np.array([k for k, _ in rows], dtype=np.int64).tobytes(), "units": b"".join(u for _, u in rows)}

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                held.setdefault(x["dim"], []).append((x["key"], x["unit"]))
                if len(held[x["dim"]]) >= BLOCK:
                    out.append(row(x["dim"]))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist([row(d) for d in list(held)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("units", pa.binary())])
    return staged(reps.select("dim", "key", "unit").mapInArrow(run, "dim int, block long, keys binary, units binary"), "hnsw-queries")


def _searched(files: list[tuple[int, int, str]], blocks: DataFrame, folder: str, ef: int, cosine: float) -> DataFrame:
    """(a, b, n): for b null, a's query found n vectors in a shard; else a link of a forest.

    A task holds ``BLOCKS`` blocks of queries at a time and reads the shards' graphs
    one after the other, so neither graphs nor queries are shuffled.
    """
    uri = store_uri(blocks.sparkSession, folder)

    def search(store, held):
        for dim, _, name in files:
            mine = [b for b in held if b["dim"] == dim]
            if not mine:
                continue
            keys, weights, units, graph = load_graph(store, name)
            a, n, ends = [], [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for b in mine:
                own = np.frombuffer(b["keys"], dtype=np.int64)
                q = np.frombuffer(b["units"], dtype=np.float64).reshape(len(own), -1)
                u, v = [ends[0]], [ends[1]]
                for i, hits in enumerate(graph.search(q.astype(np.float32), ef, cosine - 1e-4)):
                    hits = hits[(keys[hits] != own[i])]
                    hits = hits[units[hits] @ q[i] >= cosine]
                    if len(hits):
                        a.append(own[i])
                        n.append(int(weights[hits].sum()))
                        u.append(np.full(len(hits), own[i]))
                        v.append(keys[hits])
                ends = forest(np.concatenate(u), np.concatenate(v)) if sum(map(len, u)) else ends
            count, links = len(a), len(ends[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.array(a, dtype=np.int64), ends[0]])), pa.array([None] * count + ends[1].tolist(), pa.int64()), pa.array(n + [0] * links, pa.int64()),
            ], ["a", "b", "n"])

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        held = []
        for batch in batches:
            for b in batch.to_pylist():
                held.append(b)
                if len(held) >= BLOCKS:
                    yield from search(store, held)
                    held = []
        if held:
            yield from search(store, held)

    return blocks.mapInArrow(run, "a long, b long, n long")


def _within(groups: DataFrame, cosine: float) -> DataFrame:
    """(key, n): of rows (root, key, unit, weight), the weight of each vector's links within its root.

    A root's vectors are cut into parts; every pair of parts is a task's product of two small
    matrices, of which only counts leave it.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1").withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).drop("size")
    placed = groups.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("key", "root"), F.col("parts")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", "key", "unit", "weight", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def judge(rows):
        key, part = np.array([x["key"] for x in rows]), np.array([x["part"] for x in rows])
        units, weight = np.stack([np.frombuffer(x["unit"], dtype=np.float64) for x in rows]), np.array([x["weight"] for x in rows])
        left, right = part == rows[0]["i"], part == rows[0]["j"]
        near = units[left] @ units[right].T >= cosine
        same = rows[0]["i"] == rows[0]["j"]
        if same:
            np.fill_diagonal(near, False)
        yield key[left], near @ weight[right]
        if not same:
            yield key[right], weight[left] @ near

    def run(batches):
        held, now, out = [], None, []
        for batch in batches:
            for x in batch.to_pylist():
                at = x["root"], x["i"], x["j"]
                if at != now and held:
                    out += judge(held)
                    held = []
                now = at
                held.append(x)
            yield from packed(out)
            out = []
        if held:
            yield from packed(list(judge(held)))

    def packed(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in out]), pa.int64()), pa.array(np.concatenate([n for _, n in out]), pa.int64())], ["key", "n"])

    tasks = sent.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return tasks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def audit(reps: DataFrame, found: DataFrame, cosine: float, rows: int) -> float:
    """Recall of a bounded sample of queries: the lesser of the share of all their links that the searches
    found and of the mean of each query's share, so a dense group does not hide the others."""
    every = max(1, rows // AUDIT)
    sample = reps.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(every)) == 0).select("key", "dim", "unit").limit(2 * AUDIT).collect()
    if not sample:
        return 1.0
    by_dim: dict[int, tuple] = {}
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        by_dim[dim] = np.array([r["key"] for r in own], dtype=np.int64), np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in own])
    sent = reps.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim, (own, q) in sent.value.items():
                at = np.flatnonzero(dims == dim)
                if not len(at):
                    continue
                keys, weights = batch.column(0).to_numpy()[at], batch.column(3).to_numpy()[at]
                units = np.stack([np.frombuffer(batch.column(2)[int(i)].as_py(), dtype=np.float64) for i in at])
                hit = (units @ q.T >= cosine) & (keys[:, None] != own[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((hit * weights[:, None]).sum(axis=0))], ["a", "n"])

    true = reps.select("key", "dim", "unit", "weight").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 0")
    got = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("got"))
    had = F.least("n", F.coalesce("got", F.lit(0)))
    whole, mean = true.join(got, "a", "left").agg(F.sum(had) / F.sum("n"), F.avg(had / F.col("n"))).first()
    return 1.0 if whole is None else min(whole, mean)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, ef: int = 24) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    table = staged(unit_vectors(vectors), "hnsw-units")
    reps = staged(table.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "hnsw-reps")
    rows = reps.count()
    shards = max(SHARDS, -(-rows // SHARD))
    folder = new_path(vectors.sparkSession, "hnsw-graphs")
    files, blocks = build_graphs(reps, shards, folder), query_blocks(reps)
    while True:
        found = staged(_searched(files, blocks, folder, ef, cosine), "hnsw-found")
        recall = audit(reps, found, cosine, rows)
        if recall >= RECALL:
            break
        if ef >= SHARD:
            raise ValueError(f"the widest beams reach a recall of {recall:.3f} only; {RECALL} is asked for")
        ef *= 2
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    named = staged(reps.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "hnsw-named")
    counts = _within(named.select("root", "key", "unit", "weight"), cosine)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_key = named.join(least, "root").join(counts, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component")
    out = table.select("vec_id", "key").join(of_key, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
