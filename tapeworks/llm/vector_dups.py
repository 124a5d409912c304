"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector, rotated at random into at least as many dimensions, is stored as the signs of its
coordinates and one factor: the inner product of the vector with its own code. The inner product
of a code with another vector, divided by that factor, estimates the inner product of the two
vectors without bias, and the factor says how far the estimate may be off. So a pair is computed
exactly only if the bound of its estimate reaches the threshold.

Candidates share the bits of one of some tables, whose number and width follow from the size of the
largest label, such that a pair at the threshold misses all of them with a chance of MISS.

Dense sets are not compared pair by pair. Where a bucket is large, the middle of its densest ball
becomes a leader. Vectors within half the threshold's angle of a leader form its group: they are all linked, by
the triangle inequality. Every vector is held against all leaders, exactly, so the only other pairs of a
member are with vectors at the fringe of its group; these meet in blocks, in which angles to the
leader decide most pairs. Which leaders there are affects the work, not the result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_frequent_keys, components, few, lean, mix, staged

#: Chance that a pair at the threshold shares no table; standard deviations of an estimate's bound.
MISS, DEVIATIONS = 0.001, 5.0
#: Vectors of a bucket on average, rows of a block.
BUCKET, BLOCK = 16, 1024
#: Buckets with more vectors look for a leader, in this many tables, among about so many of them.
DENSE, LEADER_TABLES, LOOKED_AT = 128, 4, 64
#: Components of all leaders: 32 MB. Dense sets beyond are compared in blocks.
MAX_LEADER_VALUES = 4_000_000
#: Leaders of a label this near are one; slack of angles in double precision.
APART, SLACK = 0.05, 1e-6


@functools.lru_cache(maxsize=8)
def rotation(dim: int, bits: int) -> np.ndarray:
    """bits x dim with orthonormal columns, the same on all machines."""
    q, r = np.linalg.qr(np.random.default_rng([dim, bits]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def bits_of(dim: int, least: int) -> int:
    return 64 * -(-max(dim, least, 256) // 64)


def encode(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs) and factors of unit vectors."""
    turned = unit @ rotation(unit.shape[1], bits).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(bits)


def decoded(codes: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """The codes' own vectors, turned back."""
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * np.float32(2) - np.float32(1)
    return signs @ (rotation(dim, bits) / math.sqrt(bits)).astype(np.float32)


def deviation(factors: np.ndarray, bits: int, least: float) -> np.ndarray:
    """Standard deviation of the estimate of a pair whose inner product is least."""
    return np.sqrt((1 - factors**2) / factors**2 * (1 - least**2) / (bits - 1))


def rounded(unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """unit in 8 bits, rounded up or down at random (by a hash of the id and the place), and the step of each row."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    place = np.arange(unit.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    chance = mix(ids.astype(np.uint64)[:, None] + place) / 2.0**64
    return np.clip(np.floor(unit / step[:, None] + chance), -127, 127).astype(np.int8), step


def tables_for(rows: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, rows) / BUCKET))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def buckets(codes: np.ndarray, wide: int, tables: int) -> np.ndarray:
    """rows x tables: the bits of each table."""
    bits = np.unpackbits(codes, axis=1, count=wide * tables).reshape(len(codes), tables, wide)
    return bits.astype(np.int64) @ (1 << np.arange(wide, dtype=np.int64))


def _keys(codes, scope, wide, tables) -> np.ndarray:
    """Hashes of (scope, table, bits); scope: of label and length."""
    inner = buckets(codes, wide, tables).astype(np.uint64) * np.uint64(1024) + np.arange(tables, dtype=np.uint64)
    return mix(mix(inner) ^ scope.astype(np.uint64)[:, None]).astype(np.int64)


def _matrix(col: pa.Array, kind) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _by_length(batch: pa.RecordBatch, name: str = "dim"):
    """(length, rows) of a batch."""
    dims = batch.column(name).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


@lean
def _encoded(batches, least_bits):
    """(row, id, label, dim, v) as rows with a digest of label and vector, the vector's bytes, code and factor."""
    for batch in batches:
        for dim, own in _by_length(batch):
            v = own.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, dim) + 0.0
            codes, factors = encode(_unit(v), bits_of(dim, least_bits))
            raw = [x.tobytes() for x in v]
            digest = [hashlib.blake2b(x + label.encode(), digest_size=16).digest() for x, label in zip(raw, own.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [own.column("row"), own.column("id"), own.column("label"), own.column("dim"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors)],
                ["row", "id", "label", "dim", "key", "v", "code", "factor"],
            )


@lean
def _bucketed(batches, wide, tables, full):
    """(bucket, cid) of each table; full: with what estimates need."""
    for batch in batches:
        for dim, own in _by_length(batch):
            codes = _matrix(own.column("code"), np.uint8)
            cid, scope = own.column("cid").to_numpy(), own.column("scope").to_numpy()
            keys = _keys(codes, scope, wide, tables)
            n = len(cid)
            cols = [pa.array(keys.T.ravel()), pa.array(np.tile(cid, tables))]
            if not full:
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "cid"])
                continue
            q, step = rounded(_unit(_matrix(own.column("v"), np.float64)), cid)
            q = pa.array([x.tobytes() for x in q], pa.binary())
            for t in range(tables):
                fixed = [pa.array(keys[:, t]), own.column("cid"), pa.array(np.full(n, t, np.int32)), own.column("scope"), own.column("dim"), own.column("code"), own.column("factor"), q, pa.array(step)]
                yield pa.RecordBatch.from_arrays(fixed, ["bucket", "cid", "t", "scope", "dim", "code", "factor", "q", "step"])


BUCKETED = "bucket long, cid long, t int, scope long, dim int, code binary, factor double, q binary, step double"


def _leader(table: pa.Table) -> pa.Table:
    """The middle of the densest ball among some vectors of a bucket."""
    dim = table.column("dim")[0].as_py()
    table = table.filter(pc.equal(table.column("dim"), dim))
    x = _unit(_matrix(table.column("v").combine_chunks(), np.float64)[: 8 * LOOKED_AT])
    near = x @ x.T >= 0.98
    middle = _unit(x[near[near.sum(axis=1).argmax()]].sum(axis=0)[None])
    for _ in range(2):
        own = (x @ middle[0]) >= 0.98
        middle = _unit(x[own].sum(axis=0)[None]) if own.any() else middle
    return pa.table({"scope": table.column("scope").slice(0, 1), "dim": pa.array([dim], pa.int32()), "n": table.column("n").slice(0, 1), "middle": pa.array([middle[0].tobytes()], pa.binary())})


def _apart(rows) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By scope and length: leaders (their numbers and vectors), none too near another."""
    out: dict[tuple[int, int], list] = {}
    number = 0
    for r in rows:
        own = out.setdefault((r.scope, r.dim), [])
        x = np.frombuffer(r.middle, np.float64)
        if not own or max(y @ x for _, y in own) < math.cos(APART):
            own.append((number, x))
            number += 1
    return {k: (np.array([i for i, _ in own]), np.array([x for _, x in own])) for k, own in out.items()}


@lean
def _grouped(batches, leaders, angle):
    """Classes with their group (-1: none), the angle to its leader and the groups whose fringe they are in."""
    for batch in batches:
        n = batch.num_rows
        group, far, near = np.full(n, -1, np.int32), np.zeros(n), [[] for _ in range(n)]
        scope, dims = batch.column("scope").to_numpy(), batch.column("dim").to_numpy()
        for (s, dim), (numbers, x) in leaders.value.items():
            rows = np.flatnonzero((scope == s) & (dims == dim))
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                dots = _unit(_matrix(batch.column("v").take(pa.array(some)), np.float64)) @ x.T
                best = dots.argmax(axis=1)
                nearest = np.arccos(np.clip(dots[np.arange(len(some)), best], -1, 1))
                inside = nearest <= angle / 2 - SLACK
                group[some[inside]], far[some[inside]] = numbers[best[inside]], nearest[inside]
                i, j = np.nonzero(dots >= math.cos(min(math.pi, 1.5 * angle + SLACK)))
                for a, b in zip(some[i].tolist(), numbers[j].tolist(), strict=True):
                    if b != group[a] and (group[a] < 0 or b < group[a]):
                        near[a].append(b)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(far), pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "group", "far", "near"])


def _fringe(table: pa.Table, leaders, angle: float, least: float) -> pa.Table:
    """A block of a group's members and one of its fringe: what each gains in links, and whether a vector of
    the fringe is linked with a member (then to: the group)."""
    inner = table.column("inner").to_numpy()
    if inner.all() or not inner.any():
        return _gains([], [], [])
    group, scope, dim = (table.column(c)[0].as_py() for c in ("to", "scope", "dim"))
    x, cid, n = _unit(_matrix(table.column("v").combine_chunks(), np.float64)), table.column("cid").to_numpy(), table.column("n").to_numpy()
    numbers, middles = leaders.value[(scope, dim)]
    middle = middles[int(np.flatnonzero(numbers == group)[0])]
    y, x, far = x[inner], x[~inner], np.arccos(np.clip(x @ middle, -1, 1))
    both = far[~inner][:, None] + far[inner][None]
    linked = both <= angle - SLACK
    open_ = ~linked & (far[~inner][:, None] - far[inner][None] <= angle + SLACK)
    rows = np.flatnonzero(open_.any(axis=1))
    linked[rows] |= open_[rows] & (x[rows] @ y.T >= least)
    gain_x, gain_y = linked @ n[inner], n[~inner] @ linked
    hit = linked.any(axis=1)
    keep = gain_y > 0
    return _gains(np.concatenate((cid[~inner][hit], cid[inner][keep])), np.concatenate((gain_x[hit], gain_y[keep])), np.concatenate((np.full(hit.sum(), group), np.full(keep.sum(), -1))))


def _gains(cid, gain, to) -> pa.Table:
    return pa.table({"cid": pa.array(cid, pa.int64()), "gain": pa.array(gain, pa.int64()), "to": pa.array(to, pa.int32())})


def _runs(*cols) -> np.ndarray:
    """Bounds of runs of equal rows."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


@lean
def _paired(batches, wide, tables, least_bits, least, deviations):
    """Pairs (a, b) of a bucket whose estimates' bounds reach the threshold, in the first table that
    both share. Rows come sorted by bucket, length and cell; the last cell waits for the next batch."""
    held: pa.Table | None = None

    def done(some: pa.Table) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64)]
        some = some.combine_chunks()
        cols = {c: some.column(c).to_numpy() for c in ("bucket", "dim", "i", "j", "part", "cid", "scope", "t", "factor", "step")}
        bounds = _runs(cols["bucket"], cols["dim"], cols["i"], cols["j"])
        many = np.diff(bounds)
        for dim in np.unique(cols["dim"]).tolist():
            runs = np.flatnonzero((many > 1) & (cols["dim"][bounds[:-1]] == dim))
            at = np.repeat(runs, many[runs])
            rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(many)), many), runs)) if len(at) else at
            if not len(rows):
                continue
            bits = bits_of(dim, least_bits)
            codes = _matrix(some.column("code").take(pa.array(rows)).combine_chunks(), np.uint8)
            q = _matrix(some.column("q").take(pa.array(rows)).combine_chunks(), np.int8).astype(np.float32)
            own = {c: x[rows] for c, x in cols.items()}
            codes_back = decoded(codes, dim, bits) / own["factor"][:, None].astype(np.float32)
            q *= own["step"][:, None].astype(np.float32)
            slack = deviations * np.sqrt(deviation(own["factor"], bits, least) ** 2 + own["step"].max() ** 2 / (4 * own["factor"] ** 2))
            known = buckets(codes, wide, tables)
            ends = np.cumsum(many[runs])
            for s, e in zip((ends - many[runs]).tolist(), ends.tolist(), strict=True):
                reach = codes_back[s:e] @ q[s:e].T + slack[s:e, None] >= least
                i, j = np.nonzero(np.triu(reach & reach.T, 1))
                if not len(i):
                    continue
                i, j = i + s, j + s
                ok = own["scope"][i] == own["scope"][j]
                ok &= (own["i"][i] == own["j"][i]) | (own["part"][i] != own["part"][j])  # a cell of two blocks: only pairs between them
                earlier = np.arange(tables) < own["t"][s]
                ok &= ~((known[i] == known[j]) & earlier).any(axis=1)
                a, b = own["cid"][i[ok]], own["cid"][j[ok]]
                found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        bounds = _runs(*[held.column(c).to_numpy() for c in ("bucket", "dim", "i", "j")])
        if len(bounds) > 2:
            yield done(held.slice(0, int(bounds[-2])))
            held = held.slice(int(bounds[-2])).combine_chunks()
    if held is not None and held.num_rows:
        yield done(held)


@lean
def _exact(batches, least):
    """Pairs whose inner product reaches the threshold, in double precision."""
    for batch in batches:
        for _, own in _by_length(batch):
            x, y = (_unit(_matrix(own.column(c), np.float64)) for c in ("va", "vb"))
            keep = pa.array(np.einsum("ij,ij->i", x, y) >= least)
            yield own.select(["a", "b", "na", "nb"]).filter(keep)


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dense: int = DENSE, block: int = BLOCK, deviations: float = DEVIATIONS) -> DataFrame:
    """id_col, n_links, component_id and kept of each row.

    Two rows are linked if their labels are equal and not null, their vectors of one length, and the vectors'
    cosine in double precision is least at least. n_links counts the rows linked with a row, component_id is the smallest id
    reachable by links, its own included, and kept says whether that is its own. A vector that is null, empty or all
    zero, or holds a null or a component that is not finite, is linked with nothing. Rows that repeat
    are linked with each other; an id may repeat. A null id is never a component's, unless it has no other, and not kept.

    No pair below least is linked. One at least goes unseen with a chance of MISS at the threshold
    (far less above it) or by an estimate off by more than deviations standard deviations."""
    spark, angle = vectors.sparkSession, math.acos(least)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0) & F.col(label_col).isNotNull()
    kind = vectors.schema[id_col].dataType.simpleString()
    every = staged(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(F.size(v), F.lit(0)).alias("dim"), v.alias("v"), F.coalesce(finite, F.lit(False)).alias("fit")))
    largest = every.where("fit").groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    wide, tables = tables_for(largest, least)
    bits = wide * tables
    rows = staged(every.where("fit").drop("fit").mapInArrow(partial(_encoded, least_bits=bits), f"row long, id {kind}, label string, dim int, key binary, v binary, code binary, factor double"))
    once = [F.first(c).alias(c) for c in ("label", "dim", "v", "code", "factor")]
    classes = staged(rows.groupBy("key").agg(F.min("row").alias("cid"), F.count("*").alias("n"), F.min("id").alias("low"), *once).withColumn("scope", F.xxhash64("label", "dim")))

    # Leaders of dense sets.
    some = min(LEADER_TABLES, tables)
    placed = staged(classes.select("cid", "scope", "dim", "code").mapInArrow(partial(_bucketed, wide=wide, tables=some, full=False), "bucket long, cid long"))
    crowded = staged(placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > dense))
    looked = placed.join(few(crowded), "bucket").where(F.pmod(F.xxhash64("cid", "bucket"), F.ceil(F.col("n") / LOOKED_AT)) == 0)
    looked = looked.join(classes.select("cid", "scope", "dim", "v"), "cid").select("bucket", "scope", "dim", "v", "n")
    found = staged(looked.groupBy("bucket").applyInArrow(_leader, "scope long, dim int, n long, middle binary"))
    most = MAX_LEADER_VALUES // max(1, classes.agg(F.max("dim")).first()[0] or 1)
    leaders = spark.sparkContext.broadcast(_apart(found.orderBy(F.desc("n"), "scope", "middle").limit(most).collect()))
    names = ["cid", "key", "n", "low", "label", "dim", "v", "code", "factor", "scope"]
    schema = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in names)
    classes = staged(classes.select(*names).mapInArrow(partial(_grouped, leaders=leaders, angle=angle), f"{schema}, group int, far double, near array<int>"))
    groups = staged(classes.where("group >= 0").groupBy("group").agg(F.sum("n").alias("weight"), F.count("*").alias("size"), F.min("cid").alias("rep")))  # as many as leaders at most

    # Members of a group with its fringe.
    outer = staged(classes.where(F.size("near") > 0).select("cid", "group", F.explode("near").alias("to")))
    sizes = outer.groupBy("to").agg(F.count("*").alias("outer")).join(groups.select(F.col("group").alias("to"), "size"), "to")
    sizes = F.broadcast(staged(sizes.select("to", F.ceil(F.col("outer") / block).cast("int").alias("fs"), F.ceil(F.col("size") / block).cast("int").alias("ms"))))
    vector = classes.select("cid", "n", "scope", "dim", "v", "group")
    dealt = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = vector.where("group >= 0").withColumnRenamed("group", "to").join(sizes, "to").withColumn("m", dealt("ms", 1)).withColumn("f", upto("fs")).withColumn("inner", F.lit(True))
    edge = vector.drop("group").join(outer.select("cid", "to"), "cid").join(sizes, "to").withColumn("f", dealt("fs", 2)).withColumn("m", upto("ms")).withColumn("inner", F.lit(False))

    def fringe(table: pa.Table) -> pa.Table:
        return _fringe(table, leaders, angle, least)

    cells = ["to", "m", "f", "inner", "cid", "n", "scope", "dim", "v"]
    gains = staged(inner.select(cells).unionByName(edge.select(cells)).groupBy("to", "m", "f").applyInArrow(fringe, "cid long, gain long, to int"))

    # Vectors outside of groups, by buckets.
    loose = classes.where("group < 0").select("cid", "scope", "dim", "v", "code", "factor")
    full = loose.mapInArrow(partial(_bucketed, wide=wide, tables=tables, full=True), BUCKETED)
    counts = loose.select("cid", "scope", "dim", "code").mapInArrow(partial(_bucketed, wide=wide, tables=tables, full=False), "bucket long, cid long").groupBy("bucket").agg(F.count("*").alias("many"))
    parts = few(staged(counts.where(F.col("many") > block).select("bucket", F.ceil(F.col("many") / block).cast("int").alias("parts"))))
    full = full.join(parts, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")), F.lit(0)).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    order = ["bucket", "dim", "i", "j"]
    full = full.select(*order, "part", "cid", "t", "scope", "code", "factor", "q", "step").repartition(*order).sortWithinPartitions(*order, "cid")
    pairs = staged(full.mapInArrow(partial(_paired, wide=wide, tables=tables, least_bits=bits, least=least, deviations=deviations), "a long, b long"))
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}"), F.col("label").alias(f"label{c}"), F.col("dim").alias(f"dim{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("labela = labelb and dima = dimb").select("a", "b", "na", "nb", F.col("dima").alias("dim"), "va", "vb")
    links = staged(both.mapInArrow(partial(_exact, least=least), "a long, b long, na long, nb long"))

    # Sums and components; a group is one node.
    rep = F.broadcast(groups.select(F.col("group").alias("to"), "rep"))
    own = F.broadcast(groups.select("group", "weight", "rep"))
    gained = gains.select("cid", "gain").union(links.select("a", "nb")).union(links.select("b", "na")).groupBy("cid").agg(F.sum("gain").alias("gain"))
    node = staged(classes.select("cid", "key", "n", "low", "group").join(own, "group", "left").withColumn("node", F.coalesce("rep", "cid")).join(gained, "cid", "left"))
    hits = gains.where("to >= 0").select("cid", "to").distinct().join(rep, "to").join(node.select("cid", "node"), "cid")
    comps = staged(components(links.select("a", "b").union(hits.select(F.col("node").alias("a"), F.col("rep").alias("b")))))
    lows = node.groupBy("node").agg(F.min("low").alias("low")).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged(lows.select("node", "component").join(ids, "component").select("node", "component_id"))
    of_groups = F.broadcast(named.join(groups.select(F.col("rep").alias("node")), "node", "left_semi"))
    per = node.withColumn("links", F.col("n") - 1 + F.coalesce("gain", F.lit(0)) + F.coalesce(F.col("weight") - F.col("n"), F.lit(0)))
    columns = ["key", "n", "links", "component_id"]
    per = staged(per.where("group >= 0").join(of_groups, "node").select(columns).union(per.where("group < 0").join(named, "node").select(columns)))

    linked = by_frequent_keys(rows.select("id", "key"), per, "key", rows.count())
    alone = every.where("not fit").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    out = linked.select("id", "links", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), "component_id", kept.alias("kept"))
