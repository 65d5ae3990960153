"""Conditional permutation p-values: each cell draws as many other cells as it has neighbour values, without
replacement, nsim times; p is the smaller of both tails, ties in both, over nsim + 1.

Cells have numbers o = time index * regions + region index. Draw d of a simulation is s * A**d modulo the prime P, twice
with two starts and multipliers for 62 bits, where the starts are scrambled from (seed, cell, simulation): in integers
that Spark, numpy and SQL compute alike. So results are the same however the rows lie and whichever backend runs:
`native` explodes draws and joins values by cell number; `numpy` looks them up in the broadcast vector of values, and
is what `auto` takes while that vector is below BROADCAST cells; `sharded`, which `auto` takes beyond, looks them up in
shards of it, with the same sums bit for bit. `native` adds in no fixed order, so it agrees where sums are exact.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .gistar import closed_form
from .numbering import numbered as in_order

MOST, SOFT, BROADCAST, SLACK = 9999, 999, 4_000_000, 16
P = 2**31 - 1
#: Multipliers of both sequences, steps of the simulation in both starts, and what the rounds of scrambling add.
A, STEPS, ROUNDS = (48271, 39373), (742938285, 950706376), (1226874159, 62089911)
PORTION = 1 << 21
#: Draws that are made at a time, so that they stay in the processor's cache.
CACHED = 1 << 16
#: Cells of a shard of values, as a power of two.
SHARD_BITS = 18


def check_nsim(nsim) -> int:
    if isinstance(nsim, bool) or not isinstance(nsim, int) or nsim < 1:
        raise ValueError("nsim must be a positive integer")
    if nsim > MOST:
        raise ValueError(f"nsim must not exceed {MOST}")
    if nsim > SOFT:
        warnings.warn(f"nsim above {SOFT} is slow", stacklevel=3)
    return nsim


def numbered(gi: DataFrame) -> DataFrame:
    """gi with o (cell number) and total (cells of the cube); regions are numbered by their slots, or by their names."""
    real = gi.where(~F.col("surplus"))
    shape = real.agg(F.countDistinct("r").alias("regions"), (F.max("b") + 1).alias("times"))
    if dict(gi.dtypes)["r"] == "bigint":
        out = gi.withColumn("r_idx", F.col("r"))
    else:
        out = gi.join(in_order(real.select("r").distinct(), [F.col("r")], "r_idx"), "r", "left")
    out = out.join(F.broadcast(shape))  # one row
    return out.withColumns({"o": F.col("b") * F.col("regions") + F.col("r_idx"), "total": F.col("regions") * F.col("times")})


def scrambled(x, rounds=ROUNDS, mod=lambda v: v % P):
    """Rounds of x**5 + c modulo P, one to one on 0 to P - 1; for integers, numpy arrays and columns."""
    for c in rounds:
        square = mod(x * x)
        x = mod(mod(square * square) * x + c)
    return x


def mod_p(x: np.ndarray) -> np.ndarray:
    """x % P for int64 arrays from 0 to P * P, without a division: as P is 2**31 - 1, 2**31 counts as 1."""
    y = x & P
    y += x >> 31
    y = y.view(np.uint64)
    return np.minimum(y, y - np.uint64(P)).view(np.int64)  # the difference wraps around below P


def mod_n(x: np.ndarray, n: int) -> np.ndarray:
    """x % n for int64 arrays from 0; numpy divides unsigned numbers by one number without the processor's division."""
    y = x.view(np.uint64)
    q = y // np.uint64(n)
    q *= np.uint64(n)
    return (y - q).view(np.int64)


def tries(m, total, least=min, ceil=lambda a, b: -(-a // b)):
    """How many draws are looked at first: enough for m different cells but in a vanishing share of cases."""
    return m + SLACK + ceil(2 * m * m, total) if 3 * m < total else least(20 * total, 40 * m + 200)


def powers(n: int) -> np.ndarray:
    """A[0]**d and A[1]**d modulo P for d from 1 to n."""
    out = np.ones((2, n + 1), np.int64)
    for k, a in enumerate(A):
        have = 1
        while have <= n:
            out[k, have : 2 * have] = out[k, : min(have, n + 1 - have)] * pow(a, have, P) % P
            have *= 2
    return out[:, 1:]


def draws(cells: DataFrame, nsim: int, seed: int) -> DataFrame:
    """(o, sim, j): the cells drawn for each cell and simulation; cells has o, m, total."""
    check_nsim(nsim)
    m, total = F.col("m"), F.col("total")
    most = F.when(3 * m < total, m + SLACK + F.ceil(2 * m * m / total)).otherwise(F.least(20 * total, 40 * m + 200))
    most = F.when(total - 1 >= m, most).otherwise(m).cast("int")
    rows = cells.where("total > 1 and m > 0").select("o", "m", "total", most.alias("most"))
    longest = rows.agg(F.max("most")).first()[0] or 0
    table = powers(longest)
    listed = [F.transform(F.split(F.lit(",".join(map(str, t.tolist()))), ","), lambda v: v.cast("bigint")) for t in table]  # folded to constants

    def step(df: DataFrame, name: str, start: Column) -> DataFrame:
        """A column, scrambled: a projection for each round, so that none is written out twice."""
        df = df.withColumn(name, start)
        for c in ROUNDS:
            df = df.withColumn(name, scrambled(F.col(name), (c,)))
        return df

    rows = step(rows, "key", (F.col("o") % P * 16807 + F.expr(f"o div {P}") * 69621 + (seed * 40692 + 1) % P) % P)
    rows = rows.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(nsim))))
    for k, c in enumerate(STEPS):
        rows = step(rows, f"start{k}", (F.col("key") + F.col("sim") * F.lit(c).cast("bigint") + k) % P)
        rows = rows.withColumn(f"start{k}", F.col(f"start{k}") % (P - 1) + 1)
    place = lambda a, b: (F.col("o") + 1 + (F.col("start0") * a % P * P + F.col("start1") * b % P) % (F.col("total") - 1)) % F.col("total")
    first = [F.slice(t, F.lit(1), F.col("most")) for t in listed]
    made = rows.select("o", "sim", "m", "total", F.zip_with(*first, place).alias("made"))
    enough = F.col("total") - 1 >= m
    # Should the draws hold too few different cells, the cells that follow o fill up.
    rest = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("total") - 1), lambda d: (F.col("o") + d) % F.col("total"))
    made = made.withColumn("made", F.when(enough, F.array_distinct("made")).otherwise(F.col("made")))
    made = made.withColumn("made", F.when(F.size("made") < m, F.array_distinct(F.concat("made", rest))).otherwise(F.col("made")))
    return made.select("o", "sim", F.explode(F.slice("made", F.lit(1), m.cast("int"))).alias("j"))


def starts(o: np.ndarray, nsim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both starts for each cell and simulation."""
    key = scrambled((o % P * 16807 + o // P * 69621 + (seed * 40692 + 1) % P) % P)
    sim = np.arange(1, nsim + 1, dtype=np.int64)
    return tuple(scrambled(mod_p(key[:, None] + sim * c + k), mod=mod_p) % (P - 1) + 1 for k, c in enumerate(STEPS))


def repeats(rows: np.ndarray) -> np.ndarray:
    """Which rows hold a number twice."""
    if rows.shape[1] > 32:
        order = np.sort(rows, axis=1)
        return (order[:, 1:] == order[:, :-1]).any(axis=1)
    columns = np.ascontiguousarray(rows.T)  # few columns are compared with each other over all rows, without a sort of each row
    out = np.zeros(len(rows), bool)
    for k in range(1, len(columns)):
        out |= (columns[k:] == columns[:-k]).any(axis=0)
    return out


def picks(o: np.ndarray, m: int, total: int, nsim: int, seed: int) -> np.ndarray:
    """The same cells as `draws`, as an array (cell, simulation, draw), for cells with m neighbour values each."""
    step = max(1, CACHED // (nsim * m))
    if len(o) > step:
        return np.concatenate([picks(o[i : i + step], m, total, nsim, seed) for i in range(0, len(o), step)])
    most = tries(m, total) if total - 1 >= m else m
    up = powers(most)
    s, t = (x.ravel() for x in starts(o, nsim, seed))
    own = np.repeat(o, nsim)

    def place(at, n: int) -> np.ndarray:
        x = mod_p(s[at, None] * up[0, :n]) * P
        x += mod_p(t[at, None] * up[1, :n])
        x = mod_n(x, total - 1)
        x += own[at, None] + 1
        x -= (x >= total) * total
        return x

    out = place(slice(None), m)
    if total - 1 >= m:
        bad = np.flatnonzero(repeats(out.astype(np.int32) if total <= P else out))
        for i in range(0, len(bad), max(1, PORTION // most)):
            at = bad[i : i + max(1, PORTION // most)]
            made = place(at, most)
            order = np.argsort(made, axis=1, kind="stable")
            ranked = np.take_along_axis(made, order, 1)
            new = np.ones(made.shape, bool)
            np.put_along_axis(new, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], 1)
            count = np.cumsum(new, axis=1)
            full = count[:, -1] >= m
            out[at[full]] = made[full][new[full] & (count[full] <= m)].reshape(-1, m)
            for k in np.flatnonzero(~full):
                found = dict.fromkeys(made[k].tolist())
                found.update(dict.fromkeys(((own[at[k]] + np.arange(1, total)) % total).tolist()))
                out[at[k]] = list(found)[:m]
    return out.reshape(len(o), nsim, m)


def p_values(gi: DataFrame, nsim: int = 199, seed: int = 77, backend: str = "auto") -> DataFrame:
    """gi with p_sim and upper, lower tail counts; cells without neighbours and surplus rows have p 1."""
    check_nsim(nsim)
    if backend not in ("auto", "numpy", "native", "sharded"):
        raise ValueError("backend must be 'auto', 'numpy', 'native' or 'sharded'")
    cells = staged(numbered(gi), "gi")  # read by all that follows
    real = cells.where(~F.col("surplus") & F.col("m").isNotNull())
    if backend == "auto":
        backend = "numpy" if real.count() <= BROADCAST else "sharded"
    # Rows that share a cell have all but x in common.
    one = real.where("total > 1").groupBy("o").agg(*(F.min(c).alias(c) for c in ("m", "total", "s", "n", "mean", "var", "gi", "x")))
    tails = {"native": _native, "numpy": _numpy, "sharded": _sharded}[backend](one, nsim, seed)
    out = cells.join(tails, "o", "left")
    flat = F.col("surplus") | F.col("upper").isNull()
    p = F.least(F.col("upper"), F.col("lower")) / F.lit(nsim + 1.0)
    return out.withColumn("p_sim", F.when(flat, 1.0).otherwise(p)).drop("regions", "times", "r_idx")


def _native(one: DataFrame, nsim: int, seed: int) -> DataFrame:
    values = one.select(F.col("o").alias("j"), F.col("x").alias("v"))
    sums = draws(one, nsim, seed).join(values, "j").groupBy("o", "sim").agg(F.sum("v").alias("sim_s"), F.count("*").alias("sim_m"))
    met = sums.join(one.drop("x"), "o")
    same = F.col("sim_m") == F.col("m")
    live = (F.col("n") > F.col("m")) & (F.col("var") > 0)
    sim_gi = closed_form(F.col("sim_s"), F.col("sim_m"), F.col("n"), F.col("mean"), F.col("var"))
    above = F.when(same & live, F.col("sim_s") >= F.col("s")).otherwise(sim_gi >= F.col("gi"))
    below = F.when(same & live, F.col("sim_s") <= F.col("s")).otherwise(sim_gi <= F.col("gi"))
    # Draws that meet no value at all count as 0, as those of a flat slice do.
    tails = met.groupBy("o").agg(F.count_if(above).alias("above"), F.count_if(below).alias("below"), F.count("*").alias("met"), F.first("gi").alias("gi"))
    blank = nsim - F.col("met")
    return tails.select("o", (F.col("above") + F.when(F.col("gi") <= 0, blank).otherwise(0) + 1).alias("upper"), (F.col("below") + F.when(F.col("gi") >= 0, blank).otherwise(0) + 1).alias("lower"))


def _tails(v: np.ndarray, m: int, s, n, mean, var, gi) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower tail counts of cells from the values v (cell, simulation, draw) they drew, NaN for none."""
    there = ~np.isnan(v)
    sums, sizes = np.where(there, v, 0.0).sum(2), there.sum(2)
    s, n, mean, var, gi = (x[:, None] for x in (s, n, mean, var, gi))
    with np.errstate(invalid="ignore", divide="ignore"):
        usable = (n > sizes) & (sizes > 0) & (var > 0)
        z = np.where(usable, (sums - sizes * mean) / np.sqrt(var * sizes * (n - sizes) / np.maximum(1, n - 1)), 0.0)
    same = (sizes == m) & (n > m) & (var > 0)
    return np.where(same, sums >= s, z >= gi).sum(1) + 1, np.where(same, sums <= s, z <= gi).sum(1) + 1


_FIGURES = ["s", "n", "mean", "var", "gi"]


def _numpy(one: DataFrame, nsim: int, seed: int) -> DataFrame:
    spark = one.sparkSession
    got = one.select("o", "x", "total").toPandas()  # bounded by BROADCAST
    total = int(got["total"].iloc[0]) if len(got) else 0
    vector = np.full(total, np.nan)
    vector[got["o"].to_numpy().astype(np.int64)] = got["x"].to_numpy()
    sent = spark.sparkContext.broadcast(vector)

    def run(frames):
        for f in frames:
            for m in np.unique(f.m.to_numpy()).tolist():
                part = f[f.m == m]
                step = max(1, PORTION // (nsim * int(m)))
                for i in range(0, len(part), step):
                    g = part.iloc[i : i + step]
                    v = sent.value[picks(g.o.to_numpy().astype(np.int64), int(m), total, nsim, seed)]
                    upper, lower = _tails(v, int(m), *(g[c].to_numpy(dtype=float) for c in _FIGURES))
                    yield g[["o"]].assign(upper=upper, lower=lower)

    return one.mapInPandas(run, "o bigint, upper bigint, lower bigint")


def _sharded(one: DataFrame, nsim: int, seed: int) -> DataFrame:
    """The numpy backend without the whole vector: values lie in shards of 2**SHARD_BITS cells.

    Blocks of cells, of about PORTION draws, send each shard the addresses they drew from it, four bytes a draw, and get the
    values back in the same order, eight bytes a draw. A block makes its draws again to put them in place, so their order
    is not sent. No row stands for a draw, and sums are taken as in the numpy backend, bit for bit.
    """
    bits = SHARD_BITS
    total = (one.select("total").limit(1).first() or [0])[0]

    def dealt(batches):
        task = TaskContext.get().partitionId()
        k = 0
        for batch in batches:
            ms = batch.column("m").to_numpy()
            for m in np.unique(ms).tolist():
                own = np.flatnonzero(ms == m)
                step = max(1, PORTION // (nsim * int(m)))
                for i in range(0, len(own), step):
                    part = batch.take(pa.array(own[i : i + step]))
                    lists = [pa.array([part.column(c).to_numpy().astype(t).tolist()]) for c, t in (("o", np.int64), *((c, float) for c in _FIGURES))]
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([int(m)], pa.int64()), *lists], names=["block", "m", "o", *_FIGURES])
                    k += 1

    fields = ", ".join(f"{c} array<double>" for c in _FIGURES)
    blocks = staged(one.select("o", F.col("m").cast("bigint").alias("m"), *(F.col(c).cast("double").alias(c) for c in _FIGURES)).mapInArrow(dealt, f"block bigint, m bigint, o array<bigint>, {fields}"), "blocks")

    def drawn(o: np.ndarray, m: int):
        """The drawn cells in the order of their shards, and that order."""
        j = picks(o, m, total, nsim, seed).ravel()
        order = np.argsort((j >> bits).astype(np.min_scalar_type(total >> bits)), kind="stable")  # numpy sorts short numbers by radix
        return j[order], order

    def asked(batches):
        for batch in batches:
            for block, m, o in zip(*(batch.column(c).to_pylist() for c in ("block", "m", "o")), strict=True):
                j, _ = drawn(np.array(o, np.int64), m)
                counts = np.bincount(j >> bits)
                shard = np.flatnonzero(counts)
                at = [x.tobytes() for x in np.split((j & ((1 << bits) - 1)).astype("<u4"), np.cumsum(counts[shard])[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(shard), block)), pa.array(at, pa.binary())], names=["shard", "block", "at"])

    # A shard with many askers is held by several tasks.
    spread = max(1, -(-blocks.count() // 64))
    empty = "cast(null as array<struct<o:bigint,x:double>>)"
    asks = blocks.select("block", "m", "o").mapInArrow(asked, "shard bigint, block bigint, at binary")
    asks = asks.select("shard", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("salt"), F.lit(1).alias("role"), "block", "at", F.expr(f"{empty} as own"))
    values = one.groupBy(F.shiftright("o", bits).alias("shard")).agg(F.collect_list(F.struct(F.col("o").cast("bigint").alias("o"), F.col("x").cast("double").alias("x"))).alias("own"))  # 2**SHARD_BITS at most
    values = values.select("shard", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"), F.lit(0).alias("role"), F.expr("cast(null as bigint) as block"), F.expr("cast(null as binary) as at"), "own")

    def answered(batches):
        now, held = None, np.zeros(0)
        for batch in batches:
            blocks, shards, out = [], [], []
            for shard, salt, role, block, at, own in zip(*(batch.column(c) for c in ("shard", "salt", "role", "block", "at", "own")), strict=True):
                key = shard.as_py(), salt.as_py()
                if key != now:
                    now, held = key, np.full(1 << bits, np.nan)
                if role.as_py() == 0:
                    cells = own.values
                    held[cells.field("o").to_numpy() & ((1 << bits) - 1)] = cells.field("x").to_numpy(zero_copy_only=False)
                else:
                    blocks.append(block.as_py())
                    shards.append(key[0])
                    out.append(held[np.frombuffer(at.as_buffer(), "<u4")].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(shards, pa.int64()), pa.array(out, pa.binary())], names=["block", "shard", "got"])

    met = asks.unionByName(values).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")
    answers = met.mapInArrow(answered, "block bigint, shard bigint, got binary").withColumn("role", F.lit(1))
    both = answers.unionByName(blocks.withColumn("role", F.lit(0)), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "role", "shard")

    def placed(m, o, figures, got):
        o = np.array(o, np.int64)
        _, order = drawn(o, m)
        v = np.empty(len(order))
        v[order] = np.frombuffer(b"".join(got), "<f8")
        upper, lower = _tails(v.reshape(len(o), nsim, m), m, *(np.array(x, float) for x in figures))
        return pa.RecordBatch.from_arrays([pa.array(o), pa.array(upper), pa.array(lower)], names=["o", "upper", "lower"])

    def finished(batches):
        block, got = None, []
        for batch in batches:
            for i, role in enumerate(batch.column("role").to_pylist()):
                if role == 1:
                    got.append(batch.column("got")[i].as_py())
                    continue
                if block:
                    yield placed(*block, got)
                block, got = (batch.column("m")[i].as_py(), batch.column("o")[i].as_py(), [batch.column(c)[i].as_py() for c in _FIGURES]), []
        if block:
            yield placed(*block, got)

    return both.mapInArrow(finished, "o bigint, upper bigint, lower bigint")
