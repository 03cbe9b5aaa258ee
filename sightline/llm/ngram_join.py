"""Jaccard join on word n-grams by vertical partitioning of a global n-gram order.

1. Each text becomes a set of hashed n-grams (48 bits; two n-grams of a compared pair fall
   together with a chance of about 1e-9). Equal sets are one class from here on.
2. A sketch of fixed size counts n-grams over all documents. The global order is
   (frequency level, hash): rare ones first. The sketch shapes the order only; results are
   exact under any order.
3. The order's first part of each set, its prefix, must meet the prefix of every linked set
   (prefix filter). Prefix n-grams are dealt by n-gram, very frequent ones salted, and
   sorted, and buckets of one class fall away. Each class is held against the most central
   class that it meets in a bucket.
4. Candidates are verified over vertical fragments of the order: overlaps are counted
   fragment by fragment and summed per pair, in blocks of bounded size.
5. Verified links give components. Then each class is held against the *other* components
   that it meets in a bucket. The partial overlap in the prefix bounds the whole overlap, so
   most meetings fall by a count; the rest is verified as in 4 and closes the components.

No pair within a component is looked at twice, a group of near copies costs about its size,
and no group is gathered in one task: runs are streamed, blocks and probe chunks are bounded.

Defined cases: words are parted by ASCII white space after lower-casing A-Z; a text with
fewer words than n has its whole word sequence as its one n-gram; null texts and texts
without words have the empty set and are linked with nothing; repeated rows are one class;
rows that share an id are one document for the filter. Other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, ragged, utf8, written
from sightline.llm.components import components

BITS = 48
WORDS_HELD = 100_000
SETS_SEEN = 100_000


@dataclass(frozen=True)
class JoinSpec:
    """``percent`` is the least similarity in percent, ``sketch_bits`` sizes the counting sketch
    (4 bytes a counter), ``fragments`` the vertical cuts; a block holds ``block`` targets and a
    chunk about ``chunk`` probes; a run longer than about ``run`` is salted."""

    size: int = 5
    percent: int = 80
    sketch_bits: int = 20
    fragments: int = 4
    block: int = 256
    chunk: int = 1024
    run: int = 4096

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


class _Hashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(words: list[bytes], size: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed ^= codes[k : k + n]
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(64 - BITS))


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : BITS // 8] = raw
    return wide.view("<u8").ravel()


SETS = "kind int, doc_id long, n long, cid long, tokens binary"
BLOCK_BITS = 14


def _sets(spec: JoinSpec):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("tokens", pa.binary())])

    def run(stream):
        known, seen = _Hashes(), set()
        counts = np.zeros(1 << spec.sketch_bits, np.int32)
        shift = np.uint64(BITS - spec.sketch_bits)
        for whole in stream:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                n, cid, kept = [], [], []
                for text in utf8(batch.column(1)):
                    tokens = ngram_set(text.lower().split(), spec.size, known)
                    n.append(len(tokens))
                    data = packed(tokens)
                    key = xxhash.xxh3_64_intdigest(data) - (1 << 63) if len(tokens) else None
                    cid.append(key)
                    if key is None or key in seen:
                        kept.append(None)
                        continue
                    if len(seen) >= SETS_SEEN:
                        seen.clear()
                    seen.add(key)
                    kept.append(data)
                    np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(n), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(kept, pa.binary())],
                    schema=schema,
                )
        parts = counts.reshape(-1, 1 << min(BLOCK_BITS, spec.sketch_bits))
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([1] * len(used), pa.int32()), pa.array(used, pa.int64()), pa.array([0] * len(used), pa.int64()),
                pa.array([0] * len(used), pa.int64()), pa.array([parts[i].astype("<i4").tobytes() for i in used], pa.binary()),
            ],
            schema=schema,
        )

    return run


def _gathered(parts: DataFrame, kind: str, join) -> dict[int, np.ndarray]:
    """Arrays (block, data) joined per block, streamed past one array for each block.

    Only for tables of a fixed number of blocks of fixed size, whatever the input.
    """
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])

    def run(stream):
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(data, kind)
                if kind == "<i4":  # sums are kept in 64 bits and cut on the way out
                    piece = piece.astype(np.int64)
                total[block] = join(total[block], piece) if block in total else piece
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(v, np.iinfo(kind).max).astype(kind).tobytes() for v in total.values()], pa.binary())], schema=schema)

    rows = parts.repartition("block").mapInArrow(run, "block long, data binary").collect()
    return {r["block"]: np.frombuffer(r["data"], kind) for r in rows}


def _levels(sets: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Frequency level of each counter: 0 for usual counts, else log2 of the count.

    The collected sketch has a fixed size, 4 bytes x 2^sketch_bits, whatever the input.
    """
    found = _gathered(sets.where("kind = 1").select(F.col("doc_id").alias("block"), F.col("tokens").alias("data")), "<i4", np.add)
    wide = 1 << min(BLOCK_BITS, spec.sketch_bits)
    counts = np.zeros(1 << spec.sketch_bits, np.int64)
    for block, part in found.items():
        counts[block * wide : (block + 1) * wide] = part
    usual = 4 * counts.mean() + 16
    return np.where(counts > usual, np.log2(np.maximum(counts, 1)), 0).astype(np.uint8)


def _ordered(tokens: np.ndarray, levels: np.ndarray, spec: JoinSpec) -> np.ndarray:
    """The set in the global order, as (level, hash) keys."""
    level = levels[(tokens >> np.uint64(BITS - spec.sketch_bits)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(BITS)) | tokens)


def _prefixes(sets: DataFrame, levels, spec: JoinSpec) -> DataFrame:
    """(gram, salt, cid, n): the prefix of every set."""
    schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("cid", pa.int64()), ("n", pa.int64())])
    full = int(math.log2(spec.run))

    def run(stream):
        for whole in stream:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                keys, ids, sizes = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for data, n in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True):
                    keys.append(_ordered(unpacked(data), levels.value, spec)[: spec.prefix(n)])
                lengths = np.array([len(k) for k in keys], np.int64)
                gram = np.concatenate(keys).astype(np.int64) if keys else np.empty(0, np.int64)
                cid = np.repeat(ids, lengths)
                spread = np.left_shift(1, np.clip((gram >> BITS) - full, 0, 20))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array((cid & (spread - 1)).astype(np.int32)), pa.array(cid), pa.array(np.repeat(sizes, lengths))], schema=schema
                )

    return sets.where("tokens IS NOT NULL AND kind = 0").select("cid", "n", "tokens").mapInArrow(run, "gram long, salt int, cid long, n long")


def _runs(spec: JoinSpec):
    """Streams rows sorted by (gram, salt, cid); keeps those of runs with two classes or more.

    Rows of salted n-grams all stay: their runs are parts of one bucket. Only the last
    run's first row is held, until a second one shows that the run is to be kept.
    """
    schema = pa.schema([("gram", pa.int64()), ("cid", pa.int64()), ("n", pa.int64())])
    full = int(math.log2(spec.run))

    def run(stream):
        held = None  # the first row of the open run, if it was not given out
        run_key = last = None
        for batch in stream:
            if not len(batch):
                continue
            gram, salt, cid, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (cid[1:] != cid[:-1])
            new[0] = (int(gram[0]), int(salt[0]), int(cid[0])) != last
            last = (int(gram[-1]), int(salt[-1]), int(cid[-1]))
            gram, salt, cid, n = gram[new], salt[new], cid[new], n[new]
            if not len(gram):
                continue
            start = np.ones(len(gram), bool)
            start[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            first = np.flatnonzero(start)
            lengths = np.diff(np.append(first, len(gram)))
            out = (np.repeat(lengths, lengths) > 1) | ((gram >> BITS) > full)
            before = []
            if run_key == (int(gram[0]), int(salt[0])):  # the open run goes on
                out[: lengths[0]] = True
                before = [held] if held is not None else []
                held = None
            at = first[-1]
            if len(first) > 1 or run_key != (int(gram[at]), int(salt[at])):
                held = None if out[at] else (int(gram[at]), int(cid[at]), int(n[at]))
            run_key = (int(gram[at]), int(salt[at]))
            columns = [np.concatenate([np.array([r[k] for r in before], np.int64), x[out]]) for k, x in enumerate((gram, cid, n))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return run


def least_overlap(n: Column, m: Column, spec: JoinSpec) -> Column:
    """Smallest intersection of linked sets of these sizes."""
    return F.ceil((n + m) * spec.percent / (100 + spec.percent) - 1e-9)


def _beyond_prefix(n: Column, m: Column, spec: JoinSpec) -> Column:
    """The most n-grams that two sets can share outside the prefix that ends first."""
    return F.ceil(F.greatest(n, m) * spec.percent / 100) - 1


def _cuts(spec: JoinSpec) -> np.ndarray:
    """Ends of the vertical fragments: equal parts of the rare n-grams, then the frequent ones."""
    parts = max(spec.fragments - 1, 1)
    return np.array([(k + 1) * (1 << BITS) // parts for k in range(spec.fragments - 1)], np.uint64)


def _marked(ids: DataFrame, bits: int = 23):
    """Broadcast bitmap of fixed size, whatever the input: true at the low bits of each (hashed) id."""
    wide = 1 << BLOCK_BITS

    def mark(stream):
        seen = np.zeros(1 << bits, bool)
        for batch in stream:
            seen[batch.column(0).to_numpy().astype(np.int64) & ((1 << bits) - 1)] = True
        parts = seen.reshape(-1, wide)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([np.packbits(parts[i]).tobytes() for i in used], pa.binary())], names=["block", "data"])

    marked = np.zeros((1 << bits) // wide * wide, bool).reshape(-1, wide)
    for block, part in _gathered(ids.mapInArrow(mark, "block long, data binary"), "u1", np.bitwise_or).items():
        marked[block] = np.unpackbits(part)
    return ids.sparkSession.sparkContext.broadcast(marked.ravel())


def _segments(sets: DataFrame, wanted: DataFrame, levels, spec: JoinSpec) -> DataFrame:
    """(cid, n, fragment, tokens) of the wanted classes.

    A bitmap of fixed size over hashed ids lets most other sets go before the shuffle; the
    join behind it is exact.
    """
    bitmap = _marked(wanted.select("cid"))
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.binary())])
    cuts = _cuts(spec)

    def run(stream):
        for whole in stream:
            keep = bitmap.value[whole.column(0).to_numpy() & (len(bitmap.value) - 1)]
            kept = whole.filter(pa.array(keep))
            for at in range(0, len(kept), 256):
                batch = kept.slice(at, 256)
                cid, n, part, data = [], [], [], []
                for c, size, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    keys = _ordered(unpacked(raw), levels.value, spec)
                    # The level has done its part once the set is cut.
                    for f, piece in enumerate(np.split(keys, np.searchsorted(keys, cuts))):
                        if f == 0 or len(piece):
                            cid.append(c)
                            n.append(size)
                            part.append(f)
                            data.append(packed(piece & np.uint64((1 << BITS) - 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], schema=schema
                )

    cut = sets.where("tokens IS NOT NULL AND kind = 0").select("cid", "n", "tokens").mapInArrow(run, "cid long, n long, fragment int, tokens binary")
    return cut.join(wanted.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid", "fragment"])


def _overlaps(spec: JoinSpec):
    """Streams rows sorted by (block, chunk, fragment, role): targets are held, probes pass.

    Partial overlaps of a fragment are added to the pair's sum; after the last fragment of
    a block and chunk the linked pairs are given out. Held: one fragment of a block's targets
    and the sums of block x chunk pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def finished(sums, targets, probes):
        a, b = [], []
        ids = np.array([t for t in targets], np.int64)
        sizes = np.array([targets[t][1] for t in targets], np.int64)
        for p, (row, n) in probes.items():
            got = sums[row][: len(ids)]
            hit = np.flatnonzero(100 * got >= spec.percent * (sizes + n - got))
            for k in hit.tolist():
                if ids[k] != p:
                    a.append(p)
                    b.append(int(ids[k]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(stream):
        at, fragment = None, None
        targets, probes, sums, pieces, index = {}, {}, [], [], None
        for batch in stream:
            for block, part, chunk, frag, role, cid, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, part, chunk) != at:
                    if at is not None:
                        yield finished(sums, targets, probes)
                    at, fragment = (block, part, chunk), None
                    targets, probes, sums = {}, {}, []
                if frag != fragment:
                    fragment, pieces, index = frag, [], None
                tokens = unpacked(data)
                if role == 0:
                    slot = targets.setdefault(cid, (len(targets), n))[0]
                    pieces.append((tokens, slot))
                    continue
                row = probes.setdefault(cid, (len(probes), n))[0]
                if row == len(sums):
                    sums.append(np.zeros(len(targets) + spec.block, np.int64))
                if len(sums[row]) < len(targets):
                    sums[row] = np.concatenate([sums[row], np.zeros(len(targets), np.int64)])
                if index is None and pieces:
                    every = np.concatenate([p for p, _ in pieces])
                    owner = np.repeat([s for _, s in pieces], [len(p) for p, _ in pieces])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order]
                if index is None or not len(index[0]):
                    continue
                left, right = np.searchsorted(index[0], tokens), np.searchsorted(index[0], tokens, "right")
                sums[row] += np.bincount(index[1][ragged(left, right - left)], minlength=len(sums[row]))
        if at is not None:
            yield finished(sums, targets, probes)

    return run


def _verified(targets: DataFrame, probes: DataFrame, sets: DataFrame, levels, spec: JoinSpec) -> DataFrame:
    """Links (a, b) among probes (block, part, cid) and the targets (block, part, cid) of the same block."""
    wanted = targets.select("cid").unionByName(probes.select("cid")).distinct()
    segments = _segments(sets, wanted, levels, spec)
    chunks = probes.groupBy("block", "part").agg(F.ceil(F.count("*") / spec.chunk).cast("int").alias("chunks"))
    held = targets.join(chunks, ["block", "part"]).select("block", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cid")
    passing = probes.join(chunks, ["block", "part"]).select("block", "part", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"), "cid")
    rows = held.withColumn("role", F.lit(0)).unionByName(passing.withColumn("role", F.lit(1)))
    rows = rows.join(segments, "cid").select("block", "part", "chunk", "fragment", "role", "cid", "n", "tokens")
    dealt = rows.repartition("block", "part", "chunk").sortWithinPartitions("block", "part", "chunk", "fragment", "role", "cid")
    return dealt.mapInArrow(_overlaps(spec), "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: JoinSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id.

    The component is the smallest id reachable over links, itself included.
    """
    spec = spec or JoinSpec()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(picked.mapInArrow(_sets(spec), SETS), "ngram-sets")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(sets, spec))

    dealt = _prefixes(sets, levels, spec).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "cid")
    buckets = written(dealt.mapInArrow(_runs(spec), "gram long, cid long, n long"), "ngram-buckets")

    # First pass. The most central class of a bucket leads it: the one whose prefix lies in
    # the fullest buckets. Candidates are each class and the leader that it meets most often,
    # if often enough. What this misses is left to the second pass.
    fullness = buckets.join(buckets.groupBy("gram").agg(F.log2(F.count("*")).alias("m")).where("m > 0"), "gram")
    prefix = F.col("n") - F.ceil(F.col("n") * spec.percent / 100) + 1
    central = fullness.groupBy("cid", "n").agg(F.sum("m").alias("m")).select("cid", (F.col("m") / prefix).alias("central"))
    lead = buckets.join(central, "cid").groupBy("gram").agg(F.max(F.struct("central", "cid", "n")).alias("lead"))
    led = buckets.join(lead, "gram").select("cid", "n", F.col("lead.cid").alias("pivot"), F.col("lead.n").alias("pivot_n"))
    close = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * spec.percent
    met = led.where((F.col("cid") != F.col("pivot")) & close).groupBy("cid", "n", "pivot", "pivot_n").agg(F.count("*").alias("k"))
    met = met.where(F.col("k") + _beyond_prefix(F.col("n"), F.col("pivot_n"), spec) >= least_overlap(F.col("n"), F.col("pivot_n"), spec))
    best = checkpointed(met.groupBy("cid").agg(F.max(F.struct("k", "pivot"))["pivot"].alias("pivot")))
    probes = best.select(F.col("pivot").alias("block"), F.lit(0).alias("part"), "cid")
    targets = best.select(F.col("pivot").alias("block"), F.lit(0).alias("part"), F.col("pivot").alias("cid")).distinct()
    first = checkpointed(_verified(targets, probes, sets, levels, spec))
    labels = checkpointed(components(first).select(F.col("node").alias("cid"), F.col("component").alias("comp")))
    labels = labels.join(labels.groupBy("comp").agg(F.count("*").alias("members")), "comp")

    # Second pass: a class against other, larger components of its buckets.
    placed = buckets.select("gram", "cid", "n").join(labels, "cid", "left").select(
        "gram", "cid", "n", F.coalesce("comp", "cid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members")
    )
    groups = placed.groupBy("gram", F.col("comp").alias("other"), F.col("members").alias("other_members")).agg(
        F.min("n").alias("low"), F.max("n").alias("high")
    )
    reach = (F.col("high") * 100 >= F.col("n") * spec.percent) & (F.col("low") * spec.percent <= F.col("n") * 100)
    ahead = F.struct("members", "comp") < F.struct(F.col("other_members").alias("members"), F.col("other").alias("comp"))
    meets = placed.join(groups, "gram").where(ahead & reach).groupBy("cid", "n", "other", "other_members").agg(
        F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    low = F.greatest("low", F.ceil(F.col("n") * spec.percent / 100))
    high = F.least("high", F.floor(F.col("n") * 100 / spec.percent))
    open_pairs = checkpointed(meets.where(F.col("k") + _beyond_prefix(F.col("n"), high, spec) >= least_overlap(F.col("n"), low, spec)).select("cid", "other", "other_members"))
    blocks = F.ceil(F.col("other_members") / spec.block).cast("int")
    probes = open_pairs.select(F.col("other").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), "cid")
    asked = open_pairs.select("other", "other_members").distinct()
    members = asked.join(labels.select("comp", F.col("cid").alias("member")), asked.other == F.col("comp"), "left")
    targets = members.select(
        F.col("other").alias("block"), F.pmod(F.xxhash64(F.coalesce("member", "other")), blocks).cast("int").alias("part"),
        F.coalesce("member", "other").alias("cid"),
    )
    second = _verified(targets, probes, sets, levels, spec)
    links = first.unionByName(second).unionByName(labels.select(F.col("cid").alias("a"), F.col("comp").alias("b")))
    final = components(links)

    rows = sets.where("kind = 0").select("doc_id", "n", "cid")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least"))
    joined = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "component").select("cid", "component_id")
    return rows.join(named, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def parted(docs: DataFrame, key: Column, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose ``key`` is surely not among ``_gone``, by a bitmap over hashed keys, and the rest."""
    bitmap = _marked(gone.select(F.xxhash64("_gone").alias("hash")))

    def met(hashes: pd.Series) -> pd.Series:
        return pd.Series(bitmap.value[hashes.to_numpy() & (len(bitmap.value) - 1)])

    maybe = F.pandas_udf(met, "boolean")(F.xxhash64(key))
    return docs.where(~maybe), docs.where(maybe)


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is among the distinct ``_gone``.

    Most rows that stay go past the shuffle with their texts; the join of the rest is exact.
    ``docs`` is read once for each.
    """
    gone = checkpointed(gone)
    sure, rest = parted(docs, key, gone)
    return sure.unionByName(rest.join(gone, key == F.col("_gone"), "left_anti"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: JoinSpec | None = None) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; all columns stay.

    A document without an id stays.
    """
    gone = ngram_components(docs, id_col, text_col, spec).where("component_id != doc_id")
    return without(docs, F.col(id_col).cast("long"), gone.select(F.col("doc_id").alias("_gone")).distinct())
