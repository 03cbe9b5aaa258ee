"""Near-duplicate groups by chosen-path set similarity join.

1. Each text becomes a set of hashed word n-grams (48 bits; two n-grams of a compared pair
   fall together with a chance of about 1e-9). Equal sets are one class from here on. A class
   has ``sketch`` minwise values; their low bytes are its small sketch.
2. Several independent trees stand over all classes. In a node of a tree a class chooses
   ``branches`` of its minwise tokens and follows each of them to a child. Classes that choose
   the same token meet there; a child with one class is nothing to look at.
3. Leaders: the classes of each node are streamed in an order of their own. A node's first
   classes give its leaders, the most central ones first; every class goes with the leader of
   another component that it agrees with best. The pairs (class, best leader) are confirmed on
   full sets and give components, in ``rounds`` rounds, so a group of near copies costs
   about its size.
4. Nodes whose classes are all of one component are done. Of the others, nodes of at most
   ``node`` classes are compared exhaustively, across components only; larger ones branch again,
   by further tokens. Pairs are not written out: a node gives one row for each class whose
   sketch agrees enough with one of another component, in groups of classes that hang
   together, and equal groups of several nodes are one. A group's full sets are compared in
   one task, or in tasks of two parts of it each, which gives fewer links than the group has
   components. The classes of a large node that is mostly one component are held against the
   full sets of that component instead, part by part, and have one link per part where there is any.
5. After ``depth`` levels what is still large, families of texts that are alike without being
   linked, branches once more in a way that loses nothing: a class follows all of its rarest
   tokens, so many that a linked class must share one (rare by a counting sketch of fixed size,
   which shapes only the order). Nodes that are large even then are compared block by block.

Recall. A linked pair (similarity 0.85 or more) fails to meet in a tree with a chance of at most
0.031 at any depth (the fixed point of q = (0.15 + 0.85 q)^2, two branches), so in all of
five independent trees with 3e-8. The sketch's threshold turns down a linked pair with a chance of
at most ``miss``. Both are tested. No class, partner or candidate is capped.

Skew: copies fold into classes before any shuffle. Nodes are streamed in ranges of (node,
class), so a node with a third of all classes lies in many tasks, each with its own leaders.
Other joins by node broadcast the at most 256 nodes that hold a 256th of the rows or more.

Defined cases: words are parted by ASCII white space after lower-casing A-Z; a text with
fewer words than n has its whole word sequence as its one n-gram; null texts and texts
without words have the empty set and are linked with nothing, and so are rows without an id
(their component is null, and they are kept); repeated rows are one class; rows that share an
id are one document each, with the same id. Other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, ragged, spread_join, utf8, written
from sightline.llm.components import components
from sightline.llm.ngram_join import BITS, BLOCK_BITS, ngram_set, packed, unpacked, without
from sightline.llm.ngram_join import _gathered as gathered
from sightline.llm.ngram_join import _Hashes as Hashes

SETS_SEEN = 100_000
PROBES = 1024
FOUND = "found long, comp long, cid long, n long"


@dataclass(frozen=True)
class PathSpec:
    """``percent`` is the least similarity, ``sketch`` the number of minwise values, ``miss`` the chance
    that the sketch turns down a linked pair; a node has at most ``node`` classes to be compared
    exhaustively, a streamed node ``leaders`` leaders, a verifying task holds about ``held`` tokens."""

    size: int = 3
    percent: int = 85
    trees: int = 5
    branches: int = 2
    sketch: int = 256
    node: int = 256
    depth: int = 2
    leaders: int = 64
    rounds: int = 2
    counter_bits: int = 20
    held: int = 1 << 19
    miss: float = 1e-7
    seed: int = 11

    def __post_init__(self):
        if self.trees * self.branches > self.sketch:
            raise ValueError("the trees' first branches need a minwise value each")

    def agreement(self) -> int:
        """Least number of agreeing sketch values: fewer have a chance below ``miss`` for linked sets."""
        p, below = self.percent / 100, 0.0
        for k in range(self.sketch + 1):
            below += math.comb(self.sketch, k) * p**k * (1 - p) ** (self.sketch - k)
            if below > self.miss:
                return k
        return self.sketch


def multipliers(spec: PathSpec) -> np.ndarray:
    return np.random.default_rng(spec.seed).integers(1, 1 << 63, spec.sketch, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minwise values of a set: the least product with each factor, upper half."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 512):
        np.minimum(out, (tokens[at : at + 512, None] * factors).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _signed(spec: PathSpec):
    """(doc_id, n, digest, sig, sketch); the last two only where a task first meets a set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("sketch", pa.binary())])
    factors = multipliers(spec)

    def run(stream):
        known, seen = Hashes(), set()
        for whole in stream:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = batch.column(0).to_pylist()
                n, digests, sigs, sketches = [], [], [], []
                for i, text in zip(ids, utf8(batch.column(1)), strict=True):
                    tokens = ngram_set(text.lower().split(), spec.size, known)
                    n.append(len(tokens))
                    digest = xxhash.xxh3_128_digest(packed(tokens)) if len(tokens) and i is not None else None
                    digests.append(digest)
                    if digest is None or digest in seen:
                        sigs.append(None)
                        sketches.append(None)
                        continue
                    if len(seen) >= SETS_SEEN:
                        seen.clear()
                    seen.add(digest)
                    sig = minwise(tokens, factors)
                    sigs.append(sig.tobytes())
                    sketches.append((sig & 0xFF).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())],
                    schema=schema,
                )

    return run


def _branched(spec: PathSpec, roots: bool):
    """Rows (node, cid, sig) or, for the roots, (cid, sig): each follows its chosen tokens to children."""
    schema = pa.schema([("node", pa.int64()), ("cid", pa.int64())])

    def run(stream):
        for whole in stream:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                if not len(batch):
                    continue
                sig = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), "<u4").reshape(-1, spec.sketch)
                cid = batch.column(batch.num_columns - 2).to_numpy()
                at_row = np.arange(len(cid))
                nodes, ids = [], []
                if roots:
                    choices = [(mixed(np.full(len(cid), spec.seed * 1000 + k // spec.branches)), np.full(len(cid), k)) for k in range(spec.trees * spec.branches)]
                else:
                    node = batch.column(0).to_numpy().astype(np.uint64)
                    first = mixed(node + np.uint64(1)) % np.uint64(spec.sketch)
                    choices = [(node, first)]
                    for k in range(1, spec.branches):
                        step = np.uint64(1) + mixed(node + np.uint64(1 + k)) % np.uint64(spec.sketch - 1)
                        choices.append((node, (first + step) % np.uint64(spec.sketch)))
                for node, chosen in choices:
                    token = sig[at_row, chosen.astype(np.int64)].astype(np.uint64)
                    nodes.append(mixed(mixed(node + (chosen.astype(np.uint64) << np.uint64(40))) + token).astype(np.int64))
                    ids.append(cid)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ids))], schema=schema)

    return run


def _led(spec: PathSpec):
    """Streams rows (node, comp, cid, n, sketch) sorted by node; gives (cid, leader, score): the leader of
    another component that a class agrees with best.

    Held: the first ``node`` classes of a node, then its leaders.
    """
    schema = pa.schema([("cid", pa.int64()), ("leader", pa.int64()), ("score", pa.int32())])
    least = spec.agreement()

    def sizes_fit(a, b):
        return 100 * np.minimum(a, b) >= spec.percent * np.maximum(a, b)

    def chosen(comp, n, sketch):
        """Places of the leaders: again and again the class that most others agree with."""
        alike = np.empty((len(n), len(n)), bool)
        for k in range(len(n)):
            alike[k] = sizes_fit(n, n[k]) & (np.count_nonzero(sketch == sketch[k], axis=1) >= least)
        degree, free, out = alike.sum(axis=1), np.ones(len(n), bool), []
        while len(out) < spec.leaders and free.any():
            best = int(np.where(free, degree, -1).argmax())
            out.append(best)
            gone = alike[best] & free
            gone[best] = True
            free &= ~gone
            degree = degree - alike[:, gone].sum(axis=1)
        return np.array(out)

    def met(rows, leaders):
        comp, cid, n, sketch = leaders
        found = []
        for c, i, size, raw in rows:
            near = np.flatnonzero((comp != c) & sizes_fit(n, size))
            if len(near):
                score = np.count_nonzero(sketch[near] == np.frombuffer(raw, np.uint8), axis=1)
                best = int(score.argmax())
                if score[best] >= least:
                    found.append((i, int(cid[near[best]]), int(score[best])))
        return found

    def first(rows):
        comp, cid, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, spec.sketch)
        if len(set(comp.tolist())) < 2 and len(rows) < spec.node:
            return None, []
        lead = chosen(comp, n, sketch)
        leaders = comp[lead], cid[lead], n[lead], sketch[lead]
        return leaders, met(rows, leaders)

    def run(stream):
        at, rows, leaders = None, [], None
        for whole in stream:
            found = []
            for node, *row in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                if node != at:
                    if rows:
                        found += first(rows)[1]
                    at, rows, leaders = node, [], None
                if leaders is not None:
                    found += met([row], leaders)
                    continue
                rows.append(row)
                if len(rows) == spec.node:
                    leaders, some = first(rows)
                    found += some
                    rows = []
            columns = list(zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
        found = first(rows)[1] if rows else []
        columns = list(zip(*found)) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _compared(spec: PathSpec):
    """Streams rows (node, comp, cid, n, sketch) sorted by node; gives (found, comp, cid, n): the classes that
    agree enough with one of another component, in groups of those that hang together. At most one
    row per row read; ``found`` names a group by its classes, so nodes that find the same agree. Held: one node."""
    schema = pa.schema([(c, pa.int64()) for c in ("found", "comp", "cid", "n")])
    least = spec.agreement()

    def groups(rows):
        comp, cid, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, spec.sketch)
        _, kind, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        # Rows outside the largest component, each against those after it and all of that component.
        order = np.lexsort((cid, sizes[kind]))
        comp, cid, n, sketch = comp[order], cid[order], n[order], sketch[order]
        group, met = np.arange(len(cid)), np.zeros(len(cid), bool)
        for k in range(len(cid) - int(sizes.max())):
            rest = slice(k + 1, None)
            fit = (comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= spec.percent * np.maximum(n[rest], n[k]))
            near = np.flatnonzero(fit) + k + 1
            near = near[np.count_nonzero(sketch[near] == sketch[k], axis=1) >= least]
            if len(near):
                met[k] = met[near] = True
                group[np.isin(group, group[near])] = group[k]
        found = np.zeros(len(cid), np.int64)
        for g in np.unique(group[met]):
            within = group == g
            found[within] = np.array(xxhash.xxh3_64_intdigest(np.sort(cid[within]).tobytes()), np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (found, comp, cid, n)], schema=schema)

    def run(stream):
        at, rows = None, []
        for batch in stream:
            for node, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != at and rows:
                    yield groups(rows)
                    rows = []
                at = node
                rows.append(row)
        if rows:
            yield groups(rows)

    return run


def _linked(spec: PathSpec):
    """Streams (found, one, two, comp, cid, digest, text) sorted by the first three; gives links (a, b) that
    join the components of a group: one fewer than it has, at most. Held: the sets of one group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(sets, comps):
        ids, sizes = np.array(list(sets)), np.array([len(t) for t in sets.values()])
        every, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        part = np.unique([comps[i] for i in sets], return_inverse=True)[1]
        a, b = [], []
        for k, tokens in enumerate(sets.values()):
            if (part == part[k]).all():
                break
            left, right = np.searchsorted(every, tokens), np.searchsorted(every, tokens, "right")
            both = np.bincount(owner[ragged(left, right - left)], minlength=len(ids))
            for hit in np.flatnonzero((100 * both >= spec.percent * (sizes + len(tokens) - both)) & (part != part[k])):
                if part[hit] != part[k]:
                    part[part == part[hit]] = part[k]
                    a.append(int(ids[k]))
                    b.append(int(ids[hit]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(stream):
        known = Hashes()
        at, sets, comps = None, {}, {}
        for whole in stream:
            for k in range(0, len(whole), 64):
                part = whole.slice(k, 64)
                columns = [part.column(c).to_pylist() for c in range(6)]
                for found, one, two, comp, cid, digest, text in zip(*columns, utf8(part.column(6)), strict=True):
                    if (found, one, two) != at:
                        if len(sets) > 1:
                            yield links(sets, comps)
                        at, sets, comps = (found, one, two), {}, {}
                    tokens = ngram_set(text.lower().split(), spec.size, known)
                    if xxhash.xxh3_128_digest(packed(tokens)) == digest:  # else another row with the same id
                        sets[cid], comps[cid] = tokens, comp
        if len(sets) > 1:
            yield links(sets, comps)

    return run


def _confirmed(spec: PathSpec):
    """Streams (met, part, chunk, role, cid, digest, text) sorted by these: the sets of a part of a
    component are held while probes pass. A probe is given out with the first class of
    the part that it is linked with, which is enough, since the part's classes are one component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(stream):
        known = Hashes()
        at, targets, index = None, {}, None
        for whole in stream:
            a, b = [], []
            for k in range(0, len(whole), 64):
                part = whole.slice(k, 64)
                columns = [part.column(c).to_pylist() for c in range(6)]
                for met, block, chunk, role, cid, digest, text in zip(*columns, utf8(part.column(6)), strict=True):
                    if (met, block, chunk) != at:
                        at, targets, index = (met, block, chunk), {}, None
                    tokens = ngram_set(text.lower().split(), spec.size, known)
                    if xxhash.xxh3_128_digest(packed(tokens)) != digest:
                        continue  # another row with the same id
                    if role == 0:
                        targets[cid] = tokens
                        continue
                    if not targets:
                        continue
                    if index is None:
                        ids, sizes = np.array(list(targets)), np.array([len(t) for t in targets.values()])
                        every, owner = np.concatenate(list(targets.values())), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                        order = np.argsort(every, kind="stable")
                        index, targets = (every[order], owner[order]), dict.fromkeys(targets)
                    left, right = np.searchsorted(index[0], tokens), np.searchsorted(index[0], tokens, "right")
                    both = np.bincount(index[1][ragged(left, right - left)], minlength=len(ids))
                    hit = np.flatnonzero((100 * both >= spec.percent * (sizes + len(tokens) - both)) & (ids != cid))
                    if len(hit):
                        a.append(cid)
                        b.append(int(ids[hit[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with their component so far; a class without links is its own."""
    rows = rows.withColumn("comp", F.col("cid")) if labels is None else rows.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    return rows.select("node", "comp", "cid", "n", "sketch")


def _verified(meetings: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, spec: PathSpec) -> DataFrame:
    """Links (a, b): for each distinct (cid, met) a class of the component ``met`` that it is linked with.

    ``members`` has (met, cid, n). A component is cut into parts of about ``held`` tokens.
    """
    counts = meetings.groupBy("met").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("chunks"))
    asked = checkpointed(members.groupBy("met").agg(F.ceil(F.sum("n") / spec.held).cast("int").alias("parts"), F.count("*").alias("size")).join(counts, "met"))
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part")
    targets = spread_join(members.select("met", "cid"), asked, "met", "size", max(total[0], 1)).select(
        "met", part, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "cid"
    )
    probes = spread_join(meetings, asked, "met", "chunks", max(total[1], 1)).select(
        "met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(1).alias("role"), "cid",
    )
    rows = targets.unionByName(probes).join(classes.select("cid", "first_id", "digest"), "cid")
    rows = rows.join(docs.select(F.col("doc_id").alias("first_id"), "text"), "first_id").select("met", "part", "chunk", "role", "cid", "digest", "text")
    dealt = rows.repartition("met", "part", "chunk").sortWithinPartitions("met", "part", "chunk", "role")
    return dealt.mapInArrow(_confirmed(spec), "a long, b long")


def _joined(groups: DataFrame, classes: DataFrame, docs: DataFrame, spec: PathSpec) -> DataFrame:
    """Links (a, b) between the components of each group of (found, comp, cid, n), confirmed on full sets.

    A group of more than about ``held`` tokens is cut into parts, every two of which meet once.
    """
    parts = groups.groupBy("found").agg(F.ceil(F.sum("n") / spec.held).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cid", F.lit(spec.seed)), F.col("parts")).cast("int")
    rows = groups.join(parts, "found").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.where("parts = 1 OR part != other").select(
        "found", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "comp", "cid"
    )
    rows = rows.join(classes.select("cid", "first_id", "digest"), "cid")
    rows = rows.join(docs.select(F.col("doc_id").alias("first_id"), "text"), "first_id").select("found", "one", "two", "comp", "cid", "digest", "text")
    dealt = rows.repartition("found", "one", "two").sortWithinPartitions("found", "one", "two")
    return dealt.mapInArrow(_linked(spec), "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    """(node, size) of the nodes with two classes or more."""
    return checkpointed(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))


def path_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: PathSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable over
    links, itself included) and kept (the row has that id)."""
    spec = spec or PathSpec()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_signed(spec), "doc_id long, n long, digest binary, sig binary, sketch binary"), "path-rows")
    grouped = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("sig").alias("sig"), F.max("sketch").alias("sketch")
    )
    # Numbered once and stored; from here on the numbers are fixed.
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "path-classes")
    n_classes = classes.count()

    # First level of all trees.
    slim = classes.select("cid", "sig").mapInArrow(_branched(spec, roots=True), "node long, cid long")
    total = max(n_classes * spec.trees * spec.branches, 1)
    sketches = classes.select("cid", "n", "sketch")
    members = written(spread_join(slim, _shared(slim), "node", "size", total).join(sketches, "cid").select("node", "cid", "n", "sketch"), "path-members")

    # Leaders.
    links, tried, labels = None, None, None
    for turn in range(spec.rounds):
        named = _named(members, labels)
        streamed = named.withColumn("turn", F.xxhash64("cid", F.lit(spec.seed + turn))).repartitionByRange("node", "turn").sortWithinPartitions("node", "turn")
        led = streamed.select("node", "comp", "cid", "n", "sketch").mapInArrow(_led(spec), "cid long, leader long, score int")
        best = led.groupBy("cid").agg(F.max(F.struct("score", "leader"))["leader"].alias("met"))
        pairs = best.select(F.least("cid", "met").alias("cid"), F.greatest("cid", "met").alias("met")).distinct()
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["cid", "met"], "left_anti"))
        leaders = pairs.select("met").distinct().join(classes.select(F.col("cid").alias("met"), "n"), "met").select("met", F.col("met").alias("cid"), "n")
        linked = checkpointed(_verified(pairs, leaders, classes, docs, spec))
        links = linked if links is None else links.unionByName(linked)
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = checkpointed(components(links).select(F.col("node").alias("cid"), F.col("component").alias("comp")))

    # Across components: small nodes at once, larger ones down their trees.
    level, met, groups = members, [], []
    for depth in range(spec.depth + 2):
        named = _named(level, labels)
        stats = named.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top"))
        stats = stats.select("node", "size", F.col("top.k").alias("top"), F.col("top.comp").alias("main")).where("top < size")
        # Classes of a large node that is mostly one component are held against that as a whole.
        main = F.when((F.col("size") > spec.node) & (2 * F.col("top") > F.col("size")), F.col("main"))
        open_nodes = checkpointed(stats.select("node", "size", main.alias("main"), F.when(main.isNull(), F.col("size")).otherwise(F.col("size") - F.col("top")).alias("left")))
        total = max(open_nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 1)
        opened = spread_join(named, open_nodes, "node", "size", total).where("main IS NULL OR comp != main")
        met.append(opened.where("main IS NOT NULL").select("cid", F.col("main").alias("met")))
        small = opened.where(F.col("left") <= spec.node).select("node", "comp", "cid", "n", "sketch")
        groups.append(written(small.repartition("node").sortWithinPartitions("node").mapInArrow(_compared(spec), FOUND).distinct(), "path-found"))
        large = open_nodes.where(F.col("left") > spec.node)
        if large.isEmpty():
            break
        wide = opened.where(F.col("left") > spec.node)
        if depth > spec.depth:
            groups.append(written(_by_blocks(wide, spec).distinct(), "path-found"))
            break
        if depth == spec.depth:
            branches = _rarest(wide.select("cid").distinct(), classes, docs, spec)
        else:
            sigs = wide.select("node", "cid").join(classes.select("cid", "sig"), "cid").select("node", "cid", "sig")
            branches = sigs.mapInArrow(_branched(spec, roots=False), "node long, cid long").distinct()
        children = written(branches, "path-children")
        level = written(
            spread_join(children, _shared(children), "node", "size", max(children.count(), 1)).join(sketches, "cid").select("node", "cid", "n", "sketch"),
            "path-members",
        )

    rest = met[0]
    for more in met[1:]:
        rest = rest.unionByName(more)
    rest = checkpointed(rest.distinct())
    sizes = classes.select("cid", "n").join(labels, "cid", "left").select(F.coalesce("comp", "cid").alias("met"), "cid", "n")
    asked = sizes.join(rest.select("met").distinct(), "met", "left_semi")
    found = groups[0]
    for more in groups[1:]:
        found = found.unionByName(more)
    confirmed = _joined(written(found.distinct(), "path-groups"), classes, docs, spec)
    if not rest.isEmpty():
        confirmed = confirmed.unionByName(_verified(rest, asked, classes, docs, spec))
    final = components(links.unionByName(checkpointed(confirmed)))

    joined = classes.select("cid", "digest", "first_id", "copies").join(final.withColumnRenamed("node", "cid"), "cid", "left")
    joined = joined.withColumn("component", F.coalesce("component", "cid"))
    sizes = checkpointed(joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")))
    named = written(
        spread_join(joined, sizes, "component", "members", max(n_classes, 1)).select("digest", "component_id", "copies"), "path-named"
    )
    filled = rows.where("digest IS NOT NULL").select("doc_id", "n", "digest")
    count = max(int(named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]), 1)
    linked = spread_join(filled, named, "digest", "copies", count).select("doc_id", "n", "component_id")
    alone = rows.where("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _rarest(wanted: DataFrame, classes: DataFrame, docs: DataFrame, spec: PathSpec) -> DataFrame:
    """(node, cid): each wanted class at all of its rarest tokens, enough that a linked class shares one."""
    schema = pa.schema([("cid", pa.int64()), ("tokens", pa.binary())])
    wide, shift = 1 << BLOCK_BITS, np.uint64(BITS - spec.counter_bits)

    def read(stream):
        known = Hashes()
        for whole in stream:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                sets = [packed(ngram_set(t.lower().split(), spec.size, known)) for t in utf8(batch.column(2))]
                same = [xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema).filter(pa.array(same, pa.bool_()))

    def count(stream):
        counts = np.zeros(1 << spec.counter_bits, np.int32)
        for batch in stream:
            for data in batch.column(0).to_pylist():
                np.add.at(counts, (unpacked(data) >> shift).astype(np.int64), 1)
        parts = counts.reshape(-1, min(wide, len(counts)))
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].astype("<i4").tobytes() for k in used], pa.binary())], names=["block", "data"])

    rows = wanted.join(classes.select("cid", "first_id", "digest"), "cid").join(docs.select(F.col("doc_id").alias("first_id"), "text"), "first_id")
    sets = written(rows.select("cid", "digest", "text").mapInArrow(read, "cid long, tokens binary"), "path-sets")
    total = np.zeros(1 << spec.counter_bits, np.int64).reshape(-1, min(wide, 1 << spec.counter_bits))
    for block, part in gathered(sets.select("tokens").mapInArrow(count, "block long, data binary"), "<i4", np.add).items():
        total[block] = part
    often = sets.sparkSession.sparkContext.broadcast(total.ravel())

    def follow(stream):
        for whole in stream:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                nodes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for cid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tokens = unpacked(data)
                    kept = len(tokens) + (-spec.percent * len(tokens)) // 100 + 1
                    order = np.lexsort((tokens, often.value[(tokens >> shift).astype(np.int64)]))[:kept]
                    nodes.append(mixed(tokens[order]).astype(np.int64))
                    ids.append(np.full(kept, cid, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ids))], names=["node", "cid"])

    return sets.mapInArrow(follow, "node long, cid long").distinct()


def _by_blocks(wide: DataFrame, spec: PathSpec) -> DataFrame:
    """Groups of ``_compared`` in nodes that branching did not cut down: every two blocks of a node's rows meet once."""
    half = max(spec.node // 2, 1)
    blocks = F.ceil(F.col("left") / half).cast("int")
    rows = wide.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(spec.seed)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "comp", "cid", "n", "sketch"
    )
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_compared(spec), FOUND)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: PathSpec | None = None) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; all columns stay.

    A document without an id stays.
    """
    gone = path_components(docs, id_col, text_col, spec).where("NOT kept")
    return without(docs, F.col(id_col).cast("long"), gone.select(F.col("doc_id").alias("_gone")).distinct())
