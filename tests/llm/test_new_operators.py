"""Chosen-path join, whitening and fill-in-the-middle: awkward cases against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import queries
from sightline.llm.chosen_path import PathSpec, _compared, drop_near_copies, minwise, multipliers, path_components
from sightline.llm.fill_middle import MiddleSpec, Summaries, chunk_starts, combined, fill_in_middle, restored
from sightline.llm.whitening import WhitenSpec, coded, decoded, deviations, whiten, whitened_components
from tests.llm import helpers as plain

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def near_groups(rows, size=3, percent=85):
    """id -> (set size, smallest linked id), by counting shared n-grams of all pairs."""
    sets, holders, parent = {}, defaultdict(list), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", plain.ascii_lower(rows[i] or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent[i] = i
        shared = defaultdict(int)
        for gram in sets[i]:
            for j in holders[gram]:
                shared[j] += 1
            holders[gram].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = plain.prose(rng, 1)
    return " ".join(words)


@pytest.mark.parametrize(
    "spec", [PathSpec(), PathSpec(node=8, depth=2, leaders=1, rounds=1), PathSpec(node=4, depth=0, leaders=1)], ids=["usual", "deep", "blocks"]
)
def test_path_components(spark, spec):
    rng = random.Random(5)
    base, other = plain.prose(rng, 200), plain.prose(rng, 90)
    texts = [None, "", " \n ", "one two", "One  TWO", "one", base, base.upper(), base + " and more", "é " * 400, "\x00 a"]
    texts += [edited(rng, base, rng.choice([1, 4, 5, 6, 12])) for _ in range(60)] + [edited(rng, other, 2) for _ in range(20)] + [base] * 30
    texts += [f"{plain.prose(rng, 40)} {other}" for _ in range(10)] + [plain.prose(rng, 5000)] * 2
    got = path_components(plain.documents(spark, texts, extra=True), spec=spec).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_groups(dict(enumerate(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_path_repeats_null_ids_and_empty(spark):
    rng = random.Random(6)
    a, b = plain.prose(rng, 50), plain.prose(rng, 60)
    df = spark.createDataFrame([(3, a), (3, a), (3, b), (5, b), (None, a), (None, None), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in path_components(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 48, -1, True), (3, 48, 3, True), (3, 48, 3, True), (3, 58, 3, True), (5, 58, 3, False), (7, 0, 7, True)]
    assert path_components(df.limit(0)).count() == 0
    extra = plain.documents(spark, [a, a, b, None], extra=True)
    left = drop_near_copies(extra)
    assert left.columns == extra.columns and {r["doc_id"] for r in left.collect()} == {0, 2, 3}


def test_sketches_estimate_similarity_and_turn_down_no_linked_pair():
    spec, rng = PathSpec(), np.random.default_rng(1)
    factors, least = multipliers(spec), spec.agreement()
    shares = []
    for _ in range(300):
        both = rng.integers(0, 1 << 48, 340, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 48, 30, dtype=np.uint64)]) for _ in range(2))
        agree = int(np.count_nonzero((minwise(a, factors) & 0xFF) == (minwise(b, factors) & 0xFF)))
        assert agree >= least
        shares.append(agree / spec.sketch)
    assert abs(np.mean(shares) - 0.85) < 0.01 and 0.7 < least / spec.sketch < 0.8
    with pytest.raises(ValueError):
        PathSpec(trees=200)


def test_alike_unlinked_classes_give_a_row_each():
    spec, rng = PathSpec(), np.random.default_rng(2)
    base, k = rng.integers(0, 256, spec.sketch, dtype=np.uint8), 120
    sketches = np.tile(base, (k, 1))
    for row in sketches:  # every two agree in some 200 places, as sets do that are alike without being linked
        row[rng.choice(spec.sketch, 28, replace=False)] = rng.integers(0, 256, 28, dtype=np.uint8)
    columns = [pa.array([1] * k + [2] * k), pa.array([*range(k)] * 2), pa.array([*range(k)] * 2), pa.array([300] * 2 * k)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in sketches] * 2)], names=["node", "comp", "cid", "n", "sketch"])
    out = pa.Table.from_batches(_compared(spec)(iter([batch])))
    assert out.num_rows == 2 * k and sorted(out.column("cid").to_pylist()) == sorted([*range(k)] * 2)
    assert len(set(out.column("found").to_pylist())) == 1  # both nodes find the same group


def test_path_groups_are_cut_into_parts(spark):
    rng = random.Random(9)
    base = plain.prose(rng, 120)
    texts = [edited(rng, base, rng.choice([2, 3, 7, 8])) for _ in range(50)]
    got = path_components(plain.documents(spark, texts), spec=PathSpec(held=700, leaders=1, rounds=1)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_groups(dict(enumerate(texts)))


def test_op11(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op11_chosen_path"](spark, SF).collect()}
    assert got == near_groups(rows)


def plain_whitening(vectors, k=8, once=False):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    fit = np.unique(x, axis=0) if once else x
    n, s = len(fit), fit.sum(axis=0)
    exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, exact, (x - s / n) @ u / np.sqrt(e), e / np.trace(cov)


def check_whitening(rows, ids, want, k):
    n, exact, white, explained = want
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(ids) * k
    turn = [np.sign(sum(by[i, c + 1]["whitened"] * white[j, c] for j, i in enumerate(ids))) for c in range(k)]
    for j, i in enumerate(ids):
        for c in range(k):
            r = by[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, exact[j])
            assert abs(r["whitened"] * turn[c] - white[j, c]) < 1e-8 and abs(r["explained"] - explained[c]) < 1e-8
            assert r["identity_error"] < 1e-9


def test_op12(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check_whitening(queries.QUERIES["op12_whitening"](spark, SF).collect(), [i for i, _ in good], plain_whitening([v for _, v in good]), 8)


VECTORS = "vec_id long, embedding array<float>, code string, copies int, dims int, weight string"


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, "a", 1, 2, "w") for i, v in enumerate(vectors)], VECTORS)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_of_copies_and_bad_rows(spark, weights):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).round(3).tolist()
    vectors = good + [good[0]] * 700 + [None, [], [None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0], [1e30] * 5]
    spec = WhitenSpec(weights=weights)
    got = whitened_components(embeddings(spark, vectors), spec=spec).collect()
    want = plain_whitening(np.float32(good + [good[0]] * 700), once=weights == "one")
    if weights == "counts":
        check_whitening(got, range(740), want, 5)
    else:
        assert {r["n"] for r in got} == {want[0]} and {(r["vec_id"], r["deviation"]) for r in got} == set(enumerate(want[1]))


def test_whitening_without_variance(spark):
    assert whitened_components(embeddings(spark, [])).collect() == []
    assert whitened_components(embeddings(spark, [None, [None]])).collect() == []
    got = whitened_components(embeddings(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(got) == 6 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, None, 0.0)}
    line = whiten(embeddings(spark, [[1.0, 2.0], [2.0, 2.0], [3.0, 2.0]])).collect()
    assert all(r["whitened"][1] is None and r["explained"] == [1.0, 0.0] for r in line)
    wide = whitened_components(embeddings(spark, [[9e6, -9e6], [0.0, 0.0]] * 2)).collect()
    assert {r["deviation"] for r in wide} == {None} and len(wide) == 8


def test_codes_and_exact_deviations():
    rng = random.Random(2)
    for reach in (100, 1 << 20, 1 << 40):
        rows = [[rng.randint(-reach, reach) for _ in range(4)] for _ in range(20)]
        assert decoded([coded(np.array(r)) for r in rows], 4).tolist() == rows
        for n in (20, 10_000_019):
            sums = [rng.randint(-reach * n, reach * n) for _ in range(4)]
            assert deviations(np.array(rows), n, sums) == [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in rows]


@pytest.mark.parametrize("spec", [MiddleSpec(), MiddleSpec(cut_bits=3, longest=16, kept_bytes=500)], ids=["usual", "small"])
def test_chunk_counts_locate_units(spec):
    rng = random.Random(8)
    summaries = Summaries(spec.kept_bytes)
    for _ in range(300):
        text = "".join(rng.choice("ab é\n字 \t😀\x0b x\x1c\x85") for _ in range(rng.choice([0, 1, 5, 50, 400, 3000])))
        doc, ends = combined(text.encode(), summaries, spec), [m.end() for m in UNIT.finditer(text)]
        assert doc.units == len(ends)
        for k in {0, len(ends), *(rng.randrange(len(ends) + 1) for _ in range(6))}:
            chars = ends[k - 1] if k else 0
            assert doc.cut(k) == (len(text[:chars].encode()), chars)


def test_equal_passages_share_chunks_and_chunks_are_bounded():
    spec, rng = MiddleSpec(), random.Random(9)
    passage = plain.prose(rng, 2000)
    chunks = []
    for before in (100, 777):
        text = f"{plain.prose(rng, before)} {passage}".encode()
        starts = chunk_starts(np.frombuffer(text, np.uint8), spec).tolist()
        chunks.append({text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])})
    assert sum(map(len, chunks[0] & chunks[1])) > 0.9 * len(passage)
    long = np.frombuffer(("字" * 800_000).encode(), np.uint8)
    starts = chunk_starts(long, spec)
    assert np.diff(np.append(starts, len(long))).max() <= spec.longest + 3 and not (long[starts] & 0xC0 == 0x80).any()


def plain_middle(doc_id, text, spec):
    text, u = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"{spec.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= spec.rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if h[3] % 100 < spec.spm_rate:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100, 0])
def test_fill_in_middle(spark, rate):
    rng, spec = random.Random(10), MiddleSpec(rate=rate, spm_rate=50)
    texts = [None, "", " ", "\n\ta", "one", "a <P> b c", "x<S>", "<M>", "< S > <P", plain.prose(rng, 9000) + " ", "字 é\x00 😀 " * 300]
    texts += [f"<{plain.prose(rng, n)}<\n" for n in range(1, 40)] + ["same text here"] * 3
    df = plain.documents(spark, texts, extra=True)
    made = fill_in_middle(df, spec=spec)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"), spec)).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {i: plain_middle(i, t, spec) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["back"] for r in got} == {i: t or "" for i, t in enumerate(texts)}
    assert fill_in_middle(df.limit(0), spec=spec).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d")] * 2, "doc_id long, text string")
    assert [tuple(r)[1:] for r in fill_in_middle(nulls, spec=spec).collect()] == [plain_middle(None, "a b c d", spec)] * 2


def test_marks_must_be_apart():
    with pytest.raises(ValueError):
        MiddleSpec(prefix_mark="<", suffix_mark="<S>")
