"""Quality rules, decontamination, personal data, n-gram join: awkward cases against plain versions."""

import random

import numpy as np
import pytest

from sightline.llm.decontamination import contamination, drop_contaminated
from sightline.llm.ngram_join import JoinSpec, keep_first, ngram_components
from sightline.llm.pii import (
    Tagger, TaggerSpec, all_spans, base_spans, evened, luhn, mask_pii, none_of_these, pii_report, plausible, reconciled, tagged_spans, training_windows,
    trained_tagger, written_otherwise,
)
from sightline.llm.quality_rules import QualityRules, judge, quality_filter, quality_report
from tests.llm import helpers as plain

RNG = random.Random(4)
LONG = plain.prose(RNG, 6000)
BASE = plain.prose(RNG, 120)
AWKWARD = [None, "", " \n\t ", "one two", "One TWO", LONG, LONG, BASE, BASE.replace(" ", "\n", 3), BASE + " and more", "é " * 400, "\x00 a", "ａ" * 50]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = plain.prose(rng, 1)
    return " ".join(words)


def test_quality_counts(spark):
    texts = AWKWARD + ["a b c d e f a b c d e f g h i j", "x\nx\n \nx", "Menu | Home | About | Contact us\n" + plain.prose(RNG, 80)]
    got = {r["doc_id"]: r for r in quality_report(plain.documents(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain.quality_counts(t)
        assert {k: got[i][k] for k in want} == want
        assert not (want["base_failed"] and got[i]["kept"])


def test_quality_filter_cleans_and_rejects(spark):
    clean = ". ".join(plain.prose(RNG, 12) for _ in range(8)) + "."
    nav = "Home | About | Contact | Jobs"
    junk = " ".join(w + "###" for w in plain.prose(RNG, 60).split())
    df = plain.documents(spark, [clean, f"{nav}\n{clean}", junk, None, clean], extra=True)
    got = {r["doc_id"]: r for r in quality_filter(df).collect()}
    assert set(got) == {0, 1, 4}
    assert got[1]["text"] == clean and got[1]["n_chars"] == len(clean) and got[0]["text"] == clean
    assert quality_filter(df).columns == df.columns
    assert quality_filter(df.limit(0)).count() == 0


def test_a_phrase_does_not_take_a_long_line(spark):
    rng = random.Random(12)
    first, second = (plain.prose(rng, 400) for _ in range(2))
    lorem = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
    one_line = [f"{plain.prose(rng, 400)} {x} {plain.prose(rng, 400)}" for x in ("click here", "our Privacy Policy, our terms of use", "the words lorem ipsum")]
    short = ["All rights reserved.", "Copyright 2024 Example Company, all rights reserved.", "Please enable JavaScript to view the comments on it.", "You accept our terms of use and privacy policy by reading on", lorem]
    texts = [*one_line, "\n".join(one_line), *(f"{first}\n{x}\n{second}" for x in short), lorem]
    df = plain.documents(spark, texts)
    got = {r["doc_id"]: r["text"] for r in quality_filter(df).collect()}
    assert [got.get(i) for i in range(4)] == texts[:4]
    assert [got.get(i) for i in range(4, 4 + len(short))] == [f"{first}\n{second}"] * len(short)
    assert len(texts) - 1 not in got
    report = {r["doc_id"]: (r["n_failed_lines"], r["lost_chars"], r["kept"]) for r in quality_report(df).collect()}
    assert [report[i] for i in range(4)] == [(0, 0, True)] * 4


FURNITURE = [
    "Home About Us Products Contact Login", "Share on Facebook Share on Twitter", "Copyright 2024 Example Inc.", "Sign in", "Read more",
    "Buy now!!! Limited offer!!!", "Startseite Über uns Kontakt Impressum", "Mon compte Panier", "Iniciar sesión Registrarse", "© 2019 Verlag Beispiel GmbH.",
    "Newsletter", "Tags: Politics Europe Economy", "Next Article »".rstrip(" »"), "Ähnliche Artikel",
]
PROSE = [
    "The council met on Monday and agreed on a plan for the bridge over the river, which had been closed since spring.\n"
    "How the work will be paid for\nNobody knew.\n\"Who pays?\" asked Mary Smith of Leeds Green Party.\nIn 2019 Copyright law was changed, and the members said that they had been told of it too late.",
    "Die Brücke über den Fluss war seit dem Frühjahr gesperrt, weil die Pfeiler dem Hochwasser des\nWinters und den Lasten der Züge\nnicht mehr standhielten.\n"
    "Der Rat der Stadt beschloss am Montag einen Plan.\nSah ein Knab ein Röslein stehn,\nRöslein auf der Heiden,\nwar so jung und morgenschön.",
    "Le conseil s'est réuni lundi et a adopté un plan pour le pont.\nPourquoi le pont est fermé\n« Nous attendons depuis longtemps », a dit Marie Dupont.\nPersonne ne savait.",
    "El consejo se reunió el lunes y aprobó un plan para el puente.\n¿Quién paga?\n¡Nadie lo sabía!\nLa obra de la ciudad empieza en mayo y termina en otoño",
    "市议会星期一开会\n通过了桥梁计划\n没有人知道", "اجتمع المجلس يوم الاثنين\nووافق على خطة",
]


@pytest.mark.parametrize("line", FURNITURE)
def test_furniture_is_told_by_its_build(line):
    rules, prose = QualityRules(), PROSE[0].split("\n")[0]
    assert judge(f"{prose}\n{line}\n{prose[:-1]} again.", rules)["clean"] == f"{prose}\n{prose[:-1]} again."


@pytest.mark.parametrize("text", PROSE)
def test_prose_keeps_every_line(text):
    """Headings in small letters, verses, short sentences, broken lines, scripts without capitals."""
    assert judge(text, QualityRules())["clean"] == text


@pytest.mark.parametrize("limit", [50_000, 0])
def test_contamination(spark, limit):
    rng = random.Random(9)
    items = {0: plain.prose(rng, 30), 1: plain.prose(rng, 12), 2: "Short item Here", 3: None, 4: "!!", 5: plain.prose(rng, 1), 6: None}
    items[6] = items[1]
    texts = [*AWKWARD, f"{BASE}, {items[0].upper()} {BASE}", items[1].replace(" ", "--"), "a SHORT item, here!", items[5], items[0] + " " + items[0], items[0][:-8], items[2]]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = contamination(plain.documents(spark, texts, extra=True), bench, set_limit=limit).collect()
    want = plain.contamination(dict(enumerate(texts)), items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in got} == want
    kept = {r["doc_id"] for r in drop_contaminated(plain.documents(spark, texts), bench).collect()}
    assert kept == {d for d, x in want.items() if not x[1]}


def test_contamination_repeats_and_empty(spark):
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    df = spark.createDataFrame([(1, BASE), (1, BASE), (None, BASE), (2, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_hit"]) for r in contamination(df, bench).collect())
    assert got == [(0, 120), (1, 120), (1, 120), (2, 0)]
    assert contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(df.limit(0), bench).count() == 0


def test_base_spans_fuzz():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("0123456789.. -+()@@aZ_%é") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain.personal_data(text)


TRAINING = TaggerSpec(steps=60, sample=200)


def test_pii_report_and_mask(spark):
    rng = random.Random(3)
    made = [
        f"{plain.prose(rng, 9)} {x} {plain.prose(rng, 7)}"
        for _ in range(25)
        for x in (f"{plain.prose(rng, 1)}@mail.example.com", f"{rng.randint(1, 255)}.9.{rng.randint(1, 255)}.7", "4111 1111 1111 1111", "+1 (415) 555-2671")
    ]
    texts = [*AWKWARD, *made]
    df = plain.documents(spark, texts, extra=True)
    got = {r["doc_id"]: r for r in pii_report(df, spec=TRAINING).collect()}
    for i, t in enumerate(texts):
        base = [f"{k}:{a}:{b}" for k, a, b in plain.personal_data(t or "")]
        assert got[i]["base_spans"] == ",".join(base)
        assert set(base) <= set(got[i]["spans"].split(","))
    masked = {r["doc_id"]: r for r in mask_pii(df, spec=TRAINING).collect()}
    assert masked[0]["text"] is None and masked[5]["text"] == LONG
    assert "@" not in masked[len(AWKWARD)]["text"] and "<email>" in masked[len(AWKWARD)]["text"]
    assert masked[len(AWKWARD)]["n_chars"] == len(masked[len(AWKWARD)]["text"])
    none = plain.documents(spark, ["no data here", None])
    assert trained_tagger(none) is None and [r["spans"] for r in pii_report(none).collect()] == ["", ""]
    assert pii_report(df.limit(0)).count() == 0


def test_tagger_learns_held_out_spans():
    rng = random.Random(8)

    def text():
        x = rng.choice([f"{plain.prose(rng, 1)}@a{rng.randint(0, 9)}.example.org", f"10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}", f"+1 (415) 555-{rng.randint(1000, 9999)}"])
        return f"{plain.prose(rng, 8)} {x} {plain.prose(rng, 8)}"

    spec = TaggerSpec(steps=120)
    train, held = [text() for _ in range(300)], [text() for _ in range(60)]
    tagger = Tagger(spec).start()
    losses = tagger.train(*training_windows(train, spec))
    assert losses[-1] < 0.1 * losses[0]
    found = tagged_spans(held, tagger)
    assert sum(b in f for t, f in zip(held, found) for b in plain.personal_data(t)) >= 0.9 * len(held)


def test_deepest_window_decides_from_the_first_mark_on():
    spec = TaggerSpec()

    def paths(marks, n):
        out = np.zeros((n, spec.window), np.int64)
        for w, a, b in marks:
            out[w, a:b] = 2
            out[w, a] = 1
        return out

    late = paths([(1, 1, 9)], 2)
    assert reconciled(200, [0, 32], late, spec) == []
    # The same passage behind another hit, and with the hit behind it.
    assert reconciled(400, [0, 192, 224], paths([(0, 5, 12), (2, 1, 9)], 3), spec) == [("email", 5, 12)]
    assert reconciled(400, [0, 32, 300], paths([(1, 1, 9), (2, 5, 12)], 3), spec) == [("email", 305, 312)]
    assert reconciled(200, [0, 32], paths([(0, 33, 41)], 2), spec) == [("email", 33, 41)]
    rng = np.random.default_rng(4)
    for _ in range(200):
        starts = sorted(rng.choice(20, 6, replace=False) * spec.stride)
        length = int(starts[-1]) + int(rng.integers(1, 64))
        tags = rng.integers(0, 9, (6, spec.window)) * (rng.random((6, 1)) < 0.5)
        best = [max(((min(p - s, s + 63 - p), -w, w) for w, s in enumerate(starts) if s <= p < s + 64), default=None) for p in range(length)]
        flat = [0 if b is None else int(tags[b[2], p - starts[b[2]]]) for p, b in enumerate(best)]
        inside = {p for _, a, b in reconciled(length, [int(s) for s in starts], tags, spec) for p in range(a, b)}
        assert inside == {p for p, t in enumerate(flat) if t}


def test_tagger_gradients():
    import numpy as np

    spec = TaggerSpec(window=6, embed=3, hidden=2)
    tagger = Tagger(spec).start()
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 20, (3, 6)), rng.integers(0, 9, (3, 6))
    _, grads = tagger.gradients(codes, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        values = []
        for step in (1e-5, -1e-5):
            tagger.w[name][at] += step
            values.append(tagger.gradients(codes, tags)[0])
            tagger.w[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))


@pytest.mark.parametrize("spec", [JoinSpec(), JoinSpec(sketch_bits=6, block=3, chunk=4, run=4, fragments=3), JoinSpec(fragments=1, block=2)])
def test_ngram_components(spark, spec):
    rng = random.Random(6)
    passage = plain.prose(rng, 60)
    texts = list(AWKWARD)
    for base in (plain.prose(rng, 60), plain.prose(rng, 150)):
        texts += [edited(rng, base, rng.randint(0, 5)) for _ in range(40)]
    texts += [f"{plain.prose(rng, rng.randint(20, 90))} {passage} {plain.prose(rng, rng.randint(0, 40))}" for _ in range(30)]
    texts += [passage, passage.upper(), passage + " tail"]
    df = plain.documents(spark, texts, extra=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(df, spec=spec).collect()}
    want = plain.near_groups(dict(enumerate(texts)))
    assert got == want
    if spec == JoinSpec():
        kept = keep_first(df)
        assert kept.columns == df.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_ngram_components_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, BASE), (3, BASE), (3, BASE), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect())
    assert got == [(-1, 116, 3), (3, 116, 3), (3, 116, 3), (4, 0, 4)]
    assert ngram_components(df.limit(0)).count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    """Pipeline, near_duplicates: only documents that may go meet the ids that go."""
    from pyspark.sql import functions as F

    from sightline.llm.ngram_join import parted, without

    docs = spark.range(20_000).selectExpr("IF(id % 1000 = 7, NULL, id) AS doc_id", "'text' AS text").unionByName(spark.createDataFrame([(30, "again")], "doc_id long, text string"))
    gone = spark.range(0, 20_000, 10).select(F.col("id").alias("_gone"))
    sure, rest = parted(docs, F.col("doc_id"), gone)
    assert sure.count() + rest.count() == 20_001
    assert rest.count() < 2_200
    got = [r["doc_id"] for r in without(docs, F.col("doc_id"), gone).collect()]
    assert sorted(i for i in got if i is not None) == [i for i in range(20_000) if i % 10 and i % 1000 != 7]
    assert got.count(None) == 20


def private(rng):
    """A value of each kind as the patterns find it."""
    card = f"4{rng.randint(10**13, 10**14 - 1)}"
    card += next(str(d) for d in range(10) if luhn(card + str(d)))
    return rng.choice([
        f"{plain.prose(rng, 1)}@mail{rng.randint(0, 9)}.example.org", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card,
        f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ])


def test_tagger_adds_other_writings_and_leaves_other_numbers():
    rng, other = random.Random(12), np.random.default_rng(5)
    spec = TaggerSpec(variants=6)
    train = [f"{plain.prose(rng, 15)} {private(rng)} {plain.prose(rng, 15)}" for _ in range(240)]
    tagger = Tagger(spec).start()
    tagger.train(*evened(*training_windows(train, spec)))
    right = found = wanted = 0
    for _ in range(200):
        value = private(rng)
        kind = base_spans(value)[0][0]
        form, a, b = written_otherwise(kind, value, other)
        before = plain.prose(rng, 12) + " "
        text = f"{before}{form} {plain.prose(rng, 12)}"
        base, spans = all_spans([text], tagger)[0]
        want = (kind, len(before) + a, len(before) + b)
        if all(want[2] <= x or y <= want[1] for _, x, y in base):
            added = [s for s in spans if s not in base]
            wanted, found, right = wanted + 1, found + len(added), right + (want in added)
    assert wanted > 150 and right >= 0.9 * wanted and right >= 0.9 * found
    clean = [f"{plain.prose(rng, 10)} {none_of_these(other)} {plain.prose(rng, 10)}" for _ in range(300)]
    assert sum(bool(a) for _, a in all_spans(clean, tagger)) <= 3
    # The same spans however the windows are sliced, and in one long text as in its pieces' places.
    long = "\n".join(clean[:20] + train[:20]) * 30
    assert tagged_spans([long], tagger, rows=37) == tagged_spans([long], tagger, rows=4096)


def test_plausible_values():
    def check(kind, piece, before="x ", after=" y"):
        return [(before + piece + after)[a:b] for _, a, b in plausible(before + piece + after, kind, len(before) - 1, len(before) + len(piece))]

    assert check("card", "4111.1111.1111.1111") == ["4111.1111.1111.1111"]
    assert check("card", "4111.1111.1111.1112") == [] == check("card", "4111111111111111", after="9")
    assert check("card", "1234567812345678 4111111111111111") == ["4111111111111111"]
    assert check("ip", "10[.]0[.]0[.]7") == ["10[.]0[.]0[.]7"] and check("ip", "10[.]0[.]0[.]256") == []
    assert check("phone", "(415) 555-2671") == ["(415) 555-2671"]
    assert check("phone", "4155552671") == check("phone", "2024-01-02") == check("phone", "415 555 2671 a") == []
    assert check("email", "a.b [at] c [dot] de") == ["a.b [at] c [dot] de"] and check("email", "at home.de") == []


def test_sample_windows_are_bounded():
    spec = TaggerSpec(windows=5, variants=1, spans=2)
    text = " ".join(["4111111111111111 and 7 or", "10.0.0.7"] * 2000)
    codes, tags = training_windows([text], spec)
    assert len(codes) == len(tags) <= 5 * 2 * (1 + 2 * 2) and tags.any()
