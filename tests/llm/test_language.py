import numpy as np
import pytest
from helpers import rng
from pyspark.sql import functions as F

from cairn.llm import cues, language

WORDS = {
    "en": "the captain asked about nothing because it was raining outside and we have found that house",
    "de": "der hauptmann fragt nichts weil es geregnet hat und wir haben endlich das haus gefunden",
    "fr": "le capitaine demande rien parce que dehors pleuvait et nous avons enfin trouvé cette maison",
    "es": "el capitán preguntó nada porque estaba lloviendo fuera y hemos hallado aquella casa por fin",
    "ru": "капитан спрашивал ничего потому что шёл дождь и мы наконец нашли этот дом",
}


def sentence(r, lang, n=8):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def subtitle(lines, end="\n", gap="\n"):
    out = []
    for k, x in enumerate(lines):
        out.append(f"{k + 1}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n{x}\n{gap}")
    return "".join(out).replace("\n", end)


def run_of(r, lang, n):
    return [sentence(r, lang) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    r = rng(1)
    labelled = []
    for k in range(300):
        lang = r.choice(list(WORDS))
        label = lang if r.random() < 0.85 else r.choice(list(WORDS))
        labelled.append((subtitle(run_of(r, lang, 12)), label))
    return language.fit(labelled)


def judged(model, text):
    rows = language.judge(language.Scorer(model), [text])[0]
    return [language.LANGS[x[1]] for x in rows[1:]] or [language.LANGS[x[1]] for x in rows[:1]], [language.LANGS[x[1]] for x in rows[:1]]


def test_words():
    text = "﻿1\r\n00:00:01,0 --> 00:00:02,0\r\n<i>- VARGA: Hel­lo there</i>\r\n2\r\n0:00:03.5 --> 0:00:04.0 line:0\r\n[door] (x) *y* Go\r\n\r\n00:05 --> 00:06\nSubtitles by team X\nwww.x.example\n\n4\n00:07 --> 00:08\n"
    assert cues.cue_words(text) == [["hello", "there"], ["go"], [], []]
    assert cues.cue_words("") == [] and cues.cue_words("no cue at all") == []


@pytest.mark.parametrize("how", [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("cp1251", "latin-1")])
def test_repair(how):
    good = "шёл дождь сегодня" if how[0] == "cp1251" or how[1] == "latin-1" else "é à ü preguntó"
    assert cues.repair(good.encode(how[0]).decode(how[1])) == good
    twice = "größer wäre schön".encode().decode("latin-1").encode().decode("latin-1")
    assert cues.repair(twice) == "größer wäre schön" and cues.repair("plain é text") == "plain é text"


def test_held_out_accuracy(model):
    r = rng(2)
    cases = [(lang, subtitle(run_of(r, lang, r.choice([1, 3, 10])), end=r.choice(["\n", "\r\n", "\r"]), gap=r.choice(["\n", ""]))) for lang in WORDS for _ in range(60)]
    right = sum(judged(model, text)[1] == [lang] for lang, text in cases)
    assert right >= 0.98 * len(cases)


def test_segments(model):
    r = rng(3)
    mixed = run_of(r, "en", 10) + run_of(r, "de", 6) + run_of(r, "en", 5)
    assert judged(model, subtitle(mixed)) == (["en", "de", "en"], ["en"])
    noise = run_of(r, "en", 10) + run_of(r, "de", 3) + ["[door]", "♪ ♪", "Jory!"] + run_of(r, "en", 10)
    assert judged(model, subtitle(noise)) == (["en"], ["en"])
    split = run_of(r, "en", 12) + run_of(r, "ru", 3) + run_of(r, "en", 1) + run_of(r, "ru", 5)
    assert judged(model, subtitle(split)) == (["en", "ru"], ["en"])


def test_runs():
    def kept(text):
        langs = np.array([{"a": 0, "b": 1, "c": 2}[x] for x in text])
        main, runs = language.segments(langs)
        return "abc"[main], "".join("abc"[x[0]] for x in runs)

    assert kept("a" * 9) == ("a", "a") and kept("aaaaabbbb") == ("a", "ab") and kept("aaaaabbb") == ("a", "a")
    assert kept("bbbbcbbbbaaaaaaaaaa") == ("a", "ba") and kept("bbbcbbbaaaaaaaaaa") == ("a", "ba") and kept("ab") == ("a", "b") and kept("b") == ("b", "b")


def test_no_language(model):
    for text in (None, "", "  \n ", subtitle(["[door creaks]", "♪♪♪", "(x)", "www.a.example"]), "no cue"):
        assert language.judge(language.Scorer(model), [text])[0] == []


def test_labels(spark):
    names = {"en": "en EN eng en_GB en-US English ENGLISH", "de": "ger deu Deutsch de-AT", "es": "es_419 español Spanish", "pt": "pt-BR português", "ru": "русский rus", None: "xx und da ca unknown n/a - ?"}
    rows = [(f" {x} ", lang) for lang, text in names.items() for x in text.split()] + [("", None), (None, None), ("en gb us", None)]
    df = spark.createDataFrame(rows, "x string, want string")
    assert df.where(~language.label_language(F.col("x")).eqNullSafe(F.col("want"))).collect() == []


def documents(spark, rows):
    return spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(rows)], "doc_id bigint, text string, lang string, source string, label string")


def test_documents(spark, model):
    r = rng(4)
    rows = [(subtitle(run_of(r, "en", 8)), "en", "s"), (subtitle(run_of(r, "en", 8)), "de", "s"), (subtitle(run_of(r, "fr", 8)), None, None), (None, "en", "s"), ("", None, None), (subtitle(run_of(r, "de", 9) + run_of(r, "ru", 7)), "German", "t"), (subtitle(run_of(r, "es", 3000)), "es", "t")]
    got = language.document_languages(documents(spark, rows), model)
    assert sorted(tuple(x) for x in language.wrong_labels(got).collect()) == [(1, 0, "en"), (2, 0, "fr"), (5, 1, "de"), (5, 2, "ru")]
    assert all(0.9 < x.confidence <= 1 for x in got.collect()) and got.where("doc_id = 6").first().n_cues >= 2900


def test_label_and_source_decide_where_words_hardly_do(spark, model):
    scorer = language.Scorer(model)
    words = [w for w in model.words if np.sort(scorer.score([[w]])[0])[-1] - np.sort(scorer.score([[w]])[0])[-2] < 1.2]
    if words:
        df = documents(spark, [(subtitle([words[0]]), "en", "s")] * 3)
        assert language.wrong_labels(language.document_languages(df, model)).collect() == []


def evidence(spark, rows):
    """rows: (source, title, label, language, log odds of that language)."""
    def odds(lang, x):
        return [x if k == lang else 0.0 for k in range(language.K)]

    made = [(i, s, t, label, [(lang, 0, 4, odds(lang, x))], odds(lang, x / 4)) for i, (s, t, label, lang, x) in enumerate(rows)]
    return spark.createDataFrame(made, language.HEARD)


def test_host_shares_are_smoothed_by_title_source_and_corpus(spark):
    rows = [("s", 1, "en", 0, 50.0)] * 90 + [("s", 2, "de", 1, 50.0)] * 10 + [("t", 3, "de", 1, 50.0)] * 40 + [(None, None, "bad", 2, 1.0)]
    counts = language.tallies(evidence(spark, [(s, t, label if label in language.LANGS else None, *r) for s, t, label, *r in rows]))
    got = {(x.source, x.title): x for x in language.hosts(counts, language.label_worth(counts)).collect()}
    assert set(got) == {("s", 1), ("s", 2), ("t", 3), (None, None)} and all(abs(sum(x.prior) - 1) < 1e-9 for x in got.values())
    assert got["s", 1].prior[0] > got[None, None].prior[0] > got["t", 3].prior[0] and got["s", 2].held[1] == 10
    assert sum(got[None, None].held) == 0  # its words leave doubt


def test_labels_are_worth_what_they_prove_to_be(spark):
    """A label of a language that is often wrong counts little, also where its source is better than others."""
    rows = [("good", 1, "en", 0, 50.0)] * 300 + [("bad", 1, "en" if k % 2 else "de", 0, 50.0) for k in range(300)]
    counts = language.tallies(evidence(spark, rows))
    labels = language.label_worth(counts)
    agree = {x.source: x.agree[0] for x in language.hosts(counts, labels).collect()}
    assert agree["good"] > 0.93 and 0.45 < agree["bad"] < 0.6 and labels.other[1] > 0.9
    given = language.label_likelihood(np.array([agree["bad"]] * language.K), labels, 0)
    assert given[0] > given[1] and abs(sum(language.label_likelihood(np.full(language.K, 0.8), labels, x)[2] for x in range(language.K)) - 1) < 1e-9


def test_weak_words_are_decided_by_label_and_host(spark):
    sound = [("s", 1, "de", 1, 50.0)] * 60 + [("t", 2, "en", 0, 50.0)] * 60
    ev = evidence(spark, sound + [("s", 1, "de", 0, 0.5), ("s", 1, None, 0, 0.5), ("s", 1, "de", 0, 60.0)])
    counts = language.tallies(ev)
    labels = language.label_worth(counts)
    known = language.hosts(counts, labels).withColumnsRenamed({"source": "hs", "title": "ht"})
    joined = ev.join(known, ev["source"].eqNullSafe(known["hs"]) & ev["title"].eqNullSafe(known["ht"]))

    def langs(**options):
        return [x.lang for x in language.fuse(joined, labels, (1.0, 0.0), **options).where("doc_id >= 120").orderBy("doc_id").collect()]

    assert langs() == ["de", "de", "en"]
    assert langs(use_label=False) == ["de", "de", "en"] and langs(use_host=False) == ["de", "en", "en"] and langs(use_label=False, use_host=False) == ["en"] * 3


def test_segments_that_become_one_language_are_one(spark):
    part = lambda lang, first, x: (lang, first, 4, [x if k == lang else 0.0 for k in range(language.K)])
    rows = [(1, "s", 1, "de", [part(1, 0, 90.0), part(1, 0, 40.0), part(0, 4, 0.1), part(1, 8, 40.0), part(2, 12, 40.0)], [0.0] * language.K)]
    rows += [(k, "s", 1, "de", [part(1, 0, 50.0)], [0.0] * language.K) for k in range(2, 200)]
    ev = spark.createDataFrame(rows, language.HEARD)
    counts = language.tallies(ev)
    known = language.hosts(counts, language.label_worth(counts)).drop("source", "title")
    got = language.fuse(ev.withColumn("one", F.lit(1)).join(known.withColumn("one", F.lit(1)), "one"), language.label_worth(counts), (1.0, 0.0)).where("doc_id = 1").collect()
    assert [(x.seg_no, x.lang, x.n_cues) for x in got] == [(0, "de", 4), (1, "de", 12), (2, "fr", 4)]


def test_tempering_follows_the_labels(spark):
    """Cues that seem sure and are wrong as often as right call for more tempering than cues that are right."""
    def fitted(rows):
        ev = evidence(spark, rows)
        return language.fit_temper(ev, language.Labels(np.full(language.K, 0.95), np.full(language.K, 0.1)))

    assert fitted([("s", 1, "en", 0, 80.0)] * 100)[0] < fitted([("s", 1, "en" if k % 3 else "de", 0, 80.0) for k in range(100)])[0]


def test_reliability(spark):
    rows = [(k, 0, "en", 0.95 if k < 10 else 1.0, "en" if k else "de", 0, 1) for k in range(20)] + [(99, 0, "en", 0.5, None, 0, 1)]
    judged = spark.createDataFrame(rows, language.JUDGED)
    assert {x.bin: (x.documents, x.agreement) for x in language.reliability(judged).collect()} == {1: (10, 0.9), 6: (10, 1.0)}
    truth = spark.createDataFrame([(99, "en"), (1, "de")], "doc_id long, lang string")
    assert {x.bin: x.agreement for x in language.reliability(judged, truth).collect()} == {0: 1.0, 1: 0.0}


def test_empty_table(spark):
    empty = documents(spark, []).limit(0)
    assert language.document_languages(empty).collect() == []
    assert language.document_languages(documents(spark, [(None, None, None)])).collect() == []


def test_training_sample_is_bounded(spark):
    df = documents(spark, [(subtitle(["the captain"]), "en", "s")] * 400)
    assert len(language.train(df, sample=50).words) == 2
