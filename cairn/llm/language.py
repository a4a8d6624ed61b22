"""Missing or wrong language labels.

Evidence is fused in the log domain, for documents and for the segments of mixed ones: the likelihood of the words under
each language, tempered since the cues of a text are not independent; how often documents of a language in a source carry
the label at hand (its reliability); and the prior of the host, the shares of languages of its title within its source,
smoothed towards the source and that towards the corpus, without the document's own count. Reliability and priors are
grouped counts over all documents whose words alone leave no doubt. How far the words are tempered is found by the
likelihood of the labels over all documents.

Cues are decoded as a sequence in which a change of language has a price, so one odd cue is not a segment. The word model
is fitted on a bounded sample of labelled documents (SAMPLE) and refined on its own decisions, since the labels are what
is wrong.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.cues import cue_words
from cairn.session import cut

#: Codes of two and three letters, English and own names of the ten languages.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
}
LANGS = list(NAMES)
K = len(LANGS)
#: Documents the word model is fitted on, to a few per cent, however many there are.
SAMPLE = 3000
#: Rounds of refitting on own decisions.
ROUNDS = 2
#: Words the model keeps at most, the most frequent ones.
VOCABULARY = 40_000
#: Log odds that a cue's best language must have over the second to count as language; price of a change of language.
EVIDENCE, CHANGE = 1.5, 4.0
#: Cues in a row that make a segment.
LEAST_RUN = 4
#: Log odds that one word can add: a word of the vocabulary, another one by its letters.
WORD_LIMIT, LETTER_LIMIT = 5.0, 2.5
#: A cue of one different word counts only if the model has met the word so often and is so sure of it: else it may be a name.
SINGLE_COUNT, SINGLE_EVIDENCE = 20, 4.0
#: Different words from which a cue of the training sample is counted for its own language and not for its document's.
OWN_WORDS = 3
#: Hash buckets of letter groups, for words that are not in the vocabulary.
GRAMS = 1 << 15
#: Pseudo-documents that pull a source's shares towards the corpus, and a title's towards its source.
SMOOTHING, TITLE_SMOOTHING = 50.0, 10.0
#: Log odds from which the words of a document leave no doubt.
SURE = 10.0
#: Settings of tempering: log likelihoods are divided by T n^A for n cues.
TEMPERS, POWERS = (1.0, 1.5, 2.0, 3.0, 4.0, 8.0), (0.0, 0.25, 0.5)
#: Words a task remembers beyond the vocabulary.
REMEMBERED = 200_000


def label_language(label: Column) -> Column:
    """The language a label names: a code with or without a region, or a name, in any case; null otherwise."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    code = F.regexp_extract(plain, r"\A([a-z]{2,3})([-_][a-z0-9]{2,8})*\z", 1)
    known = F.create_map(*(F.lit(x) for lang, names in NAMES.items() for name in names.split() for x in (name, lang)))
    return F.coalesce(F.element_at(known, plain), F.element_at(known, F.when(code != "", code)))


def grams(word: str) -> list[int]:
    """Hash buckets of the groups of three letters of a word with its ends; the same in every process."""
    padded = f"^{word}$"
    return [((ord(a) * 31 + ord(b)) * 8191 + ord(c)) * 2654435761 % 4294967296 >> 17 for a, b, c in zip(padded, padded[1:], padded[2:])]


@dataclass
class WordModel:
    """Log likelihoods of words (centred per word) and of letter groups under each language."""

    words: list[str]
    table: np.ndarray  # (words, K)
    groups: np.ndarray  # (GRAMS, K)
    singles: frozenset[str]  # words that alone make a cue of a language


class Scorer:
    """Turns cues into log likelihoods, remembering the words it meets."""

    def __init__(self, model: WordModel) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids = {w: i + 1 for i, w in enumerate(self.model.words)}
        self.rows = [np.zeros((1, K), np.float32), self.model.table]
        self.size = 1 + len(self.model.words)

    def learn(self, new: list[str]) -> None:
        if self.size > len(self.model.words) + REMEMBERED:
            raise OverflowError
        block = np.zeros((len(new), K), np.float32)
        for i, word in enumerate(new):
            block[i] = self.model.groups[grams(word)].sum(axis=0)
            self.ids[word] = self.size + i
        block -= block.max(axis=1, keepdims=True)
        self.rows.append(np.maximum(0.6 * block, -LETTER_LIMIT))
        self.size += len(new)

    def score(self, cues: list[list[str]]) -> np.ndarray:
        """(cues, K) log likelihoods."""
        flat = [w for cue in cues for w in cue]
        new = set(flat).difference(self.ids)
        if new:
            try:
                self.learn(sorted(new))
            except OverflowError:
                self.reset()
                self.learn(sorted(set(flat).difference(self.ids)))
        if len(self.rows) > 2:
            self.rows = [np.concatenate(self.rows)]
        table = self.rows[0] if len(self.rows) == 1 else np.concatenate(self.rows)
        self.rows = [table]
        each = table[np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))]
        sums = np.concatenate([np.zeros((1, K)), np.cumsum(each, axis=0, dtype=np.float64)])
        ends = np.cumsum([len(c) for c in cues], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return sums[ends] - sums[starts] if len(cues) else np.zeros((0, K))

    def spoken(self, cues: list[list[str]], scores: np.ndarray) -> np.ndarray:
        """Indexes of the cues that have a language."""
        if not len(scores):
            return np.zeros(0, np.int64)
        two = np.partition(scores, K - 2, axis=1)[:, K - 2 :]
        sure = np.flatnonzero(two[:, 1] - two[:, 0] >= EVIDENCE).tolist()
        return np.array([k for k in sure if len(set(cues[k])) > 1 or cues[k][0] in self.model.singles], np.int64)


def fit_counts(counts: dict[str, np.ndarray]) -> WordModel:
    """A model from the counts of words by language. A language without any words is never chosen."""
    words = sorted(counts, key=lambda w: (-counts[w].sum(), w))[:VOCABULARY]
    table = np.array([counts[w] for w in words]).reshape(-1, K)
    logs = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * len(words) + 1))
    logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -WORD_LIMIT)
    groups = np.zeros((GRAMS, K))
    for word, n in zip(words, table):
        np.add.at(groups, grams(word), np.sqrt(n))
    groups = np.log((groups + 0.05) / (groups.sum(axis=0) + 0.05 * GRAMS))
    order = np.sort(logs, axis=1)
    often = (table.sum(axis=1) >= SINGLE_COUNT) & (order[:, -1] - order[:, -2] >= SINGLE_EVIDENCE) if len(words) else []
    singles = frozenset(w for w, yes in zip(words, often) if yes)
    unknown = table.sum(axis=0) == 0
    if not unknown.all():
        logs[:, unknown], groups[:, unknown] = -WORD_LIMIT, groups.min() - WORD_LIMIT
        logs -= logs.max(axis=1, keepdims=True)
    return WordModel(words, np.maximum(logs, -WORD_LIMIT).astype(np.float32), groups.astype(np.float32), singles)


def decode(scores: np.ndarray) -> np.ndarray:
    """Best language of each cue of many documents at once. scores: (documents, cues, K)."""
    n, steps, _ = scores.shape
    back = np.zeros((steps, n, K), np.int8)
    best = scores[:, 0]
    own = np.arange(K)[None, :]
    for t in range(1, steps):
        top = best.argmax(axis=1)
        change = np.take_along_axis(best, top[:, None], 1) - CHANGE
        stay = best >= change
        back[t] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, change) + scores[:, t]
    path = np.zeros((n, steps), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t, np.arange(n), path[:, t]]
    return path


def segments(langs: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """Main language and kept runs (language, first, last index) of the cues that have a language (one or more).

    Main is that of most cues, on ties the one that comes first. The shortest run of fewer than LEAST_RUN cues is left
    out, and its neighbours become one if they are of one language, until every run is long enough or one is left."""
    counts = np.bincount(langs, minlength=K)
    tied = np.flatnonzero(counts == counts.max())
    main = int(langs[np.isin(langs, tied)][0])
    edges = np.flatnonzero(langs[1:] != langs[:-1]) + 1
    runs = [[int(langs[a]), int(a), int(b) - 1, int(b - a)] for a, b in zip([0, *edges], [*edges, len(langs)])]
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda i: runs[i][3])
        if runs[k][3] >= LEAST_RUN:
            break
        del runs[k]
        if 0 < k < len(runs) and runs[k - 1][0] == runs[k][0]:
            _, _, last, n = runs.pop(k)
            runs[k - 1][2:] = [last, runs[k - 1][3] + n]
    return main, [(lang, first, last) for lang, first, last, _ in runs]


def judge(scorer: Scorer, texts: list[str | None]) -> list[list[tuple[int, int, np.ndarray, int, int, np.ndarray]]]:
    """For each text: (seg_no, language, log odds of all languages, first cue, cues, log odds of one cue), seg_no 0 for the document, then its
    segments if there is more than one. Nothing for a text without a cue that has a language."""
    cues = [cue_words(x) if x else [] for x in texts]
    scores = [scorer.score(c) for c in cues]
    spoken = [scorer.spoken(c, s) for c, s in zip(cues, scores)]
    out: list[list[tuple[int, int, np.ndarray, int, int, np.ndarray]]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(spoken[i])), key=lambda i: len(spoken[i]))
    for at in range(0, len(order), 256):
        group = order[at : at + 256]
        padded = np.zeros((len(group), len(spoken[group[-1]]), K))
        for j, i in enumerate(group):
            padded[j, : len(spoken[i])] = scores[i][spoken[i]]
        paths = decode(padded)
        for j, i in enumerate(group):
            n = len(spoken[i])
            own, path = padded[j, :n], paths[j, :n]
            main, kept = segments(path)
            out[i] = [(0, main, own[path == main].sum(axis=0), int(spoken[i][0]), n, own[0])]
            if len(kept) > 1:
                for k, (lang, a, b) in enumerate(kept):
                    inside = own[a : b + 1][path[a : b + 1] == lang]
                    out[i].append((k + 1, lang, inside.sum(axis=0), int(spoken[i][a]), len(inside), inside[0]))
    return out


def fit(sample: list[tuple[str, str]]) -> WordModel:
    """A model from (text, language of the label). The labels start it; then its own decisions take their place: on cues of
    several words for these, on documents for the others, so that names and cries stay as even as they are spread."""
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(K))
    parsed = [(cue_words(text), LANGS.index(lang)) for text, lang in sample]
    for cues, lang in parsed:
        for cue in cues:
            for w in cue:
                counts[w][lang] += 1
    model = fit_counts(counts)
    for _ in range(ROUNDS):
        scorer, counts = Scorer(model), defaultdict(lambda: np.zeros(K))
        for cues, label in parsed:
            scores = scorer.score(cues)
            spoken = scorer.spoken(cues, scores)
            best = scores.argmax(axis=1) if len(scores) else []
            main = int(np.bincount(best[spoken]).argmax()) if len(spoken) else label
            sure = set(spoken.tolist())
            for k, cue in enumerate(cues):
                own = int(best[k]) if k in sure and len(set(cue)) >= OWN_WORDS else main
                for w in cue:
                    counts[w][own] += 1
        model = fit_counts(counts)
    return model


def train(documents: DataFrame, sample: int = SAMPLE) -> WordModel:
    """Fit on about `sample` documents whose label names a language: those whose id hashes below the share that the
    sample is of all. Its size does not grow with the data; the count reads no texts."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label is not null")
    share = min(1.0, sample / max(1, labelled.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    return fit([(r.text, r.label) for r in labelled.where(drawn & F.col("text").isNotNull()).select("text", "label").collect()])


SEGMENT = "struct<lang:int,first_cue:int,n_cues:int,odds:array<double>>"
HEARD = f"doc_id long, source string, title long, label string, segments array<{SEGMENT}>, cue array<double>"


def text_evidence(documents: DataFrame, model: WordModel) -> DataFrame:
    """Each text that has a language, with the log odds of its words: of the document, then of its segments if there are
    several, and of its first cue that has a language. One narrow pass over the texts, which are not moved. The model, bounded by VOCABULARY and GRAMS, goes to the
    tasks as a broadcast."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    one = pa.struct([("lang", pa.int32()), ("first_cue", pa.int32()), ("n_cues", pa.int32()), ("odds", pa.list_(pa.float64()))])
    names = ["doc_id", "source", "title", "label", "segments", "cue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = judge(scorer, batch.column(4).to_pylist())
            at = pa.array([i for i, rows in enumerate(found) if rows], pa.int64())
            parts = [[{"lang": lang, "first_cue": first, "n_cues": n, "odds": odds.tolist()} for _, lang, odds, first, n, _ in rows] for rows in found if rows]
            cues = pa.array([rows[0][5].tolist() for rows in found if rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:4]), pa.array(parts, pa.list_(one)), cues], names=names)

    title = F.col("title_id").cast("long") if "title_id" in documents.columns else F.lit(None).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), title.alias("title"), label_language(F.col("lang")).alias("label"), "text")
    return rows.mapInArrow(run, HEARD)


def sure_language() -> Column:
    """Number of the language of a document whose words leave no doubt, else null."""
    first = F.element_at("segments", 1)
    order = F.array_sort(first["odds"])
    return F.when(F.element_at(order, -1) - F.element_at(order, -2) >= SURE, first["lang"])


def _smoothed(counts: list[Column], size: Column, prior: list[Column] | list[float], weight: float) -> list[Column]:
    return [(n + weight * p) / (size + weight) for n, p in zip(counts, prior)]


@dataclass
class Labels:
    """What labels are worth over the whole corpus: how often those of a language are right, and which ones are taken wrongly."""

    agree: np.ndarray
    other: np.ndarray


def tallies(evidence: DataFrame) -> DataFrame:
    """(source, title, label, heard, n): counts of all documents, heard null where the words leave doubt."""
    return evidence.groupBy("source", "title", "label", sure_language().alias("heard")).agg(F.count("*").alias("n"))


def label_worth(counts: DataFrame) -> Labels:
    """From the tallies; a language without documents is taken as the average."""
    rows = counts.where("heard is not null and label is not null").groupBy("heard", "label").agg(F.sum("n").alias("n")).collect()  # K x K at most
    table = np.zeros((K, K))
    for r in rows:
        table[r.heard, LANGS.index(r.label)] += r.n
    right, all_ = table.diagonal(), table.sum(axis=1)
    mean = (right.sum() + 1) / (all_.sum() + 2)
    wrong = table.sum(axis=0) - right
    return Labels((right + SMOOTHING * mean) / (all_ + SMOOTHING), (wrong + 1) / (wrong.sum() + K))


def hosts(counts: DataFrame, labels: Labels) -> DataFrame:
    """(source, title, prior, agree, held): for each title of a source the smoothed shares of languages of the source, how
    often its labels of each language are right, and the title's own counts. Null is a source, or a title, of its own."""
    def total(condition: Column) -> list[Column]:
        return [F.sum(F.when((F.col("heard") == k) & condition, F.col("n")).otherwise(0)) for k in range(K)]

    yes = F.lit(True)
    corpus = counts.groupBy().agg(*(c.alias(f"c{k}") for k, c in enumerate(total(yes)))).first()
    known = [corpus[k] or 0 for k in range(K)]
    shares = [(n + 1) / (sum(known) + K) for n in known]
    right = F.col("label") == F.element_at(F.array(*(F.lit(x) for x in LANGS)), F.col("heard") + 1)
    own = [*total(yes), *total(F.col("label").isNotNull()), *total(F.coalesce(right, F.lit(False)))]
    sums = counts.groupBy("source").agg(*(c.alias(f"s{k}") for k, c in enumerate(own)))
    n, labelled, good = ([F.col(f"s{k}") for k in range(g * K, (g + 1) * K)] for g in range(3))
    prior = _smoothed(n, sum(n, F.lit(0)), shares, SMOOTHING)
    agree = [(g + SMOOTHING * float(a)) / (m + SMOOTHING) for g, m, a in zip(good, labelled, labels.agree)]
    sources = sums.select(F.col("source").alias("s"), F.array(*prior).alias("prior"), F.array(*agree).alias("agree"))
    titles = counts.groupBy("source", "title").agg(F.array(*total(yes)).alias("held"))
    return titles.join(sources, titles["source"].eqNullSafe(sources["s"])).drop("s")


def tempered(odds: np.ndarray, n: int, temper: tuple[float, float]) -> np.ndarray:
    return (odds - odds.max()) / (temper[0] * n ** temper[1])


def shares_of(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def label_likelihood(agree: np.ndarray, labels: Labels, label: int) -> np.ndarray:
    """Probability of a label under each language."""
    out = (1 - agree) * labels.other[label] / np.maximum(1e-12, 1 - labels.other)
    out[label] = agree[label]
    return out


def fit_temper(evidence: DataFrame, labels: Labels) -> tuple[float, float]:
    """(T, A) of highest likelihood of the labels over all labelled documents: T by one cue of each, where words leave
    doubt, and A, for that T, by whole documents; the least of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(TEMPERS), 1 + len(POWERS)))
        for batch in batches:
            for label, first, cue in zip(*(c.to_pylist() for c in batch.columns)):
                given = label_likelihood(labels.agree, labels, LANGS.index(label))
                odds, cue = np.array(first["odds"]), np.array(cue)
                for k, t in enumerate(TEMPERS):
                    sums[k, 0] += np.log((shares_of(tempered(cue, 1, (t, 0.0))) * given).sum())
                    sums[k, 1:] += [np.log((shares_of(tempered(odds, first["n_cues"], (t, a))) * given).sum()) for a in POWERS]
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.reshape(-1))], names=["k", "sum"])

    rows = evidence.where("label is not null").select("label", F.element_at("segments", 1).alias("first"), "cue").mapInArrow(run, "k int, sum double")
    found = {r.k: r.sum for r in rows.groupBy("k").agg(F.sum("sum").alias("sum")).collect()}
    if not found:
        return 1.0, 0.0
    sums = np.array([found[k] for k in range(len(found))]).reshape(len(TEMPERS), -1).round(6)
    t = int(sums[:, 0].argmax())
    return TEMPERS[t], POWERS[int(sums[t, 1:].argmax())]


JUDGED = "doc_id long, seg_no int, lang string, confidence double, label string, first_cue int, n_cues int"


def fuse(joined: DataFrame, labels: Labels, temper: tuple[float, float], use_label: bool = True, use_host: bool = True) -> DataFrame:
    """Decide documents and segments of evidence joined with hosts. Neighbouring segments that become one language are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, label, parts, sure, prior, agree, held in zip(*(c.to_pylist() for c in batch.columns)):
                base = np.zeros(K)
                if use_host:
                    own = np.array(held, float)
                    if sure is not None:
                        own[sure] -= 1
                    base = np.log((own + TITLE_SMOOTHING * np.array(prior)) / (own.sum() + TITLE_SMOOTHING))
                decided = []
                for k, part in enumerate(parts):
                    scores = base + tempered(np.array(part["odds"]), part["n_cues"], temper)
                    if k == 0 and label is not None and use_label:
                        scores = scores + np.log(label_likelihood(np.array(agree), labels, LANGS.index(label)))
                    share = shares_of(scores)
                    best = int(share.argmax())
                    decided.append([best, float(share[best]), part["first_cue"], part["n_cues"]])
                out.append((doc, 0, LANGS[decided[0][0]], decided[0][1], label, *decided[0][2:]))
                kept: list[list] = []
                for row in decided[1:]:
                    if kept and kept[-1][0] == row[0]:
                        kept[-1][1], kept[-1][3] = max(kept[-1][1], row[1]), kept[-1][3] + row[3]
                    else:
                        kept.append(row)
                if len(kept) > 1:
                    out += [(doc, i, LANGS[row[0]], row[1], label, *row[2:]) for i, row in enumerate(kept, 1)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in JUDGED.split(", ")])

    return joined.select("doc_id", "label", "segments", sure_language().alias("sure"), "prior", "agree", "held").mapInArrow(run, JUDGED)


def document_languages(documents: DataFrame, model: WordModel | None = None, **options: bool) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, label, first_cue, n_cues): row 0 of each document with a language, and its
    segments if it has more than one. label is the language its label names, null if none.

    lang is the language of most posterior, confidence its posterior, from the words, the host and, for row 0, the label.
    A null, empty or blank text, and one whose cues hold no language, has no row."""
    evidence = cut(text_evidence(documents, model or train(documents)))
    counts = cut(tallies(evidence))
    labels = label_worth(counts)
    known = hosts(counts, labels).withColumnsRenamed({"source": "h_source", "title": "h_title"})
    joined = evidence.join(known, evidence["source"].eqNullSafe(known["h_source"]) & evidence["title"].eqNullSafe(known["h_title"]))
    return fuse(joined, labels, fit_temper(evidence, labels), **options)


def reliability(judged: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(bin, documents, confidence, agreement): documents in tenths of lost confidence (bin k: 1 - confidence below 10^-k, 6 at
    most), their mean confidence, and the share whose label (or, given truth (doc_id, lang), true language) is lang; documents without either are left out."""
    rows = judged.where("seg_no = 0").select("doc_id", "lang", "confidence", "label")
    rows = rows.where("label is not null") if truth is None else rows.drop("label").join(truth.select("doc_id", F.col("lang").alias("label")), "doc_id")
    step = F.least(F.floor(-F.log10(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))), F.lit(6)).cast("int")
    return rows.groupBy(step.alias("bin")).agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"), F.avg((F.col("lang") == F.col("label")).cast("double")).alias("agreement"))


def wrong_labels(judged: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang) of documents whose label does not name their language, and of all segments of mixed ones."""
    case = (F.col("seg_no") > 0) | ~F.col("label").eqNullSafe(F.col("lang"))
    return judged.where(case).select("doc_id", "seg_no", "lang")
