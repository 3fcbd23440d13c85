"""Languages of documents and of their lines: string kernel, Nyström landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("cs", "sk", "pl", "de", "en")
# Notations of the languages, apart from case and a region after the code.
NOTATIONS = {
    "cs": ("cs", "ces", "cze", "czech", "čeština", "cestina", "česky"), "sk": ("sk", "slk", "slo", "slovak", "slovenčina", "slovencina", "slovensky"),
    "pl": ("pl", "pol", "polish", "polski"), "de": ("de", "deu", "ger", "german", "deutsch"), "en": ("en", "eng", "english"),
}

# Beyond 200 characters a tag is told from a stray "<" by a comment's start or an attribute's value near its name.
_TAG = re.compile(r"</?[a-zA-Z!][^<>\x00]{0,200}>|<!--[^<>\x00]*>|<[a-zA-Z][\w:-]*(?=\s)(?=[^<>=\x00]{0,100}=\s?[\"'\w/#.])[^<>\x00]*>")
_SENTENCE = re.compile(r"(?<!\(ex\.)(?<=[.!?…])[\s\xa0]+(?=[„\"(]?[^\W\d_a-z])")
_NOT_LETTER = re.compile(r"(?:[^\w\n]|[\d_])+")
_CODE = re.compile(r"\b[A-Z]{2,4}\b")
#: Characters that are scored at once.
PIECE = 300_000
#: Share of the sampled documents from which on a word is common.
COMMON = 0.002


@dataclass(frozen=True)
class Settings:
    """``docs`` labelled documents a language at most are sampled to fit; the rest is the model's shape."""

    docs: int = 1000
    sentences: int = 500
    landmarks: int = 500
    grams: tuple[int, ...] = (2, 3, 4)
    width: int = 1 << 18
    ridge: float = 0.005
    #: At the lead that a sentence needs to be told from its document, so many held-out ones at most may be wrong.
    strays: float = 0.005


def label_language(label: Column) -> Column:
    """Language code that a label names in any notation, else null."""
    key = F.regexp_replace(F.lower(F.trim(label)), r"^([a-z]{2,3})[-_][a-z]{2,4}$", "$1")
    names = F.create_map(*[x for code, ways in NOTATIONS.items() for way in ways for x in (F.lit(way), F.lit(code))])
    return F.try_element_at(names, key)


def cleaned(texts: list[str]) -> list[str]:
    """Texts in NFC without markup and entities; one pass over the whole batch."""
    big = "\x00".join(t.replace("\x00", " ") for t in texts)
    if "&" in big:
        big = html.unescape(big.replace("&#0;", " "))
    if "<" in big:
        big = _TAG.sub(" ", big)
    return unicodedata.normalize("NFC", big).split("\x00") if texts else []


def _split(line: str) -> list[str]:
    """A clean line's sentences; ends of sentences are marks followed by a capital letter."""
    return [s for s in _SENTENCE.split(line) if s.strip()]


def sentences(line: str) -> list[str]:
    """A raw line's sentences."""
    return _split(cleaned([line])[0])


def letters(parts: list[str]) -> list[str]:
    """Lower-case words of each sentence between single blanks; figures and codes of capitals (airports, currencies) go.

    A sentence all in capitals keeps them, unless it has no word of more than four letters: then it is codes only.
    """
    some = [s.replace("\n", " ") if not s.isupper() else "" if max(map(len, _NOT_LETTER.sub(" ", s).split()), default=0) <= 4 else s.casefold() for s in parts]
    flat = _NOT_LETTER.sub(" ", _CODE.sub(" ", "\n".join(some)).casefold()).split("\n")
    return [f" {w.strip()} " for w in flat]


def without_accents(text: str) -> str:
    """Letters without their marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ł", "l")


def presence(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blended spectrum: ``(gram slots, start of each text, size of each text)``, each gram of a text once."""
    starts = np.cumsum([0, *[len(t) for t in texts]])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    keys = []
    for n in s.grams:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + len(h)]) * np.uint64(0x100000001B3)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(s.width).bit_length() + 1)
        inside = owner[: len(h)] == owner[n - 1 :]
        keys.append((owner[: len(h)] * s.width + h.astype(np.int64))[inside])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    of = key // s.width
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return key % s.width, bounds[:-1], np.diff(bounds)


def _sums(weights: np.ndarray, texts: list[str], s: Settings) -> np.ndarray:
    """Presence matrix of the texts, each row of length one, times ``weights``; about ``PIECE`` characters at once."""
    out = np.zeros((len(texts), weights.shape[1]), np.float32)
    k = 0
    while k < len(texts):
        end, held = k, 0
        while end < len(texts) and (end == k or held + len(texts[end]) < PIECE):
            held += len(texts[end])
            end += 1
        if held > PIECE:  # one long text: the grams of its pieces, which share enough letters to miss none
            pieces = [texts[k][a : a + PIECE + max(s.grams)] for a in range(0, len(texts[k]), PIECE)]
            slots = np.unique(np.concatenate([presence([p], s)[0] for p in pieces]))
            out[k] = weights[slots].sum(0) / np.sqrt(len(slots))
        else:
            slots, first, size = presence(texts[k:end], s)
            some = np.flatnonzero(size)
            if len(some):
                out[k + some] = np.add.reduceat(weights[slots], first[some], axis=0) / np.sqrt(size[some])[:, None]
        k = end
    return out


def _kernel(texts: list[str], slots: np.ndarray, size: np.ndarray, s: Settings) -> np.ndarray:
    """Kernel of texts and landmarks (their grams one after the other), by way of the landmarks of each gram."""
    marks = len(size)
    order = np.argsort(slots, kind="stable")
    owner = np.repeat(np.arange(marks), size)[order]
    first = np.searchsorted(slots[order], np.arange(s.width + 1))
    out = np.zeros((len(texts), marks))
    for k in range(0, len(texts), 256):
        grams, _, here = presence(texts[k : k + 256], s)
        count = first[grams + 1] - first[grams]
        total = np.cumsum(count)
        at = np.repeat(first[grams] - (total - count), count) + np.arange(count.sum())
        row = np.repeat(np.repeat(np.arange(len(here)), here), count)
        common = np.bincount(row * marks + owner[at], minlength=len(here) * marks).reshape(len(here), marks)
        out[k : k + len(here)] = common / np.sqrt(np.maximum(here, 1)[:, None] * np.maximum(size, 1)[None, :])
    return out


def _frequent(which: np.ndarray, often: np.ndarray, limit: int) -> np.ndarray:
    """At most ``limit`` of ``which``: those that occur five times and more first, then the others as they come."""
    return which[np.argsort(-(often[which] >= 5).astype(int), kind="stable")][:limit]


@dataclass(frozen=True)
class Model:
    """``weights`` (width, languages): the scores of a text are its presence row times them. ``lead``: by how much
    another language must beat the document's for a sentence to be told from it."""

    weights: np.ndarray
    lead: float


def _ridge(x: list[str], at: np.ndarray, often: np.ndarray, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """One-versus-rest kernel ridge over Nyström landmarks, folded into a weight per gram; languages weigh the same."""
    chosen = _frequent(rng.permutation(len(x)), often, s.landmarks)
    slots, _, size = presence([x[i] for i in chosen], s)
    kernel = _kernel(x, slots, size, s)
    signs = np.where(at[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
    share = np.sqrt(1 / np.maximum(np.bincount(at, minlength=len(LANGUAGES)), 1))[at][:, None]
    landmarks = kernel[chosen]
    kernel *= share
    a = np.linalg.solve(kernel.T @ kernel + s.ridge / len(chosen) * (landmarks + landmarks.T) / 2 + 1e-8 * np.eye(len(chosen)), kernel.T @ (signs * share))
    weights = np.zeros((s.width, len(LANGUAGES)), np.float32)
    of = np.repeat(np.arange(len(chosen)), size)
    np.add.at(weights, slots, (a[of] / np.sqrt(size[of])[:, None]).astype(np.float32))
    return weights


def _lead(least: np.ndarray, differ: np.ndarray, strays: float) -> float:
    """Smallest lead such that of the pairs with that lead or more at most ``2 strays`` differ; the largest if none."""
    order = np.argsort(-least, kind="stable")
    share = np.cumsum(differ[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share <= 2 * strays)
    return float(least[order[good[-1]]]) if len(good) else float(least.max(initial=0.0))


def fit(texts: list[str], labels: list[str], s: Settings = Settings()) -> Model:
    """The model of labelled texts; of no text, one that scores 0.

    The kernel of two texts is the number of common grams over the root of the product of their numbers. Labels may be
    wrong: a phrase counts once, under the label that most of its documents have, and phrases are split into two
    halves. Each half is scored by a fit on the other; the last fit is on those phrases that their held-out score
    agrees with, with and without accents. The lead comes from held-out scores, without labels: a phrase is in one
    language, so that its two ends may disagree at that lead or more only if one of them is wrong (see ``strays``).
    """
    rng = np.random.default_rng(7)
    phrases = []
    for text in cleaned([t or "" for t in texts]):
        parts = [p for line in text.split("\n") for p in _split(line)]
        phrases.append(sorted({w for w in letters(parts) if w.strip()} if parts else ()))
    # A phrase is known by its words that are common in the sample, so that names in it don't make it another one.
    seen = Counter(w for own in phrases for w in {w for p in own for w in p.split()})
    least = max(3, len(texts) * COMMON)
    known: dict[str, tuple[str, np.ndarray]] = {}
    for label, own in zip(labels, phrases, strict=True):
        for p in own:  # a document votes once for a phrase
            key = " ".join(w for w in p.split() if seen[w] >= least)
            known.setdefault(key if key.count(" ") >= 2 else p, (p, np.zeros(len(LANGUAGES), int)))[1][LANGUAGES.index(label)] += 1
    lines = [p for p, _ in known.values()]
    at = np.array([int(v.argmax()) for _, v in known.values()], int)
    often = np.array([int(v.max()) for _, v in known.values()], int)
    voted = np.array([v.max() >= 5 and 2 * v.max() >= 1.2 * v.sum() for _, v in known.values()], bool)
    if not lines:
        return Model(np.zeros((s.width, len(LANGUAGES)), np.float32), 0.0)

    def train(among: np.ndarray) -> np.ndarray:
        some = np.concatenate([_frequent(rng.permutation(among[at[among] == k]), often, s.sentences) for k in range(len(LANGUAGES))]).astype(int)
        if not len(some):
            return np.zeros((s.width, len(LANGUAGES)), np.float32)
        x = [lines[i] for i in some] + [without_accents(lines[i]) for i in some]
        return _ridge(x, np.tile(at[some], 2), np.tile(often[some], 2), s, rng)

    half = rng.permutation(len(lines)) % 2
    best = np.zeros(len(lines), int)
    parts = [w.split() for w in lines]
    ends = [[f" {' '.join(p[: len(p) // 2])} " for p in parts], [f" {' '.join(p[len(p) // 2 :])} " for p in parts]]
    leads, tongues = np.zeros((2, len(lines))), np.zeros((2, len(lines)), int)
    for k in range(2):
        mine = np.flatnonzero(half == k)
        if len(mine):
            weights = train(np.flatnonzero(half != k))
            best[mine] = _sums(weights, [lines[i] for i in mine], s).argmax(1)
            for e in range(2):
                scores = _sums(weights, [ends[e][i] for i in mine], s)
                ranked = np.sort(scores, axis=1)
                leads[e, mine], tongues[e, mine] = ranked[:, -1] - ranked[:, -2], scores.argmax(1)
    agree = (best == at) | voted
    lead = _lead(leads.min(0)[[len(p) >= 4 for p in parts]], (tongues[0] != tongues[1])[[len(p) >= 4 for p in parts]], s.strays)
    return Model(train(np.flatnonzero(agree) if agree.any() else np.arange(len(lines))), lead)


def segments(texts: list[str], model: Model, s: Settings) -> Iterator[tuple[int, int, str, float, int]]:
    """``(text, line, language, confidence, letters)`` of whole texts (line 0) and of the lines of mixed ones.

    Lines are counted from 1 among those that aren't empty (nor blank). A sentence has the language that scores best if
    that leads over its document's by ``model.lead``, else the document's; the document's is the one with most
    characters, found by letting all sentences that lead over their second best speak first. Confidence is the lead of
    the language's score over the next, from 0 to 1, averaged over letters; for a line it is that of the language's own
    sentences. A text without sentences in letters gives nothing.
    """
    owner, line_no, parts = [], [], []
    for i, text in enumerate(cleaned([t or "" for t in texts])):
        n = 0
        for line in text.split("\n"):
            if line.strip():
                n += 1
                some = _split(line)
                parts += some
                owner += [i] * len(some)
                line_no += [n] * len(some)
    if not parts:
        return
    words = letters(parts)
    once: dict[str, int] = {}
    which = np.array([once.setdefault(w, len(once)) for w in words])  # set phrases are scored once
    size = np.array([len(w) - w.count(" ") for w in once])[which]
    keep = np.flatnonzero(size)
    if not len(keep):
        return
    scores = _sums(model.weights, list(once), s)[which][keep]
    size, owner, line_no = size[keep], np.array(owner)[keep], np.array(line_no)[keep]
    chars = np.array([len(p) for p in parts])[keep]
    ranked = np.sort(scores, axis=1)
    over = np.clip((ranked[:, -1] - ranked[:, -2]) / 2, 0, 1)
    best = scores.argmax(1)
    sure = ranked[:, -1] - ranked[:, -2] >= model.lead
    new = np.append(True, owner[1:] != owner[:-1])
    doc, cuts = np.cumsum(new) - 1, np.flatnonzero(new)
    # Characters by document and language of the sentences that are sure, or of all where none is.
    said = np.zeros((len(cuts), len(LANGUAGES)))
    np.add.at(said, (doc[sure], best[sure]), chars[sure])
    whole = np.zeros_like(said)
    np.add.at(whole, doc, scores * size[:, None])
    main = np.where(said.any(1), said.argmax(1), whole.argmax(1))
    ahead = ranked[:, -1] - scores[np.arange(len(scores)), main[doc]]
    tongue = np.where(ahead >= max(model.lead, 1e-9), best, main[doc])
    total = np.zeros_like(said)
    np.add.at(total, (doc, tongue), chars)
    main = total.argmax(1)

    def sums(of: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(of, over[rows] * size[rows], n), np.bincount(of, size[rows], n)

    mine = np.flatnonzero(tongue == main[doc])
    lead_of, size_of = sums(doc[mine], mine, len(cuts))
    letters_of = np.bincount(doc, size, len(cuts))
    for k, a in enumerate(cuts):
        yield int(owner[a]), 0, LANGUAGES[main[k]], float(lead_of[k] / size_of[k]), int(letters_of[k])
    mixed = np.flatnonzero(((total > 0).sum(1) > 1)[doc])
    if len(mixed):
        keys, first, of = np.unique(np.stack([doc[mixed], line_no[mixed], tongue[mixed]]), axis=1, return_index=True, return_inverse=True)
        lead_of, size_of = sums(of.ravel(), mixed, len(first))
        for k, a in enumerate(first):
            yield int(owner[mixed[a]]), int(keys[1][k]), LANGUAGES[keys[2][k]], float(lead_of[k] / size_of[k]), int(size_of[k])


def sample(df: DataFrame, doc: str, text: str, label: str, s: Settings) -> list[tuple[str, str]]:
    """``(text, language)`` of at most ``s.docs`` labelled documents of each language, the same ones every time.

    The only rows that reach the driver: at most ``docs`` times the languages. Labels are counted first (no text is
    read); then a bound on a hash of id and label, twice as high as its language needs, leaves some thousand rows
    whatever the table's size, and of those the first by hash are taken.
    """
    named = df.select(F.xxhash64(F.lit(7), doc, label).alias("h"), F.col(text).alias("t"), label_language(F.col(label)).alias("l"))
    counts = {r["l"]: r["n"] for r in named.filter("l is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    # Hashes are uniform over 2^64; those below the bound are about 2 docs + 100 of each language.
    bound = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(-(2**63) + (2**64 - 1) * min(1.0, (2 * s.docs + 100) / n)) if n > 2 * s.docs + 100 else 2**63 - 1))])
    few = named.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("h") <= F.try_element_at(bound, F.col("l"))))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = few.withColumn("r", rank).filter(F.col("r") <= s.docs).select("t", "l", "h").collect()
    return [(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["t"]))]


def label_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "lang", s: Settings = Settings()) -> DataFrame:
    """``(doc, line_no, lang, confidence, n_letters, labelled)``: line 0 is the document, others only of mixed documents.

    ``line_no`` counts the lines that aren't empty, from 1. ``labelled`` is the language that the delivered label names,
    null if none. Languages are told from whole texts by a model fitted on a bounded sample of labelled documents
    (``Settings.docs``). Null texts and texts of figures and codes give no row; repeated ids give their rows each.
    Documents aren't shuffled; the model is of fixed size.
    """
    rows = sample(df, doc, text, label, s)
    model = df.sparkSession.sparkContext.broadcast(fit([t for t, _ in rows], [lang for _, lang in rows], s))
    slim = df.select(doc, text, label_language(F.col(label)).alias("labelled")).filter(F.col(text).isNotNull())
    schema = f"{doc} {df.schema[doc].dataType.simpleString()}, line_no int, lang string, confidence double, n_letters int, labelled string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            ids, texts, labels = batch[doc].tolist(), batch[text].tolist(), batch["labelled"].tolist()
            k = 0
            while k < len(texts):
                end, held = k, 0
                while end < len(texts) and (end == k or held + len(texts[end]) < PIECE):
                    held += len(texts[end])
                    end += 1
                found = list(segments(texts[k:end], m, s))
                yield pd.DataFrame({
                    doc: [ids[k + f[0]] for f in found], "line_no": [f[1] for f in found], "lang": [f[2] for f in found],
                    "confidence": [f[3] for f in found], "n_letters": [f[4] for f in found], "labelled": [labels[k + f[0]] for f in found],
                })
                k = end

    return slim.mapInPandas(run, schema)
