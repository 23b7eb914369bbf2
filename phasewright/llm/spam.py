"""Keyword-stuffed and link-list pages: robust outliers in spam-directed directions.

Nothing in here knows a sales word, an address or a tag.  Function words are
learnt per language from the pages, keywords are what a page itself repeats,
and what spam looks like is learnt from the outliers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewright.plans.tables import keep

#: A word on such a share of a language's different pages is a function word of it.
COMMON = 0.6
#: Share of all labelled pages, and number of different pages, that a language needs for words and figures of its own.
LEAST_SHARE, LEAST_PAGES = 0.005, 50
#: Rows of one text above this share of all rows count as one page when words are learnt; at most 1/share texts are so many.
COPIES = 0.001
#: Labels that name no language (fixed values of the language codes).
NO_LANGUAGE = ("un", "mu", "mi", "zx")
#: Tokens looked at on either side of a word, times a form comes on a page to be a keyword, and what a number weighs beside a function word.
NEAR, OFTEN, NUMERAL = 4, 3, 1.5
#: Share of a text's words that are function words at least, where sentences stand.
USUAL = 0.4
#: Most token forms whose kind a task keeps at hand, and letters worked on at a time.
CACHE, LETTERS = 200_000, 2_000_000
#: Squared distance of an outlier: the 0.999 quantile of chi-square with four degrees of freedom.
FAR = 18.47
#: Scales by which a page that shows what spam is lies off the centre in density and function words; and the least density of what they show.
SHOWN, SHOWN_DENSITY = 3.0, 0.5
#: Share of the way from ordinary pages to spam beyond which most of a page is spam.
HALF_WAY = 0.5

FEATURES = ("density", "entropy", "repetition", "function_share")
#: Whether spam has more (1) or less (-1) of a feature.
TOWARDS_SPAM = (1.0, -1.0, 1.0, -1.0)
#: Least scale of a feature, so that one that hardly ever varies doesn't flag everything.
LEAST_SCALE = 0.03

_RUN = re.compile(r"[^\W\d_]+")
_EDGES = ".,;:!?\"'()[]*|>"
_HYPHENS = "-'’¬=­"
WORD, NUMBER, MARK, JOINED = range(4)


def kind_of(token: str) -> tuple[int, str]:
    """Kind of a token and the form under which its repeats are counted.

    ``JOINED`` is a token of two or more words with signs other than hyphens
    between them, or a word behind a ``#``: addresses and tags look so.
    """
    t = token.lower()
    bare = t.strip(_EDGES)
    if bare.isalpha() and t[0] != "#":
        return WORD, bare
    runs = _RUN.findall(t)
    letters, digits = sum(map(len, runs)), any(c.isdigit() for c in t)
    if not letters:
        return (NUMBER if digits else MARK), ""
    key = max(runs, key=len)
    if sum(len(r) > 1 for r in runs) > 1 and any(not c.isalnum() and c not in _HYPHENS for c in bare) or (t[0] == "#" and letters > 1):
        return JOINED, key
    return (NUMBER if digits and letters < 3 else WORD), key


class Words:
    """Learnt function words: the languages, and for each word those it is a function word of."""

    def __init__(self, lists: dict[str, set[str]]):
        self.languages = sorted(lists)
        self.of = {}
        for k, language in enumerate(self.languages):
            for word in lists[language]:
                self.of[word] = self.of.get(word, 0) | 1 << k


class Tokens(dict):
    """Number of each token form met so far, with its kind, the number of its counted form, and the languages it is a function word of."""

    def __init__(self, words: Words):
        super().__init__()
        self.words, self.forms = words, {}
        self.kind, self.form, self.function = [], [], []

    def __missing__(self, token: str) -> int:
        kind, key = kind_of(token)
        self[token] = number = len(self.kind)
        self.kind.append(kind)
        self.form.append(self.forms.setdefault(key, len(self.forms)) if key else -1)
        self.function.append(self.words.of.get(key, 0) if kind == WORD else 0)
        return number


def features(texts: list[str | None], tokens: Tokens, labels: list[str] | None = None) -> list[tuple[int, str, float, float, float, float]]:
    """(words, language, density, entropy, repetition, function-word share) of each page.

    The language is the one whose function words the page has most of or, if
    they are under a twentieth of it, its label.  Density is the mean over all
    words of two figures' product.  One tells how loosely a word stands: twice
    the share by which function words (of any language) and numbers among the
    tokens around it fall short of ``USUAL``, between 0 and 1.  The other is the square of twice the share of keywords around it, at most 1;
    keywords are joined tokens, and forms that come ``OFTEN`` times on the page
    and are no function words.  Entropy is that of the word forms against that
    of as many different ones, repetition the share of forms that came before.
    A page without words has zeros and no language.
    """
    pages, names = len(texts), tokens.words.languages
    rows = [(text or "").split() for text in texts]
    ids = np.array([tokens[t] for row in rows for t in row], np.int64)
    n = np.array([len(row) for row in rows], np.int64)
    page = np.repeat(np.arange(pages), n)
    begin = np.cumsum(n) - n
    kind, form, function = (np.array(x, np.int64)[ids] for x in (tokens.kind, tokens.form, tokens.function))
    is_word = kind != MARK
    words = np.bincount(page[is_word], minlength=pages)
    some = np.maximum(words, 1)
    heard = np.stack([np.bincount(page[function >> k & 1 > 0], minlength=pages) for k in range(len(names))] + [np.zeros(pages, np.int64)])
    given = [names.index(x) if x in names else len(names) for x in labels or [""] * pages]
    language = np.where(heard.max(0) >= 0.05 * some, heard.argmax(0), np.array(given, np.int64))

    has_form = form >= 0
    wide = np.int64(len(tokens.forms) + 1)
    own, place, count = np.unique(page[has_form] * wide + form[has_form], return_inverse=True, return_counts=True)
    repeats = np.zeros(len(ids), np.int64)
    repeats[has_form] = count[place]
    keyword = (kind == JOINED) | ((kind == WORD) & (repeats >= OFTEN) & (function == 0))

    at = np.arange(len(ids))
    low, high = np.maximum(at - NEAR, begin[page]), np.minimum(at + NEAR + 1, (begin + n)[page])
    around = lambda x: (upto := np.concatenate(([0], np.cumsum(x))))[high] - upto[low]
    beside = np.maximum(around(is_word), 1)
    bound = around((function > 0) + NUMERAL * (kind == NUMBER)) / beside
    loose = np.clip(2 * (1 - bound / USUAL), 0, 1)
    dense = np.clip(2 * around(keyword) / beside, 0, 1) ** 2
    density = np.bincount(page, weights=loose * dense * is_word, minlength=pages) / some

    forms, different = np.bincount(page[has_form], minlength=pages), np.bincount(own // wide, minlength=pages)
    share = count / np.maximum(forms[own // wide], 1)
    entropy = np.bincount(own // wide, weights=-share * np.log(share), minlength=pages) / np.log(np.maximum(forms, 2))
    repetition = np.where(forms > 0, 1 - different / np.maximum(forms, 1), 0.0)
    spoken = np.array([*names, ""])[language].tolist()
    out = zip(words.tolist(), spoken, density.tolist(), entropy.tolist(), repetition.tolist(), (heard[language, np.arange(pages)] / some).tolist(), strict=True)
    return [row if row[0] else (0, "", 0.0, 0.0, 0.0, 0.0) for row in out]


def language_label(label: Column) -> Column:
    """The two letters of a language label; empty where it names none."""
    two = F.substring(F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")))), 1, 2)
    return F.when(two.rlike("^[a-z]{2}$") & ~two.isin(*NO_LANGUAGE), two).otherwise("")


def learnt_words(pages: DataFrame) -> Words:
    """The function words of every language with enough pages (doc, text, label): words on ``COMMON`` of its different pages or more.

    A text that holds more than ``COPIES`` of all rows counts as one page
    whatever the number of its copies; there are at most 1/``COPIES`` of those, so
    they are broadcast.  What comes to the driver is at most 1/``LEAST_SHARE``
    languages and, as a page has each word once, at most a page's mean number of
    words divided by ``COMMON`` for each.
    """
    some = pages.where("trim(text) <> '' AND label <> ''").select("label", "text", F.xxhash64("text").alias("h"))
    counts = keep(some.groupBy("h").agg(F.count(F.lit(1)).alias("copies")), n=F.sum("copies"))
    total = counts.stats["n"] or 0
    often = F.broadcast(counts.df.where((F.col("copies") > 1) & (F.col("copies") > total * COPIES)))
    weighed = some.join(often, "h", "left").select("label", "text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    # the empty word stands on every page and so counts the pages
    word = F.explode(F.array_union(F.array(F.lit("")), F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    seen = keep(weighed.select("label", "weight", word).groupBy("label", "word").agg(F.sum("weight").alias("n"))).df
    size = {r["label"]: r["n"] for r in seen.where((F.col("word") == "") & (F.col("n") >= max(LEAST_PAGES, total * LEAST_SHARE))).collect()}
    least = F.lit(None).cast("double")
    for label, n in size.items():
        least = F.when(F.col("label") == label, F.lit(n * COMMON)).otherwise(least)
    lists: dict[str, set[str]] = {label: set() for label in size}
    for r in seen.where((F.col("word") != "") & (F.col("n") >= least)).collect() if size else []:
        lists[r["label"]].add(r["word"])
    return Words(lists)


def features_of(pages: DataFrame, words: Words) -> DataFrame:
    """(doc, h, language, words, density, entropy, repetition, function_share) for pages (doc, h, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words)
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            rows = []
            for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // LETTERS)) + 1):
                rows += features([texts[g] for g in group], tokens, [labels[g] for g in group])
                if len(tokens) > CACHE:
                    tokens = Tokens(words)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("h"), pa.array(cols[1], pa.string()), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                names=["doc", "h", "language", "words", *FEATURES],
            )

    return pages.mapInArrow(run, "doc long, h long, language string, words long, " + ", ".join(f"{f} double" for f in FEATURES))


class Figures:
    """The robust figures of one language: centre, scale and inverse covariance of the scaled features."""

    def __init__(self, centre: list[float], scale: list[float], covariance: np.ndarray):
        self.centre, self.scale = centre, scale
        self.inverse = np.linalg.inv(0.9 * covariance + 0.1 * np.eye(len(centre)))

    def scaled(self, point: list[float]) -> np.ndarray:
        return (np.array(point) - self.centre) / self.scale

    def towards(self, point: list[float], pole: list[float]) -> float:
        """Share of the way from the centre to the pole, in the metric of the distance."""
        z, p = self.scaled(point), self.scaled(pole)
        return float(z @ self.inverse @ p / max(p @ self.inverse @ p, 1e-9))


POOLED = "*"


def _by_language(figures: dict[str, Figures], value) -> Column:
    """A literal for each language with figures, that of all pages for the others."""
    out = F.lit(float(value(figures[POOLED])))
    for language, own in figures.items():
        if language != POOLED:
            out = F.when(F.col("language") == language, F.lit(float(value(own)))).otherwise(out)
    return out


def _scaled(df: DataFrame, figures: dict[str, Figures]) -> DataFrame:
    """``df`` with z0 to z3: each feature less its centre, in scales."""
    return df.select("*", *[((F.col(f) - _by_language(figures, lambda x, k=k: x.centre[k])) / _by_language(figures, lambda x, k=k: x.scale[k])).alias(f"z{k}") for k, f in enumerate(FEATURES)])


def _products(df: DataFrame, figures: dict[str, Figures], other: dict[str, np.ndarray] | None = None) -> Column:
    """z' P z, or z' P p with a point ``other`` for each language, where P is the language's inverse covariance."""
    if other is None:
        return sum((F.col(f"z{a}") * F.col(f"z{b}") * _by_language(figures, lambda x, a=a, b=b: x.inverse[a, b]) for a in range(4) for b in range(4)), F.lit(0.0))
    of = {id(x): x.inverse @ other[language] for language, x in figures.items()}
    return sum((F.col(f"z{a}") * _by_language(figures, lambda x, a=a: of[id(x)][a]) for a in range(4)), F.lit(0.0))


def robust_figures(features: DataFrame) -> dict[str, Figures]:
    """Figures of every language with ``LEAST_PAGES`` pages, and of all pages together as ``*``; none if there are no pages.

    Centre and scale are the median and the median absolute deviation; the
    covariance is that of the scaled features of the pages within three scales
    of the centre in all of them, pulled a tenth of the way to the identity.
    """
    both = features.select(F.explode(F.array(F.col("language"), F.lit(POOLED))).alias("language"), *FEATURES)

    def medians(df: DataFrame) -> dict[str, list[float]]:
        mid = df.groupBy("language").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES], F.count(F.lit(1)).alias("n"))
        return {r["language"]: [r[f] for f in FEATURES] + [r["n"]] for r in mid.collect()}

    centre = {k: v for k, v in medians(both).items() if k == POOLED or (k and v[-1] >= LEAST_PAGES)}
    if POOLED not in centre:
        return {}
    pick = lambda table, k: F.create_map(*[x for lang, v in table.items() for x in (F.lit(lang), F.lit(float(v[k])))])[F.col("language")]
    own = both.where(F.col("language").isin(list(centre)))
    off = own.select("language", *[F.abs(F.col(f) - pick(centre, k)).alias(f) for k, f in enumerate(FEATURES)])
    scale = {lang: [max(1.4826 * x, LEAST_SCALE) for x in v[:-1]] for lang, v in medians(off).items()}
    z = own.select("language", *[((F.col(f) - pick(centre, k)) / pick(scale, k)).alias(f) for k, f in enumerate(FEATURES)])
    core = z.where(" AND ".join(f"abs({f}) <= 3" for f in FEATURES))
    products = [(a, b) for a in range(4) for b in range(a, 4)]
    sums = core.groupBy("language").agg(*[F.avg(f).alias(f) for f in FEATURES], *[F.avg(F.col(FEATURES[a]) * F.col(FEATURES[b])).alias(f"x{a}{b}") for a, b in products])
    spread = {}
    for r in sums.collect():
        cov = np.zeros((4, 4))
        for a, b in products:
            cov[a, b] = cov[b, a] = r[f"x{a}{b}"] - r[FEATURES[a]] * r[FEATURES[b]]
        spread[r["language"]] = cov
    return {lang: Figures([float(x) for x in mid[:-1]], scale[lang], spread.get(lang, np.eye(4))) for lang, mid in centre.items()}


def spam_pole(features: DataFrame, figures: dict[str, Figures]) -> list[float] | None:
    """What spam looks like: the medians of the outliers towards spam in every feature, by ``SHOWN`` scales in density and function words.

    None where there are no such pages, or where they are not even half dense.
    """
    z = _scaled(features, figures)
    out = z.where(_products(z, figures) > FAR)
    for k, way in enumerate(TOWARDS_SPAM):
        out = out.where(F.col(f"z{k}") * way > (SHOWN if FEATURES[k] in ("density", "function_share") else 0))
    row = out.agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]).first()
    pole = [row[f] for f in FEATURES]
    return None if pole[0] is None or pole[0] < SHOWN_DENSITY else [float(x) for x in pole]


def score_pages(documents: DataFrame, doc: str = "doc_id", text: str = "text", label: str | None = "lang") -> DataFrame:
    """One row per page: doc_id, language, words, the four features, distance (squared, robust), towards and whether it is spam.

    The distance is Mahalanobis's from the centre of the page's language, with
    robust figures.  ``towards`` tells how far on the way from that centre to
    spam the page lies: its projection, in the metric of the distance, on the
    direction to what the clearest outliers look like.  Spam is an outlier
    that lies more than half way, as a page of which more than half is spam
    does.  Tables, adverts and hymns lie off in other directions.

    Words and figures are learnt from different texts, so that copies of a page
    don't make it ordinary.  A language whose own centre lies towards spam, and
    pages of no language, take the figures of all pages.  Null and blank pages
    have no words and are never spam; without an example of spam nothing is.
    """
    pages = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), language_label(F.col(label) if label else F.lit(None)).alias("label"))
    words = learnt_words(pages)
    kept = keep(features_of(pages.select("doc", F.xxhash64("text").alias("h"), "text", "label"), words)).df
    different = keep(kept.where("words > 0").groupBy("h").agg(*[F.first(c).alias(c) for c in ("language", *FEATURES)])).df
    figures = robust_figures(different)
    pole = spam_pole(different, figures) if figures else None
    if pole is not None:
        pooled = figures[POOLED]
        odd = [x for x, own in figures.items() if pooled.towards(own.centre, pole) > HALF_WAY / 2]
        if odd:
            figures = {x: own for x, own in figures.items() if x not in odd}
            pole = spam_pole(different, figures) or pole
    if not figures:
        return kept.select(F.col("doc").alias("doc_id"), "language", "words", *FEATURES, F.lit(0.0).alias("distance"), F.lit(0.0).alias("towards"), F.lit(False).alias("spam"))
    z = _scaled(kept, figures)
    distance, towards = _products(z, figures), F.lit(0.0)
    if pole is not None:
        ends = {language: own.scaled(pole) for language, own in figures.items()}
        towards = _products(z, figures, {language: p / max(float(p @ figures[language].inverse @ p), 1e-9) for language, p in ends.items()})
    spam = (F.col("words") > 0) & (F.col("distance") > FAR) & (F.col("towards") > HALF_WAY)
    return z.select(F.col("doc").alias("doc_id"), "language", "words", *FEATURES, distance.alias("distance"), towards.alias("towards")).withColumn("spam", spam)


def spam_pages(documents: DataFrame, doc: str = "doc_id", text: str = "text", label: str | None = "lang") -> DataFrame:
    """The ids of the pages that ``score_pages`` finds to be spam."""
    return score_pages(documents, doc, text, label).where("spam").select("doc_id")
