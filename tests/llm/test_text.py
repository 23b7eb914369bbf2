"""Problems 6 to 8: planted cases, exact sums, nulls, empty and very long texts."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from phasewright.llm import leakage as L
from phasewright.llm.mixing import _encoding, chance, count_tokens, mix_sources, repetition_rates, source_label, tokenizer_file
from phasewright.llm.spam import Tokens, Words, features, kind_of, score_pages, spam_pages

NOUNS = "gill basalt glacier cable sediment fossil bellows aquifer thorn husk feather lattice rotor furnace pendulum tide meadow prism pollen gully anther vine".split()
ADJECTIVES = "gritty porous dense tidal layered saline glossy jagged slender colder acidic fibrous shallow fragile waxy coiled".split()
VERBS = "carries pierces filters loosens attracts supports scatters divides".split()
OPENING = "Read the passage below and then answer the question."


def item(seed, words=70):
    r = random.Random(seed)
    out = []
    while len(out) < words:
        out += ["the", r.choice(ADJECTIVES), r.choice(NOUNS), r.choice(VERBS), "every", r.choice(NOUNS), r.choice(["because", "while", "although", "near"])]
    return f"{OPENING} " + " ".join(out[:words]) + "\nQuestion: Why? Answer: the " + r.choice(NOUNS) + "."


def filler(r, n):
    return [r.choice("the monday town council has said that a parish school near river was closed by order of mayor until last friday and".split()) for _ in range(n)]


def page(r, inner, width=38, columns=1, noise=0.0):
    """The passage between filler, hyphenated into lines, maybe beside another column, misread at a rate."""
    words = filler(r, 60) + inner + filler(r, 60)

    def lines(words):
        out, line = [], ""
        for w in words:
            while w:
                room = width - len(line) - (1 if line else 0)
                if len(w) <= room:
                    line, w = f"{line} {w}".strip(), ""
                elif room > 4 and len(w) > 6:
                    out.append(f"{line} {w[: room - 1]}-".strip())
                    line, w = "", w[room - 1 :]
                else:
                    out.append(line)
                    line = ""
        return [*out, line]

    mine = lines(words)
    if columns == 2:
        other = lines(filler(r, len(words)))
        mine = [x for pair in zip(mine, other, strict=False) for x in pair]
    text = "\n".join(mine)
    return "".join(r.choice("aeioust") if c.isalpha() and r.random() < noise else c for c in text)


def test_leaks_are_found_as_the_scan_left_them(spark):
    r = random.Random(11)
    items = [(k, item(k), "x") for k in range(40)]
    body = lambda k: items[k][1][len(OPENING) :].split()
    docs, want = [], set()
    for d in range(60):
        k = d % 40
        n = len(body(k))
        start, length = (0, n) if d % 3 == 0 else (r.randint(0, n - 34), 34)
        inner = [w.upper() if d % 4 == 0 else w for w in body(k)[start : start + length]]
        docs.append((d, page(r, inner, columns=1 + d % 2, noise=0.01 * (d % 3)), "y"))
        want.add((d, k))
    for d in range(60, 90):  # the opening, a shred, and the words out of order
        inner = OPENING.split() + body(d % 40)[:9] + r.sample(body((d + 3) % 40), 40)
        docs.append((d, page(r, inner), "y"))
    docs += [(90, None, "y"), (91, "", "y"), (92, "\n\n--\n", "y"), (93, page(r, body(5)) + "\n" + " ".join(filler(r, 60_000)), "y")]
    want.add((93, 5))
    pages = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    table = spark.createDataFrame([*items, (98, None, "x"), (99, OPENING, "x")], "item_id long, text string, doc_id string")
    for block in (2000, 15, 3):  # one index, one pass with some, several passes
        got = {(x.doc_id, x.item_id) for x in L.leaked_items(pages, table, block=block).collect()}
        assert not got - want
        assert len(got & want) >= 0.95 * len(want) and (93, 5) in got
    assert L.leaked_items(pages.where("false"), table).collect() == [] and L.leaked_items(pages, table.where("false")).collect() == []


def test_leaks_in_narrow_columns_read_in_turn():
    r = random.Random(21)
    items = [(k, item(k)) for k in range(30)]
    index = L.ItemIndex.of(items, len(OPENING.split()))
    for width, noise in ((20, 0.0), (20, 0.03), (24, 0.03), (28, 0.05)):
        body = [items[k][1][len(OPENING) :].split() for k in range(30)]
        texts = [page(r, b[(at := r.randint(0, len(b) - 36)) : at + 36], width=width, columns=2, noise=noise) for b in body]
        got = {(t, i) for t, i, run, held, words in index.leaks(texts) if run >= L.RUN_WORDS and held >= L.SHARE * (words + 9)}
        assert sum((k, k) in got for k in range(30)) >= 27 and not {x for x in got if x[0] != x[1]}, (width, noise)
    assert list(L.ItemIndex.of([(1, OPENING)], len(OPENING.split())).leaks(["some page", ""])) == []


def test_sampling_reaches_its_recall():
    r = random.Random(12)
    letters = L.Letters(" ".join(item(k) for k in range(40))).codes
    signs = sorted(set(letters.tolist()))
    met = {}
    for edits in (0, 1, 2, 3):
        rows = []
        for _ in range(1500):
            at = r.randrange(len(letters) - 40)
            one = letters[at : at + 40].tolist()
            other = list(one)
            for _ in range(edits):
                at = r.randrange(L.WINDOW)
                other[at : at + 1] = [[r.choice(signs)], [], [other[at], r.choice(signs)]][r.randrange(3)]
            rows += [(one + [0] * 60)[:60], (other + [0] * 60)[:60]]
        h = L.sketch(np.array(rows, np.uint8).ravel(), np.arange(len(rows)) * 60)
        met[edits] = (h[:, ::2] == h[:, 1::2]).any(0).mean()
    assert met[0] == 1 and met[L.RADIUS] >= 0.9 and met[2] >= 0.65 and met[3] >= 0.4, met


def test_other_scripts_and_digits():
    r = random.Random(23)
    scripts = ["абвгдежзиклмнопрстуфхцчш", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789", "אבגדהוזחטיכלמנסעפצקרשת"]
    make = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(3, 7))) for _ in range(n))
    items = [(k, make(a, 60)) for k, a in enumerate(scripts)] + [(9, "".join(chr(r.randint(0x4E00, 0x9F00)) for _ in range(60)))]
    index = L.ItemIndex.of(items, 0)
    texts = [make(scripts[(k + 1) % 4], 50) + "\n" + " ".join(t.split()[10:40] if k < 9 else [t[10:45]]) + "\n" + make(scripts[(k + 2) % 4], 50) for k, t in items]
    got = {(t, i) for t, i, run, held, words in index.leaks(texts) if run >= L.RUN_WORDS and held >= L.SHARE * words}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 9)}
    assert L.canonical("Ŏdź Ağ ſo 1O") == L.canonical("odz ag so lo") and L.canonical("ли") != L.canonical("ил") and L.canonical("\U0001f600 a") == b"  o".replace(b"o", L.canonical("a"))


def test_edits_against_dynamic_programming():
    def exact(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    r = np.random.default_rng(3)
    a = r.integers(0, 3, (200, 12)).astype(np.uint8)
    b = np.concatenate((a, r.integers(0, 3, (200, 4)).astype(np.uint8)), 1)
    b[:, 3] = r.integers(0, 3, 200)
    b[::3] = np.roll(b[::3], 1, axis=1)
    got = L.edits(a, b)
    for x, y, g in zip(a, b, got, strict=True):
        e = exact(x.tolist(), y.tolist())
        assert g == e if e <= L.EDITS else g > L.EDITS


def test_runs():
    assert L.longest_run(np.array([1, 1, 0, 1] * 6, bool)) < 10
    assert L.longest_run(np.array([1] * 9 + [0, 0] + [1] * 9 + [0] * 4 + [1] * 5, bool)) == 20
    assert L.longest_run(np.zeros(4, bool)) == 0
    assert L.common_opening("One. Two", "One. Three") == 1 and L.common_opening("One. Two", "Other. Two") == 0 and L.common_opening(None, None) == 0


def test_misread_words_inside_a_run_count_for_the_share():
    held = np.zeros(91, bool)
    held[10:36] = True
    held[[15, 28]] = False
    assert L.longest_run(held) == 26 and L.printed_words([held]) == 26
    words = "the tidal bellows a husk is brittle near every slender pendulum because colder basalt scatters glossy feathers while saline aquifer a prism pierces layered furnace meadow".split()
    text = f"{OPENING} " + " ".join(words) + " " + " ".join(item(77, 65).split()[9:74])
    index = L.ItemIndex.of([(1, text)], 9)
    whole = len(text.split())
    short = [("x" if w in ("a", "is") else w) for w in words]
    ((_, _, run, printed, n),) = index.leaks([" ".join(filler(random.Random(1), 40) + short + ["monday"] * 9)])
    assert n + 9 == whole and run == 26 and printed == 26


def test_tokens(spark):
    texts = ["The parish council's 1,200 votes.", "", None, "Fähre " * 70_000, "naïve\n\n  text"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    own: tiktoken.Encoding = _encoding(tokenizer_file())
    got = [r.tokens for r in count_tokens(df).orderBy("k").collect()]
    assert got == [len(own.encode_ordinary(t)) if t else 0 for t in texts]


def test_source_labels(spark):
    df = spark.createDataFrame([("County Papers",), ("county_papers ",), ("COUNTY-PAPERS",), (None,)], "s string")
    assert [r[0] for r in df.select(source_label(F.col("s"))).collect()] == ["county_papers"] * 3 + [None]


def test_rates(spark):
    available = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000)], "source string, tokens long")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.25, 4), ("gone", 0.25, 3), (None, 0.1, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    rate = {r.source: r.rate for r in repetition_rates(available, targets).collect()}
    assert rate == pytest.approx({"a": 0.8, "b": 4.0, "gone": 0.0, "c": 0.0})  # b is used up at 160 = 40 / 0.25
    more = {r.source: r.rate for r in repetition_rates(available, targets, 200).collect()}
    assert more == pytest.approx({"a": 1.6, "b": 4.0, "gone": 0.0, "c": 0.0})
    most = {r.source: r.rate for r in repetition_rates(available, targets, 10**6).collect()}
    assert most == pytest.approx({"a": 2.0, "b": 4.0, "gone": 0.0, "c": 0.0})


def test_mixture(spark):
    r = random.Random(13)
    docs = [(k, " ".join(["word"] * r.randint(5, 40)), ["big", "BIG ", "small", None, "other"][k % 5 if k % 7 else 0], "z") for k in range(3000)]
    docs += [(9001, None, "big", "z"), (9002, "", "small", "z")]
    pages = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(pages, targets)
    shares = {x.source: x for x in mix.shares().collect()}
    assert all(abs(x.actual_share - x.target_share) < 0.03 and x.most_copies <= x.max_repeats for x in shares.values())
    copies = {x.doc: x.copies for x in mix.copies.collect()}
    assert not {9001, 9002} & set(copies)
    text = {d: t for d, t, _, _ in docs}
    emitted = mix.emitted().collect()
    assert sorted((x.doc, x.copy_no) for x in emitted) == sorted((d, k + 1) for d, n in copies.items() for k in range(n)) and all(x.text == text[x.doc] for x in emitted)
    assert all(abs(x.wanted_share - x.target_share) < 1e-9 for x in shares.values())
    assert {x.doc: x.copies for x in mix_sources(pages, targets).copies.collect()} == copies
    assert mix_sources(pages.where("false"), targets).shares().where("drawn_tokens > 0").count() == 0
    u = [x[0] for x in spark.range(2000).select(chance("s", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


LINKS = "www.boots24-shop.example/?id=12&tag=boots\nhttps://boots24-shop.example/boots-3.html\nbest boots\nshop.lamps.invalid/lamps-9.html\n"
TAGS = "cat:boots; colour:lamps; SKU 12345 size:boots;\n#boots #lamps #boots #seeds SKU 99887\noutlet-boots, best-lamps, outlet-seeds,\n"
STUFFED = "best boots Falford, best boots Yarmoor, boots in Zelfell,\nBOOTS boots Corbane boots, sale boots >>\nfree * boots * lamps * free * boots *\n"
SYLLABLES = "mor tal ven sur pel lim gro das ta ken lo ris mu ber ni sol wa fen quin dro hask lu vor tep il".split()
FRAMES = {
    "en": "the {} of the {} was {} by a {} and it has been said that the {} will be {} on the {} because of the {}",
    "de": "die {} und der {} wurde von dem {} nicht {} und man sagt daß die {} aus der {} mit dem {} nach {} zu {} ist",
}


def prose(r, language, n):
    """About ``n`` words of sentences, in the frame of a language."""
    out = []
    while len(out) < n:
        out += FRAMES[language].format(*[r.choice(SYLLABLES) + r.choice(SYLLABLES) + language for _ in range(9)]).split() + [".\n"]
    return " ".join(out)


def odd_page(r, k):
    """Newspaper matter that is not, or not only, sentences: tides, prices, adverts and hymns."""
    name, noun = lambda: r.choice(SYLLABLES).title() + r.choice(SYLLABLES), lambda: r.choice(SYLLABLES) + r.choice(SYLLABLES)
    if k % 4 == 0:
        return "".join(f"{r.choice(['Monday', 'Tuesday', 'Friday'])} {r.randint(1, 12)}.{r.randint(10, 59)} a.m. {r.randint(1, 12)}.{r.randint(10, 59)} p.m.\n" for _ in range(40))
    if k % 4 == 1:
        return "".join(f"{noun()}, per cwt., {r.randint(10, 99)}s. {r.randint(1, 11)}d. to {r.randint(10, 99)}s.\n" for _ in range(40))
    if k % 4 == 2:
        return "".join(f"{name()} & SON, {name()}. Price {r.randint(2, 99)}. WANTED a {noun()} hand for the {noun()} of {name()}; write to {name()}, with a {noun()} by the {noun()}.\n" for _ in range(15))
    line = prose(r, "en", 40)
    return "".join(prose(r, "en", 20) + line for _ in range(6))


def test_spam(spark):
    r = random.Random(31)
    bad = [LINKS * 8, TAGS * 8, STUFFED * 8, (LINKS + TAGS + STUFFED) * 3, prose(r, "en", 60) + STUFFED * 7, prose(r, "de", 90) + TAGS * 12]
    good = [prose(r, "en", 260) + TAGS * 3, prose(r, "en", 700) + STUFFED * 5, prose(r, "de", 300) + LINKS * 4, *[odd_page(r, k) for k in range(12)]]
    rows = [(k, t, "EN" if k % 2 else None, 0.1) for k, t in enumerate(bad + good)]
    rows += [(100 + k, prose(r, "de" if k % 5 == 0 else "en", r.randint(80, 400)) + (odd_page(r, k) if k % 7 == 0 else ""), [None, "und"][k % 20] if k % 20 < 2 else "de" if k % 5 == 0 else "en", 0.2) for k in range(400)]
    rows += [(900, None, "en", 0.0), (901, "", "fr", 0.0), (902, "' |\n--", None, 0.0), (903, prose(r, "en", 60_000), "en", 0.0), (904, LINKS * 4000, None, 0.0), (905, " \n", "de", 0.0)]
    schema = "doc_id long, text string, lang string, distance double"
    want = set(range(len(bad))) | {904}
    pages = spark.createDataFrame(rows, schema)
    assert {x.doc_id for x in spam_pages(pages).collect()} == want
    scores = {x.doc_id: x for x in score_pages(pages).collect()}
    assert len(scores) == len(rows) and scores[900].words == 0 and not scores[900].spam and scores[101].language == "en" and scores[100].language == "de"
    assert scores[0].towards > 0.8 and scores[0].distance > scores[6].distance > 18.47 and scores[6].towards < 0.5  # an outlier too, but not half way
    # copies of a page of a small language hold a third of all rows and more
    copies = spark.createDataFrame(rows + [(2000 + k, TAGS * 8, "de", 0.0) for k in range(300)], schema)
    assert {x.doc_id for x in spam_pages(copies).collect()} == want | set(range(2000, 2300))
    assert spam_pages(pages.where("doc_id BETWEEN 100 AND 500"), label=None).collect() == []  # nothing shows what spam is
    assert spam_pages(pages.where("false")).collect() == []


def test_kinds_of_tokens():
    from phasewright.llm.spam import JOINED, MARK, NUMBER, WORD

    kinds = {"Boots,": WORD, "co-op": WORD, "don't": WORD, "1s.": NUMBER, "4.30": NUMBER, ">>": MARK, "cat:boots;": JOINED, "#boots": JOINED, "shop.lamps.test": JOINED, "a.m.": WORD, "b00ts": WORD, "": MARK}
    assert {t: kind_of(t)[0] for t in kinds if t} == {t: k for t, k in kinds.items() if t}
    words = Words({"en": {"the", "of"}, "de": {"die"}})
    assert features([None, "", "the the of"], Tokens(words))[2][:2] == (3, "en") and features(["x", None], Tokens(Words({})))[0][1] == ""
