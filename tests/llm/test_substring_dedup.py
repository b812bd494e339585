import re

import pytest
from texts import EDGE_TEXTS, prose

from domquarry.llm.substring_dedup import PASSAGE as WORDS
from domquarry.llm.substring_dedup import RUN, dedup_substrings

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(t):
    """(start, end, words) of sentences with words."""
    t, out, a = t or "", [], 0
    for i in range(1, len(t) + 1):
        if i == len(t) or t[i - 1] == "\n" or (t[i - 1] in ".!?" and t[i] in " \t\n\x0b\x0c\r"):
            w = WORD.findall(t[a:i].translate(LOWER))
            if w:
                out.append((a, i, w))
            a = i
    return out


def firsts_of(places):
    """Of (what, place) pairs the places that aren't the first of their kind."""
    least = {}
    for what, place in places:
        least[what] = min(place, least.get(what, place))
    return {place for what, place in places if place != least[what]}


def brute(rows):
    """Runs of sentences first, then passages of words that these don't cover; all texts compared plainly."""
    docs = []
    for doc, t in rows:
        s = sentences(t)
        lower = (t or "").translate(LOWER)
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(lower)]
        docs.append((doc, t, s, words, (doc is None, doc or 0)))
    runs = [(tuple(tuple(x[2]) for x in s[i : i + RUN]), (key, i)) for _, _, s, _, key in docs for i in range(max(min(len(s), 1), len(s) - RUN + 1))]
    repeated, gone = firsts_of(runs), []
    for _, _, s, words, key in docs:
        at = {j for i in range(len(s)) if (key, i) in repeated for j in range(i, min(i + RUN, len(s)))}
        gone.append((at, {k for k, w in enumerate(words) for j in at if s[j][0] <= w[0] < s[j][1]}))
    grams = []
    for (_, _, _, words, key), (_, lost) in zip(docs, gone):
        plain = [w[2] for w in words]
        grams += [(tuple(plain[i : i + WORDS]), (key, i)) for i in range(len(plain) - WORDS + 1) if any(k not in lost for k in range(i, i + WORDS))]
    repeated, out = firsts_of(grams), []
    for (doc, t, s, words, key), (at, lost) in zip(docs, gone):
        left = {k for i in range(len(words)) if (key, i) in repeated for k in range(i, i + WORDS)} - lost
        touched, cut = set(at), set()
        for j in at:
            cut |= set(range(s[j][0], s[j + 1][0] if j + 1 in at else s[j][1]))
        for k in left:
            j = next(j for j, x in enumerate(s) if x[0] <= words[k][0] < x[1])
            touched.add(j)
            inside = [i for i, w in enumerate(words) if s[j][0] <= w[0] < s[j][1]]
            # between two words that go, all goes; a sentence's signs go with its first and last word
            a = s[j][0] if k == inside[0] else words[k][0]
            cut |= set(range(a, s[j][1] if k == inside[-1] else words[k][1]))
            if k + 1 in left:
                cut |= set(range(words[k][1], words[k + 1][0]))
        out.append((doc, len(s), len(touched), t if not cut else "".join(c for i, c in enumerate(t) if i not in cut)))
    return out


PASSAGE = prose(50, 60)


def fixture():
    rows = list(enumerate(EDGE_TEXTS))
    rows += [(100 + i, prose(100 + i, 80) + ("\n" if i % 2 else " tail ") + (PASSAGE.upper() if i % 3 else PASSAGE) + " " + prose(300 + i, 40)) for i in range(12)]
    rows += [(200 + i, prose(7, 90)) for i in range(4)]  # copies
    rows += [(300, f"{PASSAGE}\n{PASSAGE}"), (301, "Short. One."), (302, "Short. One."), (303, prose(8303, 50))]
    return [*rows, (None, PASSAGE), (100, rows[len(EDGE_TEXTS)][1])]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or ""))


def test_against_brute_force(docs_of):
    rows = fixture()
    out = dedup_substrings(docs_of(rows))
    got = [(r["doc_id"], r["n_sentences"], r["n_removed"], r["kept_text"]) for r in out.collect()]
    assert order(got) == order(brute(rows))
    assert out.columns.count("spans") == 1 and "lang" in out.columns


def test_what_is_caught(docs_of):
    by = {r["doc_id"]: r for r in dedup_substrings(docs_of(fixture()[:-1])).collect()}
    assert by[100]["n_removed"] == 0 and by[303]["n_removed"] == 0
    assert by[301]["n_removed"] == 0 and by[302]["n_removed"] == 2 and by[302]["kept_text"] == ""
    last = " ".join(PASSAGE.split()[-12:])
    assert all(last.lower() not in by[100 + i]["kept_text"].lower().replace("\n", " ") for i in range(1, 12))
    assert by[200]["n_removed"] == 0 and all(by[200 + i]["kept_text"].strip() == "" for i in (1, 2, 3))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_little(docs_of, rows):
    assert [r["n_removed"] for r in dedup_substrings(docs_of(rows)).collect()] == [0] * len(rows)


def words_of(seed, n, sep=" "):
    return sep.join(WORD.findall(prose(seed, n)))


LONG = {k: words_of(5000 + k, 51, sep) for k, sep in enumerate((" ", " ", ".*** ", ".&&&"))}


def passages(n):
    """Documents with a passage of n words in them: a sentence between others, in mid-sentence, with stops before other signs."""
    rows = []
    for k, (before, after) in enumerate(((". ", ". "), (" ", " "), (" ", " "), ("; ", ', "'))):
        p = LONG[k] if n == 51 else re.match(r"(?:\w+\W+){%d}\w+" % (n - 1), LONG[k]).group()
        rows += [(1000 + 10 * k + i, f"{words_of(6000 + 10 * k + i, 30)}{before}{p if i % 2 else p.upper()}{after}{words_of(7000 + 10 * k + i, 30)}", p) for i in range(3)]
    return [*rows, (2000, LONG[0][:1].upper() + LONG[0][1:] + ".", LONG[0])]


def test_passages_in_mid_sentence(docs_of):
    rows = passages(51)
    by = {r["doc_id"]: r for r in dedup_substrings(docs_of([r[:2] for r in rows])).collect()}
    for doc, text, p in rows:
        kept = WORD.findall(by[doc]["kept_text"].lower())
        if doc % 10 == 0 and doc < 2000:
            assert by[doc]["kept_text"] == text and by[doc]["n_removed"] == 0
        else:
            own = WORD.findall(text.lower())
            at = next(i for i in range(len(own)) if own[i : i + 51] == WORD.findall(p.lower()))
            assert kept == own[:at] + own[at + 51 :] and by[doc]["n_removed"] > 0 and by[doc]["spans"]


def test_shorter_passages_stay(docs_of):
    rows = [r[:2] for r in passages(50) if r[0] < 2000]
    assert all(r["n_removed"] == 0 and r["kept_text"] == dict(rows)[r["doc_id"]] for r in dedup_substrings(docs_of(rows)).collect())


def test_short_runs_go_too(docs_of):
    """No count of words keeps a repeated run: four sentences of a word each."""
    rows = [(1, "Uno one. A. B. C. D. Due one."), (2, "Tre two. A! B! C! D! Four two."), (3, "Five. A. B. C. Six.")]
    by = {r["doc_id"]: r for r in dedup_substrings(docs_of(rows)).collect()}
    assert [by[i]["n_removed"] for i in (1, 2, 3)] == [0, 4, 0] and by[2]["kept_text"] == "Tre two. Four two."


def test_two_hashes():
    """64 and 32 bits that have nothing to do with each other: equal ones of either kind don't fix the other."""
    import numpy as np

    from domquarry.llm.substring_dedup import runs

    h = np.arange(1, 9, dtype=np.uint64)
    other = h[::-1].copy()
    first = np.array([0, 8])
    _, _, x, y = runs(h, h, first, RUN)
    _, _, x2, y2 = runs(h, other, first, RUN)
    assert (x == x2).all() and (y != y2).all()


def test_long_text(docs_of):
    """Over 20,000 words and 1 MB."""
    long = prose(77, 90_000)
    rows = [(1, long), (2, "Head of it. " + long), (3, "\u00e9" * 600_000)]
    assert len(long) > 600_000
    by = {r["doc_id"]: r for r in dedup_substrings(docs_of(rows)).collect()}
    assert by[1]["n_removed"] == 0 and by[3]["n_removed"] == 0 and by[3]["kept_text"] == rows[2][1]
    assert by[2]["n_removed"] >= by[1]["n_sentences"] - 1 and len(by[2]["kept_text"]) < 60


def test_equal_passages_have_equal_anchors():
    import numpy as np

    from domquarry.llm.substring_dedup import _Words, anchors

    rows = [words_of(9000 + i, 40) + " " + LONG[0] + " " + words_of(9500 + i, i) for i in range(40)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    row, at, h = anchors(_Words(data, np.cumsum([0, *map(len, rows)])))
    for i in range(40):
        inside = {(p - 40, x) for p, x in zip(at[row == i].tolist(), h[row == i].tolist(), strict=True) if 40 <= p <= 71}
        if i == 0:
            least = min(inside, key=lambda v: v[1] % (1 << 64))
        assert least in inside
