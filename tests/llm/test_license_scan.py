import random
import re

from paperlode.llm import license_scan as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(text)
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split(" ")
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        if own:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    r = random.Random(4)
    parts = ["GNU General Public License", "apache-license", "CC BY", "cc\nby", "MIT license", "mit", "general public license", "é", "X_y", "K", "mİt license", "İ", "gnu", "cc", "by cc by by", "Apache Licenses"]
    rows = [(0, None), (1, ""), (2, " .. "), (3, "cc"), (4, "cc by"), (4, "cc by"), (4, "mit license"), (None, "MIT LICENSE"), (None, None), (5, "cc by " * 3000)]
    rows += [(i, r.choice([" ", ", ", "\n"]).join(r.choices(parts, k=r.randrange(0, 25)))) for i in range(6, 200)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_words int, label string")
    got = L.scan(df).collect()
    want = [(i, *plain(t)) for i, t in rows]
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted(want, key=str)
    assert all(set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1 for x in got)


def judged(text):
    """Labels and score by counting, for each template, the distinct words that grams on diagonals d to d + NEIGHBOURS cover."""
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, score, notices = set(), 0.0, []
    for i, (template, label) in enumerate([*L.PHRASES.items(), *L.TEMPLATES.items()]):
        t, k = template.split(" "), 2 if i < len(L.PHRASES) else 4
        grams = [tuple(t[p : p + k]) for p in range(len(t) - k + 1)]
        places = {}
        for at in range(len(w) - k + 1):
            for p, g in enumerate(grams):
                if tuple(w[at : at + k]) == g:
                    places.setdefault(at - p, set()).add(p)
        for d in places:
            covered = {p + j for x in range(d, d + L.NEIGHBOURS + 1) for p in places.get(x, ()) for j in range(k)}
            score = max(score, len(covered) / len(t))
            if k == 2 and len(places[d]) == len(grams):
                labels.add(label)
            if k == 4 and len(t) - len(covered) <= max(L.MISSING, int(len(t) * L.MISSING_SHARE)):
                notices.append((L.families()[i - len(L.PHRASES)], d, len(covered) / len(t), label))
    for f, d, share, label in notices:
        if share >= max(s for g, e, s, _ in notices if g == f and abs(e - d) <= L.NEIGHBOURS):
            labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


def labels_of(spark, texts):
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [x.labels.split(",") for x in sorted(got, key=lambda x: x.doc_id)]


def test_inserted_and_missing_words_keep_the_label(spark):
    texts, want = [], []
    for text, label in L.TEMPLATES.items():
        w = text.split(" ")
        half = len(w) // 2
        for changed in (w, w[:half] + w[half + 1 :], w[: half - 1] + w[half:], *(w[:half] + ["really"] * n + w[half:] for n in (1, 8, 30))):
            texts.append("before " + " ".join(changed) + " after")
            want.append(label)
    assert [i for i, (own, label) in enumerate(zip(labels_of(spark, texts), want)) if label not in own] == []


def test_a_notice_is_not_taken_for_one_that_is_like_it(spark):
    notices = {label: t for t, label in L.TEMPLATES.items()}
    lgpl, gpl = notices["lgpl"], notices["gpl"]
    apart = " ".join(f"word{i}" for i in range(200))
    got = labels_of(spark, [lgpl, gpl, lgpl.replace("it and", "it now and"), f"{lgpl} {apart} {gpl}", f"{notices['bsd']} {notices['isc'].replace('hereby', '')}"])
    assert got == [["lgpl"], ["gpl"], ["lgpl"], ["gpl", "lgpl"], ["bsd", "isc"]]


def test_a_very_long_text(spark):
    notice = next(t for t, label in L.TEMPLATES.items() if label == "mpl")
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    assert labels_of(spark, [f"{words} {notice} {words} cc by", words]) == [["cc-by", "mpl"], [""]]


def test_labels_and_score_equal_brute_force(spark):
    r = random.Random(12)
    notices = [x.split(" ") for x in L.TEMPLATES]
    rows = [(0, "redistribution and " * 6 + "are permitted " * 6), (1, None), (2, "all rights reserved"), (3, "general public license")]
    for i in range(4, 120):
        w = list(r.choice(notices))
        for _ in range(r.randrange(0, 7)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(0, 2)] = r.choices(["really", "cc", "by", "software", "the"], k=r.randrange(0, 3))
        if r.random() < 0.3:
            w = w[: r.randrange(1, len(w) + 1)] * r.randrange(1, 4)
        rows.append((i, " ".join(["x"] * r.randrange(0, 9) + w + r.choices(["y", "mit", "license"], k=r.randrange(0, 5))).upper()))
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: judged(t) for i, t in rows}
    assert {x.doc_id: (x.labels, round(x.score, 9)) for x in got} == want
    assert want[0] == ("", want[0][1]) and len({x for x, _ in want.values()}) > 6
    assert all(len(t.split(" ")) <= 63 for t in L.TEMPLATES)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
