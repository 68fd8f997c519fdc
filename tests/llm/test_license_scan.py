import re
from collections import Counter

from sheafwork.llm import license_scan as l


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def pairs(w):
    return Counter(zip(w, w[1:]))


def plain(text, threshold):
    """{(kind, place): (licence, shared, dice)} by comparing every unit with every template."""
    if text is None:
        return {}
    lines, parts = re.split(r"\r?\n|\r", text), re.split(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*", text)
    units = [("text", 0, text)] + [("line", k, x) for k, x in enumerate(lines) if len(lines) > 1] + [("paragraph", k, x) for k, x in enumerate(parts) if len(parts) > 1]
    out = {}
    for kind, place, unit in units:
        own = pairs(words(unit))
        best = None
        for k, (name, template) in enumerate(l.TEMPLATES):
            other = pairs(words(template))
            shared = sum((own & other).values())
            dice = 2 * shared / (sum(own.values()) + sum(other.values()))
            if own and dice >= threshold and (best is None or (dice, -k) > best[0]):
                best = ((dice, -k), name, shared)
        if best:
            out[kind, place] = (best[1], best[2], round(best[0][0], 9))
    return out


MIT = l.TEMPLATES[12][1]
TEXTS = [
    None, "", "one", "MIT License", "Released under the MIT License.", "released UNDER the mit licence!", "Intro words here.\nLicensed under the Apache License, Version 2.0.\nmore",
    MIT, "Some project\n\n" + MIT.replace(", ", ",\n") + "\n\nThe end of it.", MIT + " " + MIT, MIT.replace("Software", "Program"), "word " * 30_000 + "\nLicensed under CC BY 4.0.",
    "Licensed under CC BY-NC 4.0.\r\n\r\nLicensed under CC BY-SA 4.0.", "the the the the the", "Released under the MIT License.",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(TEXTS)], "doc_id long, text string, kind string, place int")
    for threshold in (0.8, 0.5):
        got = {}
        for r in l.scan(docs, threshold=threshold).collect():
            got.setdefault(r.doc_id, {})[r.kind, r.place] = (r.licence, r.shared, round(r.dice, 9))
        assert got == {k: found for k, t in enumerate(TEXTS) if (found := plain(t, threshold))}


def test_nulls_repeats_no_rows_and_no_python(spark):
    text = "Released under the MIT License."
    docs = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    out = l.scan(docs)
    assert sorted(((r.doc_id, r.shared) for r in out.collect()), key=repr) == sorted([(None, 4), (1, 4), (1, 4)], key=repr)
    assert l.scan(docs.where("false")).count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def plain_windows(text, threshold):
    """[(place, licence, shared, unit_size)] by comparing every run of words with every template."""
    w = words(text or "")
    own = list(zip(w, w[1:]))
    found = []
    for k, (name, template) in enumerate(l.WINDOW_TEMPLATES):
        other = pairs(words(template))
        size = sum(other.values())
        for a in range(len(own)):
            seen, shared, best = Counter(), 0, None
            for b in range(a, len(own)):
                seen[own[b]] += 1
                shared += seen[own[b]] <= other[own[b]]
                dice = 2 * shared / (b - a + 1 + size)
                if dice >= threshold and (best is None or (shared, dice) > best[:2]):
                    best = (shared, dice, b)
            if best:
                found.append((-best[0], -best[1], k, a, best[2], name))
    taken = []
    for f in sorted(found):
        if not any(t[3] <= f[4] and f[3] <= t[4] for t in taken):
            taken.append(f)
    return sorted((f[3], f[5], -f[0], f[4] - f[3] + 1) for f in taken)


APACHE = l.TEMPLATES[0][1]
NOTICES = [
    "Some project of ours\n\n" + MIT.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE") + "\n\nThe end of it.",
    "You should know that all this is " + APACHE + " as we have told you before and will again",
    "intro of it\n" + "\n".join(re.findall(r".{1,60}(?:\s|$)", l.TEMPLATES[14][1])) + "\nprogram text goes on here",
    l.WINDOW_TEMPLATES[17][1].replace("2. ", "\n\n2. "),
    MIT + " " + MIT, "word " * 500, "the software of the software", "", None, "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.",
]


def test_windows_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    out = l.scan_windows(docs)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.place, r.licence, r.shared, r.unit_size))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, t in enumerate(NOTICES) if (w := plain_windows(t, 0.8))}
    assert [[x[1] for x in sorted(got[k])] for k in range(5)] == [["MIT"], ["Apache-2.0"], ["GPL-3.0-or-later"], ["BSD-3-Clause"], ["MIT", "MIT"]]
    assert l.scan_windows(docs.where("false")).count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def test_like_licences_are_told_apart_and_clashing_columns(spark):
    known = l.WINDOW_TEMPLATES[16:]
    rows = [(k, "Intro to it.\n\n" + t.replace(". ", ".\n") + "\n\nEnd of it.", "x", 1) for k, (_, t) in enumerate(known)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string, row int")
    got = {r.doc_id: (r.licence, r.place) for r in l.scan_windows(docs).collect()}
    assert got == {k: (name, 3) for k, (name, _) in enumerate(known)}


def test_long_text(spark):
    filler = "quite ordinary text about software that goes on " * 20_000
    docs = spark.createDataFrame([(1, filler + dict(l.WINDOW_TEMPLATES)["Zlib"] + " " + filler)], "doc_id long, text string")
    assert [(r.licence, r.place, r.dice) for r in l.scan_windows(docs).collect()] == [("Zlib", 160_000, 1.0)]


def test_templates_of_a_folder(spark, tmp_path):
    long = [" ".join(f"{w}{k % (7 + m)} of the licence" for k in range(900 + m)) for m, w in enumerate(("term", "clause"))]
    for name, text in (("Long-1.0.txt", long[0]), ("Long-2.0", long[1]), ("Copy-of-1.0.md", long[0]), ("Empty.txt", ""), ("One.txt", "word")):
        (tmp_path / name).write_text(text)
    folder = l.templates_in(spark, str(tmp_path))
    known = l.templates(spark).unionByName(folder)
    changed = long[0].replace("term3", "condition")
    docs = spark.createDataFrame([(1, changed), (2, "Title\n\n" + long[1]), (3, MIT), (4, long[0][:500]), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.kind): (r.licence, round(r.dice, 9)) for r in l.scan(docs, known).collect()}
    own, other = pairs(words(changed)), pairs(words(long[0]))
    dice = round(2 * sum((own & other).values()) / (own.total() + other.total()), 9)
    assert 0.8 <= dice < 1
    whole = round(2 * (len(words(long[1])) - 1) / (2 * len(words(long[1])) - 1), 9)
    assert got == {(1, "text"): ("Copy-of-1.0", dice), (2, "text"): ("Long-2.0", whole), (2, "paragraph"): ("Long-2.0", 1.0), (2, "line"): ("Long-2.0", 1.0), (3, "text"): ("MIT", 1.0)}
    assert l.scan(docs, folder.where("false")).count() == 0


def test_size_ranges_allow_the_same_units():
    sizes = [5, 7, 40, 42, 4000]
    for threshold in (0.5, 0.8, 0.95):
        least, most = threshold / (2 - threshold), (2 - threshold) / threshold
        ranges = l.size_ranges(sizes, threshold)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and len(ranges) <= len(sizes)
        for n in range(1, 10_000):
            assert any(a <= n <= b for a, b in ranges) == any(least * s <= n <= most * s for s in sizes)


def test_windows_without_markers(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    all_of = sorted(map(tuple, l.scan_windows(docs).collect()))
    monkeypatch.setattr(l, "MARKED_BIGRAMS", 0)
    assert sorted(map(tuple, l.scan_windows(docs).collect())) == all_of
