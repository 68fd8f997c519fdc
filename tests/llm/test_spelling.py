import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from sheafwork.llm import spelling

DOCS = "doc_id bigint, text string, word string, n bigint, root int"


def edits(word, alphabet):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(counts):
    """Every word against every other by its edits."""
    alphabet = "".join(sorted(set("".join(counts))))
    near = {w: sorted(edits(w, alphabet) & counts.keys()) for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def counted(docs):
    out = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    docs = []
    for k in range(300):
        words = [rnd.choice(stems) if rnd.random() < 0.5 else stems[min(int(rnd.expovariate(0.4)), 59)] for _ in range(120)]
        words = [w[:3] + rnd.choice(["b", "", "Éx"]) + w[4:] if rnd.random() < 0.1 else w for w in words]
        docs.append((k if k % 9 else None, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words), "x", 1, 2))
    docs += docs[:5] + [(7, None, "x", 1, 2), (8, "", "x", 1, 2)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(entry.queries()["op13_spelling_variants"](spark, str(tmp_path)))
    assert found == brute(counted(docs))
    assert any(r[1] for r in found)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 2000
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "zzzzzz": 10, "zzzzzy": 50, "zzzzzx": 50}
    counts |= {long: 6, long[1:]: 30, long[:100] + "c" + long[101:]: 200, "x": 9, "": 3, "\U0001d400b": 8, "\U0001d400": 80}
    table = spark.createDataFrame([*counts.items(), (None, 4), ("null", None)], "word string, n int")
    found = rows(spelling.variants(table))
    assert found == brute(counts)
    assert dict((r[0], r[2]) for r in found)["aaaaaa"] == "abbbbb"
    assert dict((r[0], r[1]) for r in found)["zzzzzz"] == "zzzzzx"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(entry.queries()["op13_spelling_variants"](spark, str(tmp_path))) == []


def test_a_very_long_text_and_bounded_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 3)
    docs = spark.createDataFrame([(1, "Ab cd ef gh ij. " * 100_000), (2, "q" * 1_000_000), (3, "ab")], "doc_id int, text string")
    found = {r.word[:9]: r.n for r in spelling.word_counts(docs, "[a-z]+").collect()}
    assert found == {"ab": 100_001, "cd": 100_000, "ef": 100_000, "gh": 100_000, "ij": 100_000, "qqqqqqqqq": 1}


@pytest.mark.parametrize("budget", [1, 7, 1 << 20])
def test_neighbourhood_is_whole_and_without_repeats(monkeypatch, budget):
    monkeypatch.setattr(spelling, "CANDIDATES", budget)
    words = ["aab", "b", "abab", "", "\U0001d400a"]
    found = list(spelling.neighbours(words, "ab\U0001d400", lambda hashes: np.arange(hashes.size)))
    assert len(found) == len(set(found))
    for k, word in enumerate(words):
        assert {x for i, x in found if i == k} == edits(word, "ab\U0001d400")


def test_hashes_of_candidates_are_those_of_their_strings():
    words, seen = ["abcabc", "ba"], []
    passes = lambda hashes: seen.extend(hashes.reshape(-1).tolist()) or np.arange(hashes.size)
    built = [x for _, x in spelling.neighbours(words, "abc", passes)]
    assert seen == [int(spelling._prefix_hashes(spelling._codes([x]))[0, -1]) if x else 0 for x in built]


def test_bit_table_passes_every_word(spark):
    words = [f"w{k}" for k in range(5000)]
    table, bits = spelling.bit_table(spark.createDataFrame([(w,) for w in words], "word string"), len(words))
    same = {}
    for w in words:
        same.setdefault(len(w), []).append(w)
    for group in same.values():
        hashes = spelling._prefix_hashes(spelling._codes(group))[:, -1]
        assert spelling._in_table(hashes, table, bits).size == len(group)
    others = spelling._prefix_hashes(spelling._codes([f"x{k:05}" for k in range(50_000)]))[:, -1]
    assert spelling._in_table(others, table, bits).size < 500
