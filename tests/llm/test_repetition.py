import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from texloom.llm.repetition import RepetitionRules, _of_batch, maximal_repeats, repetition


def brute(words, least=8):
    best, covered = 0, [False] * len(words)
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                best = max(best, n)
                for k in range(n):
                    covered[i + k] = covered[j + k] = True
    return sum(covered), best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=50), st.integers(0, 50))
def test_covered_and_longest(words, again):
    words = [w.encode() for w in words + words[:again]]
    rows, spans = _of_batch([b" ".join(words), b"x y", b" ".join(words)], RepetitionRules(), True)
    assert (rows[0][2], rows[0][3]) == brute(words)
    assert rows[0].tolist() == rows[2].tolist() and sum(s["end"] - s["start"] for s in spans[0]) == rows[0][2]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    assert rows[0][1] == len({i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_maximal_repeats(words):
    least = 2
    want = {}
    for n in range(least, len(words)):
        places = defaultdict(list)
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append(i)
        for where in places.values():
            left = {words[i - 1] if i else None for i in where}
            right = {words[i + n] if i + n < len(words) else i for i in where}
            if len(where) > 1 and len(left) > 1 and len(right) > 1:
                want[tuple(where)] = n
    assert {tuple(p): n for n, p in maximal_repeats(words, least)} == want


def test_a_repeat_at_the_start_of_a_text():
    """What comes before a text in the batch is not what its first words follow."""
    repeat = [f"r{i}" for i in range(9)]
    first, second = ["x", "y", "z"], [*repeat, "z", *repeat]
    rows, _ = _of_batch([" ".join(t).encode() for t in (first, second)], RepetitionRules(), False)
    assert rows[1].tolist() == [19, 18, 18, 9, 18, 1]


def test_nested_intervals_take_linear_time():
    words = [b"a"] * 60_000 + [b"b", b"a"] * 20_000
    rows, _ = _of_batch([b" ".join(words)], RepetitionRules(), False)
    assert rows[0][2] == 100_000 and rows[0][3] == 59_999


def test_base_columns(docs):
    import re

    for r in repetition(docs, keep=["doc_id", "text"]).collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_rules(spark):
    rng = random.Random(1)
    fresh = [f"w{i}" for i in range(2000)]
    passage = fresh[:120]
    texts = [" ".join(fresh), " ".join(passage + fresh[200:900] + passage), " ".join(fresh[:10] * 40)]
    rng.shuffle(fresh)
    found = repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in found] == [True, False, False]
    assert found[1]["longest_repeat"] == 120 and not found[1]["base_failed"]


def test_short_phrases_decide(spark):
    differing = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (3, 5, 7):
        lines = [[f"s{k}" for k in range(size)] + differing[3 * i : 3 * i + 3] for i in range(60)]
        texts.append("\n".join(" ".join(x) for x in lines))
    few = [[f"s{k}" for k in range(5)] + differing[20 * i : 20 * i + 20] for i in range(60)]
    texts.append("\n".join(" ".join(x) for x in few))
    found = repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["base_failed"] for r in found] == [False] * 4 and [r["covered_words"] for r in found] == [0] * 4
    assert [r["short_covered_words"] for r in found] == [180, 300, 420, 300]
    assert [r["kept"] for r in found] == [False, False, False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40))
def test_short_covered(words):
    words = [w.encode() for w in words]
    assert _of_batch([b" ".join(words)], RepetitionRules(), False)[0][0][4] == brute(words, 3)[0]


def test_odd_rows(odd, none):
    rows = repetition(odd.withColumn("Kept", F.lit("mine")), spans=True)
    found = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == 10 and found[2]["n_words"] == found[3]["n_words"] == found[4]["n_words"] == 0
    assert found[2]["base_failed"] and not found[2]["kept"] and found[6]["longest_repeat"] == 59_998
    assert found[8]["n_words"] == 7 and repetition(none).count() == 0
    assert repetition(odd, only_kept=True).columns == odd.columns
