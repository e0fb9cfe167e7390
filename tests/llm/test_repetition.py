import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siltra.llm import repetition as rp
from siltra.llm.common import words_of


def brute(words, run=8):
    marked = set()
    for i in range(len(words) - run + 1):
        if any(words[j:j + run] == words[i:i + run] for j in range(i)):
            marked |= set(range(i, i + run))
    return len(marked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(1, 8))
def test_counts_like_brute_force(words, run):
    assert rp.repeated_words(words, run) == brute(words, run)


def texts(seed=0):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(n))
    out = [None, "", "...", "one two", line(5)]
    for _ in range(80):
        a = line(rng.randrange(8, 30))
        out.append(". ".join([line(rng.randrange(3, 40)), *[a.upper() if rng.random() < 0.5 else a] * rng.randrange(0, 4)]))
    return out


def frame(spark):
    rows = [(i, t, ["en", "EN ", None, "de"][i % 4], [None, "a.pdf", "b.pdf"][i % 3], 5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, share int")


def test_found_is_exact(spark):
    df = frame(spark)
    got = {r.doc_id for r in rp.share_at_least(df).collect()}
    want = {r.doc_id for r in df.collect() if (w := words_of(r.text)) and brute(w) >= 0.3 * len(w)}
    assert got == want and len(want) > 10
    measured = {r.doc_id: (r.n_words, r.n_repeated) for r in rp.repetition(df).collect()}
    assert all(measured[i] == (len(words_of(t)), brute(words_of(t))) for i, t in enumerate(texts()))


def test_thresholds_follow_the_group(spark):
    # forms repeat by a third by nature, letters hardly; five texts of each are spam; a small group goes by its language
    rng = random.Random(7)
    share = lambda at: min(1.0, max(0.0, rng.gauss(at, 0.02)))
    rows = [(i, "en", "forms.pdf", share(0.35)) for i in range(600)] + [(1000 + i, "en", "letters.pdf", share(0.02)) for i in range(300)]
    rows += [(2000 + i, None, None, share(0.05)) for i in range(200)] + [(3000 + i, "de", f"{i}.txt", share(0.03)) for i in range(100)]
    spam = [(9000 + i, lang, source, 0.55 + i / 100) for i in range(5) for lang, source in (("en", "forms.pdf"),)]
    spam += [(9100 + i, "en", "letters.pdf", 0.2 + i / 100) for i in range(5)] + [(9200 + i, None, None, 0.3) for i in range(5)] + [(9300 + i, "de", f"{i}.txt", 0.25) for i in range(5)]
    measured = spark.createDataFrame([(k, "x", lang, s, v) for k, lang, s, v in rows + spam], "doc_id long, text string, lang string, source string, share double")
    flagged = {r.doc_id for r in rp.flag_repetitive(measured, rp.adaptive_thresholds(measured)).collect()}
    planted = {r[0] for r in spam}
    fixed = {r[0] for r in rows + spam if r[3] >= rp.SHARE}
    assert planted <= flagged and len(flagged - planted) <= 3  # recall 1, precision over 0.85
    assert len(fixed - planted) > 500 and planted - fixed  # which one fixed cutoff can't give


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rp.repetitive_documents(df).count() == 0
