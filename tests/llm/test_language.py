import unicodedata
from collections import Counter

import numpy as np

from quillspark.llm import language_id
from tests.llm.test_models import BIG, fold

TOP = 300


def brute_grams(text):
    """Counts of all n-grams of 1 to 5 characters within the words of a text, words between blanks."""
    out, words, word, letter = Counter(), [], "", False
    for c in text.lower() + " ":
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind in ("Mn", "Mc"):
            word += c
            letter |= kind[0] == "L"
        elif word:
            words.append(f" {word} ")
            word = ""
    for w in words:
        for n in range(1, 6):
            for i in range(len(w) - n + 1):
                if w[i : i + n] != " ":
                    out[w[i : i + n]] += 1
    return out if letter else Counter()


def first(counts):
    # Blanks between words belong to both.
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP]]


def brute_judge(profiles, text):
    own = first(brute_grams(text or ""))
    if not own or not profiles:
        return "und", None
    away = {}
    for lang, ranked in profiles.items():
        at = {g: i for i, g in enumerate(ranked)}
        away[lang] = sum(abs(at[g] - i) if g in at else TOP for i, g in enumerate(own))
    return min(sorted(away), key=away.get), away


def test_every_document_as_by_brute_force(spark):
    rows = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang").collect()
    sums = {}
    for r in rows:
        if fold(r["doc_id"], 3) != 1 and r["lang"] is not None and r["text"] is not None:
            sums.setdefault(r["lang"], {})[(r["doc_id"], r["text"])] = r["text"]
    profiles = {lang: first(sum((brute_grams(t) for t in own.values()), Counter())) for lang, own in sums.items()}
    labelled = spark.read.parquet(f"{BIG}/documents.parquet")
    labelled = labelled.where(labelled.doc_id.isin([r["doc_id"] for r in rows if fold(r["doc_id"], 3) != 1]))
    made = language_id.learn_profiles(labelled, per_language=10**6)
    assert made.languages == sorted(profiles)
    for r in rows:
        want, away = brute_judge(profiles, r["text"])
        got, score = made.judge(r["text"])
        assert got == want
        if away:
            near, far = sorted(away.values())[:2]
            assert abs(score - (far - near) / far) < 1e-12


SCRIPTS = {
    "th": "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน และ ใช้ในประเทศไทย", "ja": "これは日本語の文章です。ひらがなとカタカナと漢字があります。",
    "ru": "Это предложение на русском языке, и оно довольно длинное.", "el": "Αυτή είναι μια πρόταση στα ελληνικά.", "en": "this is an English sentence of some length",
}


def test_many_scripts(spark):
    rows = [(i, t, lang, False) for i, (lang, t) in enumerate(SCRIPTS.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    made = language_id.learn_profiles(docs)
    asked = {"th": "ประเทศไทย", "ja": "漢字とひらがな", "ru": "русский язык", "el": "ελληνικά", "en": "English"}
    assert {lang: made.judge(t)[0] for lang, t in asked.items()} == {lang: lang for lang in asked}
    # Letters beyond the basic planes are letters; digits, signs and marks alone are not.
    assert made.judge(chr(0x20000) * 5)[0] != "und" and made.judge(chr(0x30001) * 5)[0] != "und"
    assert [made.judge(t)[0] for t in ("123 !?", "́̂", "", None)] == ["und"] * 4


def test_grams_of_texts_of_many_letters():
    rng = np.random.default_rng(2)
    for n in (30, 6000, 20_000):  # beyond 4095 different letters a key takes two words
        text = "".join(chr(0x4E00 + int(x)) + (" " if x % 7 == 0 else "") for x in rng.integers(0, n, 30_000))
        grams, counts = language_id.ranked_grams(text)
        want = brute_grams(text)
        assert [language_id.gram_text(g) for g in grams] == first(want)
        assert counts.tolist() == [want[language_id.gram_text(g)] for g in grams]


def test_ties_and_repeats(spark):
    rows = [(1, "ab", "x", False), (1, "ab", "x", False), (2, "ab", "y", False), (3, "cd", None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    made = language_id.learn_profiles(docs.where("not held_out"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, made).collect()]
    assert sorted(got) == [(1, "x"), (1, "x"), (2, "x"), (3, "x")]
