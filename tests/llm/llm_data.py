"""Small documents with the troubles of large ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, n int, node long, sig long"
VOCAB = {
    "en": "the of and to in that it is was for on with as his they at be this from have or by one had not but what all were when".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", "", "a", "ing", "er", "ß" if lang == "de" else "ly"]) for _ in range(n))


def documents(seed=1, n=60):
    """Rows of SCHEMA: copies, near copies, shared passages, repeated rows, nulls, blanks, ties and one very long text."""
    rng = random.Random(seed)
    passage = sentence(rng, "en", 60)
    texts = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        t = ". ".join(sentence(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            t = f"{t}\n{passage} {t[:30]}"
        if i % 10 == 9 and texts:
            words = texts[rng.randrange(len(texts))][0].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "Changed"
            t = " ".join(words)
        texts.append((t, lang))
    rows = [(i, t, lang, f"src{i % 4}" if i % 9 else None, len(t)) for i, (t, lang) in enumerate(texts)]
    long = sentence(rng, "en", 4000)
    extra = [None, "", " \n\t ", "one", "four words are here", "a a a " * 40, texts[3][0], texts[3][0].upper(), long, "123 456", "ÀÉ ß", "x" * 30000, "line\nline\nline\nline\nother words"]
    rows += [(n + i, t, "en" if i % 2 else None, "src0", None) for i, t in enumerate(extra)]
    rows += [rows[4], rows[4]]  # repeated rows
    return [(*r, "clash", 7, 8, 9) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
