"""Language scores against a plain version of the fit and of the scores, and texts in languages that were not learned."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from millrace.llm import language


def plain_model(rows):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for w in language.words_of(text):
            counts[lang, 0][w] += 1
            for order in language.ORDERS:
                counts[lang, order].update(language.grams_of(w, order))
    return counts


def plain_score(counts, langs, text):
    total = dict.fromkeys(langs, 0.0)
    words = language.words_of(text or "")
    for w in words:
        for order in (0, *language.ORDERS):
            names = [w] if order == 0 else language.grams_of(w, order)
            known = [x for x in names if any(counts[lang, order][x] for lang in langs)]
            if known:
                for lang in langs:
                    held = counts[lang, order]
                    total[lang] += sum(math.log((held[x] + language.SMOOTH) / (sum(held.values()) + 1.0)) for x in known) / len(known)
                break
    if not words:
        return "und", 0.0
    top = max(total.values())
    best = min(lang for lang in langs if total[lang] == top)
    return best, 1.0 / sum(math.exp(x - top) for x in total.values())


def test_fit_and_scores_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    rows = docs.collect()
    held = {r["doc_id"] for r in docs.where(language.held_out()).select("doc_id").collect()}
    learned = [(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None and r["doc_id"] not in held]
    counts, langs = plain_model(learned), sorted({lang for lang, _ in learned})
    odd = ["zzgx qwv", "the the", "", None, "123 !", "日本", "é"]
    extra = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(odd)], "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    assert model.langs == langs
    assert len(model.tables[0][0]) == len({w for lang in langs for w in counts[lang, 0]})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs.unionByName(extra), model).collect()}
    for d, t in [*((r["doc_id"], r["text"]) for r in rows), *((10_000 + i, t) for i, t in enumerate(odd))]:
        lang, score = plain_score(counts, langs, t)
        assert abs(got[d][1] - score) < 1e-4, (d, got[d], lang, score)
        assert got[d][0] == lang or abs(score - 1 / len(langs)) < 1e-6


def test_texts_of_unlearned_languages_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.learn(docs)
    word = max((w for w in (docs.first()["text"] or "a").split() if w.isalpha()), key=len)
    rows = spark.createDataFrame([(1, f"これは 日本語 の 文章 です {word}"), (2, f"слово за словом {word} идёт"), (None, None), (4, "...")], "doc_id bigint, text string")
    assert language.accepted(rows, model).collect() == []
    kept = language.accepted(docs, model)
    assert kept.count() >= 0.99 * docs.where("text is not null and text rlike '[a-zA-Z]{3}'").count()
    assert kept.columns == docs.columns
    assert language.accepted(docs.limit(0), model).collect() == []
